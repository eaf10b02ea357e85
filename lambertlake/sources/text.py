"""Spectra in text tables: delimiter, decimal mark, layout and names are found from the content."""

from __future__ import annotations

import csv
import io
import math
import re
from dataclasses import dataclass, field

import numpy as np

LAYOUTS = ("auto", "columns", "xy_pairs", "rows")
# Heads that say what an axis is, not what a sample is called.
AXIS_WORDS = set(
    "wavelength|wavelength (nm)|wavelength nm|wavelength nm.|nm|wl|lambda|abs|abs.|absorbance|absorbance (au)|au|%t|transmittance|data|value|values|intensity|"
    "wavelength[nm]|abs[au]|absorbance[au]|(nm)|nm.|".split("|")
)
AXIS_LETTERS = set("atxy")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z")
_COMMA_NUMBER = re.compile(r"(?:^|[\s;\t|])[+-]?\d+,\d+(?:[eE][+-]?\d+)?(?=$|[\s;\t|])", re.M)
DELIMITERS = ("\t", ";", ",", "|", None)  # None: white space


class FormatError(ValueError):
    """A file that holds no readable spectra."""


@dataclass
class Found:
    """A spectrum read from a file."""

    name: str
    x: np.ndarray
    y: np.ndarray
    metadata: dict[str, str] = field(default_factory=dict)

    def tidy(self) -> Found:
        """x ascending, repeated x averaged, points that aren't finite dropped."""
        x, y = np.asarray(self.x, float), np.asarray(self.y, float)
        good = np.isfinite(x) & np.isfinite(y)
        x, y = x[good], y[good]
        if len(x) < 2:
            raise FormatError(f"{self.name}: fewer than two points")
        unique, back = np.unique(x, return_inverse=True)
        if len(unique) < 2:
            raise FormatError(f"{self.name}: all wavelengths are equal")
        return Found(self.name, unique, np.bincount(back, y) / np.bincount(back), self.metadata)


def decode(raw: bytes) -> str:
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    if raw[:400].count(0) > len(raw[:400]) // 4:
        return raw.decode("utf-16-le", "replace")
    for name in ("utf-8", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def to_float(cell: object, comma: bool = False) -> float:
    """The number in a cell, NaN for anything else."""
    if isinstance(cell, bool) or cell is None:
        return math.nan
    if isinstance(cell, (int, float)):
        return float(cell)
    text = str(cell).strip().strip("\"'").strip().replace("−", "-")
    for space in (" ", " ", " "):
        text = text.replace(space, "")
    if comma:
        text = text.replace(",", ".")
    return float(text) if _NUMBER.match(text) else math.nan


def split_lines(content: str, delimiter: str | None) -> list[list[str]]:
    if delimiter is None:
        return [line.split() for line in content.splitlines()]
    try:
        return list(csv.reader(io.StringIO(content.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")), delimiter=delimiter))
    except csv.Error as error:
        raise FormatError(f"not a table: {error}") from error


def detect_format(content: str) -> tuple[str | None, bool]:
    """The delimiter and decimal mark under which most cells of the first lines are numbers."""
    head = "\n".join(content.splitlines()[:400])
    has_comma = bool(_COMMA_NUMBER.search(head))
    best: tuple[float, str | None, bool] = (-1.0, None, False)
    scores = {}
    for delimiter in DELIMITERS:
        for comma in (False, True):
            if comma and (not has_comma or delimiter == ","):
                continue
            numbers = cells = lines = 0
            try:
                rows = split_lines(head, delimiter)
            except FormatError:
                continue
            for row in rows:
                own = sum(not math.isnan(to_float(c, comma)) for c in row)
                if own >= 2:
                    lines += 1
                    numbers += own
                    cells += sum(bool(c.strip()) for c in row)
            scores[delimiter, comma] = (numbers, lines)
            score = numbers * (numbers / cells if cells else 0)
            if score > best[0]:
                best = (score, delimiter, comma)
    _, delimiter, comma = best
    if delimiter is None:  # an explicit delimiter on nearly all numeric lines is meant
        for other in DELIMITERS[:-1]:
            for c in (comma, not comma):
                if (other, c) in scores and scores[other, c][1] >= 0.8 * max(1, scores[None, comma][1]) and scores[other, c][0] >= scores[None, comma][0]:
                    return other, c
    return delimiter, comma


def is_axis(v: np.ndarray) -> bool:
    """Whether values run like wavelengths: one direction, few repeats, no large gaps, 50 or more."""
    v = v[np.isfinite(v)]
    if len(v) < 3:
        return False
    step = np.diff(v)
    repeats = int((step == 0).sum())
    moving = np.abs(step[step != 0])
    one_way = (step >= 0).all() or (step <= 0).all()
    return bool(one_way and len(moving) and repeats <= 0.05 * len(step) and moving.max() / np.median(moving) < 5 and np.abs(v).min() >= 50)


def finite_run(v: np.ndarray) -> tuple[int, int]:
    """The longest stretch of finite values, as start and stop."""
    edges = np.flatnonzero(np.diff(np.r_[0, np.isfinite(v).astype(int), 0])).reshape(-1, 2)
    return tuple(map(int, edges[np.argmax(edges[:, 1] - edges[:, 0])])) if len(edges) else (0, 0)


class Grid:
    """Cells of a table as text and as numbers."""

    def __init__(self, rows: list[list], comma: bool = False) -> None:
        width = max(map(len, rows), default=0)
        self.text = [[("" if c is None else str(c)).strip() for c in r] + [""] * (width - len(r)) for r in rows]
        self.number = np.full((len(rows), width), np.nan)
        for i, r in enumerate(rows):
            for j, c in enumerate(r):
                self.number[i, j] = to_float(c, comma)

    def name_above(self, row: int, columns: tuple[int, ...], single: bool) -> str | None:
        for i in range(row - 1, max(-1, row - 6), -1):
            if self.text[i] and self.text[i][0].startswith("#"):
                continue
            for j in columns:
                cell = self.text[i][j]
                low = cell.lower()
                if low in AXIS_WORDS or (single and low in AXIS_LETTERS) or not math.isnan(to_float(cell)):
                    continue
                return cell.strip("\"'")
        return None

    def metadata(self) -> dict[str, str]:
        """Heading lines of the forms key: value, key = value, or two cells."""
        out: dict[str, str] = {}
        for i, cells in enumerate(self.text[:80]):
            if np.isfinite(self.number[i]).sum() >= 2 or len(out) >= 60:
                break
            given = [c for c in cells if c]
            joined = given[0].lstrip("# ") if len(given) == 1 else ""
            match = re.match(r"([^:=]{1,60})[:=]\s*(.+)", joined)
            if match:
                out[match[1].strip()] = match[2].strip()
            elif len(given) == 2 and given[0].lower() not in AXIS_WORDS:
                out[given[0].rstrip(":=").strip()] = given[1]
        return out


def _columns(g: Grid, default: str) -> list[Found]:
    width = g.number.shape[1]
    for axis in range(width):
        a, b = finite_run(g.number[:, axis])
        x = g.number[a:b, axis]
        if b - a < 3 or not is_axis(x):
            continue
        taken = [j for j in range(axis + 1, width) if np.isfinite(g.number[a:b, j]).sum() >= max(3, 0.8 * (b - a))]
        if taken:
            single = len(taken) == 1
            names = [g.name_above(a, (j,), single) or (default if single else f"{default} #{n + 1}") for n, j in enumerate(taken)]
            return [Found(n, x, g.number[a:b, j]) for n, j in zip(names, taken)]
    return []


def _pairs(g: Grid, default: str) -> list[Found]:
    width = g.number.shape[1]
    out = []
    pairs = []
    for j in range(0, width - 1, 2):
        a, b = finite_run(g.number[:, j])
        if b - a >= 3 and is_axis(g.number[a:b, j]) and np.isfinite(g.number[a:b, j + 1]).sum() >= 0.8 * (b - a):
            pairs.append((j, a, b))
        elif np.isfinite(g.number[:, j : j + 2]).sum() > 2:
            return []
    if len(pairs) < 2:
        return []
    for n, (j, a, b) in enumerate(pairs):
        out.append(Found(g.name_above(a, (j, j + 1), False) or f"{default} #{n + 1}", g.number[a:b, j], g.number[a:b, j + 1]))
    return out


def _rows(g: Grid, default: str) -> list[Found]:
    for i in range(g.number.shape[0]):
        a, b = finite_run(g.number[i])
        if b - a < 3 or not is_axis(g.number[i, a:b]):
            continue
        out = []
        for k in range(i + 1, g.number.shape[0]):
            if np.isfinite(g.number[k, a:b]).sum() >= max(3, 0.8 * (b - a)):
                names = [c for c in g.text[k][:a] if c and math.isnan(to_float(c))]
                out.append(Found(names[0] if names else f"{default} #{len(out) + 1}", g.number[i, a:b], g.number[k, a:b]))
        if out:
            return out
    return []


_PARSERS = {"xy_pairs": _pairs, "columns": _columns, "rows": _rows}


def parse_grid(rows: list[list], name: str, layout: str = "auto", comma: bool = False) -> tuple[list[Found], str]:
    """Spectra of a table and the layout they are in; pairs win, otherwise the most points."""
    if layout not in LAYOUTS:
        raise FormatError(f"unknown layout {layout}")
    g = Grid(rows, comma)
    found: dict[str, list[Found]] = {}
    for key in _PARSERS if layout == "auto" else (layout,):
        if g.number.size:
            found[key] = _PARSERS[key](g, name)
    if found.get("xy_pairs"):
        best = "xy_pairs"
    else:
        best = max(found, key=lambda k: sum(len(f.x) for f in found[k]), default=None)
    if best is None or not found[best]:
        raise FormatError(f"{name}: no spectra found")
    heading = g.metadata()
    return [Found(f.name, f.x, f.y, dict(heading)).tidy() for f in found[best]], best


def parse(content: str, name: str, layout: str = "auto", delimiter: str | None = "auto", comma: bool | None = None) -> tuple[list[Found], str]:
    found_delimiter, found_comma = detect_format(content)
    delimiter = found_delimiter if delimiter == "auto" else delimiter
    return parse_grid(split_lines(content, delimiter), name, layout, found_comma if comma is None else comma)
