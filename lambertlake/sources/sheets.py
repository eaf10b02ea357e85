"""Workbooks (xlsx) with the standard library: reading cells, writing tables; compound files (OLE)."""

from __future__ import annotations

import io
import math
import re
import struct
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np

from lambertlake.sources.text import Found, FormatError, is_axis, parse_grid

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
OLE_MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
ROLES = ("standard", "sample", "mixture", "blank", "validation", "calibration", "training", "reference", "test", "placebo")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def read_xlsx(raw: bytes) -> list[tuple[str, list[list]]]:
    """(name, rows) of each sheet, in order; cells are numbers, texts, booleans or None."""
    try:
        book = zipfile.ZipFile(io.BytesIO(raw))
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        relations = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = relations[s.get(f"{{{_NS['r']}}}id")].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            rows: list[list] = []
            for r in ElementTree.fromstring(book.read(part)).iter(f"{{{_NS['m']}}}row"):
                while len(rows) < int(r.get("r", len(rows) + 1)) - 1:
                    rows.append([])
                cells: list = []
                for c in r.findall("m:c", _NS):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    v, kind = c.find("m:v", _NS), c.get("t")
                    text = v.text if v is not None else None
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif text is None:
                        value = None
                    elif kind == "s":
                        value = shared[int(text)]
                    elif kind == "b":
                        value = text == "1"
                    else:
                        value = text if kind in ("str", "e") else float(text)
                    cells.append(value)
                rows.append(cells)
            out.append((s.get("name"), rows))
        return out
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError, ValueError, TypeError) as error:
        raise FormatError(f"not a readable workbook: {error}") from error


def role_of_sheet(name: str) -> str | None:
    """A role that the sheet's name says, in the singular."""
    low = re.sub(r"[^a-z]", " ", name.lower())
    return next((r for r in ROLES if re.search(rf"\b{r}s?\b", low)), None)


def parse_workbook(raw: bytes, name: str, layout: str = "auto") -> tuple[list[Found], str]:
    """Spectra of every sheet whose name doesn't begin with an underscore; sheets of notes are passed over."""
    found, used = [], "auto"
    for sheet, rows in read_xls(raw) if raw.startswith(OLE_MAGIC) else read_xlsx(raw):
        if sheet.startswith("_"):
            continue
        try:
            own, used = parse_grid(rows, sheet, layout)
        except FormatError:
            continue
        role = role_of_sheet(sheet)
        for f in own:
            f.metadata |= {"sheet": sheet} | ({"role": role} if role else {})
        found.append((sheet, own))
    if not found:
        raise FormatError(f"{name}: no sheet has spectra")
    if len(found) > 1:
        for sheet, own in found:
            for f in own:
                f.name = f"{sheet} / {f.name}"
    return [f for _, own in found for f in own], used


def sheet_name(name: str, taken: set[str] = frozenset()) -> str:
    """At most 31 characters, none forbidden, unlike those taken."""
    base = re.sub(r"[\[\]:*?/\\]", "_", name).strip("'")[:31] or "Sheet"
    out, n = base, 2
    while out.lower() in {t.lower() for t in taken}:
        out = f"{base[: 31 - len(str(n)) - 1]}~{n}"
        n += 1
    return out


def write_xlsx(sheets: list[tuple[str, list[list]]]) -> bytes:
    """A workbook of plain tables; NaN and infinities become blank cells."""
    taken: set[str] = set()
    parts: dict[str, str] = {}
    listed = []
    for i, (name, rows) in enumerate(sheets, 1):
        own = sheet_name(name, taken)
        taken.add(own)
        lines = []
        for n, row in enumerate(rows, 1):
            cells = []
            for v in row:
                if v is None or (isinstance(v, float) and not math.isfinite(v)):
                    cells.append("<c/>")
                elif isinstance(v, bool):
                    cells.append(f'<c t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, (int, float)):
                    cells.append(f"<c><v>{v!r}</v></c>")
                else:
                    cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
            lines.append(f'<row r="{n}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_NS["m"]}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
        listed.append((own, i))
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for _, i in listed)
    parts["[Content_Types].xml"] = (
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + kinds + "</Types>"
    )
    rel = "http://schemas.openxmlformats.org/package/2006/relationships"
    parts["_rels/.rels"] = f'<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{_NS["r"]}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for n, i in listed) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{rel}">' + "".join(f'<Relationship Id="rId{i}" Type="{_NS["r"]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for _, i in listed) + "</Relationships>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in parts.items():
            z.writestr(path, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def read_ole(raw: bytes) -> dict[str, bytes]:
    """Streams of a compound file by path."""
    if not raw.startswith(OLE_MAGIC):
        raise FormatError("not a compound file")
    try:
        size, small = 1 << struct.unpack_from("<H", raw, 30)[0], 1 << struct.unpack_from("<H", raw, 32)[0]
        first_dir, cutoff, first_mini = struct.unpack_from("<I", raw, 48)[0], struct.unpack_from("<I", raw, 56)[0], struct.unpack_from("<I", raw, 60)[0]
        sector = lambda i: raw[(i + 1) * size : (i + 2) * size]
        lists = list(struct.unpack_from("<109I", raw, 76))
        more = struct.unpack_from("<I", raw, 68)[0]
        while more < 0xFFFFFFFA:
            block = struct.unpack(f"<{size // 4}I", sector(more))
            lists += block[:-1]
            more = block[-1]
        fat = np.concatenate([np.frombuffer(sector(i), "<u4") for i in lists if i < 0xFFFFFFFA])

        def chain(i: int, table: np.ndarray) -> list[int]:
            out = []
            while i < len(table) and len(out) <= len(table):
                out.append(i)
                i = int(table[i])
            return out

        whole = lambda i: b"".join(map(sector, chain(i, fat)))
        entries = []
        directory = whole(first_dir)
        for at in range(0, len(directory) - 127, 128):
            e = directory[at : at + 128]
            n = struct.unpack_from("<H", e, 64)[0]
            entries.append((e[: max(0, n - 2)].decode("utf-16-le", "replace"), e[66], *struct.unpack_from("<III", e, 68), struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<I", e, 120)[0]))
        mini_fat = np.frombuffer(whole(first_mini), "<u4") if first_mini < 0xFFFFFFFA else np.zeros(0, "<u4")
        mini = whole(entries[0][5]) if entries[0][5] < 0xFFFFFFFA else b""
        out: dict[str, bytes] = {}

        def walk(i: int, path: str) -> None:
            todo, seen = [i], set()
            while todo:
                j = todo.pop()
                if j >= len(entries) or j in seen:
                    continue
                seen.add(j)
                name, kind, left, right, child, start, length = entries[j]
                todo += [left, right]
                if kind == 1:
                    walk(child, f"{path}{name}/")
                elif kind == 2:
                    data = b"".join(mini[k * small : (k + 1) * small] for k in chain(start, mini_fat)) if length < cutoff else whole(start)
                    out[path + name] = data[:length]

        walk(entries[0][4], "")
        return out
    except (struct.error, IndexError, ValueError) as error:
        raise FormatError(f"damaged compound file: {error}") from error


def _rk(v: int) -> float:
    """A number packed in 30 bits: an integer or the top of a double, perhaps in hundredths."""
    number = float(struct.unpack("<i", struct.pack("<I", v))[0] >> 2) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return number / 100 if v & 1 else number


def _shared_texts(chunks: list[bytes]) -> list[str]:
    """The table of texts; a text may run over into the next chunk, which then begins with its own width flag."""
    out: list[str] = []
    part, at = 0, 8
    total = struct.unpack_from("<I", chunks[0], 4)[0]
    while len(out) < total and part < len(chunks):
        if at >= len(chunks[part]):
            part, at = part + 1, 0
            continue
        data = chunks[part]
        n, flags = struct.unpack_from("<HB", data, at)
        at += 3
        runs = extra = 0
        if flags & 8:
            runs = struct.unpack_from("<H", data, at)[0]
            at += 2
        if flags & 4:
            extra = struct.unpack_from("<I", data, at)[0]
            at += 4
        text, wide = "", flags & 1
        while True:
            take = min(n - len(text), (len(data) - at) // (2 if wide else 1))
            raw = data[at : at + take * (2 if wide else 1)]
            text += raw.decode("utf-16-le" if wide else "latin-1", "replace")
            at += len(raw)
            if len(text) >= n or part + 1 >= len(chunks):
                break
            part += 1
            data, wide, at = chunks[part], chunks[part][0] & 1, 1
        at += 4 * runs + extra
        while part < len(chunks) and at > len(chunks[part]):
            at -= len(chunks[part])
            part += 1
        out.append(text)
    return out


def read_xls(raw: bytes) -> list[tuple[str, list[list]]]:
    """(name, rows) of each sheet of a binary workbook: numbers, texts and values of formulas."""
    streams = read_ole(raw)
    book = next((v for k, v in streams.items() if k.lower() in ("workbook", "book")), None)
    if book is None:
        raise FormatError("no workbook in the file")
    try:
        records, at = [], 0
        while at + 4 <= len(book):
            kind, size = struct.unpack_from("<HH", book, at)
            records.append((at, kind, book[at + 4 : at + 4 + size]))
            at += 4 + size
        texts: list[str] = []
        sheets: list[tuple[str, int]] = []
        for i, (_, kind, data) in enumerate(records):
            if kind == 0x85:  # a sheet's name and place
                start, n, flags = struct.unpack_from("<I", data)[0], data[6], data[7]
                sheets.append((data[8 : 8 + n * (2 if flags & 1 else 1)].decode("utf-16-le" if flags & 1 else "latin-1"), start))
            elif kind == 0xFC:
                chunks = [data]
                for _, more, rest in records[i + 1 :]:
                    if more != 0x3C:
                        break
                    chunks.append(rest)
                texts = _shared_texts(chunks)
        index = {place: i for i, (place, _, _) in enumerate(records)}
        out = []
        for name, start in sheets:
            cells: dict[tuple[int, int], object] = {}
            depth = 0
            for _, kind, data in records[index[start] :]:
                if kind == 0x809:
                    depth += 1
                elif kind == 0x0A:
                    depth -= 1
                    if not depth:
                        break
                elif kind in (0x203, 0x27E, 0xFD, 0x06, 0x204):
                    row, column = struct.unpack_from("<HH", data)
                    if kind == 0x203:
                        cells[row, column] = struct.unpack_from("<d", data, 6)[0]
                    elif kind == 0x27E:
                        cells[row, column] = _rk(struct.unpack_from("<I", data, 6)[0])
                    elif kind == 0xFD:
                        cells[row, column] = texts[struct.unpack_from("<I", data, 6)[0]]
                    elif kind == 0x204:
                        n, flags = struct.unpack_from("<HB", data, 6)
                        cells[row, column] = data[9 : 9 + n * (2 if flags & 1 else 1)].decode("utf-16-le" if flags & 1 else "latin-1")
                    elif data[12:14] != b"\xff\xff":
                        cells[row, column] = struct.unpack_from("<d", data, 6)[0]
                elif kind == 0xBD:
                    row, first = struct.unpack_from("<HH", data)
                    for j in range((len(data) - 6) // 6):
                        cells[row, first + j] = _rk(struct.unpack_from("<I", data, 4 + 6 * j + 2)[0])
            height, width = (1 + max((c[k] for c in cells), default=-1) for k in (0, 1))
            rows: list[list] = [[None] * width for _ in range(height)]
            for (r, c), v in cells.items():
                rows[r][c] = v
            out.append((name, rows))
        return out
    except (struct.error, IndexError, KeyError) as error:
        raise FormatError(f"damaged workbook: {error}") from error


def parse_ole(raw: bytes, name: str) -> list[Found]:
    """Pairs of streams named X Data and Y Data; number width and offset are those that give an axis."""
    streams = read_ole(raw)
    out = []
    for path in sorted(p for p in streams if p.lower().endswith("x data")):
        other = next((p for p in streams if p.lower() == path.lower()[: -len("x data")] + "y data"), None)
        if other is None:
            continue
        for kind, width in (("<f8", 8), ("<f4", 4)):
            for skip in (0, 4, 8, 16):
                x, y = (np.frombuffer(streams[p][skip : skip + (len(streams[p]) - skip) // width * width], kind).astype(float) for p in (path, other))
                if len(x) == len(y) and len(x) >= 3 and is_axis(x) and np.isfinite(y).all() and np.abs(y).max() < 1e6:
                    break
            else:
                continue
            out.append(Found(name, x, y, {"stream": path}).tidy())
            break
    if not out:
        raise FormatError(f"{name}: no pair of data streams")
    return out
