"""The data source ``spectra_files``: large files read in parts by many tasks, and files written by tasks.

Reading. JCAMP-DX files are cut into byte ranges; a range owns the blocks whose ``##TITLE`` line
begins in it, so its task reads on to the end of its last block. SPC files are cut into ranges of
subfiles: where all have the same points a subfile's place follows from its number, otherwise a
task steps from head to head. Neither needs a pass over the file beforehand. Files of other
layouts, or in UTF-16, are read whole by one task each. Filters on name (equal, in, beginning)
and source_file are pushed to the source: blocks of other names aren't parsed, files of other
paths not opened. ``source_sha256`` is that of the whole file and so null for files in parts.

Writing. Each task writes files of its own in a folder for files to be, in layout ``jcamp`` (many
blocks a file), ``spc`` (many subfiles a file, single precision, without names) or ``rows`` (a
table of text, one spectrum a line, spectra of a task on the same points). The commit moves the
files of the tasks that succeeded into place and then removes earlier files, if the mode is
overwrite; an abort removes what was written. Rows never pass through the driver.

Paths may be of any file system that Arrow knows (``file``, ``hdfs``, ``s3``, ``gs``); plain paths
are local. A file that can't be read is an error, or in mode PERMISSIVE a row with its message.
In a compound JCAMP block the outer block's own data, if any, are taken to precede inner blocks.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from lambertlake.sources import exchange, text
from lambertlake.sources.reader import SCHEMA, parse_file
from lambertlake.sources.text import Found, FormatError

#: Bytes of a file that one task reads.
PART_BYTES = 32 << 20
WHOLE, JCAMP, SPC = "whole", "jcamp", "spc"
#: Where files are until they are committed.
PENDING = "_pending"

_TITLE = re.compile(rb"\s*##\s*TITLE\s*=\s*([^\r\n]*)", re.I)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path on it."""
    if re.match(r"file:/+", path):
        path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]+://", path) else (fs.LocalFileSystem(), os.path.abspath(path))


def files_of(path: str) -> list[fs.FileInfo]:
    """The files of a folder (hidden ones left out) or the file itself, in order of their names."""
    system, own = opened(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(own))
    return sorted((i for i in found if i.type == fs.FileType.File and i.base_name[0] not in "._"), key=lambda i: i.path)


def jcamp_blocks(f: io.BufferedReader, start: int, stop: int) -> Iterator[tuple[str, str]]:
    """Title and text of the blocks whose first line begins from ``start`` up to ``stop``."""
    f.seek(max(0, start - 1))
    if start:
        f.readline()  # the rest of the line before
    at, title, lines = f.tell(), None, []
    while line := f.readline():
        begins = _TITLE.match(line)
        if begins:
            if title is not None:
                yield title, text.decode(b"".join(lines))
            if at >= stop:
                return
            title, lines = text.decode(begins[1]).split("$$")[0].strip(), []
        lines.append(line)
        at += len(line)
    if title is not None:
        yield title, text.decode(b"".join(lines))


@dataclass
class Subfiles:
    """The head of an SPC file: what is the same for all its subfiles."""

    order: str
    flags: int
    exponent: int
    points: int
    first: float
    last: float
    count: int
    metadata: dict[str, str]

    @classmethod
    def of(cls, head: bytes) -> Subfiles | None:
        """None for the old format and for single spectra, which aren't cut."""
        if len(head) < 512 or not exchange.is_spc(head) or head[1] == 0x4D or not head[0] & exchange._MULTI:
            return None
        order = "<" if head[1] == 0x4B else ">"
        (n,), (first, last), (count,) = struct.unpack_from(f"{order}i", head, 4), struct.unpack_from(f"{order}dd", head, 8), struct.unpack_from(f"{order}i", head, 24)
        meta = {"XUNITS": exchange.X_UNITS.get(head[28], str(head[28])), "YUNITS": exchange.Y_UNITS.get(head[29], str(head[29])), "COMMENT": head[88:218].split(b"\0")[0].decode("latin-1")}
        return cls(order, head[0], struct.unpack_from("b", head, 3)[0], n, first, last, count, {k: v for k, v in meta.items() if v})

    @property
    def own_x(self) -> bool:
        return bool(self.flags & exchange._OWN_X)

    def _values(self, n: int) -> int:
        return n * (2 if self.flags & exchange._16BIT else 4)

    def read(self, f: io.BufferedReader, first: int, stop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number, x and y of the subfiles from ``first`` up to ``stop``."""
        x, at = np.linspace(self.first, self.last, max(self.points, 0)), 512
        if self.flags & exchange._X_VALUES and not self.own_x:
            f.seek(512)
            x = np.frombuffer(f.read(4 * self.points), f"{self.order}f4").astype(float)
            at += 4 * self.points
        k = 0
        if not self.own_x:
            k, at = first, at + first * (32 + self._values(self.points))
        while k < min(stop, self.count):
            f.seek(at)
            sub = f.read(32)
            if len(sub) < 32:
                return
            n = struct.unpack_from(f"{self.order}i", sub, 16)[0] if self.own_x else self.points
            exponent = struct.unpack_from("b", sub, 1)[0]
            # In the file format values of single precision take four bytes whatever the flag.
            width = 4 * n if exponent == -128 else self._values(n)
            if k >= first:
                if self.own_x:
                    x = np.frombuffer(f.read(4 * n), f"{self.order}f4").astype(float)
                y, _ = exchange._ordinates(f.read(width), 0, n, exponent, bool(self.flags & exchange._16BIT), self.order, False)
                yield k, x, y
            at += 32 + width + (4 * n if self.own_x else 0)
            k += 1


@dataclass
class Part(InputPartition):
    path: str
    kind: str
    start: int = 0
    stop: int = 0


def parts_of(path: str, size: int, part_bytes: int) -> list[Part]:
    """How a file is cut; only its head is read."""
    if size <= part_bytes:
        return [Part(path, WHOLE)]
    system, own = opened(path)
    with system.open_input_file(own) as f:
        head = f.read(512)
    if head.lstrip().startswith(b"##") or (_TITLE.match(head) and b"\0" not in head):
        return [Part(path, JCAMP, at, min(at + part_bytes, size)) for at in range(0, size, part_bytes)]
    sub = Subfiles.of(head)
    if sub and sub.count > 1:
        each = max(1, -(-sub.count * part_bytes // size))
        return [Part(path, SPC, at, min(at + each, sub.count)) for at in range(0, sub.count, each)]
    return [Part(path, WHOLE)]


class SpectraReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.layout = options.get("layout", "auto")
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.names: set | None = None
        self.prefixes: list[str] = []
        self.sources: set | None = None

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        left = []
        for f in filters:
            column = getattr(f, "attribute", None)
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == ("name",) and values is not None:
                self.names = values if self.names is None else self.names & values
            elif column == ("name",) and isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            elif column == ("source_file",) and values is not None:
                self.sources = values if self.sources is None else self.sources & values
            elif not (isinstance(f, IsNotNull) and column in (("name",), ("source_file",))):
                left.append(f)
            elif column == ("name",):
                self.prefixes.append("")  # rows of files that can't be read have no name
        return left

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            scheme = re.match(r"(?!file:)\w[\w+.-]+://[^/]*", path)
            for info in files_of(path):
                name = f"{scheme[0]}{info.path}" if scheme and not info.path.startswith(scheme[0].split("://")[1]) else info.path
                if self.sources is None or name in self.sources:
                    out += parts_of(name, info.size, self.part_bytes)
        return out

    def _wants(self, name: str) -> bool:
        return (self.names is None or name in self.names) and all(name.startswith(p) for p in self.prefixes)

    def _found(self, part: Part, f: io.BufferedReader) -> Iterator[tuple[Found, str | None]]:
        base = os.path.basename(part.path)
        stem = os.path.splitext(base)[0]
        if part.kind == WHOLE:
            raw = f.read()
            digest = hashlib.sha256(raw).hexdigest()
            yield from ((x, digest) for x in parse_file(part.path, raw, self.layout))
        elif part.kind == JCAMP:
            for title, block in jcamp_blocks(f, part.start, part.stop):
                if not self._wants(title or stem):
                    continue
                for x in exchange.parse_jcamp(block, stem, none=True):
                    x.metadata |= {"source_file": base, "import_layout": "jcamp"}
                    yield x, None
        else:
            sub = Subfiles.of(f.read(512))
            for k, x, y in sub.read(f, part.start, part.stop):
                if self._wants(name := f"{stem} #{k + 1}"):
                    yield Found(name, x, y, sub.metadata | {"source_file": base, "import_layout": "spc"}).tidy(), None

    def read(self, part: Part):
        system, own = opened(part.path)
        with system.open_input_file(own) as raw:
            try:
                for x, digest in self._found(part, io.BufferedReader(raw, 1 << 20)):
                    if self._wants(x.name):
                        yield x.name, x.x.tolist(), x.y.tolist(), x.metadata, part.path, digest, None
            except FormatError as error:
                if not self.permissive:
                    raise
                if self.names is None and not self.prefixes:
                    yield None, None, None, None, part.path, None, str(error)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Jcamp:
    extension = "jdx"

    def __init__(self, f) -> None:
        self.f = f

    def add(self, name: str, x: np.ndarray, y: np.ndarray) -> None:
        # A line end would end the record, two dollar signs begin a comment.
        self.f.write(exchange.write_jcamp(" ".join(name.split("\n")).replace("$$", "$ $"), x, y).encode())

    def close(self) -> None:
        pass


class _Spc:
    """Subfiles with points of their own; how many there are is known at the end and stands in the head."""

    extension = "spc"

    def __init__(self, f) -> None:
        self.f, self.rows, self.count = f, io.BytesIO(), 0

    def add(self, name: str, x: np.ndarray, y: np.ndarray) -> None:
        sub = bytearray(32)
        struct.pack_into("<Bbh", sub, 0, 0, -128, self.count % 32768)
        struct.pack_into("<i", sub, 16, len(x))
        self.rows.write(bytes(sub) + np.asarray(x, "<f4").tobytes() + np.asarray(y, "<f4").tobytes())
        self.count += 1

    def close(self) -> None:
        head = bytearray(512)
        struct.pack_into("<BBBb", head, 0, exchange._MULTI | exchange._OWN_X | exchange._X_VALUES, 0x4B, 0, -128)
        struct.pack_into("<i", head, 24, self.count)
        head[28], head[29] = 3, 2
        self.f.write(bytes(head))
        self.f.write(self.rows.getbuffer())


class _Rows:
    extension = "tsv"

    def __init__(self, f) -> None:
        self.f, self.grid = f, None

    def add(self, name: str, x: np.ndarray, y: np.ndarray) -> None:
        line = lambda head, values: ("\t".join([head, *map(repr, values.tolist())]) + "\n").encode()
        if self.grid is None:
            self.grid = x
            self.f.write(line("name", x))
        elif not np.array_equal(self.grid, x):
            raise FormatError("spectra of different points don't go into one table")
        self.f.write(line(re.sub(r"\s", " ", name), y))

    def close(self) -> None:
        pass


LAYOUTS = {"jcamp": _Jcamp, "spc": _Spc, "rows": _Rows}


class SpectraWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.layout = LAYOUTS[options.get("layout", "jcamp")]
        self.most = int(options.get("maxrecordsperfile", 10_000))
        self.job = uuid.uuid4().hex
        if self.layout is not _Jcamp and "layout" in options and self.most < 1:
            raise ValueError("maxRecordsPerFile must be positive")

    @property
    def pending(self) -> str:
        return f"{opened(self.path)[1]}/{PENDING}/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, _ = opened(self.path)
        system.create_dir(self.pending, recursive=True)
        task = TaskContext.get().partitionId()
        names, out, held, stream = [], None, 0, None

        def finish() -> None:
            out.close()
            stream.close()

        for batch in iterator:
            for name, x, y in zip(*(batch.column(c).to_pylist() for c in ("name", "x", "y"))):
                if not x or not y or len(x) != len(y):
                    raise FormatError(f"{name}: x and y must hold equally many points")
                if out is not None and held >= self.most:
                    finish()
                    out = None
                if out is None:
                    # Another attempt of the task writes other files.
                    names.append(f"part-{task:05d}-{len(names):03d}-{uuid.uuid4().hex[:12]}.{self.layout.extension}")
                    stream, held = system.open_output_stream(f"{self.pending}/{names[-1]}"), 0
                    out = self.layout(stream)
                out.add(name or "", np.array(x, float), np.array(y, float))
                held += 1
        if out is not None:
            finish()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        earlier = files_of(self.path) if self.overwrite else []
        for name in (n for m in messages if m is not None for n in m.files):
            system.move(f"{self.pending}/{name}", f"{folder}/{name}")
        for info in earlier:
            system.delete_file(info.path)
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, folder: str) -> None:
        """Remove this job's files that weren't committed, and the folder of all jobs once it is empty."""
        if system.get_file_info(self.pending).type == fs.FileType.Directory:
            system.delete_dir(self.pending)
        waiting = f"{folder}/{PENDING}"
        if system.get_file_info(waiting).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(waiting)):
            system.delete_dir(waiting)


class SpectraFiles(DataSource):
    """``spark.read.format("spectra_files").load(folder)``, ``df.write.format("spectra_files").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "spectra_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SpectraReader:
        return SpectraReader(self.options)

    def writer(self, schema, overwrite: bool) -> SpectraWriter:
        missing = {"name", "x", "y"} - set(schema.names)
        if missing:
            raise ValueError(f"to be written, spectra need the columns {sorted(missing)}")
        return SpectraWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session; pushing filters to Python sources has to be allowed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SpectraFiles)


def write(spectra: DataFrame, path: str, layout: str = "jcamp", mode: str = "append", per_file: int = 10_000) -> None:
    """Write name, x, y by tasks; see the module for layouts."""
    register(spectra.sparkSession)
    spectra.select("name", "x", "y").write.format("spectra_files").option("layout", layout).option("maxRecordsPerFile", per_file).mode(mode).save(path)


def read(spark: SparkSession, path: str, part_bytes: int = PART_BYTES, mode: str = "FAILFAST") -> DataFrame:
    register(spark)
    return spark.read.format("spectra_files").option("partBytes", part_bytes).option("mode", mode).load(path)
