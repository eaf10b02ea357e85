"""Files of spectra as DataFrames.

``read_files`` reads whole files as binary rows and parses each where it is read; a file that
can't be parsed is a row with a message instead of spectra, or an error. Large files are read in
parts by the data source of ``lambertlake.sources.blocks``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lambertlake.sources import exchange, sheets, text
from lambertlake.sources.text import Found, FormatError

SCHEMA = "name string, x array<double>, y array<double>, metadata map<string,string>, source_file string, source_sha256 string, _error string"


def parse_file(path: str, raw: bytes, layout: str = "auto") -> list[Found]:
    """Spectra of a file, by its content first and its extension second."""
    base = os.path.basename(path)
    name, extension = os.path.splitext(base)
    extension = extension.lower()
    if not raw:
        raise FormatError(f"{base}: the file is empty")
    if raw[:2] == b"PK":
        found, used = sheets.parse_workbook(raw, name, layout)
    elif raw.startswith(sheets.OLE_MAGIC):
        if any(n.lower() in ("workbook", "book") for n in sheets.read_ole(raw)):
            found, used = sheets.parse_workbook(raw, name, layout)
        else:
            found, used = sheets.parse_ole(raw, name), "ole"
    elif (extension == ".spc" or not raw[:512].isascii()) and exchange.is_spc(raw):
        found, used = exchange.parse_spc(raw, name), "spc"
    else:
        content = text.decode(raw)
        if content.lstrip().startswith("##") or extension in (".jdx", ".dx", ".jcm"):
            found, used = exchange.parse_jcamp(content, name), "jcamp"
        else:
            found, used = text.parse(content, name, layout)
    for f in found:
        f.metadata |= {"source_file": base, "import_layout": used}
    return found


def parsed(files: DataFrame, layout: str = "auto", strict: bool = True) -> DataFrame:
    """Spectra of binary rows (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("name", pa.string()), ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.float64())), ("metadata", pa.map_(pa.string(), pa.string())), ("source_file", pa.string()), ("source_sha256", pa.string()), ("_error", pa.string())])
        for batch in batches:
            rows = []
            for path, raw, digest in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "sha256"))):
                try:
                    rows += [(f.name, f.x.tolist(), f.y.tolist(), list(f.metadata.items()), path, digest, None) for f in parse_file(path, raw, layout)]
                except FormatError as error:
                    if strict:
                        raise
                    rows.append((None, None, None, None, path, digest, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)] if rows else [pa.array([], f.type) for f in kinds], schema=kinds)

    return files.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, path: str, layout: str = "auto", strict: bool = True, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return parsed(reader.load(path).select("path", "content"), layout, strict)
