"""Pipelines over DataFrames of spectra.

A spectrum is a row with ``x`` and ``y`` (array<double>), x ascending. A pipeline runs as one
Arrow pass: rows of a batch that share a grid are stacked and every step works on the stack.
A pipeline that is linear in the sample, followed by a linear measurement, is the same weights
for every spectrum of a grid; those are worked out once on the driver, from the grid's identity
basis, and become a column expression without any Python on the executors.

References are few and named by the steps; ``Library`` fetches exactly those.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lambertlake.functions.kernels import SpectrumError
from lambertlake.plans import measure as m
from lambertlake.plans.ops import OPERATIONS, Batch, Reference, apply_pipeline, is_linear

FAILFAST, PERMISSIVE = "failfast", "permissive"
#: Grids for which a fused expression is written out; spectra of more grids go through Arrow.
FUSED_GRIDS = 8
#: Non-zero weights up to which the expression is a plain sum.
SPARSE = 64


def referenced(steps: list[dict], measurement: dict | None = None) -> list[Any]:
    """Identifiers of the spectra that steps and measurement refer to, distinct and in order."""
    out = []
    for s in steps:
        op = OPERATIONS.get(s["op"])
        given = s.get("params") or {}
        out += [given.get(p.name) for p in (op.params if op else ()) if p.kind == "spectrum"]
    if measurement:
        out.append((measurement.get("params") or {}).get("reference"))
    return list(dict.fromkeys(r for r in out if r is not None and not isinstance(r, tuple)))


class Library:
    """Resolves references; a missing one is an error that names it."""

    def __init__(self, spectra: dict[Any, Reference]) -> None:
        self.spectra = spectra

    @classmethod
    def of(cls, table: DataFrame, steps: list[dict], measurement: dict | None = None, ident: str = "id") -> Library:
        wanted = referenced(steps, measurement)
        if not wanted:
            return cls({})
        rows = table.where(F.col(ident).isin(wanted)).select(ident, "x", "y").collect()
        return cls({r[ident]: (np.array(r["x"], float), np.array(r["y"], float)) for r in rows})

    def __call__(self, key: Any) -> Reference:
        if isinstance(key, tuple):
            return key
        if key not in self.spectra:
            raise SpectrumError(f"reference spectrum {key} is missing")
        return self.spectra[key]


def spectra(points: DataFrame, ident: str, x: str, y: str) -> DataFrame:
    """Spectra of long rows: points in order of x, repeated x averaged, rows that aren't finite refused."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    rows = points.select(F.col(ident), F.when(finite(px) & finite(py), px).otherwise(F.raise_error(F.lit("a point is not finite"))).alias("_x"), py.alias("_y"))
    one = rows.groupBy(ident, "_x").agg(F.avg("_y").alias("_y")).groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("_x", "_y"))).alias("p"))
    return one.where(F.size("p") >= 2).select(ident, F.col("p._x").alias("x"), F.col("p._y").alias("y"))


def tidy(df: DataFrame) -> DataFrame:
    """Packed spectra with x sorted and repeated x averaged."""

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["x"] == p["x"])
        merged = F.struct(p["x"].alias("x"), (last["s"] + p["y"]).alias("s"), (last["n"] + 1).alias("n"))
        fresh = F.struct(p["x"].alias("x"), p["y"].alias("s"), F.lit(1).alias("n"))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(fresh)))

    points = F.array_sort(F.arrays_zip("x", "y"))
    rising = F.forall(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.get(F.col("x"), i) > F.get(F.col("x"), i - 1))
    merged = F.aggregate(points, F.array().cast("array<struct<x:double,s:double,n:int>>"), step)
    df = df.withColumn("_p", F.when(~rising, merged))
    return df.withColumn("y", F.when(F.col("_p").isNull(), F.col("y")).otherwise(F.transform("_p", lambda p: p["s"] / p["n"]))).withColumn("x", F.when(F.col("_p").isNull(), F.col("x")).otherwise(F.col("_p.x"))).drop("_p")


def _stacks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Batch]]:
    """Row numbers and stacked spectra, for each grid of a batch; rows without a proper spectrum come as an empty stack."""
    xs, ys = batch.column("x"), batch.column("y")
    with_c = "concentrations" in batch.schema.names
    conc = batch.column("concentrations").to_pylist() if with_c else [None] * batch.num_rows
    groups: dict[bytes, list[int]] = {}
    for i in range(batch.num_rows):
        key = b"" if not xs[i].is_valid or not ys[i].is_valid or len(xs[i]) != len(ys[i]) or len(xs[i]) < 2 else xs[i].values.to_numpy(zero_copy_only=False).tobytes()
        groups.setdefault(key, []).append(i)
    for key, rows in groups.items():
        if not key:
            bad = Batch(np.zeros(0), np.zeros((len(rows), 0)))
            bad.fail(np.ones(len(rows), bool), "x and y must be arrays of one length, at least 2")
            yield np.array(rows), bad
        else:
            stack = np.stack([ys[i].values.to_numpy(zero_copy_only=False) for i in rows]).astype(float)
            yield np.array(rows), Batch(np.frombuffer(key), stack, [dict(conc[i]) if conc[i] else None for i in rows])


def _mapped(df: DataFrame, out: list[T.StructField], work, mode: str) -> DataFrame:
    """``df`` with columns that ``work`` makes of each stack (a tuple of lists), and ``_error`` if permissive."""
    names = [f.name for f in out] + ["_error"] * (mode == PERMISSIVE)
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *out, *([T.StructField("_error", T.StringType())] if mode == PERMISSIVE else [])])
    arrow = [pa.list_(pa.float64()) if isinstance(f.dataType, T.ArrayType) else pa.float64() for f in out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[None] * batch.num_rows for _ in out]
            errors: list[str | None] = [None] * batch.num_rows
            for rows, stack in _stacks(batch):
                try:
                    done, columns = work(stack) if stack.x.size else (stack, [[None] * len(rows)] * len(out))
                    noted = done.error
                except SpectrumError as error:
                    noted, columns = [str(error)] * len(rows), [[None] * len(rows)] * len(out)
                for j, i in enumerate(rows):
                    errors[i] = noted[j]
                    for column, values in zip(made, columns):
                        column[i] = None if noted[j] else values[j]
            if mode == FAILFAST and (wrong := next((e for e in errors if e), None)):
                raise SpectrumError(wrong)
            columns = [*(batch.column(f.name) for f in kept), *(pa.array(c, a) for c, a in zip(made, arrow))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(errors, pa.string())] * (mode == PERMISSIVE), names=schema.names)

    return df.mapInArrow(run, schema)


_DOUBLES = T.ArrayType(T.DoubleType())


def process(df: DataFrame, steps: list[dict], library: Library | None = None, mode: str = FAILFAST) -> DataFrame:
    """``df`` with x and y after the steps. Permissive: failing rows have null x and y and a message in ``_error``."""
    library = library or Library({})

    def work(stack: Batch):
        done = apply_pipeline(stack, steps, library)
        return done, [[done.x.tolist()] * len(done.y), done.y.tolist()]

    return _mapped(df, [T.StructField("x", _DOUBLES), T.StructField("y", _DOUBLES)], work, mode)


def factor_reference(steps: list[dict], measurement: dict, library: Library, raw: bool = False) -> Batch | None:
    """The reference of a weighted difference, after the method's steps unless ``raw``."""
    p = measurement.get("params") or {}
    if measurement["kind"] != "weighted_difference" or p.get("factor") is not None or p.get("reference") is None:
        return None
    x, y = library(p["reference"])
    b = Batch(x, y[None])
    return b if raw else apply_pipeline(b, steps, library)


def weights(x: np.ndarray, steps: list[dict], measurement: dict, library: Library, raw: bool = False) -> tuple[np.ndarray, float]:
    """(w, b) with signal = w.y + b for every spectrum on the grid ``x``."""
    if not (is_linear(steps) and m.KINDS[measurement["kind"]]):
        raise SpectrumError("the pipeline or the measurement isn't linear")
    n = len(x)
    basis = Batch(x, np.vstack([np.eye(n), np.zeros(n)]))
    got = m.measure(apply_pipeline(basis, steps, library), measurement, factor_reference(steps, measurement, library, raw))
    return got[:-1] - got[-1], float(got[-1])


def _dot(w: np.ndarray, b: float) -> Column:
    nonzero = np.flatnonzero(np.abs(w) > 1e-300)
    if len(nonzero) <= SPARSE:
        out = F.lit(b)
        for i in nonzero:
            out = out + F.get(F.col("y"), F.lit(int(i))) * float(w[i])
        return out
    products = F.zip_with(F.col("y"), F.array(*(F.lit(float(v)) for v in w)), lambda a, c: a * c)
    return F.aggregate(products, F.lit(b), lambda a, c: a + c)


def grids_of(df: DataFrame) -> list[list[float]]:
    """The different x of the spectra, if they are few and proper; told apart by a hash, so no array is sorted or moved."""
    key = F.xxhash64("x")
    hashes = df.select(key.alias("h")).distinct().limit(FUSED_GRIDS + 1).collect()
    if not 0 < len(hashes) <= FUSED_GRIDS:
        return []
    found = [df.where(key == h["h"]).select("x").first()["x"] for h in hashes]
    return found if all(x and len(x) >= 2 for x in found) else []


def signals(df: DataFrame, steps: list[dict], measurement: dict, library: Library | None = None, out: str = "signal", mode: str = FAILFAST, fuse: bool = True, raw: bool = False, grid: np.ndarray | None = None) -> DataFrame:
    """``df`` with the measurement of each processed spectrum in the double column ``out``.

    ``grid`` says that all spectra have this x, which saves looking for it. ``raw`` takes a weighted difference's factor from the unprocessed reference.
    """
    library = library or Library({})
    if fuse and mode == FAILFAST and is_linear(steps) and m.KINDS[measurement["kind"]]:
        grids = grids_of(df) if grid is None else [list(map(float, grid))]
        if grids:
            signal = F.lit(None).cast("double")
            for g in grids:
                w, b = weights(np.array(g, float), steps, measurement, library, raw)
                own = _dot(w, b)
                own = F.when(F.size("y") == len(g), own)
                checked = F.when(own.isNull() | F.isnan(own) | (F.abs(own) == float("inf")), F.raise_error(F.when(F.size("y") == len(g), "a signal is not finite").otherwise("x and y must be arrays of one length, at least 2"))).otherwise(own)
                # One grid needs no test of which it is; of several, a hash tells them apart.
                signal = checked if len(grids) == 1 else F.when(F.xxhash64("x") == F.xxhash64(F.array(*(F.lit(float(v)) for v in g))), checked).otherwise(signal)
            return df.withColumn(out, signal)
    reference = factor_reference(steps, measurement, library, raw)

    def work(stack: Batch):
        done = apply_pipeline(stack, steps, library)
        got = m.measure(done, measurement, reference)
        done.fail(~np.isfinite(got), "the signal is not finite")
        return done, [got.tolist()]

    return _mapped(df, [T.StructField(out, T.DoubleType())], work, mode)


def canonical(document: Any) -> str:
    """JSON with sorted keys, as checksums take it."""
    return json.dumps(document, sort_keys=True, ensure_ascii=False)
