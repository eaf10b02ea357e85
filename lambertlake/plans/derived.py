"""Spectra derived from one another, each by a pipeline of its own: pipelines are data.

``processed`` runs rows (id, x, y, pipeline, given) in one pass, ``given`` being the spectra that
a row's pipeline refers to; rows of a batch that share pipeline, grid and references are stacked.
``derive`` works out a whole lineage: a spectrum's level is one more than the highest of those it
is made from, and all spectra of a level are one job, however many pipelines they have. Spectra
travel to the rows that need them by joins; nothing of them reaches the driver.

A row whose pipeline fails, or that needs a spectrum that failed, is missing or follows from the
row itself, has null x and y and a message in ``_error``. Null pipelines are copies of the parent.
Rows that repeat an id, or an id that is given already, are an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lambertlake.functions.kernels import SpectrumError
from lambertlake.functions.shared import checkpoint
from lambertlake.plans.ops import Batch, apply_pipeline
from lambertlake.plans.pipeline import Library, referenced

_OUT = "id long, x array<double>, y array<double>, _error string"
_DOUBLES = pa.list_(pa.float64())


def with_references(plan: DataFrame) -> DataFrame:
    """``plan`` with ``refs``: the identifiers that each pipeline refers to."""
    names = [f.name for f in plan.schema.fields if f.name != "refs"]

    def run(batches: Iterator[pa.RecordBatch]):
        known: dict[str | None, list] = {None: []}
        for batch in batches:
            refs = []
            for text in batch.column("pipeline").to_pylist():
                if text not in known:
                    if len(known) > 10_000:
                        known.clear()
                    try:
                        known[text] = [int(r) for r in referenced(json.loads(text or "[]"))]
                    except (ValueError, KeyError, TypeError, AttributeError):
                        known[text] = []  # said when it is run
                refs.append(known[text])
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(refs, pa.list_(pa.int64()))], names=[*names, "refs"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema.fields if f.name != "refs"), "refs array<long>"])
    return plan.select(names).mapInArrow(run, schema)


def processed(rows: DataFrame) -> DataFrame:
    """id, x, y, _error of rows (id, x, y, pipeline, given array<struct<id, x, y>>)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ident, pipelines, given = (batch.column(c).to_pylist() for c in ("id", "pipeline", "given"))
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            out: list[tuple] = [(None, None, "there is no parent")] * len(ident)
            stacks: dict[tuple, list[int]] = {}
            for i in range(len(ident)):
                if x[i] is not None and y[i] is not None and len(x[i]) == len(y[i]) > 0:
                    own = tuple(sorted((g["id"], tuple(g["x"]), tuple(g["y"])) for g in given[i] or [] if g["x"] is not None))
                    stacks.setdefault((pipelines[i], tuple(x[i]), own), []).append(i)
            for (pipeline, grid, own), members in stacks.items():
                try:
                    library = Library({k: (np.array(a), np.array(b)) for k, a, b in own})
                    done = apply_pipeline(Batch(np.array(grid, float), np.array([y[i] for i in members], float)), json.loads(pipeline or "[]"), library)
                    for j, i in enumerate(members):
                        out[i] = (None, None, done.error[j]) if done.error[j] else (done.x.tolist(), done.y[j].tolist(), None)
                except (SpectrumError, KeyError, TypeError, ValueError) as error:
                    for i in members:
                        out[i] = (None, None, str(error) or type(error).__name__)
            xs, ys, errors = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ident, pa.int64()), pa.array(xs, _DOUBLES), pa.array(ys, _DOUBLES), pa.array(errors, pa.string())], names=["id", "x", "y", "_error"])

    return rows.select("id", "x", "y", "pipeline", "given").mapInArrow(run, _OUT)


def _supplied(plan: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of ``plan`` (id, parent, pipeline, refs) with the points of parents and references, and whether one of them has none."""
    needs = plan.select("id", "pipeline", "parent", F.explode(F.array_distinct(F.concat(F.array("parent"), "refs"))).alias("need"))
    own = points.select(F.col("id").alias("need"), "x", "y")
    # A spectrum has few references, so what meets here is small.
    met = needs.join(own, "need", "left").groupBy("id").agg(F.first("pipeline").alias("pipeline"), F.first("parent").alias("parent"), F.collect_list(F.struct(F.col("need").alias("id"), "x", "y")).alias("given"))
    parent = F.get(F.filter("given", lambda g: g["id"] == F.col("parent")), F.lit(0))
    lacking = F.exists("given", lambda g: g["x"].isNull())
    return met.select("id", "pipeline", "given", parent["x"].alias("x"), parent["y"].alias("y"), lacking.alias("lacking"))


def rerun(plan: DataFrame, points: DataFrame) -> DataFrame:
    """id, x, y, _error of each row of ``plan`` (id, parent, pipeline), made anew from ``points`` as they are; one job."""
    rows = _supplied(with_references(plan.select("id", "parent", "pipeline")), points)
    return processed(rows)


def derive(raw: DataFrame, plan: DataFrame) -> DataFrame:
    """id, x, y, level, _error of all rows of ``plan`` (id, parent, pipeline), given ``raw`` (id, x, y); a job a level."""
    left = checkpoint(with_references(plan.select(F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"), "pipeline")))
    again = left.groupBy("id").count().where("count > 1").unionByName(left.join(raw.select("id"), "id", "left_semi").groupBy("id").count())
    if not again.isEmpty():
        raise ValueError(f"spectrum {again.first()['id']} is given more than once")
    done = raw.select("id", "x", "y")
    out, level = None, 0
    while not left.isEmpty():
        level += 1
        waiting = left.select("id").withColumnRenamed("id", "need")
        needs = left.select("id", F.explode(F.concat(F.array("parent"), "refs")).alias("need"))
        held = needs.join(waiting, "need", "left_semi").select("id").distinct()
        ready = left.join(held, "id", "left_anti")
        if ready.isEmpty():
            rest = left.select("id", F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("array<double>").alias("y"), F.lit(None).cast("int").alias("level"), F.lit("a spectrum follows from itself").alias("_error"))
            out = rest if out is None else out.unionByName(rest)
            break
        rows = _supplied(ready, done)
        made = processed(rows.where("NOT lacking")).withColumn("level", F.lit(level))
        failed = rows.where("lacking").select("id", F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("array<double>").alias("y"), F.lit("a spectrum that it needs is missing").alias("_error"), F.lit(level).alias("level"))
        made = checkpoint(made.unionByName(failed))
        out = made if out is None else out.unionByName(made)
        done = done.unionByName(made.select("id", "x", "y"))
        left = checkpoint(left.join(made.select("id"), "id", "left_anti"))
    if out is None:
        return raw.limit(0).select(F.col("id").cast("long").alias("id"), "x", "y", F.lit(0).alias("level"), F.lit("").alias("_error"))
    return out.select("id", "x", "y", "level", "_error")
