"""Hash chains of entries by key: making, following and checking them in bounded memory.

An entry's hash is the SHA-256 of its predecessor's hash and its own fields, the first entry's
predecessor being ``GENESIS``. A chain can only be made from its start to its end, so one task
follows it, over sorted rows that come in batches; it keeps nothing but the last hash. Checking
needs no such order: each row's hash is checked by itself, and rows are dealt out by ranges of
(key, position), so that a long chain is checked in many segments, whose ends are compared after.
Null fields count as empty; rows without key form one chain. A key's positions must differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lambertlake.functions.shared import checkpoint

GENESIS = "genesis"
SEPARATOR = "\x1f"


def body(fields: list[str]) -> Column:
    """What is hashed of an entry, behind its predecessor's hash."""
    return F.concat_ws(SEPARATOR, *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))


def _sorted(rows: DataFrame, key: str, position: str, fields: list[str]) -> DataFrame:
    return rows.withColumn("_body", body(fields)).repartition(key).sortWithinPartitions(key, position)


def _link(head: str, own: str) -> str:
    return hashlib.sha256(f"{head}{SEPARATOR}{own}".encode()).hexdigest()


def chained(rows: DataFrame, key: str, position: str, fields: list[str], genesis: str = GENESIS) -> DataFrame:
    """``rows`` with prev_hash and hash."""
    kept = [f for f in rows.schema.fields if f.name not in ("prev_hash", "hash")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]):
        last, head = object(), genesis
        for batch in batches:
            before, after = [], []
            for k, own in zip(batch.column(key).to_pylist(), batch.column("_body").to_pylist()):
                if k != last:
                    last, head = k, genesis
                before.append(head)
                head = _link(head, own)
                after.append(head)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(before, pa.string()), pa.array(after, pa.string())], names=schema.names)

    return _sorted(rows.select(names), key, position, fields).mapInArrow(run, schema)


def heads(rows: DataFrame, key: str, position: str, fields: list[str], genesis: str = GENESIS) -> DataFrame:
    """key, n, head: each chain's length and last hash."""
    schema = T.StructType([rows.schema[key], T.StructField("n", T.LongType()), T.StructField("head", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]):
        last, head, n = None, genesis, 0
        kind = None
        done: list[tuple] = []
        for batch in batches:
            kind = batch.column(key).type
            for k, own in zip(batch.column(key).to_pylist(), batch.column("_body").to_pylist()):
                if n and k != last:
                    done.append((last, n, head))
                    head, n = genesis, 0
                last, head, n = k, _link(head, own), n + 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], names=schema.names)
                done.clear()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([n], pa.int64()), pa.array([head], pa.string())], names=schema.names)

    return _sorted(rows, key, position, fields).select(key, "_body").mapInArrow(run, schema)


def altered(chain: DataFrame, key: str, position: str, fields: list[str], genesis: str = GENESIS) -> DataFrame:
    """key, position, problem: the entries whose hash isn't theirs ('content') or whose predecessor isn't the one before ('link')."""
    where = [chain.schema[key], chain.schema[position]]
    content = chain.where(~F.sha2(F.concat_ws(SEPARATOR, "prev_hash", body(fields)), 256).eqNullSafe(F.col("hash"))).select(key, position, F.lit("content").alias("problem"))
    schema = T.StructType([*where, *(T.StructField(n, t) for n, t in (("segment", T.IntegerType()), ("first", T.BooleanType()), ("prev_hash", T.StringType()), ("hash", T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]):
        """The broken links of a segment, and its first and last entry."""
        segment, last = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in (key, position, "prev_hash", "hash"))))
            out = []
            for r in rows:
                if last is None:
                    out.append((*r[:2], segment, True, r[2], None))
                elif r[2] != (last[3] if r[0] == last[0] else genesis):
                    out.append((*r[:2], None, False, None, None))
                last = r
            if out:
                yield _batch(out, batch)
        if last is not None:
            yield _batch([(*last[:2], segment, False, None, last[3])], batch)

    def _batch(out: list, like: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [like.column(key).type, like.column(position).type, pa.int32(), pa.bool_(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=schema.names)

    dealt = chain.select(key, position, "prev_hash", "hash").repartitionByRange(key, position).sortWithinPartitions(key, position)
    found = checkpoint(dealt.mapInArrow(run, schema))
    broken = found.where("segment IS NULL").select(key, position)
    # One row for either end of a segment: few, however many entries there are.
    ends = found.where("segment IS NOT NULL").groupBy("segment").agg(*(F.max(F.when(F.col("first") == is_first, F.struct(key, position, "prev_hash", "hash"))).alias(n) for n, is_first in (("a", True), ("b", False))))
    ends = ends.withColumn("before", F.lag("b").over(W.orderBy("segment")))
    wanted = F.when(F.col(f"before.{key}").eqNullSafe(F.col(f"a.{key}")) & F.col("before").isNotNull(), F.col("before.hash")).otherwise(genesis)
    cut = ends.where(~F.col("a.prev_hash").eqNullSafe(wanted)).select(f"a.{key}", f"a.{position}")
    return content.unionByName(broken.unionByName(cut).withColumn("problem", F.lit("link")))
