"""Exact top-k search by inner product: a ball tree per shard, branch and bound.

Vectors are dealt to shards by their identifier. A shard's task builds a ball tree and then
takes in blocks of queries, one after the other. The inner product with anything in a ball is
at most q.c + |q| r; going down the tree, a branch is left out for the queries whose kth score
exceeds its bound, and the leaves that remain are visited in descending order of bound until
the bound falls below the kth score, which rises meanwhile. The kth score is shared: every
block first searches one home shard, and what it finds there bounds its search in all others.

Exact: integer scores, ties to the smaller identifier, a branch whose bound equals the kth
score is visited. A shard holds at most ``shard_rows`` vectors or so and a block ``block_rows``
queries, so a task's memory doesn't grow with the table. Rows with a null identifier, null
vectors and vectors that hold null or non-finite components take no part; shorter vectors are
padded with zeros; rows that repeat an identifier are one row, that of the smallest vector. A
query is never its own result. Fewer than k other rows give fewer results; an empty table none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lambertlake.llm import runtime

SHARD_ROWS, BLOCK_ROWS, LEAF = 32_768, 512, 256
NONE = np.iinfo(np.int64).min


class BallTree:
    """Integer vectors in a binary tree of balls, level by level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        keep = np.lexsort([*vectors.T[::-1], ids])
        keep = keep[np.r_[True, ids[keep][1:] != ids[keep][:-1]]] if len(ids) else keep
        self.ids, self.vectors = ids[keep], vectors[keep]
        order = np.arange(len(self.ids))
        #: Levels of (start, stop, index of the parent in the level above); leaves stay in every later level.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        level = [(0, len(order), 0)] if len(order) else []
        while level:
            self.levels.append(tuple(np.array(x, np.int64) for x in zip(*level)))
            if all(b - a <= LEAF for a, b, _ in level):
                break
            below = []
            for at, (a, b, _) in enumerate(level):
                if b - a <= LEAF:
                    below.append((a, b, at))
                    continue
                part = self.vectors[order[a:b]]
                split = part[:, np.argmax(part.max(0) - part.min(0))]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(split, half)]
                below += [(a, a + half, at), (a + half, b, at)]
            level = below
        self.ids, self.vectors = self.ids[order], self.vectors[order]
        top = int(np.abs(self.vectors).max(initial=0))
        #: Doubles are exact while products stay below 2^53; beyond it scores are taken in integers.
        self.top = top
        self.real = self.vectors.astype(np.float64)
        self.balls = []
        for start, stop, _ in self.levels:
            centers = np.stack([self.real[a:b].mean(0) for a, b in zip(start, stop)])
            radii = np.array([np.sqrt(((self.real[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(start, stop, centers)])
            self.balls.append((centers, radii))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query its best (-score, id) here, at most k, none worse than ``kth``, which is raised."""
        found: list[list[tuple[int, int]]] = [[] for _ in own]
        if not self.levels or not len(own):
            return found
        real = queries.astype(np.float64)
        exact = float(self.top) * float(np.abs(queries).max(initial=0)) * queries.shape[1] < 2**53
        norms = np.sqrt((real**2).sum(1))
        alive = np.ones((len(own), 1), bool)
        for (_, _, parent), (centers, radii) in zip(self.levels, self.balls):
            bound = real @ centers.T + norms[:, None] * radii
            bound += 1e-6 * (np.abs(bound) + 1)
            alive = alive[:, parent] & (bound >= kth[:, None])
        bound[~alive] = -np.inf
        start, stop, _ = self.levels[-1]
        order = np.argsort(-bound, axis=1)
        active = np.arange(len(own))
        for turn in range(len(start)):
            leaf = order[active, turn]
            still = (bound[active, leaf] >= kth[active]) & np.isfinite(bound[active, leaf])
            active, leaf = active[still], leaf[still]
            if not len(active):
                break
            by = np.argsort(leaf, kind="stable")
            for group in np.split(active[by], np.flatnonzero(np.diff(leaf[by])) + 1):
                a, b = start[order[group[0], turn]], stop[order[group[0], turn]]
                scores = real[group] @ self.real[a:b].T if exact else queries[group] @ self.vectors[a:b].T
                hits = (scores >= kth[group, None]) & (self.ids[a:b] != own[group, None])
                for g in np.flatnonzero(hits.any(1)):
                    q, hit = group[g], np.flatnonzero(hits[g])
                    if len(hit) > 4 * k:  # the k best and what ties with the last of them
                        hit = hit[scores[g][hit] >= np.partition(scores[g][hit], len(hit) - k)[len(hit) - k]]
                    mine = found[q] = sorted(found[q] + [(-int(scores[g][i]), int(self.ids[a + i])) for i in hit])[:k]
                    if len(mine) == k:
                        kth[q] = max(kth[q], -mine[-1][0])
        return found


def quantized(vector: Column) -> Column:
    """floor(1024 * component) as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("long"))


def usable(vector: Column) -> Column:
    def odd(x):
        real = x.cast("double")
        return real.isNull() | F.isnan(real) | (F.abs(real) == float("inf"))

    return vector.isNotNull() & ~F.exists(vector, odd)


_FOUND = "block long, ids array<long>, vals array<long>, kth array<long>, query array<long>, found array<long>, score array<long>"
_LONGS = pa.list_(pa.int64())


def _visit(dealt: DataFrame, k: int, width: int) -> DataFrame:
    """Per query block and shard what the shard has for it, with the raised kth scores."""

    def run(batches):
        shard, parts, tree = None, [], None
        for batch in batches:
            shards, blocks = batch.column("shard").to_numpy(), batch.column("block").to_numpy()
            ids, vals, kths = batch.column("ids"), batch.column("vals"), batch.column("kth")
            at = 0
            while at < batch.num_rows:
                if shards[at] != shard:
                    shard, parts, tree = shards[at], [], None
                if blocks[at] < 0:  # vectors of the shard come first
                    end = at + 1
                    while end < batch.num_rows and shards[end] == shard and blocks[end] < 0:
                        end += 1
                    parts.append(tuple(np.array(c.slice(at, end - at).flatten().to_numpy(zero_copy_only=False)) for c in (ids, vals)))
                    at = end
                    continue
                if tree is None:
                    tree = BallTree(np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)]), np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)]).reshape(-1, width))
                own, flat, kth = (np.array(c.slice(at, 1).flatten().to_numpy(zero_copy_only=False)) for c in (ids, vals, kths))
                got = tree.search(own, flat.reshape(-1, width), k, kth)
                rows = [(q, i, -s) for q, best in zip(own, got) for s, i in best]
                columns = [own, flat, kth, *(np.array([r[j] for r in rows], np.int64) for j in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array([blocks[at]], pa.int64()), *(pa.array([c], _LONGS) for c in columns)], names=[x.split()[0] for x in _FOUND.split(", ")])
                at += 1

    return dealt.mapInArrow(run, _FOUND)


def top_k(
    df: DataFrame, is_query: Column, k: int = 10, ident: str = "vec_id", vector: str = "vector",
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for each query row; vectors hold integers."""
    spark = df.sparkSession
    runtime.small_batches(spark)
    rows = df.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asks"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks"), F.max(F.size("v")).alias("width")).first()
    # At least a shard for every core, unless shards would be small; the results are the same.
    shards = max(1, -(-size["n"] // shard_rows), min(spark.sparkContext.defaultParallelism, -(-8 * size["n"] // shard_rows)))
    blocks, width = max(1, -(-size["asks"] // block_rows)), max(1, size["width"] or 1)
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    empty = F.array().cast("array<long>")
    vectors = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.lit(-1).cast("long").alias("block"), F.array("id").alias("ids"), padded.alias("vals"), empty.alias("kth")
    )
    asked = rows.where("asks").groupBy("id").agg(F.min(padded).alias("v"))
    asked = asked.groupBy(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("q"))
    asked = asked.select("block", F.col("q.id").alias("ids"), F.flatten("q.v").alias("vals"), F.transform("q", lambda _: F.lit(int(NONE)).cast("long")).alias("kth"))

    def dealt(queries: DataFrame) -> DataFrame:
        both = vectors.unionByName(queries.select("shard", "block", "ids", "vals", "kth"))
        parts = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
        return both.repartition(parts, "shard").sortWithinPartitions("shard", "block")

    home = runtime.checkpoint(_visit(dealt(asked.withColumn("shard", F.pmod("block", F.lit(shards)))), k, width))
    every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    others = home.select("block", "ids", "vals", "kth", F.explode(every).alias("shard"))
    found = home
    if shards > 1:
        found = home.unionByName(_visit(dealt(others.where(F.col("shard") != F.pmod("block", F.lit(shards)))), k, width))
    pairs = found.select(F.explode(F.arrays_zip("query", "found", "score")).alias("x"))
    pairs = pairs.select(F.col("x.query").alias("query_id"), F.col("x.found").alias("vec_id"), F.col("x.score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    rows = runtime.table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    return top_k(rows.select("vec_id", quantized(F.col("embedding")).alias("vector")), F.col("vec_id") % 100 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
