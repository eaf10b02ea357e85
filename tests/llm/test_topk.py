import numpy as np
import pytest
from pyspark.sql import functions as F

from lambertlake.llm import topk


def brute(ids, vectors, asks, k):
    out = []
    for i, q in zip(ids, vectors):
        if asks(i):
            best = sorted((-int(q @ v), int(j)) for j, v in zip(ids, vectors) if j != i)[:k]
            out += [(int(i), n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n,shard_rows,spread", [(3000, 700, 900), (3000, 5000, 3), (5, 100, 9), (1, 10, 9)])
def test_is_exact(spark, n, shard_rows, spread):
    rng = np.random.default_rng(n)
    vectors = rng.integers(-spread, spread, (n, 8))
    vectors[n // 3 : 2 * n // 3] = vectors[0]  # one common vector
    ids = rng.permutation(4 * n)[:n]
    df = spark.createDataFrame([(int(i), [int(x) for x in v], "z") for i, v in zip(ids, vectors)], "vec_id long, vector array<long>, score string")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 10, shard_rows=shard_rows, block_rows=64).collect()
    assert sorted(map(tuple, got)) == brute(ids, vectors, lambda i: i % 10 == 0, 10)


def test_large_products_are_exact(spark):
    df = spark.createDataFrame([(i, [2**30 + i, 2**30 - i]) for i in range(30)], "vec_id long, vector array<long>")
    got = topk.top_k(df, F.col("vec_id") == 0, 3).collect()
    vectors = np.array([(2**30 + i, 2**30 - i) for i in range(30)], np.int64)
    assert sorted(map(tuple, got)) == brute(np.arange(30), vectors, lambda i: i == 0, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [inf, 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (None, [9.0, 9.0]), (6, [1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(topk.usable(F.col("embedding")))
    df = df.select("vec_id", topk.quantized(F.col("embedding")).alias("vector"))
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, 10).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 6, 1024 * 1024), (0, 2, 5, 1024 * 512), (0, 3, 7, 0)]
    assert topk.top_k(df.limit(0), F.lit(True), 10).count() == 0


def test_whole_table(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = topk.op4_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(topk.OP4_SQL).fetchall())
