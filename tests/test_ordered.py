import hashlib
import random
import statistics
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lambertlake.operators import ordered, series
from lambertlake.storage import chain


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(-5, 5).map(float)))), st.integers(0, 9))
def test_medians_are_those_of_every_window(rows, half):
    rows = sorted(rows, key=lambda r: r[0])
    want = []
    for name in "ab":
        own = [v for s, v in rows if s == name]
        for i in range(len(own)):
            inside = [v for v in own[max(0, i - half) : i + half + 1] if v is not None]
            want.append(statistics.median(inside) if inside else None)
    assert list(ordered.medians(iter(rows), half)) == want


def test_running_median_over_batches(spark):
    rng = random.Random(1)
    rows = [(s, i, None if rng.random() < 0.1 else float(rng.randrange(50)), "keep") for s in ("a", "b", None) for i in range(rng.randrange(1, 200))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "s string, i int, v double, median string").repartition(3)
        for window in (1, 2, 9, 1001):
            got = {(r.s, r.i): r.median for r in ordered.running_median(df, "s", "i", "v", window).collect()}
            for s, i, _, _ in rows:
                inside = [v for t, j, v, _ in rows if t == s and abs(i - j) <= window // 2 and v is not None]
                assert got[s, i] == (statistics.median(inside) if inside else None)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ordered.running_median(df.limit(0), "s", "i", "v", 5).count() == 0


def test_time_hardly_grows_with_the_window():
    rng = np.random.default_rng(0)
    rows = [("a", v) for v in rng.normal(size=60_000).tolist()]

    def spent(half):
        began = time.process_time()
        assert sum(1 for _ in ordered.medians(iter(rows), half)) == len(rows)
        return time.process_time() - began

    assert spent(5000) < 6 * spent(5)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), max_size=40), st.integers(1, 6))
def test_best_partners_lie_on_the_first_hulls(points, k):
    v = np.array(points, float).reshape(-1, 2)
    layers = set(series.hull_layers(v, k).tolist())
    det = lambda i, j: abs(v[i][0] * v[j][1] - v[j][0] * v[i][1])
    ranked = sorted((-det(i, j) for i in range(len(v)) for j in range(i)))[:k]
    kept = sorted((-det(i, j) for i in layers for j in layers if j < i))[:k]
    assert [x for x in ranked if x < 0] == [x for x in kept if x < 0]


@pytest.mark.parametrize("seed", range(3))
def test_pairs_are_the_best_of_all(spark, seed):
    rng = np.random.default_rng(seed)
    n = 120
    a, b = (rng.integers(-9, 10, n).astype(float) if seed else rng.normal(size=n) for _ in range(2))
    df = spark.createDataFrame([(float(i), float(a[i]), float(b[i])) for i in range(n)] + [(999.0, None, 1.0)], "w double, a double, b double").repartition(4)
    want = sorted((-abs(a[i] * b[j] - a[j] * b[i]), i, j) for i in range(n) for j in range(i + 1, n))[:10]
    assert [(-r.det, r.w1, r.w2) for r in series.kaiser_pairs(df).collect()] == want
    plan = series.kaiser_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    flat = spark.createDataFrame([(float(i), 2.0 * i, 1.0 * i) for i in range(9)], "w double, a double, b double")
    assert [(r.w1, r.w2) for r in series.kaiser_pairs(flat, 3).collect()] == [(0, 1), (0, 2), (0, 3)]
    assert series.kaiser_pairs(flat.limit(0)).count() == 0


FIELDS = ["i", "what"]


def links(rows):
    out, heads = [], {}
    for k, i, what in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        before = heads.get(k, (0, "genesis"))
        after = hashlib.sha256("\x1f".join([before[1], str(i), what or ""]).encode()).hexdigest()
        out.append((k, i, what, before[1], after))
        heads[k] = before[0] + 1, after
    return out, heads


def made(n=300):
    rng = random.Random(2)
    return [(rng.choice(["a", "b", None]), i, rng.choice(["x", "é", None])) for i in range(n)]


def test_chains_and_heads(spark):
    rows = made()
    want, heads = links(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        df = spark.createDataFrame(rows, "k string, i long, what string").repartition(4)
        assert sorted(map(tuple, chain.chained(df, "k", "i", FIELDS).collect()), key=str) == sorted(want, key=str)
        assert {r.k: (r.n, r["head"]) for r in chain.heads(df, "k", "i", FIELDS).collect()} == heads
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert chain.heads(df.limit(0), "k", "i", FIELDS).count() == chain.altered(chain.chained(df.limit(0), "k", "i", FIELDS), "k", "i", FIELDS).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_what_was_altered_is_found(spark, parts):
    want, _ = links(made())
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        check = lambda rows: sorted(map(tuple, chain.altered(spark.createDataFrame(rows, "k string, i long, what string, prev_hash string, hash string"), "k", "i", FIELDS).collect()), key=str)
        assert check(want) == []
        for n in range(0, len(want), 99):
            k, i, what, before, after = want[n]
            changed = [*want[:n], (k, i, "other", before, after), *want[n + 1 :]]
            assert check(changed) == [(k, i, "content")]
        for n in range(0, len(want) - 1, 140):
            following = want[n + 1]
            lost = [*want[:n], *want[n + 1 :]]
            assert check(lost) == ([(following[0], following[1], "link")] if following[0] == want[n][0] else [])
        forged = [*want[:5], (*want[5][:3], want[5][3], "0" * 64), *want[6:]]
        assert check(forged) == sorted([(*want[5][:2], "content"), (*want[6][:2], "link")], key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_chain_of_many_entries(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("u").alias("k"), F.col("id").alias("i"), F.lit("w").alias("what"))
    head = "genesis"
    for i in range(n):
        head = hashlib.sha256(f"{head}\x1f{i}\x1fw".encode()).hexdigest()
    (row,) = chain.heads(df, "k", "i", FIELDS).collect()
    assert (row.n, row["head"]) == (n, head)


def test_reading_on_grids_of_their_own(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        x = sorted({rng.randrange(60) / 2 for _ in range(rng.randint(2, 20))} | {0.0, 30.0})
        grid = sorted(rng.choice([rng.uniform(-2, 33), rng.choice(x)]) for _ in range(rng.randint(0, 25)))
        rows.append((i, x, [rng.uniform(-1, 1) for _ in x], grid))
    df = spark.createDataFrame([*rows, (99, None, None, [1.0]), (98, [1.0], [1.0], [1.0])], "id int, x array<double>, y array<double>, grid array<double>")
    got = {r.id: r.v for r in df.select("id", series.resampled(F.col("x"), F.col("y"), F.col("grid")).alias("v")).collect()}
    assert got[99] is None and got[98] == [None]
    for i, x, y, grid in rows:
        want = [None if g < x[0] or g > x[-1] else float(np.interp(g, x, y)) for g in grid]
        assert [v is None for v in got[i]] == [v is None for v in want]
        assert [v for v in got[i] if v is not None] == pytest.approx([v for v in want if v is not None])
