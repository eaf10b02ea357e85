import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lambertlake.operators import series, stats
from lambertlake.storage import results as rs


def one(df):
    return df.collect()[0]


def test_line_of_a_textbook(spark):
    # Fluorescence standards: slope 1.93, intercept 1.52, r 0.9989.
    x, y = [0, 2, 4, 6, 8, 10, 12], [2.1, 5.0, 9.0, 12.6, 17.3, 21.0, 24.7]
    df = spark.createDataFrame(list(zip(map(float, x), y)), "x double, y double")
    r = one(stats.linear_regression(df, "x", "y"))
    assert (round(r.slope, 2), round(r.intercept, 2), round(r.r, 4)) == (1.93, 1.52, 0.9989)
    assert (r.s_yx, r.sd_slope, r.sd_intercept) == pytest.approx((0.4329, 0.0409, 0.2949), abs=2e-4)
    assert round(r.t, 2) == 2.57
    line = stats.linear_regression(df, "x", "y")
    got = one(line.select(stats.predict_x(F.lit(13.5)).alias("x0"), stats.ci_x(F.lit(13.5)).alias("ci"), stats.ci_x(F.lit(13.5), 4).alias("ci4")))
    assert round(got.x0, 2) == 6.21 and round(got.ci / r.t, 2) == 0.24 and round(got.ci4 / r.t, 2) == 0.14
    origin = one(stats.linear_regression(df, "x", "y", through_origin=True))
    assert origin.slope == pytest.approx(np.dot(x, y) / np.dot(x, x)) and origin.intercept == 0
    with pytest.raises(Exception, match="more than one x"):
        stats.linear_regression(df.where("x = 2").union(df.where("x = 2")).union(df.where("x = 2")), "x", "y").collect()


def test_outliers(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.403, 0.410, 0.401, 0.380])], "i int, v double")
    q = one(stats.dixon(df, "v"))
    assert round(q.q, 2) == 0.70 and q.q_crit == 0.829 and not q.outlier and q.value == 0.380
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.403, 0.410, 0.401, 0.380, 0.400, 0.413, 0.408])], "i int, v double")
    g = one(stats.grubbs(df, "v", "i"))
    assert g.value == 0.380 and g.ident == 3 and g.g_crit == pytest.approx(2.020, abs=1e-3) and g.outlier
    assert one(stats.dixon(df, "v")).outlier


def test_comparisons():
    t = stats.t_test(100.2, 0.8, 6, 99.5, 1.1, 6)
    assert t["t"] == pytest.approx(0.7 / np.sqrt((0.64 + 1.21) / 2 * 2 / 6)) and t["dof"] == 10 and round(t["t_crit"], 3) == 2.228
    f = stats.f_test(0.8, 6, 1.1, 6)
    assert f["f"] == pytest.approx(1.21 / 0.64) and round(f["f_crit"], 2) == 5.05 and round(f["f_crit_two_tailed"], 2) == 7.15
    with pytest.raises(ValueError):
        stats.f_test(0, 5, 0, 5)
    assert stats.interval_hypothesis(100, 0.3, 6, 100, 0.3, 6)["accepted"]
    assert not stats.interval_hypothesis(103, 0.3, 6, 100, 0.3, 6)["accepted"]


def test_comparisons_refuse_what_is_undefined():
    for arguments in ((1, 0.1, 1, 1, 0.1, 5), (1, -0.1, 5, 1, 0.1, 5), (1, float("nan"), 5, 1, 0.1, 5), (1, 0.0, 5, 2, 0.0, 5)):
        with pytest.raises(ValueError):
            stats.t_test(*arguments)
    with pytest.raises(ValueError):
        stats.f_test(0.1, 5, 0.2, 5, tails=3)


def test_comparisons_of_many_groups(spark):
    rng = np.random.default_rng(5)
    data = {(s, m): rng.normal(10, 1 + (m == "b"), n).tolist() for s, na, nb in (("x", 6, 8), ("y", 2, 3), (None, 4, 4)) for m, n in (("a", na), ("b", nb))}
    data |= {("single", "a"): [1.0], ("single", "b"): [1.0, 2.0], ("same", "a"): [1.0, 1.0], ("same", "b"): [1.0, 1.0], ("half", "a"): [1.0, 1.0], ("half", "b"): [1.0, 3.0]}
    df = spark.createDataFrame([(s, m, v) for (s, m), values in data.items() for v in [*values, None]], "s string, m string, v double")
    for equal in (True, False):
        got = {r["s"]: r for r in stats.t_tests(df, "v", "m", "a", "b", ["s"], equal_var=equal).collect()}
        for s in ("x", "y", None, "half"):
            a, b = data[s, "a"], data[s, "b"]
            want = stats.t_test(np.mean(a), np.std(a, ddof=1), len(a), np.mean(b), np.std(b, ddof=1), len(b), equal_var=equal)
            assert [got[s][c] for c in ("t", "dof", "p", "t_crit")] == pytest.approx([want[c] for c in ("t", "dof", "p", "t_crit")])
            assert got[s]["significant"] == want["significant"]
        assert got["single"]["t"] is got["same"]["t"] is got["same"]["p"] is None
    for tails in (1, 2):
        got = {r["s"]: r for r in stats.f_tests(df, "v", "m", "a", "b", ["s"], tails=tails).collect()}
        for s in ("x", "y", None, "half"):
            a, b = data[s, "a"], data[s, "b"]
            want = stats.f_test(np.std(a, ddof=1), len(a), np.std(b, ddof=1), len(b), tails=tails)
            assert [got[s][c] for c in ("f", "p", "f_crit")] == pytest.approx([want[c] for c in ("f", "p", "f_crit")])
            assert (got[s]["dof1"], got[s]["dof2"]) == want["dof"] and got[s]["significant"] == want["significant"]
        assert got["single"]["f"] is got["same"]["f"] is got["same"]["p"] is None
    assert stats.t_tests(df.where("false"), "v", "m", "a", "b", ["s"]).count() == 0


def test_dixon_names_the_value(spark):
    rows = [("a", 1, 5.0), ("a", 2, 1.0), ("a", 3, 1.1), ("a", 4, 5.0), (None, 7, 2.0), (None, 8, 2.1), (None, 9, 9.0), ("flat", 1, 3.0), ("flat", 2, 3.0), ("flat", 3, 3.0)]
    rows += [("long", i, float(i)) for i in range(11)] + [("short", 1, 1.0), ("short", 2, 2.0)]
    got = {r["g"]: r for r in stats.dixon(spark.createDataFrame(rows, "g string, i int, v double"), "v", ["g"], ident="i").collect()}
    assert set(got) == {"a", None, "flat"}
    assert got[None]["ident"] == 9 and got[None]["value"] == 9.0 and got[None]["outlier"]
    assert got["flat"]["q"] == 0 and got["flat"]["ident"] is None and not got["flat"]["outlier"]
    assert got["a"]["ident"] == 2


def test_round_levels():
    assert rs.round_levels(4, 20, 6) == [4, 10, 15, 20]
    assert rs.round_levels(2, 22, 6) == [2, 5, 10, 15, 22]
    assert rs.round_levels(0.5, 1.5, 5) == [0.5, 0.75, 1.0, 1.25, 1.5]
    with pytest.raises(ValueError):
        rs.round_levels(3, 3, 5)


def test_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(x), float(3 + 2 * x + rng.normal(0, 0.2) + (x - 3) ** 2 * 0.3)) for g in "abc" for x in range(6) for _ in range(3)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    lof = one(stats.lack_of_fit(df, "x", "y"))
    values = {x: [r[2] for r in rows if r[1] == x] for x in map(float, range(6))}
    pure = sum(np.var(v) * len(v) for v in values.values())
    fit = np.polyfit([r[1] for r in rows], [r[2] for r in rows], 1)
    sse = sum((r[2] - np.polyval(fit, r[1])) ** 2 for r in rows)
    assert lof.f == pytest.approx((sse - pure) / 4 / (pure / 48)) and lof.f > lof.f_crit and lof.p < 1e-6
    a = one(stats.anova(df, "y", "g"))
    assert a.dof_between == 2 and a.dof_within == 51 and 0 <= a.p <= 1
    e = one(stats.prediction_error(df, "y", "x"))
    assert e.rmsep == pytest.approx(np.sqrt(np.mean([(r[2] - r[1]) ** 2 for r in rows])))
    assert one(stats.recovery(df.where("x > 0"), "y", "x")).n == 45


def test_design_is_orthogonal(spark):
    rows = np.array([list(r)[1:] for r in series.brereton_design(spark, 6).orderBy("run").collect()])
    assert (rows[0] == 0).all() and sorted(set(rows.ravel())) == [-2, -1, 0, 1, 2]
    for a, b in itertools.combinations(rows.T, 2):
        assert a @ b == 0 and len(set(zip(a, b))) == 25


def test_names(spark):
    names = ["PAR 12 CAF_3,5", "mix 4 and 7.5", "blank"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(series.concentrations_from_name(F.col("n"), ["PAR", "CAF"]).alias("c"))
    assert [r.c for r in df.collect()] == [{"PAR": 12.0, "CAF": 3.5}, {"PAR": 4.0, "CAF": 7.5}, {}]


def test_series(spark):
    y = [1.0, -1.0, 0.0, 2.0, 2.0, -2.0]
    df = spark.createDataFrame([(1, i, float(i), v) for i, v in enumerate(y)], "s int, i int, x double, y double")
    assert sorted(r.root for r in series.zero_crossings(df, "s", "i", "x", "y").collect()) == [0.5, 2.0, 4.5]
    assert one(series.longest_runs(df.withColumn("f", F.col("y") > 0), "s", "i", "f")).start == 3
    got = [(r.x, r.y) for r in series.resample(df, "s", "x", "y", 2.5).orderBy("x").collect()]
    assert got == [(0.0, 1.0), (2.5, 1.0), (5.0, -2.0)]
    series.register(spark)
    p = spark.sql("SELECT * FROM plateaus(array(1D,2D,3D,4D,5D), array(1D,1D,1D,9D,20D), 0.01D, 1D)").collect()
    assert [tuple(r) for r in p] == [(1.0, 3.0, 1.0)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 3)], "child int, parent int")
    up = series.ascend(edges, spark.createDataFrame([(5,)], "node int"))
    assert {(r.ancestor, r.depth) for r in up.collect()} == {(5, 0), (3, 1), (1, 2), (2, 3)}


def test_greenness(spark):
    scores = spark.createDataFrame([("m", 0.75, 2.0)] * 12, "method string, score double, weight double")
    assert one(stats.agree(scores)).score == 0.75
    eco = spark.createDataFrame([("m", 6.0), ("m", 3.0)], "method string, points double")
    assert one(stats.eco_scale(eco)).rating == "excellent"
    df = spark.createDataFrame([(5.0, 2, "Danger", 1.0)], "v double, p int, w string, k double")
    assert tuple(one(df.select(stats.reagent_penalty(F.col("v"), F.col("p"), F.col("w")), stats.energy_penalty(F.col("k"))))) == (4.0, 1.0)


def test_long_lines_of_ancestors(spark):
    n = 1500
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(3, 1), (2, 2)], "child int, parent int")
    up = series.ascend(edges, spark.createDataFrame([(n,), (5,)], "node int"))
    rows = {(r.node, r.ancestor): r.depth for r in up.collect()}
    # From 3 one may go to 1 at once.
    assert len(rows) == n + 1 + 6 and rows[n, 0] == n - 1 and rows[5, 0] == 4 and rows[5, 3] == 2 and rows[5, 1] == 3
    ring = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)], "child int, parent int")
    assert sorted(r.depth for r in series.descend(ring, spark.createDataFrame([(0,)], "node int")).collect()) == list(range(7))


def test_outliers_of_a_result(spark, monkeypatch):
    found = [100.1, 99.8, 100.3, 92.0, 99.9, 100.0]
    rows = [(i, "X", v, False) for i, v in enumerate(found)] + [(9, "X", 50.0, True), (10, "X", None, False), (11, "Y", 100.0, False)]
    monkeypatch.setattr(rs, "result_rows", lambda *_: spark.createDataFrame(rows, "spectrum_id int, compound string, recovery double, excluded boolean"))
    for test in ("grubbs", "dixon"):
        got = rs.outliers(None, 1, test=test).collect()
        assert [(r["compound"], r["ident"], r["value"]) for r in got] == [("X", 3, 92.0)]
    with pytest.raises(ValueError, match="grubbs or dixon"):
        rs.outliers(None, 1, test="other")
