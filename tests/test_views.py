import pytest

from lambertlake.operators import views
from lambertlake.storage import results


def test_views(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0, 3.0], [0.0, 2.0, 4.0]), (2, "b", [0.0, 2.0, 4.0], [1.0, 1.0, 3.0])], "id int, name string, x array<double>, y array<double>")
    assert {r.id: r.y for r in views.stacked(df).collect()} == {1: [0.0, 2.0, 4.0], 2: [2.5, 2.5, 4.5]}
    assert {r.id: (r.x, r.y) for r in views.difference(df).collect()} == {1: ([1.0, 2.0, 3.0], [0.0] * 3), 2: ([2.0], [-1.0])}
    assert {r.id: r.y for r in views.normalised(df).collect()}[1] == [0.0, 0.5, 1.0]
    assert views.figure_series(df).count() == 6
    nodes = spark.createDataFrame([(1, "root"), (2, "Mixture 5"), (3, "derived"), (4, "other")], "node int, label string")
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 1)], "child int, parent int")
    assert sorted(r.node for r in views.tree_filter(nodes, edges, "mix").collect()) == [1, 2]


def test_tree_filter_looks_at_all_that_is_shown(spark):
    nodes = spark.createDataFrame([(1, "root", "", None, None), (2, "a", "standard", 401, {"PAR": 5.0}), (3, "b", "mixture", 201, {"PAR": 7.5, "CAF": 2.0})], "node int, label string, role string, points int, concentrations map<string,double>")
    edges = spark.createDataFrame([(2, 1), (3, 1)], "child int, parent int")
    for text, want in (("MIXT", [1, 3]), ("401", [1, 2]), ("par 7.5", [1, 3]), ("caf", [1, 3]), ("par", [1, 2, 3]), ("none", [])):
        assert sorted(r.node for r in views.tree_filter(nodes, edges, text).collect()) == want, text


def test_decimation_keeps_extremes_and_ends(spark):
    import random

    rng = random.Random(3)
    rows = [(n, [float(i) for i in range(n)], [float(rng.randrange(9)) for _ in range(n)]) for n in (1, 3, 16, 17, 40, 403)]
    df = spark.createDataFrame([*rows, (0, None, None)], "id int, x array<double>, y array<double>")
    got = {r.id: (r.x, r.y) for r in views.decimated(df, 4).collect()}
    assert got[0] == (None, None)
    for n, x, y in rows:
        if n <= 16:
            assert got[n] == (x, y)
            continue
        each, want = -(-n // 4), set()
        for b in range(0, n, each):
            own = y[b : b + each]
            want |= {b, b + own.index(min(own)), b + own.index(max(own)), b + len(own) - 1}
        assert got[n] == ([x[i] for i in sorted(want)], [y[i] for i in sorted(want)])


def test_demonstration(spark, tmp_path):
    project, result = views.demo_project(spark, str(tmp_path / "demo"))
    rows = results.result_rows(project, result).collect()
    assert [r.recovery for r in rows] == pytest.approx([100] * 3, abs=3) and project.verify() == []
