import json

import numpy as np
import pytest

from lambertlake.plans import derived
from lambertlake.plans.ops import Batch, apply_pipeline
from lambertlake.plans.pipeline import Library

X = np.arange(200, 221.0)
POINTS = "id long, x array<double>, y array<double>"
PLAN = "id long, parent long, pipeline string"


def step(op, **params):
    return {"op": op, "params": params}


def raw(spark, n=4):
    return spark.createDataFrame([(i, X.tolist(), (1 + i + np.cos(X / (i + 2))).tolist()) for i in range(n)], POINTS)


def test_a_lineage_is_that_of_one_pipeline_after_another(spark):
    rng = np.random.default_rng(0)
    values = {i: (X, 1 + i + np.cos(X / (i + 2))) for i in range(4)}
    plan = []
    for i in range(10, 130):  # each from any earlier one, by one of some fifty pipelines
        parent, ref = (int(rng.choice([k for k in values if k not in (i,)])) for _ in range(2))
        ref = int(rng.integers(0, 4)) if rng.random() < 0.7 else ref
        steps = [[step("scale", factor=float(i % 7 + 1))], [step("subtract", reference=ref, factor=0.25)], [step("smooth_ma", window=3), step("offset", value=0.5)], []][i % 4]
        plan.append((i, parent, json.dumps(steps)))
        b = apply_pipeline(Batch(values[parent][0], values[parent][1][None]), steps, Library(values))
        values[i] = (b.x, b.y[0])
    got = derived.derive(raw(spark), spark.createDataFrame(plan[::-1], PLAN).repartition(3)).collect()
    assert len(got) == len(plan) and all(r["_error"] is None for r in got)
    for r in got:
        assert r.y == pytest.approx(values[r.id][1].tolist())
    level = {r.id: r.level for r in got}
    for i, parent, _ in plan:
        assert level[i] > level.get(parent, 0)


def test_what_cannot_be_derived_says_why(spark):
    plan = [
        (10, 0, json.dumps([step("divide", reference=99)])),  # no such reference
        (11, 10, "[]"),  # its parent failed
        (12, 77, "[]"),  # no such parent
        (13, 14, "[]"),
        (14, 13, "[]"),  # each from the other
        (15, 0, json.dumps([step("crop", start=500, end=600)])),
        (16, 0, "not json"),
        (17, 1, None),
        (18, None, "[]"),
    ]
    got = {r.id: r for r in derived.derive(raw(spark), spark.createDataFrame(plan, PLAN)).collect()}
    assert len(got) == len(plan)
    assert {i for i, r in got.items() if r["_error"] is None} == {17}
    assert all(r.x is None and r.y is None for i, r in got.items() if i != 17)
    assert "itself" in got[13]["_error"] and "missing" in got[12]["_error"] and "missing" in got[11]["_error"]
    with pytest.raises(ValueError, match="more than once"):
        derived.derive(raw(spark), spark.createDataFrame([(0, 1, "[]")], PLAN))
    assert derived.derive(raw(spark), spark.createDataFrame([], PLAN)).count() == 0


def test_as_many_jobs_as_levels(spark):
    """1,000 derived spectra of 50 pipelines on four levels."""
    plan = [(1000 * k + i, 1000 * (k - 1) + i if k > 1 else i % 4, json.dumps([step("scale", factor=1 + i % 50 / 50)])) for k in range(1, 5) for i in range(250)]
    got = derived.derive(raw(spark), spark.createDataFrame(plan, PLAN))
    assert got.groupBy("level").count().orderBy("level").collect() == [(k, 250) for k in range(1, 5)]
    y = {r.id: r.y for r in got.where("id % 1000 = 249").collect()}
    assert y[4249] == pytest.approx(((1 + 1 + np.cos(X / 3)) * (1 + 49 / 50) ** 4).tolist())
