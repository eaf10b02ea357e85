import numpy as np
import pytest
from pyspark.sql import functions as F

from lambertlake.functions.kernels import SpectrumError
from lambertlake.plans import measure, ops
from lambertlake.plans import pipeline as pl

X = np.arange(200, 400.5, 0.5)


def g(c, w, x=X):
    return np.exp(-(((x - c) / w) ** 2) / 2)


PX = 0.040 * g(245, 12) + 0.015 * g(270, 8)
PY = 0.030 * g(275, 22) + 0.020 * g(330, 18)
PZ = 0.035 * g(260, 10) + 0.010 * g(225, 8)
REFS = {"X": (X, 10 * PX), "Y": (X, 10 * PY), "Z": (X, 10 * PZ)}
LIBRARY = pl.Library(REFS)

STEPS = {
    "crop": {"start": 220, "end": 390}, "resample": {"step": 1.5}, "smooth_sg": {}, "smooth_ma": {}, "smooth_whittaker": {},
    "baseline_offset": {}, "baseline_linear": {}, "baseline_poly": {}, "baseline_als": {}, "subtract": {"reference": "Y"},
    "add": {"reference": "Y"}, "divide": {"reference": "Y"}, "divide_centered_ratio": {"reference": "X", "divisor": "Y", "end": 290},
    "divide_sum": {"reference": "X", "reference2": "Y"}, "multiply": {"reference": "Y"}, "scale": {"factor": 3}, "offset": {"value": 0.2},
    "mean_center": {}, "subtract_plateau": {}, "normalize": {}, "snv": {}, "t_to_a": {}, "a_to_t": {}, "derivative": {"order": 2},
    "ratio_subtraction": {"divisor": "Y", "start": 330, "end": 350}, "constant_multiplication": {"divisor": "Y", "start": 330, "end": 350},
    "extended_ratio_subtraction": {"divisor": "Y", "reference": "X", "start": 330, "end": 350}, "factorized_recovery": {"reference": "Y", "wavelength": 340},
    "spectrum_subtraction": {"reference": "Y", "wavelength": 330, "derivative_order": 1}, "constant_center": {"divisor": "Y", "reference": "X", "w1": 235, "w2": 255},
}


def frame(spark, rows):
    return spark.createDataFrame([(i, X.tolist(), y.tolist()) for i, y in enumerate(rows)], "id int, x array<double>, y array<double>")


def mixtures(*pairs):
    return np.stack([a * PX + b * PY for a, b in pairs])


@pytest.mark.parametrize("key", list(ops.OPERATIONS))
def test_superposition_holds_where_it_is_claimed(key):
    rng = np.random.default_rng(3)
    a, b = (sum(rng.uniform(0.1, 1) * g(rng.uniform(220, 380), rng.uniform(15, 30)) for _ in range(3)) + 0.01 for _ in range(2))
    step = [{"op": key, "params": STEPS[key]}]
    out = ops.apply_pipeline(ops.Batch(X, np.stack([a, b, 0.4 * a + 1.7 * b, 0 * a])), step, LIBRARY).y
    if ops.OPERATIONS[key].kind == "nonlinear":
        return
    zero = out[3] if ops.OPERATIONS[key].kind == "affine" else 0 * out[3]
    want = 0.4 * (out[0] - zero) + 1.7 * (out[1] - zero) + zero
    assert out[2] == pytest.approx(want, rel=1e-8, abs=1e-9 * max(1, np.abs(out).max()))


def test_resolution_recovers_the_components():
    y = mixtures((8, 12), (15, 5))
    run = lambda op, **p: ops.apply_pipeline(ops.Batch(X, y), [{"op": op, "params": p}], LIBRARY).y
    plateau = {"divisor": "Y", "start": 330, "end": 350}
    assert run("ratio_subtraction", **plateau) == pytest.approx(np.stack([8 * PX, 15 * PX]), abs=1e-6)
    assert run("constant_multiplication", **plateau) == pytest.approx(np.stack([12 * PY, 5 * PY]), abs=1e-6)
    assert run("extended_ratio_subtraction", reference="X", **plateau) == pytest.approx(np.stack([12 * PY, 5 * PY]), abs=1e-5)
    assert run("spectrum_subtraction", reference="Y", wavelength=340) == pytest.approx(np.stack([8 * PX, 15 * PX]), abs=1e-6)
    assert run("constant_center", divisor="Y", reference="X", w1=235, w2=255) == pytest.approx(np.stack([8 * PX, 15 * PX]), abs=1e-6)


@pytest.mark.parametrize(
    "steps,measurement",
    [
        ([("divide", {"reference": "Y"}), ("derivative", {})], {"kind": "amplitude", "params": {"w1": 250.2}}),
        ([("smooth_sg", {}), ("subtract", {"reference": "Y", "factor": 0.5})], {"kind": "mean", "params": {"w1": 240, "w2": 260}}),
        ([("ratio_subtraction", STEPS["ratio_subtraction"])], {"kind": "area", "params": {"w1": 230, "w2": 270, "baseline": "linear"}}),
        ([], {"kind": "weighted_difference", "params": {"w1": 250, "w2": 280, "reference": "Y"}}),
        ([("smooth_whittaker", {}), ("offset", {"value": 0.3})], {"kind": "difference", "params": {"w1": 250, "w2": 280}}),
    ],
)
def test_fused_is_direct(spark, steps, measurement):
    steps = [{"op": o, "params": p} for o, p in steps]
    df = frame(spark, mixtures((8, 12), (15, 5), (3, 9)))
    fused = pl.signals(df, steps, measurement, LIBRARY)
    assert "MapInArrow" not in fused._jdf.queryExecution().executedPlan().toString()
    a = [r.signal for r in fused.orderBy("id").collect()]
    b = [r.signal for r in pl.signals(df, steps, measurement, LIBRARY, fuse=False).orderBy("id").collect()]
    assert a == pytest.approx(b, rel=1e-9, abs=1e-12)


def test_permissive_rows(spark):
    df = frame(spark, [PX, 0 * PX]).union(spark.createDataFrame([(9, [1.0], [2.0]), (10, None, None)], "id int, x array<double>, y array<double>"))
    got = {r.id: r for r in pl.process(df, [{"op": "snv"}], mode=pl.PERMISSIVE).collect()}
    assert got[0]["_error"] is None and got[0].y is not None
    assert "constant" in got[1]["_error"] and got[1].y is None
    assert got[9]["_error"] and got[10]["_error"]
    with pytest.raises(Exception, match="constant"):
        pl.process(df.where("id < 2"), [{"op": "snv"}]).collect()
    with pytest.raises(SpectrumError, match="missing"):
        LIBRARY("nope")


def test_tidy_and_long_points(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, 2.0, 1.0], [9.0, 1.0, 4.0, 3.0]), (2, [1.0, 2.0], [5.0, 6.0])], "id int, x array<double>, y array<double>")
    rows = {r.id: (r.x, r.y) for r in pl.tidy(df).collect()}
    assert rows == {1: ([1.0, 2.0, 3.0], [2.0, 4.0, 9.0]), 2: ([1.0, 2.0], [5.0, 6.0])}
    long = df.select("id", F.explode(F.arrays_zip("x", "y")).alias("p")).select("id", "p.x", "p.y")
    assert {r.id: (r.x, r.y) for r in pl.spectra(long, "id", "x", "y").collect()} == rows


def test_measurements():
    b = ops.Batch(X, PX[None])
    for kind in measure.KINDS:
        value = measure.measure(b, {"kind": kind, "params": {"w1": 240, "w2": 260, "factor": 0.5}})
        assert np.isfinite(value).all()
    assert measure.measure(b, {"kind": "peak_to_peak", "params": {"w1": 260, "w2": 240}})[0] == pytest.approx(np.ptp(PX[(X >= 240) & (X <= 260)]))


@pytest.mark.parametrize("grids", [1, 9])
@pytest.mark.parametrize("length", [4, 6])
def test_malformed_rows_fail_however_many_grids(spark, grids, length):
    rows = [(i, [i % grids * 0.1 + j for j in range(5)], [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(18)]
    rows.append((99, rows[0][1], [3.0] * length))
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>")
    with pytest.raises(Exception, match="x and y must be arrays of one length"):
        pl.signals(df, [], {"kind": "mean", "params": {"w1": 1.0, "w2": 3.0}}).collect()
