import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lambertlake.functions.kernels import SpectrumError
from lambertlake.operators import methods as m
from lambertlake.plans import pipeline as pl
from tests.test_pipeline import PX, PY, PZ, X

SCHEMA = "id int, x array<double>, y array<double>, concentrations map<string,double>"
MIX = [(6, 10), (10, 6), (14, 14), (8, 16), (18, 5)]


def frame(spark, rows):
    return spark.createDataFrame([(i, X.tolist(), (a * PX + b * PY + c * PZ).tolist(), {"X": float(a), "Y": float(b), "Z": float(c)}) for i, (a, b, c) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def data(spark):
    levels = (4, 8, 12, 16, 20)
    return {
        "X": frame(spark, [(c, 0, 0) for c in levels]), "Y": frame(spark, [(0, c, 0) for c in levels]), "Z": frame(spark, [(0, 0, c) for c in levels]),
        "all": frame(spark, [(c, 0, 0) for c in levels] + [(0, c, 0) for c in levels]), "mix": frame(spark, [(a, b, 0) for a, b in MIX]),
        "three": frame(spark, [(c, 0, 0) for c in levels] + [(0, c, 0) for c in levels] + [(0, 0, c) for c in levels]), "mix3": frame(spark, [(6, 10, 4), (10, 6, 12), (14, 14, 8)]),
    }


LIBRARY = pl.Library({"Y": (X, 10 * PY), "X": (X, 10 * PX)})


def check(df, tolerance=0.02, compounds=("X", "Y")):
    for r in df.collect():
        for c in compounds:
            assert r[f"found_{c}"] == pytest.approx(r.concentrations[c], rel=tolerance), (c, r.id)


@pytest.mark.parametrize(
    "steps,measurement",
    [
        ([("divide", {"reference": "Y"})], {"kind": "difference", "params": {"w1": 240, "w2": 262}}),
        ([("divide", {"reference": "Y"}), ("derivative", {})], {"kind": "amplitude", "params": {"w1": 250}}),
        ([("divide", {"reference": "Y"}), ("mean_center", {"start": 220, "end": 300})], {"kind": "amplitude", "params": {"w1": 245}}),
        ([("ratio_subtraction", {"divisor": "Y", "start": 330, "end": 350})], {"kind": "amplitude", "params": {"w1": 245}}),
        ([], {"kind": "weighted_difference", "params": {"w1": 245, "w2": 300, "reference": "Y"}}),
    ],
)
def test_univariate(data, steps, measurement):
    method = m.Univariate("X", [{"op": o, "params": p} for o, p in steps], measurement).fit(data["X"], LIBRARY)
    check(method.predict(data["mix"], LIBRARY), compounds=("X",))
    again = m.load(json.loads(json.dumps(method.definition())))
    check(again.predict(data["mix"], LIBRARY), compounds=("X",))
    assert m.is_calibrated(method.definition())


def test_equations(data):
    signals = [{"measurement": {"kind": "amplitude", "params": {"w1": w}}} for w in (245, 275, 330)]
    for intercept in (False, True):
        method = m.SignalEquations(["X", "Y"], signals, intercept).fit(data["all"])
        check(method.predict(data["mix"]), 1e-6)
        assert method.condition > 1
    areas = [{"measurement": {"kind": "area", "params": {"w1": a, "w2": b}}} for a, b in ((235, 255), (265, 285))]
    check(m.SignalEquations(["X", "Y"], areas).fit(data["all"]).predict(data["mix"]), 1e-6)
    with pytest.raises(SpectrumError):
        m.SignalEquations(["X", "Y"], signals[:1]).fit(data["all"])
    with pytest.raises(Exception, match="no concentration of Q"):
        m.SignalEquations(["X", "Q"], signals).fit(data["all"])


def test_special_methods(data):
    iso = next(w for w in np.arange(250, 270, 0.5) if abs(np.interp(w, X, PX) - np.interp(w, X, PY)) < 6e-4)
    plateau = (340.0, 360.0)
    induced = m.InducedAmplitudeModulation("X", "Y", 245.0, plateau).fit(data["X"], data["Y"])
    check(induced.predict(data["mix"]), 1e-4)
    subtraction = m.AbsorbanceSubtraction("X", "Y", iso, 340.0).fit(data["Y"], data["all"])
    check(subtraction.predict(data["mix"]), 0.08)
    modulation = m.AmplitudeModulation("X", "Y", (X, 10 * PY), 10.0, iso, plateau).fit(data["all"])
    check(modulation.predict(data["mix"]), 0.08)
    level = np.interp(265.0, X, PY)
    other = next(w for w in np.arange(275, 320, 0.5) if np.interp(w, X, PY) <= level)
    advanced = m.AdvancedAbsorbanceSubtraction("X", "Y", 265.0, float(other)).fit(data["X"], data["Y"])
    check(advanced.predict(data["mix"]), 0.06)


def test_progressive_methods(data):
    centering = m.AmplitudeCentering("Y", (X, 10 * PY), [{"compound": "Y", "kind": "plateau", "w1": 345.0, "w2": 360.0}, {"compound": "X", "kind": "rest", "w": 245.0}]).fit(data["all"])
    check(centering.predict(data["mix"]), 1e-3)
    check(m.load(json.loads(json.dumps(centering.definition()))).predict(data["mix"]), 1e-3)
    factor = m.AbsorptionFactor([{"compound": "Y", "w": 345.0}, {"compound": "X", "w": 245.0}]).fit(data["all"])
    check(factor.predict(data["mix"]), 1e-3)
    with pytest.raises(SpectrumError):
        m.AmplitudeCentering("Y", (X, PY), [{"compound": "Y", "kind": "plateau"}] * 2)


def test_standard_additions(spark):
    df = spark.createDataFrame([(float(a), 0.04 * (8 + a) + 0.3, 0.01 * (8 + a) + 0.3) for a in range(5)], "added double, p double, q double")
    assert m.addition_intersection(df, "added", "p", "q")["found"] == pytest.approx(8)


def test_robustness_and_templates(data):
    method = m.Univariate("X", [{"op": "divide", "params": {"reference": "Y"}}], {"kind": "difference", "params": {"w1": 240.0, "w2": 262.0}})
    rows = m.robustness(method, data["X"], data["mix"], LIBRARY)
    assert {r["parameter"] for r in rows} == {"measurement.w1", "measurement.w2"} and all(abs(r["deviation"]) < 1 for r in rows)
    assert len(m.TEMPLATES) == 29 and set(m.templates_by_family()) == {"zero_order", "derivative", "ratio_amplitude", "ratio_derivative", "resolution"}
    assert m.pure_standards(data["three"], "Z").count() == 5
    assert m.determine(m.Univariate("X", [], {"kind": "amplitude", "params": {"w1": 245}}).fit(data["X"]), data["mix"]).columns == ["id", "found_X"]
    x, y = m.unit_spectrum(data["three"], "X")
    assert y == pytest.approx(PX) and F.lit(1) is not None
