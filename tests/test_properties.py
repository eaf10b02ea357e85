import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lambertlake.functions.kernels import SpectrumError
from lambertlake.plans import measure, ops
from lambertlake.plans import pipeline as pl
from lambertlake.sources import exchange, reader, text
from tests.test_pipeline import LIBRARY, PX, PY, STEPS, X


def steps(draw_from):
    one = st.sampled_from(draw_from).map(lambda key: {"op": key, "params": STEPS[key]})
    return st.lists(one, min_size=1, max_size=4)


LINEAR = [k for k, o in ops.OPERATIONS.items() if o.kind == "linear"]


@settings(max_examples=120, deadline=None)
@given(steps(list(ops.OPERATIONS)))
def test_any_pipeline_gives_finite_values_or_says_why(pipeline):
    b = ops.Batch(X, np.stack([8 * PX + 3 * PY + 0.01, 2 * PX + 9 * PY + 0.02]))
    try:
        out = ops.apply_pipeline(b, pipeline, LIBRARY)
    except SpectrumError as error:
        assert str(error)
        return
    assert (np.diff(out.x) > 0).all() and out.y.shape == (2, len(out.x))
    assert all(e is not None or np.isfinite(y).all() for e, y in zip(out.error, out.y))


@settings(max_examples=60, deadline=None)
@given(steps(LINEAR), st.sampled_from([{"kind": "amplitude", "params": {"w1": 250.0}}, {"kind": "difference", "params": {"w1": 240.0, "w2": 260.0}}, {"kind": "mean", "params": {"w1": 240.0, "w2": 260.0}}]))
def test_linear_pipelines_are_weights(pipeline, measurement):
    y = np.stack([8 * PX + 3 * PY + 0.01, 2 * PX + 9 * PY + 0.02])
    try:
        done = ops.apply_pipeline(ops.Batch(X, y), pipeline, LIBRARY)
        direct = measure.measure(done, measurement)
        w, b = pl.weights(X, pipeline, measurement, LIBRARY)
    except SpectrumError:
        return
    size = np.abs(w).max() * np.abs(y).max() + 1e-12
    if np.isfinite(direct).all() and math.isfinite(size):
        assert np.abs(y @ w + b - direct).max() <= 1e-7 * max(size, np.abs(direct).max()) + 1e-12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-3, 3, allow_nan=False, width=32), min_size=5, max_size=40), st.sampled_from([",", ";", "\t"]), st.booleans())
def test_text_round_trip(values, delimiter, descending):
    x = np.arange(200.0, 200 + len(values))
    order = slice(None, None, -1) if descending else slice(None)
    comma = delimiter == ";"
    cell = lambda v: f"{v:.6f}".replace(".", ",") if comma else f"{v:.6f}"
    content = f"nm{delimiter}sample one\n" + "".join(f"{cell(a)}{delimiter}{cell(v)}\n" for a, v in list(zip(x, values))[order])
    (found,) = reader.parse_file("f.csv", content.encode())
    assert found.name == "sample one" and found.x == pytest.approx(x) and found.y == pytest.approx(np.array(values), abs=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=2, max_size=60))
def test_exchange_round_trips(values):
    x, y = np.arange(200.0, 200 + len(values)), np.array(values)
    (a,) = exchange.parse_jcamp(exchange.write_jcamp("n", x, y), "n")
    assert (a.x == x).all() and (a.y == y).all()
    (b,) = exchange.parse_spc(exchange.write_spc([(x, y)]), "n")
    assert (b.x == x).all() and b.y == pytest.approx(y, rel=1e-6, abs=1e-30)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600))
def test_any_bytes_are_read_or_refused(raw):
    try:
        found = reader.parse_file("f.csv", raw)
    except text.FormatError:
        return
    assert all(len(f.x) == len(f.y) >= 2 and np.isfinite(f.y).all() for f in found)


def test_large_tables_are_read_quickly():
    x, y = np.linspace(200, 600, 1821), np.random.default_rng(0).random((120, 1821))
    content = "Wavelength," + ",".join(f"S{i}" for i in range(120)) + "\n" + "\n".join(f"{a:.2f}," + ",".join(f"{v:.6f}" for v in col) for a, col in zip(x, y.T))
    began = time.perf_counter()
    found = reader.parse_file("large.csv", content.encode())
    assert len(found) == 120 and time.perf_counter() - began < 15
