"""Calibration methods: fit on spectra with known concentrations, apply to spectra of samples.

Spectra are rows (id, x, y, concentrations map<string,double>). Signals are columns (fused where
the pipeline is linear), lines are aggregates; what reaches the driver are a method's few
coefficients, which the prediction carries as literals. A fitted method has ``definition()``, a
JSON document from which ``load()`` makes the same method again.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from lambertlake.functions.kernels import SpectrumError
from lambertlake.operators import stats
from lambertlake.plans import pipeline as pl
from lambertlake.plans.ops import OPERATIONS

Reference = tuple[np.ndarray, np.ndarray]


def concentration(compound: str) -> Column:
    return F.try_element_at("concentrations", F.lit(compound))


def required(df: DataFrame, compounds: list[str]) -> DataFrame:
    """``df`` with columns c_<compound>; a compound that a row doesn't list is an error, 0 must be said."""
    for c in compounds:
        value = F.when(concentration(c).isNull(), F.raise_error(F.concat(F.lit(f"no concentration of {c} in "), F.col("id").cast("string")))).otherwise(concentration(c))
        df = df.withColumn(f"c_{c}", value)
    return df


def pure_standards(df: DataFrame, compound: str | None = None) -> DataFrame:
    """Rows in which exactly one compound, or the given one alone, is other than zero."""
    present = F.map_filter("concentrations", lambda _, v: v != 0)
    out = df.where(F.size(present) == 1)
    return out if compound is None else out.where(F.array_contains(F.map_keys(present), compound))


def mean_spectrum(df: DataFrame, per: Column | None = None) -> Reference:
    """Mean over rows of one grid, of y or y divided by ``per``; one row per point reaches the driver."""
    share = per if per is not None else F.lit(1.0)
    points = df.select(F.posexplode(F.arrays_zip("x", "y")).alias("i", "p"), share.alias("per"))
    rows = points.groupBy("i").agg(F.avg("p.x").alias("x"), F.avg(F.col("p.y") / F.col("per")).alias("y")).orderBy("i").collect()
    return np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])


def unit_spectrum(df: DataFrame, compound: str) -> Reference:
    """Absorbance per concentration of the pure standards, by least squares through zero at each point."""
    rows = required(pure_standards(df, compound), [compound]).select(F.posexplode(F.arrays_zip("x", "y")).alias("i", "p"), F.col(f"c_{compound}").alias("c"))
    out = rows.groupBy("i").agg(F.avg("p.x").alias("x"), (F.sum(F.col("c") * F.col("p.y")) / F.sum(F.col("c") * F.col("c"))).alias("y")).orderBy("i").collect()
    if not out:
        raise SpectrumError(f"no pure standard of {compound}")
    return np.array([r["x"] for r in out]), np.array([r["y"] for r in out])


@dataclass
class Line:
    slope: float
    intercept: float
    stats: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, x: str, y: str, through_origin: bool = False) -> Line:
        row = stats.linear_regression(df, x, y, through_origin=through_origin).collect()[0].asDict()
        return cls(row["slope"], row["intercept"], row)

    def x(self, signal: Column) -> Column:
        return (signal - self.intercept) / self.slope

    def ci(self, signal: Column, replicates: int = 1) -> Column:
        s = self.stats
        spread = 1 / replicates + 1 / s["n"] + F.pow(signal - s["y_mean"], F.lit(2.0)) / (self.slope**2 * s["sxx"])
        return F.lit(s["t"] * s["s_yx"] / abs(self.slope)) * F.sqrt(spread)


@dataclass
class Univariate:
    """Pipeline, measurement and a line; ``direct``: the signal is the concentration itself."""

    compound: str
    steps: list[dict]
    measurement: dict
    direct: bool = False
    through_origin: bool = False
    line: Line | None = None
    type: str = "univariate"

    def signal(self, df: DataFrame, library: pl.Library, out: str = "signal") -> DataFrame:
        return pl.signals(df, self.steps, self.measurement, library, out)

    def fit(self, df: DataFrame, library: pl.Library | None = None) -> Univariate:
        if not self.direct:
            rows = required(self.signal(df, library or pl.Library({})), [self.compound])
            self.line = Line.fit(rows, f"c_{self.compound}", "signal", self.through_origin)
        return self

    def predict(self, df: DataFrame, library: pl.Library | None = None) -> DataFrame:
        rows = self.signal(df, library or pl.Library({}))
        found = F.col("signal") if self.direct else self.line.x(F.col("signal"))
        return rows.withColumn(f"found_{self.compound}", found)

    def definition(self) -> dict:
        return asdict(self)


def _solved(matrix: np.ndarray, columns: list[Column]) -> list[Column]:
    """matrix . columns"""
    return [sum((c * float(w) for w, c in zip(row[1:], columns[1:])), columns[0] * float(row[0])) for row in matrix]


@dataclass
class SignalEquations:
    """Several signals, linear in several compounds (Vierordt, bivariate, areas): R = K'C (+ b)."""

    compounds: list[str]
    signals: list[dict]  # {"steps": [...], "measurement": {...}}
    intercept: bool = False
    k: list[list[float]] | None = None  # one row per compound (and one of intercepts)
    condition: float | None = None
    type: str = "equations"

    def _signals(self, df: DataFrame, library: pl.Library) -> DataFrame:
        for i, s in enumerate(self.signals):
            # The factor of a weighted difference is taken from the unprocessed reference here.
            df = pl.signals(df, s.get("steps", []), s["measurement"], library, f"r{i}", raw=True)
        return df

    def fit(self, df: DataFrame, library: pl.Library | None = None) -> SignalEquations:
        if len(self.signals) < len(self.compounds):
            raise SpectrumError("at least as many signals as compounds are needed")
        rows = required(self._signals(df, library or pl.Library({})), self.compounds)
        given = [F.col(f"c_{c}") for c in self.compounds] + ([F.lit(1.0)] if self.intercept else [])
        read = [F.col(f"r{i}") for i in range(len(self.signals))]
        n, m = len(given), len(read)
        sums = rows.agg(*(F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(given) for j, b in enumerate(given)), *(F.sum(a * b).alias(f"h{i}_{j}") for i, a in enumerate(given) for j, b in enumerate(read))).first()
        gram = np.array([[sums[f"g{i}_{j}"] for j in range(n)] for i in range(n)], float)
        cross = np.array([[sums[f"h{i}_{j}"] for j in range(m)] for i in range(n)], float)
        if np.linalg.matrix_rank(gram) < n:
            raise SpectrumError("the calibration set doesn't tell the compounds apart")
        found = np.linalg.solve(gram, cross)
        self.k, self.condition = found.tolist(), float(np.linalg.cond(found[: len(self.compounds)]))
        return self

    def predict(self, df: DataFrame, library: pl.Library | None = None) -> DataFrame:
        rows = self._signals(df, library or pl.Library({}))
        matrix = np.array(self.k)
        base = matrix[-1] if self.intercept else np.zeros(matrix.shape[1])
        inverse = np.linalg.pinv(matrix[: len(self.compounds)].T)
        read = [F.col(f"r{i}") - float(base[i]) for i in range(len(self.signals))]
        for c, found in zip(self.compounds, _solved(inverse, read)):
            rows = rows.withColumn(f"found_{c}", found)
        return rows.drop(*(f"r{i}" for i in range(len(self.signals))))

    def definition(self) -> dict:
        return asdict(self)


# Special methods for two compounds

def _at(df: DataFrame, wavelength: float, out: str, steps: list[dict] = (), library: pl.Library | None = None) -> DataFrame:
    return pl.signals(df, list(steps), {"kind": "amplitude", "params": {"w1": wavelength}}, library, out)


def q_analysis(qx: float, qy: float, ax_iso: float) -> "callable":
    """(C_X, C_Y) of absorbances at an isoabsorptive point and another: ax_iso is the common absorptivity."""

    def found(a_iso: Column, a_other: Column) -> tuple[Column, Column]:
        share = (a_other / a_iso - qy) / (qx - qy)
        total = a_iso / ax_iso
        return share * total, (1 - share) * total

    return found


@dataclass
class AbsorbanceSubtraction:
    """Y absorbs alone at w2; X and Y absorb alike at ``iso``. X by difference, the total from the line at iso."""

    x: str
    y: str
    iso: float
    w2: float
    factor: float | None = None
    line: Line | None = None

    def fit(self, y_standards: DataFrame, standards: DataFrame) -> AbsorbanceSubtraction:
        rows = _at(_at(y_standards, self.iso, "a"), self.w2, "b")
        self.factor = rows.agg(F.avg(F.col("a") / F.col("b")).alias("f")).first()["f"]
        total = _at(required(standards, [self.x, self.y]), self.iso, "a").withColumn("c", F.col(f"c_{self.x}") + F.col(f"c_{self.y}"))
        self.line = Line.fit(total, "c", "a")
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        rows = _at(_at(df, self.iso, "_a"), self.w2, "_b")
        y = self.line.x(F.col("_b") * self.factor)
        total = self.line.x(F.col("_a"))
        return rows.withColumn(f"found_{self.x}", total - y).withColumn(f"found_{self.y}", y).drop("_a", "_b")


@dataclass
class AdvancedAbsorbanceSubtraction:
    """X from the difference of two wavelengths at which Y absorbs alike; Y from what X leaves at one of them."""

    x: str
    y: str
    w1: float
    w2: float
    delta: Line | None = None
    factor: float | None = None
    rest: Line | None = None

    def fit(self, x_standards: DataFrame, y_standards: DataFrame) -> AdvancedAbsorbanceSubtraction:
        rows = _at(_at(required(x_standards, [self.x]), self.w1, "a"), self.w2, "b").withColumn("d", F.col("a") - F.col("b"))
        self.delta = Line.fit(rows, f"c_{self.x}", "d")
        self.factor = rows.agg(F.avg(F.col("a") / F.col("d")).alias("f")).first()["f"]
        self.rest = Line.fit(_at(required(y_standards, [self.y]), self.w1, "a"), f"c_{self.y}", "a")
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        rows = _at(_at(df, self.w1, "_a"), self.w2, "_b")
        d = F.col("_a") - F.col("_b")
        return rows.withColumn(f"found_{self.x}", self.delta.x(d)).withColumn(f"found_{self.y}", self.rest.x(F.col("_a") - d * self.factor)).drop("_a", "_b")


@dataclass
class AmplitudeModulation:
    """Ratio to a divisor of known concentration of Y: the plateau gives Y, the iso point the total."""

    x: str
    y: str
    divisor: Reference
    divisor_concentration: float
    iso: float
    plateau: tuple[float, float]
    line: Line | None = None

    def _ratio(self, df: DataFrame) -> DataFrame:
        steps = [{"op": "divide", "params": {"reference": self.divisor, "threshold": 0}}]
        rows = _at(df, self.iso, "_p", steps)
        return pl.signals(rows, steps, {"kind": "mean", "params": {"w1": self.plateau[0], "w2": self.plateau[1]}}, None, "_k")

    def fit(self, standards: DataFrame) -> AmplitudeModulation:
        rows = self._ratio(required(standards, [self.x, self.y])).withColumn("c", F.col(f"c_{self.x}") + F.col(f"c_{self.y}"))
        self.line = Line.fit(rows, "c", "_p")
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        rows = self._ratio(df).withColumn(f"found_{self.y}", F.col("_k") * self.divisor_concentration)
        return rows.withColumn(f"found_{self.x}", self.line.x(F.col("_p")) - F.col(f"found_{self.y}")).drop("_p", "_k")


@dataclass
class InducedAmplitudeModulation:
    """Ratio to the unit spectrum of Y: plateau C_Y; elsewhere X reads r times its concentration more."""

    x: str
    y: str
    w: float
    plateau: tuple[float, float]
    divisor: Reference | None = None
    r: float | None = None

    def fit(self, x_standards: DataFrame, y_standards: DataFrame) -> InducedAmplitudeModulation:
        rows = required(y_standards, [self.y])
        self.divisor = mean_spectrum(rows, F.col(f"c_{self.y}"))
        got = _at(required(x_standards, [self.x]), self.w, "_p", self._steps())
        self.r = got.agg(F.avg(F.col("_p") / F.col(f"c_{self.x}")).alias("r")).first()["r"]
        return self

    def _steps(self) -> list[dict]:
        return [{"op": "divide", "params": {"reference": self.divisor}}]

    def predict(self, df: DataFrame) -> DataFrame:
        rows = _at(df, self.w, "_p", self._steps())
        rows = pl.signals(rows, self._steps(), {"kind": "mean", "params": {"w1": self.plateau[0], "w2": self.plateau[1]}}, None, f"found_{self.y}")
        return rows.withColumn(f"found_{self.x}", (F.col("_p") - F.col(f"found_{self.y}")) / self.r).drop("_p")


def addition_intersection(df: DataFrame, added: str, first: str, second: str) -> dict:
    """Two signals against added amounts: the lines cross at minus the amount of X, at the signal of the rest."""
    a = stats.linear_regression(df, added, first).first()
    b = stats.linear_regression(df, added, second).first()
    if abs(a["slope"] - b["slope"]) < 1e-12 * max(abs(a["slope"]), abs(b["slope"])):
        raise SpectrumError("the two lines are parallel")
    at = (b["intercept"] - a["intercept"]) / (a["slope"] - b["slope"])
    return {"found": -at, "signal": a["intercept"] + a["slope"] * at}


@dataclass
class AmplitudeCentering:
    """Ratio spectra over a divisor: its compound by a plateau, others by amplitude differences in which what is already known cancels.

    ``parts`` are, in order: {"compound", "kind": "plateau" with w1, w2} or {"compound", "kind":
    "difference" with w1, w2 and optional "against": compound whose amplitudes at the two
    wavelengths fix the factor} or {"compound", "kind": "rest", "w"}: what is left of the
    amplitude at w.
    """

    divisor_compound: str
    divisor: Reference
    parts: list[dict]
    steps: list[dict] = field(default_factory=list)
    lines: dict[str, Line] = field(default_factory=dict)
    factors: dict[str, float] = field(default_factory=dict)
    type: str = "amplitude_centering"

    def __post_init__(self) -> None:
        named = [p["compound"] for p in self.parts]
        if len(set(named)) != len(named):
            raise SpectrumError("a compound is determined twice")

    def _pre(self) -> list[dict]:
        divisor = self.divisor
        if self.steps:
            from lambertlake.plans.ops import Batch, apply_pipeline

            done = apply_pipeline(Batch(divisor[0], divisor[1][None]), self.steps, pl.Library({}))
            divisor = (done.x, done.y[0])
        return [*self.steps, {"op": "divide", "params": {"reference": divisor}}]

    def _signal(self, df: DataFrame, part: dict, out: str) -> DataFrame:
        kind = part["kind"]
        if kind == "plateau":
            m = {"kind": "mean", "params": {"w1": part["w1"], "w2": part["w2"]}}
        elif kind == "difference":
            m = {"kind": "weighted_difference", "params": {"w1": part["w1"], "w2": part["w2"], "factor": self.factors.get(part["compound"], 1.0)}}
        else:
            m = {"kind": "amplitude", "params": {"w1": part["w"]}}
        return pl.signals(df, self._pre(), m, None, out)

    def fit(self, df: DataFrame) -> AmplitudeCentering:
        for part in self.parts:
            own = pure_standards(df, part["compound"])
            if own.count() < 3:
                raise SpectrumError(f"three pure standards of {part['compound']} are needed")
            if part["kind"] == "difference" and part.get("against"):
                other = _at(_at(pure_standards(df, part["against"]), part["w1"], "_a", self._pre()), part["w2"], "_b", self._pre())
                self.factors[part["compound"]] = other.agg(F.avg(F.col("_a") / F.col("_b")).alias("f")).first()["f"]
            rows = self._signal(required(own, [part["compound"]]), part, "_s")
            self.lines[part["compound"]] = Line.fit(rows, f"c_{part['compound']}", "_s")
            if part["kind"] == "rest":
                # What the compounds before it add to the amplitude at w, per unit of concentration.
                for before in self.parts[: self.parts.index(part)]:
                    c = before["compound"]
                    got = _at(required(pure_standards(df, c), [c]), part["w"], "_s", self._pre())
                    self.factors[f"{part['compound']}|{c}"] = stats.linear_regression(got, f"c_{c}", "_s", through_origin=True).first()["slope"]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        for i, part in enumerate(self.parts):
            c = part["compound"]
            df = self._signal(df, part, f"_s{i}")
            signal = F.col(f"_s{i}")
            if part["kind"] == "rest":
                for before in self.parts[:i]:
                    signal = signal - F.col(f"found_{before['compound']}") * self.factors[f"{c}|{before['compound']}"]
            df = df.withColumn(f"found_{c}", self.lines[c].x(signal)).drop(f"_s{i}")
        return df

    def definition(self) -> dict:
        d = asdict(self)
        d["divisor"] = [v.tolist() for v in self.divisor]
        return d


@dataclass
class AbsorptionFactor:
    """Compounds one after the other: each is read where the later ones don't absorb, less what the earlier ones add."""

    order: list[dict]  # {"compound", "w"}
    units: dict[str, list[float]] = field(default_factory=dict)  # absorptivity of a compound at every w
    lines: dict[str, Line] = field(default_factory=dict)
    type: str = "absorption_factor"

    def fit(self, df: DataFrame) -> AbsorptionFactor:
        for i, o in enumerate(self.order):
            c = o["compound"]
            own = required(pure_standards(df, c), [c])
            if own.count() < 3:
                raise SpectrumError(f"three pure standards of {c} are needed")
            for j, p in enumerate(self.order):
                own = _at(own, p["w"], f"_a{j}")
            # Factors relative to the compound's own wavelength.
            row = own.agg(*(F.avg(F.col(f"_a{j}") / F.col(f"_a{i}")).alias(f"f{j}") for j in range(len(self.order)))).first()
            self.units[c] = [row[f"f{j}"] for j in range(len(self.order))]
            self.lines[c] = Line.fit(own, f"c_{c}", f"_a{i}")
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        for j, p in enumerate(self.order):
            df = _at(df, p["w"], f"_a{j}")
        for i, o in enumerate(self.order):
            rest = F.col(f"_a{i}")
            for j in range(i):
                rest = rest - F.col(f"_r{j}") * self.units[self.order[j]["compound"]][i]
            df = df.withColumn(f"_r{i}", rest)
        for i, o in enumerate(self.order):
            df = df.withColumn(f"found_{o['compound']}", self.lines[o["compound"]].x(F.col(f"_r{i}")))
        return df.drop(*(f"{c}{i}" for c in ("_a", "_r") for i in range(len(self.order))))

    def definition(self) -> dict:
        return asdict(self)


def _line(d: dict | None) -> Line | None:
    return None if d is None else Line(**d)


def load(d: dict):
    """The fitted method of a definition."""
    d = dict(d)
    kind = d.get("type")
    if kind == "univariate":
        return Univariate(**(d | {"line": _line(d["line"])}))
    if kind == "equations":
        return SignalEquations(**d)
    if kind == "amplitude_centering":
        return AmplitudeCentering(**(d | {"divisor": tuple(np.array(v) for v in d["divisor"]), "lines": {c: _line(v) for c, v in d["lines"].items()}}))
    if kind == "absorption_factor":
        return AbsorptionFactor(**(d | {"lines": {c: _line(v) for c, v in d["lines"].items()}}))
    if kind == "spectral":
        from lambertlake.operators.chemometrics import SpectralModel

        return SpectralModel.load(d)
    raise SpectrumError(f"unknown type of method {kind}")


def is_calibrated(d: dict) -> bool:
    kind = d.get("type")
    return {"univariate": bool(d.get("direct") or d.get("line")), "equations": bool(d.get("k")), "spectral": bool(d.get("frozen"))}.get(kind, bool(d.get("lines")))


ZERO, DERIVATIVE, AMPLITUDE, RATIO_DERIVATIVE, RESOLUTION = "zero_order", "derivative", "ratio_amplitude", "ratio_derivative", "resolution"

# The ready-made methods by the names that users look them up by, with the wavelengths
# they begin with. A step is an operation, the parameters whose defaults it shows, and those it sets.
_D1 = ("derivative", "order delta_lambda", {})
_D2 = ("derivative", "delta_lambda", {"order": 2})
_D1_TEN = ("derivative", "order delta_lambda", {"scaling": 10.0})
_RATIO = ("divide", "", {})
_BY_D1 = {"divisor_derivative": 1}
READY = (
    ("Direct (zero order, λmax)", ZERO, (), "amplitude", {"w1": 260.0}),
    ("Zero-crossing derivative (D1)", DERIVATIVE, (_D1,), "amplitude", {"w1": 260.0}),
    ("Zero-crossing derivative (D2)", DERIVATIVE, (_D2,), "amplitude", {"w1": 260.0}),
    ("Derivative peak-to-peak", DERIVATIVE, (_D1,), "peak_to_peak", {"w1": 240.0, "w2": 300.0}),
    ("Dual wavelength", ZERO, (), "difference", {"w1": 250.0, "w2": 280.0}),
    ("Induced dual wavelength", ZERO, (), "weighted_difference", {"w1": 250.0, "w2": 280.0}),
    ("Dual wavelength in derivative mode", DERIVATIVE, (_D1,), "difference", {"w1": 250.0, "w2": 280.0}),
    ("Area under curve (single component)", ZERO, (), "area", {"w1": 240.0, "w2": 280.0, "baseline": "zero"}),
    ("Derivative ratio (DD1)", RATIO_DERIVATIVE, (_RATIO, _D1), "amplitude", {"w1": 260.0}),
    ("Ratio difference (RD)", AMPLITUDE, (_RATIO,), "difference", {"w1": 250.0, "w2": 280.0}),
    ("Mean centering of ratio spectra (MCR)", RATIO_DERIVATIVE, (_RATIO, ("mean_center", "", {"start": 220.0, "end": 300.0})), "amplitude", {"w1": 260.0}),
    ("Successive derivative ratio (ternary)", RATIO_DERIVATIVE, (_RATIO, _D1, _RATIO, _D1), "amplitude", {"w1": 260.0}),
    ("Double divisor ratio derivative (ternary)", RATIO_DERIVATIVE, (("divide_sum", "", {}), _D1), "amplitude", {"w1": 260.0}),
    ("Dual amplitude difference (ternary)", AMPLITUDE, (_RATIO,), "weighted_difference", {"w1": 240.0, "w2": 260.0}),
    ("Extended ratio subtraction (Y)", RESOLUTION, (("extended_ratio_subtraction", "", {"start": 300.0, "end": 320.0}),), "amplitude", {"w1": 275.0}),
    (
        "Successive spectrum subtraction (ternary)", RESOLUTION,
        (("spectrum_subtraction", "derivative_order", {"wavelength": 340.0}), ("ratio_subtraction", "", {"start": 290.0, "end": 310.0})), "amplitude", {"w1": 245.0},
    ),
    ("Ratio subtraction / spectrum subtraction (X)", RESOLUTION, (("ratio_subtraction", "", {"start": 300.0, "end": 320.0}),), "amplitude", {"w1": 260.0}),
    ("Constant multiplication / SS-CM (extended Y)", RESOLUTION, (("constant_multiplication", "", {"start": 300.0, "end": 320.0}),), "amplitude", {"w1": 260.0}),
    ("Ratio plateau / constant value (Y)", AMPLITUDE, (_RATIO,), "mean", {"w1": 300.0, "w2": 320.0}),
    ("Spectrum subtraction", RESOLUTION, (("spectrum_subtraction", "wavelength derivative_order", {}),), "amplitude", {"w1": 260.0}),
    ("Factorized zero-order (FZM)", RESOLUTION, (("factorized_recovery", "delta_lambda", {"wavelength": 260.0, "derivative_order": 1}),), "amplitude", {"w1": 260.0}),
    ("Constant center", RESOLUTION, (("constant_center", "w1 w2 target", {}),), "amplitude", {"w1": 260.0}),
    (
        "Derivative subtraction (DS, X in D1)", RESOLUTION,
        (_D1_TEN, ("ratio_subtraction", "divisor_delta_lambda", {"start": 300.0, "end": 320.0, **_BY_D1})), "amplitude", {"w1": 245.0},
    ),
    (
        "Derivative subtraction–constant multiplication (DS-CM, Y in D1)", RESOLUTION,
        (_D1_TEN, ("constant_multiplication", "divisor_delta_lambda", {"start": 300.0, "end": 320.0, **_BY_D1})), "amplitude", {"w1": 320.0},
    ),
    ("Derivative ratio of D1 spectra (D1 DR)", RATIO_DERIVATIVE, (_D1_TEN, ("divide", "divisor_delta_lambda", _BY_D1), _D1_TEN), "amplitude", {"w1": 270.0}),
    (
        "Successive ratio subtraction (ternary SRS, Z)", RESOLUTION,
        (("ratio_subtraction", "", {"start": 315.0, "end": 365.0}), ("ratio_subtraction", "", {"start": 275.0, "end": 305.0})), "amplitude", {"w1": 240.0},
    ),
    (
        "Mean centering of ratio spectra (ternary)", RATIO_DERIVATIVE,
        (_RATIO, *((op, "", {"start": 215.0, "end": 275.0}) for op in ("mean_center", "divide_centered_ratio", "mean_center"))), "amplitude", {"w1": 250.0},
    ),
    (
        "Derivative transformation (DT, recover zero order)", RESOLUTION,
        (("factorized_recovery", "delta_lambda", {"wavelength": 306.0, "wavelength_end": 313.0, "derivative_order": 1}),), "amplitude", {"w1": 294.0},
    ),
    ("Concentration value (unit divisor plateau, no regression)", AMPLITUDE, (_RATIO,), "mean", {"w1": 330.0, "w2": 333.0}),
)
#: Methods that read concentrations off without a regression.
DIRECT = {"Concentration value (unit divisor plateau, no regression)"}


def _begun(op: str, shown: str, given: dict) -> dict:
    """A step whose shown parameters have the operation's defaults."""
    defaults = {p.name: p.default for p in OPERATIONS[op].params}
    return {"op": op, "params": {n: defaults[n] for n in shown.split()} | given}


#: Ready-made univariate methods; references are left for the user to choose.
TEMPLATES = {
    name: {"family": family, "steps": [_begun(*s) for s in steps], "measurement": {"kind": kind, "params": dict(given)}, "direct": name in DIRECT}
    for name, family, steps, kind, given in READY
}


def templates_by_family() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, t in TEMPLATES.items():
        out.setdefault(t["family"], []).append(name)
    return out


def numeric_parameters(method: Univariate) -> list[tuple[str, Any, float]]:
    """(place, value, change) of what a robustness study varies; orders of derivatives stay."""
    out = []
    for i, s in enumerate(method.steps):
        out += [(f"steps.{i}.{n}", v) for n, v in s["params"].items()]
    out += [(f"measurement.{n}", v) for n, v in method.measurement["params"].items()]
    change = lambda n, v: 1.0 if isinstance(v, int) or n.rsplit(".", 1)[1] in ("w1", "w2", "start", "end", "wavelength", "wavelength_end") else abs(v) * 0.05
    return [(n, v, change(n, v)) for n, v in out if isinstance(v, (int, float)) and not isinstance(v, bool) and not n.endswith(("order", "divisor_derivative", "reference", "divisor", "reference2"))]


def robustness(method: Univariate, calibration: DataFrame, samples: DataFrame, library: pl.Library) -> list[dict]:
    """Deviation of the mean result, in per cent, when each parameter is moved down and up and the method recalibrated."""
    import copy

    def mean(m: Univariate) -> float:
        return m.fit(calibration, library).predict(samples, library).agg(F.avg(f"found_{m.compound}").alias("m")).first()["m"]

    base = mean(copy.deepcopy(method))
    out = []
    for place, value, change in numeric_parameters(method):
        for sign in (-1, 1):
            m = copy.deepcopy(method)
            target, *path = place.split(".")
            holder = m.steps[int(path[0])]["params"] if target == "steps" else m.measurement["params"]
            holder[path[-1]] = type(value)(value + sign * change)
            try:
                out.append({"parameter": place, "value": holder[path[-1]], "deviation": 100 * (mean(m) - base) / base})
            except SpectrumError as error:
                out.append({"parameter": place, "value": holder[path[-1]], "error": str(error)})
    return out


def determine(method, df: DataFrame, library: pl.Library | None = None) -> DataFrame:
    """id and found_<compound> of any fitted method."""
    takes = isinstance(method, (Univariate, SignalEquations))
    out = method.predict(df, library) if takes else method.predict(df)
    return out.select("id", *(c for c in out.columns if c.startswith("found_")))


