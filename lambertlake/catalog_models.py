"""Registered queries without SQL: multivariate models, method search, plans by templates.

Calibration sets here are 25-run designs of three known compounds with seeded noise; the models
are applied to spectra made on the executors from rows of ``part``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lambertlake.operators import chemometrics as ch
from lambertlake.operators import gram
from lambertlake.operators import methods as m
from lambertlake.operators import optimizer as op
from lambertlake.operators.series import design_cycle
from lambertlake.plans import pipeline as pl

GRID = np.arange(200, 401, 2.0)


def _band(centre: float, width: float) -> np.ndarray:
    return np.exp(-(((GRID - centre) / width) ** 2) / 2)


#: Absorbance per µg/mL of three invented compounds.
UNITS = {
    "X": 0.040 * _band(245, 12) + 0.015 * _band(270, 8),
    "Y": 0.030 * _band(275, 22) + 0.020 * _band(330, 18),
    "Z": 0.035 * _band(260, 10) + 0.010 * _band(225, 8),
}
PURE = np.stack(list(UNITS.values()))


def training(seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    cycle = np.array(design_cycle())
    levels = np.vstack([np.zeros(3), *(np.roll(cycle, -i)[:3] for i in range(24))])
    c = 10 + 4 * levels
    return c, c @ PURE + np.random.default_rng(seed).normal(0, 5e-4, (25, len(GRID)))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures whose amounts follow from part sizes and prices, without noise."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    amounts = [(4 + F.col("p_size") % 13).cast("double"), (5 + F.col("p_partkey") % 11).cast("double"), (6 + F.col("p_retailprice") % 9).cast("double")]
    x = F.array(*(F.lit(float(v)) for v in GRID))
    y = F.array(*(sum(a * float(u[i]) for a, u in zip(amounts, UNITS.values())) for i in range(len(GRID))))
    return part.select(F.col("p_partkey").alias("id"), x.alias("x"), y.alias("y"), F.create_map(*[v for n, a in zip(UNITS, amounts) for v in (F.lit(n), a)]).alias("concentrations"))


def _model(kind: str, **options):
    def run(spark, sf_dir):
        c, a = training()
        wavelengths = [226.0, 246, 260, 276, 330] if kind == "ils" else None
        model = ch.SpectralModel(list(UNITS), kind, 3, wavelengths=wavelengths, options=options).fit_matrix(GRID, a, c)
        got = model.predict(samples(spark, sf_dir), diagnose=True)
        return got.select("id", *(F.round(f"found_{n}", 6).alias(f"found_{n}") for n in UNITS), F.round("t2", 6).alias("t2"), "outside")

    return run


def _vectors(spark: SparkSession, sf_dir: str) -> list[gram.Moments]:
    """Gram matrices by fold of the vectors, whose label and last point take the part of concentrations."""
    points = F.transform("embedding", lambda v: v.cast("double"))
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), points.alias("y"), F.col("label").cast("double").alias("A"))
    x = F.array(*(F.lit(float(i)) for i in range(63)))
    df = df.select("id", x.alias("x"), F.slice("y", 1, 63).alias("y"), F.create_map(F.lit("A"), F.col("A"), F.lit("B"), F.element_at("y", 64)).alias("concentrations"))
    return gram.gram(df, ["A", "B"], 5, F.col("id") % 5)


def cross_validation(spark, sf_dir):
    got = gram.cross_validate(ch.SpectralModel(["A", "B"], "pls2", 3), _vectors(spark, sf_dir), most=8)
    return spark.createDataFrame(pd.DataFrame({"n_components": list(got["press"]), "press": list(got["press"].values())}).assign(chosen=got["chosen"]))


def interval_selection(spark, sf_dir):
    return spark.createDataFrame(pd.DataFrame(gram.intervals(ch.SpectralModel(["A", "B"], "pls2", 3), _vectors(spark, sf_dir), 8)))


def genetic_selection(spark, sf_dir):
    got = gram.genetic(ch.SpectralModel(["A", "B"], "pls2", 3), _vectors(spark, sf_dir))
    return spark.createDataFrame([(lo, hi, got["rmsecv"]) for lo, hi in got["ranges"]], "start double, stop double, rmsecv double")


def method_search(spark, sf_dir):
    """Best readings of every family for a mixture of two of the compounds."""
    units = {n: UNITS[n] for n in ("X", "Y")}
    mix = op.Mixture(GRID, units, np.full(len(GRID), 2e-4), 1e-4, [{"X": 6.0, "Y": 10.0}, {"X": 10.0, "Y": 6.0}, {"X": 14.0, "Y": 14.0}], pair_step=4.0)
    got = op.best(op.screen(spark, mix))
    return got.select("compound", "family", "steps", "measurement", F.round("robust", 6).alias("robust"))


def signal_equations(spark, sf_dir):
    c, a = training()
    rows = [(i, GRID.tolist(), y.tolist(), dict(zip(UNITS, map(float, v)))) for i, (v, y) in enumerate(zip(c, a))]
    standards = spark.createDataFrame(rows, "id int, x array<double>, y array<double>, concentrations map<string,double>")
    signals = [{"measurement": {"kind": "amplitude", "params": {"w1": w}}} for w in (246.0, 260.0, 276.0, 330.0)]
    got = m.SignalEquations(list(UNITS), signals).fit(standards).predict(samples(spark, sf_dir))
    return got.select("id", *(F.round(f"found_{n}", 4).alias(f"found_{n}") for n in UNITS))


def templates(spark, sf_dir):
    """Every ready-made method that needs no reference, read on all samples at once."""
    df = samples(spark, sf_dir).select("id", "x", "y")
    kept = []
    for i, (_, t) in enumerate(m.TEMPLATES.items()):
        needs = any(p.kind == "spectrum" for s in t["steps"] for p in pl.OPERATIONS[s["op"]].params)
        if not needs and t["measurement"]["kind"] != "weighted_difference":
            df = pl.signals(df, t["steps"], t["measurement"], out=f"signal_{i}", grid=GRID)
            kept.append(f"signal_{i}")
    return df.select("id", *(F.round(c, 8).alias(c) for c in kept))


QUERIES = {
    **{f"model_{kind}": _model(kind) for kind in ("cls", "ils", "pcr", "pls1", "pls2", "mcr", "ann", "svr")},
    "model_cross_validation": cross_validation,
    "model_intervals": interval_selection,
    "model_genetic": genetic_selection,
    "method_search": method_search,
    "signal_equations": signal_equations,
    "templates": templates,
}
