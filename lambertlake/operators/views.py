"""How spectra are looked at: stacked, as differences, normalised, filtered as a tree; demonstration data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lambertlake.operators import series


def stacked(df: DataFrame, order: str = "id", share: float = 0.5) -> DataFrame:
    """Each spectrum raised by its place times half the median span."""
    span = F.array_max("y") - F.array_min("y")
    step = df.agg((F.lit(share) * F.percentile(span, F.lit(0.5))).alias("step"))
    placed = df.withColumn("_i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order)) - 1)  # a view shows some hundred spectra
    return placed.crossJoin(F.broadcast(step)).withColumn("y", F.transform("y", lambda v: v + F.col("_i") * F.col("step"))).drop("_i", "step")


def difference(df: DataFrame, order: str = "id") -> DataFrame:
    """Each spectrum less the first, on the range that both cover."""
    first = df.orderBy(order).limit(1).select(F.col("x").alias("fx"), F.col("y").alias("fy"))
    lo = lambda p: (p["x"] >= F.array_min("fx")) & (p["x"] <= F.array_max("fx"))
    both = df.crossJoin(F.broadcast(first)).withColumn("p", F.filter(F.arrays_zip("x", "y"), lo))
    less = F.transform("p", lambda p: p["y"] - series.value_at(F.col("fx"), F.col("fy"), p["x"]))
    return both.withColumn("y", less).withColumn("x", F.col("p.x")).drop("p", "fx", "fy")


def normalised(df: DataFrame) -> DataFrame:
    """Each spectrum over its largest absolute value; flat zero stays as it is."""
    top = F.array_max(F.transform("y", F.abs))
    return df.withColumn("y", F.when(top > 0, F.transform("y", lambda v: v / top)).otherwise(F.col("y")))


def figure_series(df: DataFrame) -> DataFrame:
    """Long rows (name, x, y) for plotting."""
    return df.select("name", F.explode(F.arrays_zip("x", "y")).alias("p")).select("name", "p.x", "p.y")


def decimated(df: DataFrame, pixels: int) -> DataFrame:
    """``df`` with x and y cut to what a line of ``pixels`` columns shows: of each column of points its first, lowest, highest and last.

    A column holds equally many points (the last may hold fewer), so that drawing the line through
    what is left covers the same pixels; spectra of four points a column or fewer stay as they are.
    """
    if pixels < 1:
        raise ValueError("one pixel at least")
    points = F.transform(F.arrays_zip("x", "y"), lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), i.alias("i")))
    each = F.ceil(F.size("y") / pixels).cast("int")
    bins = F.transform(F.sequence(F.lit(0), F.floor((F.size("y") - 1) / each).cast("int")), lambda b: F.slice("_points", b * each + 1, each))

    def drawn(own):
        by_y = F.transform(own, lambda p: F.struct(p["y"].alias("y"), p["i"].alias("i"), p["x"].alias("x")))
        # Of equal values the first: the lowest of (y, i), and the highest of (y, -i).
        high = F.array_max(F.transform(own, lambda p: F.struct(p["y"].alias("y"), (-p["i"]).alias("i"), p["x"].alias("x"))))
        low = F.array_min(by_y)
        four = F.array(F.struct(F.get(own, F.lit(0))["i"].alias("i"), F.get(own, F.lit(0))["x"].alias("x"), F.get(own, F.lit(0))["y"].alias("y")),
                       F.struct(low["i"].alias("i"), low["x"].alias("x"), low["y"].alias("y")),
                       F.struct((-high["i"]).alias("i"), high["x"].alias("x"), high["y"].alias("y")),
                       F.struct(F.element_at(own, -1)["i"].alias("i"), F.element_at(own, -1)["x"].alias("x"), F.element_at(own, -1)["y"].alias("y")))
        return F.array_sort(F.array_distinct(four))

    kept = df.withColumn("_points", F.when(F.size("y") > 4 * pixels, points))
    kept = kept.withColumn("_kept", F.when(F.col("_points").isNotNull(), F.flatten(F.transform(bins, drawn))))
    kept = kept.withColumn("x", F.coalesce(F.col("_kept.x"), F.col("x"))).withColumn("y", F.coalesce(F.col("_kept.y"), F.col("y")))
    return kept.drop("_points", "_kept")


def tree_filter(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """Nodes (node, label) whose label holds the text, and the ancestors of those.

    Where there are columns role, points (a number) and concentrations (a map), what they say counts too.
    """
    said = {"label": F.col("label"), "role": F.col("role"), "points": F.col("points").cast("string")}
    given = F.array_join(F.transform(F.map_entries("concentrations"), lambda e: F.concat_ws(" ", e["key"], F.format_string("%.6g", e["value"]), e["value"].cast("string"))), ", ")
    shown_as = [c for n, c in (said | {"concentrations": given}).items() if n in nodes.columns]
    hit = nodes.where(F.lower(F.concat_ws("\n", *shown_as)).contains(text.lower())).select("node")
    shown = series.ascend(edges, hit).select(F.col("ancestor").alias("node")).distinct()
    return nodes.join(shown, "node", "left_semi")


def demo_spectra(spark: SparkSession, amounts: list[dict[str, float]], units: dict[str, np.ndarray], grid: np.ndarray, seed: int = 1, noise: float = 3e-4, preparation: float = 0.004, jitter: float = 0.05, tilt: float = 5e-4) -> DataFrame:
    """Spectra as an instrument would give them: preparation error, shifted wavelengths, a sloping baseline, noise."""
    rng = np.random.default_rng(seed)
    rows = []
    for i, own in enumerate(amounts):
        real = {c: a * (1 + rng.normal(0, preparation)) for c, a in own.items()}
        pure = sum(a * units[c] for c, a in real.items())
        y = np.interp(grid, grid + rng.normal(0, jitter), pure) + tilt * rng.normal() * (grid - grid.mean()) / np.ptp(grid) + rng.normal(0, noise, len(grid))
        rows.append((i, " ".join(f"{c} {a:g}" for c, a in own.items() if a), grid.tolist(), y.tolist(), {c: float(a) for c, a in own.items()}))
    return spark.createDataFrame(rows, "id long, name string, x array<double>, y array<double>, concentrations map<string,double>")


def demo_project(spark: SparkSession, root: str):
    """A small project from beginning to end: standards, mixtures, a ratio difference method, a result."""
    import json

    from lambertlake import catalog_models as models
    from lambertlake.operators import methods as m
    from lambertlake.plans import pipeline as pl
    from lambertlake.storage import results
    from lambertlake.storage.project import Project

    units = {c: models.UNITS[c] for c in ("X", "Y")}
    project = Project.create(spark, root, "demonstration")
    for c in units:
        project.add_compound(c)
    divisor = project.add_spectrum("Y divisor", models.GRID, 10 * units["Y"], role="divisor", concentrations={"X": 0.0, "Y": 10.0})
    standards = demo_spectra(spark, [{"X": a, "Y": 0.0} for a in (4.0, 8.0, 12.0, 16.0, 20.0)], units, models.GRID)
    mixtures = demo_spectra(spark, [{"X": a, "Y": b} for a, b in ((6.0, 10.0), (10.0, 6.0), (14.0, 14.0))], units, models.GRID, seed=2)
    project.import_frame(standards, "standard")
    project.import_frame(mixtures, "mixture")
    ids = {r: [x["id"] for x in project.records().where(F.col("role") == r).select("id").collect()] for r in ("standard", "mixture")}
    method = m.Univariate("X", [{"op": "divide", "params": {"reference": divisor}}], {"kind": "difference", "params": {"w1": 240.0, "w2": 262.0}})
    method.fit(project.spectra(ids["standard"]), pl.Library.of(project.table("points"), method.steps))
    saved = project.save_method("ratio difference", json.loads(json.dumps(method.definition())) | {"calibration_ids": ids["standard"]})
    return project, results.determine(project, saved, ids["mixture"], "assay of X")
