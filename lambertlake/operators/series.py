"""Operators on ordered series: long rows (series, position, x, y) or packed arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lambertlake.functions import kernels as k
from lambertlake.functions.shared import checkpoint


def value_at(x: Column, y: Column, at: Column | float) -> Column:
    """Linear interpolation of packed arrays, null outside the range."""
    at = at if isinstance(at, Column) else F.lit(float(at))
    below = F.size(F.filter(x, lambda v: v <= at))
    i = F.least(F.greatest(below, F.lit(1)), F.size(x) - 1)
    x0, x1, y0, y1 = F.get(x, i - 1), F.get(x, i), F.get(y, i - 1), F.get(y, i)
    inside = (at >= F.get(x, F.lit(0)) - 1e-9) & (at <= F.get(x, F.size(x) - 1) + 1e-9)
    return F.when(inside, y0 + (y1 - y0) * (at - x0) / (x1 - x0))


def resampled(x: Column, y: Column, grid: Column) -> Column:
    """y at the points of ``grid``, each row by its own x and grid (both ascending); null outside x's range.

    Points of both are merged in order once, so a row takes time in proportion to their number
    times its logarithm, in generated code. Beyond 10^-9 of the ends there is no value.
    """
    kind = "array<struct<at:double,late:int,k:int>>"

    def merged(x: Column, grid: Column) -> Column:
        own = F.transform(x, lambda v, k: F.struct(v.cast("double").alias("at"), F.lit(0).alias("late"), (k + 1).alias("k")))
        asked = F.transform(grid, lambda v, k: F.struct(v.cast("double").alias("at"), F.lit(1).alias("late"), (k + 1).alias("k")))
        return F.array_sort(F.concat(own.cast(kind), asked.cast(kind)))

    def place(s: Column, p: Column) -> Column:
        """How many of x are not beyond each point of the grid, in order."""
        return F.struct(F.when(p["late"] == 0, p["k"]).otherwise(s["seen"]).alias("seen"), F.when(p["late"] == 1, F.array_append(s["below"], s["seen"])).otherwise(s["below"]).alias("below"))

    def value(x: Column, y: Column, at: Column, below: Column) -> Column:
        i = F.least(F.greatest(below, F.lit(1)), F.size(x) - 1)
        x0, x1, y0, y1 = F.get(x, i - 1), F.get(x, i), F.get(y, i - 1), F.get(y, i)
        inside = (at >= F.get(x, F.lit(0)) - 1e-9) & (at <= F.get(x, F.size(x) - 1) + 1e-9) & (F.size(x) > 1)
        return F.when(inside, y0 + (y1 - y0) * (at - x0) / (x1 - x0))

    # Bound once: inside a lambda an expression would be worked out for every point.
    let = lambda v, then: F.get(F.transform(F.array(v), then), F.lit(0))
    start = F.struct(F.lit(0).alias("seen"), F.array().cast("array<int>").alias("below"))
    below = lambda g: F.aggregate(merged(x, g), start, place)["below"]
    found = let(grid, lambda g: let(below(g), lambda b: let(x, lambda xs: let(y, lambda ys: F.zip_with(g, b, lambda at, k: value(xs, ys, at, k))))))
    return F.when(x.isNotNull() & y.isNotNull() & grid.isNotNull(), found)


def region(x: Column, y: Column, a: float, b: float) -> Column:
    """Points (x, y) of a closed range."""
    lo, hi = min(a, b) - 1e-9, max(a, b) + 1e-9
    return F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] >= lo) & (p["x"] <= hi))


def region_mean(x: Column, y: Column, a: float, b: float) -> Column:
    part = region(x, y, a, b)
    return F.aggregate(part, F.lit(0.0), lambda s, p: s + p["y"]) / F.when(F.size(part) > 0, F.size(part))


def area(x: Column, y: Column, a: float, b: float) -> Column:
    """Trapezoids between the points of a closed range."""
    part = region(x, y, a, b)
    pairs = F.zip_with(F.slice(part, F.lit(1), F.greatest(F.size(part) - 1, F.lit(0))), F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))), lambda p, q: (q["x"] - p["x"]) * (p["y"] + q["y"]) / 2)
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def zero_crossings(df: DataFrame, series: str, position: str, x: str, y: str) -> DataFrame:
    """series, root of every zero or change of sign; one window over each series."""
    w = W.partitionBy(series).orderBy(position)
    rows = df.select(series, F.col(x).alias("x"), F.col(y).alias("y"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    hit = rows.where(F.col("y1").isNotNull() & ((F.col("y") == 0) | (F.col("y") * F.col("y1") < 0)))
    return hit.select(series, F.when(F.col("y") == 0, F.col("x")).otherwise(F.col("x") - F.col("y") * (F.col("x1") - F.col("x")) / (F.col("y1") - F.col("y"))).alias("root"))


def equal_amplitude(df: DataFrame, series: str, position: str, x: str, y: str, level: DataFrame, apart: float) -> DataFrame:
    """Roots of y less each series' ``level`` (series, at, level) farther than ``apart`` from ``at``."""
    shifted = df.join(level, series).withColumn("_d", F.col(y) - F.col("level"))
    roots = zero_crossings(shifted, series, position, x, "_d").join(level, series)
    return roots.where(F.abs(F.col("root") - F.col("at")) > apart).select(series, "root")


def isoabsorptive(a: DataFrame, b: DataFrame, ca: float, cb: float) -> DataFrame:
    """Roots of a/ca - b/cb for two series with the same positions (position, x, y)."""
    both = a.alias("a").join(b.alias("b"), "position").select(F.lit(0).alias("series"), "position", F.col("a.x").alias("x"), (F.col("a.y") / ca - F.col("b.y") / cb).alias("y"))
    return zero_crossings(both, "series", "position", "x", "y").select("root")


def runs(df: DataFrame, series: str, position: str, flag: str) -> DataFrame:
    """series, start, stop, n of every unbroken run of positions with a true flag."""
    w = W.partitionBy(series).orderBy(position)
    rows = df.select(series, F.col(position).alias("p"), F.col(flag).alias("f"), F.row_number().over(w).alias("i"))
    on = rows.where("f").withColumn("g", F.col("i") - F.row_number().over(W.partitionBy(series).orderBy("p")))
    return on.groupBy(series, "g").agg(F.min("p").alias("start"), F.max("p").alias("stop"), F.count("*").alias("n")).drop("g")


def longest_runs(df: DataFrame, series: str, position: str, flag: str) -> DataFrame:
    """The longest run of each series, the first of equals."""
    best = F.max_by(F.struct("start", "stop", "n"), F.struct("n", -F.col("start"))).alias("r")
    return runs(df, series, position, flag).groupBy(series).agg(best).select(series, "r.*")


def moving_average(df: DataFrame, series: str, position: str, y: str, window: int, out: str = "smooth") -> DataFrame:
    w = W.partitionBy(series).orderBy(position).rowsBetween(-(window // 2), (window - 1) // 2)
    return df.withColumn(out, F.avg(y).over(w))


def resample(df: DataFrame, series: str, x: str, y: str, step: float) -> DataFrame:
    """Even grid from each series' first x, by the bracket of neighbouring rows; no point is compared with all."""
    w = W.partitionBy(series).orderBy(x)
    rows = df.select(series, F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0"), F.lead(x).over(w).cast("double").alias("x1"), F.lead(y).over(w).cast("double").alias("y1"), F.min(x).over(W.partitionBy(series)).cast("double").alias("first"))
    lo = F.ceil((F.col("x0") - F.col("first")) / step - 1e-9).cast("long")
    hi = F.when(F.col("x1").isNull(), lo).otherwise(F.ceil((F.col("x1") - F.col("first")) / step - 1e-9).cast("long") - 1)
    # The last point of a series belongs to the grid only if it lies on it.
    on_last = F.abs(F.col("first") + lo * step - F.col("x0")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("x0"))
    filled = rows.where(F.when(F.col("x1").isNull(), on_last).otherwise(hi >= lo)).withColumn("k", F.explode(F.sequence(lo, hi)))
    at = F.col("first") + F.col("k") * step
    return filled.select(series, at.alias("x"), F.coalesce(F.col("y0") + (F.col("y1") - F.col("y0")) * (at - F.col("x0")) / (F.col("x1") - F.col("x0")), F.col("y0")).alias("y"))


@udtf(returnType="start double, stop double, mean double")
class Plateaus:
    """Level stretches of packed x and y, from left to right."""

    def eval(self, x: list, y: list, tolerance: float, width: float):
        yield from k.plateaus(np.array(x, float), np.array(y, float), tolerance, width)


@udtf(returnType="x double, y double, kind string")
class Extrema:
    """Maxima and minima of packed x and y that stand out."""

    def eval(self, x: list, y: list, share: float):
        yield from k.extrema(np.array(x, float), np.array(y, float), share)


def register(spark) -> None:
    """Make the table functions known to SQL as ``plateaus`` and ``extrema``."""
    spark.udtf.register("plateaus", Plateaus)
    spark.udtf.register("extrema", Extrema)


# Joins and trees


def ascend(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, ancestor, depth (the least) along (child, parent) edges, however long the lines are; cycles end.

    Jumps are doubled from round to round, so a line of n nodes takes log2(n) rounds. Each
    round is written to the checkpoint folder.
    """
    edges = edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct()
    jumps = checkpoint(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")))
    found = checkpoint(start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).distinct())
    n, length = found.count(), 1
    while True:
        # Found are all ancestors less than length steps away; jumps are the pairs length steps apart, in a tree one for each node.
        far = found.join(jumps, found["ancestor"] == jumps["a"]).select("node", F.col("b").alias("ancestor"), (F.col("depth") + length).alias("depth"))
        found = checkpoint(found.unionByName(far).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        before, n = n, found.count()
        if n == before:
            return found
        other = jumps.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = checkpoint(jumps.join(other, "b").select("a", F.col("c").alias("b")).distinct())
        length *= 2


def descend(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, descendant, depth."""
    turned = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return ascend(turned, start).withColumnRenamed("ancestor", "descendant")


def brereton_design(spark, factors: int) -> DataFrame:
    """Coded five-level design of 25 rows for up to six factors, any two of them orthogonal; the centre first.

    The levels run through the non-zero elements of the field of 25 elements in order of
    powers: six log-steps apart, two columns meet each pair of levels once.
    """
    if not 1 <= factors <= 6:
        raise ValueError("between one and six factors")
    cycle = design_cycle()
    row = F.array(*map(F.lit, cycle))
    columns = [F.when(F.col("run") == 0, 0).otherwise(F.get(row, ((F.col("run") - 1 + j) % 24).cast("int"))).alias(f"f{j + 1}") for j in range(factors)]
    return spark.range(25).withColumnRenamed("id", "run").select("run", *columns)


def design_cycle() -> list[int]:
    """24 levels: the linear recurrence of a primitive polynomial over the integers mod 5, mapped to -2..2."""
    # x^2 = x + 3 has a root of order 24 mod 5.
    a, b, out = 1, 0, []
    for _ in range(24):
        out.append(a)
        a, b = b, (b + 3 * a) % 5
    levels = {0: 0, 1: -2, 2: -1, 3: 1, 4: 2}
    return [levels[v] for v in out]


def designs(df: DataFrame, centres: list[str], steps: list[str]) -> DataFrame:
    """The 25 runs of the design for each row of ``df``, with c1, c2, .. around its centres by its steps."""
    if not 1 <= len(centres) <= 6:
        raise ValueError("between one and six factors")
    row = F.array(*map(F.lit, design_cycle()))
    runs = df.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))))
    level = lambda j: F.when(F.col("run") == 0, 0).otherwise(F.get(row, ((F.col("run") - 1 + j) % 24).cast("int")))
    return runs.select("*", *(F.round(F.col(c) + level(j) * F.col(s), 6).alias(f"c{j + 1}") for j, (c, s) in enumerate(zip(centres, steps))))


def design_concentrations(design: DataFrame, centres: list[float], steps: list[float]) -> DataFrame:
    """Concentrations c1, c2, .. of a coded design."""
    return design.select("run", *(F.round(F.lit(c) + F.col(f"f{j + 1}") * s, 6).alias(f"c{j + 1}") for j, (c, s) in enumerate(zip(centres, steps))))


def concentrations_from_name(name: Column, compounds: list[str]) -> Column:
    """map of compound to the number behind its name; a decimal comma counts as a point.

    If no compound is named, the numbers of the name are taken in order, if there are enough.
    """
    number = r"([0-9]+(?:[.,][0-9]+)?)"
    found = [F.nullif(F.regexp_extract(name, rf"(?i)(?<![A-Za-z]){c}[ _=:-]*{number}", 1), F.lit("")) for c in compounds]
    numbers = F.regexp_extract_all(name, F.lit(number), F.lit(1))
    value = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double") if hasattr(Column, "try_cast") else F.replace(c, F.lit(","), F.lit(".")).cast("double")
    named = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, compounds)), F.array(*map(value, found))), lambda _, v: v.isNotNull())
    placed = F.map_from_arrays(F.array(*map(F.lit, compounds)), F.transform(F.slice(numbers, 1, len(compounds)), value))
    return F.when(F.size(named) > 0, named).when(F.size(numbers) >= len(compounds), placed).otherwise(F.create_map().cast("map<string,double>"))


def hull_layers(v: np.ndarray, k: int) -> np.ndarray:
    """The rows of ``v`` on the first k convex hulls of the points and their mirror images, peeled one after another."""
    left, found = np.arange(len(v)), []
    for _ in range(k):
        if not len(left):
            break
        both = np.vstack([v[left], -v[left]])
        order = np.lexsort((both[:, 1], both[:, 0]))
        # What lies on an edge, or as near to it as rounding may put it, counts as on the hull.
        slack = 1e-12 * float(np.abs(both).max() or 1.0) ** 2
        on: set[int] = set()
        for turn in (order, order[::-1]):
            chain: list[int] = []
            for i in turn:
                while len(chain) > 1:
                    (ax, ay), (bx, by), (cx, cy) = both[chain[-2]], both[chain[-1]], both[i]
                    if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) >= -slack:
                        break
                    chain.pop()
                chain.append(i)
            on.update(int(i) % len(left) for i in chain)
        here = np.array(sorted(on))
        found.append(left[here])
        left = np.delete(left, here)
    return np.sort(np.concatenate(found)) if found else left


def kaiser_pairs(grid: DataFrame, k: int = 10) -> DataFrame:
    """w1, w2, det: the k pairs of wavelengths, w1 < w2, with the largest |a1 b2 - a2 b1|, of rows (w, a, b).

    For a given first point the determinant is linear in the second, so each convex hull of the
    points and their mirror images has a partner better than any point inside it: the k best
    pairs are among the points of the first k hulls. Every task peels its own rows, what is left
    is peeled once more and compared. Ties go to smaller wavelengths; rows with nulls don't count.
    """
    schema = "w double, a double, b double"

    def candidates(batches):
        tables = [b for b in batches if b.num_rows]
        if tables:
            w, a, b = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("w", "a", "b"))
            # Pairs of determinant 0 are ranked by wavelength alone.
            keep = np.union1d(hull_layers(np.stack([a, b], axis=1), k), np.argsort(w, kind="stable")[: k + 1])
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (w, a, b)], names=["w", "a", "b"])

    def best(batches):
        for t in candidates(batches):
            w, a, b = (t.column(c).to_numpy() for c in ("w", "a", "b"))
            order = np.argsort(w, kind="stable")
            w, a, b = w[order], a[order], b[order]
            found: list[tuple] = []
            for i in range(len(w) - 1):
                det = np.abs(a[i] * b[i + 1 :] - a[i + 1 :] * b[i])
                top = np.argsort(-det, kind="stable")[:k]
                found = sorted([*found, *((-float(det[j]), float(w[i]), float(w[i + 1 + j])) for j in top if w[i + 1 + j] > w[i])])[:k]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in ([f[1] for f in found], [f[2] for f in found], [-f[0] for f in found])], names=["w1", "w2", "det"])

    points = grid.select(*(F.col(c).cast("double").alias(c) for c in ("w", "a", "b"))).dropna()
    return points.mapInArrow(candidates, schema).coalesce(1).mapInArrow(best, "w1 double, w2 double, det double")
