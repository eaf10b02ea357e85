"""Validation statistics as aggregates: one row out for each group of rows in.

Every function aggregates on the executors (partial, then final); quantiles of t and F are
then looked up for the few rows that result. Nulls are left out by the aggregates. Statistics
that a group has too few values for are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lambertlake.functions import dist

ALPHA = 0.05

# Critical values of Dixon's Q (two-sided), n = 3 to 10.
DIXON = {
    0.10: (0.941, 0.765, 0.642, 0.560, 0.507, 0.468, 0.437, 0.412),
    0.05: (0.970, 0.829, 0.710, 0.625, 0.568, 0.526, 0.493, 0.466),
    0.01: (0.994, 0.926, 0.821, 0.740, 0.680, 0.634, 0.598, 0.568),
}


def _by(df: DataFrame, by: list[str] | tuple[str, ...]):
    return df.groupBy(*by)


def describe(df: DataFrame, value: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """n, mean, sd, rsd (per cent), sem, min and max."""
    v = F.col(value)
    out = _by(df, by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.withColumn("rsd", F.try_divide(100 * F.col("sd"), F.abs("mean"))).withColumn("sem", F.col("sd") / F.sqrt("n"))


def precision(df: DataFrame, value: str, group: str) -> DataFrame:
    return describe(df, value, [group])


def recoveries(df: DataFrame, found: str, taken: str, out: str = "recovery") -> DataFrame:
    """Per cent found of what was taken; nothing taken is an error."""
    t = F.col(taken)
    return df.withColumn(out, F.when(t == 0, F.raise_error(F.lit("a taken amount is zero"))).otherwise(100 * F.col(found) / t))


def recovery(df: DataFrame, found: str, taken: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return describe(recoveries(df, found, taken), "recovery", by)


def linear_regression(
    df: DataFrame, x: str, y: str, by: list[str] | tuple[str, ...] = (), through_origin: bool = False,
    alpha: float = ALPHA, lod_basis: str = "intercept", strict: bool = True,
) -> DataFrame:
    """Least squares line with its standard deviations, confidence limits, LOD and LOQ.

    ``strict`` refuses groups with too few points or a single x; otherwise they get nulls.
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(px.isNotNull() & py.isNotNull())
    sums = _by(rows, by).agg(
        F.count("*").alias("n"), F.avg(px).alias("x_mean"), F.avg(py).alias("y_mean"), F.regr_sxx(py, px).alias("sxx"),
        F.regr_syy(py, px).alias("syy"), F.regr_sxy(py, px).alias("sxy"), F.sum(px * px).alias("xx"), F.sum(px * py).alias("xy"), F.sum(py * py).alias("yy"),
        F.min(px).alias("x_min"), F.max(px).alias("x_max"),
    )
    p = 1 if through_origin else 2
    if strict:
        bad = (F.col("n") < p + 1) | (F.col("xx") == 0 if through_origin else F.col("sxx") == 0)
        sums = sums.withColumn("n", F.when(bad, F.raise_error(F.lit("a line needs more points and more than one x"))).otherwise(F.col("n")))
    slope = F.try_divide("xy", "xx") if through_origin else F.try_divide("sxy", "sxx")
    out = sums.withColumn("slope", slope)
    out = out.withColumn("intercept", F.lit(0.0) if through_origin else F.col("y_mean") - F.col("slope") * F.col("x_mean"))
    rest = F.col("yy") - F.col("slope") * F.col("xy") if through_origin else F.col("syy") - F.col("slope") * F.col("sxy")
    out = out.withColumn("sse", F.greatest(rest, F.lit(0.0))).withColumn("dof", F.col("n") - p)
    out = out.withColumn("s_yx", F.sqrt(F.try_divide("sse", F.when(F.col("dof") > 0, F.col("dof")))))
    out = out.withColumn("sd_slope", F.try_divide(F.col("s_yx"), F.sqrt("xx" if through_origin else "sxx")))
    out = out.withColumn("sd_intercept", F.lit(0.0) if through_origin else F.col("sd_slope") * F.sqrt(F.col("xx") / F.col("n")))
    out = out.withColumn("r", F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))).withColumn("r2", 1 - F.try_divide("sse", "syy"))
    out = out.withColumn("t", dist.t_quantile(F.lit(1 - alpha / 2), F.when(F.col("dof") > 0, F.col("dof"))))
    for name, sd in (("slope", "sd_slope"), ("intercept", "sd_intercept")):
        out = out.withColumn(f"{name}_low", F.col(name) - F.col("t") * F.col(sd)).withColumn(f"{name}_high", F.col(name) + F.col("t") * F.col(sd))
    sigma = F.col("s_yx") if through_origin or lod_basis != "intercept" else F.col("sd_intercept")
    return out.withColumn("lod", F.try_divide(3.3 * sigma, F.abs("slope"))).withColumn("loq", F.try_divide(10 * sigma, F.abs("slope")))


def predict_x(signal: Column, line: DataFrame | None = None) -> Column:
    """Where the line of columns slope and intercept has the signal."""
    return F.try_divide(signal - F.col("intercept"), F.col("slope"))


def predict_y(x: Column) -> Column:
    return F.col("intercept") + F.col("slope") * x


def ci_x(signal: Column, replicates: int = 1, through_origin: bool = False) -> Column:
    """Half width of the confidence interval of x read from a mean of ``replicates`` signals."""
    if through_origin:
        spread = F.pow(signal, F.lit(2.0)) / (F.pow("slope", F.lit(2.0)) * F.col("xx"))
    else:
        spread = 1 / F.col("n") + F.pow(signal - F.col("y_mean"), F.lit(2.0)) / (F.pow("slope", F.lit(2.0)) * F.col("sxx"))
    return F.col("t") * F.col("s_yx") / F.abs("slope") * F.sqrt(F.lit(1.0 / replicates) + spread)


def residuals(df: DataFrame, line: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with what the (single-row) line leaves of them."""
    return df.crossJoin(F.broadcast(line.select("slope", "intercept").limit(1))).withColumn("residual", F.col(y) - predict_y(F.col(x))).drop("slope", "intercept")


def lack_of_fit(df: DataFrame, x: str, y: str, alpha: float = ALPHA) -> DataFrame:
    """F of lack of fit against pure error; null without replicates or with fewer than three levels."""
    py = F.col(y).cast("double")
    levels = df.groupBy(F.col(x).cast("double").alias("x")).agg(F.count(py).alias("n"), F.avg(py).alias("mean"), (F.var_pop(py) * F.count(py)).alias("pure"))
    n, mx = F.sum("n"), F.sum(F.col("n") * F.col("x")) / F.sum("n")
    # Weighted sums over the levels give the line of all points.
    sums = levels.agg(
        n.alias("n"), F.count("*").alias("levels"), F.sum("pure").alias("pure"), mx.alias("mx"), (F.sum(F.col("n") * F.col("mean")) / n).alias("my"),
        F.sum(F.col("n") * F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("n") * F.col("x") * F.col("mean")).alias("xy"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("mm"),
    )
    sxx, sxy, smm = (F.col("xx") - F.col("n") * F.col("mx") * F.col("mx"), F.col("xy") - F.col("n") * F.col("mx") * F.col("my"), F.col("mm") - F.col("n") * F.col("my") * F.col("my"))
    out = sums.withColumn("lack", F.greatest(smm - F.try_divide(sxy * sxy, sxx), F.lit(0.0))).withColumn("dof_lack", F.col("levels") - 2).withColumn("dof_pure", F.col("n") - F.col("levels"))
    fit = (F.col("dof_lack") > 0) & (F.col("dof_pure") > 0) & (F.col("pure") > 0)
    out = out.withColumn("f", F.when(fit, F.try_divide(F.col("lack") / F.col("dof_lack"), F.col("pure") / F.col("dof_pure"))))
    return out.withColumn("p", 1 - dist.f_probability(F.col("f"), F.col("dof_lack"), F.col("dof_pure"))).withColumn("f_crit", F.when(fit, dist.f_quantile(F.lit(1 - alpha), F.col("dof_lack"), F.col("dof_pure"))))


def summaries(df: DataFrame, value: str, group: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.groupBy(F.col(group).alias("group")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))


def anova_summary(groups: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One-way analysis of variance of rows (n, mean, sd)."""
    out = groups.agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("mm"), F.sum((F.col("n") - 1) * F.pow("sd", F.lit(2.0))).alias("within"),
    )
    out = out.withColumn("between", F.col("mm") - F.col("n") * F.col("grand") * F.col("grand")).withColumn("dof_between", F.col("groups") - 1).withColumn("dof_within", F.col("n") - F.col("groups"))
    out = out.withColumn("f", F.try_divide(F.col("between") / F.col("dof_between"), F.col("within") / F.col("dof_within")))
    return out.withColumn("p", 1 - dist.f_probability(F.col("f"), F.col("dof_between"), F.col("dof_within"))).withColumn("f_crit", dist.f_quantile(F.lit(1 - alpha), F.col("dof_between"), F.col("dof_within")))


def anova(df: DataFrame, value: str, group: str, alpha: float = ALPHA) -> DataFrame:
    return anova_summary(summaries(df, value, group), alpha)


def _check_summary(sd: float, n: int) -> None:
    if not (math.isfinite(sd) and sd >= 0):
        raise ValueError("a standard deviation must be finite and not negative")
    if n != int(n) or n < 2:
        raise ValueError("two values at least are needed")


def t_test(mean1: float, sd1: float, n1: int, mean2: float, sd2: float, n2: int, equal_var: bool = True, alpha: float = ALPHA, welch_dof: bool = True) -> dict:
    """Unpaired test from summaries; without pooling the degrees of freedom are Welch's (for p), or pooled ones for the critical value."""
    _check_summary(sd1, n1)
    _check_summary(sd2, n2)
    if sd1 == sd2 == 0:
        raise ValueError("both standard deviations are zero")
    a, b = sd1**2 / n1, sd2**2 / n2
    pooled = n1 + n2 - 2
    if equal_var:
        se, dof = math.sqrt(((n1 - 1) * sd1**2 + (n2 - 1) * sd2**2) / pooled * (1 / n1 + 1 / n2)), float(pooled)
    else:
        se, dof = math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    t = abs(mean1 - mean2) / se
    p = 2 * (1 - dist.t_cdf(t, dof))
    return {"t": t, "dof": dof, "p": p, "t_crit": dist.t_ppf(1 - alpha / 2, dof if welch_dof else pooled), "significant": p < alpha}


def f_test(sd1: float, n1: int, sd2: float, n2: int, alpha: float = ALPHA, tails: int = 1) -> dict:
    """Ratio of variances, the larger on top."""
    _check_summary(sd1, n1)
    _check_summary(sd2, n2)
    if tails not in (1, 2):
        raise ValueError("one tail or two")
    (v1, d1), (v2, d2) = sorted(((sd1**2, n1 - 1), (sd2**2, n2 - 1)), key=lambda v: -v[0])
    if v1 == 0:
        raise ValueError("both standard deviations are zero")
    f = v1 / v2 if v2 else math.inf
    one, two = dist.f_ppf(1 - alpha, d1, d2), dist.f_ppf(1 - alpha / 2, d1, d2)
    p = min(1.0, tails * (1 - dist.f_cdf(f, d1, d2))) if v2 else 0.0
    return {"f": f, "dof": (d1, d2), "p": p, "f_crit": one if tails == 1 else two, "f_crit_one_tailed": one, "f_crit_two_tailed": two, "significant": f > (one if tails == 1 else two)}


def compare(df: DataFrame, value: str, group: str, first, second, **options) -> dict:
    """t and F tests of two groups; two rows reach the driver."""
    rows = {r["group"]: r for r in summaries(df.where(F.col(group).isin(first, second)), value, group).collect()}
    a, b = rows[first], rows[second]
    return {"t_test": t_test(a["mean"], a["sd"], a["n"], b["mean"], b["sd"], b["n"], welch_dof=False, **options), "f_test": f_test(a["sd"], a["n"], b["sd"], b["n"])}


def two_groups(df: DataFrame, value: str, group: str, first, second, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """n, mean and variance of two groups side by side, in one pass; v1 and v2 are null below two values."""
    aggregates = []
    for k, name in enumerate((first, second), 1):
        v = F.when(F.col(group) == F.lit(name), F.col(value).cast("double"))
        aggregates += [F.count(v).alias(f"n{k}"), F.avg(v).alias(f"mean{k}"), F.when(F.count(v) > 1, F.var_samp(v)).alias(f"v{k}")]
    return _by(df, by).agg(*aggregates)


def t_tests(df: DataFrame, value: str, group: str, first, second, by: list[str] | tuple[str, ...] = (), equal_var: bool = True, alpha: float = ALPHA) -> DataFrame:
    """t test of two groups for each of ``by``; null where a group has one value or none, or neither varies."""
    out = two_groups(df, value, group, first, second, by)
    a, b, pooled = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2"), (F.col("n1") + F.col("n2") - 2).cast("double")
    if equal_var:
        se2 = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / pooled * (1 / F.col("n1") + 1 / F.col("n2"))
        dof = F.when(se2 > 0, pooled)
    else:
        se2 = a + b
        dof = F.try_divide(se2 * se2, a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    out = out.withColumn("t", F.try_divide(F.abs(F.col("mean1") - F.col("mean2")), F.sqrt(se2))).withColumn("dof", dof)
    out = out.withColumn("p", 2 * (1 - dist.t_probability(F.col("t"), F.col("dof")))).withColumn("t_crit", dist.t_quantile(F.lit(1 - alpha / 2), F.col("dof")))
    return out.withColumn("significant", F.col("p") < alpha)


def f_tests(df: DataFrame, value: str, group: str, first, second, by: list[str] | tuple[str, ...] = (), alpha: float = ALPHA, tails: int = 1) -> DataFrame:
    """F test of two groups for each of ``by``, the larger variance on top.

    Null where a group has one value or none, or neither varies; infinite where only one varies.
    """
    if tails not in (1, 2):
        raise ValueError("one tail or two")
    out = two_groups(df, value, group, first, second, by)
    swap = F.col("v2") > F.col("v1")
    top, low = F.greatest("v1", "v2"), F.least("v1", "v2")
    known = F.col("v1").isNotNull() & F.col("v2").isNotNull() & (top > 0)
    out = out.withColumn("f", F.when(known, F.coalesce(F.try_divide(top, low), F.lit(math.inf))))
    out = out.withColumn("dof1", F.when(swap, F.col("n2")).otherwise(F.col("n1")) - 1).withColumn("dof2", F.when(swap, F.col("n1")).otherwise(F.col("n2")) - 1)
    finite = F.when(F.col("f") < math.inf, F.col("f"))
    p = F.when(F.col("f") == math.inf, 0.0).otherwise(F.least(F.lit(1.0), tails * (1 - dist.f_probability(finite, F.col("dof1"), F.col("dof2")))))
    out = out.withColumn("p", F.when(F.col("f").isNotNull(), p))
    enough = lambda c: F.when(F.col("f").isNotNull(), F.col(c))
    out = out.withColumn("f_crit", dist.f_quantile(F.lit(1 - alpha / tails), enough("dof1"), enough("dof2")))
    return out.withColumn("significant", F.col("f") > F.col("f_crit"))


def interval_hypothesis(mean1: float, sd1: float, n1: int, mean2: float, sd2: float, n2: int, theta: float = 0.02, alpha: float = ALPHA) -> dict:
    """Whether the 1 - 2 alpha interval of the ratio of means lies within 1 +- theta."""
    pooled = ((n1 - 1) * sd1**2 + (n2 - 1) * sd2**2) / (n1 + n2 - 2)
    t2 = dist.t_ppf(1 - alpha, n1 + n2 - 2) ** 2
    a, c = mean2**2 - t2 * pooled / n2, mean1**2 - t2 * pooled / n1
    root = (mean1 * mean2) ** 2 - a * c
    if a <= 0 or root < 0:
        return {"lower": math.nan, "upper": math.nan, "accepted": False}
    lower, upper = ((mean1 * mean2 + s * math.sqrt(root)) / a for s in (-1, 1))
    return {"lower": lower, "upper": upper, "accepted": lower >= 1 - theta and upper <= 1 + theta}


def interval_hypotheses(df: DataFrame, value: str, group: str, first, second, by: list[str] | tuple[str, ...] = (), theta: float = 0.02, alpha: float = ALPHA) -> DataFrame:
    """lower, upper, accepted for each of ``by``: whether the 1 - 2 alpha interval of the ratio of two groups' means lies within 1 +- theta.

    Bounds are null, and nothing is accepted, where a group has one value or none or the second
    mean can't be told from zero.
    """
    out = two_groups(df, value, group, first, second, by)
    dof = (F.col("n1") + F.col("n2") - 2).cast("double")
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.when(dof > 0, dof)
    out = out.withColumn("dof", F.when(pooled.isNotNull(), dof)).withColumn("_t", dist.t_quantile(F.lit(1 - alpha), F.col("dof")))
    t2 = F.col("_t") * F.col("_t") * pooled
    a, c = F.col("mean2") * F.col("mean2") - t2 / F.col("n2"), F.col("mean1") * F.col("mean1") - t2 / F.col("n1")
    both = F.col("mean1") * F.col("mean2")
    out = out.withColumn("_a", a).withColumn("_root", both * both - a * c)
    known = (F.col("_a") > 0) & (F.col("_root") >= 0)
    bound = lambda sign: F.when(known, (both + sign * F.sqrt(F.greatest("_root", F.lit(0.0)))) / F.col("_a"))
    out = out.withColumn("lower", bound(-1)).withColumn("upper", bound(1)).drop("_t", "_a", "_root")
    return out.withColumn("accepted", F.coalesce((F.col("lower") >= 1 - theta) & (F.col("upper") <= 1 + theta), F.lit(False)))


def standard_addition(df: DataFrame, added: str, response: str, by: list[str] | tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    return linear_regression(df, added, response, by, strict=strict).withColumn("found", F.try_divide("intercept", "slope"))


def addition_recovery(df: DataFrame, found: str, added: str) -> DataFrame:
    """Rows with found less the mean of unspiked rows, and its per cent of what was added."""
    base = df.where(F.col(added) == 0).agg(F.avg(found).alias("base"))
    out = df.crossJoin(F.broadcast(base)).withColumn("recovered", F.col(found) - F.col("base"))
    return out.withColumn("recovery", F.try_divide(100 * F.col("recovered"), F.when(F.col(added) != 0, F.col(added))))


def enrichment_correction(df: DataFrame, found: str, added: str, claim: str | None = None) -> DataFrame:
    out = df.withColumn("corrected", F.col(found) - F.col(added))
    return out if claim is None else out.withColumn("of_claim", F.try_divide(100 * F.col("corrected"), F.col(claim)))


def grubbs(df: DataFrame, value: str, ident: str, by: list[str] | tuple[str, ...] = (), alpha: float = ALPHA) -> DataFrame:
    """The value farthest from its group's mean, with G and its critical value; ties to the smaller identifier."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull()).select(*by, F.col(ident).alias("ident"), v.alias("v"))
    sums = _by(rows, by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min(F.struct("v", "ident")).alias("low"), F.min(F.struct((-F.col("v")).alias("v"), "ident")).alias("high"))
    # The farthest value is the smallest or the largest one.
    far_low, far_high = F.col("mean") - F.col("low.v"), -F.col("high.v") - F.col("mean")
    out = sums.withColumn("value", F.when(far_low >= far_high, F.col("low.v")).otherwise(-F.col("high.v")))
    out = out.withColumn("ident", F.when(far_low >= far_high, F.col("low.ident")).otherwise(F.col("high.ident")))
    out = out.withColumn("g", F.when(F.col("sd") == 0, 0.0).otherwise(F.try_divide(F.greatest(far_low, far_high), F.col("sd"))))
    n = F.col("n")
    t = dist.t_quantile(F.when(n >= 3, 1 - alpha / (2 * n)), F.when(n >= 3, n - 2))
    out = out.withColumn("_t2", F.pow(t, F.lit(2.0))).withColumn("g_crit", (n - 1) / F.sqrt(n) * F.sqrt(F.try_divide(F.col("_t2"), n - 2 + F.col("_t2"))))
    return out.withColumn("outlier", F.coalesce((F.col("sd") > 0) & (F.col("g") > F.col("g_crit")), F.lit(False))).drop("_t2", "low", "high")


def dixon(df: DataFrame, value: str, by: list[str] | tuple[str, ...] = (), alpha: float = ALPHA, ident: str | None = None) -> DataFrame:
    """Q of the more isolated end of each group of 3 to 10 values; other groups are left out.

    They are left out before any values are gathered, so no more than ten meet. With ``ident``
    the column of that name tells which value it is; ties to the smaller identifier.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull()).select(*by, v.alias("v"), (F.col(ident) if ident else F.lit(None).cast("int")).alias("ident"))
    counted = _by(rows, by).agg(F.count("*").alias("n")).where(F.col("n").between(3, 10))
    if by:
        keys = [F.col(c).alias(f"_key{i}") for i, c in enumerate(by)]
        same = [rows[c].eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(by)]
        small = rows.join(counted.select("n", *keys), same).drop(*(f"_key{i}" for i in range(len(by))))
    else:
        small = rows.crossJoin(F.broadcast(counted))  # one row
    out = small.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("v", "ident"))).alias("all"))
    at = lambda k: F.element_at("all", k)["v"]
    last = F.array_min(F.transform(F.filter("all", lambda e: e["v"] == F.element_at("all", -1)["v"]), lambda e: e["ident"]))
    span = at(-1) - at(1)
    q_low, q_high = F.try_divide(at(2) - at(1), span), F.try_divide(at(-1) - at(-2), span)
    out = out.withColumn("q", F.coalesce(F.greatest(q_low, q_high), F.lit(0.0)))
    out = out.withColumn("value", F.when(span == 0, F.lit(None)).when(q_low >= q_high, at(1)).otherwise(at(-1)))
    out = out.withColumn("ident", F.when(span == 0, F.lit(None)).when(q_low >= q_high, F.element_at("all", 1)["ident"]).otherwise(last))
    out = out.withColumn("q_crit", F.get(F.array(*map(F.lit, DIXON[alpha])), (F.col("n") - 3).cast("int")))
    out = out.withColumn("outlier", F.col("q") > F.col("q_crit")).drop("all")
    return out if ident else out.drop("ident")


def prediction_error(df: DataFrame, predicted: str, actual: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """RMSEP, bias, SEP and R2."""
    e, a = F.col(predicted) - F.col(actual), F.col(actual).cast("double")
    out = _by(df, by).agg(F.count(e).alias("n"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmsep"), F.stddev_samp(e).alias("sep"), F.sum(e * e).alias("_sse"), (F.var_pop(a) * F.count(a)).alias("_sst"))
    return out.withColumn("r2", 1 - F.try_divide("_sse", "_sst")).drop("_sse", "_sst")


def relative_rmsep(df: DataFrame, predicted: str, actual: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Per cent, over rows with something to find."""
    rel = F.when(F.col(actual) > 0, (F.col(predicted) - F.col(actual)) / F.col(actual))
    return _by(df, by).agg((100 * F.sqrt(F.avg(rel * rel))).alias("relative_rmsep"))


def absorptivity(df: DataFrame, concentration: str, signal: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    c = F.col(concentration).cast("double")
    return _by(df, by).agg(F.try_divide(F.sum(c * F.col(signal)), F.sum(c * c)).alias("absorptivity"))


# Greenness

AGREE_PRINCIPLES = 12


def agree(scores: DataFrame) -> DataFrame:
    """Weighted mean of the scores (score, weight) of a method's principles; red over yellow to green as a colour."""
    total = F.sum(F.col("weight") * F.col("score")) / F.sum("weight")
    out = scores.groupBy("method").agg(total.alias("total"), F.count("*").alias("n"))
    v = F.least(F.greatest("total", F.lit(0.0)), F.lit(1.0))
    red, green = F.when(v < 0.5, 255).otherwise((510 * (1 - v)).cast("int")), F.when(v < 0.5, (510 * v).cast("int")).otherwise(200 + (55 * (1 - v)).cast("int"))
    two = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    checked = F.when(F.col("n") != AGREE_PRINCIPLES, F.raise_error(F.lit("twelve scores are needed"))).otherwise(F.round("total", 2))
    return out.select("method", checked.alias("score"), F.concat(F.lit("#"), two(red), two(green), F.lit("40")).alias("colour"))


def eco_scale(penalties: DataFrame) -> DataFrame:
    out = penalties.groupBy("method").agg((100 - F.sum("points")).alias("score"))
    return out.withColumn("rating", F.when(F.col("score") > 75, "excellent").when(F.col("score") > 50, "acceptable").otherwise("inadequate"))


def reagent_penalty(volume_ml: Column, pictograms: Column, signal_word: Column) -> Column:
    amount = F.when(volume_ml < 10, 1).when(volume_ml <= 100, 2).otherwise(3)
    return (amount * pictograms * F.when(F.lower(signal_word) == "danger", 2).otherwise(1)).cast("double")


def energy_penalty(kwh: Column) -> Column:
    return F.when(kwh <= 0.1, 0.0).when(kwh <= 1.5, 1.0).otherwise(2.0)


# The fields of the procedure index and its colours.
GAPI_FIELDS = (
    "Collection", "Preservation", "Transport", "Storage", "Type of method", "Scale of extraction", "Solvents/reagents used", "Additional treatments",
    "Amount (reagents/solvents)", "Health hazard", "Safety hazard", "Energy (per sample)", "Occupational hazard", "Waste", "Waste treatment",
)
GAPI_COLOURS = {"green": "#2ca02c", "yellow": "#f2c80f", "red": "#d62728"}
