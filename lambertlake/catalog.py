"""Registered queries of the engine on the driver's tables, and the SQL that gives the same rows.

``embeddings`` serve as spectra of 64 points (x is the position), ``events`` as one series per
user in order of event_id, ``lineitem`` as calibration points and replicate results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lambertlake import catalog_models
from lambertlake.functions.shared import checkpoint, fresh_folder
from lambertlake.operators import gram, methods, ordered, series, stats, views
from lambertlake.operators.chemometrics import SpectralModel
from lambertlake.plans import derived
from lambertlake.plans import pipeline as pl
from lambertlake.sources import blocks
from lambertlake.storage import chain

FLAGSHIP = "ratio_difference_assay"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("double"))
    y = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", x.alias("x"), y.alias("y"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))


SPECTRA = "s AS (SELECT vec_id AS id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS y FROM embeddings)"
REFS = f"{SPECTRA}, d AS (SELECT y AS d FROM s WHERE id = 0), e AS (SELECT y AS e FROM s WHERE id = 1)"


# Pipeline operations

def _checksum(df: DataFrame) -> DataFrame:
    """One row for each spectrum: its points, and the sum of y times position."""
    sums = F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return df.select(F.col("id").alias("vec_id"), F.size("y").cast("long").alias("n_points"), F.round(sums, 4).alias("checksum"))


def _op_query(key: str, params: dict, z: str | None, steps: list[dict] | None = None) -> None:
    steps = steps or [{"op": key, "params": params}]

    def run(spark, sf_dir):
        df = spectra(spark, sf_dir)
        return _checksum(pl.process(df, steps, pl.Library.of(df, steps)))

    sql = None
    if z is not None:
        sql = f"""WITH {REFS}, z AS (SELECT id, {z} AS z FROM s, d, e)
SELECT id AS vec_id, CAST(len(z) AS BIGINT) AS n_points,
       round(list_sum(list_transform(range(1, len(z) + 1), lambda i: z[i] * i)), 4) AS checksum FROM z"""
    query(f"operation_{key}", sql)(run)


def _each(expression: str) -> str:
    return f"list_transform(range(1, 65), lambda i: {expression})"


_RATIO = "list_transform(range(1, 65), lambda i: y[i] / d[i])"
_PLATEAU = "(list_sum(list_transform(range(51, 57), lambda j: y[j] / d[j])) / 6)"
_MEAN = "list_avg(y)"
_SLOPE = "list_transform(range(2, 64), lambda i: (y[i + 1] - y[i - 1]) / 2)"
_MATCH = f"(list_sum(list_transform(range(1, 65), lambda m: (y[m] - {_PLATEAU} * d[m]) * e[m])) / list_sum(list_transform(range(1, 65), lambda m: e[m] * e[m])))"
_PURE = "((e[11] / d[11]) / (e[21] / d[21]))"
_CENTER = f"(y[21] / d[21] - (y[11] / d[11] - y[21] / d[21]) / ({_PURE} - 1))"

for _key, _params, _z in (
    ("crop", {"start": 10, "end": 50}, "y[11:51]"),
    ("resample", {"step": 0.5}, "list_transform(range(0, 127), lambda i: (y[i // 2 + 1] + y[(i + 1) // 2 + 1]) / 2)"),
    ("smooth_ma", {"window": 5}, _each("list_avg(y[greatest(i - 2, 1):least(i + 2, 64)])")),
    ("baseline_offset", {"start": 50, "end": 63}, _each("y[i] - list_avg(y[51:64])")),
    ("baseline_linear", {"w1": 5, "w2": 60}, _each("y[i] - y[6] - (y[61] - y[6]) / 55 * (i - 6)")),
    ("subtract", {"reference": 0, "factor": 0.5}, _each("y[i] - 0.5 * d[i]")),
    ("add", {"reference": 0, "factor": 2}, _each("y[i] + 2 * d[i]")),
    ("divide", {"reference": 0, "threshold": 0}, _RATIO),
    ("divide_sum", {"reference": 0, "reference2": 1, "factor2": 0.5, "threshold": 0}, _each("y[i] / (d[i] + 0.5 * e[i])")),
    ("multiply", {"reference": 0}, _each("y[i] * d[i]")),
    ("scale", {"factor": 3}, _each("y[i] * 3")),
    ("offset", {"value": 0.25}, _each("y[i] + 0.25")),
    ("mean_center", {}, _each(f"y[i] - {_MEAN}")),
    ("subtract_plateau", {"start": 20, "end": 30}, _each("y[i] - list_avg(y[21:31])")),
    ("normalize", {"mode": "max"}, _each("y[i] / list_max(list_transform(y, lambda v: abs(v)))")),
    ("snv", {}, _each(f"(y[i] - {_MEAN}) / sqrt(list_sum(list_transform(y, lambda v: (v - {_MEAN}) * (v - {_MEAN}))) / 63)")),
    ("t_to_a", {"percent": False}, _each("-log10(greatest(y[i], 1e-12))")),
    ("a_to_t", {}, _each("100 * pow(10.0, -y[i])")),
    ("derivative", {"order": 1, "delta_lambda": 2}, _SLOPE),
    ("ratio_subtraction", {"divisor": 0, "start": 50, "end": 55}, _each(f"y[i] - {_PLATEAU} * d[i]")),
    ("constant_multiplication", {"divisor": 0, "start": 50, "end": 55}, _each(f"{_PLATEAU} * d[i]")),
    ("factorized_recovery", {"reference": 0, "wavelength": 30}, _each("y[31] / d[31] * d[i]")),
    ("spectrum_subtraction", {"reference": 0, "wavelength": 30, "wavelength_end": 35}, _each("y[i] - list_sum(list_transform(range(31, 37), lambda j: y[j] / d[j])) / 6 * d[i]")),
    # A parabola through seven points, evaluated t away from their middle; at the ends the last seven are used.
    ("smooth_sg", {"window": 7, "polyorder": 2}, _each("list_sum(list_transform(range(-3, 4), lambda j: y[least(greatest(i, 4), 61) + j] * (1.0 / 7 + (i - least(greatest(i, 4), 61)) * j / 28.0 + ((i - least(greatest(i, 4), 61)) ** 2 - 4) * (j * j - 4) / 84.0)))")),
    ("smooth_whittaker", {}, None),
    ("baseline_poly", {}, None),
    ("baseline_als", {}, None),
    ("divide_centered_ratio", {"reference": 1, "divisor": 0, "start": 10, "end": 50, "threshold": 0}, "list_transform(range(11, 52), lambda i: y[i] / (e[i] / d[i] - list_sum(list_transform(range(11, 52), lambda j: e[j] / d[j])) / 41))"),
    ("extended_ratio_subtraction", {"divisor": 0, "reference": 1, "start": 50, "end": 55}, _each(f"y[i] - {_MATCH} * e[i]")),
    ("constant_center", {"divisor": 0, "reference": 1, "w1": 10, "w2": 20, "target": "Y"}, _each(f"{_CENTER} * d[i]")),
):
    _op_query(_key, _params, _z)


# The system of five bands (1 and ten times the second differences' squares) factored, then solved forwards and backwards.
ORACLE_SQL["operation_smooth_whittaker"] = f"""WITH RECURSIVE {SPECTRA},
a AS (SELECT i, 1 + 10.0 * CASE WHEN i IN (1, 64) THEN 1 WHEN i IN (2, 63) THEN 5 ELSE 6 END AS a, CASE WHEN i = 64 THEN 0 WHEN i IN (1, 63) THEN -20.0 ELSE -40.0 END AS b, CASE WHEN i < 63 THEN 10.0 ELSE 0 END AS c FROM range(1, 65) t(i)),
l AS (SELECT i, CAST(a AS DOUBLE) AS d, CAST(b / a AS DOUBLE) AS e, CAST(c / a AS DOUBLE) AS f, CAST(0 AS DOUBLE) AS dp, CAST(0 AS DOUBLE) AS fp FROM a WHERE i = 1
UNION ALL SELECT i, d, (b - e * f * d0) / d, c / d, d0, f FROM (SELECT a.i, a.b, a.c, l.e, l.f, l.d AS d0, a.a - l.e * l.e * l.d - l.fp * l.fp * l.dp AS d FROM l JOIN a ON a.i = l.i + 1)),
z AS (SELECT id, CAST(1 AS BIGINT) AS i, y[1] AS z, CAST(0 AS DOUBLE) AS zp FROM s
UNION ALL SELECT z.id, z.i + 1, s.y[z.i + 1] - l.e * z.z - l.fp * z.zp, z.z FROM z JOIN s ON s.id = z.id JOIN l ON l.i = z.i WHERE z.i < 64),
x AS (SELECT z.id, z.i, z.z / l.d AS x, CAST(0 AS DOUBLE) AS xn FROM z JOIN l ON l.i = z.i WHERE z.i = 64
UNION ALL SELECT x.id, z.i, z.z / l.d - l.e * x.x - l.f * x.xn, x.x FROM x JOIN z ON z.id = x.id AND z.i = x.i - 1 JOIN l ON l.i = z.i)
SELECT id AS vec_id, count(*) AS n_points, round(sum(x * i), 4) AS checksum FROM x GROUP BY id"""


def _f_tail(f: str, d1: str, d2: str) -> str:
    """The probability of an F beyond ``f`` in closed form, for one even number of degrees at least."""
    terms = lambda n, other, x: f"list_sum(list_transform(range(0, CAST({n} AS BIGINT) // 2), lambda a_: pow({x}, a_) * coalesce(list_product(list_transform(range(1, a_ + 1), lambda b_: ({other} / 2.0 + b_ - 1) / b_)), 1)))"
    x = f"(CASE WHEN isinf({f}) THEN 0 ELSE {d2} / ({d2} + {d1} * {f}) END)"
    return f"CASE WHEN {d1} % 2 = 0 THEN pow({x}, {d2} / 2.0) * {terms(d1, d2, f'(1 - {x})')} WHEN {d2} % 2 = 0 THEN 1 - pow(1 - {x}, {d1} / 2.0) * {terms(d2, d1, x)} END"


def _closed(p: str, d1: str, d2: str, digits: int):
    """p where it has the closed form."""
    return F.when((F.col(d1) % 2 == 0) | (F.col(d2) % 2 == 0), F.round(p, digits)).alias("p")


# Measurements

@query(
    "measurements",
    f"""WITH {SPECTRA}
SELECT id AS vec_id, round((y[11] + y[12]) / 2, 6) AS amplitude, round(y[11] - y[31], 6) AS difference, round(y[11] - 0.5 * y[31], 6) AS weighted_difference,
  round(y[11] / y[31], 4) AS ratio, round(list_max(y[11:31]) - list_min(y[11:31]), 6) AS peak_to_peak, round(list_max(y[11:31]), 6) AS maximum,
  round(list_min(y[11:31]), 6) AS minimum, round(list_avg(y[11:31]), 6) AS mean,
  round(list_sum(list_transform(range(11, 31), lambda i: (y[i] + y[i + 1]) / 2)), 6) AS area FROM s""",
)
def measurements(spark, sf_dir):
    """All nine kinds of measurement through the operator; the one grid is looked up once."""
    df = spectra(spark, sf_dir)
    (grid,) = pl.grids_of(df)
    names = []
    for name, more, digits in (
        ("amplitude", {"w1": 10.5}, 6), ("difference", {}, 6), ("weighted_difference", {"factor": 0.5}, 6), ("ratio", {}, 4), ("peak_to_peak", {}, 6),
        ("maximum", {}, 6), ("minimum", {}, 6), ("mean", {}, 6), ("area", {}, 6),
    ):
        df = pl.signals(df, [], {"kind": name, "params": {"w1": 10, "w2": 30} | more}, out=name, grid=grid)
        names.append(F.round(name, digits).alias(name))
    return df.select(F.col("id").alias("vec_id"), *names)


RATIO_DIFFERENCE = ([{"op": "divide", "params": {"reference": 0, "threshold": 0}}], {"kind": "difference", "params": {"w1": 20, "w2": 40}})


@query(
    FLAGSHIP,
    f"""WITH {SPECTRA}, d AS (SELECT y AS d FROM s WHERE id = 0),
g AS (SELECT id, CAST(label AS DOUBLE) AS taken, y[21] / d[21] - y[41] / d[41] AS signal FROM s, d WHERE id <> 0),
l AS (SELECT regr_slope(signal, taken) AS b, regr_intercept(signal, taken) AS a FROM g WHERE id % 2 = 0)
SELECT id AS vec_id, taken, round(signal, 6) AS signal, round((signal - a) / b, 4) AS found FROM g, l WHERE id % 2 = 1""",
)
def ratio_difference_assay(spark, sf_dir):
    """Signals of ratio spectra, a line from the even rows, amounts found in the odd ones."""
    df = spectra(spark, sf_dir)
    steps, measurement = RATIO_DIFFERENCE
    got = pl.signals(df.where("id <> 0"), steps, measurement, pl.Library.of(df, steps)).withColumn("taken", F.col("label").cast("double"))
    line = stats.linear_regression(got.where("id % 2 = 0"), "taken", "signal").select("slope", "intercept")
    found = got.where("id % 2 = 1").crossJoin(F.broadcast(line))  # one row
    return found.select(F.col("id").alias("vec_id"), "taken", F.round("signal", 6).alias("signal"), F.round(stats.predict_x(F.col("signal")), 4).alias("found"))


# Statistics

@query(
    "linear_regression",
    """SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
  round(corr(l_extendedprice, l_quantity), 8) AS r, round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 3) AS s_yx
FROM lineitem GROUP BY l_returnflag""",
)
def linear_regression(spark, sf_dir):
    line = stats.linear_regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return line.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 8).alias("r"), F.round("s_yx", 3).alias("s_yx"))


@query(
    "regression_through_origin",
    """WITH a AS (SELECT l_linestatus, count(*) AS n, sum(l_quantity * l_extendedprice) AS xy, sum(l_quantity * l_quantity) AS xx, sum(l_extendedprice * l_extendedprice) AS yy FROM lineitem GROUP BY 1)
SELECT l_linestatus, round(xy / xx, 5) AS slope, round(sqrt((yy - xy * xy / xx) / (n - 1)), 3) AS s_yx, round(3.3 * sqrt((yy - xy * xy / xx) / (n - 1)) / (xy / xx), 5) AS lod FROM a""",
)
def regression_through_origin(spark, sf_dir):
    line = stats.linear_regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_linestatus"], through_origin=True)
    return line.select("l_linestatus", F.round("slope", 5).alias("slope"), F.round("s_yx", 3).alias("s_yx"), F.round("lod", 5).alias("lod"))


@query(
    "absorptivity",
    "SELECT l_shipmode, round(a, 6) AS absorptivity FROM (SELECT l_linenumber AS l_shipmode, sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS a FROM lineitem GROUP BY 1)",
)
def absorptivity(spark, sf_dir):
    got = stats.absorptivity(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_linenumber"])
    return got.select(F.col("l_linenumber").alias("l_shipmode"), F.round("absorptivity", 6).alias("absorptivity"))


@query(
    "lack_of_fit",
    """WITH v AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem),
g AS (SELECT x, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS pure FROM v GROUP BY x),
s AS (SELECT regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS sse, count(*) AS n FROM v),
t AS (SELECT sum(pure) AS pure, count(*) AS k FROM g)
SELECT k AS levels, round((sse - pure) / (k - 2) / (pure / (n - k)), 5) AS f, round(""" + _f_tail("((sse - pure) / (k - 2) / (pure / (n - k)))", "(k - 2)", "(n - k)") + """, 5) AS p FROM s, t""",
)
def lack_of_fit(spark, sf_dir):
    return stats.lack_of_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select("levels", F.round("f", 5).alias("f"), _closed("p", "dof_lack", "dof_pure", 5))


@query(
    "describe",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(100 * stddev_samp(value) / abs(avg(value)), 6) AS rsd,
  round(stddev_samp(value) / sqrt(count(value)), 6) AS sem, min(value) AS min, max(value) AS max FROM events GROUP BY event_type""",
)
def describe(spark, sf_dir):
    got = stats.describe(table(spark, sf_dir, "events"), "value", ["event_type"])
    return got.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "rsd", "sem")), "min", "max")


@query(
    "recovery",
    """SELECT l_returnflag, count(*) AS n, round(avg(100 * l_extendedprice * (1 - l_discount) / l_extendedprice), 6) AS mean, round(stddev_samp(100 * l_extendedprice * (1 - l_discount) / l_extendedprice), 6) AS sd
FROM lineitem GROUP BY l_returnflag""",
)
def recovery(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("found", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return stats.recovery(rows, "found", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(
    "anova",
    """WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1),
a AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS w FROM g), b AS (SELECT sum(g.n * (m - gm) * (m - gm)) AS s FROM g, a)
SELECT CAST(k AS BIGINT) AS groups, CAST(n AS BIGINT) AS n, round((s / (k - 1)) / (w / (n - k)), 5) AS f,
round(""" + _f_tail("((s / (k - 1)) / (w / (n - k)))", "(k - 1)", "(n - k)") + """, 6) AS p FROM a, b""",
)
def anova(spark, sf_dir):
    got = stats.anova(table(spark, sf_dir, "events"), "value", "event_type")
    return got.select("groups", "n", F.round("f", 5).alias("f"), _closed("p", "dof_between", "dof_within", 6))


@query(
    "grubbs",
    """WITH a AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd, count(value) AS n FROM events GROUP BY 1 HAVING count(value) >= 3)
SELECT user_id, n, round(max(abs(value - m)) / any_value(sd), 6) AS g FROM events JOIN a USING (user_id) GROUP BY user_id, n""",
)
def grubbs(spark, sf_dir):
    got = stats.grubbs(table(spark, sf_dir, "events"), "value", "event_id", ["user_id"])
    return got.where("n >= 3").select("user_id", "n", F.round("g", 6).alias("g"))


_TWO = """g AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS n1, count(*) FILTER (l_linestatus = 'O') AS n2, avg(l_extendedprice) FILTER (l_linestatus = 'F') AS m1,
avg(l_extendedprice) FILTER (l_linestatus = 'O') AS m2, var_samp(l_extendedprice) FILTER (l_linestatus = 'F') AS v1, var_samp(l_extendedprice) FILTER (l_linestatus = 'O') AS v2 FROM lineitem GROUP BY 1)"""


@query(
    "t_test",
    # The distribution of t in closed form: sums of powers of cosines, for any whole number of degrees.
    f"""WITH {_TWO}, t AS (SELECT *, n1 + n2 - 2 AS dof, abs(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM g WHERE n1 > 1 AND n2 > 1 AND v1 + v2 > 0),
a AS (SELECT *, atan(t / sqrt(dof)) AS o FROM t),
s AS (SELECT *, list_sum(list_transform(range(0, dof // 2), lambda k: CASE WHEN dof % 2 = 0 THEN pow(cos(o), 2 * k) * coalesce(list_product(list_transform(range(1, k + 1), lambda i: (2 * i - 1) / (2.0 * i))), 1)
ELSE pow(cos(o), 2 * k + 1) * coalesce(list_product(list_transform(range(1, k + 1), lambda i: 2 * i / (2.0 * i + 1))), 1) END)) AS s FROM a)
SELECT l_orderkey, round(t, 6) AS t, CAST(dof AS DOUBLE) AS dof, round(CASE WHEN dof % 2 = 0 THEN 1 - sin(o) * s ELSE 1 - 2 / pi() * (o + sin(o) * coalesce(s, 0)) END, 7) AS p FROM s""",
)
def t_test(spark, sf_dir):
    got = stats.t_tests(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus", "F", "O", ["l_orderkey"]).where("t IS NOT NULL")
    return got.select("l_orderkey", F.round("t", 6).alias("t"), "dof", F.round("p", 7).alias("p"))


@query(
    "f_test",
    f"""WITH {_TWO}, f AS (SELECT *, CASE WHEN least(v1, v2) = 0 THEN CAST('infinity' AS DOUBLE) ELSE greatest(v1, v2) / least(v1, v2) END AS f, CASE WHEN v2 > v1 THEN n2 ELSE n1 END - 1 AS dof1, CASE WHEN v2 > v1 THEN n1 ELSE n2 END - 1 AS dof2
FROM g WHERE n1 > 1 AND n2 > 1 AND v1 + v2 > 0)
SELECT l_orderkey, round(least(v1, v2) / greatest(v1, v2), 9) AS inverse_f, dof1, dof2, round({_f_tail('f', 'dof1', 'dof2')}, 7) AS p FROM f""",
)
def f_test(spark, sf_dir):
    got = stats.f_tests(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus", "F", "O", ["l_orderkey"])
    return got.where("f IS NOT NULL").select("l_orderkey", F.round(1 / F.col("f"), 9).alias("inverse_f"), "dof1", "dof2", _closed("p", "dof1", "dof2", 7))


@query(
    "t_test_welch",
    f"""WITH {_TWO}, w AS (SELECT *, v1 / n1 AS a, v2 / n2 AS b FROM g WHERE n1 > 1 AND n2 > 1 AND v1 + v2 > 0)
SELECT l_orderkey, round(abs(m1 - m2) / sqrt(a + b), 6) AS t, round((a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)), 6) AS dof FROM w""",
)
def t_test_welch(spark, sf_dir):
    got = stats.t_tests(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus", "F", "O", ["l_orderkey"], equal_var=False).where("t IS NOT NULL")
    return got.select("l_orderkey", F.round("t", 6).alias("t"), F.round("dof", 6).alias("dof"))


@query(
    "interval_hypothesis",
    # The 95 % quantiles of t for one to seven degrees of freedom.
    f"""WITH {_TWO}, t AS (SELECT *, n1 + n2 - 2 AS dof, [6.313751514675043, 2.919985580353726, 2.353363434801823, 2.131846786326649, 2.015048373333024, 1.943180280515302, 1.894578605090006][n1 + n2 - 2] AS t,
((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS v FROM g WHERE n1 > 1 AND n2 > 1 AND n1 + n2 <= 9),
a AS (SELECT *, m2 * m2 - t * t * v / n2 AS a, m1 * m1 - t * t * v / n1 AS c FROM t), r AS (SELECT *, m1 * m2 * m1 * m2 - a * c AS r FROM a),
b AS (SELECT l_orderkey, CASE WHEN a > 0 AND r >= 0 THEN (m1 * m2 - sqrt(greatest(r, 0))) / a END AS lower, CASE WHEN a > 0 AND r >= 0 THEN (m1 * m2 + sqrt(greatest(r, 0))) / a END AS upper FROM r)
SELECT l_orderkey, round(lower, 4) AS lower, round(upper, 4) AS upper, CAST(coalesce(lower >= 0.5 AND upper <= 1.5, false) AS INTEGER) AS accepted FROM b WHERE upper < 100 OR upper IS NULL""",
)
def interval_hypothesis(spark, sf_dir):
    got = stats.interval_hypotheses(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus", "F", "O", ["l_orderkey"], theta=0.5)
    got = got.where("dof <= 7 AND (upper < 100 OR upper IS NULL)")  # the quantiles listed; beyond, rounding decides the digits
    return got.select("l_orderkey", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), F.col("accepted").cast("int").alias("accepted"))


@query(
    "dixon",
    """WITH v AS (SELECT l_orderkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
e AS (SELECT l_orderkey, n, min(v) AS a, max(CASE WHEN i = 2 THEN v END) AS b, max(CASE WHEN i = n - 1 THEN v END) AS c, max(v) AS d FROM v WHERE n BETWEEN 3 AND 10 GROUP BY 1, 2)
SELECT l_orderkey, n, round(CASE WHEN d = a THEN 0 ELSE greatest((b - a) / (d - a), (d - c) / (d - a)) END, 6) AS q FROM e""",
)
def dixon(spark, sf_dir):
    return stats.dixon(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_orderkey"]).select("l_orderkey", "n", F.round("q", 6).alias("q"))


@query(
    "prediction_error",
    """SELECT l_returnflag, count(*) AS n, round(avg(e), 5) AS bias, round(sqrt(avg(e * e)), 5) AS rmsep, round(stddev_samp(e), 5) AS sep, round(1 - sum(e * e) / (var_pop(l_extendedprice) * count(*)), 7) AS r2
FROM (SELECT *, l_quantity * 1500 - l_extendedprice AS e FROM lineitem) GROUP BY 1""",
)
def prediction_error(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("predicted", F.col("l_quantity") * 1500)
    got = stats.prediction_error(rows, "predicted", "l_extendedprice", ["l_returnflag"])
    return got.select("l_returnflag", "n", F.round("bias", 5).alias("bias"), F.round("rmsep", 5).alias("rmsep"), F.round("sep", 5).alias("sep"), F.round("r2", 7).alias("r2"))


@query(
    "relative_rmsep",
    "SELECT l_linestatus, round(100 * sqrt(avg(pow((l_quantity * 1500 - l_extendedprice) / l_extendedprice, 2))), 5) AS relative_rmsep FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1",
)
def relative_rmsep(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("predicted", F.col("l_quantity") * 1500)
    return stats.relative_rmsep(rows, "predicted", "l_extendedprice", ["l_linestatus"]).select("l_linestatus", F.round("relative_rmsep", 5).alias("relative_rmsep"))


@query(
    "standard_addition",
    "SELECT l_suppkey, round(regr_intercept(l_extendedprice, l_quantity) / regr_slope(l_extendedprice, l_quantity), 5) AS found FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND regr_sxx(l_extendedprice, l_quantity) > 0",
)
def standard_addition(spark, sf_dir):
    got = stats.standard_addition(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_suppkey"], strict=False)
    return got.where("n >= 3 AND sxx > 0").select("l_suppkey", F.round("found", 5).alias("found"))


@query(
    "eco_scale",
    """SELECT n_name AS method, CAST(100 - sum(s_suppkey % 7) AS BIGINT) AS score, CASE WHEN 100 - sum(s_suppkey % 7) > 75 THEN 'excellent' WHEN 100 - sum(s_suppkey % 7) > 50 THEN 'acceptable' ELSE 'inadequate' END AS rating
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
)
def eco_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return stats.eco_scale(rows.select(F.col("n_name").alias("method"), (F.col("s_suppkey") % 7).alias("points"))).select("method", F.col("score").cast("long").alias("score"), "rating")


# Series

@query(
    "zero_crossings",
    """WITH v AS (SELECT user_id, event_id AS x, value - 50 AS y, lead(event_id) OVER w AS x1, lead(value - 50) OVER w AS y1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, round(CASE WHEN y = 0 THEN x ELSE x - y * (x1 - x) / (y1 - y) END, 5) AS root FROM v WHERE y1 IS NOT NULL AND (y = 0 OR y * y1 < 0)""",
)
def zero_crossings(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("y", F.col("y") - 50)
    return series.zero_crossings(rows, "user_id", "event_id", "x", "y").select("user_id", F.round("root", 5).alias("root"))


@query(
    "moving_average",
    "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events",
)
def moving_average(spark, sf_dir):
    return series.moving_average(events(spark, sf_dir), "user_id", "event_id", "y", 5).select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


@query(
    "running_median",
    "SELECT user_id, event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS median FROM events",
)
def running_median(spark, sf_dir):
    return ordered.running_median(events(spark, sf_dir), "user_id", "event_id", "y", 9).select("user_id", "event_id", F.round("median", 6).alias("median"))


@query(
    "running_median_wide",
    "SELECT user_id, event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 500 PRECEDING AND 500 FOLLOWING), 6) AS median FROM events",
)
def running_median_wide(spark, sf_dir):
    return ordered.running_median(events(spark, sf_dir), "user_id", "event_id", "y", 1001).select("user_id", "event_id", F.round("median", 6).alias("median"))


@query(
    "interpolation",
    """WITH v AS (SELECT user_id, event_id AS x, value AS y, lead(event_id) OVER w AS x1, lead(value) OVER w AS y1, min(event_id) OVER (PARTITION BY user_id) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT *, unnest(range(CAST(ceil((x - f) / 50.0) AS BIGINT), CASE WHEN x1 IS NULL THEN CASE WHEN (x - f) % 50 = 0 THEN (x - f) // 50 + 1 ELSE 0 END ELSE CAST(ceil((x1 - f) / 50.0) AS BIGINT) END)) AS k FROM v)
SELECT user_id, CAST(f + 50 * k AS DOUBLE) AS x, round(CASE WHEN x1 IS NULL THEN y ELSE y + (y1 - y) * (f + 50 * k - x) / (x1 - x) END + 1e-9, 6) AS y FROM k""",
)
def interpolation(spark, sf_dir):
    return series.resample(events(spark, sf_dir), "user_id", "x", "y", 50.0).select("user_id", "x", F.round(F.col("y") + 1e-9, 6).alias("y"))  # ties of rounding aside


@query(
    "longest_runs",
    """WITH v AS (SELECT user_id, event_id, value > 40 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
g AS (SELECT user_id, event_id, i - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM v WHERE f),
r AS (SELECT user_id, min(event_id) AS start, max(event_id) AS stop, count(*) AS n FROM g GROUP BY user_id, g)
SELECT user_id, start, stop, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, start) AS k FROM r) WHERE k = 1""",
)
def longest_runs(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("flag", F.col("y") > 40)
    return series.longest_runs(rows, "user_id", "event_id", "flag").select("user_id", "start", "stop", "n")


@query(
    "unlike_grids",
    f"""WITH {SPECTRA}, g AS (SELECT id, (id % 5) AS c, y, unnest(range(0, 70)) AS k FROM s),
p AS (SELECT id, c, y[1:64 - c] AS y, 1.0 + c / 8.0 AS d, k * (0.75 + c / 16.0) - 1 AS pos, k FROM g),
v AS (SELECT id, k, CASE WHEN pos >= 0 AND pos <= d * (len(y) - 1) THEN y[least(CAST(floor(pos / d) AS INTEGER), len(y) - 2) + 1]
 + (y[least(CAST(floor(pos / d) AS INTEGER), len(y) - 2) + 2] - y[least(CAST(floor(pos / d) AS INTEGER), len(y) - 2) + 1]) * (pos / d - least(CAST(floor(pos / d) AS INTEGER), len(y) - 2)) END AS v FROM p)
SELECT id AS vec_id, count(v) AS n_points, round(sum(v * (k + 1)), 4) AS checksum FROM v GROUP BY id""",
)
def unlike_grids(spark, sf_dir):
    """Each spectrum on a grid of its own (60 to 64 points), read on another of its own."""
    c = F.col("id") % 5
    df = spectra(spark, sf_dir).withColumn("y", F.slice("y", F.lit(1), (64 - c).cast("int"))).withColumn("x", F.transform("y", lambda _, i: i * (1 + c / 8)))
    grid = F.transform(F.sequence(F.lit(0), F.lit(69)), lambda k: k * (0.75 + c / 16) - 1)
    found = df.withColumn("found", series.resampled(F.col("x"), F.col("y"), grid))
    sums = F.aggregate(F.transform("found", lambda v, i: F.coalesce(v * (i + 1), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    return found.select(F.col("id").alias("vec_id"), F.size(F.array_compact("found")).cast("long").alias("n_points"), F.round(sums, 4).alias("checksum"))


@query(
    "figure_series",
    f"""WITH {SPECTRA}, b AS (SELECT id, b, y[b * 8 + 1:b * 8 + 8] AS v FROM s, range(0, 8) t(b)),
i AS (SELECT id, unnest(list_distinct([b * 8, b * 8 + list_position(v, list_min(v)) - 1, b * 8 + list_position(v, list_max(v)) - 1, b * 8 + 7])) AS i FROM b)
SELECT id AS vec_id, CAST(i AS DOUBLE) AS x, y[i + 1] AS y FROM i JOIN s USING (id)""",
)
def figure_series(spark, sf_dir):
    """What eight columns of pixels show of each vector."""
    drawn = views.decimated(spectra(spark, sf_dir), 8).withColumn("name", F.col("id").cast("string"))
    return views.figure_series(drawn).select(F.col("name").cast("long").alias("vec_id"), "x", "y")


@query(
    "extrema",
    # A point is as prominent as it stands above the higher of the lowest points on either side, up to where the line is higher than it.
    f"""WITH {SPECTRA}, b AS (SELECT id, 'max' AS kind, 1 AS f, y FROM s UNION ALL SELECT id, 'min', -1, list_transform(y, lambda v: -v) FROM s),
k AS (SELECT *, k FROM b, range(2, 64) t(k) WHERE y[k] > y[k - 1] AND y[k] > y[k + 1]),
e AS (SELECT *, coalesce(list_max(list_filter(range(1, k), lambda i: y[i] > y[k])), 0) AS l, coalesce(list_min(list_filter(range(k + 1, 65), lambda i: y[i] > y[k])), 65) AS r FROM k)
SELECT id, kind, CAST(k - 1 AS DOUBLE) AS at, round(f * y[k], 6) AS value FROM e
WHERE y[k] - greatest(list_min(y[l + 1:k - 1]), list_min(y[k + 1:r - 1])) >= 0.2 * (list_max(y) - list_min(y))""",
)
def extrema(spark, sf_dir):
    df = spectra(spark, sf_dir)
    found = df.lateralJoin(series.Extrema(F.col("x").outer(), F.col("y").outer(), F.lit(0.2)).alias("e"))
    return found.select("id", "e.kind", F.round("e.x", 6).alias("at"), F.round("e.y", 6).alias("value"))


@query(
    "plateaus",
    f"""WITH RECURSIVE {SPECTRA}, j AS (SELECT id, y, i, list_max(list_filter(range(i, 65), lambda j: list_max(y[i:j]) - list_min(y[i:j]) <= 0.3 * (list_max(y) - list_min(y)))) AS j FROM s, range(1, 64) t(i)),
w AS (SELECT id, CAST(1 AS BIGINT) AS i FROM s UNION ALL SELECT w.id, CASE WHEN j.j - j.i >= 4 THEN j.j ELSE j.i END + 1 FROM w JOIN j ON j.id = w.id AND j.i = w.i)
SELECT id, CAST(i - 1 AS DOUBLE) AS start, CAST(j - 1 AS DOUBLE) AS stop, round(list_avg(y[i:j]), 6) AS mean FROM w JOIN j USING (id, i) WHERE j - i >= 4""",
)
def plateaus(spark, sf_dir):
    df = spectra(spark, sf_dir)
    found = df.lateralJoin(series.Plateaus(F.col("x").outer(), F.col("y").outer(), F.lit(0.3), F.lit(4.0)).alias("p"))
    return found.select("id", "p.start", "p.stop", F.round("p.mean", 6).alias("mean"))


@query(
    "kaiser_selection",
    f"""WITH {SPECTRA}, a AS (SELECT i AS w, avg(y[i + 1]) FILTER (label % 2 = 0) AS a, avg(y[i + 1]) FILTER (label % 2 = 1) AS b FROM s, range(0, 64) t(i) GROUP BY i)
SELECT CAST(p.w AS DOUBLE) AS w1, CAST(q.w AS DOUBLE) AS w2, round(abs(p.a * q.b - q.a * p.b), 9) AS det FROM a p JOIN a q ON p.w < q.w ORDER BY abs(p.a * q.b - q.a * p.b) DESC, 1, 2 LIMIT 10""",
)
def kaiser_selection(spark, sf_dir):
    points = spectra(spark, sf_dir).select("label", F.explode(F.arrays_zip("x", "y")).alias("p")).select("label", "p.x", "p.y")
    mean = lambda odd: F.avg(F.when(F.col("label") % 2 == odd, F.col("y")))
    grid = points.groupBy(F.col("x").alias("w")).agg(mean(0).alias("a"), mean(1).alias("b"))
    return series.kaiser_pairs(grid).select("w1", "w2", F.round("det", 9).alias("det"))


# The 24 levels of the cyclic five-level design.
_CYCLE = "[-2, 0, 1, 1, -1, -2, -1, 0, -2, -2, 2, -1, 2, 0, -1, -1, 1, 2, 1, 0, 2, 2, -2, 1]"


@query(
    "experimental_design",
    f"""SELECT s_suppkey, r AS run, round(CAST(100 + CASE WHEN r = 0 THEN 0 ELSE {_CYCLE}[(r - 1) % 24 + 1] * 2.5 END AS DOUBLE), 6) AS c1,
round(s_acctbal + CAST(CASE WHEN r = 0 THEN 0 ELSE {_CYCLE}[r % 24 + 1] * (1 + s_nationkey) END AS DOUBLE), 6) AS c2 FROM supplier, range(0, 25) t(r)""",
)
def experimental_design(spark, sf_dir):
    """The design around each supplier's balance."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(100.0).alias("m1"), F.lit(2.5).alias("d1"), F.col("s_acctbal").alias("m2"), (F.col("s_nationkey") + 1.0).alias("d2"))
    return series.designs(rows, ["m1", "m2"], ["d1", "d2"]).select("s_suppkey", "run", "c1", "c2")


@query(
    "concentrations_from_name",
    "SELECT p_partkey, CAST(regexp_extract(p_brand, 'Brand[ _=:#-]*([0-9]+)', 1) AS DOUBLE) AS brand FROM part",
)
def concentrations_from_name(spark, sf_dir):
    named = series.concentrations_from_name(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")), ["Brand"])
    return table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(named, F.lit("Brand")).alias("brand"))


# Joins, trees and the audit chain

@query(
    "usage",
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
)
def usage(spark, sf_dir):
    """Documents that refer to any of some records: a semi join on exploded references."""
    refs = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(refs, "o_orderkey", "left_semi").select("o_orderkey")


@query("not_undone", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_undone(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query(
    "lineage",
    """WITH RECURSIVE t AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_nationkey AS BIGINT) AS ancestor, 0 AS depth FROM nation
UNION ALL SELECT node, ancestor // 2, depth + 1 FROM t WHERE ancestor > 0) SELECT node, ancestor, depth FROM t""",
)
def lineage(spark, sf_dir):
    """Each nation's line of parents, the parent of k being k div 2."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    edges = nodes.where("node > 0").select(F.col("node").alias("child"), F.expr("node div 2").alias("parent"))
    return series.ascend(edges, nodes)


@query(
    "audit_chain",
    """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
c AS (SELECT user_id, i, sha256('genesis' || chr(31) || event_id || chr(31) || event_type) AS h FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.i, sha256(c.h || chr(31) || e.event_id || chr(31) || e.event_type) FROM c JOIN e ON e.user_id = c.user_id AND e.i = c.i + 1)
SELECT user_id, max(i) AS n, arg_max(h, i) AS head FROM c GROUP BY user_id""",
)
def audit_chain(spark, sf_dir):
    """Head of each user's hash chain."""
    return chain.heads(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_id", "event_type"])


@query(
    "audit_altered",
    """WITH e AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, event_id, 'content' AS problem FROM e WHERE event_id % 97 = 5 AND event_id % 89 <> 7
UNION ALL SELECT user_id, event_id, 'link' FROM e WHERE before % 89 = 7 AND event_id % 89 <> 7
UNION ALL SELECT e.user_id, e.event_id, 'link' FROM e JOIN (SELECT user_id, min(event_id) AS first, min(event_id) FILTER (event_id % 89 <> 7) AS left FROM e GROUP BY user_id) f ON e.user_id = f.user_id AND e.event_id = f.left AND f.left <> f.first AND e.before % 89 <> 7""",
)
def audit_altered(spark, sf_dir):
    """Entries whose type was changed afterwards, and those whose predecessor was taken out."""
    made = checkpoint(chain.chained(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", ["event_id", "event_type"]))
    changed = made.withColumn("event_type", F.when(F.col("event_id") % 97 == 5, "other").otherwise(F.col("event_type"))).where("event_id % 89 <> 7")
    return chain.altered(changed, "user_id", "event_id", ["event_id", "event_type"])


@query(
    "audit_search",
    "SELECT event_id, event_type FROM events WHERE event_type ILIKE '%e%' ORDER BY event_id DESC LIMIT 200",
)
def audit_search(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("event_type").ilike("%e%"))
    return rows.orderBy(F.desc("event_id")).limit(200).select("event_id", "event_type")


# Ready-made methods by their names, on vectors taken as spectra from 200 nm in steps of 2.5

def _slope(v: str, i: str = "i") -> str:
    """The derivative at a point, given what v is there."""
    return f"(({v.replace('[i]', f'[{i} + 1]')}) - ({v.replace('[i]', f'[{i} - 1]')})) / 5"


def _over(v: str, a: int, b: int, by: str = "list_avg") -> str:
    return f"{by}(list_transform(range({a}, {b + 1}), lambda i: {v}))"


_Q, _QD = "y[i] / d[i]", "y[i] / (d[i] + e[i])"
_AT = lambda v, i: v.replace("[i]", f"[{i}]")
_FIT = f"({_over('(y[i] - ' + _over('y[k] / d[k]', 41, 49).replace('lambda i', 'lambda k') + ' * d[i]) * e[i]', 1, 64, 'list_sum')} / {_over('e[i] * e[i]', 1, 64, 'list_sum')})"
#: Name, parameters set for the steps in their order, for the measurement, and the signal in SQL (point 25 is 260 nm).
_READY = (
    ("Direct (zero order, λmax)", (), {}, "y[25]"),
    ("Zero-crossing derivative (D1)", ({"delta_lambda": 5.0},), {}, _slope("y[i]", "25")),
    ("Derivative peak-to-peak", ({"delta_lambda": 5.0},), {}, f"{_over(_slope('y[i]'), 17, 41, 'list_max')} - {_over(_slope('y[i]'), 17, 41, 'list_min')}"),
    ("Dual wavelength", (), {}, "y[21] - y[33]"),
    ("Induced dual wavelength", (), {"factor": 0.5}, "y[21] - 0.5 * y[33]"),
    ("Dual wavelength in derivative mode", ({"delta_lambda": 5.0},), {}, f"{_slope('y[i]', '21')} - {_slope('y[i]', '33')}"),
    ("Area under curve (single component)", (), {}, _over("(y[i] + y[i + 1]) / 2 * 2.5", 17, 32, "list_sum")),
    ("Derivative ratio (DD1)", ({"reference": 0, "threshold": 0}, {"delta_lambda": 5.0}), {}, _slope(_Q, "25")),
    ("Ratio difference (RD)", ({"reference": 0, "threshold": 0},), {}, f"{_AT(_Q, 21)} - {_AT(_Q, 33)}"),
    ("Mean centering of ratio spectra (MCR)", ({"reference": 0, "threshold": 0}, {}), {}, f"{_AT(_Q, 25)} - {_over(_Q, 9, 41)}"),
    ("Double divisor ratio derivative (ternary)", ({"reference": 0, "reference2": 1, "threshold": 0}, {"delta_lambda": 5.0}), {}, _slope(_QD, "25")),
    ("Dual amplitude difference (ternary)", ({"reference": 0, "threshold": 0},), {"factor": 0.5}, f"{_AT(_Q, 17)} - 0.5 * {_AT(_Q, 25)}"),
    ("Extended ratio subtraction (Y)", ({"divisor": 0, "reference": 1},), {}, f"y[31] - {_FIT} * e[31]"),
    ("Ratio subtraction / spectrum subtraction (X)", ({"divisor": 0},), {}, f"y[25] - {_over(_Q, 41, 49)} * d[25]"),
    ("Constant multiplication / SS-CM (extended Y)", ({"divisor": 0},), {}, f"{_over(_Q, 41, 49)} * d[25]"),
    ("Ratio plateau / constant value (Y)", ({"reference": 0, "threshold": 0},), {}, _over(_Q, 41, 49)),
    ("Spectrum subtraction", ({"reference": 0, "wavelength": 300.0},), {}, "y[25] - y[41] / d[41] * d[25]"),
    ("Factorized zero-order (FZM)", ({"reference": 0, "wavelength": 300.0, "derivative_order": 0},), {}, "y[41] / d[41] * d[25]"),
    ("Concentration value (unit divisor plateau, no regression)", ({"reference": 0, "threshold": 0},), {}, _over(_Q, 53, 54)),
)


@query(
    "template_signals",
    f"WITH {REFS} SELECT id AS vec_id, {', '.join(f'round({sql}, 4) AS s{k}' for k, (*_, sql) in enumerate(_READY))} FROM s, d, e",
)
def template_signals(spark, sf_dir):
    """The signals of nineteen ready-made methods, all read from one scan."""
    df = spectra(spark, sf_dir).withColumn("x", F.transform("x", lambda v: 200 + 2.5 * v))
    grid = [200 + 2.5 * i for i in range(64)]
    library = pl.Library.of(df, [{"op": "divide_sum", "params": {"reference": 0, "reference2": 1}}])
    out = df
    for k, (name, set_, measured, _) in enumerate(_READY):
        t = methods.TEMPLATES[name]
        steps = [{"op": s["op"], "params": s["params"] | given} for s, given in zip(t["steps"], set_)]
        measurement = t["measurement"] | {"params": t["measurement"]["params"] | measured}
        out = pl.signals(out, steps, measurement, library, out=f"s{k}", grid=grid)
    return out.select(F.col("id").alias("vec_id"), *(F.round(f"s{k}", 4).alias(f"s{k}") for k in range(len(_READY))))


@query(
    "signal_equations_of_vectors",
    f"""WITH {SPECTRA}, v AS (SELECT id, label + 1.0 AS a, id % 9 + 1.0 AS b, y[11] - y[12] AS r, y[31] + 2.0 AS q FROM s),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * r) AS ar, sum(b * r) AS br, sum(a * q) AS aq, sum(b * q) AS bq FROM v),
k AS (SELECT (ar * bb - br * ab) / (aa * bb - ab * ab) AS kar, (br * aa - ar * ab) / (aa * bb - ab * ab) AS kbr, (aq * bb - bq * ab) / (aa * bb - ab * ab) AS kaq, (bq * aa - aq * ab) / (aa * bb - ab * ab) AS kbq FROM g)
SELECT id AS vec_id, round((r * kbq - q * kbr) / (kar * kbq - kaq * kbr), 3) AS a, round((q * kar - r * kaq) / (kar * kbq - kaq * kbr), 3) AS b FROM v, k""",
)
def signal_equations_of_vectors(spark, sf_dir):
    """Two amounts from two signals, calibrated on all vectors by one aggregation."""
    amounts = F.create_map(F.lit("A"), F.col("label") + 1.0, F.lit("B"), F.col("id") % 9 + 1.0)
    df = spectra(spark, sf_dir).withColumn("concentrations", amounts)
    raised = [{"op": "offset", "params": {"value": 2.0}}]
    signals = [{"measurement": {"kind": "difference", "params": {"w1": 10.0, "w2": 11.0}}}, {"steps": raised, "measurement": {"kind": "amplitude", "params": {"w1": 30.0}}}]
    got = methods.SignalEquations(["A", "B"], signals).fit(df).predict(df)
    return got.select(F.col("id").alias("vec_id"), F.round("found_A", 3).alias("a"), F.round("found_B", 3).alias("b"))


@query(
    "univariate_of_vectors",
    f"""WITH {SPECTRA}, v AS (SELECT id, label AS c, (y[12] - y[10]) / 2 - (y[42] - y[40]) / 2 + 0.1 * label AS r FROM s)
SELECT id AS vec_id, round((r - (SELECT regr_intercept(r, c) FROM v)) / (SELECT regr_slope(r, c) FROM v), 4) AS found FROM v""",
)
def univariate_of_vectors(spark, sf_dir):
    """A dual-wavelength derivative method calibrated on all vectors and read back."""
    df = spectra(spark, sf_dir)
    tilted = df.withColumn("y", F.transform("y", lambda v, i: v - F.col("label") * 0.05 * i * (i - 51) / 30))
    # Of the added parabola the derivatives at 10 and 40 differ by a tenth of the label.
    method = methods.Univariate("A", [{"op": "derivative", "params": {"order": 1, "delta_lambda": 2.0}}], {"kind": "difference", "params": {"w1": 10.0, "w2": 40.0}})
    rows = tilted.withColumn("concentrations", F.create_map(F.lit("A"), F.col("label").cast("double")))
    return method.fit(rows).predict(rows).select(F.col("id").alias("vec_id"), F.round("found_A", 4).alias("found"))


@query(
    "q_analysis_of_vectors",
    f"""WITH {SPECTRA}, v AS (SELECT id, abs(y[11]) + 1 AS i, abs(y[21]) + 0.5 AS o FROM s)
SELECT id AS vec_id, round((o / i - 0.4) / (1.3 - 0.4) * i / 0.02, 6) AS a, round((1 - (o / i - 0.4) / (1.3 - 0.4)) * i / 0.02, 6) AS b FROM v""",
)
def q_analysis_of_vectors(spark, sf_dir):
    a, b = methods.q_analysis(1.3, 0.4, 0.02)(F.abs(F.get("y", F.lit(10))) + 1, F.abs(F.get("y", F.lit(20))) + 0.5)
    return spectra(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


# Spectra derived from derived ones, every row by a pipeline of its own

@query(
    "derived_levels",
    f"""WITH {SPECTRA}, r AS (SELECT id AS r, y AS d FROM s WHERE id < 7), v AS (SELECT id, list_transform(range(1, 65), lambda i: y[i] * (1 + id % 3)) AS a, d FROM s JOIN r ON r = id % 7),
b AS (SELECT id, a, list_transform(range(1, 65), lambda i: a[i] - 0.5 * d[i]) AS b FROM v),
u AS (SELECT id + 1000000 AS id, 1 AS level, a AS y FROM b UNION ALL SELECT id + 2000000, 2, b FROM b UNION ALL SELECT id + 3000000, 3, list_transform(range(11, 52), lambda i: b[i] + 0.25) FROM b)
SELECT id AS vec_id, level, CAST(len(y) AS BIGINT) AS n_points, round(list_sum(list_transform(range(1, len(y) + 1), lambda i: y[i] * i)), 4) AS checksum FROM u""",
)
def derived_levels(spark, sf_dir):
    """Three generations: scaled, less half of one of seven vectors, cropped and raised."""
    raw = spectra(spark, sf_dir)
    step = lambda op, **params: F.struct(F.lit(op).alias("op"), F.struct(*(v.alias(n) for n, v in params.items())).alias("params"))
    kinds = {
        1: F.to_json(F.array(step("scale", factor=1 + F.col("id") % 3))),
        2: F.to_json(F.array(step("subtract", reference=F.col("id") % 7, factor=F.lit(0.5)))),
        3: F.concat(F.lit("["), F.to_json(step("crop", start=F.lit(10.0), end=F.lit(50.0))), F.lit(","), F.to_json(step("offset", value=F.lit(0.25))), F.lit("]")),
    }
    plans = [raw.select((F.col("id") + k * 1000000).alias("id"), (F.col("id") + (k - 1) * 1000000).alias("parent"), text.alias("pipeline")) for k, text in kinds.items()]
    made = derived.derive(raw, plans[0].unionByName(plans[1]).unionByName(plans[2]))
    levels = made.select("id", "level")
    return _checksum(made.where("_error IS NULL").select("id", "y")).join(levels.withColumnRenamed("id", "vec_id"), "vec_id")


# Files written by tasks and read in parts

@query("files_in_parts", f"WITH {SPECTRA} SELECT id AS vec_id, CAST(len(y) AS BIGINT) AS n_points, round(list_sum(list_transform(y, lambda v, i: v * i)), 4) AS checksum FROM s")
def files_in_parts(spark, sf_dir):
    """Spectra written as compound JCAMP files, each of which several tasks read."""
    folder = fresh_folder(spark, "jcamp")
    blocks.write(spectra(spark, sf_dir).withColumn("name", F.concat(F.lit("vector "), F.col("id").cast("string"))), folder, per_file=250)
    back = blocks.read(spark, folder, part_bytes=1 << 16)
    return _checksum(back.select(F.substring_index("name", " ", -1).cast("long").alias("id"), "y"))


@query("files_by_name", f"WITH {SPECTRA} SELECT id AS vec_id, CAST(len(y) AS BIGINT) AS n_points, round(list_sum(list_transform(y, lambda v, i: CAST(v AS FLOAT) * i)), 4) AS checksum FROM s WHERE id IN (3, 77, 250)")
def files_by_name(spark, sf_dir):
    """Three spectra by name from such files: the source is handed the filter and parses no others."""
    folder = fresh_folder(spark, "jcamp")
    blocks.write(spectra(spark, sf_dir).withColumn("name", F.concat(F.lit("vector "), F.col("id").cast("string"))), folder)
    back = blocks.read(spark, folder, part_bytes=1 << 16).where(F.col("name").isin("vector 3", "vector 77", "vector 250"))
    return _checksum(back.select(F.substring_index("name", " ", -1).cast("long").alias("id"), "y"))


# Calibration by normal equations, cross-validation

@query(
    "multiple_regression",
    """WITH a AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_tax) AS b, sum(l_tax * l_tax) AS d, sum(l_quantity * l_extendedprice) AS u, sum(l_tax * l_extendedprice) AS v FROM lineitem)
SELECT round((u * d - b * v) / (a * d - b * b), 5) AS k1, round((a * v - b * u) / (a * d - b * b), 3) AS k2 FROM a""",
)
def multiple_regression(spark, sf_dir):
    """Least squares of two responses by their Gram matrix, one pass over the rows."""
    q, t, e = (F.col(c) for c in ("l_quantity", "l_tax", "l_extendedprice"))
    g = table(spark, sf_dir, "lineitem").agg(F.sum(q * q).alias("a"), F.sum(q * t).alias("b"), F.sum(t * t).alias("d"), F.sum(q * e).alias("u"), F.sum(t * e).alias("v"))
    return g.selectExpr("round((u * d - b * v) / (a * d - b * b), 5) AS k1", "round((a * v - b * u) / (a * d - b * b), 3) AS k2")


@query(
    "cross_validation",
    """WITH v AS (SELECT l_quantity AS x, l_extendedprice AS y, l_orderkey % 5 AS fold FROM lineitem),
p AS (SELECT fold, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM v GROUP BY fold), a AS (SELECT sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM p),
m AS (SELECT p.*, ((a.n - p.n) * (a.xy - p.xy) - (a.x - p.x) * (a.y - p.y)) / ((a.n - p.n) * (a.xx - p.xx) - (a.x - p.x) ** 2) AS b, a.x - p.x AS rx, a.y - p.y AS ry, a.n - p.n AS rn FROM p, a),
c AS (SELECT *, (ry - b * rx) / rn AS c0 FROM m)
SELECT CAST(fold AS BIGINT) AS fold, n, round(sqrt((yy - 2 * b * xy - 2 * c0 * y + b * b * xx + 2 * b * c0 * x + n * c0 * c0) / n), 3) AS rmsecv FROM c""",
)
def cross_validation(spark, sf_dir):
    """Error of a line in each of five folds, from the folds' sums: the rows are read once."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_orderkey") % 5).alias("fold"))
    x, y = F.col("x"), F.col("y")
    p = v.groupBy("fold").agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"))
    every = W.partitionBy(F.lit(0))  # five rows
    rest = {c: F.sum(c).over(every) - F.col(c) for c in ("n", "x", "y", "xx", "xy")}
    p = p.select("*", *(r.alias(f"r_{c}") for c, r in rest.items()))
    p = p.withColumn("b", (F.col("r_n") * F.col("r_xy") - F.col("r_x") * F.col("r_y")) / (F.col("r_n") * F.col("r_xx") - F.col("r_x") * F.col("r_x")))
    p = p.withColumn("c0", (F.col("r_y") - F.col("b") * F.col("r_x")) / F.col("r_n"))
    return p.selectExpr("fold", "n", "round(sqrt((yy - 2 * b * xy - 2 * c0 * y + b * b * xx + 2 * b * c0 * x + n * c0 * c0) / n), 3) AS rmsecv")


# Linear models fitted on a whole table from its Gram matrix: the label of a vector from its points

def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).withColumn("concentrations", F.create_map(F.lit("A"), F.col("label").cast("double")))


_POINTS = f"{SPECTRA}, p AS (SELECT id, label, unnest(y) AS v, generate_subscripts(y, 1) AS i FROM s)"


def _found(kind: str, **ask):
    def run(spark, sf_dir):
        df = labelled(spark, sf_dir)
        return SpectralModel(["A"], kind, 1, **ask).fit(df).predict(df).select(F.col("id").alias("vec_id"), F.round("found_A", 5).alias("found"))

    return run


query(
    "calibration_ils",
    f"""WITH {SPECTRA}, v AS (SELECT id, label AS c, y[4] AS a, y[18] AS b FROM s),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc FROM v)
SELECT id AS vec_id, round(mc + ((ac * bb - bc * ab) * (a - ma) + (bc * aa - ac * ab) * (b - mb)) / (aa * bb - ab * ab), 5) AS found FROM v, m""",
)(_found("ils", wavelengths=[3.0, 17.0]))

query(
    "calibration_cls",
    f"""WITH {_POINTS}, w AS (SELECT i, avg(v) AS m, covar_pop(v, label) / var_pop(label) AS k FROM p GROUP BY i)
SELECT id AS vec_id, round((SELECT avg(label) FROM s) + sum((v - m) * k) / (SELECT sum(k * k) FROM w), 5) AS found FROM p JOIN w USING (i) GROUP BY id""",
)(_found("cls"))

query(
    "calibration_pls",
    f"""WITH {_POINTS}, w AS (SELECT i, avg(v) AS m, covar_pop(v, label) AS k FROM p GROUP BY i),
t AS (SELECT id, any_value(label) AS c, sum((v - m) * k) AS t FROM p JOIN w USING (i) GROUP BY id)
SELECT id AS vec_id, round((SELECT avg(c) FROM t) + t * (SELECT covar_pop(t, c) / var_pop(t) FROM t), 5) AS found FROM t""",
)(_found("pls1"))


@query(
    "calibration_left_out",
    f"""WITH {_POINTS}, f AS (SELECT unnest(range(0, 5)) AS f),
w AS (SELECT f, i, avg(v) AS m, covar_pop(v, label) AS k FROM f JOIN p ON id % 5 <> f GROUP BY f, i),
t AS (SELECT f, id, any_value(label) AS c, sum((v - m) * k) AS t FROM p JOIN w USING (i) GROUP BY f, id),
q AS (SELECT f, avg(c) AS mc, covar_pop(t, c) / var_pop(t) AS q FROM t WHERE id % 5 <> f GROUP BY f)
SELECT CAST(f AS BIGINT) AS fold, count(*) AS n, round(sqrt(avg((mc + q * t - c) ** 2)), 6) AS rmsecv FROM t JOIN q USING (f) WHERE id % 5 = f GROUP BY f""",
)
def calibration_left_out(spark, sf_dir):
    """Error of a PLS component in each fold of vectors, from one scan for all folds."""
    parts = gram.gram(labelled(spark, sf_dir), ["A"], 5, F.col("id") % 5)
    errors = gram.press(SpectralModel(["A"], "pls1", 1), parts)[:, 0, 0]
    rows = [(f, int(p.n), float((e / p.n) ** 0.5)) for f, (p, e) in enumerate(zip(parts, errors))]
    return spark.createDataFrame(rows, "fold long, n long, rmsecv double").withColumn("rmsecv", F.round("rmsecv", 6))


QUERIES.update(catalog_models.QUERIES)
