"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes.

Budgets go down a tree domain - language - source. A node can take at most its leaves' tokens
times ``max_epochs``. Among the children of a node the budget is filled in proportion to their
weights; what a child cannot take is shared by its siblings, again by weight, and because a
child's limit is that of its whole subtree, only what a whole subtree lacks goes to its
parent's siblings. All in integers, so any engine gets the same budgets.

A leaf with budget b and T tokens takes b div T whole epochs, then, from the next epoch, the
longest prefix within b mod T. An epoch's order is that of md5(seed:epoch:doc_id), ties by
number of tokens. Prefix sums are taken over 4096 ranges of that key first and then inside the
one range where a leaf's prefix ends, so no leaf is brought together in one task.

Null languages and sources count as the empty name; names without a weight have ``other``.
Documents without tokens cost nothing and come with the prefix that reaches them; a leaf
without any tokens gives nothing. Rows that repeat a doc_id are drawn each; rows alike in all
columns are counted first, so a doc_id of many rows is no load for one task. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lambertlake.llm import runtime

LEVELS = ("domain", "lang", "source")
#: Target weights, in whole numbers, of names by level; ``other`` for the rest.
WEIGHTS = {
    "domain": {"d0": 50, "d1": 30, "d2": 20, "other": 10},
    "lang": {"en": 40, "de": 20, "fr": 20, "es": 20, "other": 10},
    "source": {"other": 10},
}
SEED = 17
#: Copies of a row that are made at once.
CHUNK = 1024
#: The budget, as a share of all tokens.
SHARE = (9, 10)


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r]+")).cast("long")


def domain_of(source: Column) -> Column:
    """Sources by the number at their end, modulo 3."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("d"), (F.when(number != "", number).cast("long") % 3).cast("string")))


def _weight(level: str, weights: dict) -> Column:
    known = weights[level]
    out = F.lit(known["other"])
    for name, w in known.items():
        if name != "other":
            out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(12,0)")


def _whole(x: Column) -> Column:
    return x.cast("decimal(24,0)")



def _filled(nodes: DataFrame, level: str, weights: dict) -> DataFrame:
    """``nodes`` (with cap, and budget of their parent) with their own share in budget."""
    above = LEVELS[: LEVELS.index(level)]
    nodes = nodes.withColumn("w", _weight(level, weights)).where("w > 0")
    parent = W.partitionBy(*above) if above else W.partitionBy(F.lit(0))
    order = parent.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), level)
    nodes = nodes.withColumn("s", F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
    nodes = nodes.withColumn("ws", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    left = "CAST(budget AS DECIMAL(24,0)) - s"
    nodes = nodes.withColumn("full", F.expr(f"cap <= CAST(w AS DECIMAL(12,0)) * ({left}) DIV ws"))
    nodes = nodes.withColumn("s0", F.min(F.when(~F.col("full"), F.col("s"))).over(parent))
    nodes = nodes.withColumn("w0", F.max(F.when(~F.col("full"), F.col("ws"))).over(parent))
    own = F.expr("CASE WHEN full THEN cap ELSE CAST(w * (CAST(budget AS DECIMAL(24,0)) - s0) DIV w0 AS DECIMAL(24,0)) END")
    return nodes.withColumn("budget", own).drop("w", "s", "ws", "full", "s0", "w0")


def leaf_budgets(leaves: DataFrame, share: tuple[int, int], max_epochs: int, weights: dict) -> DataFrame:
    """domain, lang, source, tokens, budget, of leaves with their tokens."""
    caps = leaves.withColumn("cap", _whole(F.col("tokens") * max_epochs))
    domains = caps.groupBy("domain").agg(_whole(F.sum("cap")).alias("cap"), _whole(F.sum("tokens")).alias("tokens"))
    total = F.sum("tokens").over(W.partitionBy(F.lit(0)))
    domains = domains.withColumn("all", total).withColumn("budget", F.expr(f"CAST(`all` * {share[0]} DIV {share[1]} AS DECIMAL(24,0))")).drop("all", "tokens")
    domains = _filled(domains, "domain", weights).select("domain", "budget")
    langs = caps.groupBy("domain", "lang").agg(_whole(F.sum("cap")).alias("cap")).join(domains, "domain")
    langs = _filled(langs, "lang", weights).select("domain", "lang", "budget")
    return _filled(caps.join(langs, ["domain", "lang"]), "source", weights).select(*LEVELS, "tokens", F.col("budget").cast("long").alias("budget"))


def mix(
    docs: DataFrame, share: tuple[int, int] = SHARE, max_epochs: int = 2, seed: int = SEED, weights: dict = WEIGHTS
) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: one row for each time a document is taken.

    ``docs`` has doc_id, domain, lang, source and n_tokens.
    """
    rows = docs.select("doc_id", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEVELS), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    # Written once: identifiers and counts, so that texts are read once. Rows alike in all are one row with their number.
    rows = runtime.checkpoint(rows.groupBy("doc_id", *LEVELS, "n_tokens").agg(F.count("*").alias("copies")))
    leaves = rows.groupBy(*LEVELS).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    budgets = leaf_budgets(leaves.where("tokens > 0"), share, max_epochs, weights)
    budgets = budgets.select(*LEVELS, F.expr("CAST(budget DIV tokens AS INT)").alias("whole"), F.expr("budget % tokens").alias("rest"))
    drawn = rows.join(budgets, list(LEVELS))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = drawn.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), ident).cast("binary")))
    drawn = drawn.withColumn("range", F.substring("key", 1, 3)).withColumn("all", F.col("n_tokens") * F.col("copies"))
    ranges = drawn.groupBy(*LEVELS, "range").agg(F.sum("all").alias("sum"))
    upto = F.sum("sum").over(W.partitionBy(*LEVELS).orderBy("range").rowsBetween(W.unboundedPreceding, 0))
    ranges = ranges.withColumn("upto", upto).select(*LEVELS, "range", (F.col("upto") - F.col("sum")).alias("before"), "upto")
    drawn = drawn.join(ranges, [*LEVELS, "range"])
    # Only rows of the range in which the prefix ends are put in order.
    clear = drawn.where((F.col("upto") <= F.col("rest")) | (F.col("before") > F.col("rest")))
    clear = clear.withColumn("more", F.when(F.col("upto") <= F.col("rest"), F.col("copies")).otherwise(0))
    inside = W.partitionBy(*LEVELS, "range").orderBy("key", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    split = drawn.where((F.col("upto") > F.col("rest")) & (F.col("before") <= F.col("rest")))
    split = split.withColumn("left", F.col("rest") - F.col("before") - (F.sum("all").over(inside) - F.col("all")))
    reached = F.expr("CASE WHEN left < 0 THEN 0 WHEN n_tokens = 0 THEN copies ELSE least(copies, left DIV n_tokens) END")
    split = split.withColumn("more", reached).drop("left")
    taken = clear.unionByName(split).withColumn("epoch", F.explode(F.expr("sequence(0, whole)")))
    taken = taken.withColumn("times", F.when(F.col("epoch") < F.col("whole"), F.col("copies")).otherwise(F.col("more"))).where("times > 0")
    # As many rows as copies, in two steps so that no array is long.
    taken = taken.withColumn("chunk", F.explode(F.expr(f"sequence(0, (times - 1) DIV {CHUNK})")))
    taken = taken.withColumn("one", F.explode(F.expr(f"array_repeat(0, CAST(least({CHUNK}, times - chunk * {CHUNK}) AS INT))")))
    return taken.select("doc_id", *LEVELS, "n_tokens", "epoch")


def measured(docs: DataFrame) -> DataFrame:
    """What mix() takes, of a table of documents."""
    return docs.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", words(F.col("text")).alias("n_tokens"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(measured(runtime.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))


def _case(level: str) -> str:
    known = "".join(f" WHEN {level} = '{n}' THEN {w}" for n, w in WEIGHTS[level].items() if n != "other")
    other = WEIGHTS[level]["other"]
    return f"CAST(CASE{known} ELSE {other} END AS HUGEINT)" if known else f"CAST({other} AS HUGEINT)"


def _filled_sql(name: str, source: str, level: str) -> str:
    above = ", ".join(LEVELS[: LEVELS.index(level)])
    by = f"PARTITION BY {above}" if above else ""
    keys = ", ".join(LEVELS[: LEVELS.index(level) + 1])
    return f"""
{name}_a AS (SELECT *, {_case(level)} AS w FROM ({source})),
{name}_b AS (
  SELECT *, sum(cap) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {level} ROWS UNBOUNDED PRECEDING) - cap AS s,
         sum(w) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM {name}_a
),
{name}_c AS (SELECT *, cap <= w * (budget - s) // ws AS filled FROM {name}_b),
{name}_d AS (
  SELECT *, min(CASE WHEN NOT filled THEN s END) OVER ({by}) AS s0, max(CASE WHEN NOT filled THEN ws END) OVER ({by}) AS w0 FROM {name}_c
),
{name} AS (SELECT {keys}, CASE WHEN filled THEN cap ELSE w * (budget - s0) // w0 END AS budget FROM {name}_d)"""


OP3_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
              ELSE 'd' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 3) END AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS BIGINT) AS n_tokens
  FROM documents
),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0),
caps AS (SELECT *, tokens * 2 AS cap FROM leaves),
{_filled_sql('by_domain', "SELECT domain, CAST(sum(cap) AS HUGEINT) AS cap, CAST((SELECT sum(tokens) FROM leaves) AS HUGEINT) * 9 // 10 AS budget FROM caps GROUP BY domain", "domain")},
{_filled_sql('by_lang', "SELECT domain, lang, c.cap, budget FROM (SELECT domain, lang, CAST(sum(cap) AS HUGEINT) AS cap FROM caps GROUP BY ALL) c JOIN by_domain USING (domain)", "lang")},
{_filled_sql('by_source', "SELECT domain, lang, source, cap, budget FROM caps JOIN by_lang USING (domain, lang)", "source")},
plan AS (
  SELECT domain, lang, source, CAST(budget // tokens AS INTEGER) AS whole, CAST(budget % tokens AS BIGINT) AS rest
  FROM by_source JOIN leaves USING (domain, lang, source)
),
drawn AS (
  SELECT docs.*, whole, rest, md5('{SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM docs JOIN plan USING (domain, lang, source)
),
summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens ROWS UNBOUNDED PRECEDING) <= rest AS more FROM drawn
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, whole + CASE WHEN more THEN 1 ELSE 0 END)) AS INTEGER) AS epoch
FROM summed
"""
