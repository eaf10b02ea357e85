"""How filters interact, in every order: sorted posting lists and galloping merges.

Each filter has, for each part (language), the sorted list of the documents that fail it; two
more lists hold the documents labelled good and those labelled toxic. Lists are dealt out by
ranges of (part, doc_id), so that all lists of a range meet in one task whatever a part's size,
and a task holds one batch of a range at a time. There the lists are merged: the merge gallops
over runs that are in one list only, and counts the documents of every exclusive region; sizes
of unions and differences are sums of regions and are added up over ranges. With the union's
size of each set of filters, every order of the filters is arithmetic:

* removed by f after the set S: size(S + f) - size(S); kept: all - size(S + f)
* redundant: size(f) - removed; failing f only: size(all filters) - size(all but f)

Filters (null text: empty; words are runs without space, tab and \\n \\v \\f \\r): A under 200
words, B less than half of the words distinct, C more than 3 % capitals A-Z, D one of #$%&*|,
E the text of a smaller doc_id anywhere in the table. Every row is a document, also where rows
repeat a doc_id: such rows are no copies of one another for E, all have the labels of their
doc_id, of which one suffices where labels repeat. Rows without doc_id are nobody's original,
never fail E and have no labels. A null language is the part ''. Other columns are ignored,
whatever their names; an empty table has no parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lambertlake.llm import runtime

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SETS = 1 << len(FILTERS)
#: Lists of the labels, numbered after those of the filters.
GOOD, TOXIC = len(FILTERS), len(FILTERS) + 1
LISTS = len(FILTERS) + 2

#: For each set of filters, which regions (bits: the lists that hold a document) are in its union.
_REGION = np.arange(1 << LISTS)
_IN = ((_REGION[None, :] & np.arange(SETS)[:, None]) != 0).astype(np.int64)
_IN_GOOD, _IN_TOXIC = _IN * (_REGION >> GOOD & 1), _IN * (_REGION >> TOXIC & 1)


def failing(text: str = "text") -> dict[str, F.Column]:
    """The failure condition of each filter that sees one text only."""
    text = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    number, chars = F.size(words).cast("long"), F.char_length(text).cast("long")
    capitals = chars - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": number < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * number,
        "C": 100 * capitals > 3 * chars,
        "D": text.rlike("[#$%&*|]"),
    }


def postings(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists' entries (part, doc_id, row, list) and each part's number of documents (part, documents).

    ``row`` tells apart rows that share a doc_id.
    """
    text = F.coalesce("text", F.lit(""))
    mask = sum(F.when(failed, 1 << FILTERS.index(name)).otherwise(0) for name, failed in failing().items())
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"),
        mask.cast("int").alias("mask"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = runtime.checkpoint(rows)  # the texts are read once; row keeps its value
    first = rows.where("doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"))
    # Written first: then the join has two plain sides, and a hot text can be split.
    first = runtime.checkpoint(first.where("first < _last").drop("_last"))
    entry = ["part", "doc_id", "row"]
    copies = rows.join(first, "same").where("doc_id > first").select(*entry, F.lit(FILTERS.index("E")).alias("list"))
    failed = [F.when(F.col("mask").bitwiseAND(1 << k) != 0, k) for k in range(len(failing()))]
    own = rows.select(*entry, F.explode(F.array_compact(F.array(*failed))).alias("list"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    known = runtime.checkpoint(known.where("good OR bad"))
    said = F.array_compact(F.array(F.when(F.col("good"), GOOD), F.when(F.col("bad"), TOXIC)))
    labelled = rows.join(known, "doc_id").select(*entry, F.explode(said).alias("list"))
    return own.unionByName(copies).unionByName(labelled), rows.groupBy("part").agg(F.count("*").alias("documents"))


def beyond(ids: np.ndarray, at: int, limit: int) -> int:
    """The first position from ``at`` whose id is ``limit`` or more, by doubling steps and then halving."""
    step, low, n = 1, at, len(ids)
    while low + step < n and ids[low + step] < limit:
        low += step
        step += step
    return low + int(np.searchsorted(ids[low : low + step + 1], limit))


def regions(lists: list[np.ndarray]) -> np.ndarray:
    """Ids by the set of lists that hold them (bit k: the k-th), given sorted lists without repetition."""
    out = np.zeros(1 << len(lists), np.int64)
    live = [k for k in range(len(lists)) if len(lists[k])]
    at, heads = [0] * len(lists), {k: int(lists[k][0]) for k in live}
    while live:
        live.sort(key=heads.__getitem__)
        low = heads[live[0]]
        holders = [k for k in live if heads[k] == low]
        others = [heads[k] for k in live if heads[k] != low]
        k = live[0]
        if len(holders) == 1:  # a run that no other list has
            to = beyond(lists[k], at[k], others[0]) if others else len(lists[k])
            out[1 << k] += to - at[k]
            at[k] = to
        else:
            out[sum(1 << k for k in holders)] += 1
            for k in holders:
                at[k] += 1
        for k in holders:
            if at[k] < len(lists[k]):
                heads[k] = int(lists[k][at[k]])
            else:
                live.remove(k)
    return out


def union_sizes(entries: DataFrame) -> DataFrame:
    """part, filters (bits), failing, good, toxic: the size of each union of the filters' lists, and of its labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict[str, np.ndarray] = {}
        rest = None

        def count(table: pa.Table):
            parts = table.column("part").combine_chunks().dictionary_encode()
            names, code = parts.dictionary.to_pylist(), parts.indices.to_numpy()
            row, which = (table.column(c).to_numpy() for c in ("row", "list"))
            # Entries come in the order (part, doc_id, row): an id is the rank of its document there.
            new = np.r_[True, row[1:] != row[:-1]]
            rank = np.cumsum(new)
            cut = np.r_[0, np.flatnonzero(np.diff(code)) + 1, len(code)]
            for a, b in zip(cut[:-1], cut[1:]):
                found = regions([rank[a:b][which[a:b] == k] for k in range(LISTS)])
                name = names[code[a]]
                sums[name] = sums.get(name, 0) + found

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            row = table.column("row").to_numpy()
            # The last document may go on in the next batch.
            end = len(row) - int(np.argmax(row[::-1] != row[-1])) if (row != row[-1]).any() else 0
            if end:
                count(table.slice(0, end))
            rest = table.slice(end).combine_chunks()
        if rest is not None and rest.num_rows:
            count(rest)
        for name, found in sums.items():
            columns = [pa.array([name] * SETS), pa.array(np.arange(SETS, dtype=np.int32)), *(pa.array(m @ found) for m in (_IN, _IN_GOOD, _IN_TOXIC))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "filters", "failing", "good", "toxic"])

    entries = entries.select("part", "doc_id", "row", F.col("list").cast("int").alias("list"))
    dealt = entries.repartitionByRange("part", "doc_id", "row").sortWithinPartitions("part", "doc_id", "row", "list")
    found = dealt.mapInArrow(run, "part string, filters int, failing long, good long, toxic long")
    return found.groupBy("part", "filters").agg(*(F.sum(c).alias(c) for c in ("failing", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does in each order of all filters, by part: a row for each part, order and step."""
    runtime.small_batches(docs.sparkSession)
    entries, parts = postings(docs, labels)
    sizes = union_sizes(entries)
    sizes = sizes.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("filters", F.struct("failing", "good", "toxic")))).alias("sizes"))
    steps = parts.join(sizes, "part", "left").withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda k: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), F.substring("filter_order", k, 1)) - 1)
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda s, k: s + F.when(k < F.col("step"), bit(k)).otherwise(0))
    steps = steps.withColumn("own", bit(F.col("step"))).withColumn("before", before)
    size = lambda s, c: F.coalesce(F.try_element_at("sizes", s)[c], F.lit(0))
    upto, every = F.col("before") + F.col("own"), F.lit(SETS - 1)
    steps = steps.withColumn("removed", size(upto, "failing") - size(F.col("before"), "failing")).select(
        "part",
        "filter_order",
        "step",
        "own",
        (F.col("documents") - size(upto, "failing")).alias("kept"),
        "removed",
        (size(F.col("own"), "failing") - F.col("removed")).alias("redundant"),
        (size(every, "failing") - size(every - F.col("own"), "failing")).alias("unique_fails"),
        (size(upto, "good") - size(F.col("before"), "good")).alias("good_lost"),
        (size(upto, "toxic") - size(F.col("before"), "toxic")).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "own"))).drop("own")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(docs, runtime.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
known AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
         {'A': len(words) < 200,
          'B': 100 * list_unique(words) < 50 * len(words),
          'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'),
          'E': coalesce(doc_id > first, false)} AS f
  FROM docs JOIN firsts USING (text) LEFT JOIN known USING (doc_id)
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
masks AS (
  SELECT part, good, bad, count(*) AS n,
         concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END,
                CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS failed
  FROM fails GROUP BY ALL
),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM orders, range(1, 6) t(step)
),
joined AS (
  SELECT m.*, s.*, contains(failed, own) AS hit, regexp_matches(failed, '[' || before || '0]') AS gone FROM masks m, steps s
),
counted AS (
  SELECT part, filter_order, step, own,
         CAST(sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN failed = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN NOT gone AND hit AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN NOT gone AND hit AND bad THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM joined GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
