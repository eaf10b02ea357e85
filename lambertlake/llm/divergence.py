"""How sources differ in their words, within a language: distances of sources, and each one's own terms.

Terms are runs of letters A-Z (lower-cased), a-z and characters beyond ASCII; a language keeps
the V terms that at least ``least_docs`` of its documents contain. A group (lang, source) gives
a kept term, of which it has ``count`` occurrences, p = 1 + floor(10^9 (count + 5) / (N + 5 V)),
N being the group's occurrences of kept terms; the language gives it q likewise.

1. Each task counts terms by group and hands on sums, bounded in number, not words. Sums meet
   by (lang, term), where those of too few documents go.
2. Kept terms are dealt out by (lang, slot of the term), together with the totals of all the
   language's groups. A task adds up |p - p'| for every pair of sources (as many sums as the
   result has rows), and retains of every group's terms the k-skyband: those dominated by fewer
   than k others, a term being dominated by one that occurs at least as often in the group, at
   most as often in the language, and stands earlier in UTF-8. As p - q grows with the one and
   falls with the other count, the k highest p - q, ties to the earlier term, are in the skyband.
   Terms come in their order, so a term is retained or dropped for good when it comes.
3. Sums of pairs are added up; skybands are merged and ranked exactly by p - q.

All arithmetic is in integers and exact for counts up to 9 * 10^15. Null text, lang and source
are ''. Every row is a document, also where rows repeat a doc_id, which isn't read; other columns
are ignored, whatever their names. A group without terms has its pairs; where a language keeps no
term they are 0. A source alone in its language has no pairs. Ties go to the UTF-8 earlier item.
An empty table gives no rows. The language's number of sources is taken to be one whose square,
the result, is bearable: a task holds one language's totals and pair sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lambertlake.llm import runtime

LEAST_DOCS, TOP = 30, 50
SCALE_STEPS, SMOOTHING = 3, 5
#: Different terms of all groups that a task counts before it hands sums on.
HELD = 400_000
#: Cells of a table of terms by sources that is looked at once.
CELLS = 1 << 20

#: Bytes of terms as they are (A-Z lower-cased), all others as spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_TERMS).split()


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / total), exactly: long division by thousands."""
    rest, out = np.broadcast_arrays(count + SMOOTHING, 0)
    rest, out = rest.astype(np.int64), out.astype(np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs in parts; a row with the term '' for each group."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts: dict[tuple, tuple[Counter, Counter]] = {}

        def out():
            for (lang, source), (count, docs) in counts.items():
                n = len(count) + 1
                columns = [pa.array([lang] * n), pa.array([source] * n), pa.array([b"", *count], pa.binary()).cast(pa.string())]
                columns += [pa.array([0, *count.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, count)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "docs"])
            counts.clear()

        for batch in runtime.slices(batches):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())):
                count, docs = counts.get((lang, source)) or counts.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text.as_py())
                count.update(found)
                docs.update(set(found))
            if sum(len(c) + 1 for c, _ in counts.values()) > HELD:
                yield from out()
        yield from out()

    filled = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return filled.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, count, lang_count, first for the kept terms, and the term '' for each group.

    ``first`` is true for one source of each term.
    """
    dealt = term_counts(docs).repartition("lang", "term")  # serves both the sums and the window
    sums = dealt.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    over = W.partitionBy("lang", "term")
    sums = sums.select("*", F.sum("docs").over(over).alias("all"), F.sum("count").over(over).alias("lang_count"), (F.min("source").over(over) == F.col("source")).alias("first"))
    return sums.where((F.col("term") == "") | (F.col("all") >= least_docs)).drop("all", "docs")


class _Language:
    """Sums of pairs and skybands of one language's terms in one slot."""

    def __init__(self, lang: str, sources: list[str], totals: np.ndarray, lang_total: int, k: int):
        self.lang, self.sources, self.totals, self.lang_total, self.k = lang, sources, totals, lang_total, k
        self.place = {s: i for i, s in enumerate(sources)}
        self.pairs = np.zeros((len(sources), len(sources)), np.int64)
        self.seen = False
        self.band: list[list] = [[np.zeros(64, np.int64), np.zeros(64, np.int64), []] for _ in sources]

    def take(self, term: list, code: np.ndarray, source: np.ndarray, count: np.ndarray, lang_count: np.ndarray) -> None:
        """Rows of whole terms in order; ``code`` numbers them from 0, ``source`` by place."""
        self.seen = True
        none = share(np.zeros(len(self.sources), np.int64), self.totals)
        p = share(count, self.totals[source])
        rows = max(1, CELLS // len(self.sources))
        for low in range(0, int(code[-1]) + 1, rows):
            a, b = np.searchsorted(code, (low, low + rows))
            table = np.repeat(none[:, None], min(rows, int(code[-1]) + 1 - low), axis=1)
            table[source[a:b], code[a:b] - low] = p[a:b]
            for s in range(len(self.sources) - 1):
                self.pairs[s, s + 1 :] += np.abs(table[s + 1 :] - table[s]).sum(1)
        for r in range(len(code)):
            often, rare, names = self.band[source[r]]
            n = len(names)
            if n >= self.k and np.count_nonzero((often[:n] >= count[r]) & (rare[:n] <= lang_count[r])) >= self.k:
                continue
            if n == len(often):
                often, rare = np.concatenate([often, often]), np.concatenate([rare, rare])
                self.band[source[r]][:2] = often, rare
            often[n], rare[n] = count[r], lang_count[r]
            names.append(term[r])

    def rows(self, always: bool) -> Iterator[pa.RecordBatch]:
        def batch(source: str, part: str, items: list, values: np.ndarray):
            n = len(items)
            columns = [*(pa.array([x] * n, pa.string()) for x in (self.lang, source, part)), pa.array(items, pa.string()), pa.array(values, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])

        if not (self.seen or always):
            return
        for s, source in enumerate(self.sources):
            others = [x for x in range(len(self.sources)) if x != s]
            yield batch(source, "pair", [self.sources[x] for x in others], (self.pairs + self.pairs.T)[s, others])
            often, rare, names = self.band[s]
            if names:
                n = len(names)
                value = share(often[:n], self.totals[s]) - share(rare[:n], np.int64(self.lang_total))
                some = np.flatnonzero(value > 0)
                yield batch(source, "term", [names[x] for x in some], value[some])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources by distance, terms by p - q."""
    spark = docs.sparkSession
    runtime.small_batches(spark)
    saved = runtime.checkpoint(kept_terms(docs, least_docs))
    lang = W.partitionBy("lang")
    groups = saved.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("first") & (F.col("term") != ""), 1).otherwise(0)).alias("v"))
    terms_ = F.lit(SMOOTHING) * F.sum("v").over(lang)
    groups = groups.select("lang", "source", (F.col("n") + terms_).alias("count"), (F.sum("n").over(lang) + terms_).alias("lang_count"))
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = groups.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("term", F.lit(""))
    own = saved.where("term <> ''").withColumn("slot", F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int"))
    columns = ["lang", "slot", "term", "source", "count", "lang_count"]
    # Totals come first, as they have the term ''.
    dealt = groups.select(columns).unionByName(own.select(columns)).repartition("lang", "slot").sortWithinPartitions("lang", "slot", "term", "source")

    def run(batches: Iterator[pa.RecordBatch]):
        at, now, totals, rest = None, None, [], None

        def begun():
            sources, count, lang_count = zip(*totals)
            totals.clear()
            # Without kept terms nothing is divided.
            return _Language(at[0], list(sources), np.maximum(np.array(count, np.int64), 1), max(lang_count[0], 1), top)

        def take(table: pa.Table):
            nonlocal at, now
            lang, term, source = (table.column(c).to_pylist() for c in ("lang", "term", "source"))
            slot, count, lang_count = (table.column(c).to_numpy() for c in ("slot", "count", "lang_count"))
            start = 0
            while start < len(lang):
                end = start + 1
                while end < len(lang) and slot[end] == slot[start] and lang[end] == lang[start] and (term[end] == "") == (term[start] == ""):
                    end += 1
                if (lang[start], slot[start]) != at:
                    if at is not None:
                        now = now or begun()
                        yield from now.rows(at[1] == 0)
                    at, now = (lang[start], slot[start]), None
                if term[start] == "":
                    totals.extend(zip(source[start:end], count[start:end], lang_count[start:end]))
                else:
                    now = now or begun()
                    own = term[start:end]
                    code = np.cumsum([0] + [a != b for a, b in zip(own, own[1:])])
                    place = np.fromiter(map(now.place.__getitem__, source[start:end]), np.int64, end - start)
                    now.take(own, code, place, count[start:end], lang_count[start:end])
                start = end

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            # The last term may go on in the next batch.
            keys = list(zip(*(table.column(c).to_pylist() for c in ("lang", "term"))))
            end = len(keys)
            while end and keys[end - 1] == keys[-1]:
                end -= 1
            yield from take(table.slice(0, end))
            rest = table.slice(end).combine_chunks()
        if rest is not None:
            yield from take(rest)
        if at is not None:
            now = now or begun()
            yield from now.rows(at[1] == 0)

    found = runtime.checkpoint(dealt.mapInArrow(run, "lang string, source string, part string, item string, value long"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).select("*", rank)
    return pairs.unionByName(found.where("part = 'term'").select("*", rank).where(F.col("rank") <= top))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(runtime.table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
),
words AS (SELECT row, lang, source, unnest(words) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM words GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS lang_n FROM counts GROUP BY ALL HAVING sum(docs) >= 30),
groups AS (
  SELECT g.lang, g.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT c.* FROM counts c JOIN kept USING (lang, term)) c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
),
langs AS (
  SELECT lang, CAST(sum(n) AS HUGEINT) AS n, CAST((SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS HUGEINT) AS v FROM groups g GROUP BY lang
),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (g.n + 5 * l.v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (k.lang_n + 5) // (l.n + 5 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
),
every AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
),
ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM every
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
