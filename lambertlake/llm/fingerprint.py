"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A paragraph is a line; a section is a run of paragraphs that ends at a blank line or where a
paragraph's own hash says so, so that an edit moves no border but those beside it. Inside a
paragraph the leaves are its sentences, long ones cut every 96 characters. A leaf's hash is
that of its text, any other node's that of its children's hashes and lengths: 64 bits below,
128 at the root.

The fingerprint spells the tree: the root's 32 hex digits, the length in code points, then
for each section its hash and, in brackets, each paragraph's hash with its leaves' hashes
and lengths. Equal texts have equal roots, and different ones have different roots but for
collisions of hashes. Where roots differ, equal sections and paragraphs are matched whole
without looking inside, and what is left is compared leaf by leaf; the branches that stay
unmatched locate the edits. Likeness is the share of both texts' code points in matched
branches.

Null texts are taken as empty; empty texts have a root and no sections, and are like each
other by 1 and like anything else by 0. Repeated rows have equal fingerprints. The next
document is the one of next lower doc_id, null ones last; rows that share a doc_id follow
each other by xxhash64 of their texts, then by text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lambertlake.llm import runtime

#: Leaves: a sentence with what follows it up to the next, at most so many characters.
_LEAF = re.compile(r"[^.!?]{1,96}(?:[.!?]+\s*)?|[.!?]+\s*")
#: One paragraph in so many ends a section.
SECTION = 4

Tree = tuple[str, int, list]  # root, length, sections: (hash, length, paragraphs: (hash, length, leaves: (hash, length)))


def _leaf(piece: str) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass")), len(piece)


def _spelled(children: list) -> bytes:
    """The children's hashes and lengths, as their parent hashes them."""
    return array("Q", [x for c in children for x in c[:2]]).tobytes()


def _node(children: list) -> tuple[int, int, list]:
    return xxhash.xxh3_64_intdigest(_spelled(children)), sum(c[1] for c in children), children


def tree(text: str) -> Tree:
    sections, opened = [], []
    for line in text.splitlines(keepends=True):
        opened.append(_node(list(map(_leaf, _LEAF.findall(line)))))
        if opened[-1][0] % SECTION == 0 or line.isspace():
            sections.append(_node(opened))
            opened = []
    if opened:
        sections.append(_node(opened))
    return xxhash.xxh3_128_hexdigest(_spelled(sections)), len(text), sections


def spell(t: Tree) -> str:
    root, size, sections = t
    inner = ";".join(
        f"{h:x}[" + ",".join(f"{p:x}:" + " ".join(f"{x:x}.{n:x}" for x, n in leaves) for p, _, leaves in paragraphs) + "]"
        for h, _, paragraphs in sections
    )
    return f"{root}-{size:x}-{inner}"


def parse(fingerprint: str) -> Tree:
    root, size, inner = fingerprint.split("-", 2)
    sections = []
    for part in inner.split(";") if inner else []:
        h, _, rest = part[:-1].partition("[")
        paragraphs = []
        for p in rest.split(","):
            own, _, spelled = p.partition(":")
            leaves = [(int(x, 16), int(n, 16)) for x, _, n in (s.partition(".") for s in spelled.split(" "))]
            paragraphs.append((int(own, 16), sum(n for _, n in leaves), leaves))
        sections.append((int(h, 16), sum(p[1] for p in paragraphs), paragraphs))
    return root, int(size, 16), sections


def _unmatched(a: list, b: list) -> tuple[int, list, list]:
    """Length of the nodes that both lists have, as often as both have them, and the other nodes."""
    if not a or not b:
        return 0, a, b
    left = Counter((x[0], x[1]) for x in b)
    matched, rest = 0, []
    for x in a:
        if left.get(key := (x[0], x[1]), 0):
            left[key] -= 1
            matched += x[1]
        else:
            rest.append(x)
    if not matched:
        return 0, a, b
    other = []
    for x in reversed(b):  # what is left over are the last ones of each
        if left.get(key := (x[0], x[1]), 0):
            left[key] -= 1
            other.append(x)
    return matched, rest, other[::-1]


def likeness(a: Tree, b: Tree) -> float:
    """Share of both texts' code points in branches that both have; 1 only for equal texts."""
    if a[0] == b[0] and a[1] == b[1]:
        return 1.0
    if not a[1] or not b[1]:
        return 0.0
    total, x, y = _unmatched(a[2], b[2])
    for _ in range(2):
        more, x, y = _unmatched([c for n in x for c in n[2]], [c for n in y for c in n[2]])
        total += more
    return min(2 * total / (a[1] + b[1]), 1 - 1e-9)


def edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Code-point ranges (start, stop) of ``a``'s leaves that have no match in ``b``."""
    if a[0] == b[0] and a[1] == b[1]:
        return []
    have = Counter(leaf for s in b[2] for p in s[2] for leaf in p[2])
    out: list[tuple[int, int]] = []
    at = 0
    for s in a[2]:
        for p in s[2]:
            for leaf in p[2]:
                if have[leaf]:
                    have[leaf] -= 1
                elif out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + leaf[1])
                else:
                    out.append((at, at + leaf[1]))
                at += leaf[1]
    return out


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with each text's fingerprint in the string column ``out``."""
    runtime.small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != out]
    columns = [f.name for f in kept]

    def run(batches):
        for batch in runtime.slices(batches):
            got = [spell(tree(t or "")) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(got, pa.string())], names=[*columns, out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType(), False)]))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and the flag ``_halo``, in partitions that each hold a range of doc_id, descending.

    Every range is followed, in its own partition, by the first row of the next one (after
    the last range: of the first), marked as halo. The texts are shuffled once. The borders,
    of which there are four per partition, are approximate quantiles; a doc_id that holds
    several of them, as the rows without doc_id, is cut further by the texts' hashes.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    # Python gets numbers without nulls: with them, large ones would lose their last digits.
    known = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("_tie")
    cuts = [i / (4 * n) for i in range(1, 4 * n)]
    found = rows.agg(F.percentile_approx("doc_id", cuts, 40 * n), F.count("*"), F.count("doc_id")).first()
    # Ascending, of identifiers with all bits turned: range 0 has the largest.
    borders, times = np.unique(~np.array(found[0] or [], np.int64), return_counts=True)
    # A border's own rows are in the range that ends with it, or in as many of their own as it has quantiles.
    hot = np.where(times > 1, times, 0)
    base = np.r_[0, np.cumsum(1 + hot)]
    unnamed = 1 + (found[1] - found[2]) * 4 * n // max(1, found[1])

    @F.pandas_udf("int")
    def bucket(unknown: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.Series:
        own = ~ids.to_numpy(np.int64)
        at = np.searchsorted(borders, own, side="left")
        share = ((ties.to_numpy(np.int64) >> 33) + 2**30) / 2**31  # from 0 to below 1, in order of the hash
        out = base[at]
        if len(borders):
            near = np.minimum(at, len(borders) - 1)
            parts = np.where((borders[near] == own) & (at == near), hot[near], 0)
            out = out + np.where(parts > 0, 1 + (share * parts).astype(np.int64), 0)
        return pd.Series(np.where(unknown, base[-1] + 1 + (share * unnamed).astype(np.int64), out).astype(np.int32))

    # One row for each range that has rows: as many as partitions, not as documents.
    order = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), "_tie")
    firsts = rows.groupBy(bucket(*known).alias("b")).agg(F.min(order).alias("first")).collect()
    top = {r["b"]: (None if r["first"][0] else ~r["first"][1], r["first"][2]) for r in firsts}
    full = sorted(top)
    before = {b: full[i - 1] for i, b in enumerate(full)}  # before the first comes the last

    @F.pandas_udf("array<struct<b:int,h:boolean>>")
    def copies(unknown: pd.Series, ids: pd.Series, ties: pd.Series, buckets: pd.Series) -> pd.Series:
        first = [(None if u else i, t) == top[b] for u, i, t, b in zip(unknown, ids, ties, buckets)]
        return pd.Series([[{"b": b, "h": False}] + [{"b": before[b], "h": True}] * is_first for b, is_first in zip(buckets, first)])

    rows = rows.withColumn("_copy", F.explode(copies(*known, bucket(*known))))
    dealt = rows.select("doc_id", "text", "_tie", F.col("_copy.b").alias("_bucket"), F.col("_copy.h").alias("_halo"))
    dealt = dealt.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_halo", F.desc_nulls_last("doc_id"), "_tie", "text")
    return dealt.drop("_tie")


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text has its last third replaced by the first characters of the next document's,
    in descending order of doc_id; after the last comes the first.
    """
    runtime.small_batches(docs.sparkSession)

    def run(batches):
        last = None  # doc_id, bucket, text, tree
        for batch in runtime.slices(batches):
            out = []
            for doc_id, text, bucket, halo in zip(*(c.to_pylist() for c in batch.columns)):
                if halo and last is None:
                    continue  # repeated rows of the next range's first document
                own = tree(text)
                if last is not None and last[1] == bucket:
                    out.append(_compared(*last, text, own))
                last = None if halo else (doc_id, bucket, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    return in_order(docs).mapInArrow(run, _OUT)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema(
    [(name, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[kind]) for name, kind in (x.split() for x in _OUT.split(", "))]
)


def _compared(doc_id, _bucket, text: str, own: Tree, other: str, others: Tree) -> tuple:
    n = len(text)
    edited = text[: n - n // 3] + other[: n // 3]
    changed = tree(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, digest, spell(own), spell(changed), likeness(own, changed), likeness(own, others)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_next(runtime.table(spark, sf_dir, "documents").select("doc_id", "text"))
