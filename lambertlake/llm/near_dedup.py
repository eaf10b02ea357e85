"""Near duplicates by ProbMinHash, banding and exact verification.

A text is the set of its shingles of five words (all its words, if fewer), each weighted by one
plus the logarithm of how often it occurs. Every shingle is a Poisson process of the rate of its
weight: its arrivals fall on random registers, and a register keeps its earliest arrival. An
element stops as soon as its next arrival is later than the latest register, so most shingles of
a long text cost one arrival. Two texts' registers agree with the probability Jaccard of their
weights. Where no shingle repeats that is the Jaccard similarity of the sets. Where some do it can
be far below it, so such texts have registers of equal weights beside: a pair is a candidate by
either, is ruled out only by both, and is verified by the similarity of the sets, so that what
repeats in a text loses no link.

1. Equal texts are one node from the start; texts that share a doc_id are linked.
2. Registers are cut into bands; texts that agree on a band share a bucket. Every member is
   paired with its buckets' pivots (first member), pairs whose registers disagree clearly go,
   and the rest is verified on the words themselves, by the Jaccard similarity of the sets:
   first each member's likeliest pivot, then what links not yet joined components.
3. A bucket that still holds several components is searched completely: members outside its
   largest component are compared with all members, in blocks of bounded size that carry the
   texts, so that pairs the registers don't rule out are verified there (on 64-bit hashes of
   the shingles) and only links leave the task. So no link of a bucket is lost, and no group
   is expanded into all its pairs or brought together in one task.

The class of a document is the smallest doc_id of its component, links being similarities of
``threshold`` or more. Null texts count as empty; texts without words are like their exact
copies only. Rows that repeat a doc_id are one document, whatever their texts; documents without
doc_id get no class and link nothing. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lambertlake.llm import runtime

WORDS, THRESHOLD = 5, 0.8
#: Registers are BANDS x ROWS; at 0.8 a pair shares no band in 15 of a million cases.
BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
#: Registers agree within four and a half standard deviations of the similarity.
SLACK = 4.5 / (2 * REGISTERS**0.5) * 0.8
#: Words a worker remembers the hash of; hashing one anew costs little.
REMEMBERED = 50_000
#: Members of a block: outside the largest component, and of all.
FEW, MANY = 64, 256

_GOLDEN, _PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= runtime.LONG_WORD:
            self[word] = found
        return found


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of WORDS words, given the words' hashes."""
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * _PRIME + words[i : i + n]
        out ^= out >> np.uint64(29)
    return _mix(out)


def prob_min_hash(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, registers: int = REGISTERS) -> np.ndarray:
    """The register values (owners x registers) of several weighted sets at once."""
    first = np.full(owners * registers, np.inf)
    value = np.zeros(owners * registers, np.uint64)
    at, seed = np.zeros(len(shingles)), shingles.copy()
    element, weight, who = shingles, weights, owner
    while len(element):
        seed = _mix(seed + _GOLDEN)
        at = at - np.log1p(-((seed >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weight
        cell = who * registers + (_mix(seed ^ _GOLDEN) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, cell, at)
        won = at == first[cell]
        value[cell[won]] = element[won]
        # Later arrivals of an element can matter only before its owner's latest register.
        on = at < first.reshape(owners, registers).max(1)[who]
        element, seed, at, weight, who = element[on], seed[on], at[on], weight[on], who[on]
    return value.reshape(owners, registers)


def signatures(texts: list[str | None], hashes: dict, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Register values of the texts that have words (texts x 2 x registers: weighted, of equal weights), and which those are."""
    sets, weights, has, again = [], [], [], []
    for i, text in enumerate(texts):
        words = text.split() if text else []
        if words:
            found = shingle_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            found, times = np.unique(found, return_counts=True)
            sets.append(found)
            weights.append(1 + np.log(times) if weighted else np.ones(len(found)))
            if weighted and len(found) < times.sum():
                again.append(len(has))
            has.append(i)
    if not has:
        return np.zeros((0, 2, REGISTERS), np.uint64), np.zeros(0, np.int64)
    # Texts in which shingles repeat once more, with equal weights.
    all_sets, all_weights = sets + [sets[k] for k in again], weights + [np.ones(len(sets[k])) for k in again]
    owner = np.repeat(np.arange(len(all_sets)), [len(s) for s in all_sets])
    values = prob_min_hash(np.concatenate(all_sets), np.concatenate(all_weights).astype(np.float64), owner, len(all_sets))
    equal = np.arange(len(has))
    equal[again] = np.arange(len(has), len(all_sets))
    return np.stack([values[: len(has)], values[equal]], axis=1), np.array(has)


def band_keys(values: np.ndarray) -> np.ndarray:
    """64-bit keys, different for each band (texts x bands x 2: of both kinds of registers)."""
    each = values.reshape(-1, 2, BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), each.shape[:3]).copy()
    for i in range(ROWS):
        out = _mix(out * _PRIME + each[..., i])
    return np.ascontiguousarray(out.transpose(0, 2, 1)).view(np.int64)


_SIGNED = "doc_id long, text_key binary, bands array<long>, registers binary"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with text_key, which tells texts apart."""
    return docs.withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))


def _sign(docs: DataFrame, weighted: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        runtime.forget()
        hashes = _WordHashes()
        for batch in runtime.slices(batches):
            texts = batch.column("text").to_pylist()
            values, has = signatures(texts, hashes, weighted)
            bands, low = band_keys(values), (values & np.uint64(0xFF)).astype(np.uint8)
            row = dict(zip(has.tolist(), range(len(has))))
            counts = np.zeros(len(texts) + 1, np.int32)
            counts[has + 1] = 2 * BANDS
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(bands.ravel()))
            registers = pa.array([low[row[i]].tobytes() if i in row else b"" for i in range(len(texts))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), lists, registers], names=["doc_id", "text_key", "bands", "registers"])

    return _keyed(docs).mapInArrow(run, _SIGNED)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of registers kept in a byte each, of which one in 256 agrees by chance: the higher of both kinds."""
    same = (a == b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], 2, REGISTERS).mean(-1).max(-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, y) whose registers don't rule them out, with the estimate."""
    own = nodes.select(F.col("rep").alias("x"), F.col("registers").alias("rx"))
    other = nodes.select(F.col("rep").alias("y"), F.col("registers").alias("ry"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 2 * REGISTERS) for c in ("rx", "ry"))
                near = agreement(a, b)
                keep = pa.array(near >= threshold - SLACK)
                yield pa.RecordBatch.from_arrays([batch.column("x").filter(keep), batch.column("y").filter(keep), pa.array(near).filter(keep)], names=["x", "y", "near"])

    return pairs.join(own, "x").join(other, "y").select("x", "y", "rx", "ry").mapInArrow(run, "x long, y long, near double")


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the texts' shingles, on the words themselves."""
    x, y = _shingles(a), _shingles(b)
    return len(x & y) / max(1, len(x | y))


def _shingles(text: str) -> set:
    words = text.split()
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(WORDS))))


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and compressed text of the wanted nodes (text_key, rep); the one time that texts are moved."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in runtime.slices(batches):
            packed = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(packed, pa.binary())], names=["rep", "packed"])

    found = _keyed(docs.where("doc_id IS NOT NULL")).join(wanted, "text_key").select("rep", "text")
    return found.mapInArrow(run, "rep long, packed binary").dropDuplicates(["rep"])


def _verified(pairs: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, y) whose texts are similar enough."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        known: dict[int, set] = {}

        def shingles(ident, data):
            found = known.get(ident)
            if found is None:
                if len(known) >= 64:
                    known.clear()
                found = known[ident] = _shingles(unpack(data).decode("utf-8", "surrogatepass"))
            return found

        for batch in runtime.slices(batches):
            x, y, px, py = (batch.column(c).to_pylist() for c in ("x", "y", "px", "py"))
            keep = []
            for i, j, p, q in zip(x, y, px, py):
                a, b = shingles(i, p), shingles(j, q)
                both = len(a & b)
                keep.append(both >= threshold * (len(a) + len(b) - both) and both > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("x", "y")], names=["x", "y"])

    own = packed.select(F.col("rep").alias("x"), F.col("packed").alias("px"))
    other = packed.select(F.col("rep").alias("y"), F.col("packed").alias("py"))
    return pairs.select("x", "y").join(other, "y").join(own, "x").select("x", "y", "px", "py").mapInArrow(run, "x long, y long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each node's component, by passing labels and halving paths."""
    both = runtime.checkpoint(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).union(edges.select("y", "x")))
    labels = runtime.checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        new = near.join(far, "low", "left").select("node", F.least("low", "lower").alias("label"), (F.least("low", "lower") < F.col("label")).alias("moved"))
        new = runtime.checkpoint(new)
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def _joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels after further edges: the components of components."""
    if labels is None:
        return components(edges)
    between = _labelled(_labelled(edges, labels, "x"), labels, "y").select(F.col("x_label").alias("x"), F.col("y_label").alias("y"))
    more = components(between.where("x <> y"))
    fresh = more.select(F.col("node").alias("label"), F.col("label").alias("lower"))
    old = labels.join(fresh, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    new = more.join(labels, "node", "left_anti")
    done = runtime.checkpoint(old.unionByName(new))
    runtime.release(edges.sparkSession)
    return done


def _labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias(column), F.col("label").alias("_label")), column, "left").withColumn(
        f"{column}_label", F.coalesce("_label", column)
    ).drop("_label")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose two members are in different components."""
    return _labelled(_labelled(pairs, labels, "x"), labels, "y").where("x_label <> y_label").drop("x_label", "y_label")


def _rest(members: DataFrame, labels: DataFrame, nodes: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """Links (x, y) across components among the members of each bucket.

    Blocks carry registers and texts, so that a pair is judged where its members meet and only
    links leave the task: for a member and another component the first link found, likeliest
    pair first. A pair that shares several buckets is judged in the first of them, which whole
    keys tell: bytes of registers may agree by chance where the members have no bucket.
    """
    mine = _labelled(members, labels, "rep")
    mine = mine.select("key", "band", "rep", F.col("rep_label").alias("label"))
    sizes = mine.groupBy("key", "label").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts"))
    sizes = sizes.where("parts > 1").select(
        "key", "main", F.ceil((F.col("all") - F.col("most")) / FEW).cast("int").alias("few"), F.ceil(F.col("all") / MANY).cast("int").alias("many")
    )
    # Written first: then both sides of the join are plain shuffles, of which a hot key can be split.
    mine = mine.join(runtime.checkpoint(sizes), "key").join(nodes.select("rep", "bands", "registers").join(packed, "rep"), "rep")
    mine = mine.withColumn("earlier", F.slice("bands", F.lit(1), 2 * F.col("band")))
    place = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = mine.where("label <> main").withColumn("i", place(1, "few")).withColumn("j", upto("many")).withColumn("asks", F.lit(True))
    told = mine.withColumn("j", place(2, "many")).withColumn("i", upto("few")).withColumn("asks", F.lit(False))
    columns = ["key", "i", "j", "band", "asks", "rep", "label", "earlier", "registers", "packed"]
    dealt = asks.select(columns).unionByName(told.select(columns)).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def block(asks, rep, label, earlier, registers, texts, known):
        unpack = zstandard.ZstdDecompressor().decompress

        def shingles(r):
            found = known.get(rep[r])
            if found is None:
                if len(known) >= 4 * MANY:
                    known.clear()
                words = unpack(texts[r]).decode("utf-8", "surrogatepass").split()
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
                found = known[rep[r]] = np.unique(shingle_hashes(hashes))
            return found

        many = np.flatnonzero(~asks)
        for r in np.flatnonzero(asks):
            other = many[label[many] != label[r]]
            near = agreement(registers[other], registers[r])
            hit = near >= threshold - SLACK
            hit[hit] = ~(earlier[other[hit]][:, :, :, None] == earlier[r][None, :, None, :]).any((1, 2, 3))
            order = np.argsort(-near[hit], kind="stable")
            done = set()
            for o in other[hit][order]:
                if label[o] in done:
                    continue
                a, b = shingles(r), shingles(o)
                # No more can be shared than the smaller set has.
                if min(len(a), len(b)) < threshold * max(len(a), len(b)):
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both >= threshold * (len(a) + len(b) - both):
                    done.add(label[o])
                    yield int(rep[r]), int(rep[o])

    def run(batches):
        held, texts, last, known = [], [], None, {}

        def out():
            asks, rep, label, earlier, registers = (np.concatenate([h[c] for h in held]) for c in range(5))
            found = list(block(asks, rep, label, earlier, registers, texts, known))
            held.clear()
            texts.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, band, asks, rep, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in columns[:7])
            registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint8).reshape(-1, 2 * REGISTERS)
            keys = batch.column("earlier").flatten().to_numpy(zero_copy_only=False)
            start = np.r_[0, np.cumsum(2 * band)]  # a row has two keys of each band earlier than its bucket's
            own = batch.column("packed").to_pylist()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in zip(np.r_[0, cut], np.r_[cut, len(key)]):
                if last is not None and last != (key[a], i[a], j[a]):
                    yield from out()
                last = (key[a], i[a], j[a])
                earlier = keys[start[a] : start[b]].reshape(b - a, band[a], 2)
                held.append((asks[a:b].astype(bool), rep[a:b], label[a:b], earlier, registers[a:b]))
                texts += own[a:b]
        if held:
            yield from out()

    return dealt.mapInArrow(run, "x long, y long")


def _same_document(held: DataFrame) -> DataFrame:
    """Links (x, y) between the texts of one doc_id, given doc_id and node of every row."""
    several = held.groupBy("doc_id").agg(F.min("rep").alias("y"), F.max("rep").alias("_last")).where("y < _last").drop("_last")
    return held.join(several, "doc_id").where("rep > y").select(F.col("rep").alias("x"), "y").distinct()


def classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """doc_id, class_id for every row of ``docs``.

    Without ``weighted`` both kinds of registers take all shingles of a text alike.
    """
    runtime.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    signed = runtime.checkpoint(_sign(docs, weighted))
    nodes = signed.where("doc_id IS NOT NULL").groupBy("text_key")
    nodes = nodes.agg(F.min("doc_id").alias("lowest"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
    # A node's number is any number of its own: results don't depend on which.
    nodes = runtime.checkpoint(nodes.withColumn("rep", F.monotonically_increasing_id()))
    held = runtime.checkpoint(signed.select("doc_id", "text_key").join(nodes.select("text_key", "rep"), "text_key", "left").select("doc_id", "rep"))
    real = nodes.where(F.size("bands") > 0).select("rep", "bands", "registers")
    keyed = F.array_distinct(F.transform("bands", lambda key, i: F.struct(F.floor(i / 2).cast("int").alias("band"), key.alias("key"))))
    banded = real.select("rep", F.inline(keyed).alias("band", "key"))
    pivots = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("_last")).where("pivot <> _last").drop("_last")
    pivots = runtime.checkpoint(pivots)  # so that the join below has two plain sides, and a hot key can be split
    members = runtime.checkpoint(banded.join(pivots, "key"))
    shared = members.select("rep").distinct()
    del signed, pivots
    runtime.release(docs.sparkSession)
    packed = runtime.checkpoint(_packed(docs, nodes.select("text_key", "rep").join(shared, "rep")))
    some = real.join(shared, "rep", "left_semi")
    star = members.where("rep <> pivot").select(F.col("rep").alias("x"), F.col("pivot").alias("y")).distinct()
    star = runtime.checkpoint(_estimated(star, some, threshold))
    runtime.release(docs.sparkSession)
    best = star.groupBy("x").agg(F.max_by("y", F.struct("near", -F.col("y"))).alias("y"))
    labels = components(_verified(best, packed, threshold).unionByName(_same_document(held.where("doc_id IS NOT NULL"))))
    tried = star.join(best, ["x", "y"], "left_anti")
    labels = _joined(labels, runtime.checkpoint(_verified(_apart(tried, labels), packed, threshold)))
    del star, best, tried
    labels = _joined(labels, runtime.checkpoint(_rest(members.select("key", "band", "rep"), labels, some, packed, threshold)))
    del packed, members, banded, real, some, shared
    runtime.release(docs.sparkSession)
    own = nodes.select("rep", "lowest").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    names = own.where("label IS NOT NULL").groupBy("label").agg(F.min("lowest").alias("_class"))
    own = own.join(names, "label", "left").select("rep", F.coalesce("_class", "lowest").alias("class_id"))
    return held.join(own, "rep", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose class has a smaller doc_id; rows without doc_id stay."""
    gone = classes(docs, text).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = classes(runtime.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
