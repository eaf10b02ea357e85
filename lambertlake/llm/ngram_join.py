"""All pairs of documents whose sets of word shingles are alike, by partitions of the universe.

Words are runs without space, tab and \\n \\v \\f \\r, A-Z lower-cased; a document's set are its
distinct shingles of five words, or all its words as one where there are fewer. Two documents
link where their sets' Jaccard similarity is 0.8 or more.

1. Signing. Sets of r and s shingles that link differ in at most (r + s) / 9. Sizes fall into
   bands; a set is signed in its own band and, if a partner may be there, in the next. A band
   cuts the universe of hashes into segments; a segment counts one unit, two if sets are also
   indexed by its one-deletion neighbourhood (the segment without one of its shingles). Where
   two sets' common units outnumber their differences, they have a segment alike or, of two
   units, one deletion apart: then they share a key. A set need not keep all units: it may drop
   as many as the band has to spare for it, ``spare``, whichever they are. It drops the dearest,
   by the entries that they take and by how often their keys were met so far (empty segments
   first): cost decides what is indexed, never what is found.
2. Entries (key, set) meet in cells of keys, as packed arrays; keys of several sets become
   buckets. A key that takes a large part of a task's sets doesn't go through cells: its entries
   become members of its bucket at once, and one of them stands for them in the cell.
3. Linking. Equal sets and rows of one doc_id are one component from the start. Each member is
   paired with its bucket's pivot; pairs are verified on the words themselves, first those that
   share most buckets, then those between components. A bucket that still has several components
   is searched: members outside its largest component are compared with all others, in blocks of
   bounded size, by sizes and parity bitmaps, which never rule out a link; the pairs that are
   left are verified on the words. So every link is found or implied, and no group is expanded into all
   its pairs.

A document's component is the smallest doc_id that it can reach by links. Null text counts as
empty. Documents without words link with nothing (n_shingles 0), not even with each other. Rows
that repeat a doc_id are one document in linking, whatever their texts, each with its own
n_shingles; rows without doc_id link nothing and have no component. Other columns are ignored,
an empty table gives no rows. Segments and counts are taken of 64-bit hashes of shingles; links
are verified on words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lambertlake.llm import runtime
from lambertlake.llm.near_dedup import WORDS, _apart, _joined, _labelled, _mix, components, shingle_hashes

#: Links have 100 * intersection >= LEAST * union.
LEAST = 80
#: Documents that a task signs at once.
DOCS = 512
#: Cells for each shuffle partition.
CELLS = 16
#: Slots of a task's count of the keys it met, and the part of its sets that makes a key hot.
SLOTS, HOT = 1 << 20, 16
#: Bits of the smallest parity bitmap.
BITS = 1024
#: Members of a block: outside the largest component, and of all.
FEW, MANY = 64, 256
#: Bytes of text that are hashed at once.
PIECE = 1 << 17
#: Texts and sets that a task remembers.
KNOWN = 4 * MANY

_U = np.uint64
_EMPTY = 1 << 40


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles(own: list[bytes]) -> set:
    if len(own) < WORDS:
        return {tuple(own)} if own else set()
    return set(zip(*(own[i:] for i in range(WORDS))))


def linked(a: set, b: set) -> bool:
    both = len(a & b)
    return both > 0 and 100 * both >= LEAST * (len(a) + len(b) - both)


#: A value for each byte (A-Z as a-z), which bytes are between words, and a factor with its inverse.
_BYTE = _mix(np.arange(1, 257, dtype=_U))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_FACTOR = 0xD6E8FEB86659FD93
_INVERSE = pow(_FACTOR, -1, 1 << 64)


@cache
def _powers(base: int, steps: int) -> np.ndarray:
    """Powers of ``base``, PIECE * 2 ** steps of them."""
    out = np.full(PIECE << steps, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a text given as bytes: polynomials of the bytes, all words at once."""
    space = np.concatenate([[True], _SPACE[text], [True]])
    start = np.flatnonzero(space[:-1] & ~space[1:])
    stop = np.flatnonzero(~space[:-1] & space[1:])
    steps = max(0, (len(text) // PIECE).bit_length())
    upto = np.zeros(len(text) + 1, _U)
    np.cumsum(_BYTE[text] * _powers(_FACTOR, steps)[: len(text)], out=upto[1:])
    return _mix((upto[stop] - upto[start]) * _powers(_INVERSE, steps)[start] + (stop - start).astype(_U)), start


def _all_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, and each text's number of words."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    found, count, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while not _SPACE[data[to - 1]]:  # pieces end between words
            gap = _SPACE[data[to : to + PIECE]]
            to += int(np.argmax(gap)) + 1 if gap.any() else len(gap)
        hashes, start = word_hashes(data[at:to])
        found.append(hashes)
        count += np.bincount(np.searchsorted(ends, start + at, side="right"), minlength=len(texts))
        at = to
    return np.concatenate(found), count


def hashed(texts: list[bytes]) -> list[np.ndarray]:
    """The texts' sets of shingles as sorted 64-bit hashes."""
    if not texts:
        return []
    hashes, count = _all_hashes(texts)
    stop = np.cumsum(count)
    found = [np.sort(shingle_hashes(hashes[b - n : b])) if n else np.zeros(0, _U) for b, n in zip(stop, count)]
    return [s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s for s in found]


@cache
def band_start(k: int) -> int:
    """The least size of band k: 1, 2, 3, 5, 8, 12, ... half as much again each time."""
    return 1 if k == 0 else math.ceil(band_start(k - 1) * 1.5)


@cache
def band_of(size: int) -> int:
    k = 0
    while band_start(k + 1) <= size:
        k += 1
    return k


@cache
def layout(k: int) -> tuple[int, int]:
    """Segments of band k, and how many of them have neighbourhoods; (0, 0) where only equal sets link.

    As many neighbourhoods as keep empty segments rarer than what the smallest sets may drop:
    few large segments for small sets, many small ones of mostly one unit for large sets.
    """
    most = band_start(k + 1) - 1
    differ = 2 * most // 9
    if not differ:
        return 0, 0
    units = 1 + differ + 2 * math.ceil(differ / 10)
    least = math.ceil(0.8 * band_start(k))
    for near in (units // 8, units // 4, units // 2):
        empty = (units - near) * math.exp(-least / (units - near))
        if near and empty <= max(0.05, spare(units, least) / 2):
            break
    near = max(1, near)
    return units - near, near


def spare(units: int, size: int) -> int:
    """Units that a set may drop, so that any two that link keep more in common than they differ in."""
    return (9 * (units - 1) - 2 * size) // 18


def bands(size: int) -> list[int]:
    """The bands a set is signed in."""
    own = band_of(size)
    found = [own] + [own + 1] * (5 * size // 4 >= band_start(own + 1))
    return [k for k in found if layout(k)[0]]


class Signer:
    """Keys of sets; remembers roughly how often it met each key."""

    def __init__(self):
        self.met = np.zeros(SLOTS, np.int32)
        self.total = self.sets = 0

    def _seen(self, keys: np.ndarray) -> np.ndarray:
        """How often keys were met before this, beyond what a slot holds on average."""
        return np.maximum(self.met[(keys >> _U(20)) % _U(SLOTS)] - self.total / SLOTS, 0)

    def sign(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, the place of the set that each belongs to, and whether the key is hot."""
        by: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            for k in bands(len(s)) if len(s) else ():
                by.setdefault(k, []).append(i)
        self.sets += len(sets)
        keys, owners = [], []
        for k, members in by.items():
            found, owner = self._band(k, [sets[i] for i in members])
            keys.append(found)
            owners.append(np.array(members)[owner])
        if not keys:
            return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, bool)
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        hot = self._seen(keys) > max(64, self.sets / HOT)
        self.met += np.bincount(((keys >> _U(20)) % _U(SLOTS)).astype(np.int64), minlength=SLOTS).astype(np.int32)
        self.total += len(keys)
        return keys, owners, hot

    def _band(self, k: int, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        segments, near = layout(k)
        count = len(sets)
        sizes = np.array([len(s) for s in sets])
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(count), sizes)
        # Sorted hashes: a segment is a run of them.
        segment = owner * segments + ((token >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64)
        bound = np.searchsorted(segment, np.arange(count * segments + 1))
        held = np.diff(bound)
        each = _mix(token + _U(k))
        upto = np.concatenate([np.zeros(1, _U), np.cumsum(each, dtype=_U)])
        total = upto[bound[1:]] - upto[bound[:-1]]
        place = np.tile(np.arange(segments, dtype=_U), count) + _U(k << 32)
        tag = _mix(place)
        full = _mix(total ^ tag)
        seen = self._seen(full)
        # Costs of the units: a full key, and the neighbourhoods of the first segments.
        cost = np.where(held == 0, _EMPTY, 1 + 8 * seen)
        of = np.repeat(np.arange(count), segments)
        has_near = np.tile(np.arange(segments) < near, count)
        around = np.flatnonzero(has_near)
        # Without its only shingle a segment is empty. Neighbourhoods go before the full key goes.
        cost_near = np.maximum(np.where(held[around] <= 1, _EMPTY, held[around]), cost[around] + 1)
        costs = np.concatenate([cost, cost_near])
        owners = np.concatenate([of, of[around]])
        may = (9 * (segments + near - 1) - 2 * sizes) // 18
        order = np.lexsort((-costs, owners))
        rank = np.arange(len(order)) - np.searchsorted(owners[order], np.arange(count))[owners[order]]
        drop = np.zeros(len(costs), bool)
        drop[order] = rank < may[owners[order]]
        keep_full = ~drop[: len(full)]
        keys, whose = [full[keep_full]], [of[keep_full]]
        kept_near = np.zeros(len(full), bool)
        kept_near[around] = ~drop[len(full) :]
        some = kept_near[segment]
        if some.any():
            less = total[segment[some]] - each[some]
            keys.append(_mix(less ^ tag[segment[some]]))
            whose.append(owner[some])
        return np.concatenate(keys), np.concatenate(whose)


def parity(own: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Of each of ``bits`` classes of shingles whether the set has an odd number; as 64-bit words."""
    return np.packbits(np.bincount((own % _U(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").view(_U)


def fine(own: np.ndarray) -> np.ndarray:
    """The parity bitmap of two to four bits for each shingle, BITS times a power of two."""
    return parity(own, BITS << max(0, (2 * len(own) - 1) // BITS).bit_length())


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of fewer classes that a bitmap implies."""
    while len(bitmap) > words:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


_DOC = "struct<doc_id:bigint,n:bigint,set_key:binary,text_key:binary,bitmap:binary>"
_DEALT = f"cell int, row long, doc {_DOC}, keys binary, sets binary, hot boolean"
_FOUND = f"row long, key long, pivot long, doc {_DOC}"
_ARROW_DOC = pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("text_key", pa.binary()), ("bitmap", pa.binary())])


def _signed(docs: DataFrame, cells: int) -> DataFrame:
    """Rows of three kinds: documents; entries of a cell (keys, sets); members of hot keys."""

    def run(batches: Iterator[pa.RecordBatch]):
        signer, known = Signer(), set()
        schema = pa.schema([("cell", pa.int32()), ("row", pa.int64()), ("doc", _ARROW_DOC), ("keys", pa.binary()), ("sets", pa.binary()), ("hot", pa.bool_())])

        def rows(count, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)

        for batch in runtime.slices(batches, DOCS):
            ident, row = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            sets = hashed(batch.column("text").cast(pa.binary()).to_pylist())
            set_keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            described = [pa.array(ident, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_keys, pa.binary()), batch.column("text_key"), pa.array([fine(s).tobytes() for s in sets], pa.binary())]
            yield rows(len(sets), cell=[r % cells for r in row], row=row, doc=pa.StructArray.from_arrays(described, fields=list(_ARROW_DOC)))
            # A set that this task has signed before needs no more entries.
            new = []
            for i, key in enumerate(set_keys):
                if key is not None and ident[i] is not None and key not in known:
                    known.add(key)
                    new.append(i)
            if len(known) > 500_000:
                known.clear()
            keys, owner, hot = signer.sign([sets[i] for i in new])
            if not len(keys):
                continue
            # Within these documents a row is a small number.
            first_row, row = row[0], np.array(row, np.int64)
            who = row[new][owner]
            if hot.any():
                yield rows(int(hot.sum()), cell=(who[hot] % cells).astype(np.int32), row=who[hot], hot=np.ones(int(hot.sum()), bool), keys=[x.tobytes() for x in keys[hot]])
                first = np.zeros(len(keys), bool)
                first[np.flatnonzero(hot)[np.unique(keys[hot], return_index=True)[1]]] = True
                keys, who = keys[~hot | first], who[~hot | first]
            order = np.argsort(keys, kind="stable")
            keys, who = keys[order], (who[order] - first_row).astype(np.uint16)
            cell = ((keys >> _U(32)) * _U(cells) >> _U(32)).astype(np.int32)
            cut = np.flatnonzero(np.diff(cell, prepend=-1))
            ends = np.r_[cut[1:], len(cell)]
            yield rows(len(cut), cell=cell[cut], row=[first_row] * len(cut), keys=[keys[a:b].tobytes() for a, b in zip(cut, ends)], sets=[who[a:b].tobytes() for a, b in zip(cut, ends)])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, _DEALT)


def _buckets(signed: DataFrame) -> DataFrame:
    """Documents, and members (key, row, pivot) of the keys that several sets have; hot keys' members without pivot."""

    def run(batches: Iterator[pa.RecordBatch]):
        schema = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("pivot", pa.int64()), ("doc", _ARROW_DOC)])

        def rows(n, columns):
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        held, at = [], None

        def out():
            keys = np.frombuffer(b"".join(k for k, _, _ in held), np.int64)
            sets = np.concatenate([np.frombuffer(s, np.uint16) + np.int64(first) for _, s, first in held])
            held.clear()
            order = np.lexsort((sets, keys))
            keys, sets = keys[order], sets[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])] if len(keys) else np.zeros(0, bool)
            keys, sets = keys[new], sets[new]
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
            size = np.diff(np.r_[start, len(keys)])
            several = np.repeat(size > 1, size)
            if several.any():
                pivot = np.repeat(sets[start], size)
                yield rows(int(several.sum()), {"row": pa.array(sets[several]), "key": pa.array(keys[several]), "pivot": pa.array(pivot[several])})

        for batch in batches:
            documents = batch.filter(batch.column("doc").is_valid())
            if documents.num_rows:
                yield rows(documents.num_rows, {c: documents.column(c) for c in ("row", "doc")})
            hot = batch.filter(batch.column("hot").is_valid())
            if hot.num_rows:
                keys = np.frombuffer(b"".join(hot.column("keys").to_pylist()), np.int64)
                yield rows(hot.num_rows, {"row": hot.column("row"), "key": pa.array(keys)})
            entries = batch.filter(batch.column("sets").is_valid())
            for cell, keys, sets, first in zip(*(entries.column(c).to_pylist() for c in ("cell", "keys", "sets", "row"))):
                if cell != at and held:
                    yield from out()
                at = cell
                held.append((keys, sets, first))
        if held:
            yield from out()

    return signed.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, _FOUND)


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and compressed words of the wanted sets (text_key, rep); the one time that texts are moved."""

    def pack(batches):
        compress = zstandard.ZstdCompressor(level=1).compress
        known = set()
        for batch in runtime.slices(batches, DOCS):
            keys = batch.column("text_key").to_pylist()
            new = []
            for i, key in enumerate(keys):
                if key not in known:
                    known.add(key)
                    new.append(i)
            if len(known) > 500_000:
                known.clear()
            texts = batch.column("text").cast(pa.binary()).take(pa.array(new, pa.int32())).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in new], pa.binary()), pa.array([compress(b" ".join(words(t))) for t in texts], pa.binary())], names=["text_key", "packed"])

    own = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text")
    own = own.mapInArrow(pack, "text_key binary, packed binary")
    return own.join(wanted, "text_key").dropDuplicates(["rep"]).select("rep", "packed")


def near(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles may link, by sizes and parity bitmaps (rows of 64-bit words): never False for a link."""
    differ = np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)
    return (100 * np.minimum(n, m) >= LEAST * np.maximum(n, m)) & (differ * (100 + LEAST) <= (100 - LEAST) * (n + m))


def _words(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def _may(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (x, y) that sizes and bitmaps don't rule out."""
    own = nodes.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("bitmap").alias("bx"))
    other = nodes.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("bitmap").alias("by"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sizes = zip(*(batch.column(c).to_pylist() for c in ("nx", "ny")))
                keep = []
                for (n, m), a, b in zip(sizes, _words(batch.column("bx")), _words(batch.column("by"))):
                    fewer = min(len(a), len(b))
                    keep.append(bool(near(n, m, folded(a, fewer), folded(b, fewer))))
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("x", "y", "shared")], names=["x", "y", "shared"])

    columns = ["x", "y", "shared", "nx", "ny", "bx", "by"]
    return pairs.join(other, "y").join(own, "x").select(columns).mapInArrow(run, "x long, y long, shared long")


def _short(nodes: DataFrame) -> DataFrame:
    """rep, n and the bitmap of BITS classes."""

    def run(batches):
        for batch in batches:
            maps = [folded(b, BITS // 64).tobytes() for b in _words(batch.column("bitmap"))]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array(maps, pa.binary())], names=["rep", "n", "bitmap"])

    return nodes.select("rep", "n", "bitmap").mapInArrow(run, "rep long, n long, bitmap binary")


class _Sets(dict):
    """Sets of shingles by node, given their packed words."""

    def of(self, node: int, packed: bytes) -> set:
        found = self.get(node)
        if found is None:
            if len(self) >= KNOWN:
                self.clear()
            found = self[node] = shingles(zstandard.ZstdDecompressor().decompress(packed).split())
        return found


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (x, y) that link, on the words themselves."""

    def run(batches):
        sets = _Sets()
        for batch in runtime.slices(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("x", "y", "px", "py")))
            keep = pa.array([linked(sets.of(x, px), sets.of(y, py)) for x, y, px, py in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("x", "y")], names=["x", "y"])

    own = nodes.select(F.col("rep").alias("x"), F.col("packed").alias("px"))
    other = nodes.select(F.col("rep").alias("y"), F.col("packed").alias("py"))
    return pairs.select("x", "y").join(own, "x").join(other, "y").select("x", "y", "px", "py").mapInArrow(run, "x long, y long")


def _remaining(members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (x, y), x < y, in different components, of buckets of at least three sets, that may link.

    In a block, a member outside its bucket's largest component meets all others.
    """
    mine = _labelled(members, labels, "rep").select("key", "rep", F.col("rep_label").alias("label"))
    sizes = mine.groupBy("key", "label").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts"))
    # The two of a pair have been compared: one is the pivot.
    sizes = sizes.where("parts > 1 AND all > 2").select("key", "main", F.ceil((F.col("all") - F.col("most")) / FEW).cast("int").alias("few"), F.ceil(F.col("all") / MANY).cast("int").alias("many"))
    # Written first: then both sides of the join are plain shuffles, of which a hot key can be split.
    mine = mine.join(runtime.checkpoint(sizes), "key").join(nodes, "rep")
    place = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = mine.where("label <> main").withColumn("i", place(1, "few")).withColumn("j", upto("many")).withColumn("asks", F.lit(True))
    told = mine.withColumn("j", place(2, "many")).withColumn("i", upto("few")).withColumn("asks", F.lit(False))
    columns = ["key", "i", "j", "asks", "rep", "label", "n", "bitmap"]
    dealt = asks.select(columns).unionByName(told.select(columns)).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        held, last = [], None
        judged: set = set()

        def out():
            asks, rep, label, n, bitmap = (np.concatenate([h[c] for h in held]) for c in range(5))
            held.clear()
            found = set()
            told = np.flatnonzero(~asks)
            for r in np.flatnonzero(asks):
                other = told[label[told] != label[r]]
                other = other[near(n[r], n[other], bitmap[r], bitmap[other])]
                found.update((int(min(rep[r], o)), int(max(rep[r], o))) for o in rep[other])
            if len(judged) > 1_000_000:
                judged.clear()
            found -= judged  # a pair may meet in many buckets
            judged.update(found)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, asks, rep, label, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in columns[:7])
            bitmap = np.frombuffer(b"".join(batch.column("bitmap").to_pylist()), np.uint64).reshape(len(key), -1)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in zip(np.r_[0, cut], np.r_[cut, len(key)]):
                if last is not None and last != (key[a], i[a], j[a]):
                    yield from out()
                last = (key[a], i[a], j[a])
                held.append((asks[a:b].astype(bool), rep[a:b], label[a:b], n[a:b], bitmap[a:b]))
        if held:
            yield from out()

    return dealt.mapInArrow(run, "x long, y long").distinct()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    spark = docs.sparkSession
    runtime.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cells = CELLS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = runtime.checkpoint(_buckets(_signed(docs, cells)))
    runtime.release(spark)
    rows = found.where("doc IS NOT NULL").select("row", "doc.*")
    reps = runtime.checkpoint(rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL").groupBy("set_key").agg(F.min("row").alias("rep")))
    # Documents without words are sets of their own.
    held = rows.join(reps, "set_key", "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "row")))
    held = runtime.checkpoint(held.select("doc_id", "row", "rep", "n", "text_key", F.when(F.col("row") == F.col("rep"), F.col("bitmap")).alias("bitmap")))
    of = held.where("rep IS NOT NULL").select("row", "rep")
    members = runtime.checkpoint(found.where("doc IS NULL").join(of, "row").select("key", "rep", "pivot"))
    del found, rows, reps
    runtime.release(spark)
    hot = members.where("pivot IS NULL").select("key", "rep").distinct()
    stars = members.where("pivot IS NOT NULL").select("rep", F.col("pivot").alias("row")).groupBy("rep", "row").agg(F.count("*").alias("shared"))
    stars = stars.join(of.withColumnRenamed("rep", "y"), "row").select(F.col("rep").alias("x"), "y", "shared")
    pivots = runtime.checkpoint(hot.groupBy("key").agg(F.min("rep").alias("y")))
    stars = stars.unionByName(hot.join(pivots, "key").select(F.col("rep").alias("x"), "y", F.lit(1).cast("long").alias("shared")))
    stars = stars.where("x <> y").groupBy("x", "y").agg(F.sum("shared").alias("shared"))
    members = members.select("key", "rep")
    nodes = held.where("bitmap IS NOT NULL").select("text_key", "rep", "n", "bitmap")
    nodes = runtime.checkpoint(nodes.join(members.select("rep").distinct(), "rep"))
    stars = runtime.checkpoint(_may(stars, nodes))
    packed = runtime.checkpoint(_packed(docs, nodes.select("text_key", "rep")))
    nodes = nodes.drop("text_key")
    runtime.release(spark)
    # Rows of one doc_id are one document.
    own = held.where("doc_id IS NOT NULL").select("doc_id", "rep")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("y"), F.max("rep").alias("_last")).where("y < _last").drop("_last")
    same = own.join(several, "doc_id").where("rep > y").select(F.col("rep").alias("x"), "y").distinct()
    best = stars.groupBy("x").agg(F.max_by("y", F.struct("shared", -F.col("y"))).alias("y"))
    labels = components(_verified(best, packed).unionByName(same))
    tried = stars.join(best, ["x", "y"], "left_anti")
    labels = _joined(labels, runtime.checkpoint(_verified(_apart(tried, labels), packed)))
    compared = stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    rest = _remaining(members, labels, _short(nodes)).join(compared, ["x", "y"], "left_anti")
    rest = _may(rest.withColumn("shared", F.lit(0).cast("long")), nodes)
    labels = _joined(labels, runtime.checkpoint(_verified(rest, packed)))
    lowest = own.groupBy("rep").agg(F.min("doc_id").alias("lowest")).join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    names = lowest.where("label IS NOT NULL").groupBy("label").agg(F.min("lowest").alias("named"))
    lowest = lowest.join(names, "label", "left").select("rep", F.coalesce("named", "lowest").alias("component_id"))
    return held.join(lowest, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op12_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(runtime.table(spark, sf_dir, "documents").select("doc_id", "text"))
