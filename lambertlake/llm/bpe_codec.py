"""BPE encoding and decoding by traversal of a prefix-sharing trie.

The tokens of a text are those of its words, and a word's encoding can be read off the
last token of each of its prefixes: the last token ``t`` of a prefix is the only one whose
rest (the prefix without ``t``) ends in a token that merging would leave apart from ``t``.
So the distinct new words of a batch are put into a trie, and a depth-first walk hands each
node the last-token states of its ancestors; a prefix that many words share is worked out
once. A word's identifiers follow by stepping back from its end.

Two tokens stay apart unless a merge joins a symbol on the right edge of the first with one
on the left edge of the second before either is merged inwards.

Null and empty texts give no identifiers and decode to the empty text. Decoding null gives
null. Other columns pass through; an input column with an output's name is replaced.
"""

from __future__ import annotations

import array
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lambertlake.llm import runtime, wordbpe
from lambertlake.llm.token_counts import merged_length

#: Distinct words, and pairs of tokens, a worker remembers before it starts anew: some 150 MB.
REMEMBERED, REMEMBERED_PAIRS = 500_000, 300_000
FOREVER = 1 << 60


class TrieCodec:
    """Encodes words with one vocabulary."""

    def __init__(self, bpe: wordbpe.WordBpe) -> None:
        self.bpe = bpe
        self.rank = {pair: rank for pair, (rank, _) in bpe.merges.items()}
        parts = {joined: pair for pair, (_, joined) in bpe.merges.items()}
        self.single = {*bpe.byte, *(b + bpe.end for b in bpe.byte)}
        # A token that merging doesn't give from its own symbols is never the last one of anything.
        # Each gives itself, so that the pairs remembered share one copy of it.
        self.tokens = {t: t for t in (*self.single, *parts) if t in bpe.ids and self.reached(t)}
        self.longest = max(map(self.width, self.tokens))
        #: By a token's last three symbols (and word end), the widths of tokens so ending, longest first.
        self.widths: dict[str, list[int]] = {}
        for t in self.tokens:
            if (width := self.width(t)) > 2:
                self.widths.setdefault(t[width - 3 :], []).append(width)
        self.widths = {k: sorted({*v}, reverse=True) for k, v in self.widths.items()}
        # The symbols at an edge, from the whole token inwards, each with the rank at which it is merged on.
        self.right: dict[str, list[tuple[str, int]]] = {}
        self.left: dict[str, list[tuple[str, int]]] = {}
        for t in self.tokens:
            for side, edges in ((1, self.right), (0, self.left)):
                chain, at, until = edges.setdefault(t, []), t, FOREVER
                while at not in self.single:
                    chain.append((at, until))
                    until, at = self.rank[parts[at]], parts[at][side]
                chain.append((at, until))
        self.pairs: dict[tuple[str, str], bool] = {}
        #: A word's identifiers as 32-bit integers in a row.
        self.found: dict[str, bytes] = {}

    def width(self, token: str) -> int:
        return len(token) - len(self.bpe.end) * token.endswith(self.bpe.end)

    def reached(self, token: str) -> bool:
        """Whether merging the token's own symbols gives the token."""
        symbols = list(token[: self.width(token)])
        symbols[-1] += token[len(symbols) :]
        return merged_length(symbols, self.bpe.merges) == 1

    def apart(self, a: str, b: str) -> bool:
        """Whether merging leaves the neighbours ``a`` and ``b`` as they are."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            # Of equal pairs the left one goes first: a's own merge wins a tie, b's loses it.
            known = self.pairs[a, b] = not any(
                (r := self.rank.get((x, y))) is not None and r < x_until and r <= y_until
                for x, x_until in self.right[a]
                for y, y_until in self.left[b]
            )
        return known

    def last_token(self, spelled: str, states: list[str], depth: int, suffix: str) -> str:
        """The last token of the prefix of ``depth`` symbols, of which ``spelled`` has the last ones.

        states[i] is the last token of the first i symbols.
        """
        n = len(spelled)
        end = spelled[-3:] + suffix
        for width in self.widths.get(end, ()):
            if width <= n:
                t = self.tokens.get(spelled[n - width :] + suffix)
                if t is not None and (width == depth or self.apart(states[depth - width], t)):
                    return t
        if n > 1:
            t = self.tokens.get(spelled[-2:] + suffix)
            if t is not None and (depth == 2 or self.apart(states[depth - 2], t)):
                return t
        return spelled[-1] + suffix

    def learn(self, words) -> None:
        """Put the encodings of new words into ``found``."""
        ids, found, byte, end = self.bpe.ids, self.found, self.bpe.byte.__getitem__, self.bpe.end
        root: dict = {}
        for word in words:
            node = root
            for symbol in map(byte, word.encode("utf-8", "surrogatepass")):
                node = node.setdefault(symbol, {})
            node[""] = word  # a word ends here
        states, longest, last_token = [""], self.longest, self.last_token
        stack = [(1, symbol, node) for symbol, node in root.items()]
        while stack:
            depth, spelled, node = stack.pop()
            del states[depth:]
            if (word := node.pop("", None)) is not None:
                t = last_token(spelled, states, depth, end)
                out, at = [ids[t]], depth - self.width(t)
                while at:
                    t = states[at]
                    out.append(ids[t])
                    at -= len(t)
                out.reverse()
                found[word] = array.array("i", out).tobytes()
            if node:
                states.append(last_token(spelled, states, depth, ""))
                if depth >= longest:
                    spelled = spelled[1 - longest :]
                stack += [(depth + 1, spelled + s, child) for s, child in node.items()]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The identifiers of all texts in a row, and where each text's begin, with the end."""
        found, looked, new = self.found, [], set()
        if len(found) > REMEMBERED:
            found.clear()
        found.update({s: array.array("i", [i]).tobytes() for s, i in self.bpe.special.items()})
        for text in texts:
            words = self.bpe.pieces(text) if text else []
            got = list(map(found.get, words))
            if None in got:
                new.update(w for w, x in zip(words, got) if x is None)
                looked.append(words)
            else:
                looked.append(b"".join(got))
        gc.disable()  # a trie has no cycles, and walking a large one again and again costs more than it
        try:
            self.learn(new)
        finally:
            gc.enable()
        parts = [x if isinstance(x, bytes) else b"".join(map(found.__getitem__, x)) for x in looked]
        for word in new:
            if len(word) > runtime.LONG_WORD:
                del found[word]
        ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
        return np.frombuffer(b"".join(parts), np.int32), ends


@runtime.kept
def shared(path: str) -> TrieCodec:
    """One codec for each Python worker, which keeps what it has learned from task to task."""
    codec = TrieCodec(wordbpe.load(path))
    gc.freeze()
    return codec


def _with(df: DataFrame, out: dict[str, T.DataType], source: str, work) -> DataFrame:
    """``df`` with columns ``out`` that ``work()`` makes of the Arrow column ``source``."""
    runtime.small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in out]
    columns = [f.name for f in kept]

    def run(batches):
        of = work()
        for batch in runtime.slices(batches):
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), *of(batch.column(source))], names=[*columns, *out])

    return df.mapInArrow(run, T.StructType([*kept, *(T.StructField(name, kind) for name, kind in out.items())]))


def _decoder(path: str):
    strings = pa.array(wordbpe.load(path).strings)

    def of(column: pa.ListArray) -> pa.Array:
        first, last = column.offsets[0], column.offsets[-1]
        tokens = strings.take(column.values.slice(first.as_py(), last.as_py() - first.as_py()))
        return pc.binary_join(pa.ListArray.from_arrays(pc.subtract(column.offsets, first), tokens, mask=column.is_null()), " ")

    return of


def encode(df: DataFrame, text: str = "text", out: str = "ids", decoded: str | None = None, path: str | None = None) -> DataFrame:
    """``df`` with the identifiers of each text in the array<int> column ``out``.

    With ``decoded`` the identifiers are decoded again in the same pass, into that column:
    a second one would keep a second worker, with its own memory, for each task.
    """
    path = path or wordbpe.default_path()

    def work():
        codec = shared(path)
        back = _decoder(path) if decoded else None

        def of(column):
            values, ends = map(pa.array, codec.encode(column.to_pylist()))
            ids = pa.ListArray.from_arrays(ends, values)
            return (ids, back(ids)) if back else (ids,)

        return of

    columns = {out: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    return _with(df, columns, text, work)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of each list of identifiers in the string column ``out``.

    The vocabulary file names no decoder, so the tokens are joined by single spaces.
    """
    path = path or wordbpe.default_path()

    def work():
        back = _decoder(path)
        return lambda column: (back(column),)

    return _with(df, {out: T.StringType()}, ids, work)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id with the number and digest of the identifiers and the digest of the decoded text."""
    return df.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )


def op7_bpe_codec(spark, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, decoded="decoded"))
