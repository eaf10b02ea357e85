"""Token counts by heap-and-linked-list byte-pair merging.

A word is a doubly linked list of byte symbols. A heap gives the lowest-rank adjacent
pair again and again; each merge removes one symbol, so the count is the number of
initial symbols less the merges. No identifiers are made.

Null and empty texts count 0 tokens; repeated rows are counted each on their own. Only
the text column is read; other columns pass through unchanged, and an input column with
the output's name is replaced.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lambertlake.llm import runtime, wordbpe

#: Distinct words whose counts a worker remembers; beyond it the memory is emptied.
REMEMBERED = 800_000


def merged_length(symbols: list[str], merges: dict[tuple[str, str], tuple[int, str]]) -> int:
    """Symbols left after merging, lowest rank first and leftmost among equals."""
    n = len(symbols)
    if n < 2:
        return n
    here = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merges[pair][0], i, pair) for i in range(n - 1) if (pair := (here[i], here[i + 1])) in merges]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j >= n or here[i] != pair[0] or here[j] != pair[1]:
            continue  # one of the two has been merged meanwhile
        here[i], here[j] = merges[pair][1], ""
        done += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (pair := (here[i], here[k])) in merges:
                heapq.heappush(heap, (merges[pair][0], i, pair))
        if (h := before[i]) >= 0 and (pair := (here[h], here[i])) in merges:
            heapq.heappush(heap, (merges[pair][0], h, pair))
    return n - done


class _Counts(dict):
    """Count by word, filled when asked."""

    def __init__(self, bpe: wordbpe.WordBpe) -> None:
        super().__init__(dict.fromkeys(bpe.special, 1))
        self.bpe = bpe

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.bpe.special, 1))
        found = merged_length(self.bpe.symbols(word), self.bpe.merges)
        if len(word) <= runtime.LONG_WORD:
            self[word] = found
        return found


@runtime.kept
def shared(path: str) -> _Counts:
    """One memory for each Python worker, kept from task to task."""
    return _Counts(wordbpe.load(path))


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` with the number of tokens of each text in the long column ``out``."""
    runtime.small_batches(df.sparkSession)
    path = path or wordbpe.default_path()
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.LongType(), False)])
    columns = [f.name for f in kept]

    def run(batches):
        bpe = wordbpe.load(path)
        counts = shared(path)
        for batch in runtime.slices(batches):
            got = [sum(map(counts.__getitem__, bpe.pieces(t))) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(got, pa.int64())], names=[*columns, out])

    return df.mapInArrow(run, schema)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return count_tokens(docs).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )
