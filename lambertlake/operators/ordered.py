"""Operators that go through a series in order, batch by batch, with a state of bounded size."""

from __future__ import annotations

import heapq
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Median:
    """The median of a changing multiset: two heaps around it; what was taken away leaves a heap when it comes to its top."""

    def __init__(self) -> None:
        self.low: list[float] = []  # negated
        self.high: list[float] = []
        self.gone: Counter = Counter()
        self.below = self.above = 0  # values that count in either heap

    def add(self, x: float) -> None:
        if self.below and x > -self.low[0]:
            heapq.heappush(self.high, x)
            self.above += 1
        else:
            heapq.heappush(self.low, -x)
            self.below += 1
        self._balance()

    def remove(self, x: float) -> None:
        self.gone[x] += 1
        if x <= -self.low[0]:
            self.below -= 1
        else:
            self.above -= 1
        self._clean()
        self._balance()

    def _clean(self) -> None:
        for heap, sign in ((self.low, -1), (self.high, 1)):
            while heap and self.gone.get(sign * heap[0], 0):
                x = sign * heapq.heappop(heap)
                self.gone[x] -= 1
                if not self.gone[x]:
                    del self.gone[x]

    def _balance(self) -> None:
        while self.below > self.above + 1:
            heapq.heappush(self.high, -heapq.heappop(self.low))
            self.below, self.above = self.below - 1, self.above + 1
            self._clean()
        while self.above > self.below:
            heapq.heappush(self.low, -heapq.heappop(self.high))
            self.below, self.above = self.below + 1, self.above - 1
            self._clean()

    def value(self) -> float | None:
        if not self.below:
            return None
        return -self.low[0] if self.below > self.above else (self.high[0] - self.low[0]) / 2


def medians(values: Iterator[tuple[object, float | None]], half: int) -> Iterator[float | None]:
    """For (series, value) in order the median of the values up to ``half`` rows away in the series; nulls don't count."""
    window: deque = deque()  # from half before the row that is next to half behind it
    inside, last, ahead, back = Median(), object(), 0, 0

    def shift() -> float | None:
        nonlocal ahead, back
        got = inside.value()
        ahead -= 1
        back += 1
        if back > half:
            old = window.popleft()
            back -= 1
            if old is not None:
                inside.remove(old)
        return got

    for series, value in values:
        if series != last:
            while ahead:
                yield shift()
            window.clear()
            inside, last, ahead, back = Median(), series, 0, 0
        window.append(value)
        ahead += 1
        if value is not None:
            inside.add(value)
        if ahead > half:
            yield shift()
    while ahead:
        yield shift()


def running_median(df: DataFrame, series: str, position: str, y: str, window: int, out: str = "median") -> DataFrame:
    """The median over ``window`` rows (cut at the ends) around each row of a series.

    A row takes time logarithmic in the window, and a task holds a window and a batch or two.
    Null values don't count; a window without values has none. NaN isn't supported.
    """
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]):
        waiting: deque = deque()

        def rows():
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    yield from zip(batch.column(series).to_pylist(), batch.column("_y").to_pylist())

        ready: list = []
        for m in medians(rows(), window // 2):
            ready.append(m)
            if len(ready) == waiting[0].num_rows:
                batch = waiting.popleft()
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(ready, pa.float64())], names=schema.names)
                ready = []

    dealt = df.select(*names, df[y].cast("double").alias("_y")).repartition(series).sortWithinPartitions(series, position)
    return dealt.mapInArrow(run, schema)
