"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density, weight and spread of lexicon words; lexicon words near a word
of the second person; shares of capitals, words in capitals, punctuation, digits and
obfuscation (symbols inside words, runs of symbols), and lexicon words that show once an
obfuscated word is undone. The lexicon is a short fixed list and what training labels add:
words, and stems of five letters, that are far more frequent in toxic training rows.

Training reads only labels whose crc32(doc_id as text) mod 3 is not 1, at most ``max_rows`` of
them (those of lowest hash) with one text each, so that fitting costs the same however large
the corpus; scoring reads every text whole. The calibration is out of sample for every row: the
training rows are dealt to FOLDS parts, each part is scored by a lexicon and trees made from
the others, and those scores are calibrated together. Labels, language, source and identifier
are no inputs of a score.

Null and empty texts get the score of a text without any features. Null labels are left out;
a document labelled twice counts as toxic if either label says so; of a labelled doc_id with
several texts the least text is taken. With no labels of one of the two kinds the score is the
smoothed share of toxic labels. Rows without doc_id are never learned from and not held out.
Repeated rows are scored each; other columns pass through.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lambertlake.llm import runtime

#: Labelled rows that training takes at most.
MAX_ROWS = 30_000
FOLDS = 3
REJECT = 0.7
STEM = 5
#: Entries the labels may add to the lexicon.
LEXICON = 2000
#: Words a worker remembers the weight of; words, and characters of them, that it counts at once.
REMEMBERED = 50_000
COUNTED, COUNTED_CHARS = 100_000, 4_000_000

# Insults in the four languages, and words of the second person.
INSULTS = (
    "idiot moron stupid loser pathetic worthless scum trash disgusting clown imbecile fool dumb "
    "idiota estúpido imbécil basura asqueroso payaso inútil idiote crétin stupide ordure minable dégoûtant "
    "trottel dumm depp abschaum müll wertlos ekelhaft versager"
).split()
YOU = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tú ti usted ustedes vosotros".split()

FEATURES = (
    "words capitals capital_words punctuation exclamations symbols digits obfuscated symbol_runs "
    "hits hit_density weight weight_density strongest distinct near_you near_you_density stem_hits undone"
).split()

_WORD = re.compile(r"\w+")
_CAPITAL_WORD = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_OBFUSCATED = re.compile(r"[^\W\d_]*[^\W\d_][@$*#!0-9]+[^\W\d_][\w@$*#!]*")
_RUN = re.compile(r"([!?*$%#&@])\1+")
_UNDO = str.maketrans("013457@$!", "oieastasi", "*#")


class Surface(NamedTuple):
    """What of a text doesn't depend on a lexicon: words, undone obfuscated words, features."""

    words: list[str]
    undone: list[str]
    features: list[float]


def surface(text: str) -> Surface:
    words = _WORD.findall(text.lower())
    n = len(words) or 1
    seen = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    size = max(1, int(seen.sum()))
    letters = max(1, int(seen[65:91].sum() + seen[97:123].sum() + seen[192:].sum()))
    symbols = int(seen[[35, 36, 37, 38, 42, 64, 94, 126]].sum())
    undone: list[str] = []
    runs = 0
    if symbols or seen[48:58].any() or seen[33]:
        undone = [found.lower().translate(_UNDO) for found in _OBFUSCATED.findall(text)]
        runs = len(_RUN.findall(text))
    measured = [
        math.log1p(len(words)), seen[65:91].sum() / letters, len(_CAPITAL_WORD.findall(text)) / n if seen[65:91].sum() > 2 else 0.0,
        (seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()) / size,
        seen[33] / size, symbols / size, seen[48:58].sum() / size, len(undone) / n, runs / n,
    ]
    return Surface(words, undone, measured)


@dataclass
class Tree:
    """A tree of fixed depth: per inner node a feature and a cut, per leaf a value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, rows, inner = np.zeros(len(x), np.int64), np.arange(len(x)), len(self.feature)
        while at[0] < inner if len(at) else False:
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.cut[at])
        return self.value[at - inner]


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    prior: float
    trees: list[Tree] = field(default_factory=list)
    raw_at: np.ndarray | None = None
    score_at: np.ndarray | None = None
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def weight(self, word: str) -> float:
        """Weight of a lower-cased word; -1 for the second person, 0 for most words."""
        found = self.words.get(word)
        if found is None:
            found = self.stems.get(word[:STEM], 0.0) if len(word) >= STEM else 0.0
        return found

    def features(self, given: Surface) -> list[float]:
        known, words = self.known, given.words
        try:
            weights = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            fresh = {w: self.weight(w) for w in set(words).difference(known)}
            known.update((w, x) for w, x in fresh.items() if len(w) <= runtime.LONG_WORD)
            weights = [known[w] if w in known else fresh[w] for w in words]
        n = len(words) or 1
        hits = near = stem_hits = 0
        total = strongest = 0.0
        distinct: set[str] = set()
        if any(weights):
            you = [i for i, w in enumerate(weights) if w < 0]
            at = 0
            for i, w in enumerate(weights):
                if w > 0:
                    hits, total, strongest = hits + 1, total + w, max(strongest, w)
                    distinct.add(words[i])
                    stem_hits += words[i] not in self.words
                    while at + 1 < len(you) and abs(you[at + 1] - i) <= abs(you[at] - i):
                        at += 1
                    near += bool(you) and abs(you[at] - i) <= 5
        undone = sum(self.weight(w) > 0 for w in given.undone)
        return [*given.features, hits, hits / n, total, total / n, strongest, len(distinct), near, near / n, stem_hits, undone]

    def matrix(self, texts) -> np.ndarray:
        return np.array([self.features(surface(t or "")) for t in texts], np.float64).reshape(-1, len(FEATURES))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), math.log(self.prior / (1 - self.prior)))
        for tree in self.trees:
            out += tree.predict(x)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        plain = 1 / (1 + np.exp(-raw))
        if self.raw_at is None:
            return plain
        # The calibrated steps have ties; a millionth of the plain score keeps their order.
        return np.clip(np.interp(raw, self.raw_at, self.score_at), 0, 1) * (1 - 1e-6) + 1e-6 * plain


def boost(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48) -> list[Tree]:
    """Trees for the logistic loss, grown level by level on binned features."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    # Rare features are zero at almost every quantile: cut just above zero and among the rest too.
    for j in range(width):
        if len(rest := x[x[:, j] > 0, j]):
            cuts[j] = np.unique(np.concatenate([cuts[j], [0.0], np.quantile(rest, np.linspace(0, 1, 9)[:-1])]))
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    most = 1 + max(map(len, cuts))
    raw = np.full(n, math.log(prior / (1 - prior)))
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-9)
        inner = 2**depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            for j in range(width):
                cell = (at - first) * most + codes[:, j]
                g = np.bincount(cell, slope, count * most).reshape(count, most).cumsum(1)
                h = np.bincount(cell, curve, count * most).reshape(count, most).cumsum(1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
                gain[(h < 1e-3) | (h_all - h < 1e-3)] = 0
                gain = gain[:, : len(cuts[j])]
                if gain.shape[1]:
                    k = gain.argmax(1)
                    top = gain[np.arange(count), k]
                    for i in np.flatnonzero(top > best):
                        best[i], feature[first + i], cut[first + i] = top[i], j, cuts[j][k[i]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, slope, 2**depth) / (np.bincount(leaf, curve, 2**depth) + 1)
        trees.append(Tree(feature, cut, value))
        raw += value[leaf]
    return trees


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: the blocks' mean raw scores and shares, both ascending."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of raw, sum of y, rows
    for r, v in zip(raw[order], y[order]):
        blocks.append([float(r), float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    # A block's share is shrunk a little, so that a handful of rows isn't taken for certainty.
    return np.array([b[0] / b[2] for b in blocks]), np.maximum.accumulate([(b[1] + 0.01) / (b[2] + 0.02) for b in blocks])


def _training_rows(docs: DataFrame, labels: DataFrame, text: str, max_rows: int) -> DataFrame:
    """_text, _toxic, _fold: one row for each label that is learned from."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = own.groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # so many rows at most, whatever the table's size
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(FOLDS)).cast("int"))
    found = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(rows), "doc_id")
    return found.groupBy("doc_id").agg(F.min("_text").alias("_text"), F.first("_toxic").alias("_toxic"), F.first("_fold").alias("_fold")).drop("doc_id")


def _lexicons(rows: DataFrame) -> list[tuple[dict[str, float], dict[str, float], int, int]]:
    """Words and stems far more frequent in toxic rows, and the rows of either label: without each fold, then of all."""

    def count(batches):
        runtime.forget()
        seen: dict[str, list[int]] = {}
        size = 0
        for batch in runtime.slices(batches):
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("_text", "_toxic", "_fold"))):
                words = set(_WORD.findall((text or "").lower()))
                for k in {f"w{w}" for w in words} | {f"s{w[:STEM]}" for w in words if len(w) >= STEM} | {"n"}:
                    own = seen.get(k)
                    if own is None:
                        own, size = seen.setdefault(k, [0] * (2 * FOLDS)), size + len(k)
                    own[2 * fold + (toxic > 0)] += 1
            if len(seen) > COUNTED or size > COUNTED_CHARS:
                yield _counted(seen)
                seen, size = {}, 0
        yield _counted(seen)

    # n0, n1: clean and toxic rows of the first fold, and so on.
    names = [f"n{i}" for i in range(2 * FOLDS)]
    counts = rows.mapInArrow(count, "key string, " + ", ".join(f"{n} long" for n in names)).groupBy("key").agg(*(F.sum(n).alias(n) for n in names))
    toxic_rows = sum((F.col(n) for n in names[1::2]), F.lit(0))
    counts = runtime.checkpoint(counts.where((toxic_rows >= 4) | (F.col("key") == "n")))
    total = counts.where(F.col("key") == "n").collect()
    if not total:
        return [({}, {}, 0, 0)] * (FOLDS + 1)
    parts, sizes = [], []
    for k in range(FOLDS + 1):
        own = [2 * f for f in range(FOLDS) if f != k]
        clean, toxic = (sum(total[0][names[i + t]] for i in own) for t in (0, 1))
        sizes.append((clean, toxic))
        have, against = (sum((F.col(names[i + t]) for i in own), F.lit(0)) for t in (1, 0))
        odds = F.log((have + 0.5) / (toxic + 1)) - F.log((against + 0.5) / (clean + 1))
        best = counts.where((F.col("key") != "n") & (have >= 4)).select(F.lit(k).alias("k"), "key", odds.alias("odds"))
        parts.append(best.where("odds > 2.5").orderBy(F.desc("odds"), "key").limit(LEXICON))
    made: list[tuple[dict, dict]] = [({}, {}) for _ in range(FOLDS + 1)]
    for r in functools.reduce(DataFrame.unionByName, parts).collect():
        made[r["k"]][r["key"][0] == "s"][r["key"][1:]] = float(r["odds"])
    return [(*m, *n) for m, n in zip(made, sizes)]


def _counted(seen: dict[str, list[int]]) -> pa.RecordBatch:
    columns = [pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(2 * FOLDS)]
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *columns], names=["key", *(f"n{i}" for i in range(2 * FOLDS))])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """Learn lexicon, trees and calibration from the labelled rows that aren't held out."""
    runtime.small_batches(docs.sparkSession)
    rows = runtime.checkpoint(_training_rows(docs, labels, text, max_rows))
    models = []
    for words, stems, clean, toxic in _lexicons(rows):
        words = dict.fromkeys(INSULTS, 2.0) | words | dict.fromkeys(YOU, -1.0)
        models.append(Model(words, stems, (toxic + 0.5) / (clean + toxic + 1)))
    final = models[FOLDS]
    if not clean or not toxic:  # of all rows
        return final

    def measure(batches):
        runtime.forget()
        for batch in runtime.slices(batches):
            given = [surface(t or "") for t in batch.column("_text").to_pylist()]
            x = [[v for m in models for v in m.features(g)] for g in given]
            columns = [pa.array(x, pa.list_(pa.float64())), batch.column("_toxic").cast(pa.int32()), batch.column("_fold")]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "fold"])

    got = rows.mapInArrow(measure, "x array<double>, y int, fold int").toPandas()
    x, y, fold = np.stack(got["x"].to_numpy()), (got["y"].to_numpy() > 0).astype(np.float64), got["fold"].to_numpy()
    order = np.lexsort([*x.T, y, fold])  # the same model whatever order the rows come in
    x, y, fold = x[order].reshape(len(y), FOLDS + 1, -1), y[order], fold[order]
    del rows
    runtime.release(docs.sparkSession)
    final.trees = boost(x[:, FOLDS], y, final.prior)
    raw = np.empty(len(y))
    for k, model in enumerate(models[:FOLDS]):
        model.trees = boost(x[fold != k, k], y[fold != k], model.prior)
        raw[fold == k] = model.raw(x[fold == k, k])
    final.raw_at, final.score_at = isotonic(raw, y)
    return final


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of toxicity in the double column ``out``."""
    runtime.small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != out]
    columns = [f.name for f in kept]
    given = df.sparkSession.sparkContext.broadcast(model)  # at most LEXICON words and 60 trees

    def run(batches):
        runtime.forget()
        own = given.value
        try:
            for batch in runtime.slices(batches):
                got = own.score(own.matrix(batch.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(got, pa.float64())], names=[*columns, out])
        finally:
            own.known.clear()  # the worker keeps the model for its next task, but needn't keep the words

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType(), False)]))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, runtime.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted")
    )
