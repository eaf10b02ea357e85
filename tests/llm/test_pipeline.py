import tracemalloc

import corpus_pipeline as cp
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lambertlake.llm import bpe_codec, mixing, near_dedup, pii, runtime, toxicity
from tests.llm import test_mixing, test_near_dedup, test_pii

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = runtime.table(spark, SF, "documents")
    columns, kept = docs.columns, []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
        kept.append(docs.collect())
    first = {r.doc_id: r for r in runtime.table(spark, SF, "documents").collect()}
    whole = runtime.table(spark, SF, "documents")
    model = toxicity.fit(whole, runtime.table(spark, SF, "labels"))
    scores = {i: model.score(model.matrix([r.text]))[0] for i, r in first.items()}
    assert {r.doc_id for r in kept[0]} == {i for i, s in scores.items() if s < 0.7}
    lead = test_near_dedup.brute([(r.doc_id, r.text) for r in kept[0]])
    assert {r.doc_id for r in kept[1]} == {i for i, c in lead.items() if i == c}
    before = {r.doc_id: r.text for r in kept[1]}
    assert {r.doc_id for r in kept[2]} == set(before)
    given = spark.createDataFrame(kept[1], whole.schema)
    spans = {r.doc_id: r.spans for r in pii.find(given, pii.fit(given)).collect()}
    for r in kept[2]:
        text = before[r.doc_id]
        for s in reversed(spans[r.doc_id]):  # none overlap in this table
            text = f"{text[: s.start]}[{pii.KINDS[s.kind].upper()}]{text[s.stop :]}"
        assert r.text == text and r.n_chars == len(text) and not test_pii.brute(text)
        assert {f"{pii.KINDS[s.kind]}:{s.start}:{s.stop}" for s in spans[r.doc_id]} >= set(test_pii.brute(before[r.doc_id]))
    rows = mixing.measured(spark.createDataFrame(kept[2], whole.schema)).collect()
    wanted = test_mixing.brute([(r.doc_id, r.domain, r.lang, r.source, r.n_tokens) for r in rows], mixing.SHARE, 1)
    assert sorted(r.doc_id for r in kept[3]) == sorted(r[0] for r in wanted)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in kept[3]}
    assert {r.doc_id: r.ids for r in kept[4]} == {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s1", 5), (1, "", "en", "s1", 0), (2, "a@b.c " * 9, "en", "s1", 54), (2, "a@b.c " * 9, "en", "s1", 54)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            given = stage(spark, given, SF)
            given.collect()


class _OneWorker:
    """Stands for a DataFrame whose tasks all run here, as in one Python worker that is reused."""

    def __init__(self, real, batches):
        self.real, self.batches, self.schema, self.sparkSession = real, batches, real.schema, real.sparkSession

    def mapInArrow(self, run, schema):
        self.peak = 0
        for _ in run(iter(self.batches)):
            self.peak = max(self.peak, tracemalloc.get_traced_memory()[0])


def test_a_reused_worker_forgets_what_other_stages_learned(spark, monkeypatch):
    real = spark.createDataFrame([], "doc_id long, text string, text_key binary")
    texts = [" ".join(f"w{k}x" for k in range(at, at + 1000)) for at in range(0, 150_000, 1000)]
    rows = pa.table({"doc_id": range(len(texts)), "text": texts, "text_key": [b"k"] * len(texts)}).to_batches()
    worker = _OneWorker(real, rows)
    monkeypatch.setattr(near_dedup, "_keyed", lambda docs: docs)
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        bpe_codec.encode(worker)
        codec = worker.peak - before
        assert codec > 30e6  # the vocabulary and the words
        assert tracemalloc.get_traced_memory()[0] - before > 30e6  # kept for the operator's next task
        near_dedup._sign(worker, True)
        assert worker.peak - before < 0.7 * codec
        assert tracemalloc.get_traced_memory()[0] - before < 10e6
        bpe_codec.encode(worker)
        toxicity.score(worker, toxicity.Model({"w1x": 1.0}, {}, 0.5))
        assert worker.peak - before < 0.7 * codec
        assert tracemalloc.get_traced_memory()[0] - before < 10e6
    finally:
        tracemalloc.stop()
