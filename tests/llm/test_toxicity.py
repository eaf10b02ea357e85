import numpy as np
from pyspark.sql import functions as F

from lambertlake.llm import toxicity as tx


def auc(score, y):
    ranks = np.empty(len(score))
    s = np.sort(score)
    ranks = (np.searchsorted(s, score, "left") + np.searchsorted(s, score, "right") + 1) / 2
    return (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = tx.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.97
    assert ((held.score >= 0.7).astype(int) == held.predicted).all()
    assert held[held.predicted == 1].toxic.mean() > 0.97
    assert held[held.toxic == 1].predicted.mean() > 0.85


def test_small_sample(spark):
    sf = "/root/testdata/sf0.01"  # 33 toxic rows to learn from
    got = tx.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.95
    assert held[held.toxic == 1].predicted.mean() > 0.75 and held[held.toxic == 0].predicted.mean() < 0.02


def test_held_out_labels_change_no_score(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert turned.exceptAll(labels).count() > 100
    models = [tx.fit(docs, x) for x in (labels, turned, labels.where(~tx.held_out(F.col("doc_id"))))]
    texts = [r.text for r in docs.select("text").collect()]
    scores = [m.score(m.matrix(texts)) for m in models]
    assert (scores[0] == scores[1]).all() and (scores[0] == scores[2]).all()
    # Other columns are no inputs: the same texts under other names get the same scores.
    other = docs.select(F.lit(7).cast("long").alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("other").alias("source"))
    assert sorted(r.score for r in tx.score(other, models[0]).collect()) == sorted(scores[0])


def test_training_rows_are_one_for_each_label(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i % 40} {'idiot' * (i % 3)}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, toxic int")
    rows = tx._training_rows(docs, labels, "text", 10).collect()
    assert len(rows) == 10 == len({r._text.split()[1] for r in rows})
    assert tx._training_rows(docs, labels, "text", 1000).count() == labels.where(~tx.held_out(F.col("doc_id"))).distinct().count()


def test_no_row_is_calibrated_by_what_it_taught(spark):
    # Without signal a leaky calibration would find some; out of sample the scores stay near the share of toxic rows.
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 400, 30))) for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(rng.random() < 0.2)) for i in range(900)], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    got = model.score(model.matrix([r.text for r in docs.collect()]))
    assert (got < 0.7).all()


def test_isotonic_is_monotone():
    raw = np.array([0.0, 1, 2, 3, 4, 5])
    at, to = tx.isotonic(raw, np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(at) > 0).all() and (np.diff(to) >= 0).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you idiot " * 9), (3, "you idiot " * 9), (4, "1d10t " * 50000)], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("clash")).withColumn("_toxic", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = tx.score(docs, tx.fit(docs, none)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    assert tx.score(docs, tx.fit(docs, one)).count() == 5
    assert tx.score(docs.limit(0), tx.fit(docs.limit(0), one)).count() == 0
    held = spark.createDataFrame([(None,), (1,)], "doc_id long").select(tx.held_out(F.col("doc_id")).alias("h")).collect()
    assert held[0].h is False and held[1].h is not None
