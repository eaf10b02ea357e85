"""From raw documents to token identifiers, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; the caller writes
its result as Parquet and reads it again as the next stage's ``docs``. All but the last return
the columns of ``docs``. Empty tables pass through; null texts are handled as each operator
states, and columns beyond those of documents are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lambertlake.llm import bpe_codec, mixing, near_dedup, pii, runtime, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, learned from the labels of those that are left."""
    model = toxicity.fit(docs, runtime.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="_score").where(F.col("_score") < toxicity.REJECT).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each class of near duplicates."""
    return near_dedup.deduplicated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the names of their kinds; n_chars follows the text."""
    done = pii.redact(docs, pii.fit(docs))
    return done.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their source's budget, nine tenths of all tokens in one epoch at most.

    Rows that repeat a doc_id stay together: all of them, if one is taken.
    """
    taken = mixing.mix(mixing.measured(docs), max_epochs=1).select(F.col("doc_id").alias("_taken"))
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["_taken"]), "left_semi")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and the digests of identifiers and decoded text."""
    coded = bpe_codec.encode(docs.select("doc_id", "lang", "source", "text"), decoded="decoded")
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe_codec", encode),
]
#: Trained models, sketches and byte-pair merging have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = runtime.checkpoint(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
