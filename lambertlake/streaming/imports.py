"""Structured streams: spectra files as they arrive, and event series in watermarked windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lambertlake.sources import reader


def arriving_files(spark: SparkSession, folder: str, glob: str | None = None, per_batch: int = 1000) -> DataFrame:
    """Spectra of new files of a folder; a file that can't be read is a row with a message."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_batch)
    if glob:
        files = files.option("pathGlobFilter", glob)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return reader.parsed(files.schema(schema).load(folder).select("path", "content"), strict=False)


def import_stream(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Hand each micro-batch to ``batch``; with ``once`` the query ends when all there is has been read."""
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def rejected(project) -> DataFrame:
    """batch, stream, source_file, source_sha256, message: a row for each file that into_project could not read."""
    schema = "source_file string, source_sha256 string, message string, stream string, batch long"
    if not project.files.names("_rejected"):
        return project.spark.createDataFrame([], schema)
    return project.spark.read.schema(schema).parquet(f"{project.files.root}/_rejected")


def into_project(project, stream: DataFrame, checkpoint: str, name: str = "import") -> StreamingQuery:
    """Append each micro-batch to a project, one commit and one log entry at a time, exactly once.

    The commit that adds a batch's spectra also notes the batch's number under the stream's
    ``name``, so a batch that Spark hands over again after a failure is left alone. Files that
    can't be read are rows of ``rejected``, in a folder by batch that is written anew if the batch
    comes again; the log entry counts them. A new ``checkpoint`` needs a new ``name``.
    """
    ledger = f"stream:{name}"

    def batch(df: DataFrame, n: int) -> None:
        done = project.meta(ledger)
        if done is not None and int(done) >= n:
            return
        bad = df.where(F.col("_error").isNotNull()).select("source_file", "source_sha256", F.col("_error").alias("message"))
        bad.write.mode("overwrite").parquet(f"{project.files.root}/_rejected/stream={name}/batch={n}")
        failed = project.spark.read.parquet(f"{project.files.root}/_rejected/stream={name}/batch={n}").count()
        good = df.where(F.col("_error").isNull()).select("name", "x", "y", "metadata")
        project.import_frame(good, meta={ledger: str(n)}, details={"stream": name, "batch": n, "rejected": failed})

    return import_stream(stream, checkpoint, batch)


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and range of a value per key and window; rows later than ``late`` are left out of a stream."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("_t", late)
    out = stamped.groupBy(F.window("_t", width).alias("w"), key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("w.start").alias("start"), key, "n", "mean", "min", "max")
