"""Session helpers shared by the operators."""

from __future__ import annotations

import functools
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python worker works on at once; texts may be hundreds of kB each.
ROWS = 256
#: Bytes of one Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20
#: Characters beyond which a worker doesn't remember what it found out about a word.
LONG_WORD = 64

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes that go to a Python worker at once, unless the session has a bound of its own.

    Batches of short rows stay as long as the session's number of records allows.
    """
    if spark.conf.get(_BYTES).rstrip("bB") == str(64 << 20):  # Spark's default
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what Python makes of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_kept: list = []


def kept(make: Callable) -> Callable:
    """What ``make`` gives is kept by the Python worker from task to task, until another operator's task forgets it."""
    made = functools.lru_cache(maxsize=1)(make)
    _kept.append(made)
    return made


def forget() -> None:
    """Drop what the Python worker keeps of earlier tasks of other operators.

    Spark hands workers on from stage to stage, and what several operators learned would add up.
    """
    for made in _kept:
        made.cache_clear()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and cut its lineage.

    The folder is the one the cluster names in spark.checkpoint.dir. Only a session in one
    local process gets a temporary one where that is unset; on a cluster, whose machines
    can't share such a folder, it is an error. Where the session sets
    spark.cleaner.referenceTracking.cleanCheckpoints, Spark deletes a checkpoint once nothing
    refers to it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lambertlake-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, whereupon Spark deletes shuffle files and checkpoints that nothing refers to.

    A driver with memory to spare may not do so for long, while the disks fill up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
