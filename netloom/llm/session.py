"""Shared folder, checkpoints and small frame helpers used by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import checkpoint_folder, ship

#: ASCII white space of every contract, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/netloom/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_path`` named."""
    jvm = spark.sparkContext._jvm  # Spark has no public way to delete from any file system
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of frames made in here go when the action on them ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; no shuffle files of what led there stay."""
    checkpoint_folder(df.sparkSession)
    with no_shuffles_left(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


#: Bytes of an Arrow batch, unless the session has a limit of its own: a batch of very long texts has few rows.
BATCH_BYTES = 4 << 20
_LIMIT, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with this package on the executors' path, in batches of at most BATCH_BYTES and a row."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(_LIMIT) == _DEFAULT:
        df.sparkSession.conf.set(_LIMIT, str(BATCH_BYTES))

    def run(batches):
        yield from function(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Return a task's freed memory to the system: a Python worker lives on and runs other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
