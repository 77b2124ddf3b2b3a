"""What the operators of this subpackage share: table access and shared storage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wirespark-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps survive lost executors without recomputing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_held: dict = {}


def held(key, make):
    """What is costly to make and large, one of a kind in a worker process: when another step asks for its own, the last one goes."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


@contextlib.contextmanager
def uncollected():
    """Without cyclic garbage collection for a while: memos hold very many small objects and no cycles, and walking them costs time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def without_gc(run):
    """A function of batches, for mapInArrow, that runs so."""

    def wrapped(batches):
        with uncollected():
            yield from run(batches)

    return wrapped


def release() -> None:
    """Workers serve many steps: those that don't use the memo of another give it up."""
    if _held:
        _held.clear()
        trim()


def trim() -> None:
    """Give freed memory back to the system (glibc only)."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slabs(texts: Iterable[str], most: int = 1 << 20) -> Iterable[list[str]]:
    """Consecutive texts in groups of about `most` characters, so that a batch of long texts needs bounded memory."""
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text with null as empty, and the named columns; whatever else the table has is dropped, so nothing clashes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def fold(column: str = "doc_id", parts: int = 4):
    """crc32 of the id as text, modulo parts: the folds that keep held-out rows out of training. Rows without an id are in none (-1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(-1))


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
