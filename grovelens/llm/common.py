"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import inspect
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The contracts' word separators: space and \t \n \x0b \f \r.
BLANK = r"[\x20\x09-\x0D]"

#: Keys with more rows than this are split off by skew_join; the limit doubles until at most HOT_KEYS keys exceed it.
HOT_ROWS = 1_000
HOT_KEYS = 500_000
#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20

_own_dir: str | None = None
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and everything runs on this machine."""
    global _own_dir
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = f"file://{tempfile.mkdtemp(prefix='grovelens-')}"
    return _own_dir


def give_back() -> None:
    """Return freed memory of this worker to the machine: an idle worker then keeps none of what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, without that call


def trimmed(run):
    """run (batches to batches), with give_back() when a task is done."""

    def batches(given):
        try:
            yield from run(given)
        finally:
            give_back()

    return batches


def trimmed_after(run):
    """run (a group's tables to a table), with give_back() when nothing of the group but the result is left of it."""

    @functools.wraps(run)
    def group(*tables):
        try:
            return run(*tables)
        finally:
            give_back()

    group.__signature__ = inspect.signature(run)  # Spark counts the arguments
    return group


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES: executor and Python worker each hold a few of them at once."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(name).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/grovelens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._grovelens_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again."""
    for table in tables:
        path = table._grovelens_path
        _delete(_written.pop(path), path)


def release() -> None:
    """Delete the tables that materialize() wrote; frames that read them can't be used afterwards."""
    while _written:
        path, spark = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the files are then left behind
            return


atexit.register(release)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text, with the further columns asked for; all others, whatever their names, are left out."""
    return df.select(F.col("doc_id").cast(LongType()).alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def free_name(name: str, *frames: DataFrame) -> str:
    """name, with underscores before it until no frame has a column that differs from it by case alone."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def skew_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row for each key, without sending all rows of a hot key to one task.

    left is read up to three times, so it should be a written table or cheap. Keys of more than HOT_ROWS rows are counted
    first (with partial sums); their rows of right, HOT_KEYS at most, are broadcast, and all others are joined by a shuffle.
    Null keys match nothing and stay where they are: an inner join leaves them out, a left join keeps them.
    """
    given = left.filter(F.col(on).isNotNull())
    many = free_name("many", left)
    hot = materialize(given.groupBy(on).agg(F.count("*").alias(many)).filter(F.col(many) > HOT_ROWS))
    limit, keys = HOT_ROWS, hot.count()
    while keys > HOT_KEYS:
        limit *= 2
        keys = hot.filter(F.col(many) > limit).count()
    if keys:
        some = F.broadcast(hot.filter(F.col(many) > limit).select(on))
        cold = given.join(some, on, "left_anti").join(right, on, how)
        joined = cold.unionByName(given.join(F.broadcast(right.join(some, on, "left_semi")), on, "inner"))
        if how == "left":
            # hot keys that right lacks
            lacking = given.join(some, on, "left_semi").join(F.broadcast(right.join(some, on, "left_semi")), on, "left_anti")
            joined = joined.unionByName(lacking, allowMissingColumns=True)
    else:
        joined = given.join(right, on, how)
    if how == "left":
        joined = joined.unionByName(left.filter(F.col(on).isNull()), allowMissingColumns=True)
    return joined
