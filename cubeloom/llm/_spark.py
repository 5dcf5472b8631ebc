"""Spark helpers of this subpackage: written tables in the shared folder, checked joins, row keys."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted payload is at most this.
BROADCAST_BYTES = 64 << 20
#: Rows of an Arrow batch, at most, in the sessions of operators that pass whole texts to Python.
ARROW_ROWS = 1000
SPACES = " \t\n\x0b\f\r"
WORD_RE = "[^\\x20\\x09-\\x0D]+"
SPACE_RE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a local one on a local master, else one below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="shared-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables of one operator call; each cuts the lineage and outlives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        # Texts can be long: Arrow batches of the default 10,000 rows would take much memory on both sides.
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for f in frames:
            path = jvm.org.apache.hadoop.fs.Path(f._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def tasks(spark: SparkSession, at_least: int = 1) -> int:
    """Shuffle tasks to use: the session's setting."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lean(run):
    """A function over Arrow batches that gives its memory back at the end: workers are used again, also by other operators."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def checked(side: DataFrame, payload_bytes: float) -> DataFrame:
    """``side`` marked for broadcast if its counted bytes are within the bound, else for a shuffled hash join."""
    return F.broadcast(side) if payload_bytes <= BROADCAST_BYTES else side.hint("shuffle_hash")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns, and the whole row as ``_row``: columns with any names pass through untouched."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *needed)


def unpacked(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of ``_row``, some of them changed."""
    return [changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns]


def words_of(text: Column) -> Column:
    """All words of a text as an array (empty for none)."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE))


def let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once for a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def ceil_log2(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n))))
