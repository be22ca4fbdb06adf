"""Small helpers shared by the corpus operators: tables, the shared folder, cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bits of the hit filter (2 MB when broadcast, whatever the size of the input).
FILTER_BITS = 1 << 24
#: Bytes of texts that go to a Python worker at once.
BATCH_BYTES = "4m"
#: Characters of a plan's text that the driver keeps.
PLAN_TEXT = "8192"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own.

    Our own is a folder of this machine, so it serves local mode alone.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/strandline-{what}-{uuid.uuid4().hex[:12]}"


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, what: str, *aggregates) -> tuple[DataFrame, dict]:
    """As `written`, with aggregates over the rows, which the writing job takes along."""
    seen = Observation()
    out = written(df.observe(seen, *aggregates), what)
    return out, seen.get


class Scratch:
    """Tables of one operator's run: those that its result doesn't read go when it is done.

    with Scratch(spark) as scratch: table = scratch.written(df, "name")
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._folders = spark, []

    def __enter__(self) -> Scratch:
        return self

    def folder(self, what: str) -> str:
        self._folders.append(new_folder(self.spark, what))
        return self._folders[-1]

    def written(self, df: DataFrame, what: str) -> DataFrame:
        path = self.folder(what)
        df.write.option("compression", "zstd").parquet(path)
        trim_driver(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, df: DataFrame, what: str, *aggregates) -> tuple[DataFrame, dict]:
        seen = Observation()
        out = self.written(df.observe(seen, *aggregates), what)
        return out, seen.get

    def __exit__(self, *_) -> None:
        for path in self._folders:
            remove_folder(self.spark, path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffles and broadcasts of finished steps: it acts when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()
    trim_driver(spark)


def settings(spark: SparkSession) -> None:
    """What jobs over texts need of a session.

    Arrow batches by their bytes: rows of text are long, and a batch is in memory
    on both sides at once.  Short plan texts: the driver keeps those of a thousand
    executions, each as often as adaptive execution plans anew.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)


def plain_memory() -> None:
    """In a Python worker: Arrow's buffers come from the system's allocator, which `trim` clears."""
    pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """In a Python worker that is done with a task, and in the driver: what was freed goes back to the system, for workers wait long for the next one."""
    with contextlib.suppress(AttributeError, OSError):  # the C library can, or does so by itself
        ctypes.CDLL(None).malloc_trim(0)


def trim_driver(spark: SparkSession) -> str:
    """What the driver's Python and JVM have freed outside the Java heap goes back to the system; returns what the JVM says.

    Its compiler threads and the planning of each job leave fragments with the C
    library, hundreds of MB after a hundred jobs.  The JVM's own command gives them
    back; a JVM that doesn't know it (before 17.0.9, or on another C library) goes on
    as it is.
    """
    trim()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = jvm.java.lang.Class
    try:
        kinds = gateway.new_array(kind, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = kind.forName(name)
        # By the interface's method: the server's own class is not open to callers.
        invoke = kind.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        values = gateway.new_array(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values).strip()
    except Py4JError:
        return ""


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0


def shards_for(size: int, shard_bytes: int) -> int:
    return max(1, math.ceil(size / shard_bytes))


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def whole(df: DataFrame) -> Column:
    """All columns of df as one: beside it an operator's own columns may have any name."""
    return F.struct(*[column(c) for c in df.columns]).alias("row")


def unpacked(df: DataFrame, like: DataFrame, *more: Column) -> DataFrame:
    """The columns of `like` out of column row, then more."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in like.columns], *more)


def _spotted(df: DataFrame, hits: DataFrame, hit_key: str, how: str) -> DataFrame:
    """df (row, key) with bits of the broadcast bitmap that holds its key's place; how: inner, or left for rows without any."""
    bitmap = (
        hits.select(F.pmod(F.xxhash64(hit_key), F.lit(FILTER_BITS)).alias("spot")).distinct()
        .groupBy(F.expr("bitmap_bucket_number(spot)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(spot))").alias("bits"))
    )
    seek = df.withColumn("spot", F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))).withColumn("bucket", F.expr("bitmap_bucket_number(spot)"))
    return seek.join(F.broadcast(bitmap), "bucket", how)


def _bit():
    position = F.expr("bitmap_bit_position(spot)")
    byte = F.conv(F.hex(F.substring("bits", (position / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def keyed(df: DataFrame, key: Column) -> DataFrame:
    """df as (row, key)."""
    return df.select(whole(df), key.alias("key"))


def may_hit(packed: DataFrame, hits: DataFrame, hit_key: str) -> DataFrame:
    """Rows of packed (row, key) whose key may be among the hits, by a broadcast bitmap of fixed size.

    The bitmap has FILTER_BITS bits however many hits there are: it lets every
    true hit through and more of the others as it fills, so an exact join must
    follow.  It keeps the texts of rows that cannot match out of that join's
    shuffle.
    """
    return _spotted(packed, hits, hit_key, "inner").where(_bit()).select("row", "key")


def cannot_hit(packed: DataFrame, hits: DataFrame, hit_key: str) -> DataFrame:
    """The other rows: their key is not among the hits."""
    return _spotted(packed, hits, hit_key, "left").where(F.col("bits").isNull() | ~_bit()).select("row", "key")


def without(df: DataFrame, key: str, dropped: DataFrame, dropped_key: str) -> DataFrame:
    """Rows of df, all columns as they were, whose key is not among `dropped`; rows with a null key stay.

    Rows that the bitmap clears stay where they are; only the others meet the
    dropped keys in a join.
    """
    packed = keyed(df, column(key))
    keys = dropped.select(F.col(dropped_key).alias("gone")).distinct()
    some = may_hit(packed, dropped, dropped_key).join(keys, F.col("key") == F.col("gone"), "left_anti")
    return unpacked(cannot_hit(packed, dropped, dropped_key).union(some.select("row", "key")), df)
