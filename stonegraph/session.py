"""Session helpers: sizing of shuffles, checked broadcasts, durable cuts of the lineage."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of ``df``; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int = 48 << 20, expansion: float = 1.0) -> int:
    """Partitions so that each holds about ``bytes_each``, at least the session's own number.

    ``expansion`` is the ratio of the bytes held in a task to the bytes the
    optimizer estimates (compressed files, for a scan).
    """
    spark, size = df.sparkSession, plan_bytes(df)
    if size > UNKNOWN:  # Catalyst doesn't know: data from the driver or from a checkpoint, or a join
        return max(shuffle_partitions(spark), df.rdd.getNumPartitions())
    return max(shuffle_partitions(spark), math.ceil(size * expansion / bytes_each))


def _checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it. Only a session on one machine may go without; its folder is then made. RuntimeError on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        wanted = sc.getConf().get("spark.checkpoint.dir")
        if not wanted and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="stonegraph-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


UNKNOWN = 1 << 50  #: bytes beyond which an estimate of Catalyst's tells nothing


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder and read back; a job runs.

    A checkpoint keeps the size estimated for its plan, which multiplies with
    each join: in a loop it soon has thousands of digits, and planning comes to
    a halt over them. So where the estimate tells nothing it is dropped.
    """
    spark = df.sparkSession
    _checkpoint_folder(spark)
    cut = df.checkpoint(eager=True)
    if plan_bytes(cut) > UNKNOWN:
        cut = DataFrame(spark._jsparkSession.internalCreateDataFrame(cut._jdf.queryExecution().toRdd(), cut._jdf.schema(), False), spark)
    return cut


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables under the cluster's shared checkpoint folder."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


BITS = 15  #: a row of a bit table has 2 ** BITS bits (4 KB)


class BitTable:
    """A filter of bigint hashes, of about 16 bits for each of ``count`` keys.

    It never exceeds ``2 ** most_log2`` bits (16 MB), whatever the number of
    keys, so it may be broadcast; with more keys than that it only lets more
    strangers through. What passes has to be joined exactly afterwards.
    """

    def __init__(self, keys: DataFrame, key: str, count: int, most_log2: int = 27):
        self.log2 = min(most_log2, max(BITS, (16 * max(1, count) - 1).bit_length()))
        at = keys.select(F.col(key).bitwiseAND((1 << self.log2) - 1).alias("_at")).distinct()
        bucket = F.shiftright("_at", BITS)
        parts = min(shuffle_partitions(keys.sparkSession), 1 << (self.log2 - BITS))
        self.table = at.repartition(parts, bucket).groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND((1 << BITS) - 1)).alias("_bits"))

    def _joined(self, rows: DataFrame, key: str, how: str) -> tuple[DataFrame, Column]:
        at = F.col(key).bitwiseAND((1 << self.log2) - 1)
        inner = at.bitwiseAND((1 << BITS) - 1).cast("int")
        byte = F.conv(F.hex(F.substring("_bits", F.shiftright(inner, 3) + 1, F.lit(1))), 16, 10).cast("bigint")
        table = self.table.withColumnRenamed("_bucket", "_of")
        return rows.join(F.broadcast(table), F.shiftright(at, BITS) == F.col("_of"), how), F.getbit(byte, inner.bitwiseAND(7)) == 1

    def held(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose ``key`` may be among the keys."""
        joined, bit = self._joined(rows, key, "inner")
        return joined.where(bit).drop("_of", "_bits")

    def strange(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose ``key`` is certainly not among the keys."""
        joined, bit = self._joined(rows, key, "left")
        return joined.where(F.coalesce(~bit, F.lit(True))).drop("_of", "_bits")


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """The rows of a small table, on the driver; ValueError if there are more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows and can't be held by the driver")
    return rows


def blank_to_null(c: Column) -> Column:
    """Null for null, empty and blank strings."""
    return F.when(F.length(F.trim(c)) > 0, c)
