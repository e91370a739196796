"""Tables between the steps of a job, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: So many rows (under 100 bytes each) may go to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session without it, as in tests, gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = f"{tempfile.gettempdir()}/logloom-shared"
    return where.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This session's folder below :func:`shared_dir`; it is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/logloom/{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    Cuts the lineage: what follows survives lost executors without running the
    steps before again, and readers prune columns.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(rows: DataFrame, key: str, order_by: tuple[str, ...]) -> DataFrame:
    """``rows`` dealt by range of key and order and sorted, as a table, with ``_part`` and ``_row``, which grow in that order.

    A key with most rows spreads over parts; what a row needs to know of other parts is one row a part and key.
    """
    sorted_ = rows.repartitionByRange(key, *order_by).sortWithinPartitions(key, *order_by).withColumn("_row", F.monotonically_increasing_id())
    return stored(sorted_, "ranged").withColumn("_part", F.shiftright("_row", 33))  # all that follows must see the same partitions


def _beside_parts(rows: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """``rows`` of :func:`ranged` with what ``parts`` (``_p``, ``_key`` and more) holds for their part and key."""
    parts = stored(parts, "parts")
    few = parts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    on = (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(F.broadcast(parts) if few else parts.hint("merge"), on).drop("_p", "_key")


def beside(rows: DataFrame, key: str, about: DataFrame) -> DataFrame:
    """``rows`` with what ``about`` holds for their key, NULL where it holds nothing; ``about`` has one row a key.

    Few go to every executor, so rows stay where they are: dealt by key, a key with most rows would be in one task.
    """
    about = stored(about, "about")
    few = about.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(about) if few else about, key, "left")


def numbered(rows: DataFrame, key: str, order_by: tuple[str, ...], number: str) -> DataFrame:
    """``rows`` with a dense ``number`` from 0 inside each ``key``, in the order of ``order_by``.

    No window over a whole key: each run of a key in a part is shifted by the rows of its key in the parts before.
    """
    parts = ranged(rows, key, order_by)
    held = parts.groupBy(F.col("_part").alias("_p"), F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = _beside_parts(parts, key, held.select("_p", "_key", (before - F.col("_first")).alias("_shift")))
    return joined.withColumn(number, F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def running_sum(rows: DataFrame, key: str, order_by: tuple[str, ...], value: str, total: str) -> DataFrame:
    """``rows`` with ``total``, the sum of ``value`` over the rows of the key up to this one."""
    parts = ranged(rows, key, order_by)
    held = parts.groupBy(F.col("_part").alias("_p"), F.col(key).alias("_key")).agg(F.sum(value).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(value).over(Window.partitionBy("_part", key).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    joined = _beside_parts(parts.withColumn("_inside", inside), key, held.select("_p", "_key", before.alias("_before")))
    return joined.withColumn(total, F.col("_inside") + F.col("_before")).drop("_row", "_part", "_inside", "_before")


def next_value(rows: DataFrame, key: str, order_by: tuple[str, ...], value: str, following: str) -> DataFrame:
    """``rows`` with ``following``, the first ``value`` that is not null in the rows of the key behind this one."""
    parts = ranged(rows, key, order_by)
    held = parts.groupBy(F.col("_part").alias("_p"), F.col(key).alias("_key")).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("_row"))).alias("_n"))
    after = F.first("_n", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_p").rowsBetween(1, Window.unboundedFollowing))
    # The first behind a row is the last before it from the other end, which a window carries along.
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("_part", key).orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, -1))
    joined = _beside_parts(parts.withColumn("_inside", inside), key, held.select("_p", "_key", after.alias("_after")))
    return joined.withColumn(following, F.coalesce("_inside", "_after")).drop("_row", "_part", "_inside", "_after")
