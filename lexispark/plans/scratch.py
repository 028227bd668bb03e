"""Tables between the steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side up to so many bytes may be sent to every task; beyond it the join is a shuffle.
BROADCAST_BYTES = 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder serves, but only in local
    mode, where driver and executors are one machine.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lexispark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs no recomputation of what came before. ``drop``
    deletes the table where nothing reads it any more; the rest goes when the
    driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete stored tables; what isn't a stored table is left alone."""
    for t in tables:
        path = getattr(t, "_scratch", None) if "_scratch" in t.__dict__ else None
        if path:
            fs, p = _hadoop(t.sparkSession, path)
            fs.delete(p, True)


def sendable(df: DataFrame, *sized: Column, fixed: int = 64) -> DataFrame:
    """``df``, marked for sending to all tasks where its rows take up to
    BROADCAST_BYTES: ``fixed`` bytes each and those of the ``sized`` columns."""
    each = F.lit(fixed).cast("long")
    for c in sized:
        each = each + c
    total = df.agg(F.coalesce(F.sum(each), F.lit(0))).collect()[0][0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def fresh(name: str, *taken: DataFrame) -> str:
    """``name``, made longer until no column of the tables is called so."""
    have = {c.lower() for t in taken for c in t.columns}
    while name.lower() in have:
        name += "_"
    return name


def running(rows: DataFrame, order: Column, amount: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over those before them in the order.

    Rows are ranged, and written so that both uses see the same ranges; a range
    starts from the sums of the ranges before it, so nothing is sorted in one task.
    """
    part, first, step = (fresh(x, rows) for x in ("part", "first", "step"))
    ranged = stored(rows.withColumn(step, amount.cast("long")).repartitionByRange(order).withColumn(part, F.spark_partition_id()), "ranged")
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranged.groupBy(part).agg(F.sum(step).alias(step)).select(part, F.coalesce(F.sum(step).over(earlier), F.lit(0)).alias(first))
    within = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn(name, F.coalesce(F.sum(step).over(within), F.lit(0)))
    return placed.join(F.broadcast(starts), part).withColumn(name, F.col(name) + F.col(first)).drop(part, first, step)
