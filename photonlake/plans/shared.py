"""Intermediate tables in the folder that driver and executors share, and numbering without a global sort."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_COUNT = itertools.count()
#: Folders that were named and not deleted yet.
_MADE: list[str] = []
#: Bytes of a side that is broadcast at most, with what a hash table takes for a row.
BROADCAST_BYTES = 16 << 20
_ROW_BYTES = 48


def _shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{root.rstrip('/')}/photonlake-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset, in local mode only, under the warehouse directory."""
    _MADE.append(f"{_shared_root(spark)}/{next(_COUNT)}")
    return _MADE[-1]


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_shared(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. DataFrames that were made from them can't be read after."""
    _delete(spark, _shared_root(spark))
    _MADE.clear()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``make`` returns, then delete the tables that were written on the way to it."""
    before = len(_MADE)
    out = materialise(make())
    for path in _MADE[before:-1]:
        _delete(spark, path)
    _MADE[before:] = _MADE[-1:]
    return out


def counted_bytes(df: DataFrame) -> int:
    """Bytes of a table's rows in a hash table, by one aggregate over it; so for tables that are written already."""
    width = F.lit(_ROW_BYTES + 8 * len(df.columns)).cast("bigint")
    for f in df.schema:
        if f.dataType.typeName() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif f.dataType.typeName() in ("array", "map"):
            width = width + 64 * F.greatest(F.coalesce(F.size(F.col(f"`{f.name}`")), F.lit(0)), F.lit(0))
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table as the right side of a join: broadcast if its counted bytes are few, else met by a merge join."""
    return F.broadcast(df) if counted_bytes(df) <= limit else df.hint("merge")


def carried(df: DataFrame, key: Column, width: int, add: Column, name: str) -> DataFrame:
    """``df`` with the running sum of ``add`` in the order of ``key`` (a whole number), itself included.

    Rows are dealt out by ``floor(key / width)``; each bucket's total is summed up over buckets in a table that has
    one row a bucket, so no task sorts the whole input. Ties of ``key`` share a sum.
    """
    cut = df.withColumn("_bucket", F.floor(key / width))
    totals = cut.groupBy(F.col("_bucket").alias("_b")).agg(F.sum(add).alias("_t"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(key)
    joined = cut.withColumn("_own", F.sum(add).over(inside)).join(totals, F.col("_bucket").eqNullSafe(F.col("_b")))
    return joined.withColumn(name, (F.col("_before") + F.col("_own")).cast("bigint")).drop("_bucket", "_b", "_before", "_own")
