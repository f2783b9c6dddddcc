"""Running sums over keys that may hold much of a table: ranges of rows, each summed on its own, added to the ranges before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fixed(df: DataFrame) -> DataFrame:
    """``df`` as it is now, however often it is read: in the shared folder that ``spark.checkpoint.dir`` names; a local session without one caches."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
    return df.persist()


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same keys up to this one in ``order``, which should be total.

    Rows are dealt by ranges of (keys, order), so a key with a third of all rows is many tasks' work; the sums of ranges, one for
    each key in each task, are all that is summed by key alone. Null keys are a key of their own.
    """
    ranged = fixed(df.withColumn("_v", value).repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    inside = F.sum("_v").over(Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy("_p", *keys).agg(F.sum("_v").alias("_n"))
    sizes = sizes.select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.coalesce(before, F.lit(0)).alias("_b"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)], F.col("_p") == F.col("_q"))
    return ranged.withColumn("_i", inside).join(sizes, same).withColumn(name, F.col("_i") + F.col("_b")).select(*df.columns, name)
