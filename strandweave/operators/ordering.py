"""Global order without a single-task sort: ranks and running totals over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.session import save_scratch


def _by_range(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows range-partitioned by ``order`` with their partition number, kept in a scratch table
    so that the partition a row belongs to can never change between the uses below."""
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return save_scratch(parts)


def _totals_before(parts: DataFrame, amount: Column) -> DataFrame:
    """Sum over all earlier partitions; one row per partition, so small by construction."""
    totals = parts.groupBy("_part").agg(F.sum(amount).alias("_total"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_total").over(earlier), F.lit(0))
    return totals.select("_part", before.alias("_before"))


def running_total(df: DataFrame, key: str, amount: str, out: str) -> DataFrame:
    """Add ``out = 1 + sum of amount over rows with a smaller key`` (unique keys)."""
    parts = _by_range(df, [F.col(key)])
    inside = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    joined = parts.join(F.broadcast(_totals_before(parts, F.col(amount))), "_part")
    return joined.withColumn(out, own + F.col("_before") + 1).drop("_part", "_before")


def with_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add the 1-based position of each row in the given total order; ``_read`` lists the saved table it is read from."""
    parts = _by_range(df, order)
    inside = Window.partitionBy("_part").orderBy(*order)
    joined = parts.join(F.broadcast(_totals_before(parts, F.lit(1))), "_part")
    ranked = joined.withColumn(out, F.row_number().over(inside) + F.col("_before")).drop("_part", "_before")
    ranked._read = [parts]
    return ranked
