"""Windows over long ordered groups, in two levels.

A plain window sorts each of its groups in one task. Here a group is cut into blocks that follow its order: rows
look at their neighbours within a block, and a block at what its predecessors sum up to; only one row a block meets
in the group's own window. A hot term, or a field with a billion terms, is then many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def in_order(df: DataFrame, group: list[str], block: Column, order: list[str | Column], rank: str | None = None, lag: dict[str, str] | None = None, single: bool = False) -> DataFrame:
    """df with the row's rank (from 0) in its group and, for each (column: new name) of lag, that column of the row before.

    block must not fall as order rises. Rows are dealt once, by group and block; what the blocks before hold is carried
    to the blocks of groups that have more than one, and to no others. With lag, order is one column, unique in its group.
    single says that all rows are known to lie in one block, which bounds every group: then a plain window does.
    """
    lag = lag or {}
    if single:
        inner = W.partitionBy(*group).orderBy(*order)
        out = df.withColumns({name: F.lag(column).over(inner) for column, name in lag.items()}) if lag else df
        return out.withColumn(rank, F.row_number().over(inner) - 1) if rank else out
    inner = W.partitionBy(*group, "_block").orderBy(*order)
    rows = df.withColumn("_block", block)
    last = F.struct(F.max(order[0]).alias(order[0])) if list(lag) == order else F.max_by(F.struct(*lag), order[0]) if lag else None
    sums = [F.count(F.lit(1)).alias("_n")] + ([last.alias("_last")] if lag else [])
    over = W.partitionBy(*group)
    blocks = rows.groupBy(*group, "_block").agg(*sums).withColumn("_blocks", F.count(F.lit(1)).over(over)).where("_blocks > 1")
    earlier = over.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")] + ([F.lag("_last").over(over.orderBy("_block")).alias("_carry")] if lag else [])
    rows = rows.withColumn("_rank", F.row_number().over(inner) - 1)
    for column in lag:
        rows = rows.withColumn(f"_lag_{column}", F.lag(column).over(inner))
    out = rows.join(blocks.select(*group, "_block", *carried), [*group, "_block"], "left")
    for column, name in lag.items():
        out = out.withColumn(name, F.when(F.col("_rank") == 0, F.col(f"_carry.{column}")).otherwise(F.col(f"_lag_{column}")))
    if rank:
        out = out.withColumn(rank, F.coalesce("_base", F.lit(0)) + F.col("_rank"))
    return out.drop("_block", "_rank", "_base", *(["_carry"] if lag else []), *(f"_lag_{c}" for c in lag))


def running_sum(df: DataFrame, block: Column, order: list[Column], value: str, name: str, rank: str) -> DataFrame:
    """df with the running sum and rank (from 1) of all rows in order; block must not fall as the order advances."""
    df = df.withColumn("_block", block)
    sums = df.groupBy("_block").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    base = sums.select("_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sums"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ns"))
    inner = W.partitionBy("_block").orderBy(*order)
    out = df.withColumn("_r", F.row_number().over(inner)).withColumn("_s", F.sum(value).over(inner.rowsBetween(W.unboundedPreceding, 0)))
    return out.join(base, "_block").withColumn(name, F.col("_sums") + F.col("_s")).withColumn(rank, F.col("_ns") + F.col("_r")).drop("_block", "_r", "_s", "_sums", "_ns")


def descending_block(value: Column) -> Column:
    """A block number that rises as value falls: the value's bit length, then its twelve next bits."""
    size = F.length(F.bin(F.greatest(value, F.lit(0))))
    lead = F.call_function("shiftright", value, F.greatest(size - 13, F.lit(0)))
    return -(size * 16384 + lead)
