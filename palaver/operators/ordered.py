"""Row order within groups of any size.

A plain window over a group sorts the group in one task. These cut a group into blocks of the order column, work inside the blocks and carry over the
borders through a table with one row per block, so that a group with a third of all rows is spread over many tasks. Rows with a null key or position have no
place in an order and are left out; saying so in every branch also lets Spark see that the branches share their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 4096


def _blocked(df: DataFrame, keys: list[str], pos: str, block: int) -> DataFrame:
    placed = " AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, pos])
    return df.where(placed).withColumn("_b", F.floor(F.col(pos) / F.lit(block))).where("_b IS NOT NULL")


def with_previous(df: DataFrame, keys: list[str], pos: str, cols: list[str], name: str = "prev", block: int = BLOCK) -> DataFrame:
    """Adds ``name``: a struct of the columns ``cols`` of the row before by pos in its group (null for the first). (keys, pos) must be unique."""
    row = F.struct(*cols)
    d = _blocked(df, keys, pos, block)
    last = d.groupBy(*keys, "_b").agg(F.max_by(row, F.col(pos)).alias("_l"))
    carry = last.select(*keys, "_b", F.lag("_l").over(W.partitionBy(*keys).orderBy("_b")).alias("_c"))
    inner = W.partitionBy(*keys, "_b").orderBy(pos)
    return d.withColumn("_p", F.lag(row).over(inner)).join(carry, [*keys, "_b"], "left").withColumn(name, F.coalesce("_p", "_c")).drop("_b", "_p", "_c")


def with_running_sum(df: DataFrame, keys: list[str], pos: str, value: Column, name: str, exclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """Adds the running sum of a value by pos in its group; exclusive leaves the row's own out."""
    d = _blocked(df, keys, pos, block).withColumn("_v", F.coalesce(value, F.lit(0)))
    total = d.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    carry = total.select(*keys, "_b", F.coalesce(F.sum("_s").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_c"))
    inner = W.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    own = F.col("_v") if exclusive else F.lit(0)
    return d.withColumn("_r", F.sum("_v").over(inner)).join(carry, [*keys, "_b"]).withColumn(name, F.col("_r") + F.col("_c") - own).drop("_b", "_v", "_r", "_c")
