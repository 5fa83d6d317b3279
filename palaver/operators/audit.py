"""Indexes beside stored objects: lookups with fallbacks, gaps between them, saved versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last save of every key, by the order columns (upserts as latest-wins)."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in cols))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows whose key has no new ones, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without_deleted(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no tombstone."""
    return df.join(tombstones.select(key).distinct(), key, "left_anti")


def fallback_lookup(rows: DataFrame, objects: DataFrame, first: Column, second: Column) -> DataFrame:
    """rows with found (the stored key: the new layout's, else the old one's, else null) and layout."""
    o = objects.select("objkey").distinct()
    a = o.select(F.col("objkey").alias("_k1"), F.lit("new").alias("_l1"))
    b = o.select(F.col("objkey").alias("_k2"), F.lit("legacy").alias("_l2"))
    j = rows.withColumn("_k1", first).withColumn("_k2", second).join(a, "_k1", "left").join(b, "_k2", "left")
    return j.withColumn("layout", F.coalesce("_l1", "_l2")).withColumn("found", F.when(F.col("_l1").isNotNull(), F.col("_k1")).when(F.col("_l2").isNotNull(), F.col("_k2"))).drop("_k1", "_k2", "_l1", "_l2")


def index_gaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: keys of one index that the other lacks (`only_a`, `only_b`)."""
    x, y = (d.where(F.col(key).isNotNull()).select(key).distinct() for d in (a, b))
    return x.join(y, key, "left_anti").withColumn("side", F.lit("only_a")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("only_b")))


def backfilled(rows: DataFrame, docs: DataFrame, key: str, value: str) -> DataFrame:
    """rows with ``value`` taken from docs where it is missing."""
    d = docs.groupBy(key).agg(F.min(value).alias("_v"))
    return rows.join(d, key, "left").withColumn(value, F.coalesce(value, "_v")).drop("_v")


def union_lists(parts: list[DataFrame]) -> DataFrame:
    """All rows of the parts, in columns by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_name(df: DataFrame, name: str, locale: str = "ru") -> DataFrame:
    """Rows in the order of a language's collation, nulls last."""
    return df.orderBy(F.collate(F.col(name), locale).asc_nulls_last(), name)
