"""Continuous periods and gaps of overlapping intervals, by a sweep over boundary events.

Every span is turned into a plus event at its start and a minus event at its end. Events at one instant of one entity are summed
first (map-side), so a hot instant is one row. The time line of an entity is cut into buckets of ``bucket`` units; inside a bucket a
window computes the prefix sum of the events, and the count that is already open at the bucket's start comes from a prefix sum over the
(few) bucket totals. So an entity that holds a third of all rows is spread over as many tasks as it has buckets, and no task ever sees
more distinct instants than ``bucket``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HOUR_MS = 3_600_000


def boundaries(df: DataFrame, keys: list[str], start: str, end: str, bucket: int = HOUR_MS) -> DataFrame:
    """The instants where an entity's active count leaves or reaches zero: keys, _b (bucket), _t, _open (true where a period starts).

    Spans with a null key part, a null end or ``end <= start`` take no part. Repeated spans count once or twice alike."""
    valid = df.where(reduce(and_, [*(F.col(k).isNotNull() for k in keys), F.col(end) > F.col(start)]))
    at = lambda c, d: F.struct(F.col(c).cast("long").alias("t"), F.lit(d).alias("d"))
    spans = valid.select(*keys, F.explode(F.array(at(start, 1), at(end, -1))).alias("_e"))
    spans = spans.select(*keys, F.floor(F.col("_e.t") / F.lit(bucket)).alias("_b"), F.col("_e.t").alias("_t"), F.col("_e.d").alias("_d"))
    at = spans.groupBy(*keys, "_b", "_t").agg(F.sum("_d").alias("_d"))
    at = at.where("_d <> 0 AND _b IS NOT NULL AND _t IS NOT NULL")  # as many spans end as start here: the count is the same on both sides, and it isn't zero
    inner = W.partitionBy(*keys, "_b").orderBy("_t").rowsBetween(W.unboundedPreceding, 0)
    total = at.groupBy(*keys, "_b").agg(F.sum("_d").alias("_sum"))
    carry = total.select(*keys, "_b", F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))
    swept = at.withColumn("_run", F.sum("_d").over(inner)).join(carry, [*keys, "_b"])
    after = F.col("_run") + F.col("_carry")
    return swept.select(*keys, "_b", "_t", (after - F.col("_d")).alias("_before"), after.alias("_after")).where("_before = 0 OR _after = 0").select(*keys, "_b", "_t", (F.col("_before") == 0).alias("_open"))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, bucket: int = HOUR_MS, where: Column | None = None) -> DataFrame:
    """Columns keys, kind (`period` or `gap`), from_ms, to_ms.

    period: a longest stretch covered by spans; spans that overlap or touch belong together. gap: the stretch between two successive
    periods of one entity. An entity without a valid span has no rows; an empty table gives an empty result; other columns are ignored."""
    if where is not None:
        df = df.where(where)
    edge = boundaries(df.select(*dict.fromkeys([*keys, start, end])), keys, start, end, bucket)
    first = edge.groupBy(*keys, "_b").agg(F.min("_t").alias("_first"))
    nxt = first.select(*keys, "_b", F.lead("_first").over(W.partitionBy(*keys).orderBy("_b")).alias("_next"))
    inner = W.partitionBy(*keys, "_b").orderBy("_t")
    out = edge.withColumn("_lead", F.lead("_t").over(inner)).join(nxt, [*keys, "_b"])
    to = F.coalesce("_lead", "_next")
    return out.select(*keys, F.when(F.col("_open"), "period").otherwise("gap").alias("kind"), F.col("_t").alias("from_ms"), to.alias("to_ms")).where("to_ms IS NOT NULL")
