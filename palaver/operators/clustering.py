"""Speaker clusters from voice vectors: centroids, adaptive mutual-nearest merging, absorption of small clusters.

Labels of one recording are few; recordings are many. Everything is grouped by recording (grp), so only labels of one recording meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TINY = 1e-8


def dot(a: str | Column, b: str | Column) -> Column:
    """The sum of products of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: str | Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + TINY
    return F.transform(v, lambda x: x.cast("double") / norm)


def total_durations(segments: DataFrame) -> DataFrame:
    """Speech per label over all segments, whatever their length."""
    return segments.groupBy("grp", "label").agg(F.sum("duration").alias("total"))


def centroids(segments: DataFrame, longest: int = 10, least: float = 1.0) -> DataFrame:
    """grp, label, centroid, weight: the normalised mean vector of a label's longest segments of at least ``least`` seconds.

    segments: grp, label, seg, duration, embedding. Ties of length: the smaller seg."""
    w = W.partitionBy("grp", "label").orderBy(F.desc("duration"), "seg")
    top = segments.where((F.col("duration") >= least) & F.col("embedding").isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= longest)
    dims = top.select("grp", "label", F.posexplode("embedding").alias("d", "x")).groupBy("grp", "label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = dims.groupBy("grp", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    weight = top.groupBy("grp", "label").agg(F.sum("duration").alias("weight"))
    return mean.join(weight, ["grp", "label"]).select("grp", "label", unit("v").alias("centroid"), "weight")


def merge_nearest(cents: DataFrame, floor: float = 0.8) -> DataFrame:
    """grp, label, merged: each label's cluster after one round of merging.

    The threshold of a recording is the middle of the widest gap between its sorted pair similarities, but at least ``floor``; with fewer than two
    pairs there is no gap and nothing merges. Two labels merge if each is the other's nearest (ties: the smaller label) and their similarity reaches the
    threshold; the smaller label names the cluster."""
    a = cents.select("grp", F.col("label").alias("a"), F.col("centroid").alias("va"))
    b = cents.select("grp", F.col("label").alias("b"), F.col("centroid").alias("vb"))
    sims = a.join(b, "grp").where("a < b").select("grp", "a", "b", dot("va", "vb").alias("sim"))  # labels of one recording
    down = W.partitionBy("grp").orderBy(F.desc("sim"), "a", "b")
    gaps = sims.withColumn("_next", F.lead("sim").over(down)).where("_next IS NOT NULL")
    cut = gaps.groupBy("grp").agg(F.max_by((F.col("sim") + F.col("_next")) / 2, F.struct(F.col("sim") - F.col("_next"), (-F.col("sim")).alias("s"))).alias("cut"))
    both = sims.select("grp", F.col("a").alias("x"), F.col("b").alias("y"), "sim").union(sims.select("grp", F.col("b").alias("x"), F.col("a").alias("y"), "sim"))
    k = F.row_number().over(W.partitionBy("grp", "x").orderBy(F.desc("sim"), "y"))
    near = both.withColumn("_k", k).where("_k = 1").select("grp", "x", "y", "sim")
    back = near.select("grp", F.col("x").alias("y"), F.col("y").alias("x"))
    mutual = near.join(back, ["grp", "x", "y"]).join(cut, "grp", "left").where(F.col("sim") >= F.greatest(F.coalesce("cut", F.lit(1.0)), F.lit(floor)))
    to = mutual.where("x > y").select("grp", F.col("x").alias("label"), F.col("y").alias("_to"))
    return cents.select("grp", "label").join(to, ["grp", "label"], "left").select("grp", "label", F.coalesce("_to", "label").alias("merged"))


def merged_centroids(cents: DataFrame, merges: DataFrame) -> DataFrame:
    """Centroids of the clusters: the normalised mean of their members', weighted by duration."""
    d = cents.join(merges, ["grp", "label"]).select("grp", "merged", "weight", F.posexplode("centroid").alias("d", "x"))
    d = d.groupBy("grp", "merged", "d").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"))
    v = d.groupBy("grp", "merged").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    w = cents.join(merges, ["grp", "label"]).groupBy("grp", "merged").agg(F.sum("weight").alias("weight"))
    return v.join(w, ["grp", "merged"]).select("grp", F.col("merged").alias("label"), unit("v").alias("centroid"), "weight")


def absorb_small(totals: DataFrame, cents: DataFrame, least: float = 10.0) -> DataFrame:
    """grp, label, absorbed: clusters with less than ``least`` seconds of speech go to the nearest big one; without a vector, or without a big one, they stay."""
    t = totals.join(cents.select("grp", "label", "centroid"), ["grp", "label"], "left")
    small = t.where((F.col("total") < least) & F.col("centroid").isNotNull()).select("grp", F.col("label").alias("s"), F.col("centroid").alias("vs"))
    big = t.where((F.col("total") >= least) & F.col("centroid").isNotNull()).select("grp", F.col("label").alias("b"), F.col("centroid").alias("vb"))
    best = small.join(big, "grp").groupBy("grp", F.col("s").alias("label")).agg(F.max_by("b", F.struct(dot("vs", "vb"), (-F.xxhash64("b")).alias("h"))).alias("to"))
    return totals.select("grp", "label").join(best, ["grp", "label"], "left").select("grp", "label", F.coalesce("to", "label").alias("absorbed"))


def absorbed_clusters(segments: DataFrame, names: DataFrame, cents: DataFrame, least: float = 10.0, longest: int = 10) -> DataFrame:
    """grp, label, absorbed: the cluster of every label after small clusters have gone to big ones.

    segments: as of centroids(); names: grp, label, merged (labels without a centroid may be missing); cents: grp, label (a cluster), centroid. A cluster counts with the time of all segments of its
    labels. One without a centroid gets that of its naming label's longest segments, whatever their length; without any vector it stays."""
    every = segments.select("grp", "label").distinct().join(names, ["grp", "label"], "left").select("grp", "label", F.coalesce("merged", "label").alias("merged"))
    totals = total_durations(segments).join(every, ["grp", "label"]).groupBy("grp", F.col("merged").alias("label")).agg(F.sum("total").alias("total"))
    fallback = centroids(segments.join(cents.select("grp", "label"), ["grp", "label"], "left_anti"), longest, 0.0)
    to = absorb_small(totals, cents.select("grp", "label", "centroid").unionByName(fallback.select("grp", "label", "centroid")), least)
    return every.join(to.withColumnRenamed("label", "merged"), ["grp", "merged"]).select("grp", "label", "absorbed")


def merge_rounds(cents: DataFrame, rounds: int, floor: float = 0.8) -> DataFrame:
    """grp, label, merged after several rounds: each round merges the clusters of the one before; names are followed to the end.

    Every round is written out, so that a lost executor doesn't send the next one back to the start."""
    from palaver.session import materialise

    names, now = cents.select("grp", "label", F.col("label").alias("merged")), cents
    for _ in range(rounds):
        step = materialise(merge_nearest(now, floor))
        if step.where("label <> merged").isEmpty():
            break
        now = materialise(merged_centroids(now, step))
        names = materialise(names.join(step.select("grp", F.col("label").alias("merged"), F.col("merged").alias("_to")), ["grp", "merged"], "left").select("grp", "label", F.coalesce("_to", "merged").alias("merged")))
    return names
