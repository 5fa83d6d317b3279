"""Near-equal short texts inside groups: trigram Dice joins, entity overlap, greedy first-wins dedup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import text as X
from palaver.session import materialise

NEAR, LOW = 0.6, 0.3


def _prefix(g: str, least: float) -> Column:
    """Hashes of the grams, in one global order, of which two sets of Dice >= least share at least one: an exact filter."""
    n = F.size(g) - F.ceil(F.size(g) * F.lit(least / (2 - least)) - 1e-9).cast("int") + 1
    return F.slice(F.array_sort(F.transform(g, lambda x: F.xxhash64(x))), 1, n)


def _not_alone(items: DataFrame) -> DataFrame:
    """Items of groups of two or more: the others have no pairs, and their texts needn't be looked at."""
    return items.join(items.groupBy("grp").agg(F.count("*").alias("_n")).where("_n > 1").select("grp").hint("merge"), "grp", "left_semi")


def dice_pairs(items: DataFrame, least: float = LOW, below: float | None = None) -> DataFrame:
    """grp, i, j, score: pairs i < j of a group whose Dice score is at least ``least`` and, if given, less than ``below``.

    items: grp, pos, text; (grp, pos) unique, grp not null. Exact: candidates come from an equi-join on the prefix of the gram sets in the order of their
    hashes (an order that frequent grams don't lead) and a length bound, then the whole sets are compared. Texts under three letters have no grams and no pairs.
    All joins are shuffles by hint: gram sets and grams take little as files, by which Spark chooses broadcasts, and many times that in the driver's memory."""
    d = _not_alone(items.select("grp", "pos", "text")).select("grp", "pos", X.grams(F.col("text")).alias("g")).where(F.size("g") > 0)
    d = materialise(d)  # read four times, and costly to make
    p = d.select("grp", "pos", F.size("g").alias("n"), F.explode(_prefix("g", least)).alias("k"))
    a, b = (p.select("grp", F.col("pos").alias(i), F.col("n").alias(f"n_{i}"), "k") for i in ("i", "j"))
    bound = least / (2 - least)
    c = a.join(b.hint("merge"), ["grp", "k"]).where(f"i < j AND least(n_i, n_j) >= {bound} * greatest(n_i, n_j) - 1e-9").select("grp", "i", "j").distinct()
    gi, gj = (d.select("grp", F.col("pos").alias(i), F.col("g").alias(f"g{i}")).hint("merge") for i in ("i", "j"))
    c = c.join(gi, ["grp", "i"]).join(gj, ["grp", "j"])
    out = c.select("grp", "i", "j", X.dice(F.col("gi"), F.col("gj")).alias("score")).where(F.col("score") >= least)
    return out if below is None else out.where(F.col("score") < below)


def entity_pairs(items: DataFrame, least: float = 0.5) -> DataFrame:
    """grp, i, j, score: pairs whose named entities overlap: shared / smaller set >= least."""
    d = _not_alone(items.select("grp", "pos", "text")).select("grp", "pos", X.entities(F.col("text")).alias("e")).where(F.size("e") > 0)
    x = d.select("grp", "pos", F.size("e").alias("n"), F.explode("e").alias("k"))
    a, b = (x.select("grp", F.col("pos").alias(i), F.col("n").alias(f"n_{i}"), "k") for i in ("i", "j"))
    c = a.join(b.hint("merge"), ["grp", "k"]).where("i < j").groupBy("grp", "i", "j").agg((F.count("*") / F.min(F.least("n_i", "n_j"))).alias("score"))
    return c.where(F.col("score") >= least)


def all_pairs(items: DataFrame) -> DataFrame:
    """Borderline and entity pairs without doubles; a pair of both kinds keeps its text score."""
    u = dice_pairs(items, LOW, NEAR).withColumn("src", F.lit(0)).unionByName(entity_pairs(items).withColumn("src", F.lit(1)))
    return u.groupBy("grp", "i", "j").agg(F.min_by("score", "src").alias("score"), F.min("src").alias("src"))


def drop_resembling(items: DataFrame, others: DataFrame, least: float = NEAR) -> DataFrame:
    """Items (grp, pos, text) of a group without those that resemble one of the group's others (grp, text)."""
    return items.join(resembling(items, others, least).hint("merge"), ["grp", "pos"], "left_anti")


def resembling(items: DataFrame, others: DataFrame, least: float = NEAR) -> DataFrame:
    """grp, pos of the items with a Dice score of at least ``least`` to one of the group's others; all joins are shuffles by hint, as in dice_pairs."""
    bound = least / (2 - least)
    d = items.select("grp", "pos", X.grams(F.col("text")).alias("g")).where(F.size("g") > 0)
    o = others.select("grp", X.grams(F.col("text")).alias("h")).where(F.size("h") > 0).withColumn("o", F.md5(F.array_join(F.array_sort("h"), "\n").cast("binary"))).dropDuplicates(["grp", "o"])
    a = d.select("grp", "pos", F.size("g").alias("n"), F.explode(_prefix("g", least)).alias("k"))
    b = o.select("grp", "o", F.size("h").alias("m"), F.explode(_prefix("h", least)).alias("k"))
    c = a.join(b.hint("merge"), ["grp", "k"]).where(f"least(n, m) >= {bound} * greatest(n, m) - 1e-9").select("grp", "pos", "o").distinct()
    c = c.join(d.hint("merge"), ["grp", "pos"]).join(o.hint("merge"), ["grp", "o"])
    return c.where(X.dice(F.col("g"), F.col("h")) >= least).select("grp", "pos").distinct()


def grounded(values: DataFrame, names: DataFrame, labels: DataFrame) -> DataFrame:
    """The values (grp, pos, text) that equal one of the group's labels (grp, label) or resemble one of its names (grp, text); a group that has neither keeps all."""
    some = names.select("grp").union(labels.select("grp")).distinct()
    near = resembling(values, names).withColumn("_n", F.lit(True))
    same = labels.select("grp", F.col("label").alias("text")).distinct().withColumn("_s", F.lit(True))
    d = values.join(near, ["grp", "pos"], "left").join(same, ["grp", "text"], "left").join(some.withColumn("_some", F.lit(True)), "grp", "left")
    return d.where("_n OR _s OR _some IS NULL").select("grp", "pos", "text")


def grounded_owners(tasks: DataFrame, names: DataFrame, labels: DataFrame, team: str = "Команда") -> DataFrame:
    """Tasks (grp, pos, owner, ...) whose owner was neither heard nor is a label, given to the team; no owner stays none, and a group without speakers keeps its owners."""
    who = tasks.where("owner IS NOT NULL AND owner <> ''").select("grp", F.col("owner").alias("pos"), F.col("owner").alias("text")).distinct()
    known = grounded(who, names, labels).select("grp", F.col("text").alias("owner"), F.lit(True).alias("_k"))
    d = tasks.join(known, ["grp", "owner"], "left")
    return d.withColumn("owner", F.when(F.col("_k") | F.col("owner").isNull() | (F.col("owner") == ""), F.col("owner")).otherwise(team)).select(*tasks.columns)


def greedy_dedup(items: DataFrame, least: float = NEAR) -> DataFrame:
    """grp, pos of the items that stay: in order of pos, an item goes if it resembles an earlier one that stayed (not: any earlier one).

    Only the edges of resembling pairs matter, so the fold runs over a group's edges, sorted by the later item and streamed; an item without
    an earlier resembling one stays without being looked at."""
    edges = dice_pairs(items, least).select("grp", "j", "i").repartition("grp").sortWithinPartitions("grp", "j", "i")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grp, gone, dropped = object(), set(), []
        for b in batches:
            for g, j, i in b.itertuples(index=False):
                if g != grp:
                    grp, gone = g, set()
                if i not in gone and j not in gone:
                    gone.add(j)
                    dropped.append((g, j))
            yield pd.DataFrame(dropped, columns=["grp", "pos"])
            dropped = []

    kind = items.schema["pos"].dataType.simpleString()
    return items.select("grp", "pos").join(edges.mapInPandas(fold, f"grp string, pos {kind}").hint("merge"), ["grp", "pos"], "left_anti")


def resolve_pairs(pairs: DataFrame) -> DataFrame:
    """grp, pos of the items removed: in order of (i, j), a pair judged the same (column same) removes j unless either is already gone; a null verdict keeps both."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grp, gone, out = object(), set(), []
        for b in batches:
            for g, i, j, same in b.itertuples(index=False):
                if g != grp:
                    grp, gone = g, set()
                if same is True and i not in gone and j not in gone:
                    gone.add(j)
                    out.append((g, j))
            yield pd.DataFrame(out, columns=["grp", "pos"])
            out = []

    kind = pairs.schema["j"].dataType.simpleString()
    d = pairs.select("grp", "i", "j", "same").repartition("grp").sortWithinPartitions("grp", "i", "j")
    return d.mapInPandas(fold, f"grp string, pos {kind}")
