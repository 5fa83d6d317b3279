"""References to records that do not exist: range-partitioned sorted parents, probed by binary search.

Parents and references are cut into ranges of their keys' 64-bit hash, which are even whatever the keys look like. A task holds the sorted
keys of one range's parents as an array and probes the references of that range, batch by batch, by binary search; batches are streamed,
so only a range's distinct parents are in memory. Both sides are aggregated before the shuffle: a key that holds a third of all references is one row a referring record.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.session import materialise


def norm_key(c: Column | str) -> Column:
    """Without outer spaces and slashes, in lower case; null stays null. A key of nothing but those is the empty key, which no parent has."""
    return F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[\s/]+|[\s/]+$", ""))


@dataclass(frozen=True)
class Parent:
    target: str
    df: DataFrame
    key: str
    arrived: str = "arrivedAt"
    deleted: str | None = None


@dataclass(frozen=True)
class Reference:
    src_table: str
    ref_field: str
    df: DataFrame
    record: str
    key: Column
    target: str
    arrived: str = "arrivedAt"


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _parents(p: Parent) -> DataFrame:
    gone = F.col(p.deleted).isNotNull() if p.deleted else F.lit(False)
    return (
        p.df.select(norm_key(p.key).alias("key"), _micros(p.arrived).alias("at"), gone.alias("gone"))
        .where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("at").alias("at"), F.max("gone").alias("gone"))
        .select(F.lit(p.target).alias("target"), "key", F.lit(0).alias("side"), "at", "gone", F.lit(None).cast("string").alias("src_table"), F.lit(None).cast("string").alias("ref_field"), F.lit(None).cast("string").alias("record"))
    )


def _references(r: Reference) -> DataFrame:
    return (
        r.df.select(F.col(r.record).alias("record"), norm_key(r.key).alias("key"), _micros(r.arrived).alias("at"))
        .where("key IS NOT NULL")
        .groupBy("record", "key")
        .agg(F.min("at").alias("at"))
        .select(F.lit(r.target).alias("target"), "key", F.lit(1).alias("side"), "at", F.lit(False).alias("gone"), F.lit(r.src_table).alias("src_table"), F.lit(r.ref_field).alias("ref_field"), "record")
    )


_OUT = "src_table string, ref_field string, record string, at long, why string"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, side and key: the parents of a range, then its references."""
    rng, hashes, keys, at, gone = None, None, [], [], []
    sealed: tuple | None = None
    for b in batches:
        ranges = b.column("rng").to_numpy(zero_copy_only=False)
        sides = b.column("side").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((ranges[1:] != ranges[:-1]) | (sides[1:] != sides[:-1])) + 1
        for lo, hi in zip([0, *cut], [*cut, len(ranges)], strict=True):
            if lo == hi:
                continue
            part = b.slice(lo, hi - lo)
            if ranges[lo] != rng:
                rng, keys, at, gone, hashes, sealed = ranges[lo], [], [], [], [], None
            if sides[lo] == 0:
                hashes.append(part.column("h").to_numpy(zero_copy_only=False))
                keys.append(part.column("full"))
                at.append(part.column("at").to_numpy(zero_copy_only=False).astype("float64"))
                gone.append(part.column("gone").to_numpy(zero_copy_only=False).astype(bool))
                continue
            if sealed is None:
                if keys:
                    sealed = (np.concatenate(hashes), pa.concat_arrays(keys), np.concatenate(at), np.concatenate(gone))
                else:
                    sealed = (np.empty(0, "int64"), pa.array([], pa.string()), np.empty(0), np.empty(0, bool))
            yield from _search(part, *sealed)


def _search(part: pa.RecordBatch, hashes: np.ndarray, keys: pa.Array, at: np.ndarray, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    h = part.column("h").to_numpy(zero_copy_only=False)
    lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
    place = np.where(hi > lo, lo, -1)
    full = part.column("full")
    if len(keys):
        found = np.flatnonzero(place >= 0)
        same = pa.compute.equal(full.take(pa.array(found)), keys.take(pa.array(place[found]))).to_numpy(zero_copy_only=False)
        for i in found[~same]:  # two keys of one 64-bit hash: look through the run
            place[i] = next((j for j in range(lo[i], hi[i]) if keys[j].as_py() == full[int(i)].as_py()), -1)
    mine = part.column("at").to_numpy(zero_copy_only=False).astype("float64")
    ok = place >= 0
    theirs, dead = np.full(len(h), np.nan), np.zeros(len(h), bool)
    if len(keys):
        theirs[ok], dead[ok] = at[place[ok]], gone[place[ok]]
    why = np.where(~ok, "missing", np.where(dead, "deleted", np.where(theirs > mine, "late", "")))
    bad = np.flatnonzero(why != "")
    if len(bad):
        t = part.take(pa.array(bad))
        yield pa.RecordBatch.from_arrays([t.column("src_table"), t.column("ref_field"), t.column("record"), t.column("at"), pa.array(why[bad].astype(object), pa.string())], names=["src_table", "ref_field", "record", "at", "why"])


def orphan_references(parents: list[Parent], references: list[Reference], ranges: int) -> DataFrame:
    """One row per referring table, field and record whose reference is no good: src_table, ref_field, record, period (yyyy-MM), why.

    why is `missing` (no such parent), else `deleted` (a row of the parent is marked deleted), else `late` (the parent's earliest arrival is
    after the reference's earliest). period is the month of the earliest arrival of the referring rows. A null key refers to nothing; an
    empty one (nothing but spaces and slashes) to no parent. A record whose rows name several keys is listed once, with the worst of them
    in the order above. A null arrival is never late, and gives a null period. Without parents every reference is missing; without
    references the result is empty. ``ranges``: number of key ranges; a range's parents should fit a task's memory. A range with more than twice its share of the
    references (a hot key) is split by record."""
    both = None
    for part in [*map(_parents, parents), *map(_references, references)]:
        both = part if both is None else both.unionByName(part)
    full = F.concat_ws("\u0001", "target", "key")
    rows = both.withColumn("full", full).withColumn("h", F.xxhash64("full"))
    top = F.shiftright("h", 40) + F.lit(2**23)  # the hash's upper 24 bits, as an unsigned number
    rows = rows.withColumn("rng", F.floor(top * F.lit(ranges) / F.lit(2**24)).cast("int"))
    rows = materialise(rows.select("rng", "side", "h", "full", "at", "gone", "src_table", "ref_field", "record"))
    # a range with a hot key has more references than its share: it is split by record, and its parents go to every part
    sizes = rows.where("side = 1").groupBy("rng").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(W.partitionBy(F.lit(0)))
    parts = sizes.select("rng", F.ceil(F.col("n") * ranges / (2 * whole)).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(parts), "rng", "left")  # at most ``ranges`` rows
    own = F.pmod(F.xxhash64("record"), F.coalesce("parts", F.lit(1))).cast("int")
    rows = rows.withColumn("_part", F.explode(F.when(F.col("side") == 1, F.array(own)).otherwise(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))))
    rows = rows.withColumn("rng", F.col("rng").cast("long") * 2**20 + F.col("_part")).drop("_part", "parts")
    found = rows.repartition(ranges, "rng").sortWithinPartitions("rng", "side", "h").mapInArrow(_probe, _OUT)
    rank = F.when(F.col("why") == "missing", 0).when(F.col("why") == "deleted", 1).otherwise(2)
    return (
        found.groupBy("src_table", "ref_field", "record")
        .agg(F.min_by("why", rank).alias("why"), F.min("at").alias("at"))
        .select("src_table", "ref_field", "record", F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("period"), "why")
    )
