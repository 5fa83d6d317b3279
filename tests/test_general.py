"""Intervals, orphan references and block-wise order against brute force."""

import random

from pyspark.sql import functions as F

from palaver.operators.intervals import periods_and_gaps
from palaver.operators.ordered import with_previous, with_running_sum
from palaver.operators.references import Parent, Reference, orphan_references


def brute_periods(spans):
    out = {}
    for g, a, b in spans:
        if g is not None and a is not None and b is not None and b > a:
            out.setdefault(g, []).append((a, b))
    rows = set()
    for g, s in out.items():
        merged = []
        for a, b in sorted(s):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        rows |= {(g, "period", a, b) for a, b in merged}
        rows |= {(g, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return rows


def test_periods_match_brute_force(spark):
    r = random.Random(3)
    spans = []
    for g in ["a", "b", "c", None]:
        for _ in range(300 if g == "a" else 40):
            a = r.randrange(-50, 4000)
            spans.append((g, a, a + r.choice([-3, 0, 1, 5, 20, 90])))
    spans += [("a", None, 5), ("a", 5, None), ("d", 1, 2), ("d", 2, 3), ("d", 1, 2), ("e", -10, 10_000)]
    df = spark.createDataFrame(spans, "g string, a long, b long").withColumn("_t", F.lit(1)).withColumn("kind", F.lit("x"))
    for bucket in (7, 100, 10**9):
        got = {tuple(x) for x in periods_and_gaps(df, ["g"], "a", "b", bucket).collect()}
        assert got == brute_periods(spans)


def test_periods_of_nothing(spark):
    assert periods_and_gaps(spark.createDataFrame([], "g string, a long, b long"), ["g"], "a", "b").count() == 0


def _refs(spark, parents, refs, ranges=5):
    p = spark.createDataFrame(parents, "k string, arrivedAt timestamp_ntz, deletedAt timestamp_ntz").withColumn("key", F.lit("clash"))
    r = spark.createDataFrame(refs, "rec string, k string, arrivedAt timestamp_ntz").withColumn("at", F.lit("clash"))
    out = orphan_references([Parent("t", p, "k", deleted="deletedAt")], [Reference("src", "f", r, "rec", F.col("k"), "t")], ranges)
    return {tuple(x) for x in out.collect()}


def test_references(spark):
    from datetime import datetime as D

    t1, t2, t3 = D(2024, 1, 31), D(2024, 2, 1), D(2024, 3, 1)
    parents = [("A/", t2, None), ("b", t1, None), ("b", t1, t3), ("c", t3, None), (" d ", t1, None), ("e", t3, None), ("e", t1, None), (None, t1, None)]
    refs = [("r1", " a", t2), ("r2", "a", t1), ("r3", "b", t2), ("r4", "x", t2), ("r4", "x", t3), ("r5", None, t1), ("r6", "/D/", t1), ("r7", "e", t1), ("r8", " / ", t3), ("r9", "c", t2), ("r9", "b", t2), ("r10", "c", t1), ("r10", "c", t3)]
    assert _refs(spark, parents, refs) == {
        ("src", "f", "r2", "2024-01", "late"), ("src", "f", "r3", "2024-02", "deleted"), ("src", "f", "r4", "2024-02", "missing"), ("src", "f", "r8", "2024-03", "missing"),
        ("src", "f", "r9", "2024-02", "deleted"), ("src", "f", "r10", "2024-01", "late"),
    }
    assert {x[2] for x in _refs(spark, [], refs)} == {f"r{i}" for i in range(1, 11)} - {"r5"}
    assert _refs(spark, parents, []) == set()


def test_references_random(spark):
    from datetime import datetime as D

    r = random.Random(5)
    parents = [(f"k{r.randrange(3000)}", D(2024, 1, 1), None) for _ in range(2000)]
    refs = [(f"r{i}", f"k{r.randrange(3000)}" if i % 3 else "k1", D(2024, 1, 2)) for i in range(3000)]
    have = {p[0] for p in parents}
    assert {x[2] for x in _refs(spark, parents, refs, 13)} == {x[0] for x in refs if x[1] not in have}


def test_order_over_blocks(spark):
    r = random.Random(1)
    rows = [(g, p, r.randrange(9)) for g in "ab" for p in r.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "g string, pos int, v int")
    d = with_running_sum(with_previous(df, ["g"], "pos", ["v"], block=16), ["g"], "pos", F.col("v"), "s", block=16)
    got = {(x.g, x.pos): (x.prev and x.prev.v, x.s) for x in d.collect()}
    for g in "ab":
        last, total = None, 0
        for _, p, v in sorted(x for x in rows if x[0] == g):
            total += v
            assert got[g, p] == (last, total)
            last = v


def test_hot_reference_key_is_split(spark):
    """A key with most of the references is probed in several parts, and nothing is lost."""
    from datetime import datetime as D

    parents = [(f"k{i}", D(2024, 1, 1), None) for i in range(200)] + [("hot", D(2024, 1, 1), D(2024, 2, 1))]
    refs = [(f"r{i}", "hot" if i % 3 else f"k{i % 400}", D(2024, 1, 2)) for i in range(6000)]
    got = _refs(spark, parents, refs, 16)
    assert {(x[2], x[4]) for x in got} == {(f"r{i}", "deleted") for i in range(6000) if i % 3} | {(f"r{i}", "missing") for i in range(0, 6000, 3) if i % 400 >= 200}


def test_periods_without_keys(spark):
    df = spark.createDataFrame([(1, 3), (2, 5), (9, 4), (None, 2), (7, 8)], "`a b` long, b long")
    assert {tuple(x) for x in periods_and_gaps(df, [], "`a b`", "b").collect()} == {("period", 1, 5), ("gap", 5, 7), ("period", 7, 8)}
