"""Mixing sources to target weights by Pareto order sampling (Rosén, 1997).

Each source gets its share of the largest total that every source can fill within its repeat limit. A document's expected copies are
``min(max_repeats, c * w)``, where c is set so that the source's expected tokens meet its target and w is the document's weight: a text that stands in
the corpus m times weighs 1 / 2**floor(log2 m), so its copies together weigh about as much as one. The whole part of the expected copies is allocated with certainty. The
rest, the document's inclusion odds, is sampled in Pareto order: documents are ranked by the odds of a uniform number (a keyed hash of the id) divided by
their inclusion odds, and taken in that order until the source's remaining tokens are filled. So each source's size is fixed to within one document.

Nothing is collected but one row per source and weight class (at most 64 classes). The place where a source is full is found from sums over a
fixed grid of the rank, so even a source with a third of all rows is never sorted in one task: only the one grid cell in which it fills is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palaver.llm.tokenizer import DEFAULT_DIR, count_tokens
from palaver.session import materialise

CELLS = 65_536
#: Targets are handed to every task, so their number is checked.
MOST_TARGETS = 10_000


def solve(classes: list[tuple[float, int]], limit: int, target: float) -> float:
    """c of sum(tokens * min(limit, c * weight)) = target over (weight, tokens); the smallest c that fills everything if the target is too large."""
    full, rest = 0.0, sorted(classes, reverse=True)
    while rest:
        open_ = sum(w * t for w, t in rest)
        c = (target - full) / open_ if open_ else 0.0
        if c * rest[0][0] <= limit:
            return max(c, 0.0)
        w, t = rest.pop(0)
        full += t * limit
        if not rest:
            return limit / w
    return 0.0


def plan(stats: dict[str, list[tuple[float, int]]], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[float, dict[str, tuple[float, float]]]:
    """The mix's total tokens, and of each source that has documents its effective share (targets of such sources, scaled to 1) and c."""
    have = {s: x for s, x in targets.items() if x[0] > 0 and x[1] > 0 and sum(t for _, t in stats.get(s, []))}
    scale = sum(x[0] for x in have.values())
    room = {s: sum(t for _, t in stats[s]) * have[s][1] for s in have}
    most = min((room[s] / (have[s][0] / scale) for s in have), default=0.0)
    size = min(most, total) if total is not None else most
    return size, {s: (have[s][0] / scale, solve(stats[s], have[s][1], size * have[s][0] / scale)) for s in have}


def sized_documents(docs: DataFrame, key: str, text: str, source: str, folder: str = DEFAULT_DIR) -> DataFrame:
    """key, source, n_tokens, weight of the documents that have a source and at least one token; written once, as the encoding is the costly part."""
    d = docs.where(F.col(source).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    d = d.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.unhex(F.md5(F.encode(text, "utf-8"))).alias("h"), F.col(text).alias("text"))
    sized = materialise(count_tokens(d, "text", ["doc_id", "source", "h"], folder=folder))
    many = sized.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    weight = F.pow(F.lit(2.0), -F.floor(F.log2(F.coalesce("m", F.lit(1)))))
    return sized.join(many, "h", "left").select("doc_id", "source", "n_tokens", weight.alias("weight")).where("n_tokens > 0")


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: int | None = None, seed: int = 7, folder: str = DEFAULT_DIR) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: doc_id, source, n_tokens, copies (how often the document is taken, 1 to max_repeats). report: source, target_share,
    effective_share, actual_share, tokens, documents, copies, largest_repeat, available_tokens.

    targets: source, target_share, max_repeats; repeated rows count once (the largest share). A source without documents, share or repeats
    is reported with no tokens, and the other targets are scaled to make up for it (effective_share). A document without a source, or
    whose source is no target, and a null or empty text are never taken. Without any documents both results are empty or zero. Runs the
    encoding and one small aggregate when called."""
    spark = docs.sparkSession
    goals = targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    goal = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in goals.limit(MOST_TARGETS + 1).collect()}
    if len(goal) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    wanted = docs.join(F.broadcast(goals.select(F.col("source").alias(source))), source, "left_semi")
    sized = materialise(sized_documents(wanted, key, text, source, folder))
    stats: dict[str, list[tuple[float, int]]] = {}
    for r in sized.groupBy("source", "weight").agg(F.sum("n_tokens").alias("t")).collect():
        stats.setdefault(r["source"], []).append((r["weight"], r["t"]))
    size, by = plan(stats, goal, total)
    rows = [(s, goal[s][0], by.get(s, (0.0, 0.0))[0], by.get(s, (0.0, 0.0))[1], goal[s][1], size * by.get(s, (0.0, 0.0))[0], sum(t for _, t in stats.get(s, []))) for s in sorted(goal)]
    planned = spark.createDataFrame(rows, "source string, target_share double, effective_share double, c double, max_repeats int, target_tokens double, available_tokens long")
    lam = F.least(F.col("max_repeats").cast("double"), F.col("c") * F.col("weight"))
    d = sized.join(F.broadcast(planned.select("source", "c", "max_repeats", "target_tokens").where("c > 0")), "source")
    near = F.when(F.abs(lam - F.round(lam)) < 1e-9, F.round(lam)).otherwise(lam)
    d = d.withColumn("lam", near).withColumn("base", F.floor("lam").cast("int")).withColumn("pi", F.col("lam") - F.col("base"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(2**53))
    odds = (u / (1 - u)) / (F.col("pi") / (1 - F.col("pi")))
    d = d.withColumn("x", F.when(F.col("pi") > 0, odds / (1 + odds))).withColumn("cell", F.floor(F.col("x") * CELLS).cast("int"))
    d = d.select("doc_id", "source", "n_tokens", "base", "x", "cell", "target_tokens", F.col("max_repeats").alias("cap"))
    sure = d.groupBy("source").agg(F.sum(F.col("base") * F.col("n_tokens")).alias("sure"), F.first("target_tokens").alias("target"))
    cells = d.where("cell IS NOT NULL").groupBy("source", "cell").agg(F.sum("n_tokens").alias("t"))
    run = cells.withColumn("before", F.sum("t").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)))
    run = run.withColumn("before", F.coalesce("before", F.lit(0))).join(sure, "source").withColumn("left", F.col("target") - F.col("sure") - F.col("before"))
    edge = F.broadcast(run.where("left > 0 AND t >= left").select("source", F.col("cell").alias("edge"), F.col("left").alias("left")))  # one row per source
    d = d.join(edge, "source", "left")
    inside = d.where("cell = edge").withColumn("upto", F.sum("n_tokens").over(W.partitionBy("source").orderBy("x", "doc_id")))
    half = F.col("upto") - F.col("n_tokens") / 2.0  # the document on the border is taken if that comes closer
    inside = inside.withColumn("more", (half <= F.col("left")).cast("int"))
    outside = d.where("cell IS NULL OR edge IS NULL OR cell <> edge").withColumn("more", F.when(F.col("cell").isNull(), 0).when(F.col("edge").isNull(), 1).otherwise((F.col("cell") < F.col("edge")).cast("int")))
    nothing_left = F.broadcast(sure.where("target - sure <= 0.5").select(F.col("source")))
    outside = outside.join(nothing_left.withColumn("_none", F.lit(1)), "source", "left").withColumn("more", F.when(F.col("_none").isNotNull(), 0).otherwise(F.col("more")))
    cols = ["doc_id", "source", "n_tokens", F.least(F.col("base") + F.col("more"), F.col("cap")).cast("int").alias("copies")]
    taken = outside.select(*cols).unionByName(inside.select(*cols)).where("copies > 0")
    got = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("largest_repeat"))
    report = planned.join(F.broadcast(got), "source", "left").withColumn("all", F.sum("tokens").over(W.partitionBy(F.lit(1))))  # a row per target
    report = report.select(
        "source", "target_share", "effective_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "documents", "copies", "largest_repeat")), "available_tokens"
    )
    return taken, report
