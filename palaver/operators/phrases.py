"""Operators on ordered phrases: cleaning, sessions, runs, ranks, timing, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.functions import text as X
from palaver.operators.ordered import with_previous, with_running_sum

FIELDS = ["speakerId", "speakerLabel", "speakerTag", "detectedName", "startTimeMs", "endTimeMs", "text"]


def distinct_phrases(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per (meeting_id, pos): repeated rows hold the same values, of which the smallest is taken."""
    return df.groupBy("meeting_id", "pos").agg(*(F.min(c).alias(c) for c in [*FIELDS, *(extra or [])]))


def cleaned(p: DataFrame, keep_noise: bool = True, min_words: int = 1, intended: bool = False) -> DataFrame:
    """Adds clean; drops phrases that come out empty, short, or (unless kept) as noise."""
    d = p.withColumn("clean", X.correct(F.col("text"), intended)).where("clean <> ''").where(X.word_count(F.col("clean")) >= min_words)
    return d if keep_noise else d.where(~X.is_noise(F.col("clean")))


def transcript_gate(p: DataFrame, transcript: DataFrame, least: int = 20) -> DataFrame:
    """meeting_id, phrases, words, poor: whether a meeting has no phrases or too few words in its whole text."""
    n = p.groupBy("meeting_id").agg(F.count("*").alias("phrases"))
    t = transcript.groupBy("meeting_id").agg(F.max(X.word_count(F.col("rawText"))).alias("words"))
    d = t.join(n, "meeting_id", "full").select("meeting_id", F.coalesce("phrases", F.lit(0)).alias("phrases"), F.coalesce("words", F.lit(0)).alias("words"))
    return d.withColumn("poor", (F.col("phrases") == 0) | (F.col("words") < least))


def speaker_stats(p: DataFrame) -> DataFrame:
    """Per meeting and speaker: utterances, words, speaking time (negative spans and missing times count 0)."""
    ms = F.greatest(F.lit(0), F.coalesce("endTimeMs", F.lit(0)) - F.coalesce("startTimeMs", F.lit(0)))
    return p.groupBy("meeting_id", "speakerId").agg(F.count("*").alias("utterances"), F.sum(X.word_count(F.col("text"))).alias("words"), F.sum(ms).alias("duration_ms"))


def _grouped(d: DataFrame, run: str) -> DataFrame:
    piece = F.struct("pos", F.col("text").alias("x"))
    return d.groupBy("meeting_id", run).agg(
        F.min("pos").alias("first_pos"),
        F.min_by("speakerTag", "pos").alias("tag"),
        F.min_by("speakerId", "pos").alias("speaker"),
        F.min_by("startTimeMs", "pos").alias("start_ms"),
        F.max_by("endTimeMs", "pos").alias("end_ms"),
        F.count("*").alias("n"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda s: s["x"]), " ")).alias("text"),
    )


def sessions(p: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """Groups of successive phrases of one tag whose pauses are known and shorter than gap_ms; blank phrases take no part. The end is that of the last phrase."""
    d = with_previous(p.where("trim(text) <> ''"), ["meeting_id"], "pos", ["speakerTag", "endTimeMs"])
    same = F.col("prev").isNotNull() & F.col("prev.speakerTag").eqNullSafe(F.col("speakerTag")) & F.coalesce(F.col("startTimeMs") - F.col("prev.endTimeMs") < gap_ms, F.lit(False))
    return _grouped(with_running_sum(d, ["meeting_id"], "pos", F.when(same, 0).otherwise(1), "run"), "run").drop("run", "speaker")


def tag_runs(p: DataFrame, step_ms: int = 1000) -> DataFrame:
    """Runs of one tag, with synthetic times (the run's index times step_ms)."""
    d = with_previous(p.where("trim(text) <> ''"), ["meeting_id"], "pos", ["speakerTag"])
    d = with_running_sum(d, ["meeting_id"], "pos", F.when(F.col("prev").isNotNull() & F.col("prev.speakerTag").eqNullSafe(F.col("speakerTag")), 0).otherwise(1), "run")
    return _grouped(d, "run").select("meeting_id", "first_pos", "tag", ((F.col("run") - 1) * step_ms).alias("start_ms"), (F.col("run") * step_ms).alias("end_ms"), "n", "text")


def merged_runs(p: DataFrame) -> DataFrame:
    """Runs of successive phrases of one speaker: the first one's fields, the last one's end, the texts joined."""
    d = with_previous(p.where("text IS NOT NULL"), ["meeting_id"], "pos", ["speakerId"])
    d = with_running_sum(d, ["meeting_id"], "pos", F.when(F.col("prev").isNotNull() & F.col("prev.speakerId").eqNullSafe(F.col("speakerId")), 0).otherwise(1), "run")
    return _grouped(d, "run").drop("run", "tag")


def ranked_speakers(p: DataFrame) -> DataFrame:
    """Speakers by words (ties: who spoke first), with new ids and labels by rank."""
    s = p.where("speakerId IS NOT NULL").groupBy("meeting_id", "speakerId").agg(F.sum(X.word_count(F.col("text"))).alias("words"), F.min("pos").alias("first_pos"))
    k = F.row_number().over(W.partitionBy("meeting_id").orderBy(F.desc("words"), "first_pos"))  # a row per speaker
    return s.withColumn("rank", k).select("meeting_id", F.col("speakerId").alias("original_id"), F.concat(F.lit("speaker-"), F.col("rank")).alias("speaker_id"), F.concat(F.lit("Спикер "), F.col("rank")).alias("speaker_label"), "words", "rank")


def dense_labels(p: DataFrame) -> DataFrame:
    """Speakers numbered by the order of their ids as strings."""
    s = p.where("speakerId IS NOT NULL").select("meeting_id", "speakerId").distinct()
    return s.withColumn("number", F.dense_rank().over(W.partitionBy("meeting_id").orderBy("speakerId")))


def proportional_timing(p: DataFrame, total_ms: int) -> DataFrame:
    """Times by length of text: each phrase gets its share of total_ms, one after another."""
    d = p.withColumn("len", F.coalesce(F.length("text"), F.lit(0)))
    whole = d.groupBy("meeting_id").agg(F.sum("len").alias("whole"))
    d = d.join(whole, "meeting_id").withColumn("dur", F.when(F.col("whole") > 0, F.floor(F.lit(total_ms) * F.col("len") / F.col("whole") + 0.5)).otherwise(0).cast("long"))
    d = with_running_sum(d.select("meeting_id", "pos", "dur"), ["meeting_id"], "pos", F.col("dur"), "start_ms", exclusive=True)
    return d.select("meeting_id", "pos", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"))


def first_samples(p: DataFrame) -> DataFrame:
    """Each speaker's first phrase."""
    s = p.where("speakerId IS NOT NULL").groupBy("meeting_id", "speakerId").agg(F.min_by(F.struct("pos", "text", "startTimeMs"), "pos").alias("r"))
    return s.select("meeting_id", "speakerId", F.col("r.pos").alias("pos"), F.col("r.text").alias("text"), F.col("r.startTimeMs").alias("start_ms"))


def dialogue_roles(p: DataFrame) -> DataFrame:
    """Who opened the talk, who spoke most (ties: all of them), and the rest."""
    s = p.where("speakerId IS NOT NULL").groupBy("meeting_id", "speakerId").agg(F.sum(X.word_count(F.col("text"))).alias("words"), F.min("pos").alias("first_pos"))
    all_ = W.partitionBy("meeting_id")  # a row per speaker
    role = F.when(F.col("first_pos") == F.min("first_pos").over(all_), "начал разговор").when(F.col("words") == F.max("words").over(all_), "основной спикер").otherwise("участник")
    return s.withColumn("role", role)


def palette(p: DataFrame, size: int = 8) -> DataFrame:
    """Colour slots by first appearance, and the slot a label gets that never appeared."""
    s = p.where("speakerLabel IS NOT NULL").groupBy("meeting_id", "speakerLabel").agg(F.min("pos").alias("first_pos"))
    at = F.row_number().over(W.partitionBy("meeting_id").orderBy("first_pos", "speakerLabel")) - 1
    return s.select("meeting_id", "speakerLabel", X.palette_slot(at, size).alias("slot"), X.name_slot(F.col("speakerLabel"), size).alias("fallback_slot"))


def raw_text(p: DataFrame) -> DataFrame:
    """Each meeting's text: `label: text` lines in order. The whole text of a meeting is one value, so it must fit a row."""
    line = F.concat(F.coalesce("speakerLabel", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    got = p.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return got.select("meeting_id", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("raw_text"))


def in_order(df: DataFrame, group: str, value: str, pos: str) -> DataFrame:
    """Distinct values per group in the order of their first appearance."""
    d = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(pos).alias("p"))
    return d.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("p", value)).cast("long")).select(group, value, "place")


def packed_chunks(p: DataFrame, budget: int = 8000, tail: int = 2) -> DataFrame:
    """meeting_id, chunk, first_id, last_id, chars, context_ids: greedy packing of `[id] label: text` lines into chunks of at most budget characters (a longer line is a chunk of its own),
    each with the ids of the last ``tail`` lines before it.

    Packing is a fold over a meeting's line lengths. It streams over the rows, sorted by meeting and position, with a meeting's running state
    in memory and nothing else; a meeting is one task's work, as every chunk depends on all before it."""
    d = with_running_sum(p, ["meeting_id"], "pos", F.lit(1), "id")
    size = F.length(F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.coalesce("speakerLabel", F.lit("null")), F.lit(": "), F.coalesce("text", F.lit(""))))
    d = d.select("meeting_id", "id", size.alias("size")).repartition("meeting_id").sortWithinPartitions("meeting_id", "id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        for b in batches:
            for m, i, s in b.itertuples(index=False):
                if now is None or now[0] != m:
                    if now is not None:
                        out.append(tuple(now))
                    now = [m, 1, i, i, s, []]
                elif now[4] + s > budget:
                    out.append(tuple(now))
                    now = [m, now[1] + 1, i, i, s, list(range(max(now[2], i - tail), i))]
                else:
                    now[3], now[4] = i, now[4] + s
            yield pd.DataFrame(out, columns=cols)
            out = []
        if now is not None:
            yield pd.DataFrame([tuple(now)], columns=cols)

    cols = ["meeting_id", "chunk", "first_id", "last_id", "chars", "context_ids"]
    return d.mapInPandas(fold, "meeting_id string, chunk long, first_id long, last_id long, chars long, context_ids array<long>")


def text_pieces(df: DataFrame, keys: list[str], text: str, budget: int = 18_000) -> DataFrame:
    """keys, piece, text: texts cut between lines into pieces; a line that would take a piece beyond ``budget`` characters (each newline counts one) opens the next. A longer line is a
    piece of its own, an empty text one empty piece; null has none. A text is one row, so its lines are one task's work; its pieces are emitted one by one."""
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1) for whole in batches for i in range(whole.num_rows)):
            t = b.column(len(keys))[0].as_py()
            if t is None:
                continue
            lines = t.split("\n")
            ends = np.cumsum([len(x) + 1 for x in lines])  # where each line ends, its newline included
            first, pieces = 0, []
            while first < len(lines):
                before = int(ends[first - 1]) if first else 0
                after = max(first + 1, int(np.searchsorted(ends, before + budget + 1, "right")))
                pieces.append("\n".join(lines[first:after]))
                first = after
            rows = b.take(pa.array([0] * len(pieces)))
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keys))), pa.array(range(1, len(pieces) + 1), pa.int32()), pa.array(pieces, pa.string())], names=[*keys, "piece", "text"])

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(cut, f"{ddl}, piece int, text string")


def addressed_names(p: DataFrame) -> DataFrame:
    """Names that whole phrases call, per meeting in order of first appearance."""
    return in_order(p.withColumn("name", X.addressed_name(F.col("text"))), "meeting_id", "name", "pos")
