"""Who spoke: diarization segments, overlap attribution, id chains and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import text as X
from palaver.functions.numbers import numbers_preserved


def parse_rttm(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """speaker, start, stop of the SPEAKER lines of RTTM text; other lines, and lines whose numbers don't parse, are left out."""
    f = F.split(F.trim(F.col(line)), r"\s+")
    num = lambda i: F.try_element_at(f, F.lit(i)).try_cast("double")
    d = lines.where(F.try_element_at(f, F.lit(1)) == "SPEAKER").select(*(keep or []), F.try_element_at(f, F.lit(8)).alias("speaker"), num(4).alias("start"), (num(4) + num(5)).alias("stop"))
    return d.where("speaker IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL")


def rttm_line(uri: Column, speaker: Column, start: Column, stop: Column) -> Column:
    """A segment as an RTTM line with three decimals."""
    return F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", uri, start, stop - start, speaker)


def overlap_attribution(phrases: DataFrame, segments: DataFrame, bin_ms: int = 30_000, fallback: str | None = None) -> DataFrame:
    """meeting_id, pos, speaker, overlap_ms: the speaker whose segments overlap a phrase most (ties: whose first overlapping segment comes first).

    phrases: meeting_id, pos, start_ms, end_ms. segments: meeting_id, seg, speaker, start_ms, end_ms. Only true overlap counts; a phrase without any
    gets ``fallback``. Both sides are cut at a grid of bin_ms and joined on meeting and bin, so that a long meeting is spread over its
    bins; overlaps are clipped to the bin and add up."""
    cut = lambda d: d.where("end_ms > start_ms").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_ms") / bin_ms), F.floor((F.col("end_ms") - 1) / bin_ms))))
    s = cut(segments).select("meeting_id", "bin", "seg", "speaker", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"))
    j = cut(phrases).join(s, ["meeting_id", "bin"])
    lo, hi = F.greatest("start_ms", "s0", F.col("bin") * bin_ms), F.least("end_ms", "s1", (F.col("bin") + 1) * bin_ms)
    j = j.select("meeting_id", "pos", "speaker", "seg", (hi - lo).alias("o")).where("o > 0")
    per = j.groupBy("meeting_id", "pos", "speaker").agg(F.sum("o").alias("o"), F.min("seg").alias("first"))
    best = per.groupBy("meeting_id", "pos").agg(F.max_by(F.struct("speaker", "o"), F.struct("o", (-F.col("first")).alias("f"))).alias("b"))
    d = phrases.select("meeting_id", "pos").join(best, ["meeting_id", "pos"], "left")
    return d.select("meeting_id", "pos", F.coalesce("b.speaker", F.lit(fallback)).alias("speaker"), F.coalesce("b.o", F.lit(0)).alias("overlap_ms"))


def apply_refined(phrases: DataFrame, refined: DataFrame, preserved: Column) -> DataFrame:
    """Phrases with the refined line of their number, where the check holds; status: applied, rejected or unchanged.

    phrases: id, text; refined: id, refined. ``preserved`` is a condition over text and refined."""
    j = phrases.join(refined, "id", "left")
    status = F.when(F.col("refined").isNull() | F.col("refined").eqNullSafe(F.col("text")), "unchanged").when(preserved, "applied").otherwise("rejected")
    return j.withColumn("status", status).withColumn("result", F.when(F.col("status") == "applied", F.col("refined")).otherwise(F.col("text")))


def answered(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, body: the answered lines of each answer, blank ones left out, of lines with one number the last one. lines: keys, place, line."""
    l = lines.select(*keys, "place", X.line_id(F.col("line")).alias("id"), X.line_body(F.col("line")).alias("body")).where("id IS NOT NULL AND body <> ''")
    return l.groupBy(*keys, "id").agg(F.max_by("body", "place").alias("body"))


def correction_report(asked: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, asked, missing, applied, rejected, unchanged, changed_ppm (applied of those asked, in whole millionths; 0 if none was asked): what came of each answer.

    asked: keys, id, text; answers: keys, id, refined (as of answered()). A line whose numbers changed is rejected."""
    on = [asked[c].eqNullSafe(answers[c]) for c in (*keys, "id")]
    j = asked.join(answers, on, "left").select(*(asked[c] for c in keys), asked.id, "text", "refined")
    status = F.when(F.col("refined").isNull(), "missing").when(~numbers_preserved(F.col("text"), F.col("refined")), "rejected").when(F.col("refined") == F.col("text"), "unchanged").otherwise("applied")
    n = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    g = j.withColumn("status", status).groupBy(*keys).agg(F.count("*").alias("asked"), *map(n, ("missing", "applied", "rejected", "unchanged")))
    return g.withColumn("changed_ppm", F.coalesce(F.try_divide(F.col("applied") * 1_000_000, F.col("asked")), F.lit(0)).cast("long"))


def named_segments(phrases: DataFrame, drafts: DataFrame) -> DataFrame:
    """Phrases with the name guessed for their speaker, else the name detected in the phrase."""
    d = drafts.groupBy("meeting_id", F.col("id").alias("speakerId")).agg(F.min("guessedName").alias("draft"))
    return phrases.join(d, ["meeting_id", "speakerId"], "left").select("meeting_id", "pos", "speakerId", F.coalesce("draft", "detectedName").alias("name"))


def confirmed_drafts(confirmed: DataFrame, stored: DataFrame) -> DataFrame:
    """Confirmed drafts beside what was proposed: the stored proposal where that field is present (even if null), else the stored guess.

    confirmed: meeting_id, id, confirmed. stored: meeting_id, id, guessedName, confidence, proposedName, proposedConfidence, has_proposal."""
    s = stored.select(
        "meeting_id", "id", F.when(F.col("has_proposal"), F.col("proposedName")).otherwise(F.col("guessedName")).alias("proposed"), F.when(F.col("has_proposal"), F.col("proposedConfidence")).otherwise(F.col("confidence")).alias("proposed_confidence")
    )
    return confirmed.join(s, ["meeting_id", "id"], "left")


def voice_map(labels: DataFrame, relabels: DataFrame, embeddings: DataFrame) -> DataFrame:
    """final_id, embedding: label -> original id (of labels, the last by pos wins) -> final id -> vector.

    labels: label, original_id, pos. relabels: original_id, final_id. embeddings: label, embedding."""
    last = labels.groupBy("original_id").agg(F.max_by("label", "pos").alias("label"))
    return last.join(relabels, "original_id").join(embeddings, "label").select("final_id", "embedding")


def looked_up(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], value: str, group: str = "meeting_id") -> DataFrame:
    """Left rows with ``value`` of the first of several keys that matches, in order: found. Of several right rows with a key the smallest value is taken."""
    out = left
    for i, (a, b) in enumerate(on):
        r = right.where(F.col(b).isNotNull()).groupBy(F.col(group), F.col(b).alias(a)).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(r, [group, a], "left")
    return out.withColumn("found", F.coalesce(*(f"_v{i}" for i in range(len(on))))).drop(*(f"_v{i}" for i in range(len(on))))


def roster_expansion(names: DataFrame, roster: DataFrame) -> DataFrame:
    """grp, name, full_name, n: the one roster name of that first name (a full roster name stands for itself), and how many the name may mean.

    names, roster: grp, name. Compared in lower case with ё as е."""
    key = lambda c: F.translate(F.lower(F.trim(F.col(c))), "ё", "е")
    r = roster.select("grp", F.col("name").alias("full"), key("name").alias("k")).distinct()
    full = r.groupBy("grp", "k").agg(F.min("full").alias("exact"))
    first = r.select("grp", F.substring_index("k", " ", 1).alias("k"), "full").groupBy("grp", "k").agg(F.count("*").alias("c"), F.min("full").alias("only"))
    n = names.select("grp", "name", key("name").alias("k")).distinct().join(full, ["grp", "k"], "left").join(first, ["grp", "k"], "left")
    count = F.when(F.col("exact").isNotNull(), 1).otherwise(F.coalesce("c", F.lit(0)))
    return n.select("grp", "name", F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("c") == 1, F.col("only")).otherwise(F.col("name")).alias("full_name"), count.cast("long").alias("n"))
