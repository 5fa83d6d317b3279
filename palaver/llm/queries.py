"""Queries of the language-model problems, and SQL for those that SQL can express."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import linking, mixing, pii, quality, quantiles, tokenizer
from palaver.llm import turns as speech
from palaver.session import materialise, table

PERMILLE = [10, 250, 500, 750, 900, 950, 990]
#: The key of the pseudonyms. Without one of the deployment's own, a random key of this process: nobody can turn its pseudonyms back or link them to another run's.
PSEUDONYM_KEY = os.environ.get("PALAVER_PSEUDONYM_KEY", "").encode() or secrets.token_bytes(32)
METRICS = ["latencyMs", "costRub", "werAfter"]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run once: repeated rows of a natural key hold the same values."""
    r = table(spark, sf_dir, "results")
    day = F.date_format("startedAt", "yyyy-MM-dd")
    return r.groupBy("model", "caseId", "run").agg(*(F.min(m).alias(m) for m in METRICS), F.min(day).alias("day"))


def p1_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per model and day of startedAt, and (day = `all`) per model from the days' sketches put together."""
    k = ["model", "day"]
    days = materialise(quantiles.merged(quantiles.sketches(_runs(spark, sf_dir), k, METRICS), k))
    whole = quantiles.merged(days.withColumn("task", F.abs(F.hash("day")) % 4096), ["model"]).withColumn("day", F.lit("all"))
    return quantiles.percentiles(days.select(*k, "metric", *quantiles.NAMES).unionByName(whole.select(*k, "metric", *quantiles.NAMES)), k, PERMILLE)


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of every measure per model over all runs."""
    return quantiles.percentiles(quantiles.merged(quantiles.sketches(_runs(spark, sf_dir), ["model"], METRICS), ["model"]), ["model"], PERMILLE)


def p1_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per model and day of startedAt."""
    k = ["model", "day"]
    return quantiles.percentiles(quantiles.merged(quantiles.sketches(_runs(spark, sf_dir), k, METRICS), k), k, PERMILLE)


def p1_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per model from the sketches of the days, each merged apart first."""
    days = quantiles.merged(quantiles.sketches(_runs(spark, sf_dir), ["model", "day"], METRICS), ["model", "day"])
    days = days.withColumn("task", F.abs(F.hash("day")) % 4096)
    return quantiles.percentiles(quantiles.merged(days, ["model"]), ["model"], PERMILLE)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three text fields under one schema: src, meeting_id, pos, text."""
    ph = table(spark, sf_dir, "phrases").select(F.lit("phrases").alias("src"), "meeting_id", F.col("pos").cast("int").alias("pos"), "text")
    tr = table(spark, sf_dir, "transcript").select(F.lit("transcript").alias("src"), "meeting_id", F.lit(0).alias("pos"), F.col("rawText").alias("text"))
    pr = table(spark, sf_dir, "protocol").select(F.lit("protocol").alias("src"), "meeting_id", F.lit(0).alias("pos"), F.col("summary.overview").alias("text"))
    return ph.unionByName(tr).unionByName(pr).where("text IS NOT NULL AND text <> ''")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of personal information in each field."""
    return pii.items(_texts(spark, sf_dir), ["src", "meeting_id", "pos"], "text").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its items replaced; repeated rows once."""
    return pii.redacted(_texts(spark, sf_dir), ["src", "meeting_id", "pos"], "text", PSEUDONYM_KEY).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speaker turns of every meeting."""
    return speech.turns(speech.prepared(table(spark, sf_dir, "phrases"))).select("meeting_id", "first_pos", "last_pos")


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns with speaker and clean text."""
    return speech.turns(speech.prepared(table(spark, sf_dir, "phrases"), with_text=True))


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp (meeting) and spelling of the three name fields."""
    pr = table(spark, sf_dir, "protocol").select(F.col("meeting_id").alias("grp"), F.explode("participants").alias("spelling"))
    ai = table(spark, sf_dir, "action_items").select(F.col("meeting_id").alias("grp"), F.col("owner").alias("spelling"))
    sd = table(spark, sf_dir, "speaker_drafts").select(F.col("meeting_id").alias("grp"), F.col("guessedName").alias("spelling"))
    return pr.unionByName(ai).unionByName(sd).select("grp", linking.clean_spelling("spelling").alias("spelling"))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of a meeting and what it means."""
    return linking.entities(_spellings(spark, sf_dir)).withColumnRenamed("grp", "meeting_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings that mean the same person or organisation."""
    ents = materialise(linking.entities(_spellings(spark, sf_dir)))
    return linking.pairs(ents).withColumnRenamed("grp", "meeting_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is taken."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of every source."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are no natural prose."""
    docs = quality.classify(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "common_words"))
    return docs.where("p_prose < 0.5").select("doc_id")


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basic statistics of every document."""
    docs = quality.document_statistics(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "common_words"))
    return docs.select("doc_id", F.col("n_words").cast("long").alias("n_words"), *(F.round(c, 6).alias(c) for c in quality.STATS[1:]))


def _p1_sql(*groups: str) -> str:
    long = " UNION ALL ".join(f"SELECT {g}, '{m}' metric, CAST({m} AS DOUBLE) v FROM r" for m in METRICS for g in groups)
    ps = ", ".join(f"min(v) FILTER (i >= (n * {p} + 999) // 1000) p{p}" for p in PERMILLE)
    keys = "model, day" if "day" in groups[0] else "model"
    return f"""WITH r AS (SELECT model, caseId, run, min(latencyMs) latencyMs, min(costRub) costRub, min(werAfter) werAfter, min(strftime(startedAt, '%Y-%m-%d')) AS day FROM results GROUP BY ALL),
l AS ({long}), o AS (SELECT *, row_number() OVER (PARTITION BY {keys}, metric ORDER BY v) i, count(*) OVER (PARTITION BY {keys}, metric) n FROM l WHERE v IS NOT NULL AND NOT isnan(v))
SELECT {keys}, metric, n, {ps}, CAST(0 AS DOUBLE) rank_error FROM o GROUP BY {keys}, metric, n"""


#: White space as Python's str.split has it, and line ends as str.splitlines has them.
_WS, _EOL = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]", r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_P9 = rf"""WITH c AS (SELECT list(DISTINCT lower(word)) ws FROM common_words),
d AS (SELECT doc_id, CASE WHEN regexp_replace(text, '{_WS}+', '', 'g') <> '' THEN text END AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') ws, length(regexp_replace(text, '{_WS}+', '', 'g')) solid,
      list_filter(list_transform(regexp_split_to_array(text, '{_EOL}'), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') ls FROM d),
n AS (SELECT doc_id, text, len(ws) n, list_sum(list_transform(ws, lambda x: length(x))) chars, solid, ls, len(list_filter(ws, lambda x: list_contains(cw, x))) usual FROM w, (SELECT ws cw FROM c))
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) n_words, CASE WHEN text IS NOT NULL THEN round(coalesce(chars, 0) / greatest(n, 1), 6) END mean_word_len,
CASE WHEN text IS NOT NULL THEN round(greatest(0, solid - coalesce(chars, 0)) / greatest(solid, 1), 6) END symbol_ratio,
CASE WHEN text IS NOT NULL THEN round(len(list_filter(ls, lambda x: x[-1] IN ('.', '!', '?', '…', '»', '"', ')'))) / greatest(len(ls), 1), 6) END end_punct_share,
CASE WHEN text IS NOT NULL THEN round(usual / greatest(n, 1), 6) END common_share FROM n"""

QUERIES = {"p1_rollup": p1_rollup, "p1_percentiles": p1_percentiles, "p1_daily": p1_daily, "p1_from_days": p1_from_days, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_turns": p4_turns, "p5_found": p5_found, "p5_entities": p5_entities, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_report": p8_report, "p9_found": p9_found, "p9_stats": p9_stats}
#: p1: at the scale where the SQL runs no buffer collapses, so the sketch must be exact.
SQL = {"p1_rollup": _p1_sql("model, day", "model, 'all' AS day"), "p1_percentiles": _p1_sql("model"), "p1_daily": _p1_sql("model, day"), "p1_from_days": _p1_sql("model"), "p9_stats": _P9}
