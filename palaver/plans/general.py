"""Queries of the general problems: intervals (p2) and orphan references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators.intervals import periods_and_gaps
from palaver.operators.references import Parent, Reference, orphan_references
from palaver.session import shuffle_partitions, table

REFERRING = ("phrases", "transcript", "protocol", "action_items", "speaker_drafts")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of speech and gaps of each speaker of a meeting."""
    return periods_and_gaps(table(spark, sf_dir, "phrases"), ["meeting_id", "speakerId"], "startTimeMs", "endTimeMs")


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per meeting and speaker: number and length of periods and gaps."""
    f = p2_found(spark, sf_dir)
    n = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    ms = lambda k: F.sum(F.when(F.col("kind") == k, F.col("to_ms") - F.col("from_ms")).otherwise(0))
    return f.groupBy("meeting_id", "speakerId").agg(n("period").alias("periods"), ms("period").alias("speech_ms"), n("gap").alias("gaps"), ms("gap").alias("silence_ms"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of every referring table, field and meeting."""
    meetings = table(spark, sf_dir, "meetings")
    parents = [
        Parent("projects", table(spark, sf_dir, "projects"), "id", deleted="deletedAt"),
        Parent("storage", table(spark, sf_dir, "storage_keys"), "objkey", deleted="deletedAt"),
        Parent("meetings", meetings, "id", deleted="deletedAt"),
    ]
    from palaver.operators.references import norm_key

    refs = [
        Reference("meetings", "projectId", meetings, "id", F.col("projectId"), "projects"),
        Reference("meetings", "baseKey", meetings, "id", F.concat(norm_key("baseKey"), F.lit("/meeting.json")), "storage"),
        *(Reference(t, "meeting_id", table(spark, sf_dir, t), "meeting_id", F.col("meeting_id"), "meetings") for t in REFERRING),
    ]
    return orphan_references(parents, refs, ranges=shuffle_partitions(spark)).withColumnRenamed("record", "meeting_id").select("src_table", "ref_field", "meeting_id", "period", "why")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, field, month and reason."""
    return p6_found(spark, sf_dir).groupBy("src_table", "ref_field", "period", "why").agg(F.count("*").alias("orphans"))


_P2 = """
WITH s AS (SELECT DISTINCT meeting_id, speakerId, startTimeMs f, endTimeMs t FROM phrases
           WHERE meeting_id IS NOT NULL AND speakerId IS NOT NULL AND endTimeMs > startTimeMs),
m AS (SELECT *, max(t) OVER (PARTITION BY meeting_id, speakerId ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) p FROM s),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR f > p THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id, speakerId ORDER BY f, t) n FROM m),
per AS (SELECT meeting_id, speakerId, min(f) from_ms, max(t) to_ms FROM g GROUP BY meeting_id, speakerId, n),
gap AS (SELECT meeting_id, speakerId, to_ms from_ms, lead(from_ms) OVER (PARTITION BY meeting_id, speakerId ORDER BY from_ms) to_ms FROM per),
found AS (SELECT meeting_id, speakerId, 'period' kind, from_ms, to_ms FROM per
          UNION ALL SELECT meeting_id, speakerId, 'gap', from_ms, to_ms FROM gap WHERE to_ms IS NOT NULL)
"""

_KEY = r"lower(regexp_replace({}, '^[\s/]+|[\s/]+$', '', 'g'))"
_REFS = "\nUNION ALL ".join(
    [
        f"SELECT 'meetings' src_table, 'projectId' ref_field, id meeting_id, 'projects' target, {_KEY.format('projectId')} k, arrivedAt FROM meetings",
        f"SELECT 'meetings', 'baseKey', id, 'storage', {_KEY.format('baseKey')} || '/meeting.json', arrivedAt FROM meetings",
        *(f"SELECT '{t}', 'meeting_id', meeting_id, 'meetings', {_KEY.format('meeting_id')}, arrivedAt FROM {t}" for t in REFERRING),
    ]
)
_P6 = f"""
WITH p AS (SELECT target, k, min(arrivedAt) a, max(CASE WHEN deletedAt IS NULL THEN 0 ELSE 1 END) gone FROM (
    SELECT 'projects' target, {_KEY.format("id")} k, arrivedAt, deletedAt FROM projects
    UNION ALL SELECT 'storage', {_KEY.format("objkey")}, arrivedAt, deletedAt FROM storage_keys
    UNION ALL SELECT 'meetings', {_KEY.format("id")}, arrivedAt, deletedAt FROM meetings) GROUP BY target, k),
r AS (SELECT src_table, ref_field, meeting_id, target, k, min(arrivedAt) a FROM ({_REFS}) WHERE k IS NOT NULL GROUP BY ALL),
j AS (SELECT r.*, CASE WHEN p.k IS NULL THEN 'missing' WHEN p.gone = 1 THEN 'deleted' WHEN p.a > r.a THEN 'late' END why
      FROM r LEFT JOIN p ON p.target = r.target AND p.k = r.k),
found AS (SELECT src_table, ref_field, meeting_id, strftime(min(a), '%Y-%m') period,
          CASE min(CASE why WHEN 'missing' THEN 0 WHEN 'deleted' THEN 1 ELSE 2 END) WHEN 0 THEN 'missing' WHEN 1 THEN 'deleted' ELSE 'late' END why
          FROM j WHERE why IS NOT NULL GROUP BY src_table, ref_field, meeting_id)
"""

QUERIES = {"p2_found": p2_found, "p2_coverage": p2_coverage, "p6_found": p6_found, "p6_report": p6_report}
SQL = {
    "p2_found": _P2 + "SELECT meeting_id, speakerId, kind, from_ms, to_ms FROM found",
    "p2_coverage": _P2
    + """SELECT meeting_id, speakerId, count(*) FILTER (kind = 'period') periods, CAST(coalesce(sum(to_ms - from_ms) FILTER (kind = 'period'), 0) AS BIGINT) speech_ms,
         count(*) FILTER (kind = 'gap') gaps, CAST(coalesce(sum(to_ms - from_ms) FILTER (kind = 'gap'), 0) AS BIGINT) silence_ms FROM found GROUP BY meeting_id, speakerId""",
    "p6_found": _P6 + "SELECT src_table, ref_field, meeting_id, period, why FROM found",
    "p6_report": _P6 + "SELECT src_table, ref_field, period, why, count(*) orphans FROM found GROUP BY ALL",
}
