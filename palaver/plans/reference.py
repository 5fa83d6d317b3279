"""Queries over the transcript operators, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.functions import numbers, text as X
from palaver.operators import attribution, audio, audit, clustering, minutes, phrases, scoring, similarity
from palaver.session import materialise, table
from palaver.sources import formats

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: SQL pieces. SP: white space; PH: phrases once each.
SP = r"[ \t\n\x{0b}\f\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
PH = "ph AS (SELECT meeting_id, pos, min(speakerId) speakerId, min(speakerLabel) speakerLabel, min(speakerTag) speakerTag, min(detectedName) detectedName, min(startTimeMs) startTimeMs, min(endTimeMs) endTimeMs, min(text) AS text FROM phrases GROUP BY meeting_id, pos)"
JUNK = r"""(({0}) IS NULL OR lower(trim({0})) = '' OR regexp_matches(lower(trim({0})), '^(null|нет(\s.*)?|не\s+(было|указано|определено|найдено|заданы?).*|отсутствует.*)$'))"""
GRAMS = r"list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3)))"
NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
DICE = "(CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END)"
TASKS = "t AS (SELECT meeting_id, pos, min(owner) AS owner, min(task) task, min(deadline) deadline FROM action_items GROUP BY meeting_id, pos)"


def WORDS(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '{SP}+'), lambda w: w <> ''))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ph(spark: SparkSession, d: str) -> DataFrame:
    return phrases.distinct_phrases(table(spark, d, "phrases"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "action_items").groupBy("meeting_id", "pos").agg(*(F.min(c).alias(c) for c in ("owner", "task", "deadline")))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Tasks as (grp, pos, text); only tasks of one owner of a meeting are compared, owners in lower case with ё as е, no owner being one too."""
    t = _tasks(spark, d)
    again = F.concat(F.col("task"), F.lit(" на объекте "), F.coalesce("deadline", F.lit("Север-2 до 2024")))  # every task once more in other words, so that there is something to find
    t = t.unionByName(t.select("meeting_id", (F.col("pos") + 100_000).alias("pos"), "owner", again.alias("task"), "deadline"))
    key = F.to_json(F.array("meeting_id", F.coalesce(X.name_key(F.col("owner")), F.lit("\u0000"))))
    return t.select(key.alias("grp"), "pos", F.col("task").alias("text"), "meeting_id")


_BY_OWNER = f"WITH {TASKS}, t2 AS (SELECT * FROM t UNION ALL SELECT meeting_id, pos + 100000, owner, task || ' на объекте ' || coalesce(deadline, 'Север-2 до 2024'), deadline FROM t), k AS (SELECT *, replace(lower(owner), 'ё', 'е') ok FROM t2), "
_PAIRED = _BY_OWNER + (
    f"n AS (SELECT meeting_id, pos, ok, {NORM.format('task')} s FROM k), g AS (SELECT meeting_id, pos, ok, CASE WHEN length(s) >= 3 THEN {GRAMS.format('s')} ELSE [] END g FROM n), "
    f"d AS (SELECT a.meeting_id, a.pos i, b.pos j, {DICE.format('a.g', 'b.g')} score FROM g a JOIN g b ON a.meeting_id = b.meeting_id AND a.ok IS NOT DISTINCT FROM b.ok AND a.pos < b.pos), "
)
_ENT = (
    r"w AS (SELECT meeting_id, pos, ok, list_transform(list_filter(regexp_split_to_array(coalesce(task, ''), '" + SP + r"+'), lambda x: x <> '')[2:], lambda x: regexp_replace(x, '[^\p{L}\p{N}-]', '', 'g')) w FROM k), "
    "e AS (SELECT meeting_id, pos, ok, list_distinct(list_transform(list_filter(w, lambda x: regexp_matches(x, '^[А-ЯЁ][а-яё]+(-[А-ЯЁ]?[а-яё]+)?$') OR regexp_matches(x, '^[А-ЯЁ]{2,}$') OR regexp_matches(x, '^[0-9]{2,}$')), lambda x: lower(x))) e FROM w), "
    "ep AS (SELECT a.meeting_id, a.pos i, b.pos j, len(list_intersect(a.e, b.e)) * 1.0 / least(len(a.e), len(b.e)) score FROM e a JOIN e b ON a.meeting_id = b.meeting_id AND a.ok IS NOT DISTINCT FROM b.ok AND a.pos < b.pos WHERE len(a.e) > 0 AND len(b.e) > 0), "
)


# ---- phrases


@query(f"""WITH {PH}, c AS (SELECT meeting_id, pos, trim(regexp_replace(coalesce(text, ''), '{SP}+', ' ', 'g')) clean FROM ph)
SELECT meeting_id, pos, clean, {WORDS('clean')} words FROM c WHERE clean <> '' AND NOT ({WORDS('clean')} <= 3 AND len(list_filter(regexp_split_to_array(lower(clean), ' '), lambda w: w NOT IN ('угу','ага','эм','эээ','ну','вот','это','так'))) = 0)""")
def clean_phrases(spark, d):
    """Corrected phrases that aren't noise (no ASCII word stands against a correction here, so the SQL only collapses spaces)."""
    c = phrases.cleaned(_ph(spark, d), keep_noise=False)
    return c.select("meeting_id", "pos", "clean", X.word_count(F.col("clean")).alias("words"))


@query(f"""WITH {PH}, n AS (SELECT meeting_id, count(*) phrases FROM ph GROUP BY 1), t AS (SELECT meeting_id, max({WORDS('rawText')}) words FROM transcript GROUP BY 1)
SELECT meeting_id, coalesce(phrases, 0) phrases, coalesce(words, 0) words, coalesce(phrases, 0) = 0 OR coalesce(words, 0) < 20 AS poor FROM t FULL JOIN n USING (meeting_id)""")
def poor_transcripts(spark, d):
    """Meetings whose transcript is too poor to go on with."""
    return phrases.transcript_gate(_ph(spark, d), table(spark, d, "transcript"))


@query(f"""WITH {PH} SELECT meeting_id, speakerId, count(*) utterances, CAST(sum({WORDS('text')}) AS BIGINT) words,
CAST(sum(greatest(0, coalesce(endTimeMs, 0) - coalesce(startTimeMs, 0))) AS BIGINT) duration_ms FROM ph GROUP BY 1, 2""")
def speaker_stats(spark, d):
    """Utterances, words and speaking time per speaker."""
    return phrases.speaker_stats(_ph(spark, d))


_RUN = """g AS (SELECT *, sum(CASE WHEN {same} THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY pos) run FROM l)"""
_SES = f"""WITH {PH}, l AS (SELECT *, lag(speakerTag) OVER w pt, lag(endTimeMs) OVER w pe, lag(pos) OVER w pp FROM ph WHERE trim(text) <> '' WINDOW w AS (PARTITION BY meeting_id ORDER BY pos)), """


@query(_SES + _RUN.format(same="pp IS NOT NULL AND pt IS NOT DISTINCT FROM speakerTag AND coalesce(startTimeMs - pe < 2000, false)") + """
SELECT meeting_id, min(pos) first_pos, arg_min_null(speakerTag, pos) tag, arg_min_null(startTimeMs, pos) start_ms, arg_max_null(endTimeMs, pos) end_ms, count(*) n, trim(string_agg(text, ' ' ORDER BY pos)) AS text FROM g GROUP BY meeting_id, run""")
def sessions(spark, d):
    """Phrases of one tag without a long pause."""
    return phrases.sessions(_ph(spark, d))


@query(_SES + _RUN.format(same="pp IS NOT NULL AND pt IS NOT DISTINCT FROM speakerTag") + """
SELECT meeting_id, min(pos) first_pos, arg_min_null(speakerTag, pos) tag, CAST((run - 1) * 1000 AS BIGINT) start_ms, CAST(run * 1000 AS BIGINT) end_ms, count(*) n, trim(string_agg(text, ' ' ORDER BY pos)) AS text FROM g GROUP BY meeting_id, run""")
def tag_runs(spark, d):
    """Runs of one tag with synthetic times."""
    return phrases.tag_runs(_ph(spark, d))


@query(f"""WITH {PH}, l AS (SELECT *, lag(speakerId) OVER w ps, lag(pos) OVER w pp FROM ph WHERE text IS NOT NULL WINDOW w AS (PARTITION BY meeting_id ORDER BY pos)), """ + _RUN.format(same="pp IS NOT NULL AND ps IS NOT DISTINCT FROM speakerId") + """
SELECT meeting_id, min(pos) first_pos, arg_min_null(speakerId, pos) speaker, arg_min_null(startTimeMs, pos) start_ms, arg_max_null(endTimeMs, pos) end_ms, count(*) n, trim(string_agg(text, ' ' ORDER BY pos)) AS text FROM g GROUP BY meeting_id, run""")
def merged_runs(spark, d):
    """Runs of one speaker."""
    return phrases.merged_runs(_ph(spark, d))


_SPK = f"""WITH {PH}, s AS (SELECT meeting_id, speakerId, CAST(sum({WORDS('text')}) AS BIGINT) words, min(pos) first_pos FROM ph WHERE speakerId IS NOT NULL GROUP BY 1, 2) """


@query(_SPK + """SELECT meeting_id, speakerId original_id, 'speaker-' || k speaker_id, 'Спикер ' || k speaker_label, words, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY words DESC, first_pos) k FROM s)""")
def ranked_speakers(spark, d):
    """Speakers renumbered by words."""
    return phrases.ranked_speakers(_ph(spark, d))


@query("SELECT meeting_id, speakerId, CAST(dense_rank() OVER (PARTITION BY meeting_id ORDER BY speakerId) AS INT) AS number FROM (SELECT DISTINCT meeting_id, speakerId FROM phrases WHERE speakerId IS NOT NULL)")
def numbered_speakers(spark, d):
    """Speakers numbered by their ids as strings."""
    return phrases.dense_labels(table(spark, d, "phrases"))


@query(f"""WITH {PH}, l AS (SELECT meeting_id, pos, coalesce(length(text), 0) n, sum(coalesce(length(text), 0)) OVER (PARTITION BY meeting_id) whole FROM ph),
u AS (SELECT meeting_id, pos, CAST(CASE WHEN whole > 0 THEN floor(3600000 * n / whole + 0.5) ELSE 0 END AS BIGINT) dur FROM l),
r AS (SELECT *, CAST(coalesce(sum(dur) OVER (PARTITION BY meeting_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) start_ms FROM u)
SELECT meeting_id, pos, start_ms, start_ms + dur end_ms FROM r""")
def proportional_timing(spark, d):
    """Times by length of text over an hour."""
    return phrases.proportional_timing(_ph(spark, d), 3_600_000)


@query(f"""WITH {PH} SELECT meeting_id, speakerId, pos, text, startTimeMs start_ms FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, speakerId ORDER BY pos) k FROM ph WHERE speakerId IS NOT NULL) WHERE k = 1""")
def first_samples(spark, d):
    """Each speaker's first phrase."""
    return phrases.first_samples(_ph(spark, d))


@query(_SPK + """SELECT meeting_id, speakerId, words, first_pos, CASE WHEN first_pos = min(first_pos) OVER m THEN 'начал разговор' WHEN words = max(words) OVER m THEN 'основной спикер' ELSE 'участник' END AS role FROM s WINDOW m AS (PARTITION BY meeting_id)""")
def dialogue_roles(spark, d):
    """Roles in the talk."""
    return phrases.dialogue_roles(_ph(spark, d))


@query(f"""WITH {PH}, s AS (SELECT meeting_id, speakerLabel, min(pos) p FROM ph WHERE speakerLabel IS NOT NULL GROUP BY 1, 2)
SELECT meeting_id, speakerLabel, CAST((row_number() OVER (PARTITION BY meeting_id ORDER BY p, speakerLabel) - 1) % 8 AS INT) slot,
CAST(list_sum(list_transform(string_split(speakerLabel, ''), lambda c: unicode(c))) % 8 AS INT) fallback_slot FROM s""")
def label_palette(spark, d):
    """Colour slots of the labels."""
    return phrases.palette(_ph(spark, d))


@query(f"""WITH {PH} SELECT meeting_id, string_agg(coalesce(speakerLabel, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY pos) raw_text FROM ph GROUP BY 1""")
def meeting_texts(spark, d):
    """Each meeting's phrases as one text."""
    return phrases.raw_text(_ph(spark, d))


@query(f"""WITH {PH}, s AS (SELECT meeting_id, speakerId, min(pos) p FROM ph WHERE speakerId IS NOT NULL GROUP BY 1, 2) SELECT meeting_id, speakerId, row_number() OVER (PARTITION BY meeting_id ORDER BY p, speakerId) place FROM s""")
def speakers_in_order(spark, d):
    """Speakers by first appearance."""
    return phrases.in_order(_ph(spark, d), "meeting_id", "speakerId", "pos")


@query(f"""WITH RECURSIVE {PH}, l AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY pos) id, speakerLabel, text FROM ph),
z AS (SELECT meeting_id, id, length('[' || id || '] ' || coalesce(speakerLabel, 'null') || ': ' || coalesce(text, '')) size FROM l),
f AS (SELECT meeting_id, id, size chars, CAST(1 AS BIGINT) chunk FROM z WHERE id = 1 UNION ALL
SELECT z.meeting_id, z.id, CASE WHEN chars + size > 8000 THEN size ELSE chars + size END, CASE WHEN chars + size > 8000 THEN chunk + 1 ELSE chunk END FROM f JOIN z ON z.meeting_id = f.meeting_id AND z.id = f.id + 1),
c AS (SELECT meeting_id, chunk, min(id) first_id, max(id) last_id, max(chars) chars FROM f GROUP BY 1, 2), p AS (SELECT *, lag(first_id) OVER (PARTITION BY meeting_id ORDER BY chunk) pf FROM c)
SELECT meeting_id, chunk, first_id, last_id, CAST(chars AS BIGINT) chars, CASE WHEN pf IS NULL THEN CAST([] AS BIGINT[]) ELSE range(greatest(pf, first_id - 2), first_id) END context_ids FROM p""")
def refine_chunks(spark, d):
    """Lines packed into chunks of 8000 characters."""
    return phrases.packed_chunks(_ph(spark, d))


@query("""WITH RECURSIVE t AS (SELECT meeting_id, min(rawText) AS text FROM transcript GROUP BY 1), a AS (SELECT meeting_id, string_split(text, chr(10)) ls FROM t WHERE text IS NOT NULL),
l AS (SELECT meeting_id, unnest(range(1, len(ls) + 1)) id, unnest(ls) line FROM a), f AS (SELECT meeting_id, id, length(line) + 1 n, 1 piece FROM l WHERE id = 1 UNION ALL
SELECT l.meeting_id, l.id, CASE WHEN n + length(line) > 2000 THEN length(line) + 1 ELSE n + length(line) + 1 END, CASE WHEN n + length(line) > 2000 THEN piece + 1 ELSE piece END FROM f JOIN l ON l.meeting_id = f.meeting_id AND l.id = f.id + 1)
SELECT meeting_id, piece, string_agg(line, chr(10) ORDER BY id) AS text FROM f JOIN l USING (meeting_id, id) GROUP BY 1, 2""")
def transcript_pieces(spark, d):
    """Transcripts cut between lines into pieces of 2000 characters."""
    t = table(spark, d, "transcript").groupBy("meeting_id").agg(F.min("rawText").alias("text"))
    return phrases.text_pieces(t, ["meeting_id"], "text", 2000)


@query(rf"""WITH {PH}, n AS (SELECT meeting_id, pos, nullif(regexp_extract(trim(text), '^([А-ЯЁ][а-яё]{{1,20}})[?!.]?$', 1), '') AS name FROM ph),
s AS (SELECT meeting_id, name, min(pos) p FROM n WHERE name IS NOT NULL AND lower(name) NOT IN ({", ".join(f"'{w}'" for w in X.ADDRESS_STOP)}) AND NOT regexp_matches(lower(name), '(ск|бург|град|поль|полье)$') GROUP BY 1, 2)
SELECT meeting_id, name, row_number() OVER (PARTITION BY meeting_id ORDER BY p, name) place FROM s""")
def addressed_names(spark, d):
    """Names that whole phrases call."""
    return phrases.addressed_names(_ph(spark, d))


@query()
def numeric_facts(spark, d):
    """The numbers that each phrase names."""
    p = _ph(spark, d)
    return p.select("meeting_id", "pos", numbers.numeric_values(F.col("text")).alias("values")).where(F.size("values") > 0)


@query(f"""WITH {PH}, s AS (SELECT CAST(floor(greatest(coalesce(startTimeMs, 0), 0) / 1000) AS BIGINT) s, meeting_id, pos FROM ph)
SELECT meeting_id, pos, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END timecode FROM s""")
def timecodes(spark, d):
    """Start times as h:mm:ss."""
    return _ph(spark, d).select("meeting_id", "pos", X.timecode(F.col("startTimeMs")).alias("timecode"))


# ---- texts with structure


@query(f"WITH {PH} SELECT meeting_id, pos, coalesce(speakerTag, '0') tag, text, CAST(startTimeMs AS BIGINT) start_ms FROM ph WHERE trim(text) <> ''")
def recognised_phrases(spark, d):
    """Phrases written as the recogniser's JSON lines and parsed from them again."""
    word = F.struct(F.col("text"), F.col("startTimeMs").cast("long").alias("startTimeMs"), F.col("endTimeMs").cast("long").alias("endTimeMs"))
    final = F.struct(F.col("speakerTag").alias("channelTag"), F.array(F.struct("text", F.array(word).alias("words"))).alias("alternatives"))
    lines = _ph(spark, d).select("meeting_id", "pos", F.to_json(F.struct(F.struct(final.alias("final")).alias("result"))).alias("value"))
    r = formats.parse_recognition(lines, keep=["meeting_id", "pos"])
    return r.select("meeting_id", "pos", "tag", "text", F.col("words")[0]["startTimeMs"].alias("start_ms"))


@query("SELECT DISTINCT meeting_id, id, label, guessedName FROM speaker_drafts WHERE id <> '' AND label <> ''")
def salvaged_drafts(spark, d):
    """Drafts read back from an answer that was cut off within its last object."""
    s = table(spark, d, "speaker_drafts").select("meeting_id", "id", "label", "guessedName").distinct()
    raw = F.concat(F.lit('```json [{"id": "x"}, '), F.to_json(F.struct("id", "label", "guessedName"), {"ignoreNullFields": "false"}), F.lit(', {"id": "speaker-9", "guessedName": '))
    cut = s.select("meeting_id", raw.alias("raw"))
    return cut.select("meeting_id", F.inline(X.salvaged_drafts(F.col("raw"))))



_ANSWERS = r"""r AS (SELECT model, caseId, run, min(rawResponse) raw FROM results GROUP BY ALL), l AS (SELECT model, caseId, run, unnest(range(0, len(ls))) place, unnest(ls) line FROM (SELECT *, string_split(raw, chr(10)) ls FROM r WHERE raw IS NOT NULL)),
b AS (SELECT model, caseId, run, place, CAST(regexp_extract(line, '^\s*\[(\d+)\]', 1) AS INT) id, trim(regexp_replace(trim(regexp_extract(line, '^\s*\[\d+\]\s*(.*)$', 1)), '(?i)^спикер\s*\d+\s*:\s*', '')) body FROM l WHERE regexp_matches(line, '^\s*\[\d+\]')),
ans AS (SELECT model, caseId, run, id, arg_max(body, place) body FROM b WHERE body <> '' GROUP BY ALL)"""
_RUN_KEYS = ["model", "caseId", "run"]


def _answers(spark, d):
    """Lines of the models' answers that hold something, each number once."""
    r = table(spark, d, "results").groupBy(*_RUN_KEYS).agg(F.min("rawResponse").alias("raw"))
    return attribution.answered(r.select(*_RUN_KEYS, F.posexplode(F.split("raw", "\n")).alias("place", "line")), _RUN_KEYS)


@query(f"WITH {_ANSWERS} SELECT model, caseId, run, id, body FROM ans")
def refined_lines(spark, d):
    """Numbered lines of the models' answers; blank ones are none, and of one number the last counts."""
    return _answers(spark, d)


#: The lines that a case asks for: every number that some answer to it holds.
_ASKED = "asked AS (SELECT a.model, a.caseId, a.run, c.id FROM (SELECT DISTINCT model, caseId, run FROM r WHERE raw IS NOT NULL) a JOIN (SELECT DISTINCT caseId, id FROM ans) c USING (caseId))"


def _asked(spark, d, answers):
    runs = table(spark, d, "results").where("rawResponse IS NOT NULL").select(*_RUN_KEYS).distinct()
    case = answers.groupBy("caseId", "id").agg(F.min("body").alias("text"))
    return runs.join(case, "caseId").select(*_RUN_KEYS, "id", "text")


@query(f"WITH {_ANSWERS}, {_ASKED} SELECT model, caseId, run, id FROM asked WHERE NOT EXISTS (SELECT 1 FROM ans i WHERE NOT regexp_matches(i.body, '[0-9]') AND i.model IS NOT DISTINCT FROM asked.model AND i.caseId = asked.caseId AND i.run = asked.run AND i.id = asked.id)")
def missing_lines(spark, d):
    """Lines that a case asks for and an answer lacks, if what holds digits doesn't count as answered."""
    got = _answers(spark, d)
    asked = _asked(spark, d, got)
    got = got.where(~F.col("body").rlike("[0-9]"))
    return asked.join(got, [asked[c].eqNullSafe(got[c]) for c in (*_RUN_KEYS, "id")], "left_anti").select(*_RUN_KEYS, "id")


@query()
def correction_loop(spark, d):
    """What came of each answer's lines against the case's (the smallest answer to a line stands for what was asked): missing, applied, rejected for changed numbers, unchanged."""
    got = _answers(spark, d)
    return attribution.correction_report(_asked(spark, d, got), got.withColumnRenamed("body", "refined"), _RUN_KEYS)


@query(r"""WITH t AS (SELECT meeting_id, min(rawText) AS text FROM transcript GROUP BY 1), a AS (SELECT meeting_id, regexp_split_to_array(text, '\r?\n') ls FROM t WHERE text IS NOT NULL),
l AS (SELECT meeting_id, CAST(unnest(range(0, len(ls))) AS INT) pos, unnest(ls) line FROM a)
SELECT meeting_id, pos, CASE WHEN regexp_matches(line, '^(.{1,50}):\s*(.+)$') THEN trim(regexp_extract(line, '^(.{1,50}):\s*(.+)$', 1)) END AS label,
CASE WHEN regexp_matches(line, '^(.{1,50}):\s*(.+)$') THEN trim(regexp_extract(line, '^(.{1,50}):\s*(.+)$', 2)) ELSE trim(line) END AS text FROM l WHERE trim(line) <> ''""")
def transcript_lines(spark, d):
    """Transcripts parsed into labelled lines."""
    t = table(spark, d, "transcript").groupBy("meeting_id").agg(F.min("rawText").alias("text"))
    l = t.select("meeting_id", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).where("trim(line) <> ''")
    label, body = X.labelled(F.col("line"))
    return l.select("meeting_id", "pos", label.alias("label"), body.alias("text"))


@query(r"""WITH l AS (SELECT doc_id, string_split(trim(unnest(string_split(text, chr(10)))), ' ') f FROM documents WHERE text LIKE '%SPEAKER %')
SELECT doc_id, f[8] speaker, CAST(f[4] AS DOUBLE) AS start, CAST(f[4] AS DOUBLE) + CAST(f[5] AS DOUBLE) AS stop FROM l WHERE f[1] = 'SPEAKER' AND len(f) >= 8 AND TRY_CAST(f[4] AS DOUBLE) IS NOT NULL AND TRY_CAST(f[5] AS DOUBLE) IS NOT NULL""")
def rttm_segments(spark, d):
    """Diarization segments found in documents."""
    l = table(spark, d, "documents").where(F.col("text").contains("SPEAKER ")).select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return attribution.parse_rttm(l, keep=["doc_id"])


@query(r"""WITH l AS (SELECT doc_id, string_split(trim(unnest(string_split(text, chr(10)))), ' ') f FROM documents WHERE text LIKE '%SPEAKER %'),
s AS (SELECT doc_id, f[8] sp, CAST(f[4] AS DOUBLE) a, CAST(f[4] AS DOUBLE) + CAST(f[5] AS DOUBLE) b FROM l WHERE f[1] = 'SPEAKER' AND len(f) >= 8 AND TRY_CAST(f[4] AS DOUBLE) IS NOT NULL AND TRY_CAST(f[5] AS DOUBLE) IS NOT NULL)
SELECT doc_id, printf('SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>', CAST(doc_id AS VARCHAR), a, b - a, sp) line FROM s""")
def rttm_lines(spark, d):
    """Segments written back as RTTM lines."""
    s = rttm_segments(spark, d)
    return s.select("doc_id", attribution.rttm_line(F.col("doc_id").cast("string"), F.col("speaker"), F.col("start"), F.col("stop")).alias("line"))


@query(r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) line FROM documents WHERE text LIKE '%{%'), v AS (SELECT doc_id, TRY_CAST(line AS JSON) j FROM l WHERE line LIKE '{%}')
SELECT doc_id, coalesce(json_extract_string(j, '$.speakerTag'), '0') tag, CAST(json_extract_string(j, '$.startTimeMs') AS BIGINT) start_ms FROM v WHERE json_extract_string(j, '$.final') = 'true'""")
def recognition_lines(spark, d):
    """Final results of the recogniser among JSON lines; bad lines are skipped."""
    l = table(spark, d, "documents").where(F.col("text").contains("{")).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    j = F.from_json(F.trim("line"), "speakerTag string, startTimeMs long, final boolean")
    return l.where(F.trim("line").rlike(r"^\{.*\}$")).select("doc_id", j.alias("j")).where("j.final").select("doc_id", F.coalesce("j.speakerTag", F.lit("0")).alias("tag"), F.col("j.startTimeMs").alias("start_ms"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents WHERE text LIKE '% — %'), m AS (SELECT doc_id, trim(regexp_extract(line, '^([А-ЯЁ]{2,6}) — ([^\t]+)\t', 1)) term, trim(regexp_extract(line, '^([А-ЯЁ]{2,6}) — ([^\t]+)\t', 2)) meaning FROM l)
SELECT term, meaning, count(*) n, count(DISTINCT doc_id) docs FROM m WHERE term <> '' GROUP BY 1, 2""")
def abbreviations(spark, d):
    """A glossary of abbreviations over all documents."""
    l = table(spark, d, "documents").where(F.col("text").contains(" — ")).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    rx = "^([А-ЯЁ]{2,6}) — ([^\\t]+)\\t"
    m = l.select("doc_id", F.trim(F.regexp_extract("line", rx, 1)).alias("term"), F.trim(F.regexp_extract("line", rx, 2)).alias("meaning")).where("term <> ''")
    per = m.groupBy("term", "meaning", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term", "meaning").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


_SLUG = "lower(trim(name))"
for _a, _b in X.SLUG.items():
    _SLUG = f"replace({_SLUG}, '{_a}', '{_b}')"


@query(f"WITH n AS (SELECT DISTINCT title AS name FROM (SELECT summary.title title FROM protocol UNION ALL SELECT name FROM projects) WHERE title IS NOT NULL) SELECT name, regexp_replace(regexp_replace({_SLUG}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug FROM n")
def slugs(spark, d):
    """Slugs of all titles and project names."""
    n = table(spark, d, "protocol").select(F.col("summary.title").alias("name")).union(table(spark, d, "projects").select("name")).where("name IS NOT NULL").distinct()
    return n.withColumn("slug", X.slug(F.col("name")))


@query(r"SELECT DISTINCT objkey, regexp_replace(objkey, '\.json$', '.refined.json') refined, regexp_replace(objkey, '\.json$', '.voice.json') voice FROM storage_keys")
def artifact_keys(spark, d):
    """Keys of the artifacts beside stored documents."""
    k = table(spark, d, "storage_keys").select("objkey").distinct()
    return k.select("objkey", X.key_variant(F.col("objkey"), "refined").alias("refined"), X.key_variant(F.col("objkey"), "voice").alias("voice"))


_MONTH = "CASE " + " ".join(f"WHEN m IN ({', '.join(repr(w) for w in ws.split())}) THEN {i}" for i, ws in enumerate(X.MONTHS, 1)) + " END"
_MRX = "|".join(w for ws in X.MONTHS for w in ws.split())


@query(rf"""WITH {TASKS}, md AS (SELECT id meeting_id, max(TRY_CAST(date AS DATE)) mday FROM meetings GROUP BY 1), j AS (SELECT t.*, mday, regexp_matches(deadline, '^\d{{4}}-\d{{2}}-\d{{2}}$') iso FROM t LEFT JOIN md USING (meeting_id)),
x AS (SELECT *, lower(regexp_extract(deadline, '(?i)(\d{{1,2}})(?:-?(?:го|ого|му|е))?\s+({_MRX})', 2)) m, TRY_CAST(CASE WHEN iso THEN substr(deadline, 9, 2) ELSE regexp_extract(deadline, '(?i)(\d{{1,2}})(?:-?(?:го|ого|му|е))?\s+({_MRX})', 1) END AS INT) dd FROM j),
y AS (SELECT *, CASE WHEN iso THEN CAST(substr(deadline, 6, 2) AS INT) ELSE {_MONTH} END mm FROM x)
SELECT meeting_id, pos, CASE WHEN mday IS NOT NULL AND mm IS NOT NULL AND dd IS NOT NULL AND (iso OR NOT regexp_matches(deadline, '\b(19|20)\d{{2}}\b'))
THEN printf('%d-%02d-%02d', year(mday) + CASE WHEN make_date(year(mday), 1, 1) + to_months(mm - 1) + to_days(dd - 1) < mday THEN 1 ELSE 0 END, mm, dd) ELSE deadline END AS deadline FROM y""")
def deadlines(spark, d):
    """Deadlines with the year that the meeting's date implies."""
    m = table(spark, d, "meetings").groupBy(F.col("id").alias("meeting_id")).agg(F.max(F.col("date").try_cast("date")).alias("day"))
    return _tasks(spark, d).join(m, "meeting_id", "left").select("meeting_id", "pos", X.future_deadline(F.col("deadline"), F.col("day")).alias("deadline"))


# ---- attribution and lookups


@query(f"""WITH {PH}, s AS (SELECT meeting_id, pos, speakerTag, startTimeMs a, endTimeMs b FROM ph), o AS (SELECT p.meeting_id, p.pos, q.speakerTag speaker, sum(least(p.b, q.b) - greatest(p.a, q.a)) o, min(q.pos) f
FROM s p JOIN s q ON p.meeting_id = q.meeting_id AND p.a < q.b AND p.b > q.a AND p.b > p.a AND q.b > q.a GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, pos ORDER BY o DESC, f) k FROM o) SELECT s.meeting_id, s.pos, coalesce(k.speaker, 'SPEAKER_00') speaker, CAST(coalesce(k.o, 0) AS BIGINT) overlap_ms FROM s LEFT JOIN k ON k.meeting_id = s.meeting_id AND k.pos = s.pos AND k.k = 1""")
def overlap_speakers(spark, d):
    """The speaker whose spans overlap each phrase most, all phrases' spans being the segments."""
    p = _ph(spark, d).select("meeting_id", "pos", "speakerTag", F.col("startTimeMs").alias("start_ms"), F.col("endTimeMs").alias("end_ms"))
    return attribution.overlap_attribution(p, p.withColumnsRenamed({"pos": "seg", "speakerTag": "speaker"}), fallback="SPEAKER_00")


@query(f"""WITH {PH}, g AS (SELECT meeting_id, id speakerId, min(guessedName) draft FROM speaker_drafts GROUP BY 1, 2) SELECT meeting_id, pos, speakerId, coalesce(draft, detectedName) AS name FROM ph LEFT JOIN g USING (meeting_id, speakerId)""")
def named_phrases(spark, d):
    """Phrases with their speaker's name."""
    return attribution.named_segments(_ph(spark, d), table(spark, d, "speaker_drafts"))


_DRAFT = "dr AS (SELECT meeting_id, id, min(guessedName) guessedName, min(confidence) confidence, min(proposedName) proposedName, min(proposedConfidence) proposedConfidence, bool_or(has_proposal) has_proposal FROM speaker_drafts GROUP BY 1, 2)"


def _drafts(spark, d):
    s = table(spark, d, "speaker_drafts")
    return s.groupBy("meeting_id", "id").agg(*(F.min(c).alias(c) for c in ("guessedName", "confidence", "proposedName", "proposedConfidence")), F.max("has_proposal").alias("has_proposal"))


@query(f"""WITH {_DRAFT} SELECT meeting_id, id, guessedName confirmed, CASE WHEN has_proposal THEN proposedName ELSE guessedName END proposed, CASE WHEN has_proposal THEN proposedConfidence ELSE confidence END proposed_confidence FROM dr""")
def confirmed_names(spark, d):
    """Confirmed names beside their proposals."""
    s = _drafts(spark, d)
    return attribution.confirmed_drafts(s.select("meeting_id", "id", F.col("guessedName").alias("confirmed")), s)


@query(f"""WITH {_DRAFT}, c AS (SELECT meeting_id, nullif(replace(lower(trim(CASE WHEN has_proposal THEN proposedName ELSE guessedName END)), 'ё', 'е'), '') p, nullif(replace(lower(trim(guessedName)), 'ё', 'е'), '') c FROM dr)
SELECT meeting_id, count(p) proposed, count(*) FILTER (p = c) agreed, count(*) FILTER (p <> c) changed, count(*) FILTER (p IS NULL AND c IS NOT NULL) filled, count(*) FILTER (p IS NOT NULL AND c IS NULL) cleared FROM c GROUP BY 1""")
def confirmation_summary(spark, d):
    """What became of the proposals, per meeting."""
    return minutes.confirmation_summary(confirmed_names(spark, d))


@query(f"""WITH {PH}, l AS (SELECT meeting_id, speakerLabel, min(pos) first_pos FROM ph WHERE speakerLabel IS NOT NULL GROUP BY 1, 2), {_DRAFT.replace('GROUP BY 1, 2)', 'GROUP BY 1, 2)')},
s AS (SELECT meeting_id, id, label, guessedName FROM speaker_drafts), a AS (SELECT meeting_id, guessedName k, min(id) v FROM s GROUP BY 1, 2), b AS (SELECT meeting_id, label k, min(id) v FROM s GROUP BY 1, 2), c AS (SELECT meeting_id, id k, min(id) v FROM s GROUP BY 1, 2)
SELECT l.meeting_id, l.speakerLabel, coalesce(a.v, b.v, c.v) AS found FROM l LEFT JOIN a ON a.meeting_id = l.meeting_id AND a.k = l.speakerLabel LEFT JOIN b ON b.meeting_id = l.meeting_id AND b.k = l.speakerLabel LEFT JOIN c ON c.meeting_id = l.meeting_id AND c.k = l.speakerLabel""")
def label_lookup(spark, d):
    """The draft that a label names: by name, by label, by id."""
    l = table(spark, d, "phrases").where("speakerLabel IS NOT NULL").select("meeting_id", "speakerLabel").distinct()
    s = table(spark, d, "speaker_drafts")
    return attribution.looked_up(l, s, [("speakerLabel", "guessedName"), ("speakerLabel", "label"), ("speakerLabel", "id")], "id").select("meeting_id", "speakerLabel", "found")


@query(f"""WITH r AS (SELECT DISTINCT meeting_id grp, p AS f, replace(lower(trim(p)), 'ё', 'е') k FROM (SELECT meeting_id, unnest(participants) p FROM protocol) WHERE p IS NOT NULL), n AS (SELECT DISTINCT meeting_id grp, guessedName AS name, replace(lower(trim(guessedName)), 'ё', 'е') k FROM speaker_drafts WHERE guessedName IS NOT NULL),
a AS (SELECT grp, k, min(f) e FROM r GROUP BY 1, 2), b AS (SELECT grp, split_part(k, ' ', 1) k, count(*) c, min(f) o FROM (SELECT DISTINCT grp, k, f FROM r) GROUP BY 1, 2)
SELECT n.grp, n.name, CASE WHEN a.e IS NOT NULL THEN a.e WHEN b.c = 1 THEN b.o ELSE n.name END full_name, CASE WHEN a.e IS NOT NULL THEN 1 ELSE coalesce(b.c, 0) END n FROM n LEFT JOIN a USING (grp, k) LEFT JOIN b USING (grp, k)""")
def roster_names(spark, d):
    """Guessed names expanded by the meeting's participants."""
    r = table(spark, d, "protocol").select(F.col("meeting_id").alias("grp"), F.explode("participants").alias("name")).where("name IS NOT NULL")
    n = table(spark, d, "speaker_drafts").select(F.col("meeting_id").alias("grp"), F.col("guessedName").alias("name")).where("name IS NOT NULL")
    return attribution.roster_expansion(n, r)


@query(r"""WITH m AS (SELECT id, min(projectId) p, min(baseKey) b FROM meetings GROUP BY 1), k AS (SELECT DISTINCT objkey FROM storage_keys), q AS (SELECT id, trim(b, ' /') || '/meeting.json' k1, 'projects/' || lower(trim(p, ' /')) || '/meetings/' || id || '/meeting.json' k2 FROM m)
SELECT id, CASE WHEN a.objkey IS NOT NULL THEN 'new' WHEN b.objkey IS NOT NULL THEN 'legacy' END AS layout, CASE WHEN a.objkey IS NOT NULL THEN k1 WHEN b.objkey IS NOT NULL THEN k2 END AS found FROM q LEFT JOIN k a ON a.objkey = k1 LEFT JOIN k b ON b.objkey = k2""")
def stored_meetings(spark, d):
    """Where each meeting is stored: the new layout, else the old one."""
    m = table(spark, d, "meetings").groupBy("id").agg(F.min("projectId").alias("p"), F.min("baseKey").alias("b"))
    strip = lambda c: F.regexp_replace(c, "^[ /]+|[ /]+$", "")
    k1, k2 = F.concat(strip("b"), F.lit("/meeting.json")), F.concat(F.lit("projects/"), F.lower(strip("p")), F.lit("/meetings/"), F.col("id"), F.lit("/meeting.json"))
    return audit.fallback_lookup(m, table(spark, d, "storage_keys"), k1, k2).select("id", "layout", "found")


@query("""WITH a AS (SELECT DISTINCT id FROM meetings), b AS (SELECT DISTINCT meeting_id id FROM protocol) SELECT id, 'only_a' side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'only_b' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def index_gaps(spark, d):
    """Meetings without minutes, and minutes without a meeting."""
    return audit.index_gaps(table(spark, d, "meetings").select("id"), table(spark, d, "protocol").select(F.col("meeting_id").alias("id")), "id")


@query("""WITH p AS (SELECT id, min(ownerId) o FROM projects GROUP BY 1), m AS (SELECT id, min(projectId) projectId FROM meetings GROUP BY 1) SELECT m.id, m.projectId, p.o ownerId FROM m LEFT JOIN p ON p.id = m.projectId""")
def meeting_owners(spark, d):
    """Meetings with the owner of their project."""
    m = table(spark, d, "meetings").groupBy("id").agg(F.min("projectId").alias("projectId")).withColumn("ownerId", F.lit(None).cast("string"))
    p = table(spark, d, "projects").select(F.col("id").alias("projectId"), "ownerId")
    return audit.backfilled(m, p, "projectId", "ownerId").select("id", "projectId", "ownerId")


_LATEST = "lm AS (SELECT * EXCLUDE k FROM (SELECT id, projectId, status, updatedAt, deletedAt, summaryTitle, row_number() OVER (PARTITION BY id ORDER BY updatedAt DESC, arrivedAt DESC) k FROM meetings) WHERE k = 1)"


def _latest(spark, d):
    m = table(spark, d, "meetings").select("id", "projectId", "status", "updatedAt", "arrivedAt", "deletedAt", "summaryTitle")
    return audit.latest(m, "id", ["updatedAt", "arrivedAt"])


@query(f"WITH {_LATEST} SELECT id, status, CAST(updatedAt AS VARCHAR) updated FROM lm")
def latest_saves(spark, d):
    """The last save of every meeting."""
    return _latest(spark, d).select("id", "status", F.col("updatedAt").cast("string").alias("updated"))


@query(f"WITH {_LATEST} SELECT id meeting_id, last_value(CASE WHEN status = 'done' THEN id END IGNORE NULLS) OVER (PARTITION BY projectId ORDER BY updatedAt, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) previous_id FROM lm WHERE projectId IS NOT NULL")
def previous_meetings(spark, d):
    """The finished meeting before each meeting of a project."""
    return minutes.previous_meeting(_latest(spark, d))


@query(f"WITH {_LATEST}, k AS (SELECT projectId, id, row_number() OVER (PARTITION BY projectId ORDER BY updatedAt DESC, id) place FROM lm WHERE deletedAt IS NULL) SELECT projectId, id, CAST(place AS INT) place FROM k WHERE place <= 5")
def recent_meetings(spark, d):
    """The five latest meetings of each project that aren't deleted."""
    k = F.row_number().over(W.partitionBy("projectId").orderBy(F.desc("updatedAt"), "id"))
    return _latest(spark, d).where("deletedAt IS NULL").withColumn("place", k).where("place <= 5").select("projectId", "id", "place")


# ---- similarity


@query(_PAIRED + "z AS (SELECT 1) SELECT meeting_id, i, j, round(score, 6) score FROM d WHERE score >= 0.3 AND score < 0.6")
def borderline_pairs(spark, d):
    """Pairs of one owner's tasks that may be the same."""
    it = _items(spark, d)
    return similarity.dice_pairs(it, 0.3, 0.6).select(F.get_json_object("grp", "$[0]").alias("meeting_id"), "i", "j", F.round("score", 6).alias("score"))


@query(_BY_OWNER + _ENT + "z AS (SELECT 1) SELECT meeting_id, i, j, round(score, 6) score FROM ep WHERE score >= 0.5")
def entity_pairs(spark, d):
    """Pairs of one owner's tasks that share their named things."""
    return similarity.entity_pairs(_items(spark, d)).select(F.get_json_object("grp", "$[0]").alias("meeting_id"), "i", "j", F.round("score", 6).alias("score"))


@query(_PAIRED + _ENT + "u AS (SELECT meeting_id, i, j, score, 0 src FROM d WHERE score >= 0.3 AND score < 0.6 UNION ALL SELECT meeting_id, i, j, score, 1 FROM ep WHERE score >= 0.5) SELECT meeting_id, i, j, round(arg_min(score, src), 6) score, CAST(min(src) AS INT) src FROM u GROUP BY 1, 2, 3")
def candidate_pairs(spark, d):
    """Both kinds of pairs without doubles."""
    return similarity.all_pairs(_items(spark, d)).select(F.get_json_object("grp", "$[0]").alias("meeting_id"), "i", "j", F.round("score", 6).alias("score"), "src")


@query((_PAIRED + """e AS (SELECT meeting_id, ok, j pos, list(i) near FROM (SELECT d.meeting_id, k.ok, i, j FROM d JOIN k ON k.meeting_id = d.meeting_id AND k.pos = d.j WHERE score >= 0.6) GROUP BY 1, 2, 3),
o AS (SELECT k.meeting_id, coalesce(k.ok, chr(0)) ok, k.pos, coalesce(near, []) near, row_number() OVER (PARTITION BY k.meeting_id, k.ok ORDER BY k.pos) n FROM k LEFT JOIN e ON e.meeting_id = k.meeting_id AND e.pos = k.pos),
f AS (SELECT meeting_id, ok, n, [pos] kept FROM o WHERE n = 1 UNION ALL SELECT o.meeting_id, o.ok, o.n, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, o.pos) END FROM f JOIN o ON o.meeting_id = f.meeting_id AND o.ok = f.ok AND o.n = f.n + 1)
SELECT meeting_id, unnest(kept) pos FROM (SELECT meeting_id, ok, arg_max(kept, n) kept FROM f GROUP BY 1, 2)""").replace("WITH", "WITH RECURSIVE", 1))
def kept_tasks(spark, d):
    """Tasks left by the greedy dedup within an owner."""
    return similarity.greedy_dedup(_items(spark, d)).select(F.get_json_object("grp", "$[0]").alias("meeting_id"), "pos")


_DECISIONS = "dc AS (SELECT DISTINCT meeting_id, decision FROM (SELECT meeting_id, unnest(decisions) decision FROM protocol) WHERE decision IS NOT NULL)"


@query(f"""WITH {TASKS}, {_DECISIONS}, a AS (SELECT *, {NORM.format('decision')} s FROM dc), b AS (SELECT DISTINCT meeting_id, {NORM.format('task')} s FROM t WHERE task IS NOT NULL),
ag AS (SELECT *, CASE WHEN length(s) >= 3 THEN {GRAMS.format('s')} ELSE [] END g FROM a), bg AS (SELECT *, CASE WHEN length(s) >= 3 THEN {GRAMS.format('s')} ELSE [] END g FROM b)
SELECT meeting_id, decision FROM ag WHERE NOT EXISTS (SELECT 1 FROM bg WHERE bg.meeting_id = ag.meeting_id AND {DICE.format('ag.g', 'bg.g')} >= 0.6)""")
def own_decisions(spark, d):
    """Decisions that no task of the meeting says again."""
    dc = table(spark, d, "protocol").select("meeting_id", F.explode("decisions").alias("text")).where("text IS NOT NULL").distinct()
    it = dc.select(F.col("meeting_id").alias("grp"), F.col("text").alias("pos"), "text")
    return similarity.drop_resembling(it, _tasks(spark, d).select(F.col("meeting_id").alias("grp"), F.col("task").alias("text"))).select(F.col("grp").alias("meeting_id"), F.col("text").alias("decision"))


@query(f"""WITH v AS (SELECT DISTINCT meeting_id, p FROM (SELECT meeting_id, unnest(participants) p FROM protocol) WHERE p IS NOT NULL), s AS (SELECT meeting_id, label, guessedName g FROM speaker_drafts),
vg AS (SELECT *, {NORM.format('p')} s FROM v), vq AS (SELECT *, CASE WHEN length(s) >= 3 THEN {GRAMS.format('s')} ELSE [] END g FROM vg), n AS (SELECT DISTINCT meeting_id, {NORM.format('g')} s FROM s WHERE g IS NOT NULL), nq AS (SELECT *, CASE WHEN length(s) >= 3 THEN {GRAMS.format('s')} ELSE [] END g FROM n)
SELECT meeting_id, p AS participant FROM vq WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.meeting_id = vq.meeting_id) OR EXISTS (SELECT 1 FROM s WHERE s.meeting_id = vq.meeting_id AND s.label = vq.p) OR EXISTS (SELECT 1 FROM nq WHERE nq.meeting_id = vq.meeting_id AND {DICE.format('vq.g', 'nq.g')} >= 0.6)""")
def grounded_participants(spark, d):
    """Participants who were heard."""
    v = table(spark, d, "protocol").select(F.col("meeting_id").alias("grp"), F.explode("participants").alias("text")).where("text IS NOT NULL").distinct().withColumn("pos", F.col("text"))
    s = table(spark, d, "speaker_drafts")
    names = s.where("guessedName IS NOT NULL").select(F.col("meeting_id").alias("grp"), F.col("guessedName").alias("text"))
    labels = s.select(F.col("meeting_id").alias("grp"), "label")
    return similarity.grounded(v, names, labels).select(F.col("grp").alias("meeting_id"), F.col("text").alias("participant"))


@query(f"""WITH {TASKS}, s AS (SELECT meeting_id, label, guessedName g FROM speaker_drafts), o AS (SELECT DISTINCT meeting_id, owner, {NORM.format('owner')} s FROM t WHERE owner <> ''), og AS (SELECT *, CASE WHEN length(s) >= 3 THEN {GRAMS.format('s')} ELSE [] END g FROM o),
n AS (SELECT DISTINCT meeting_id, {NORM.format('g')} s FROM s WHERE g IS NOT NULL), nq AS (SELECT *, CASE WHEN length(s) >= 3 THEN {GRAMS.format('s')} ELSE [] END g FROM n),
k AS (SELECT meeting_id, owner FROM og WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.meeting_id = og.meeting_id) OR EXISTS (SELECT 1 FROM s WHERE s.meeting_id = og.meeting_id AND s.label = og.owner) OR EXISTS (SELECT 1 FROM nq WHERE nq.meeting_id = og.meeting_id AND {DICE.format('og.g', 'nq.g')} >= 0.6))
SELECT t.meeting_id, pos, CASE WHEN t.owner IS NULL OR t.owner = '' OR k.owner IS NOT NULL THEN t.owner ELSE 'Команда' END AS owner FROM t LEFT JOIN k ON k.meeting_id = t.meeting_id AND k.owner = t.owner""")
def grounded_tasks(spark, d):
    """Tasks of owners who weren't heard, given to the team."""
    s = table(spark, d, "speaker_drafts")
    names = s.where("guessedName IS NOT NULL").select(F.col("meeting_id").alias("grp"), F.col("guessedName").alias("text"))
    t = _tasks(spark, d).select(F.col("meeting_id").alias("grp"), "pos", "owner")
    return similarity.grounded_owners(t, names, s.select(F.col("meeting_id").alias("grp"), "label")).withColumnRenamed("grp", "meeting_id")


# ---- minutes


@query("""WITH v AS (SELECT meeting_id, label, guessedName AS name FROM speaker_drafts), t AS (SELECT meeting_id, label, count(*) total FROM v GROUP BY 1, 2), p AS (SELECT meeting_id, label, replace(lower(trim(name)), 'ё', 'е') name_key, count(*) votes FROM v WHERE trim(name) <> '' GROUP BY 1, 2, 3)
SELECT meeting_id, label, name_key, votes, total, round(votes / total, 6) share FROM p JOIN t USING (meeting_id, label)""")
def vote_shares(spark, d):
    """Shares of the names guessed for a label."""
    v = minutes.vote_shares(table(spark, d, "speaker_drafts").select("meeting_id", "label", F.col("guessedName").alias("name")).where("label IS NOT NULL"))
    return v.withColumn("share", F.round("share", 6))


@query()
def assigned_names(spark, d):
    """One name per label, by votes and within the roster."""
    s = table(spark, d, "speaker_drafts")
    votes = s.select("meeting_id", "label", F.col("guessedName").alias("name"), F.col("id").alias("seq")).where("label IS NOT NULL").distinct()
    roster = table(spark, d, "protocol").select("meeting_id", F.explode("participants").alias("name"))
    return minutes.assign_names(votes, roster)


@query(f"""WITH {TASKS} SELECT meeting_id, pos, CASE WHEN NOT {JUNK.format('owner')} THEN owner END AS owner, task, CASE WHEN NOT {JUNK.format('deadline')} THEN deadline END AS deadline FROM t WHERE NOT {JUNK.format('task')}""")
def sane_tasks(spark, d):
    """Tasks without placeholder values."""
    return minutes.sane_tasks(_tasks(spark, d))


_PR = "pr AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY arrivedAt) k FROM protocol) WHERE k = 1)"


def _protocol(spark, d):
    p = table(spark, d, "protocol")
    return p.groupBy("meeting_id").agg(F.min_by(F.struct("summary", "participants", "topics", "decisions"), "arrivedAt").alias("r")).select("meeting_id", "r.*")


@query(f"""WITH {_PR} SELECT meeting_id, list_filter(coalesce(decisions, []), lambda x: NOT {JUNK.format('x')}) decisions, len(list_filter(coalesce(topics, []), lambda x: x IS NOT NULL AND NOT {JUNK.format('x.title')} AND NOT {JUNK.format('x.narrative')})) topics FROM pr""")
def sane_protocols(spark, d):
    """Lists of the minutes without placeholders."""
    return _protocol(spark, d).select("meeting_id", minutes.sane_strings("decisions").alias("decisions"), F.size(minutes.sane_topics("topics")).alias("topics"))


@query("""WITH s AS (SELECT DISTINCT meeting_id, pos sample, text overview FROM (SELECT meeting_id, pos, min(text) AS text FROM phrases GROUP BY 1, 2)) SELECT meeting_id, arg_max_null(overview, (length(coalesce(overview, '')) * 1000000 - sample)) overview, CAST(arg_max(sample, (length(coalesce(overview, '')) * 1000000 - sample)) AS INT) sample, count(*) samples FROM s GROUP BY 1""")
def longest_samples(spark, d):
    """The longest of many versions, the earliest of equals."""
    s = _ph(spark, d).select("meeting_id", F.col("pos").alias("sample"), F.lit(None).cast("string").alias("title"), F.col("text").alias("overview"))
    return minutes.best_sample(s).select("meeting_id", "overview", "sample", "samples")


@query("""WITH m AS (SELECT id, projectId, min(date) date FROM meetings WHERE projectId IS NOT NULL GROUP BY 1, 2), p AS (SELECT meeting_id, min(summary.overview) o, min(summary.title) t FROM protocol GROUP BY 1)
SELECT projectId, arg_min_null(t, id) title, coalesce(string_agg(trim(o), ' ' ORDER BY id), '') overview FROM m JOIN p ON p.meeting_id = m.id GROUP BY 1""")
def project_overviews(spark, d):
    """The overviews of a project's meetings put together."""
    m = table(spark, d, "meetings").where("projectId IS NOT NULL").select("id", "projectId").distinct()
    p = table(spark, d, "protocol").groupBy("meeting_id").agg(F.min("summary.overview").alias("overview"), F.min("summary.title").alias("title"))
    j = m.join(p, m.id == p.meeting_id).select(F.col("projectId").alias("meeting_id"), F.col("id").alias("sample"), "title", "overview")
    return minutes.joined_pieces(j).withColumnRenamed("meeting_id", "projectId")


@query(f"""WITH {_PR}, l AS (SELECT meeting_id, summary.title t, nullif(summary.overview, '') o, list_transform(list_filter(coalesce(participants, []), lambda x: NOT {JUNK.format('x')}), lambda x: '- ' || x) p,
list_transform(list_filter(coalesce(topics, []), lambda x: x IS NOT NULL AND NOT {JUNK.format('x.title')} AND NOT {JUNK.format('x.narrative')}), lambda x: '* ' || x.title || ': ' || x.narrative) k, list_transform(list_filter(coalesce(decisions, []), lambda x: NOT {JUNK.format('x')}), lambda x: '- ' || x) c FROM pr)
SELECT meeting_id, concat_ws(chr(10) || chr(10), t, o, CASE WHEN len(p) > 0 THEN 'Участники:' || chr(10) || array_to_string(p, chr(10)) END, CASE WHEN len(k) > 0 THEN 'Темы:' || chr(10) || array_to_string(k, chr(10)) END, CASE WHEN len(c) > 0 THEN 'Решения:' || chr(10) || array_to_string(c, chr(10)) END) report FROM l""")
def reports(spark, d):
    """The minutes as text."""
    p = _protocol(spark, d).select("meeting_id", F.col("summary.title").alias("title"), F.col("summary.overview").alias("overview"), "participants", "topics", "decisions")
    return minutes.report(p)


# ---- scoring


_SCORE = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce({0}, '')), 'ё', 'е'), '(?m)^[^\n:]{{1,32}}:\s', '', 'g'), '[^a-zа-я0-9\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


#: The SQL side's distance counts bytes, so its letters are made one byte each.
_ASCII = "translate({0}, 'абвгдежзийклмнопрстуфхцчшщъыьэюя', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&@')"


@query(f"""WITH {PH}, f AS (SELECT meeting_id, pos, text, lead(text) OVER (PARTITION BY meeting_id ORDER BY pos) nxt FROM ph), s AS (SELECT meeting_id, pos, {_SCORE.format('text')} a, {_SCORE.format("trim(regexp_replace(coalesce(text, ''), '[(\\[<{{*][^)\\]>}}*]*[)\\]>}}*]', '', 'g'))")} b FROM f)
SELECT meeting_id, pos, levenshtein({_ASCII.format('a')}, {_ASCII.format('b')}) errors, length(a) AS size, round(CASE WHEN length(a) > 0 THEN levenshtein({_ASCII.format('a')}, {_ASCII.format('b')}) / length(a) WHEN length(b) = 0 THEN 0.0 ELSE 1.0 END, 6) cer FROM (SELECT meeting_id, pos, replace(a, ' ', '') a, replace(b, ' ', '') b FROM s)""")
def character_errors(spark, d):
    """Character errors of each phrase against itself without bracketed notes."""
    bare = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[(\[<{*][^)\]>}*]*[)\]>}*]", ""))
    a, b = scoring.characters(F.col("text")), scoring.characters(bare)
    e = scoring.character_errors(F.col("text"), bare)
    return _ph(spark, d).select("meeting_id", "pos", e.alias("errors"), F.length(a).cast("long").alias("size"), F.round(scoring.rate(e, F.length(a), F.length(b)), 6).alias("cer"))


@query()
def word_errors(spark, d):
    """Word errors of each phrase against itself without bracketed notes."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"[(\[<{*][^)\]>}*]*[)\]>}*]", "")
    p = _ph(spark, d).select("meeting_id", "pos", scoring.word_errors(F.col("text"), bare).alias("e"))
    return p.select("meeting_id", "pos", "e.*")


_RES = "r AS (SELECT model, caseId, run, min(werBefore) werBefore, min(werAfter) werAfter FROM results GROUP BY ALL), o AS (SELECT *, werAfter IS NOT NULL AND NOT isnan(werAfter) ok FROM r)"


def _results(spark, d):
    return table(spark, d, "results").groupBy("model", "caseId", "run").agg(F.min("werBefore").alias("werBefore"), F.min("werAfter").alias("werAfter"))


_PPM = "CAST(sum(TRY_CAST(round({0} * 1000000) AS BIGINT)) FILTER (ok AND NOT isnan({0})) // nullif(count({0}) FILTER (ok AND NOT isnan({0})), 0) AS BIGINT)"


@query(f"WITH {_RES} SELECT model, caseId, count(*) runs, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) scored, coalesce({_PPM.format('werBefore')}, 0) wer_before_ppm, coalesce({_PPM.format('werAfter')}, 0) wer_after_ppm FROM o GROUP BY 1, 2")
def case_averages(spark, d):
    """Averages per model and case."""
    return scoring.averages(_results(spark, d), ["model", "caseId"])


@query(f"WITH {_RES} SELECT model, caseId, count(*) runs, {_PPM.format('werAfter')} wer_after_ppm, CAST(grouping(model, caseId) AS INT) AS level FROM o GROUP BY ROLLUP (model, caseId)")
def rolled_up_scores(spark, d):
    """Averages per case, model and overall in one pass."""
    return scoring.rolled_up(_results(spark, d))


# ---- rest of the minutes


@query(f"""WITH {TASKS}, {_DECISIONS} SELECT meeting_id, decision FROM dc WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.meeting_id = dc.meeting_id AND lower(t.task)[1:50] = lower(decision)[1:50])""")
def unremoved_decisions(spark, d):
    """Decisions that don't begin like a task of the meeting."""
    dc = table(spark, d, "protocol").select(F.col("meeting_id").alias("grp"), F.explode("decisions").alias("text")).where("text IS NOT NULL").distinct()
    gone = _tasks(spark, d).select(F.col("meeting_id").alias("grp"), F.col("task").alias("text"))
    return minutes.without_removed(dc, gone).select(F.col("grp").alias("meeting_id"), F.col("text").alias("decision"))


@query("""WITH p AS (SELECT DISTINCT meeting_id, x AS name FROM (SELECT meeting_id, unnest(participants) x FROM protocol) WHERE x IS NOT NULL) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM speaker_drafts s WHERE s.meeting_id = p.meeting_id AND s.guessedName = p.name)""")
def unassigned_participants(spark, d):
    """Participants whom no speaker was taken for."""
    p = table(spark, d, "protocol").select("meeting_id", F.explode("participants").alias("name")).where("name IS NOT NULL").distinct()
    return p.join(table(spark, d, "speaker_drafts").select("meeting_id", F.col("guessedName").alias("name")), ["meeting_id", "name"], "left_anti")


@query(f"""WITH {PH} SELECT meeting_id, count(*) phrases, CAST(sum(CASE WHEN trim(regexp_replace(text, '{SP}+', ' ', 'g')) <> text THEN 1 ELSE 0 END) AS BIGINT) changed FROM ph GROUP BY 1""")
def changed_phrases(spark, d):
    """How many phrases the cleaning changes, per meeting."""
    p = _ph(spark, d)
    return p.groupBy("meeting_id").agg(F.count("*").alias("phrases"), F.sum((X.correct(F.col("text")) != F.col("text")).cast("long")).alias("changed")).withColumn("changed", F.coalesce("changed", F.lit(0)))


@query(f"""WITH {_RES}, m AS (SELECT coalesce(model, '-') m, count(*) runs, coalesce({_PPM.format('werAfter')}, 0) p FROM o GROUP BY model) SELECT '| model | runs | error |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(printf('| %s | %d | %.2f %% |', m, runs, p / 10000), chr(10) ORDER BY m) AS table FROM m""")
def score_table(spark, d):
    """Mean errors per model as a markdown table."""
    return minutes.score_table(scoring.averages(_results(spark, d), ["model"]))


@query()
def projects_by_name(spark, d):
    """Projects in the order of the Russian collation."""
    return audit.by_name(table(spark, d, "projects").select("id", "name").distinct(), "name")


@query("""WITH o AS (SELECT meeting_id grp, lower(trim(guessedName)) term, min(confidence) confidence, list_sort(list(DISTINCT guessedName)) variants FROM speaker_drafts WHERE trim(guessedName) <> '' GROUP BY 1, 2),
n AS (SELECT meeting_id grp, lower(trim(owner)) term, CAST(NULL AS VARCHAR) confidence, list_sort(list(DISTINCT owner)) variants FROM action_items WHERE trim(owner) <> '' GROUP BY 1, 2)
SELECT coalesce(o.grp, n.grp) grp, coalesce(o.term, n.term) term, o.confidence, CASE WHEN o.term IS NULL THEN n.variants WHEN n.term IS NULL THEN o.variants ELSE o.variants || list_filter(n.variants, lambda x: NOT list_contains(o.variants, x)) END variants FROM o FULL JOIN n ON o.grp = n.grp AND o.term = n.term""")
def merged_glossaries(spark, d):
    """Two glossaries of a meeting (guessed names, owners) put together: fields of the first stay, spellings are united."""
    side = lambda t, c, f: t.where(f"trim({c}) <> ''").groupBy(F.col("meeting_id").alias("grp"), F.lower(F.trim(c)).alias("term")).agg(f.alias("confidence"), F.array_sort(F.collect_set(c)).alias("variants"))
    old = side(table(spark, d, "speaker_drafts"), "guessedName", F.min("confidence"))
    new = side(table(spark, d, "action_items"), "owner", F.min(F.lit(None).cast("string")))
    return minutes.merged_terms(old, new, ["confidence"])


# ---- clustering and signals


_SEG = "s AS (SELECT label, vec_id, CAST(1 + vec_id % 20 AS DOUBLE) dur, embedding e FROM embeddings)"


def _segments(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.lit("all").alias("grp"), F.col("label"), F.col("vec_id").alias("seg"), (1 + F.col("vec_id") % 20).cast("double").alias("duration"), "embedding")


@query(f"""WITH {_SEG}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dur DESC, vec_id) k FROM s) WHERE k <= 10), u AS (SELECT label, CAST(unnest(range(0, 64)) AS INT) dim, CAST(unnest(e) AS DOUBLE) x FROM t),
m AS (SELECT label, dim, avg(x) x FROM u GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) + 1e-8 n FROM m GROUP BY 1) SELECT label, dim, round(x / n, 5) AS value FROM m JOIN n USING (label)""")
def voice_centroids(spark, d):
    """Mean voice of each label's longest segments."""
    c = clustering.centroids(_segments(spark, d))
    return c.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", "dim", F.round("x", 5).alias("value"))


@query()
def merged_voices(spark, d):
    """Labels after one round of merging nearest voices, and the small ones absorbed."""
    s = _segments(spark, d)
    c = materialise(clustering.centroids(s))
    m = materialise(clustering.merge_nearest(c, floor=0.2))
    a = clustering.absorbed_clusters(s, m, clustering.merged_centroids(c, m), least=500.0)
    return m.join(a, ["grp", "label"]).select("label", "merged", "absorbed")


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) e FROM embeddings), a AS (SELECT vec_id, e, list_sort(list_transform(e, lambda v: abs(v))) m FROM x)
SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda v: v * v)) / len(e)), 6) rms, round(list_max(m), 6) peak, round(len(list_filter(m, lambda v: v > 0.98)) / len(e), 6) clipped, round(len(list_filter(m, lambda v: v < 0.005)) / len(e), 6) silent,
round(20 * log10(greatest(m[CAST(floor(len(m) * 0.95) AS INT) + 1], 1e-6) / greatest(m[CAST(floor(len(m) * 0.2) AS INT) + 1], 1e-6)), 4) snr FROM a""")
def signal_statistics(spark, d):
    """Level, peak, clipping, silence and signal-to-noise ratio of sample arrays."""
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(audio.rms(e), 6).alias("rms"), F.round(audio.peak(e), 6).alias("peak"), F.round(audio.clipping_ratio(e), 6).alias("clipped"), F.round(audio.silence_ratio(e), 6).alias("silent"), F.round(audio.snr_db(e), 4).alias("snr")
    )


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) e FROM embeddings), a AS (SELECT vec_id, list_sort(list_transform(e, lambda v: abs(v))) m FROM x),
f AS (SELECT vec_id, len(list_filter(m, lambda v: v > 0.98)) / len(m) > 0.001 c, len(list_filter(m, lambda v: v < 0.005)) / len(m) > 0.8 s, 20 * log10(greatest(m[CAST(floor(len(m) * 0.95) AS INT) + 1], 1e-6) / greatest(m[CAST(floor(len(m) * 0.2) AS INT) + 1], 1e-6)) < 10 n, vec_id % 20 < 5 t, list_max(m) < 0.05 q FROM a)
SELECT vec_id, CASE WHEN CAST(c AS INT) + CAST(s AS INT) + CAST(n AS INT) + CAST(t AS INT) + CAST(q AS INT) >= 3 OR s OR q THEN 'poor' WHEN CAST(c AS INT) + CAST(s AS INT) + CAST(n AS INT) + CAST(t AS INT) + CAST(q AS INT) >= 2 OR n THEN 'fair' ELSE 'good' END quality FROM f""")
def quality_classes(spark, d):
    """The quality class of sample arrays (vec_id modulo 20 as their seconds)."""
    e = F.col("embedding")
    q = audio.quality_class(audio.clipping_ratio(e), audio.silence_ratio(e), audio.snr_db(e), F.col("vec_id") % 20, audio.peak(e))
    return table(spark, d, "embeddings").select("vec_id", q.alias("quality"))
