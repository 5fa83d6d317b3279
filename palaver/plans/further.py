"""Queries of the operators that the main flows use only in passing, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import text as X
from palaver.operators import attribution, audio, audit, clustering, minutes, phrases
from palaver.plans.reference import JUNK, PH, TASKS, _ph, _segments, _tasks
from palaver.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_VOICES = "c AS (SELECT label, CAST(sum(1 + vec_id % 20) AS DOUBLE) total FROM embeddings GROUP BY 1)"


@query(f"WITH {_VOICES} SELECT label, total FROM c")
def voice_times(spark, d):
    """Speech of every label over all segments."""
    return clustering.total_durations(_segments(spark, d)).select("label", "total")


@query(f"""WITH {PH}, {_VOICES}, l AS (SELECT meeting_id, speakerId, CAST(speakerTag AS INT) tag, pos FROM ph WHERE TRY_CAST(speakerTag AS INT) IS NOT NULL AND speakerId IS NOT NULL), o AS (SELECT meeting_id || '/' || speakerId original_id, arg_max(tag, pos) tag FROM l GROUP BY 1),
r AS (SELECT DISTINCT meeting_id || '/' || id original_id, meeting_id || '/' || guessedName final_id FROM speaker_drafts WHERE guessedName IS NOT NULL AND id IS NOT NULL)
SELECT DISTINCT final_id, total FROM o JOIN r USING (original_id) JOIN c ON c.label = o.tag""")
def voices_of_names(spark, d):
    """What is known of the voice (here its speech over all segments) of every confirmed name: from the label last used for a speaker, by the speaker's final name."""
    p = _ph(spark, d).where("speakerId IS NOT NULL").select(F.concat_ws("/", "meeting_id", "speakerId").alias("original_id"), F.col("speakerTag").try_cast("int").alias("label"), "pos").where("label IS NOT NULL")
    s = table(spark, d, "speaker_drafts").where("guessedName IS NOT NULL AND id IS NOT NULL")
    names = s.select(F.concat_ws("/", "meeting_id", "id").alias("original_id"), F.concat_ws("/", "meeting_id", "guessedName").alias("final_id")).distinct()
    v = clustering.total_durations(_segments(spark, d)).select("label", F.col("total").alias("embedding"))
    return attribution.voice_map(p, names, v).select("final_id", F.col("embedding").alias("total")).distinct()


@query("SELECT meeting_id, id, label, guessedName FROM speaker_drafts s WHERE confidence IS DISTINCT FROM 'low' OR NOT EXISTS (SELECT 1 FROM speaker_drafts o WHERE o.meeting_id = s.meeting_id AND o.confidence IS DISTINCT FROM 'low' )")
def usable_drafts(spark, d):
    """Drafts without samples (here confidences) that are nothing but fallbacks, unless a meeting has no others."""
    s = table(spark, d, "speaker_drafts").where("meeting_id IS NOT NULL")
    v = s.select("meeting_id", "id", "label", "guessedName", F.coalesce("confidence", F.lit("-")).alias("sample"), F.when(F.col("confidence") == "low", "fallback").alias("reasoning"))
    return minutes.usable_samples(v).select("meeting_id", "id", "label", "guessedName")


_LISTS = "SELECT meeting_id, min(participants) participants, min(decisions) decisions FROM protocol GROUP BY 1"


@query(f"WITH p AS ({_LISTS}) SELECT meeting_id, len(CASE WHEN (decisions IS NULL OR len(decisions) = 0) AND participants IS NOT NULL THEN participants ELSE decisions END) n FROM p")
def lifted_lists(spark, d):
    """Decisions, or where there are none the list beside them (here the participants)."""
    p = table(spark, d, "protocol").groupBy("meeting_id").agg(F.min("participants").alias("participants"), F.min("decisions").alias("decisions"))
    n = minutes.lifted(F.col("decisions"), F.col("participants"))
    return p.select("meeting_id", F.when(n.isNotNull(), F.size(n)).cast("long").alias("n"))


@query("SELECT meeting_id, 'owner' src, owner AS name FROM action_items UNION ALL SELECT meeting_id, 'draft', guessedName FROM speaker_drafts UNION ALL SELECT meeting_id, 'participant', unnest(participants) FROM protocol")
def mentioned_names(spark, d):
    """All names of the three lists together."""
    a = table(spark, d, "action_items").select("meeting_id", F.lit("owner").alias("src"), F.col("owner").alias("name"))
    s = table(spark, d, "speaker_drafts").select(F.lit("draft").alias("src"), "meeting_id", F.col("guessedName").alias("name"))
    p = table(spark, d, "protocol").select(F.explode("participants").alias("name"), "meeting_id", F.lit("participant").alias("src"))
    return audit.union_lists([a, s, p])


@query("SELECT DISTINCT meeting_id, label, guessedName AS name FROM speaker_drafts WHERE meeting_id NOT IN (SELECT meeting_id FROM action_items WHERE meeting_id IS NOT NULL) AND meeting_id IS NOT NULL UNION ALL SELECT DISTINCT meeting_id, 'owner', owner FROM action_items WHERE meeting_id IS NOT NULL")
def replaced_samples(spark, d):
    """Samples of a meeting replaced as a whole by newer ones where there are any."""
    old = table(spark, d, "speaker_drafts").where("meeting_id IS NOT NULL").select("meeting_id", "label", F.col("guessedName").alias("name")).distinct()
    new = table(spark, d, "action_items").where("meeting_id IS NOT NULL").select("meeting_id", F.lit("owner").alias("label"), F.col("owner").alias("name")).distinct()
    return audit.replaced(old, new, "meeting_id")


@query("SELECT DISTINCT id, status FROM meetings WHERE id NOT IN (SELECT id FROM meetings WHERE deletedAt IS NOT NULL)")
def living_meetings(spark, d):
    """Saves of meetings without a tombstone."""
    m = table(spark, d, "meetings")
    return audit.without_deleted(m.select("id", "status").distinct(), m.where("deletedAt IS NOT NULL").select("id"), "id")


@query("SELECT DISTINCT guessedName AS name, upper(trim(guessedName)[1]) initials FROM speaker_drafts WHERE guessedName IS NOT NULL")
def name_initials(spark, d):
    """What an avatar shows for a name."""
    n = table(spark, d, "speaker_drafts").where("guessedName IS NOT NULL").select(F.col("guessedName").alias("name")).distinct()
    return n.select("name", X.initials(F.col("name")).alias("initials"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) a, list_transform(list_reverse(embedding), lambda v: CAST(v AS DOUBLE)) b FROM embeddings), m AS (SELECT vec_id, list_transform(range(1, len(a) + 1), lambda i: (a[i] + b[i]) / 2) m FROM e),
g AS (SELECT vec_id, m, least(8.0, 0.1 / greatest(sqrt(list_sum(list_transform(m, lambda v: v * v)) / len(m)), 1e-9)) g FROM m)
SELECT vec_id, round(list_max(list_transform(m, lambda v: greatest(-1.0, least(1.0, v * g)))), 6) top, round(list_sum(list_transform(m, lambda v: abs(greatest(-1.0, least(1.0, v * g))))), 4) whole FROM g""")
def mixed_down(spark, d):
    """Two channels (a signal and itself backwards) mixed down and brought to a level."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    m = audio.mono(F.array(e, F.reverse(e)))
    t = table(spark, d, "embeddings").select("vec_id", audio.gained(m).alias("s"))
    return t.select("vec_id", F.round(F.array_max("s"), 6).alias("top"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + F.abs(x)), 4).alias("whole"))


@query(f"""WITH {TASKS}, q AS (SELECT meeting_id, pos, task, CASE WHEN NOT {JUNK.format('owner')} THEN replace(lower(owner), 'ё', 'е') END who FROM t WHERE trim(task) <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, who, task ORDER BY pos) c FROM q)
SELECT meeting_id, count(*) tasks, count(DISTINCT (who, task)) different FROM k GROUP BY 1""")
def told_tasks(spark, d):
    """Tasks that say something, per meeting, and how many different ones of one owner there are."""
    t = _tasks(spark, d).where("trim(task) <> ''").withColumn("who", F.when(~X.is_junk(F.col("owner")), X.name_key(F.col("owner"))))
    return t.groupBy("meeting_id").agg(F.count("*").alias("tasks"), F.size(F.collect_set(F.struct("who", "task"))).cast("long").alias("different"))


@query(f"""WITH {PH}, s AS (SELECT meeting_id, speakerId, CAST(sum(len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> ''))) AS BIGINT) words, min(pos) first_pos FROM ph WHERE speakerId IS NOT NULL GROUP BY 1, 2),
k AS (SELECT meeting_id, speakerId, row_number() OVER (PARTITION BY meeting_id ORDER BY words DESC, first_pos) k FROM s)
SELECT meeting_id, 'speaker-' || k original_id, 'speaker-' || k speaker_id FROM k""")
def ranked_again(spark, d):
    """Speakers renumbered by words twice: the second time changes nothing."""
    p = _ph(spark, d)
    once = phrases.ranked_speakers(p).select("meeting_id", F.col("original_id").alias("speakerId"), "speaker_id")
    q = p.join(once, ["meeting_id", "speakerId"]).withColumn("speakerId", F.col("speaker_id")).select(*p.columns)
    return phrases.ranked_speakers(q).select("meeting_id", "original_id", "speaker_id")
