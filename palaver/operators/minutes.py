"""Minutes: votes on names, cleaned protocol fields, samples merged into one, report text, glossaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.functions import text as X
from palaver.session import materialise

HIGH = 0.7


def sane_strings(c: Column | str) -> Column:
    """An array of strings without junk; a null array is empty."""
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: ~X.is_junk(x))


def sane_topics(c: Column | str) -> Column:
    """Topics whose title and narrative both say something, as (title, narrative)."""
    empty = F.array().cast("array<struct<title:string,narrative:string>>")
    return F.coalesce(F.filter(c, lambda t: t.isNotNull() & ~X.is_junk(t["title"]) & ~X.is_junk(t["narrative"])), empty)


def sane_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that say something; owners and deadlines that don't become null."""
    clear = lambda c: F.when(~X.is_junk(F.col(c)), F.col(c)).alias(c)
    return tasks.where(~X.is_junk(F.col("task"))).select("meeting_id", "pos", clear("owner"), "task", clear("deadline"))


def lifted(top: Column, nested: Column) -> Column:
    """A list field of a record whose fields slipped into its summary: the nested list where the top one is missing or empty and the nested one is there."""
    return F.when((top.isNull() | (F.size(top) == 0)) & nested.isNotNull(), nested).otherwise(top)


def vote_shares(votes: DataFrame) -> DataFrame:
    """meeting_id, label, name_key, votes, total, share: votes per name of a label; a vote without a name counts in the total only.

    votes: meeting_id, label, name."""
    key = X.name_key(F.trim("name"))
    total = votes.groupBy("meeting_id", "label").agg(F.count("*").alias("total"))
    per = votes.withColumn("name_key", key).where("name_key <> ''").groupBy("meeting_id", "label", "name_key").agg(F.count("*").alias("votes"))
    return per.join(total, ["meeting_id", "label"]).withColumn("share", F.col("votes") / F.col("total"))


def assign_names(votes: DataFrame, roster: DataFrame) -> DataFrame:
    """meeting_id, label, name, votes, total, confidence, candidates: one name per label, by votes, each name as often as the roster has it.

    votes: meeting_id, label, name, seq (order of the votes). roster: meeting_id, name. A label stands for a name that none of its others outvotes; of equal ones for the one named
    first that has room. Labels go before others by their share, then votes, then order. A first name that the roster has once becomes the full
    name; one that it has several times keeps the candidates and low confidence. Labels ask for their names in rounds, and every round each name keeps its first labels: a window per
    name of a meeting, until no label that was turned away has another name to ask for (two rounds or so: one for each equal name)."""
    v = votes.withColumn("key", X.name_key(F.trim("name")))
    labels = v.groupBy("meeting_id", "label").agg(F.count("*").alias("total"), F.min("seq").alias("lseq"))
    named = v.where("key <> ''").groupBy("meeting_id", "label", "key").agg(F.count("*").alias("votes"), F.min_by(F.trim("name"), "seq").alias("said"), F.min("seq").alias("cseq"))
    people = roster.where("trim(name) <> ''").select("meeting_id", F.trim("name").alias("full")).withColumn("key", X.name_key(F.col("full"))).groupBy("meeting_id", "key").agg(F.max("full").alias("full"))
    by_first = people.groupBy("meeting_id", F.element_at(F.split("key", r"\s+"), 1).alias("key")).agg(F.sort_array(F.collect_list("full")).alias("namesakes"))
    of_label = W.partitionBy("meeting_id", "label")
    asks = named.withColumn("_most", F.max("votes").over(of_label)).where("votes = _most").drop("_most").withColumn("turn", F.row_number().over(of_label.orderBy("cseq", "key")))
    asks = asks.join(people, ["meeting_id", "key"], "left").join(by_first, ["meeting_id", "key"], "left").join(labels, ["meeting_id", "label"])
    may = F.when(F.col("full").isNotNull(), F.array("full")).otherwise(F.coalesce("namesakes", F.array().cast("array<string>")))
    asks = materialise(asks.withColumn("may", may).withColumn("room", F.greatest(F.size("may"), F.lit(1))).drop("full", "namesakes"))
    queue = W.partitionBy("meeting_id", "key").orderBy(F.desc(F.col("votes") / F.col("total")), F.desc("votes"), "lseq", "label")
    at = asks.select("meeting_id", "label").distinct().withColumn("turn", F.lit(1))
    while True:
        asked = materialise(asks.join(at, ["meeting_id", "label", "turn"]).withColumn("kept", F.row_number().over(queue) <= F.col("room")))
        away = asked.where("NOT kept").select("meeting_id", "label", F.col("turn") + 1).toDF("meeting_id", "label", "turn").join(asks, ["meeting_id", "label", "turn"], "left_semi")
        if away.isEmpty():
            break
        at = materialise(at.join(away.withColumnRenamed("turn", "_next"), ["meeting_id", "label"], "left").select("meeting_id", "label", F.coalesce("_next", "turn").alias("turn")))
    won = asked.where("kept").select("meeting_id", "label", "said", "votes", "may")
    out = labels.join(won, ["meeting_id", "label"], "left")
    sure = (F.col("votes") >= HIGH * F.col("total")) & (F.size("may") < 2)
    return out.select(
        "meeting_id", "label", F.when(F.size("may") == 1, F.col("may")[0]).otherwise(F.col("said")).alias("name"), F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), "total",
        F.when(F.coalesce(sure, F.lit(False)), "high").otherwise("low").alias("confidence"), F.when(F.size("may") > 1, F.col("may")).alias("candidates"),
    )


def confirmation_summary(pairs: DataFrame) -> DataFrame:
    """Per meeting: how many names were proposed, and agreed to, changed, filled in or cleared. pairs: meeting_id, proposed, confirmed."""
    p, c = (F.nullif(X.name_key(F.trim(x)), F.lit("")) for x in ("proposed", "confirmed"))
    n = lambda cond: F.sum(cond.cast("int")).alias
    both = p.isNotNull() & c.isNotNull()
    return pairs.groupBy("meeting_id").agg(n(p.isNotNull())("proposed"), n(both & (p == c))("agreed"), n(both & (p != c))("changed"), n(p.isNull() & c.isNotNull())("filled"), n(p.isNotNull() & c.isNull())("cleared"))


def best_sample(samples: DataFrame) -> DataFrame:
    """Per meeting the title, overview and sample number of the longest overview (ties: the earliest sample). samples: meeting_id, sample, title, overview."""
    order = F.struct(F.length(F.coalesce("overview", F.lit(""))), -F.col("sample"))
    return samples.groupBy("meeting_id").agg(F.max_by(F.struct("title", "overview", "sample"), order).alias("b"), F.count("*").alias("samples")).select("meeting_id", "b.title", "b.overview", "b.sample", "samples")


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces of one meeting put together: the first title, the overviews joined by spaces in order. pieces: meeting_id, sample, title, overview."""
    o = F.array_sort(F.collect_list(F.struct("sample", F.trim("overview").alias("o"))))
    return pieces.groupBy("meeting_id").agg(F.min_by("title", "sample").alias("title"), F.array_join(F.transform(o, lambda s: s["o"]), " ").alias("overview"))


def report(protocol: DataFrame) -> DataFrame:
    """meeting_id, report: the minutes as text, sections in fixed order, empty ones left out. protocol: meeting_id, title, overview, participants, topics, decisions."""
    part = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.lit(head + "\n"), F.array_join(lines, "\n")))
    topics = F.transform(sane_topics("topics"), lambda t: F.concat(F.lit("* "), t["title"], F.lit(": "), t["narrative"]))
    bullets = lambda c: F.transform(sane_strings(c), lambda s: F.concat(F.lit("- "), s))
    return protocol.select(
        "meeting_id",
        F.concat_ws("\n\n", "title", F.nullif("overview", F.lit("")), part("Участники:", bullets("participants")), part("Темы:", topics), part("Решения:", bullets("decisions"))).alias("report"),
    )


def merged_glossary(old: DataFrame, new: DataFrame) -> DataFrame:
    """grp, term, variants: terms of both, the variants of a term united in first-seen order (the old ones first). old, new: grp, term, variants."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1))).select("grp", "term", "_o", F.posexplode_outer("variants").alias("_p", "v"))
    v = both.groupBy("grp", "term", "v").agg(F.min(F.struct("_o", "_p")).alias("k"))
    return v.groupBy("grp", "term").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("k", "v")))), lambda s: s["v"]).alias("variants"))


def merged_terms(old: DataFrame, new: DataFrame, scalars: list[str]) -> DataFrame:
    """grp, term, variants and the scalar fields of both glossaries: of a term that both have the old fields stay (also where they are null), and the variants are united as in merged_glossary()."""
    fields = old.select("grp", "term", *scalars, F.lit(0).alias("_o")).unionByName(new.select("grp", "term", *scalars, F.lit(1).alias("_o")))
    one = fields.groupBy("grp", "term").agg(F.min_by(F.struct(*scalars), F.struct("_o", *scalars)).alias("f")).select("grp", "term", *(F.col(f"f.{c}").alias(c) for c in scalars))
    return one.join(merged_glossary(old.select("grp", "term", "variants"), new.select("grp", "term", "variants")), ["grp", "term"])


def merged_abbreviations(old: DataFrame, new: DataFrame) -> DataFrame:
    """grp, abbreviation, meaning of both; a new meaning replaces an old one."""
    return new.unionByName(old.join(new.select("grp", "abbreviation"), ["grp", "abbreviation"], "left_anti"))


def merged_samples(samples: DataFrame, lists: DataFrame) -> DataFrame:
    """meeting_id, title, overview, topics of the sample with the longest overview (ties: the earliest), and items: the lists of all samples, flattened in the order of the samples, without those that resemble an earlier one.

    samples: meeting_id, sample, title, overview, topics; lists: meeting_id, sample, pos, item."""
    from palaver.operators.ordered import with_running_sum
    from palaver.operators.similarity import greedy_dedup

    order = F.struct(F.length(F.coalesce("overview", F.lit(""))), -F.col("sample"))
    best = samples.groupBy("meeting_id").agg(F.max_by(F.struct("title", "overview", "topics"), order).alias("b")).select("meeting_id", "b.*")
    flat = with_running_sum(lists.withColumn("_place", F.col("sample").cast("long") * 2**32 + F.col("pos")), ["meeting_id"], "_place", F.lit(1), "id")
    kept = greedy_dedup(flat.select(F.col("meeting_id").alias("grp"), F.col("id").alias("pos"), F.col("item").alias("text"))).select(F.col("grp").alias("meeting_id"), F.col("pos").alias("id"))
    items = flat.join(kept, ["meeting_id", "id"]).groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda s: s["item"]).alias("items"))
    return best.join(items, "meeting_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def previous_meeting(meetings: DataFrame) -> DataFrame:
    """meeting_id, previous_id: the latest earlier finished meeting of the same project, by (updatedAt, id). meetings: id, projectId, status, updatedAt.

    As-of within months: a window looks back inside a project's month, and what it doesn't find comes from the last finished meeting of the
    months before, so that a project with most of the meetings is spread over its months."""
    m = meetings.where("projectId IS NOT NULL").select("id", "projectId", "status", "updatedAt").withColumn("_m", F.date_format("updatedAt", "yyyy-MM"))
    done = F.when(F.col("status") == "done", F.col("id"))
    inner = W.partitionBy("projectId", "_m").orderBy("updatedAt", "id").rowsBetween(W.unboundedPreceding, -1)
    last = m.groupBy("projectId", "_m").agg(F.max_by("id", F.when(F.col("status") == "done", F.struct("updatedAt", "id"))).alias("_last"))
    before = last.select("projectId", "_m", F.last("_last", True).over(W.partitionBy("projectId").orderBy("_m").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    d = m.withColumn("_p", F.last(done, True).over(inner)).join(before, ["projectId", "_m"], "left")
    return d.select(F.col("id").alias("meeting_id"), F.coalesce("_p", "_before").alias("previous_id"))


def usable_samples(votes: DataFrame) -> DataFrame:
    """Votes without those of samples that are nothing but fallbacks, unless a meeting has no other. votes: meeting_id, sample, reasoning, ..."""
    bad = votes.groupBy("meeting_id", "sample").agg(F.min((F.coalesce("reasoning", F.lit("")) == "fallback").cast("int")).alias("_bad"))
    some = bad.groupBy("meeting_id").agg(F.min("_bad").alias("_all"))
    d = votes.join(bad, ["meeting_id", "sample"]).join(some, "meeting_id")
    return d.where("_bad = 0 OR _all = 1").drop("_bad", "_all")


def without_removed(items: DataFrame, removals: DataFrame, length: int = 50) -> DataFrame:
    """Items (grp, text) whose lower-cased beginning is none of the group's removals' (grp, text)."""
    head = lambda c: F.substring(F.lower(c), 1, length)
    gone = removals.where("text IS NOT NULL").select("grp", head("text").alias("_h")).distinct()
    return items.withColumn("_h", head("text")).join(gone, ["grp", "_h"], "left_anti").drop("_h")


def kept_highlights(quotes: DataFrame, most: int = 5) -> DataFrame:
    """grp, pos of the first ``most`` quotes of a group after dropping blank ones and, within a speaker, those that resemble an earlier one.

    quotes: grp, pos, speaker, quote; a speaker that is a placeholder is no speaker."""
    from palaver.operators.similarity import greedy_dedup

    q = quotes.where("trim(quote) <> ''").withColumn("who", F.when(~X.is_junk(F.col("speaker")), X.name_key(F.col("speaker"))))
    q = q.withColumn("g2", F.to_json(F.array("grp", F.coalesce("who", F.lit("\u0000")))))
    kept = greedy_dedup(q.select(F.col("g2").alias("grp"), "pos", F.col("quote").alias("text"))).withColumnRenamed("grp", "g2")
    d = q.select("grp", "g2", "pos").join(kept, ["g2", "pos"])
    return d.withColumn("k", F.row_number().over(W.partitionBy("grp").orderBy("pos"))).where(F.col("k") <= most).select("grp", "pos")


def score_table(scores: DataFrame) -> DataFrame:
    """One row, table: a markdown table of model, runs and mean error, by model. scores: model, runs, wer_after_ppm; a row per model."""
    line = F.format_string("| %s | %d | %.2f %% |", F.coalesce("model", F.lit("-")), F.col("runs"), F.col("wer_after_ppm") / 10_000)
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("model", F.lit("-")).alias("m"), line.alias("l")))), lambda s: s["l"]), "\n")
    return scores.agg(F.concat(F.lit("| model | runs | error |\n|---|---|---|\n"), rows).alias("table"))
