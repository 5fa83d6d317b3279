"""Speech transcripts into clean speaker turns.

1. Phrases are brought together in blocks of pos of a meeting, once. Repeated rows of a phrase count once. A phrase's time is its start as stored, else the time written at
   the start of its text, else the time of the phrase before it by pos (0 for the first); what a block needs from the blocks before it comes from a table with a row per block.
2. A phrase with an id has that speaker. All others go through a hidden Markov model of their meeting. Its states are the participants (the ids; labels that never stand beside an
   id; the labels alone where the meeting has no ids), its transitions are counted from known neighbours, and a phrase's emission is its likelihood under the
   participant's language profile (smoothed counts of hashed words) together with what its label stands for: the votes of the phrases that have both (labels are compared without their
   many spellings), weighted so that a label that always stood for one speaker decides. Phrases with an id pin the best path, so each stretch between two of them is solved by itself,
   exactly, wherever the borders of blocks are. A stretch of more than BLOCK places is solved in pieces that see LAG places beyond their ends.
3. Recording residue is removed; a phrase of nothing but times, sound notes, hesitation sounds and noise markers is dropped.
4. Phrases are range-partitioned by meeting, time and pos, so a meeting with a third of all rows is spread over many tasks; each task finds its runs of
   one speaker, and runs that touch across a border are joined by a window over the border runs only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palaver.session import materialise, shuffle_partitions

BLOCK, LAG = 4096, 256
BUCKETS = 128
#: Weight of what a label stands for against the language and the transitions, and the votes that a label has for everyone beforehand.
LABEL, DOUBT = 10.0, 1e-300
#: The noise markers, and words of sound notes in round brackets.
MARKERS = "угу ага эм эээ ну вот это так".split()
NOTES = "смех смеется смеётся кашель аплодисменты музыка шум помехи пауза неразборчиво нрзб тишина звонок телефона стук вздох вздыхает плач шепот шёпот гудок сигнал".split()

_TIME = r"(\d{1,2}):(\d\d):(\d\d)"
_LABEL = r"(?iu)(?:\[?\s*(?:[сc]п[иu]к[еe][рp]|[sс]peaker|сп|спк)\s*\.?[\s_№-]*\d+\s*\]?(?:\s*\([^)]*\))?\s*:+\s*)"
_NOTE = r"(?iu)\(\([^)]*\)\)|\[[^\]\d]*\]|<[^>\d]*>|\{[^}]*\}|\*[^*\n\d]{1,40}\*|[♪♫♬]+|\((?:\s*(?:" + "|".join(NOTES) + r")\s*)+\)"
_STAMP = r"[\[(<]\s*\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?\s*[\])>]"
_BARE = r"^\s*\d{1,2}:\d\d:\d\d(?:[.,]\d+)?\s*[—–-]?\s*"
_SOUND = r"(?iu)(?<![\p{L}\d-])(?:э+м*|э+(?:-э+)+м*|м+(?:-м+)+|м{2,}|э-э|хм+|гм+|умм+|а+(?:-а+)+|у+(?:-у+)+)(?![\p{L}\d-])"


def _spaces(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[\u200b\u200c\u200d\u2060\ufeff\u00ad]", ""), r"[\s\u00a0\u2007\u202f]+", " ")


#: What every text holds that cleaning changes.
_DIRTY = (
    r"(?iu)[\[({<*♪♫♬\x{200b}-\x{200d}\x{2060}\x{feff}\x{ad}\x{a0}\x{2007}\x{202f}\t\n\r\f\x0b]|\s\s|^\s|\s$|\d:\d\d|\s[,.!?;:…]|,\s*,|^[,.;:!?…—–-]"
    r"|(?<![\p{L}\d-])(?:э(?:э|м|-|(?!\p{L}))|мм|м-|хм|гм|умм|а-|аа|у-|уу|(?:[сc]п[иu]к|сп\.|сп\s|спк|[sс]peaker)[^:]{0,40}:)"
)


def clean_text(c: Column | str) -> Column:
    """The text without sound notes, bracketed or leading times, a leading speaker label, hesitation sounds and doubled spaces; null stays null.

    One look tells the many texts that hold nothing of the kind; only the others go through the replacements."""
    t = F.col(c) if isinstance(c, str) else c
    return F.when(t.rlike(_DIRTY), _cleaned(t)).otherwise(t)


def _cleaned(t: Column) -> Column:
    t = _spaces(t)
    t = F.regexp_replace(t, _NOTE, " ")
    t = F.regexp_replace(t, _STAMP, " ")
    for _ in range(2):
        t = F.regexp_replace(t, _BARE, " ")
        t = F.regexp_replace(t, r"^\s*" + _LABEL, " ")
    t = F.regexp_replace(t, r"(?iu),?\s*(?<![\p{L}\d-])э{2,}м*(?![\p{L}\d-]),?", " ")
    t = F.regexp_replace(t, _SOUND, " ")
    t = F.regexp_replace(t, r"\s+([,.!?;:…])", "$1")
    t = F.regexp_replace(t, r",(?:\s*,)+", ",")
    t = F.regexp_replace(t, r"^[\s,.;:!?…—–-]+", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


_NOTHING = (
    r"(?iu)^(?:\s*+" + _LABEL[len("(?iu)") :] + r")?+(?:"
    + r"\(\([^)]*+\)\)|\[[^\]]*+\]|<[^>]*+>|\{[^}]*+\}|\*[^*\n\p{N}]{1,40}+\*|\((?:\s*+(?:" + "|".join(NOTES) + r")(?![\p{L}\p{N}])\s*+)++\)"
    + r"|\d{1,2}+:\d\d(?::\d\d)?+(?:[.,]\d++)?+(?!\d)"
    + r"|(?:э++м*+(?:-э++м*+)*+|м++(?:-м++)++|мм++|хм++|гм++|а++(?:-а++)++|у++(?:-у++)++|" + "|".join(MARKERS) + r")(?![\p{L}\p{N}])(?!-[\p{L}\p{N}])"
    + r"|[^\p{L}\p{N}])*+$"
)


def is_noise(c: Column | str) -> Column:
    """Whether a text is nothing but sound notes, times, hesitation sounds and noise markers (perhaps after a speaker label); null and empty texts are noise too.

    One possessive pattern over the raw text, which gives up at the first real word."""
    t = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.translate(t, "\u200b\u200c\u200d\u2060\ufeff\u00ad", "").rlike(_NOTHING), F.lit(True))


def written_time(c: Column | str) -> Column:
    """The time at the start of a text (h:mm:ss, bare or in brackets, perhaps after a speaker label) in milliseconds, or null."""
    t = F.col(c) if isinstance(c, str) else c
    rx = r"^\s*(?:" + _LABEL[len("(?iu)") :] + r")?\s*[\[(<]?\s*" + _TIME
    n = [F.regexp_extract(t, "(?iu)" + rx, i).try_cast("long") for i in (1, 2, 3)]
    return (n[0] * 3600 + n[1] * 60 + n[2]) * 1000


def label_key(c: Column | str) -> Column:
    """One key for all spellings of a label: n:7 for a numbered speaker, w:name for a name; null for a blank one."""
    t = F.col(c) if isinstance(c, str) else c
    num = F.regexp_extract(t, r"(\d+)", 1)
    word = F.translate(F.lower(F.regexp_replace(t, r"[\[\]():;.,\"«»]", " ")), "ё", "е")
    word = F.trim(F.regexp_replace(word, r"\s+", " "))
    return F.when(num != "", F.concat(F.lit("n:"), F.regexp_replace(num, "^0+(?=.)", ""))).when(word != "", F.concat(F.lit("w:"), word))


def _hashed(t: Column) -> Column:
    """The words of a text as a string of one ASCII sign each (their bucket)."""
    words = F.split(F.lower(F.nullif(t, F.lit(""))), " ")
    return F.coalesce(F.array_join(F.transform(words, lambda w: F.char(F.hash(w).bitwiseAND(F.lit(BUCKETS - 1)))), ""), F.lit(""))


def blocks(phrases: DataFrame, with_text: bool = False) -> DataFrame:
    """The phrases of every meeting, each once (of rows with the same meeting_id and pos the one that arrived first; ties: by a hash of the row), with

    t (the time that orders them), id, k, tag, inner, det (label keys), noise, w (hashed words), who (id or else label), prev (who of the phrase before that has one),
    pin, pin_pos (the id before, and its place), open (no id, or the first with an id after that) and, if asked for, clean. Nulls in meeting_id or pos drop a row."""
    label = F.col("speakerLabel")
    inner = F.when(label.rlike(r"\d"), F.nullif(F.regexp_extract(label, r"\(([^)\d]+)\)", 1), F.lit("")))
    cols = {
        "own": F.coalesce(F.col("startTimeMs").cast("long"), F.when(F.col("startTimeMs").isNull(), written_time("text"))),
        "id": F.col("speakerId"), "k": label_key(label), "tag": F.col("speakerTag"), "inner": label_key(inner), "det": label_key("detectedName"),
        "noise": is_noise("text"), "w": _hashed(F.col("text")),
    }
    cols |= {"clean": clean_text("text")} if with_text else {}
    arrived = F.coalesce(F.col("arrivedAt").cast("timestamp"), F.lit("9999-12-31").cast("timestamp"))
    p = phrases.where("meeting_id IS NOT NULL AND pos IS NOT NULL").select("meeting_id", F.col("pos").cast("int").alias("pos"), F.floor(F.col("pos") / BLOCK).alias("block"), arrived.alias("_a"), *(c.alias(n) for n, c in cols.items()))
    p = p.withColumn("_h", F.xxhash64(*cols))
    within = W.partitionBy("meeting_id", "block")
    p = p.withColumn("_p", F.lag("pos").over(within.orderBy("pos", "_a", "_h"))).where("_p IS NULL OR _p <> pos").drop("_a", "_h", "_p")
    p = p.withColumn("who", F.coalesce("id", F.concat(F.lit("label "), F.col("k"))))
    by = within.orderBy("pos")
    pin = F.when(F.col("id").isNotNull(), F.struct("id", "pos"))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    here = {
        "t": F.last("own", True).over(by.rowsBetween(W.unboundedPreceding, 0)), "_pin": F.last(pin, True).over(before), "prev": F.last("who", True).over(before),
        "open": F.col("id").isNull() | F.lag("id").over(by).isNull(),
    }
    p = p.withColumns(here).withColumns({"pin": F.col("_pin.id"), "pin_pos": F.col("_pin.pos")}).drop("_pin")
    return _carried(materialise(p))


def _carried(p: DataFrame) -> DataFrame:
    """What the phrases at the front of a block, before its first time, id or speaker, take over from the blocks before. These are few, so only they are joined."""
    lacks = (F.col("block") > 0) & (F.col("t").isNull() | F.col("pin_pos").isNull() | F.col("prev").isNull())
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("pos"))
    last = p.join(p.where(lacks).select("meeting_id").distinct(), "meeting_id", "left_semi").groupBy("meeting_id", "block").agg(
        F.max_by("own", at("own")).alias("t0"), F.max(at("id")).alias("pin_pos0"), F.max_by("id", at("id")).alias("pin0"), F.max_by("who", at("who")).alias("prev0")
    )
    upto = W.partitionBy("meeting_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    taken = ["t", "pin", "pin_pos", "prev"]
    last = last.select("meeting_id", "block", *(F.last(f"{c}0", True).over(upto).alias(f"{c}0") for c in taken))
    fronts = p.where(lacks).join(last, ["meeting_id", "block"], "left").withColumns({c: F.coalesce(c, f"{c}0") for c in taken})
    return p.where(~lacks).unionByName(materialise(fronts.select(*p.columns))).withColumn("t", F.coalesce("t", F.lit(0)))


def viterbi(emit: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best path: emit (phrases x states), start (states) and step (from x to), all logarithms."""
    n, s = emit.shape
    score, back = start + emit[0], np.zeros((n, s), int)
    for i in range(1, n):
        way = score[:, None] + step
        back[i] = way.argmax(0)
        score = way.max(0) + emit[i]
    path = np.empty(n, int)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


_MODEL = "meeting_id string, people array<string>, words binary, steps binary, keys array<string>, ids array<int>, votes array<long>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """meeting_id, who, prev, words, c: counts of hashed words per speaker (prev null) and of steps from one speaker to the next (words null), batch by batch."""
    for b in batches:
        if not b.num_rows:
            continue
        code = lambda c: pc.fill_null(b.column(c).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        m, who, prev = code("meeting_id"), code("who"), code("prev")
        _, first, group = np.unique(m * (len(who) + 1) + who, return_index=True, return_inverse=True)
        w = b.column("w")
        size = pc.binary_length(w).to_numpy(zero_copy_only=False)
        sign = np.frombuffer(b"".join(x.encode() for x in w.to_pylist()), np.uint8)
        words = np.bincount(np.repeat(group, size) * BUCKETS + sign, minlength=len(first) * BUCKETS).astype(np.int32).reshape(-1, BUCKETS)
        _, at, c = np.unique(np.where(prev < 0, -1, (group * (len(who) + 1)) + prev), return_index=True, return_counts=True)
        at, c = at[prev[at] >= 0], c[prev[at] >= 0]
        take = lambda n, i: b.column(n).take(pa.array(i))  # noqa: B023, E731
        names = ["meeting_id", "who", "prev", "words", "c"]
        yield pa.RecordBatch.from_arrays([take("meeting_id", first), take("who", first), pa.nulls(len(first), pa.string()), pa.array([x.tobytes() for x in words], pa.binary()), pa.array(np.bincount(group, minlength=len(first)))], names=names)
        yield pa.RecordBatch.from_arrays([take("meeting_id", at), take("who", at), take("prev", at), pa.nulls(len(at), pa.binary()), pa.array(c)], names=names)


def _model(parts: list[dict], seen: list[dict]) -> tuple:
    """people, log profiles, log steps and votes of one meeting."""
    ids = {x["id"] for x in seen if x["id"] is not None} | {x["who"] for x in parts if not x["who"].startswith("label ")}
    votes: dict[tuple[str, str], int] = {}
    for x in seen:
        who = x["id"] if ids else f"label {x['k']}" if (x["k"] or "").startswith("n:") else None
        if who is None:
            continue
        k, tag = x["k"], x["tag"]
        for key, c in ((f"lt|{k}|{tag}", 1000 * (k is not None and tag is not None)), (f"l|{k}", 1000 * (k is not None)), (f"l|{x['inner']}", int(x["inner"] is not None)), (f"l|{x['det']}", int(x["det"] is not None)), (f"t|{tag}", int(k is not None and tag is not None))):
            if c:
                votes[key, who] = votes.get((key, who), 0) + c * x["c"]
    known = {key for key, _ in votes}
    # a label that nothing else explains is a speaker of its own
    people = sorted({who for _, who in votes} | ids | {x["who"] for x in parts if x["who"].startswith("label ") and f"l|{x['who'][6:]}" not in known})
    at = {x: i for i, x in enumerate(people)}
    words, steps = np.full((len(people), BUCKETS), 0.1), np.full((len(people), len(people)), 0.5)
    for x in parts:
        if x["who"] in at:
            if x["words"] is not None:
                words[at[x["who"]]] += np.frombuffer(x["words"], np.int32)
            elif x["prev"] in at:
                steps[at[x["prev"]], at[x["who"]]] += x["c"]
    rows = sorted((k, at[i], c) for (k, i), c in votes.items())
    return people, np.log(words / words.sum(1, keepdims=True)).astype(np.float32).tobytes(), np.log(steps / steps.sum(1, keepdims=True)).astype(np.float32).tobytes(), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def models(p: DataFrame) -> DataFrame:
    """One row per meeting with phrases to decode: its participants, their language, the steps between them, and what its labels stand for. p: as of blocks().

    Counts are made batch by batch where the phrases lie, so a meeting with a third of all rows sends a few rows a batch."""
    parts = p.where("who IS NOT NULL").select("meeting_id", "who", "prev", "w").mapInArrow(_parts, "meeting_id string, who string, prev string, words binary, c long")
    parts = parts.groupBy("meeting_id").agg(F.collect_list(F.struct("who", "prev", "words", "c")).alias("parts"))
    seen = p.where("id IS NOT NULL OR k LIKE 'n:%'").groupBy("meeting_id", "id", "k", "tag", "inner", "det").agg(F.count("*").alias("c"))
    seen = seen.groupBy("meeting_id").agg(F.collect_list(F.struct("id", "k", "tag", "inner", "det", "c")).alias("seen"))

    schema = to_arrow_schema(StructType.fromDDL(_MODEL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                out = [(m, *_model(x or [], y or [])) for m, x, y in zip(*(part.column(c).to_pylist() for c in ("meeting_id", "parts", "seen")), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    open_ = p.where("id IS NULL").select("meeting_id").distinct()
    return parts.join(seen, "meeting_id", "full").join(open_, "meeting_id", "left_semi").mapInArrow(run, _MODEL)


class _Meeting:
    """The model of one meeting, ready to decode."""

    def __init__(self, r: dict):
        self.people = r["people"] or []
        s = len(self.people)
        self.at = {x: i for i, x in enumerate(self.people)}
        self.words = np.frombuffer(r["words"] or b"", np.float32).reshape(s, BUCKETS)
        self.steps = np.frombuffer(r["steps"] or b"", np.float32).reshape(s, s)
        self.votes: dict[str, np.ndarray] = {}
        for k, i, c in zip(r["keys"] or [], r["ids"] or [], r["votes"] or [], strict=True):
            self.votes.setdefault(k, np.zeros(s))[i] += c
        self.said: dict[tuple, np.ndarray] = {}

    def label(self, k: str | None, tag: str | None) -> np.ndarray | float:
        """The weighted logarithm of the shares of votes of a label and tag; 0 for a phrase without a label."""
        if k is None:
            return 0.0
        if (k, tag) not in self.said:
            v = next((v for key in ((f"lt|{k}|{tag}",) * (tag is not None) + (f"l|{k}",) + (f"t|{tag}",) * (tag is not None)) if (v := self.votes.get(key)) is not None), None)
            if v is None:
                v = np.zeros(len(self.people))
                if f"label {k}" in self.at:
                    v[self.at[f"label {k}"]] = 1
            self.said[k, tag] = LABEL * np.log((v + DOUBT) / (v + DOUBT).sum())
        return self.said[k, tag]

    def path(self, rows: list[dict], before: str | None) -> list[str | None]:
        """The speakers of a stretch of phrases without an id, perhaps with the one with an id that ends it."""
        if not self.people:
            return [None] * len(rows)
        s = len(self.people)
        start = self.steps[self.at[before]] if before in self.at else np.zeros(s)
        emit = np.zeros((len(rows), s))
        for i, x in enumerate(rows):
            if x["id"] is not None:
                emit[i] = -1e9
                emit[i, self.at[x["id"]]] = 0.0
            else:
                emit[i] = self.label(x["k"], x["tag"]) + self.words[:, np.frombuffer(x["w"].encode(), np.uint8)].sum(1)
        return [self.people[i] for i in viterbi(emit, start, self.steps)]


def decoded(p: DataFrame, keep: list[str]) -> DataFrame:
    """meeting_id, pos, keep, speaker of the phrases without an id: the best path through their meeting's model. p: as of blocks(). Where a meeting has neither an id nor a label, nobody (null)."""
    rest = F.col("pos") - F.coalesce(F.col("pin_pos"), F.lit(-1)) - 1
    piece, off = F.floor(rest / BLOCK), F.pmod(rest, F.lit(BLOCK))
    places = F.array(F.struct(piece.alias("piece"), F.lit(True).alias("own")), F.when((off < LAG) & (piece > 0), F.struct((piece - 1).alias("piece"), F.lit(False).alias("own"))), F.when(off >= BLOCK - LAG, F.struct((piece + 1).alias("piece"), F.lit(False).alias("own"))))
    rows = p.where("open").withColumn("place", F.explode(places)).where("place IS NOT NULL")
    row = ["pin_pos", "pos", "pin", "id", "k", "tag", "w", *keep]
    rows = rows.groupBy("meeting_id", F.floor(F.coalesce(F.col("pin_pos"), F.lit(-1)) / BLOCK).alias("chunk"), "place.piece").agg(F.collect_list(F.struct(*row, F.col("place.own").alias("own"))).alias("rows"))
    ddl = "meeting_id string, pos int, " + "".join(f"{c} {p.schema[c].dataType.simpleString()}, " for c in keep) + "speaker string"

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            for part in (b.slice(i, 16) for i in range(0, b.num_rows, 16)):
                out = []
                for r in part.to_pylist():
                    if last[0] != r["meeting_id"]:
                        last = (r["meeting_id"], _Meeting(r))
                    stretch: list[dict] = []
                    for x in [*sorted(r["rows"], key=lambda x: (x["pin_pos"] or -1, x["pos"])), None]:
                        if stretch and (x is None or x["pin_pos"] != stretch[0]["pin_pos"]):
                            who = last[1].path(stretch, stretch[0]["pin"] if r["piece"] == 0 else None)
                            out += [{"meeting_id": r["meeting_id"], "speaker": s, **y} for s, y in zip(who, stretch, strict=True) if y["own"] and y["id"] is None]
                            stretch = []
                        if x is not None:
                            stretch.append(x)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return materialise(rows.join(models(p).hint("merge"), "meeting_id", "left").mapInArrow(run, ddl))


def prepared(phrases: DataFrame, with_text: bool = False) -> DataFrame:
    """meeting_id, pos, t, noise, speaker and, if asked for, clean (the clean text) of every phrase."""
    p = blocks(phrases, with_text)
    keep = ["t", "noise", *(["clean"] if with_text else [])]
    return p.where("id IS NOT NULL").select("meeting_id", "pos", *keep, F.col("id").alias("speaker")).unionByName(decoded(p, keep))


def turns(rows: DataFrame) -> DataFrame:
    """meeting_id, speaker, first_pos, last_pos, phrases, from_ms and, if ``rows`` have clean texts, text (these joined by spaces).

    rows: as of prepared(). A turn is a longest run, in order of time and pos, of one speaker's phrases that aren't noise; phrases of which nobody
    knows the speaker (null) count as one speaker. Nulls in meeting_id or pos drop a row; an empty table gives no turns."""
    with_text = "clean" in rows.columns
    cols = ["meeting_id", "t", "pos", "speaker", *(["clean"] if with_text else [])]
    n = max(2, shuffle_partitions(rows.sparkSession))
    ordered = rows.where("NOT noise").select(*cols).repartitionByRange(n, "meeting_id", "t", "pos").sortWithinPartitions("meeting_id", "t", "pos")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["meeting_id", "speaker", "first_t", "first_pos", "last_t", "last_pos", "n", "edge", *(["text"] if with_text else [])]
        pending: list | None = None  # the run that may go on in the next batch
        first = True

        def row(m, s, t0, p0, t1, p1, k, texts):
            return [m, s, t0, p0, t1, p1, k, texts]

        def emit(rs: list, edges: list[bool]) -> pa.RecordBatch:
            cols = list(zip(*rs, strict=True))
            arrays = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:7]), pa.array(edges, pa.bool_())]
            if with_text:
                arrays.append(pa.array([" ".join(x) for x in cols[7]], pa.string()))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            if not b.num_rows:
                continue
            m, s = b.column("meeting_id"), b.column("speaker")
            mi = m.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            si = pc.fill_null(s.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            t, p = b.column("t").to_numpy(zero_copy_only=False), b.column("pos").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((mi[1:] != mi[:-1]) | (si[1:] != si[:-1])) + 1
            lo, hi = np.array([0, *cut]), np.array([*cut, b.num_rows])
            ms, ss = m.take(pa.array(lo)).to_pylist(), s.take(pa.array(lo)).to_pylist()
            texts = b.column("clean").to_pylist() if with_text else None
            out = []
            for i in range(len(lo)):
                a, z = int(lo[i]), int(hi[i])
                tx = texts[a:z] if with_text else []
                if pending is not None and pending[0] == ms[i] and pending[1] == ss[i]:
                    pending[4:7] = [int(t[z - 1]), int(p[z - 1]), pending[6] + z - a]
                    pending[7] += tx
                    continue
                if pending is not None:
                    out.append(pending)
                pending = row(ms[i], ss[i], int(t[a]), int(p[a]), int(t[z - 1]), int(p[z - 1]), z - a, tx)
            if out:
                yield emit(out, [first and i == 0 for i in range(len(out))])
                first = False
        if pending is not None:
            yield emit([pending], [True])

    ddl = "meeting_id string, speaker string, first_t long, first_pos long, last_t long, last_pos long, n long, edge boolean" + (", text string" if with_text else "")
    found = ordered.mapInArrow(runs, ddl)
    key = F.struct("first_t", "first_pos")
    # only a task's first and last run can go on elsewhere: the first and last run of each task are marked, and between marked runs of one speaker
    # that follow each other there is no other run if the number of runs between is 0, which the running number of the task's runs tells
    marked = found.withColumn("_task", F.spark_partition_id())
    out = ["meeting_id", "speaker", "first_pos", "last_pos", F.col("n").alias("phrases"), F.col("first_t").alias("from_ms"), *(["text"] if with_text else [])]
    inside = marked.where("NOT edge").select(*out)
    by = W.partitionBy("meeting_id").orderBy(key)
    edge = marked.where("edge").withColumn("_s", F.lag(F.struct("speaker", "_task")).over(by))
    new = F.col("_s").isNull() | ~F.col("_s.speaker").eqNullSafe(F.col("speaker")) | (F.col("_s._task") == F.col("_task"))
    edge = edge.withColumn("_run", F.sum(new.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    texts = [F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_t", "first_pos", "text"))), lambda x: x["text"]), " ").alias("text")] if with_text else []
    whole = edge.groupBy("meeting_id", "_run").agg(
        F.first("speaker").alias("speaker"), F.min_by("first_pos", key).alias("first_pos"), F.max_by("last_pos", F.struct("last_t", "last_pos")).alias("last_pos"), F.sum("n").alias("phrases"), F.min("first_t").alias("from_ms"), *texts
    )
    return inside.unionByName(whole.drop("_run")).withColumn("first_pos", F.col("first_pos").cast("int")).withColumn("last_pos", F.col("last_pos").cast("int"))
