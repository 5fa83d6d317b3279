"""Operators against brute force and literal vectors."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from palaver.operators import attribution, audio, audit, clustering, minutes, phrases, scoring, similarity

PH = "meeting_id string, pos int, speakerId string, speakerLabel string, speakerTag string, detectedName string, startTimeMs long, endTimeMs long, text string"


def ph(spark, rows):
    return spark.createDataFrame([("m", i, *r) for i, r in enumerate(rows)], PH)


def test_sessions(spark):
    rows = [(None, None, "0", None, 0, 1000, "а"), (None, None, "0", None, 2999, 3500, "б"), (None, None, "0", None, 5500, 6000, "в"), (None, None, "1", None, None, None, " "), (None, None, "0", None, None, 9, "г")]
    got = sorted(tuple(r) for r in phrases.sessions(ph(spark, rows)).select("first_pos", "n", "end_ms", "text").collect())
    assert got == [(0, 2, 3500, "а б"), (2, 1, 6000, "в"), (4, 1, 9, "г")]


def test_ranked_ties(spark):
    rows = [("A", None, None, None, 0, 1, "1 2 3 4 5"), ("B", None, None, None, 0, 1, "1 2 3 4 5 6 7 8 9"), ("C", None, None, None, 0, 1, "1 2 3 4 5"), (None, None, None, None, 0, 1, "x")]
    got = {r.original_id: r["rank"] for r in phrases.ranked_speakers(ph(spark, rows)).collect()}
    assert got == {"B": 1, "A": 2, "C": 3}


def test_chunks_hold_their_budget(spark):
    r = random.Random(2)
    rows = [(None, "S", None, None, 0, 1, "x" * r.randrange(1, 400)) for _ in range(200)] + [(None, "S", None, None, 0, 1, "y" * 900)]
    got = sorted((tuple(x) for x in phrases.packed_chunks(ph(spark, rows), budget=800).collect()), key=lambda x: x[1])
    sizes = [len(f"[{i + 1}] S: {t[6]}") for i, t in enumerate(rows)]
    want, cur = [], []
    for i, s in enumerate(sizes, 1):
        if cur and sum(sizes[j - 1] for j in cur) + s > 800:
            want.append(cur)
            cur = []
        cur.append(i)
    want.append(cur)
    assert [(x[2], x[3]) for x in got] == [(c[0], c[-1]) for c in want]
    assert [list(x[5]) for x in got][1:] == [c[-2:] for c in want[:-1]]


def test_overlap_attribution(spark):
    p = spark.createDataFrame([("m", 0, 0, 4000), ("m", 1, 4000, 5000), ("m", 2, 100_000, 170_000)], "meeting_id string, pos int, start_ms long, end_ms long")
    s = spark.createDataFrame([("m", 0, "A", 0, 1000), ("m", 1, "B", 1000, 3500), ("m", 2, "A", 3500, 4000), ("m", 3, "C", 100_000, 135_000), ("m", 4, "D", 135_000, 170_000)], "meeting_id string, seg int, speaker string, start_ms long, end_ms long")
    got = {r.pos: (r.speaker, r.overlap_ms) for r in attribution.overlap_attribution(p, s, fallback="SPEAKER_00").collect()}
    assert got == {0: ("B", 2500), 1: ("SPEAKER_00", 0), 2: ("C", 35_000)}


def test_refined_lines_apply_if_numbers_hold(spark):
    p = spark.createDataFrame([(1, "шаг двести"), (2, "до двадцатого июня"), (3, "так")], "id int, text string")
    r = spark.createDataFrame([(1, "Шаг 200."), (2, "До 21 июня.")], "id int, refined string")
    from palaver.functions import numbers

    got = {x.id: (x.status, x.result) for x in attribution.apply_refined(p, r, numbers.numbers_preserved(F.col("text"), F.col("refined"))).collect()}
    assert got == {1: ("applied", "Шаг 200."), 2: ("rejected", "до двадцатого июня"), 3: ("unchanged", "так")}


def test_confirmed_null_is_not_absent(spark):
    c = spark.createDataFrame([("m", "s1", "Артём"), ("m", "s2", "Настя"), ("m", "s3", "Вячеслав")], "meeting_id string, id string, confirmed string")
    s = spark.createDataFrame([("m", "s1", "Артём", "high", None, None, False), ("m", "s2", "Настя", "low", "Наталья", "low", True), ("m", "s3", "Слава", "low", None, "low", True)], "meeting_id string, id string, guessedName string, confidence string, proposedName string, proposedConfidence string, has_proposal boolean")
    got = {r.id: (r.proposed, r.proposed_confidence) for r in attribution.confirmed_drafts(c, s).collect()}
    assert got == {"s1": ("Артём", "high"), "s2": ("Наталья", "low"), "s3": (None, "low")}


def py_grams(s):
    import re

    s = re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", (s or "").lower())).strip()
    return {s[i : i + 3] for i in range(len(s) - 2)}


def py_dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_dice_pairs_are_exact(spark):
    r = random.Random(4)
    words = "смета кровля договор акт отчёт план насос кран отправить проверить обновить".split()
    rows = [(r.choice("ab"), i, " ".join(r.choice(words) for _ in range(r.randrange(0, 5)))) for i in range(120)] + [("a", 500, None), ("a", 501, "аб"), ("a", 502, "аб")]
    df = spark.createDataFrame(rows, "grp string, pos int, text string")
    g = {(a, b): py_grams(t) for a, b, t in rows}
    for least in (0.3, 0.6, 0.8):
        want = {(x[0], x[1], y[1]) for x, y in itertools.combinations(sorted(g), 2) if x[0] == y[0] and py_dice(g[x], g[y]) >= least}
        assert {(x.grp, x.i, x.j) for x in similarity.dice_pairs(df, least).collect()} == want
    kept = {}
    for a, b, t in sorted(rows, key=lambda x: x[1]):
        if not any(py_dice(py_grams(t), k) >= 0.6 for k in kept.get(a, {}).values()):
            kept.setdefault(a, {})[b] = py_grams(t)
    assert {(x.grp, x.pos) for x in similarity.greedy_dedup(df).collect()} == {(a, b) for a in kept for b in kept[a]}


def broadcasts(df):
    """Joins by broadcast, of small tables that Spark is free to broadcast, in the plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


ALIKE = [("a", i, f"Отправить акт №{10 + i % 3} по Северу") for i in range(6)]


def test_dice_pairs_broadcast_nothing(spark):
    df = spark.createDataFrame(ALIKE, "grp string, pos int, text string")
    assert broadcasts(similarity.dice_pairs(df, 0.3, 0.6)) == 0


def test_all_pairs_broadcast_nothing(spark):
    df = spark.createDataFrame(ALIKE, "grp string, pos int, text string")
    assert broadcasts(similarity.entity_pairs(df)) == 0
    assert broadcasts(similarity.all_pairs(df)) == 0


def test_greedy_dedup_broadcasts_nothing(spark):
    df = spark.createDataFrame(ALIKE, "grp string, pos int, text string")
    assert broadcasts(similarity.greedy_dedup(df)) == 0


def test_drop_resembling_broadcasts_nothing(spark):
    df = spark.createDataFrame(ALIKE, "grp string, pos int, text string")
    got = similarity.drop_resembling(df, df.where("pos = 0").select("grp", "text"))
    assert broadcasts(got) == 0


def test_dedup_vectors(spark):
    cases = [
        ("Накидать смету на вариант со сэндвич-панелями для сравнения стоимости с бетонными плитами", "Накидать смету на замену плит на сэндвич-панели для сравнения стоимости", 1),
        ("Подготовить дефектные ведомости для Рыбинска и Апатитов", "Подготовить дефектные акты и графики по Старому Осколу и Ярославлю", 2),
        ("ab", "ab", 2),
    ]
    df = spark.createDataFrame([(str(k), i, t) for k, c in enumerate(cases) for i, t in enumerate(c[:2])], "grp string, pos int, text string")
    got = {r.grp: r["count"] for r in similarity.greedy_dedup(df).groupBy("grp").count().collect()}
    assert got == {str(k): c[2] for k, c in enumerate(cases)}


def test_resolved_pairs(spark):
    p = spark.createDataFrame([("g", 0, 1, True), ("g", 1, 2, True), ("g", 0, 3, None), ("g", 2, 3, False)], "grp string, i int, j int, same boolean")
    assert {r.pos for r in similarity.resolve_pairs(p).collect()} == {1}


def test_grounded(spark):
    v = spark.createDataFrame([("m", 0, "Романов"), ("m", 1, "Спикер 3"), ("m", 2, "Александр"), ("n", 0, "Романов")], "grp string, pos int, text string")
    n = spark.createDataFrame([("m", "Александр Ильин")], "grp string, text string")
    lab = spark.createDataFrame([("m", "Спикер 3")], "grp string, label string")
    assert {(r.grp, r.text) for r in similarity.grounded(v, n, lab).collect()} == {("m", "Спикер 3"), ("m", "Александр"), ("n", "Романов")}


def test_name_assignment(spark):
    def run(votes, roster=()):
        v = spark.createDataFrame([("m", a, n, i) for i, (a, n) in enumerate(votes)], "meeting_id string, label string, name string, seq int")
        r = spark.createDataFrame([("m", x) for x in roster], "meeting_id string, name string")
        return {x.label: (x.name, x.confidence, x.candidates) for x in minutes.assign_names(v, r).collect()}

    seven = [(a, n) for _ in range(7) for a, n in (("A", "Артем"), ("B", "Семен"))]
    assert run(seven)["A"] == ("Артем", "high", None)
    same = [(a, "Артем") for _ in range(7) for a in "AB"]
    same[1] = ("B", None)
    assert run(same)["B"][0] is None
    split = [("A", "Артем")] * 8 + [("B", "Артем")] * 4 + [("B", "Влад")] * 4
    assert run(split)["B"][0] == "Влад"
    assert run([("A", "Артем")] * 8 + [("B", "Артем")] * 5 + [("B", "Влад")] * 3)["B"][0] is None
    assert run([("A", "Настя")] * 7, ["Настя Филатова"])["A"] == ("Настя Филатова", "high", None)
    two = run([("A", "Настя")] * 7 + [("B", "Настя")] * 7 + [("C", "Настя")] * 7, ["Настя Филатова", "Настя Хохлова"])
    assert two["A"] == ("Настя", "low", ["Настя Филатова", "Настя Хохлова"]) and two["B"][0] == "Настя" and two["C"][0] is None


def test_word_errors(spark):
    assert scoring.align_counts("a b c".split(), "a x c d".split()) == (1, 0, 1)
    assert scoring.align_counts([], ["a"]) == (0, 0, 1)
    df = spark.createDataFrame([("a b c", "a x c d"), ("", ""), (None, "x")], "r string, h string").select(scoring.word_errors(F.col("r"), F.col("h")).alias("e"))
    assert [tuple(r.e) for r in df.collect()] == [(1, 0, 1, 3), (0, 0, 0, 0), (0, 0, 1, 0)]


def test_two_voices_never_merge(spark):
    v = lambda *x: [float(i) for i in x]
    two = spark.createDataFrame([("r", 1, v(1, 0), 5.0), ("r", 2, v(0.95, 0.3), 5.0)], "grp string, label int, centroid array<double>, weight double")
    assert {(r.label, r.merged) for r in clustering.merge_nearest(two).collect()} == {(1, 1), (2, 2)}
    three = spark.createDataFrame([("r", 1, v(1, 0), 5.0), ("r", 2, v(0.99, 0.14), 5.0), ("r", 3, v(0, 1), 5.0)], "grp string, label int, centroid array<double>, weight double")
    assert {(r.label, r.merged) for r in clustering.merge_nearest(three).collect()} == {(1, 1), (2, 1), (3, 3)}
    totals = spark.createDataFrame([("r", 1, 50.0), ("r", 2, 4.0), ("r", 3, 60.0), ("r", 4, 1.0)], "grp string, label int, total double")
    assert {(r.label, r.absorbed) for r in clustering.absorb_small(totals, three).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_schema_repair_and_glossary(spark):
    d = spark.createDataFrame([(None, ["a"]), ([], ["b"]), (["c"], ["d"]), (["e"], None), (None, None)], "t array<string>, n array<string>")
    assert [r[0] for r in d.select(minutes.lifted(F.col("t"), F.col("n"))).collect()] == [["a"], ["b"], ["c"], ["e"], None]
    old = spark.createDataFrame([("p", "КС-2", ["ка эс два"]), ("p", "ПНР", [])], "grp string, term string, variants array<string>")
    new = spark.createDataFrame([("p", "КС-2", ["кс два", "ка эс два"])], "grp string, term string, variants array<string>")
    assert {r.term: r.variants for r in minutes.merged_glossary(old, new).collect()} == {"КС-2": ["ка эс два", "кс два"], "ПНР": []}


def test_versions(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, v int, s string")
    assert {(r.id, r.s) for r in audit.latest(d, "id", ["v"]).collect()} == {("a", "y"), ("b", "z")}
    new = spark.createDataFrame([("a", 9, "n")], "id string, v int, s string")
    assert {(r.id, r.s) for r in audit.replaced(d, new, "id").collect()} == {("a", "n"), ("b", "z")}
    assert {r.id for r in audit.without_deleted(d, new, "id").collect()} == {"b"}


def test_mono_of_many_channels(spark):
    df = spark.createDataFrame([([[float(i), 1.0] for i in range(150)],), ([[2.0, 3.0]],)], "c array<array<double>>")
    assert [r[0] for r in df.select(audio.mono(F.col("c"))).collect()] == [[74.5, 1.0], [2.0, 3.0]]


def test_signals():
    x = np.concatenate([np.zeros(100), np.ones(100), np.zeros(300)])
    assert len(audio.voiced(x, 10, 0.5, 1, 2)) == 10 * (2 + 12 + 2)
    assert len(audio.resample(x, 16_000, 8_000)) == 250
    assert audio.denoised(np.sin(np.arange(4000) / 5)).shape == (4000,)
    assert audio.high_pass(np.ones(5), 0.9).tolist() == [0.0] * 5


def test_samples_highlights_and_removals(spark):
    v = spark.createDataFrame([("m", 1, "fallback"), ("m", 1, "fallback"), ("m", 2, "fallback"), ("m", 2, None), ("n", 1, "fallback")], "meeting_id string, sample int, reasoning string")
    assert sorted((r.meeting_id, r["sample"]) for r in minutes.usable_samples(v).collect()) == [("m", 2), ("m", 2), ("n", 1)]
    q = spark.createDataFrame([("m", 0, "Анна", "Мы успеем к среде"), ("m", 1, "анна", "Мы успеем к среде!"), ("m", 2, "Пётр", "Мы успеем к среде"), ("m", 3, "null", " "), ("m", 4, None, "Смета готова")], "grp string, pos int, speaker string, quote string")
    assert {r.pos for r in minutes.kept_highlights(q).collect()} == {0, 2, 4}
    assert {r.pos for r in minutes.kept_highlights(q, most=1).collect()} == {0}


def test_merge_rounds_follow_names(spark):
    v = lambda *x: [float(i) for i in x]
    c = spark.createDataFrame([("r", 1, v(1, 0, 0), 5.0), ("r", 2, v(0.99, 0.1, 0), 5.0), ("r", 3, v(0.97, 0.2, 0), 5.0), ("r", 4, v(0, 0, 1), 5.0)], "grp string, label int, centroid array<double>, weight double")
    one = {(r.label, r.merged) for r in clustering.merge_nearest(c, 0.5).collect()}
    more = {(r.label, r.merged) for r in clustering.merge_rounds(c, 3, 0.5).collect()}
    assert (4, 4) in one and (4, 4) in more and len({m for _, m in more}) <= len({m for _, m in one})


def test_ranking_twice_changes_nothing(spark):
    rows = [("A", None, None, None, 0, 1, "1 2 3"), ("B", None, None, None, 0, 1, "1 2 3 4"), ("A", None, None, None, 0, 1, "5")]
    p = ph(spark, rows)
    r = phrases.ranked_speakers(p).select("meeting_id", F.col("original_id").alias("speakerId"), "speaker_id")
    q = p.join(r, ["meeting_id", "speakerId"]).withColumn("speakerId", F.col("speaker_id")).drop("speaker_id")
    assert phrases.merged_runs(p).count() == phrases.merged_runs(q).count()


def test_adapter_retries_and_reports(spark):
    from palaver.adapters import Echo, apply_adapter

    def make():
        seen = {}

        def call(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "bad" or (prompt == "flaky" and seen[prompt] < 2):
                raise ValueError("no")
            return Echo()(prompt)

        return call

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "flaky"), (4, None)], "id int, prompt string")
    got = {r.id: (r.answer, r.error) for r in apply_adapter(df, ["id"], ["prompt"], "string", make, waits=(0.01,)).collect()}
    assert got == {1: ("a", None), 2: (None, "ValueError: no"), 3: ("flaky", None), 4: (None, None)}


def test_correction_report(spark):
    """Blank lines don't count as answered, of one number the last line does, changed numbers are rejected, and what wasn't answered is missing."""
    lines = [(0, "[1] Спикер 2: новая строка"), (1, "[1] другая фраза"), (2, "[2]  "), (3, "[3] было 21 штук"), (4, "[4] так же"), (5, "болтовня"), (6, "[9] лишняя")]
    got = attribution.answered(spark.createDataFrame([("a", *x) for x in lines], "run string, place int, line string"), ["run"])
    assert {(r.id, r.body) for r in got.collect()} == {(1, "другая фраза"), (3, "было 21 штук"), (4, "так же"), (9, "лишняя")}
    asked = spark.createDataFrame([("a", 1, "новая"), ("a", 2, "x"), ("a", 3, "было двадцать штук"), ("a", 4, "так же"), (None, 1, "y")], "run string, id int, text string")
    rows = {r.run: tuple(r)[1:] for r in attribution.correction_report(asked, got.withColumnRenamed("body", "refined"), ["run"]).collect()}
    assert rows == {"a": (4, 1, 1, 1, 1, 250_000), None: (1, 1, 0, 0, 0, 0)}


def test_text_pieces(spark):
    texts = [(1, "aaaa\nbb\ncccccccccccc\nd"), (2, ""), (3, None), (4, "x" * 30), (5, "a\n\nb")]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("piece", F.lit("clash"))
    got = {(r.id, r.piece): r.text for r in phrases.text_pieces(df, ["id"], "text", 8).collect()}
    assert {i for i, _ in got} == {1, 2, 4, 5}
    for i, t in texts:
        mine = [got[k] for k in sorted(got) if k[0] == i]
        assert t is None or "\n".join(mine) == t
        assert all(len(p) <= 8 or "\n" not in p for p in mine)
        assert all(len(p) + 1 + len(q.split("\n")[0]) > 8 for p, q in itertools.pairwise(mine))  # the next line had no room


def test_quality_classes(spark):
    rows = [(0.0, 0.1, 20.0, 9.0, 0.5, "good"), (0.01, 0.1, 20.0, 9.0, 0.5, "good"), (0.01, 0.1, 20.0, 2.0, 0.5, "fair"), (0.0, 0.1, 5.0, 9.0, 0.5, "fair"), (0.0, 0.9, 20.0, 9.0, 0.5, "poor"), (0.0, 0.1, 20.0, 9.0, 0.01, "poor"), (0.01, 0.1, 5.0, 2.0, 0.5, "poor"), (None, None, None, None, None, "good")]
    df = spark.createDataFrame(rows, "c double, s double, n double, t double, p double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", audio.quality_class(F.col("c"), F.col("s"), F.col("n"), F.col("t"), F.col("p"))).collect())


def test_small_clusters_are_absorbed_by_their_summed_time(spark):
    """Two merged labels are big together; a label too short for a centroid goes by all of its segments; one without vectors stays."""
    v = lambda *x: [float(i) for i in x]
    seg = [("r", 1, 1, 6.0, v(1, 0)), ("r", 2, 2, 6.0, v(1, 0.1)), ("r", 3, 3, 20.0, v(0, 1)), ("r", 4, 4, 0.5, v(0.1, 1)), ("r", 5, 5, 0.5, None)]
    s = spark.createDataFrame(seg, "grp string, label int, seg int, duration double, embedding array<double>")
    c = clustering.centroids(s)
    m = spark.createDataFrame([("r", 1, 1), ("r", 2, 1), ("r", 3, 3)], "grp string, label int, merged int")
    got = {(r.label, r.absorbed) for r in clustering.absorbed_clusters(s, m, clustering.merged_centroids(c, m)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)}


def test_merged_samples_and_glossaries(spark):
    samples = spark.createDataFrame([("m", 1, "А", "коротко", ["т1"]), ("m", 2, "Б", "подлиннее", ["т2"]), ("m", 3, "В", "подлиннее", ["т3"])], "meeting_id string, sample int, title string, overview string, topics array<string>")
    lists = spark.createDataFrame([("m", 1, 0, "Заказать бетон для плиты"), ("m", 2, 0, "Заказать бетон для плиты."), ("m", 2, 1, "Позвонить заказчику")], "meeting_id string, sample int, pos int, item string")
    assert [tuple(r) for r in minutes.merged_samples(samples, lists).collect()] == [("m", "Б", "подлиннее", ["т2"], ["Заказать бетон для плиты", "Позвонить заказчику"])]
    old = spark.createDataFrame([("p", "t", ["a"], "старое")], "grp string, term string, variants array<string>, note string")
    new = spark.createDataFrame([("p", "t", ["b", "a"], "новое"), ("p", "u", None, "новое")], old.schema)
    assert {(r.term, r.note, tuple(r.variants)) for r in minutes.merged_terms(old, new, ["note"]).collect()} == {("t", "старое", ("a", "b")), ("u", "новое", ())}
    a, b = (spark.createDataFrame([("p", "СП", x), *extra], "grp string, abbreviation string, meaning string") for x, extra in (("старое", [("p", "ПК", "комиссия")]), ("новое", [])))
    assert {(r.abbreviation, r.meaning) for r in minutes.merged_abbreviations(a, b).collect()} == {("СП", "новое"), ("ПК", "комиссия")}
