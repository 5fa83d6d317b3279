"""Operators of the llm subpackage against brute force, round trips, and hard cases."""

import base64
import math
import random
import re
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import linking, mixing, names, pii, quality, quantiles, tokenizer
from palaver.llm import turns as speech

VOCABULARY = f"{tokenizer.DEFAULT_DIR}/byte_bpe_50k.tiktoken"


# ---- percentiles


def test_sketch_keeps_its_bound():
    r = np.random.default_rng(1)
    for values in (r.normal(size=60_000), np.sort(r.normal(size=60_000)), r.integers(0, 5, 60_000).astype(float), r.pareto(1, 60_000)):
        parts = [quantiles.Sketch(6, 128) for _ in range(7)]
        for i, chunk in enumerate(np.array_split(values, 70)):
            parts[i % 7].add(chunk)
        s = parts[0]
        for p in parts[1:]:
            s.merge(quantiles.Sketch.unpack(p.pack()))
        assert s.n == len(values) and len(s.full) <= 6 and 0 < s.err < 0.2 * s.n
        for permille in (1, 10, 250, 500, 900, 999):
            v = s.at([permille])[0]
            rank = max(1, -(-s.n * permille // 1000))
            assert (values < v).sum() < rank + s.err and (values <= v).sum() >= rank - s.err


def test_buffer_size_keeps_the_error_that_is_asked_for():
    r = np.random.default_rng(5)
    for error, n in ((0.05, 30_000), (0.01, 200_000)):
        k = quantiles.buffer_size(error, n)
        s = quantiles.Sketch(4, k)
        for c in np.array_split(r.normal(size=n), 23):
            s.add(c)
        assert s.err <= error * n and quantiles.buffer_size(error, n // 2) <= k
    assert quantiles.buffer_size(0.01, 10**10) == 2048


def test_default_sketch_is_tight_over_a_million():
    s = quantiles.Sketch()
    v = np.random.default_rng(2).permutation(1_000_000).astype(float)
    for c in np.array_split(v, 40):
        s.add(c)
    assert s.err / s.n < 0.01 and abs(s.at([500])[0] - 500_000) < 0.01 * 1_000_000


def test_percentiles_over_groups(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "b", None]), r.choice([None, float("nan"), r.random(), 1.0]), r.randrange(9)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, x double, n int").withColumn("metric", F.lit("clash")).repartition(7)
    got = {(x.g, x.metric): x for x in quantiles.percentiles(quantiles.merged(quantiles.sketches(df, ["g"], ["x", "n"]), ["g"]), ["g"], [500, 990]).collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, x, _ in rows if k == g and x is not None and not math.isnan(x))
        row = got[g, "x"]
        assert (row.n, row.p500, row.rank_error) == (len(v), v[-(-len(v) * 500 // 1000) - 1], 0.0)
    empty = quantiles.sketches(df.where("false"), ["g"], ["x"])
    assert quantiles.percentiles(quantiles.merged(empty, ["g"]), ["g"], [500]).count() == 0


# ---- tokens and mixing


def _ranks():
    with open(VOCABULARY, "rb") as f:
        return tokenizer.read_ranks(f.read())


HARD = ["", None, " ", "a", "Привет, мир!", "I'll we've  two   spaces\n\n\tend ", "👷🏽‍♀️ emoji 🔥", "<|endoftext|>", "x" * 5000, "абв" * 3000, "ё​а b﻿", "\x00\x1c\x85", "123456789 ½ Ⅷ", "שלום العربية 日本語"]


def test_ids_equal_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = tokenizer.Encoder(_ranks(), kept=2000)
    r = random.Random(5)
    texts = [t for t in HARD if t] + ["".join(r.choice("аеёбв гд.,!?1 \n'tsllABCxyz") for _ in range(r.randrange(1, 200))) for _ in range(400)]
    for t in texts:
        assert enc.encode(t) == lib.encode_ordinary(t)
        assert lib.decode(enc.encode(t)) == t
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in tokenizer.encode(df, "doc_id", "text").collect()}
    assert got == {i: lib.encode_ordinary(t) if t else [] for i, t in enumerate(HARD)}
    assert tokenizer.encode(df.where("false"), "doc_id", "text").count() == 0


def test_mix(spark):
    r = random.Random(7)
    docs = [(i, r.choice(["big"] * 6 + ["mid", "small", "other", None]), " ".join(r.choice(["дом", "план", "акт"]) for _ in range(r.randrange(1, 40)))) for i in range(1500)]
    docs += [(9000 + i, "big", "одно и то же") for i in range(400)] + [(9900, "big", None), (9901, "mid", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("copies", F.lit("clash"))
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("gone", 0.1, 3), ("mid", 0.3, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix(df, t)
    m = [x.asDict() for x in mix.collect()]
    assert len({x["doc_id"] for x in m}) == len(m) and {x["source"] for x in m} == {"big", "mid", "small"}
    caps = {"big": 1, "mid": 2, "small": 4}
    assert all(1 <= x["copies"] <= caps[x["source"]] for x in m)
    rep = {x.source: x for x in report.collect()}
    total = sum(x["copies"] * x["n_tokens"] for x in m)
    for s, share in (("big", 0.5 / 0.9), ("mid", 0.3 / 0.9), ("small", 0.1 / 0.9)):
        assert rep[s].tokens == sum(x["copies"] * x["n_tokens"] for x in m if x["source"] == s)
        assert abs(rep[s].actual_share - share) < 0.01 and abs(rep[s].tokens / total - rep[s].actual_share) < 1e-9
    assert rep["gone"].tokens == 0
    again = {(x.doc_id, x.copies) for x in mixing.mix(df.repartition(9), t)[0].collect()}
    assert again == {(x["doc_id"], x["copies"]) for x in m}
    few, _ = mixing.mix(df, t, total=500)
    assert abs(sum(x.copies * x.n_tokens for x in few.collect()) - 500) < 300
    none, rep0 = mixing.mix(df.where("false"), t)
    assert none.count() == 0 and rep0.count() == 4


def test_solve():
    for classes, limit, target in (([(1.0, 100)], 3, 150.0), ([(1.0, 100), (0.5, 100)], 1, 150.0), ([(1.0, 100), (0.25, 1000)], 2, 600.0)):
        c = mixing.solve(classes, limit, target)
        assert abs(sum(t * min(limit, c * w) for w, t in classes) - target) < 1e-6


# ---- personal information


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Пишите мне на khorma+x@mail.lug.test, отвечу", ["email"]), ("polina точка soykavina собака pochta дефис sever точка example", ["email"]), ("a_b (собака) beton.example", ["email"]),
        ("У ворот бегает собака, поставьте там ограждение.", []), ("Напишите в общий чат @дежурный, там ответят.", []), ("собаку в адресе система не принимает", []),
        ("звоните +7 972 588-06-93", ["phone"]), ("8‑972‑131‑9767", ["phone"]), ("973.050.48.30", ["phone"]), ("8 (973) 930 68 72", ["phone"]),
        ("мой сотовый восемь девятьсот семьдесят шесть шестьсот семьдесят девять восемнадцать девяносто один", ["phone"]), ("восемь девятьсот, эээ, семьдесят шесть шестьсот семьдесят девять восемнадцать девяносто один", ["phone"]),
        ("Заявка 99911114-09 висит", []), ("Артикул 4607632818585 снят", []), ("партии 7808 8918 4330, проверьте", []), ("строки 395-350-37, итог", []), ("Счётчик показывает 710522813", []),
        ("паспорт РФ 39 22 № 965820", ["id_number"]), ("серия 3509 номер 976728", ["id_number"]), ("снилс 45235847999", ["id_number"]), ("656-741-635 29 без ошибок", ["id_number"]), ("ИНН 988217408250", ["id_number"]),
        ("паспорт двадцать три ноль четыре номер четыреста двадцать восемьсот девяносто девять", ["id_number"]), ("паспорт на лифт мы обещали ещё 230 дней назад", []), ("ИНН 7701234567 нашей фирмы", []),
        ("ул. Бересклетная, д.51к1", ["address"]), ("Мельничный переулок, 51/2", ["address"]), ("улица ольховная дом восемьдесят три квартира сто пять", ["address"]), ("ул Мельничная 69-9", ["address"]),
        ("Улицу перекроют на 15 дней", []), ("Дом 110 по генплану сносим последним.", []),
        ("Акт подписал Дрожкурин Т. О. вчера", ["person"]), ("без подписи ксении бельдымовой акт не примут", ["person"]), ("Мария Сергеевна согласна", ["person"]), ("Polina Ploskoshova придёт", ["person"]), ("ЕЛЕНА О. в отпуске", ["person"]),
        ("Артём, что у нас по теме", []), ("Компания «Кардымов и партнёры» прислала акт", []), ("снизили на 420 процентов ульяна пожалуйста помогите", []), ("19 листов инна что у нас", []),
        (None, []), ("", []), ("   ", []),
    ],
)
def test_kinds(text, kinds):
    assert pii.kinds(text) == kinds


def test_redaction_keeps_the_rest():
    key = b"k"
    t = "Звоните 8 (973) 930 68 72, это Мария​ Пурмачина; почта a.b@mail.test."
    out = pii.redact(t, key)
    assert out.startswith("Звоните [PHONE 8 (") and "; почта [EMAIL " in out and out.endswith("].") and "930 68" not in out and "Пурмачина" not in out
    a, b = pii.redact("тел 89739306872", key), pii.redact("тел восемь девятьсот семьдесят три девятьсот тридцать шестьдесят восемь семьдесят два", key)
    digits = lambda s: "".join(c for c in s if c.isdigit())[-10:]
    assert digits(a) == digits(b)
    assert pii.redact(None, key) is None and pii.redact("", key) == "" and pii.redact("без всего", key) == "без всего"
    assert pii.kinds("x" * 300_000 + " Мария Пурмачина " + "ы" * 300_000) == ["person"]


@pytest.mark.parametrize("between", ["\n", " ", "\t", " - ", "; "])
def test_long_runs_of_numbers_are_read_whole(between):
    phones = [f"891234500{i:02d}" for i in range(20)]
    t = between.join(phones)
    assert [t[a:b] for a, b, *_ in pii.find(t)] == phones
    assert not any(p[1:] in pii.redact(t, b"k") for p in phones)
    row = between.join(["1 204 77", "12 5 60"] * 12)
    assert pii.kinds(row) == [] and pii.kinds(f"{row}{between}8 912 345-00-01{between}{row}") == ["phone"]
    assert pii.kinds(f"{row}{between}656-741-635 29{between}{row}") == ["id_number"]


STREETS = "улица улице улицу улицы ул ул. переулок переулка переулке переулку пер пер. проезд проезда проезде проезду пр-д проспект проспекта просп просп. пр-т шоссе набережная набережной набережную наб наб. бульвар б-р площадь площади пл. тупик аллея аллеи аллею".split()


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        *((f"ivan.k{a}mail.test", "email") for a in ("@", " @ ", "(at)", "[at]", " [at] ", "(dog)", "[dog]", "( dog )", "[ at ]", "(эт)", "[эт]", "(собака)", "[собака]")),
        ("ivan эт mail точка test", "email"), ("polina точка soykavina\nэт\nmail точка test", "email"), ("ivan собака mail точка test", "email"),
        *((f"{s} {name}{sep}5", "address") for s in STREETS for name in ("Ольховая",) for sep in (" ", ", ", " д. ", ", дом ")), *((f"Мельничная {s}{sep}5", "address") for s in STREETS for sep in (" ", ", ", " д. ", " №")),
        ("восемь четыреста девяносто пять сто двадцать три сорок пять шестьдесят семь", "phone"), ("плюс семь четыреста девяносто пять сто двадцать три сорок пять шестьдесят семь", "phone"), ("семь триста сорок три двести двадцать два тридцать три сорок четыре", "phone"),
        ("восемь девять один два три четыре пять шесть семь восемь девять", "phone"), ("девять, один, два, три, четыре, пять, шесть, семь, восемь, ноль", "phone"), ("восемь восемьсот сто двадцать три сорок пять шестьдесят семь", "phone"),
        ("серию 45 12 № 123456", "id_number"), ("серии 4512 номер 123456", "id_number"), ("45 12 номер 123456", "id_number"), ("паспорт 4512 n 123456", "id_number"), ("инн физлица " + "четыре " * 12, "id_number"), ("серию четыре пять один два номер один два три четыре пять шесть", "id_number"),
        ("Lev Kardymov", "person"), ("Мaрия Пурмaчина", "person"), ("Кардымов Савиныч", "person"), ("Сергеевну Кардымову", "person"),
    ],
)
def test_each_form_is_reached_alone(text, kind):
    assert pii.kinds(text) == pii.kinds(f"Слово {text} и дальше") == [kind]


def test_forms_that_look_like_triggers():
    for t in ("эт точка зрения", "мы эт самое, точка", "см. (at) и [dog]", "семь восемь раз", "девять или десять человек", "передали пер, наб и ул", "Пересохла 5 раз"):
        assert pii.kinds(t) == [], t
    spoken = "восемь девятьсот двенадцать триста сорок пять шестьдесят семь восемьдесят девять"
    assert pii.kinds(spoken + " один") == []
    assert [k for *_, k, _ in pii.find(", ".join([spoken] * 20))] == ["phone"] * 20
    assert len({pii.find(f"ivan{a}mail.test")[0][3] for a in ("@", "(at)", " [dog] ", "( эт )")} | {pii.find("ivan эт mail точка test")[0][3]}) == 1


KEY = b"0123456789abcdef"


@pytest.mark.parametrize(
    "text",
    [
        "инн семьсот семьдесят семь четыреста пятьдесят шесть семьсот восемьдесят девять сто двадцать три",
        "его инн: " + ", ".join("семь семь семь четыре пять шесть семь восемь девять один два три".split()) + ", и дальше текст",
        "пишите ivan точка " + "petrov точка " * 40 + "x собака mail точка ru, и дальше",
        "почта " + "ящик_" * 60 + "@example.ru, и дальше",
        "паспорт:" + " " * 300 + "4512 123456",
        "живёт на ул. " + "а" * 150 + " д. 5, " + "стр. 1, " * 20 + "кв. 7",
        "снилс " + "э-э " * 60 + "112-233-445 95",
    ],
)
def test_long_items_are_whole(text):
    (a, b, kind, value), = pii.find(text)
    shown = pii.redact(text, KEY)
    assert len(re.sub("(э-э )+|\\s{9,}", "", shown)) < 120 and not re.search("три$|petrov|ящик_|123456|ааа|кв|95", shown.replace(value, ""))


@pytest.mark.parametrize("text", ["+49 30 1234567", "+1 (212) 555-01-23", "+380 44 123 45 67", "+998901234567", "восемь четыреста девяносто пять сто двадцать три сорок пять шестьдесят семь", "плюс семь восемьсот двенадцать сто двадцать три сорок пять шестьдесят семь"])
def test_landline_and_foreign_phones(text):
    assert [k for *_, k, _ in pii.find(f"звоните {text}, жду")] == ["phone"] and not pii.find("итого +15 000 000 000 рублей")


def test_numbers_keep_their_layout():
    for text, rx in [("СНИЛС 112-233-445 95", r"СНИЛС \[ID_NUMBER \d{3}-\d{3}-\d{3} \d\d\]"), ("тел. +7 (916) 123-45-67 доб. 12", r"тел. \[PHONE \+7 \(9\d\d\) \d{3}-\d\d-\d\d доб. \d\d\]"), ("паспорт 45 12 № 123456", r"паспорт \[ID_NUMBER \d\d \d\d № \d{6}\]")]:
        assert re.fullmatch(rx, pii.redact(text, KEY))
    a, b = (re.sub(r"\D", "", pii.redact(t, KEY))[-9:] for t in ("89161234567", "+7 (916) 123-45-67"))
    assert a == b
    m = re.search(r"\d{3}-\d{3}-\d{3} \d\d", pii.redact("СНИЛС 112-233-445 95", KEY)).group()
    body = re.sub(r"\D", "", m)
    assert body[9:] == pii.snils_check(body[:9]) and pii.feistel(body[:9], KEY, "snils", back=True) == "112233445"


def test_cases_of_a_person_link():
    same = ["Иван Петров", "Ивана Петрова", "Петрову Ивану", "Ваня Петров", "Ivan Petrov"]
    assert len({pii.person_key(x) for x in same}) == 1 and pii.person_key("Иван Павлов") != pii.person_key(same[0])
    assert pii.person_key("Анна Сергеевна Смирнова") == pii.person_key("Смирновой Анне Сергеевне")


def test_dates_of_birth_are_permuted_where_asked_for():
    t = "паспорт 4512 123456 выдан 12.03.2015, встреча 01.02.2024, 99.99.2015 г.р."
    new = pii.redact(t, KEY, dates=True)
    d = re.search(r"выдан (\d\d)\.(\d\d)\.(\d{4}), встреча 01.02.2024, 99.99.2015 г.р.$", new)
    assert pii.feistel_date(date(*map(int, d.groups()[::-1])), KEY, back=True) == date(2015, 3, 12) and "12.03.2015" in pii.redact(t, KEY)


def test_a_short_key_is_an_error(spark):
    with pytest.raises(ValueError, match="16 bytes"):
        pii.redacted(spark.createDataFrame([("a",)], "text string"), [], "text", b"k")


def test_tags_of_different_values_differ():
    tag = lambda v: pii.pseudonym("email", v, b"k")
    assert len({tag(f"a{i}@mail.test") for i in range(300_000)}) == 300_000
    assert len(tag("a@mail.test")) >= 16 and tag("a@mail.test") == tag("a@mail.test")


def test_feistel_is_a_permutation():
    key = b"secret"
    assert len({pii.feistel(f"{i:03d}", key) for i in range(1000)}) == 1000
    for d in ("9739306872", "01", "7", "00000000000"):
        assert pii.feistel(pii.feistel(d, key, "t"), key, "t", back=True) == d
    for day in (date(1900, 1, 1), date(2024, 2, 29), date(2099, 12, 31)):
        assert pii.feistel_date(pii.feistel_date(day, key), key, back=True) == day
    good = "112233445" + pii.snils_check("112233445")
    new = pii.pseudonym("id_number", good, key)
    assert new != good and new[9:] == pii.snils_check(new[:9])
    inn = "7707083893" + pii.inn_check("7707083893")
    new = pii.pseudonym("id_number", inn, key)
    assert new[10:] == pii.inn_check(new[:10])


def test_items_over_rows(spark):
    df = spark.createDataFrame([("a", 1, "Мария Пурмачина, +7 972 588-06-93"), ("b", 2, None), (None, None, "a@b.test")], "m string, pos int, text string").withColumn("kind", F.lit("clash"))
    assert {tuple(r) for r in pii.items(df, ["m", "pos"], "text").collect()} == {("a", 1, "person"), ("a", 1, "phone"), (None, None, "email")}
    assert pii.redacted(df, ["m", "pos"], "text", KEY).where("m = 'b'").first().redacted is None
    assert pii.items(df.where("false"), ["m"], "text").count() == 0


# ---- turns

PH = "meeting_id string, pos int, speakerId string, speakerLabel string, speakerTag string, detectedName string, startTimeMs long, text string, arrivedAt string"


def _turns(spark, rows):
    df = spark.createDataFrame(rows, PH).withColumn("arrivedAt", F.to_timestamp("arrivedAt")).withColumn("noise", F.lit("clash"))
    return [tuple(r) for r in speech.turns(speech.prepared(df, with_text=True)).select("meeting_id", "speaker", "first_pos", "last_pos", "text").orderBy("meeting_id", "from_ms", "first_pos").collect()]


def test_turns(spark):
    at = "2024-01-01 00:00:00"
    rows = [
        ("m", 0, "speaker-1", "Спикер 1", "0", None, 1000, "Эм, начнём (смеётся)", at), ("m", 1, None, "СПИКЕР №1", "0", None, 2000, "и продолжим", at), ("m", 2, "speaker-2", "Спикер 2", "1", None, 3000, "Угу, ну", at),
        ("m", 3, "speaker-1", None, "0", None, 4000, "закончим", at), ("m", 4, "speaker-2", "Спикер 2", "1", None, None, "[0:00:01] раньше всех", at), ("m", 5, None, "Cпикер 2:", "1", None, None, "следом", at),
        ("m", 5, None, "Cпикер 2:", "1", None, None, "следом", "2024-01-02 00:00:00"), ("m", 6, "speaker-2", "x", "1", None, 5000, None, at), ("m", 7, "speaker-2", "x", "1", None, 6000, "♪♪ [пауза]", at), (None, 1, "a", "b", "c", None, 1, "t", at), ("m", None, "a", "b", "c", None, 1, "t", at),
    ]
    # 0 at 1000, 4 and 5 at 1000 (written, carried), 1 at 2000, 3 at 4000; 2, 6 and 7 hold nothing
    assert _turns(spark, rows) == [("m", "speaker-1", 0, 0, "начнём"), ("m", "speaker-2", 4, 5, "раньше всех следом"), ("m", "speaker-1", 1, 3, "и продолжим закончим")]
    assert _turns(spark, []) == []


def test_labels_without_ids(spark):
    at = "2024-01-01 00:00:00"
    rows = [("m", i, None, lab, None, None, i, "слово", at) for i, lab in enumerate(["Спикер 1", "[спикер 1]", "Speaker 2", "speaker_2", "Спикер 1 (Анна)", "Анна", "Спикер 2"])]
    assert [(t[2], t[3]) for t in _turns(spark, rows)] == [(0, 1), (2, 3), (4, 5), (6, 6)]


def test_missing_labels_by_language(spark):
    at = "2024-01-01 00:00:00"
    a, b = "бетон арматура опалубка кран насос", "смета договор бюджет платёж счёт"
    rows = [("m", i, "A" if i % 2 else "B", "Спикер 1" if i % 2 else "Спикер 2", None, None, i, a if i % 2 else b, at) for i in range(40)]
    rows += [("m", 40, None, None, None, None, 40, b, at), ("m", 41, None, None, None, None, 41, a, at), ("n", 0, None, None, None, None, 0, "никто", at)]
    df = spark.createDataFrame(rows, PH).withColumn("arrivedAt", F.to_timestamp("arrivedAt"))
    got = {(r.meeting_id, r.pos): r.speaker for r in speech.prepared(df).collect()}
    assert got["m", 40] == "B" and got["m", 41] == "A" and got["n", 0] is None


def test_missing_speakers_across_a_border(spark, monkeypatch):
    monkeypatch.setattr(speech, "BLOCK", 8)
    at = "2024-01-01 00:00:00"
    row = lambda m, i, who: (m, i, who, None, None, None, i, None if who is None else "бетон арматура опалубка" if who == "A" else "смета", at)
    rows = [row("after", i, "BA"[i % 2]) for i in range(8)] + [row("after", 8, None)]
    rows += [row("before", 7, None)] + [row("before", i, "AB"[i % 2]) for i in range(8, 16)]
    rows += [row("long", i, None if 6 <= i <= 9 else "BA"[i % 2]) for i in range(16)]
    df = spark.createDataFrame(rows, PH).withColumn("arrivedAt", F.to_timestamp("arrivedAt"))
    got = sorted((r.meeting_id, r.pos, r.speaker) for r in speech.prepared(df).collect())
    assert len(got) == len(rows)
    got = {(m, i): who for m, i, who in got}
    assert got["after", 8] == got["before", 7] == "B" and [got["long", i] for i in range(6, 10)] == ["B", "A", "B", "A"]


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    """A meeting of more than BLOCK phrases, with long stretches of nobody known and labels now and then, comes out as without blocks; ambiguous labels are settled by the language."""
    at, r = "2024-01-01 00:00:00", random.Random(3)
    say = {"A": "бетон арматура опалубка кран".split(), "B": "смета договор счёт бюджет".split(), "C": "да нет хорошо ладно".split()}
    rows = []
    for m, known in (("few", 0.05), ("most", 0.8)):
        for i in range(9000):
            who = r.choice("AABBCC")
            label = {"A": "Спикер 1", "B": "Спикер 1", "C": "спикер №2"}[who]
            rows.append((m, i, who if r.random() < known else None, label if r.random() < 0.6 else None, None, None, i, " ".join(r.choices(say[who], k=3)), at))
    df = spark.createDataFrame(rows, PH).withColumn("arrivedAt", F.to_timestamp("arrivedAt"))
    got = {(x.meeting_id, x.pos): x.speaker for x in speech.prepared(df).collect()}
    monkeypatch.setattr(speech, "BLOCK", 10**6)
    assert got == {(x.meeting_id, x.pos): x.speaker for x in speech.prepared(df).collect()}
    said = {(m, i): "A" if t.split()[0] in say["A"] else "B" if t.split()[0] in say["B"] else "C" for m, i, *_, t, _ in rows}
    assert sum(got[k] == v for k, v in said.items()) > 0.99 * len(said)
    monkeypatch.setattr(speech, "BLOCK", 64)
    monkeypatch.setattr(speech, "LAG", 16)
    assert got == {(x.meeting_id, x.pos): x.speaker for x in speech.prepared(df).collect()}


def test_runs_over_many_partitions(spark):
    at, r = "2024-01-01 00:00:00", random.Random(9)
    rows = [("big" if i % 3 else f"m{i % 7}", i, r.choice("AABC"), None, None, None, r.choice([i * 10, i * 10, 500]), "слово", at) for i in range(3000)]
    df = spark.createDataFrame(rows, PH).withColumn("arrivedAt", F.to_timestamp("arrivedAt"))
    got = {(t.meeting_id, t.first_pos, t.last_pos) for t in speech.turns(speech.prepared(df)).collect()}
    want = set()
    for m in {x[0] for x in rows}:
        run = None
        for x in sorted((x for x in rows if x[0] == m), key=lambda x: (x[6], x[1])):
            if run and run[0] == x[2]:
                run[2] = x[1]
            else:
                if run:
                    want.add((m, run[1], run[2]))
                run = [x[2], x[1], x[1]]
        want.add((m, run[1], run[2]))
    assert got == want


@pytest.mark.parametrize(("text", "noise"), [(None, True), ("", True), ("Э-э-э, ну", True), ("[0:01:34] ((помехи))", True), ("00:00:04 — Ммм...", True), ("*кашель* ну вот", True), ("Спикер 2: гм.", True), ("да", False), ("вот так вышло", False), ("12:30", True), ("300", False), ("(да)", False), ("нуэ", False)])
def test_noise(spark, text, noise):
    assert spark.createDataFrame([(text,)], "t string").select(speech.is_noise("t")).first()[0] is noise


# ---- names


def test_parsed_names():
    p = lambda s: linking.parse(s)
    assert p("Команда") is None and p(" не указано ") is None and p("null") is None and p("Спикер 3") is None and p("...") is None
    assert p("Миеаил Ветлаченко")["given"] == "михаил" and p("Dmitry Soykatin")["given"] == "дмитрий"
    assert p("Полине Дрожкыминой")["name"] == p("Полина Дрожкымина")["name"] == p("Polina Drozhkymina")["name"]
    assert p("«Вектор Лифт», ИП")["name"] == p("Vektor-Lift")["name"] == p("ВЕКТОР-ЛИФТ")["name"]
    assert (p("Пурмачина М. С.")["gi"], p("Елена О.")["si"]) == ("m", "o")
    assert p("Вектор Лифт")["kind"] == "o" and p("Вектор Лифт")["name"] == p("ООО ВекторЛифт")["name"]
    assert p("Тaтьяна Яклачина (гость)")["given"] == "татьяна"


def test_linked_names(spark):
    groups = {
        "a": [["Мария Пурмачина", "Пурмачина М. С.", "Маша Пурмачина", "Мария Сергеевна", "Мария Пурмачнна", "Мариа Пурмачина"], ["Иван Кардымов", "Кардымов", "Ваня", "IVAN KARDYMOV"], ["ООО «Север-Лифт»", "Северлифт", "Sever-Lift", "Севрелифт"]],
        "b": [["Елена Обжурина"], ["Елена Кардатова"], ["Лена"], ["Дмитрий Тарватин"], ["Дмитрий Тарвачин"]],
        "c": [["Ольга", "Оля"], ["Команда"]],
    }
    pool = "Пурмачина Кардымов Обжурина Кардатова Тарватин Тарвачин".split()
    rows = [(g, s) for g, cs in groups.items() for c in cs for s in c] + [("a", None), ("a", ""), (None, "Мария Пурмачина"), ("a", "Ваня")]
    rows += [(f"z{i}", f"Анна {n}") for i in range(12) for n in pool] + [(f"z{i}", "ООО «Север-Лифт»") for i in range(12)]
    df = spark.createDataFrame(rows, "grp string, spelling string").withColumn("name", F.lit("clash"))
    got = {(r.grp, r.name_a, r.name_b) for r in linking.pairs(linking.entities(df.select("grp", "spelling"))).collect() if r.grp in groups}
    want = {(g, x, y) for g, cs in groups.items() for c in cs for x in c for y in c if x < y}
    assert got == want
    assert linking.entities(df.where("false").select("grp", "spelling")).count() == 0


def _typo(r, s, kind):
    abc, i = "abvgdeziklmnoprstu", r.randrange(1, len(s) - 1)
    return {"swap": s[:i] + s[i + 1] + s[i] + s[i + 2 :], "drop": s[:i] + s[i + 1 :], "double": s[:i] + s[i] + s[i:], "wrong": s[:i] + r.choice([c for c in abc if c != s[i]]) + s[i + 1 :]}[kind]


@pytest.mark.parametrize("kind", ["swap", "drop", "double", "wrong"])
def test_typos_of_every_kind_find_their_centre(spark, kind):
    r, rows, want = random.Random(11), [], set()
    for i in range(300):
        s = "".join(r.choice("abvgdeziklmnoprstu") for _ in range(r.randrange(5, 13)))
        t = _typo(r, s, kind)
        if s == t:
            continue
        rows += [("p", s, 40), ("p", t, 3)]
        want.add((t, s))
    df = spark.createDataFrame(rows, "kind string, name string, n long").dropDuplicates(["name"])
    got = {(x.name1, x.name2) for x in linking.near_names(df, linking.tune()).collect()}
    assert len(want & got) >= 0.99 * len(want)


def test_chains_end_and_an_absent_centre_joins(spark):
    """A misspelt misspelling goes to the end of its chain; two misspellings of a name that the group lacks belong together; two well attested names don't."""
    rows = [(f"a{i}", "Пурмаченко Анна") for i in range(40)] + [(f"b{i}", "Анна Пурмченко") for i in range(6)] + [(f"d{i}", "Анна Пурмавенко") for i in range(20)]
    rows += [("x", s) for s in ("Анна Пурмаченко", "Анна Пурмченко", "Анна Пурмченк")]
    rows += [("y", s) for s in ("Анна Пурмачнеко", "Анна Ппурмаченко")]
    rows += [("w", s) for s in ("Анна Пурмаченко", "Анна Пурмавенко", "Пурмавенко А. С.")]
    got = linking.pairs(linking.entities(spark.createDataFrame(rows, "grp string, spelling string"))).collect()
    assert {(r.grp, r.name_a, r.name_b) for r in got if r.grp in "xyw"} == {
        ("x", "Анна Пурмаченко", "Анна Пурмченко"), ("x", "Анна Пурмаченко", "Анна Пурмченк"), ("x", "Анна Пурмченк", "Анна Пурмченко"),
        ("y", "Анна Ппурмаченко", "Анна Пурмачнеко"), ("w", "Анна Пурмавенко", "Пурмавенко А. С."),
    }


def test_swaps_in_short_names_are_candidates(spark):
    r, rows = random.Random(12), []
    for i in range(300):
        s = "".join(r.sample("abvgdeziklmnoprstu", r.randrange(4, 8)))
        k = r.randrange(len(s) - 1)
        t = s[:k] + s[k + 1] + s[k] + s[k + 2 :]
        assert linking.osa(s, t) == 1 and linking.monge_elkan(s, t) >= linking.MONGE_ELKAN
        rows += [(i, s), (i, t)]
    b = linking.banded(spark.createDataFrame(rows, "i int, name string"), ["i", "name"], linking.tune())
    assert b.groupBy("i", "band", "bh").agg(F.countDistinct("name").alias("n")).where("n = 2").select("i").distinct().count() == 300


def test_distances():
    assert linking.osa("abcd", "abdc") == 1 and linking.osa("abc", "abc") == 0 and linking.osa("a", "abcdef", 2) > 2
    assert linking.monge_elkan("вектор лифт", "лифт вектор") == 1.0
    assert names.is_patronymic("сергеевна") and not names.is_surname("процентов")


# ---- quality


def test_quality(spark):
    prose = "Мы договорились, что плиту привезут к вечеру, но на складе снова нет места. Поэтому решение такое: ждём до среды и пишем письмо."
    docs = [(1, prose), (2, "1) смета\n2) договор\n3) акт сверки\n4) письмо\n5) план"), (3, "a;b;c\n1;2;3\n4;5;6\n7;8;9"), (4, "#*=-~|" * 40), (5, None), (6, ""), (7, " \n "), (8, "да " * 60), (9, (prose + " ") * 1 + "\n".join(f"Вопрос номер {i} мы обсудили и решили отложить до следующей встречи." for i in range(3000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    words = spark.createDataFrame([("ru", w, i) for i, w in enumerate("мы что но на к и до нет не в с такое".split())], "lang string, word string, word_rank int")
    got = {r.doc_id: r.p_prose for r in quality.classify(df, "doc_id", "text", words).collect()}
    assert got[5] is None and got[6] is None and got[7] is None
    assert got[1] > 0.5 and got[9] > 0.5 and max(got[i] for i in (2, 3, 4, 8)) < 0.5
    assert quality.document_statistics(df.where("false"), "doc_id", "text", words).count() == 0
    assert quality.classify(df.where("false"), "doc_id", "text", words).count() == 0


def test_trees_learn_and_calibration_orders():
    r = np.random.default_rng(4)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality.Trees().fit(x[:1500], y[:1500])
    assert ((t.margin(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95
    a, b = quality.calibrate(t.margin(x[1500:]), y[1500:])
    assert a > 0 and abs(b) < 2


def test_holdout_accuracy():
    x, y = quality.holdout()
    weak = quality.weak_labels(x)
    assert len(y) >= 100 and 0.3 < y.mean() < 0.7
    assert (weak[weak >= 0] == y[weak >= 0]).mean() > 0.97
