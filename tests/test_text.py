"""Text functions against literal vectors."""

import pytest
from pyspark.sql import functions as F

from palaver.functions import numbers, text as X


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("шаг двести, по факту 250", [200, 250]), ("м триста пятьдесят", [350]), ("М350 и КС-2", [2, 350]), ("до двадцатого июня", [20]), ("до двадцать первого июня", [21]),
        ("один миллион восемьсот тысяч", [1800000]), ("без чисел вообще", []), (None, []), ("", []),
    ],
)
def test_numbers(text, values):
    assert numbers.numbers_in(text) == values


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("м триста пятьдесят заказан", "М350 заказан", True), ("ка эс два передали", "КС-2 передали", True), ("придут в четверг к семи утра", "Придут в четверг к семи утра.", True),
        ("кс три до двадцатого июня", "КС-3 до двадцать первого июня", False), ("аванс десять процентов", "аванс согласован", False), ("бетон заказан", "бетон М350 заказан", False),
    ],
)
def test_numbers_preserved(spark, a, b, same):
    assert one(spark, numbers.numbers_preserved, a, b) is same


def test_junk(spark):
    for v, junk in [(None, True), ("", True), (" ", True), ("null", True), ("Нет решений", True), ("не указано", True), ("не согласовано техзадание", False), ("нетто", False), ("Отсутствует", True)]:
        assert one(spark, X.is_junk, v) is junk


def test_corrections(spark):
    assert one(spark, X.correct, "скажи алиса пожалуйста") == "скажи алиса пожалуйста"
    assert one(spark, lambda c: X.correct(c, intended=True), "скажи алиса пожалуйста") == "скажи пожалуйста"
    assert one(spark, X.correct, None) == ""


def test_noise(spark):
    for v, noise in [(None, True), ("", True), ("Угу ага", True), ("угу ага ну так", False), ("угу да", False)]:
        assert one(spark, X.is_noise, v) is noise


def test_slug_and_lines(spark):
    assert one(spark, X.slug, " Еженедельный продуктовый ") == "ezhenedelnyy-produktovyy"
    assert one(spark, X.line_id, "[2] Спикер 2: Вторая") == 2
    assert one(spark, X.line_body, "[2] Спикер 2: Вторая") == "Вторая"
    assert one(spark, X.line_id, "мусорная строка") is None
    assert one(spark, lambda c: X.labelled(c)[0], "Иванов: Привет") == "Иванов"
    assert one(spark, lambda c: X.labelled(c)[1], "Иванов: Привет: да") == "да"


def test_grams_and_dice(spark):
    d = lambda a, b: one(spark, lambda x, y: X.dice(X.grams(x), X.grams(y)), a, b)
    assert round(d("Александр", "Александр Ильин"), 3) == 0.7
    assert d("ab", "ab") == 0.0
    assert d(None, "abc") == 0.0
    assert round(d("Завершить договор по Якутии 11 МКД до четверга", "Довести договор по Якутии 11 МКД до четверга"), 3) == 0.819


def test_addressed(spark):
    for v, name in [("Наталья", "Наталья"), ("Настя, ты где", None), ("Мурманск", None), ("Хорошо", None), (None, None)]:
        assert one(spark, X.addressed_name, v) == name


def test_deadline(spark):
    f = lambda v: one(spark, lambda c: X.future_deadline(c, F.lit("2026-05-10").cast("date")), v)
    assert [f("2023-06-02"), f("до 2 мая"), f("до 2 июня 2027"), f("конец недели"), f(None), f("31-го февраля")] == ["2026-06-02", "2027-05-02", "до 2 июня 2027", "конец недели", None, "2027-02-31"]


def test_json_and_scoring_form(spark):
    assert one(spark, X.json_object, '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, X.json_object, 'слово {"a": 1} слово') == '{"a": 1}'
    assert one(spark, X.json_object, "{") is None
    assert one(spark, X.scoring_form, "Спикер 1: Ёлка, да!") == "елка да"
    assert one(spark, lambda c: X.timecode(c.cast("long")), "3661000") == "1:01:01"


def test_entities_of_a_very_long_text(spark):
    t = "слово " * 100_005 + "Ольховка и 125"
    assert sorted(one(spark, X.entities, t)) == ["125", "ольховка"]
    assert one(spark, X.entities, "Ольховка") == [] and one(spark, X.entities, "") == [] and one(spark, X.entities, None) is None


def test_cut_off_answers_are_salvaged(spark):
    raw = '[{"id": "speaker-1", "label": "Спикер 1", "guessedName": "Артем"}, {"id": "speaker-2", "label": "Спикер 2", "guessedName": null}, {"id": "", "label": "x", "guessedName": "y"}, {"id": "speaker-3", "gue'
    df = spark.createDataFrame([(raw,), (None,), ("{}",)], "t string").select(X.salvaged_drafts(F.col("t")).alias("d"))
    assert [[tuple(x) for x in r.d] for r in df.collect()] == [[("speaker-1", "Спикер 1", "Артем"), ("speaker-2", "Спикер 2", None)], [], []]
    assert one(spark, X.json_object, "ответ: [1, 2] вот") == "[1, 2]"


def test_numbers_of_any_length():
    assert numbers.numbers_in("9" * 50 + " и " + "1" * 5000)[0] == int("9" * 50)
