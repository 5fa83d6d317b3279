"""Text functions over columns. Null in gives null out unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript counts it.
SPACE = r"[ \t\n\x0B\f\r   -     　﻿]"
#: Corrections of the recogniser's usual errors, in order.
CORRECTIONS = [("окей google", ""), ("окей гугл", ""), ("алиса", ""), ("сири", ""), ("айфон", ""), ("часища", "часть"), ("курочки", ""), ("порно", "")]
#: Words that alone make a phrase noise.
NOISE = ["угу", "ага", "эм", "эээ", "ну", "вот", "это", "так"]
#: Fixed value: placeholder strings that mean nothing was said.
JUNK = r"^(null|нет(\s.*)?|не\s+(было|указано|определено|найдено|заданы?).*|отсутствует.*)$"
#: Words that open a phrase like a name does.
ADDRESS_STOP = [
    "хорошо", "ладно", "ясно", "понятно", "итак", "значит", "короче", "кстати", "слушай", "слушайте", "смотри", "смотрите", "ну", "да", "нет", "так", "ок", "окей",
    "стоп", "погоди", "подожди", "секунду", "момент", "внимание", "вопрос", "возможно", "наверное", "например", "собственно", "вообще", "естественно", "конечно",
    "точно", "отлично", "супер", "класс", "круто", "всё", "все", "давайте", "давай", "пожалуйста", "пойдем", "пойдём", "сделаем", "смех", "аналогично", "получается",
    "соответственно", "правильно", "позвонил", "устранять", "мониторинг", "обследование",
]
#: Month names in the nominative and the genitive.
MONTHS = ["январь января", "февраль февраля", "март марта", "апрель апреля", "май мая", "июнь июня", "июль июля", "август августа", "сентябрь сентября", "октябрь октября", "ноябрь ноября", "декабрь декабря"]
#: Letters to Latin for slugs.
SLUG = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}


def words(t: Column) -> Column:
    return F.filter(F.split(t, SPACE + "+"), lambda w: w != "")


def word_count(t: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.size(words(t)), F.lit(0))


def collapse(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, SPACE + "+", " "))


def correct(t: Column, intended: bool = False) -> Column:
    """Recogniser corrections, then single spaces; null becomes ''.

    By default a correction needs an ASCII word character on the other side of each border, which is what the ASCII word boundary demands beside a
    Cyrillic letter, so ordinary Cyrillic text stays as it is; ``intended`` takes Unicode word boundaries."""
    out = F.coalesce(t, F.lit(""))
    for bad, good in CORRECTIONS:
        if intended:
            out = F.regexp_replace(out, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){bad}(?![\p{{L}}\p{{N}}_])", good)
        else:
            first = "(?<![A-Za-z0-9_])" if bad[0].isascii() else "(?<=[A-Za-z0-9_])"
            last = "(?![A-Za-z0-9_])" if bad[-1].isascii() else "(?=[A-Za-z0-9_])"
            out = F.regexp_replace(out, f"(?iu){first}{bad}{last}", good)
    return collapse(out)


def is_noise(t: Column) -> Column:
    """No word at all, or at most three words of which each is a noise marker."""
    w = words(F.lower(F.coalesce(t, F.lit(""))))
    return (F.size(w) <= 3) & F.forall(w, lambda x: x.isin(NOISE))


def is_junk(t: Column) -> Column:
    """Null, blank, or a placeholder for nothing."""
    s = F.lower(F.trim(F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")))
    return t.isNull() | (s == "") | s.rlike(JUNK)


def name_key(t: Column) -> Column:
    return F.translate(F.lower(t), "ё", "е")


def slug(t: Column) -> Column:
    """Latin slug: letters mapped, anything else to single hyphens, none at the ends."""
    s = F.lower(F.trim(t))
    s = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), SLUG.items(), s)
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def grams(t: Column, n: int = 3) -> Column:
    """Distinct n-grams of the lower-cased text whose signs are spaces and whose spaces are single; shorter texts and nulls have none."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    at = F.sequence(F.lit(1), F.length(s) - (n - 1))
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(at, lambda i: F.substr(s, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """2 * shared / (size a + size b) of two gram sets; 0 if either is empty."""
    n = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def entities(t: Column) -> Column:
    """Distinct capitalised words, capital abbreviations and numbers of two or more digits, after the first word; in lower case."""
    w = F.transform(F.filter(words(t), lambda _, i: i > 0), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}-]", ""))
    keep = F.filter(w, lambda x: x.rlike("^[А-ЯЁ][а-яё]+(-[А-ЯЁ]?[а-яё]+)?$") | x.rlike("^[А-ЯЁ]{2,}$") | x.rlike("^[0-9]{2,}$"))
    return F.array_distinct(F.transform(keep, lambda x: F.lower(x)))


def line_id(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"^\s*\[(\d+)\]", 1), F.lit("")).try_cast("int")


def line_body(line: Column) -> Column:
    """What follows `[N]`, without a `Спикер N:` before it."""
    body = F.trim(F.regexp_extract(line, r"^\s*\[\d+\]\s*(.*)$", 1))
    return F.trim(F.regexp_replace(body, r"(?iu)^спикер\s*\d+\s*:\s*", ""))


def labelled(line: Column) -> tuple[Column, Column]:
    """(label, text) of `Label: text`, the label being at most 50 characters up to the last colon in them; null and the line itself otherwise."""
    rx = r"^(.{1,50}):\s*(.+)$"
    has = line.rlike(rx)
    return F.when(has, F.trim(F.regexp_extract(line, rx, 1))), F.when(has, F.trim(F.regexp_extract(line, rx, 2))).otherwise(F.trim(line))


def addressed_name(t: Column) -> Column:
    """The name that a whole phrase calls, or null."""
    s = F.trim(t)
    n = F.nullif(F.regexp_extract(s, r"^([А-ЯЁ][а-яё]{1,20})[?!.]?$", 1), F.lit(""))
    return F.when(~F.lower(n).isin(ADDRESS_STOP) & ~F.lower(n).rlike("(ск|бург|град|поль|полье)$"), n)


def unfence(t: Column) -> Column:
    """Without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def json_object(t: Column) -> Column:
    """The first candidate that parses as JSON: the text, the text without its fence, its first `{...}`, its first `[...]`; null if none does."""
    s = unfence(t)
    inner = [F.nullif(F.regexp_extract(s, rx, 1), F.lit("")) for rx in (r"(?s)(\{.*\})", r"(?s)(\[.*\])")]
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(ok(t), ok(s), *map(ok, inner))


#: Fixed value: a whole flat object of an answer with an id and, after it, a guessed name.
FLAT_DRAFT = r'(\{[^{}]*"id"[^{}]*"guessedName"[^{}]*\})'


def salvaged_drafts(t: Column) -> Column:
    """Array of (id, label, guessedName): the whole flat objects of a cut-off answer that have an id and a label and mention a guessed name after the id; null gives an empty array."""
    flat = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(FLAT_DRAFT), 1)
    rows = F.transform(flat, lambda x: F.from_json(x, "id string, label string, guessedName string"))
    return F.filter(rows, lambda r: r.isNotNull() & (r["id"] != "") & (r["label"] != ""))


def scoring_form(t: Column) -> Column:
    """Lower case, ё as е, without `Label: ` at line starts and signs, single spaces."""
    s = F.translate(F.lower(F.coalesce(t, F.lit(""))), "ё", "е")
    s = F.regexp_replace(s, r"(?m)^[^\n:]{1,32}:\s", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-zа-я0-9\s-]", " "), r"\s+", " "))


def future_deadline(deadline: Column, meeting_date: Column) -> Column:
    """An ISO date, or a day and month without a year, moved to its nearest date that isn't before the meeting; other texts stay. Impossible days keep their number."""
    month_of = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for w in m.split() for x in (w, i)])
    rx = r"(?iu)(\d{1,2})(?:-?(?:го|ого|му|е))?\s+(" + "|".join(w for m in MONTHS for w in m.split()) + ")(?![а-яё])"
    iso = deadline.rlike(r"^\d{4}-\d{2}-\d{2}$")
    spoken = ~deadline.rlike(r"(?<![A-Za-z0-9_])(19|20)\d{2}(?![A-Za-z0-9_])") & deadline.rlike(rx)
    day = F.when(iso, F.substring(deadline, 9, 2)).otherwise(F.regexp_extract(deadline, rx, 1)).try_cast("int")
    month = F.when(iso, F.substring(deadline, 6, 2).try_cast("int")).otherwise(F.try_element_at(month_of, F.lower(F.regexp_extract(deadline, rx, 2))))
    base = F.to_date(meeting_date)
    first = F.add_months(F.make_date(F.year(base), F.lit(1), F.lit(1)), month - 1)
    year = F.year(base) + (F.date_add(first, day - 1) < base).cast("int")
    fixed = F.format_string("%d-%02d-%02d", year, month, day)
    return F.when(base.isNotNull() & (iso | spoken) & fixed.isNotNull() & month.isNotNull() & day.isNotNull(), fixed).otherwise(deadline)


def timecode(ms: Column) -> Column:
    """m:ss, with hours from one hour on; null and negative as 0:00."""
    s = F.floor(F.greatest(F.coalesce(ms, F.lit(0)), F.lit(0)) / 1000)
    h, m, x = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, x)).otherwise(F.format_string("%d:%02d", m, x))


def key_variant(key: Column, kind: str) -> Column:
    """`x.json` as `x.<kind>.json`; other keys stay."""
    return F.regexp_replace(key, r"\.json$", f".{kind}.json")


def palette_slot(first_seen: Column, size: int = 8) -> Column:
    """The colour slot of the n-th person seen (from 0)."""
    return (first_seen % size).cast("int")


def name_slot(t: Column, size: int = 8) -> Column:
    """The slot of a name that wasn't seen: the sum of its code points, modulo the palette."""
    return (F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c)) % size).cast("int")


def initials(t: Column) -> Column:
    """The capital first letter of the first word, or of the only one."""
    return F.upper(F.substring(F.trim(t), 1, 1))
