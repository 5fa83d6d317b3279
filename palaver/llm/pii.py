"""Personal information inside free text: found, and replaced by typed placeholders.

Kinds: email, phone, id_number (passport, SNILS, a person's INN), address (a street with a house number), person (at least two parts of one
person's name side by side). Items count however written or dictated: number words are read as digits, spoken marks as signs, hesitation sounds
and invisible characters inside an item are passed over. A cheap automaton looks for triggers over the whole text; the patterns run only around those, in
windows that grow as long as the text goes on with what an item may hold, so that no item is cut.

Redaction keeps the rest of the text to the letter. Numbers become pseudonyms of their own format: their digits go through a keyed Feistel
permutation (with check digits worked out anew where the kind has them) and stand in the layout that the number had, so equal numbers, however written, stay linked across
documents and the key's holder can turn them back. Other kinds get a keyed tag, equal for equal values; a person's case, order and script don't count. Dates of birth and issue are
permuted too where the caller asks for it.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import names
from palaver.llm.batches import pieces

KINDS = ("email", "phone", "id_number", "address", "person")
NEAR = 90  # characters around a trigger that an item may reach
TAG = 32  # hex digits of a keyed tag: 128 bits, so that different values of any corpus have different tags

#: Number words.
UNITS = {w: i for i, w in enumerate("ноль один два три четыре пять шесть семь восемь девять".split())} | {"нуль": 0, "одна": 1, "две": 2}
TEENS = {w: 10 + i for i, w in enumerate("десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split())}
TENS = {w: 20 + 10 * i for i, w in enumerate("двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split())}
HUNDREDS = {w: 100 + 100 * i for i, w in enumerate("сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split())}
_NUM = "|".join(sorted([*UNITS, *TEENS, *TENS, *HUNDREDS], key=len, reverse=True))
_RUN = re.compile(rf"\b(?:плюс\s+)?(?:{_NUM})(?:[\s,]+(?:{_NUM}))+\b")

_HYPHENS = {c: "-" for c in map(ord, "‐‑‒–—−")}
_SPACES = {c: " " for c in map(ord, "       \t")}
_FLAT = [(chr(c), x) for c, x in (_HYPHENS | _SPACES).items()] + [("ё", "е"), ("Ё", "Е")]
_HIDDEN = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
_GAP = re.compile(r"\s{9}")
_SKIP = re.compile(rf"[{_HIDDEN}]|(?<=\s{{8}})\s+|,?\s*\bэ+-?э+(?:-э+)*м*\b,?")

_STREET = r"(?:улиц[аеуы]|ул\.?|переул(?:ок|ка|ке|ку)|пер\.?|проезд[аеу]?|пр-д|проспект[аеу]?|просп\.?|пр-т|шоссе|набережн(?:ая|ой|ую)|наб\.?|бульвар[аеу]?|б-р|площад[ьи]|пл\.|тупик[аеу]?|алле[яеию])"
_HOUSE = rf"(?:,?\s*(?:д\.?|дом[ау]?|№)\s*(?:\d|(?:{_NUM})\b)|,?\s*\d)"
_HOUSE_TAIL = r"\d*(?:\s?[/-]\s?\d+)?\s?(?:[абвгд]\b)?(?:,?\s?(?:к|корп|корпус|стр|строение|кв|квартира|оф|офис|подъезд)\.?\s?\d+)*"
_ADDR = [
    re.compile(rf"\b{_STREET}\s+[а-я][а-я-]{{2,}}(?:\s+[а-я][а-я-]{{2,}})?{_HOUSE}{_HOUSE_TAIL}", re.I),
    re.compile(rf"\b[а-я][а-я-]+(?:ая|ой|ую|ий|ый|ого|ому|ом|ое|ем)\s+{_STREET}{_HOUSE}{_HOUSE_TAIL}", re.I),
]
_MAIL = re.compile(r"[a-zа-я0-9][a-zа-я0-9._+-]*\s?(?:@|[\(\[]\s*(?:собака|at|эт|dog)\s*[\)\]])\s?[a-zа-я0-9-]+(?:\.[a-zа-я0-9-]+)+", re.I)
_W = r"[a-zа-я0-9_]+"
_SIGN = r"(?:точка|дефис|тире|минус|плюс|(?:нижнее\s+)?подчеркивание)"
_SPOKEN_MAIL = re.compile(rf"(?:[a-z0-9_]+|[a-zа-я0-9_]+(?=\s+(?:{_SIGN}|собака)\s))(?:\s+{_SIGN}\s+{_W})*\s+(?:собака|эт)\s+{_W}(?:\s+{_SIGN}\s+{_W})*?\s+точка\s+{_W}(?:\s+точка\s+{_W})*", re.I)
_PHONE = re.compile(r"(?<![\d+])(?<!\d[.-])(?:(?:\+\s?7|[78])[\s.-]{0,2}\(?[3489]\d\d\)?[\s.-]{0,2}\d{3}[\s.-]{0,2}\d\d[\s.-]{0,2}\d\d|\(?9\d\d\)?[\s.-]{1,2}\d{3}[\s.-]{0,2}\d\d[\s.-]{0,2}\d\d|9\d{9})(?![\d]|[-.]\d)(?:,?\s?доб\.?\s?\d+)?")
_FOREIGN = re.compile(r"(?<![\d+])\+(?!\s?7)[1-9]\d{0,2}(?:[\s.-]{0,2}\(?\d{1,4}\)?(?:[\s.-]{1,2}\d{2,8}){1,4}|\d{7,12})(?![\d]|[-.]\d)(?:,?\s?доб\.?\s?\d+)?")
_THOUSANDS = re.compile(r"\+\d{1,3}(?:[\s.]\d{3})+$")
_PASS = [
    re.compile(r"\bпаспорт[а-я]{0,3}(?:\s+рф|\s+гражданина\s+рф)?[\s:,]*(?:серия\s*)?\d\d\s?\d\d[\s,]*(?:№|номер|n)?\s*\d{6}(?!\d)", re.I),
    re.compile(r"\bсери[яию]\s*:?\s*\d\d\s?\d\d[\s,]*(?:№|номер|n)?\s*\d{6}(?!\d)", re.I),
    re.compile(r"(?<![\d-])\d\d\s?\d\d\s(?:№|номер)\s?\d{6}(?!\d)", re.I),
]
_SNILS = [re.compile(r"(?<![\d-])\d{3}-\d{3}-\d{3}[\s-]\d\d(?!\d)"), re.compile(r"\bснилс[\s:,№]*(\d{3}[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d\d)(?!\d)", re.I)]
_INN = re.compile(r"\bинн(?:\s+(?:физ\.?\s?лица|физлица|физического\s+лица))?[\s:,№]*(\d{12})(?!\d)", re.I)
_SPOKEN_ID = re.compile(rf"\b(?:паспорт[а-я]{{0,3}}(?:\s+рф)?|сери[яию]|снилс|инн(?:\s+физлица)?)[\s:,]+(?:серия\s+)?(?:(?:{_NUM}|номер)[\s,]+){{3,}}(?:{_NUM})\b", re.I)

_WORD = re.compile(r"[A-Za-zА-Яа-яЁё]+(?:-[A-Za-zА-Яа-яЁё]+)*")
_INITIALS_AFTER = re.compile(r"\b([А-Яа-я][а-я]{3,}|[А-Я]{4,})(?:-[А-Яа-я]+)?\s+[А-Яа-я]\.\s?(?:[А-Яа-я]\.)?(?!\s*\d)")
_INITIALS_BEFORE = re.compile(r"(?<![А-Яа-я.])[А-Яа-я]\.\s?(?:[А-Яа-я]\.\s?)?([А-Я][а-я]{3,}|[А-Я]{4,}|[а-я]{4,})\b")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    add = lambda w, k: a.add_word(w, (k, w))
    spaces, digits = [[c for c in map(chr, range(0x10000)) if is_(c)] for is_ in (str.isspace, str.isdecimal)]
    for w in ("@", "собака"):
        add(w, "email")
    for w in ("at", "эт", "dog"):
        for c in (")", "]", *spaces):
            add(w + c, "sign")
    for w in ("паспорт", "сери", "снилс", "инн"):
        add(w, "words")
    for c in spaces:
        add(f"{c}номер", "words")
    for w in ("семь", "девя"):  # what the first number word of a phone holds
        add(w, "spoken")
    for w in ("улиц", "переул", "проезд", "пр-д", "просп", "пр-т", "шоссе", "набережн", "бульвар", "б-р", "площад", "пл.", "тупик", "аллея", "аллее", "аллеи", "аллею"):  # `алле` is a form of a given name
        add(w, "address")
    for w in ("ул", "пер", "наб"):
        for c in (".", ",", "№", "д", *spaces, *digits):
            add(w + c, "address")
    for f in (*names.forms(), *names.latin_forms()):
        add(f, "given")
    for w in ("ович", "евич", "ьич", "иныч", "овн", "евн", "ичн"):
        add(w, "patronymic")
    a.make_automaton()
    return a


_AUTO = None
_DIGITS = re.compile(r"\d[\d\s().№-]{7,}\d")
_DOT = re.compile(r"(?<![а-я])[а-я]\.")
_LATIN = re.compile("[a-z]")
_MIXED = re.compile(r"(?<=[а-я])[a-z]|(?<=[a-z])[а-я]")
_AT = re.compile(r"\s?[\(\[]\s*(?:собака|at|эт|dog)\s*[\)\]]\s?|\sэт\s")
_NUMBER = frozenset([*UNITS, *TEENS, *TENS, *HUNDREDS])


def digits_of(words: str) -> str:
    """Number words as the digits that a dictated number means: hundreds, tens and units that can join do."""
    out, now, room = "", None, 0
    for w in re.findall(r"[а-я]+", words):
        v = HUNDREDS.get(w) or TENS.get(w) or TEENS.get(w) or UNITS.get(w)
        if v is None:
            continue
        size = 3 if v >= 100 else 2 if v >= 10 else 1
        joins = now is not None and now and ((room == 3 and (size == 2 or (size == 1 and v))) or (room == 2 and size == 1 and v))
        if joins:
            now += v
            room = 0 if size == 1 or 10 <= v < 20 else 2
        else:
            if now is not None:
                out += str(now)
            now, room = v, size if not (10 <= v < 20) and size > 1 else 0
    return out + (str(now) if now is not None else "")


def _lower(t: str) -> str:
    """Lower case of the same length."""
    low = t.lower()
    return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


_SIGNS = frozenset("точка дефис тире минус плюс нижнее подчеркивание собака эт".split())
_HOUSE_WORDS = "д дом дома дому к корп корпус стр строение кв квартира оф офис подъезд номер серия"
_AFTER = re.compile(rf"\S*(?:[\s,]+(?:(?:{'|'.join(_SIGNS)})\s+\S+|(?:{_NUM}|{_HOUSE_WORDS.replace(' ', '|')})(?!\w)\S*|№\S*|\S*\d\S*))*")


def _before(low: str, lo: int) -> int:
    """The start of the words around ``lo`` that belong to one dictated item: number words, digits, signs and what stands before a sign."""
    end = lo
    while lo > 0 and not low[lo - 1].isspace():
        lo -= 1
    while end < len(low) and not low[end].isspace():
        end += 1
    first = low[lo:end].strip(",.:;()")
    while True:
        b = lo
        while b > 0 and (low[b - 1].isspace() or low[b - 1] == ","):
            b -= 1
        a = b
        while a > 0 and not low[a - 1].isspace():
            a -= 1
        w = low[a:b].strip(",.:;()")
        if a == b or not (first in _SIGNS or w in _SIGNS or w in _NUMBER or any(map(str.isdigit, w))):
            return lo
        lo, first = a, w


def _windows(at: list[int] | list[tuple[int, int]], low: str, near: int = NEAR) -> list[tuple[int, int]]:
    """What lies near places or spans, a span as a whole, to the ends of the items that reach beyond; windows that meet are one."""
    n, out = len(low), []
    for a, b in sorted(p if isinstance(p, tuple) else (p, p) for p in at):
        if out and b + near <= out[-1][1]:
            continue
        lo, hi = max(0, a - near), min(n, b + near)
        lo, hi = _before(low, lo) if lo else 0, _AFTER.match(low, hi).end() if hi < n else n
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _clean(text: str) -> tuple[str, list[int] | None]:
    """The text without fillers and invisible characters, with spaces and dashes made plain, and where its characters came from."""
    flat = text
    for c, x in _FLAT:
        if c in flat:
            flat = flat.replace(c, x)
    low = _lower(flat)
    if not ("ээ" in low or "э-э" in low or any(c in flat for c in _HIDDEN) or _GAP.search(flat)):
        return flat, None
    keep, at, last = [], [], 0
    for m in _SKIP.finditer(low):
        keep.append(flat[last : m.start()])
        at += range(last, m.start())
        last = m.end()
    keep.append(flat[last:])
    at += range(last, len(flat))
    return "".join(keep), [*at, len(flat)]


def _capital(w: str) -> bool:
    return w[:1].isupper() and w[1:].islower()


def _persons(text: str, low: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    words = [(m.start() + lo, m.end() + lo, m.group()) for m in _WORD.finditer(text[lo:hi])]
    given, latin = names.forms(), names.latin_forms()
    n = len(words)

    def kind(i: int) -> str:
        w = names.plain(names.unmix(words[i][2]))
        if w in given:
            return "g"
        if names.is_patronymic(w):
            return "p"
        if w.isascii():
            return "G" if w in latin else "S" if names.is_latin_surname(w) else ""
        if names.is_surname(w):
            return "s"
        return "i" if len(w) == 1 else ""

    kinds = [kind(i) for i in range(n)]

    def beside(i: int, j: int) -> bool:
        gap = text[words[i][1] : words[j][0]]
        if not gap or gap.strip() or len(gap) > 3 or "\n\n" in gap:
            return False
        a, b = words[i][2], words[j][2]
        return not ((_capital(a) and b[0].islower()) or (_capital(b) and a[0].islower()))

    i = 0
    while i < n:
        j = i
        parts = kinds[i]
        if parts and parts in "gpsGS":
            while j + 1 < n and kinds[j + 1] and kinds[j + 1] in "gpsGS" and beside(j, j + 1) and j - i < 2:
                nxt = kinds[j + 1]
                if any(nxt in same and set(same) & set(parts) for same in ("gG", "sS", "p")) or (nxt in "GS") != (parts[-1] in "GS"):
                    break
                if parts == "s" and nxt in "gp" and not names.agree(low[words[j][0] : words[j][1]], low[words[j + 1][0] : words[j + 1][1]]):
                    break
                j += 1
                parts += kinds[j]
            if len(parts) > 1 and ("g" in parts or "p" in parts or "G" in parts):
                yield words[i][0], words[j][1]
                i = j + 1
                continue
            if parts == "g" and i + 1 < n and kinds[i + 1] == "i" and text[words[i + 1][1] : words[i + 1][1] + 1] == "." and beside(i, i + 1):
                if not re.match(r"\.\s*\d", text[words[i + 1][1] :]):
                    yield words[i][0], words[i + 1][1] + 1
                    i += 2
                    continue
        i += 1


_PATR_END = re.compile(r"(ович|евич|ьич|иныч|овн|евн|ичн)(?:а|у|ем|ом|е|ы|ой)?$")
_SUR_END = re.compile(r"(?:((?:ов|ев|ин|ын))(?:а|у|ым|ом|е|ой|ы|ою)?|(ск|цк)(?:ий|ая|ого|ой|ому|ую|им|ом))$")


@lru_cache(maxsize=100_000)
def person_key(said: str) -> str:
    """A person's name without case, order, gender endings and script: given name (in full where its short form has one), patronymic, then the other parts."""
    given, patr, rest = [], [], []
    for raw in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", said.lower()):
        w = names.plain(names.unmix(raw))
        base = names.forms().get(w) or names.latin_forms().get(w)
        if base is not None:
            fulls = names.full_names().get(base, {base})
            given.append(names.to_latin(next(iter(fulls)) if len(fulls) == 1 else base))
        elif names.is_patronymic(w):
            patr.append(names.to_latin(_PATR_END.sub(r"\1", w)))
        elif w.isascii():
            rest.append(re.sub(r"(?<=ov|ev|in|yn)a$", "", w) if len(w) > 4 else w)
        else:
            rest.append(names.to_latin(_SUR_END.sub(lambda m: m.group(1) or m.group(2), w)))
    return " ".join([*sorted(given), *sorted(patr), *sorted(rest)])


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the items of a text, in order and without overlaps; value is the item in a plain form (digits for numbers)."""
    global _AUTO
    if not text:
        return []
    if _AUTO is None:
        _AUTO = _automaton()
    t, back = _clean(text)
    low = _lower(t)
    n = len(t)
    hits: dict[str, list[int]] = {}
    for end, (k, w) in _AUTO.iter(low):
        if k == "given":
            a = end - len(w)
            if (a >= 0 and low[a].isalpha()) or (end + 1 < n and low[end + 1].isalpha()):
                continue
            k = "person"
        elif k == "patronymic":
            k = "person"
        elif k == "sign":
            if not _sign(low, end + 1 - len(w), end):
                continue
            k = "email"
        hits.setdefault(k, []).append(end)
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []

    def put(a: int, b: int, kind: str, value: str) -> None:
        i = bisect(taken, (a, b))
        if (not i or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            taken.insert(i, (a, b))
            found.append((a, b, kind, value))

    for lo, hi in _windows(hits.get("email", []), low):
        for rx in (_MAIL, _SPOKEN_MAIL):
            for m in rx.finditer(low, lo, hi):
                v = re.sub(r"\s+", " ", _AT.sub("@", m.group()))
                for word, sign in (("нижнее подчеркивание", "_"), ("подчеркивание", "_"), ("собака", "@"), ("точка", "."), ("дефис", "-"), ("тире", "-"), ("минус", "-"), ("плюс", "+")):
                    v = re.sub(rf"\s?[\(\[]?\s?\b{word}\b\s?[\)\]]?\s?", sign, v)
                put(m.start(), m.end(), "email", v.replace(" ", ""))
    nums = [m.span() for m in _DIGITS.finditer(low)]
    spots = [*((p, p + NEAR) for p in hits.get("words", [])), *nums]
    for lo, hi in _windows(spots, low):
        for rx in (*_PASS, *_SNILS, _INN):
            for m in rx.finditer(low, lo, hi):
                put(m.start(), m.end(), "id_number", re.sub(r"\D", "", m.group()))
        for m in _SPOKEN_ID.finditer(low, lo, hi):
            d = digits_of(m.group())
            if len(d) >= 8:
                put(m.start(), m.end(), "id_number", d)
    for lo, hi in _windows(nums, low, 40):
        for m in _PHONE.finditer(low, lo, hi):
            d = re.sub(r"\D", "", m.group().split("доб")[0])
            put(m.start(), m.end(), "phone", d[-10:])
        for m in _FOREIGN.finditer(low, lo, hi):
            said = m.group().split("доб")[0].rstrip(" ,")
            d = re.sub(r"\D", "", said)
            if 9 <= len(d) <= 15 and not _THOUSANDS.match(said):
                put(m.start(), m.end(), "phone", d if len(d) > 10 else f"+{d}")
    for m in _spoken_runs(low, hits.get("spoken", [])):
        for a, b, d in _spoken_phones(m):
            put(a, b, "phone", d[-10:])
    for lo, hi in _windows(hits.get("address", []), low):
        for rx in _ADDR:
            for m in rx.finditer(low, lo, hi):
                put(m.start(), m.end(), "address", re.sub(r"[\s.,]+", " ", m.group()).strip())
    if not low.isascii() and _LATIN.search(low):  # letters of both scripts in a word: no form of a name is seen in it as it stands
        hits.setdefault("person", []).extend(m.start() for m in _MIXED.finditer(low))
    for lo, hi in _windows(hits.get("person", []), low):
        while lo > 0 and low[lo - 1].isalpha():
            lo -= 1
        while hi < n and low[hi].isalpha():
            hi += 1
        for a, b in _persons(t, low, lo, hi):
            put(a, b, "person", person_key(low[a:b]))
    dots = [m.start() for m in _DOT.finditer(low)]
    for lo, hi in _windows(dots, low, 40):
        while lo > 0 and low[lo - 1].isalpha():
            lo -= 1
        for rx in (_INITIALS_AFTER, _INITIALS_BEFORE):
            for m in rx.finditer(t, lo, hi):
                w = m.group(1)
                if names.is_surname(names.plain(names.unmix(w))) and (w[0].isupper() or t[m.start() : m.end()].islower()):
                    put(m.start(), m.end(), "person", person_key(low[m.start() : m.end()]))
    found.sort()
    if back is not None:
        found = [(back[a], back[b - 1] + 1, k, v) for a, b, k, v in found]
    return found


def _sign(low: str, a: int, end: int) -> bool:
    """Whether a written-out at sign stands in brackets, or a bare `эт` between spaces, as in a dictated mail."""
    i = a - 1
    while i >= 0 and low[i].isspace():
        i -= 1
    return i >= 0 and (low[i] in "([" or (low[a:end] == "эт" and i < a - 1 and low[end].isspace()))


def _spoken_runs(low: str, at: list[int]) -> Iterator[re.Match]:
    """The whole runs of number words that hold these places, with a `плюс` before them."""
    done = -1
    for p in at:
        if p < done:
            continue
        lo = p
        while lo > 0 and low[lo - 1].isalpha():
            lo -= 1
        while True:
            b = lo
            while b > 0 and (low[b - 1] == "," or low[b - 1].isspace()):
                b -= 1
            a = b
            while a > 0 and low[a - 1].isalpha():
                a -= 1
            if a == b or b == lo or low[a:b] not in _NUMBER:
                break
            lo = a
        if low[a:b] == "плюс" and b < lo and "," not in low[b:lo]:
            lo = a
        if m := _RUN.match(low, lo):
            done = m.end()
            yield m


def _is_phone(digits: str, said: str) -> bool:
    n = len(digits)
    return (n == 11 and bool(re.match("[78][3489]", digits))) or (n == 10 and digits[0] == "9") or (9 <= n <= 11 and bool(re.match(r"(?:плюс\s+семь|восемь)\s+девятьсот", said)))


def _spoken_phones(m: re.Match) -> list[tuple[int, int, str]]:
    """The phones of a run of number words: the run as one phone, or phones one after another that make up all of it; else none."""
    said = m.group()
    d = digits_of(said)
    if len(d) <= 11:
        return [(m.start(), m.end(), d)] if _is_phone(d, said) else []
    words, out, i = [w.span() for w in re.finditer("[а-я]+", said)], [], 0
    while i < len(words):
        best = None
        for j in range(i + 4, len(words) + 1):
            part = said[words[i][0] : words[j - 1][1]]
            d = digits_of(part)
            if len(d) > 11:
                break
            if (len(d) == 11 and re.match("[78][3489]", d)) or (len(d) == 10 and d[0] == "9"):
                best = (j, d)
        if best is None:
            return []
        out.append((m.start() + words[i][0], m.start() + words[best[0] - 1][1], best[1]))
        i = best[0]
    return out


def kinds(text: str | None) -> list[str]:
    return sorted({k for *_, k, _ in find(text)})


def feistel(digits: str, key: bytes, tweak: str = "", back: bool = False, rounds: int = 8) -> str:
    """A keyed permutation of the digit strings of one length (two or more digits; one digit is shifted)."""
    n = len(digits)
    if n < 2:
        s = int.from_bytes(hmac.new(key, f"{tweak}|1".encode(), hashlib.sha256).digest()[:4], "big") % 10
        return str((int(digits) + (-s if back else s)) % 10) if digits else digits
    u = n // 2
    a, b = int(digits[:u]), int(digits[u:])
    size = (10**u, 10 ** (n - u))

    def f(i: int, x: int, m: int) -> int:
        return int.from_bytes(hmac.new(key, f"{tweak}|{n}|{i}|{x}".encode(), hashlib.sha256).digest()[:16], "big") % m

    for i in reversed(range(rounds)) if back else range(rounds):
        s = -1 if back else 1
        if i % 2 == 0:
            a = (a + s * f(i, b, size[0])) % size[0]
        else:
            b = (b + s * f(i, a, size[1])) % size[1]
    return f"{a:0{u}d}{b:0{n - u}d}"


def feistel_date(d: date, key: bytes, back: bool = False) -> date:
    """A keyed permutation of the days from 1900 to 2099, by walking along the Feistel cycle until it is back in range."""
    first, n = date(1900, 1, 1), 73_049
    x = f"{(d - first).days:05d}"
    while True:
        x = feistel(x, key, "date", back)
        if int(x) < n:
            return first + timedelta(int(x))


def snils_check(body: str) -> str:
    s = sum(int(c) * (9 - i) for i, c in enumerate(body))
    return f"{s % 101 % 100:02d}"


def inn_check(body: str) -> str:
    a = sum(int(c) * w for c, w in zip(body, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), strict=True)) % 11 % 10
    b = sum(int(c) * w for c, w in zip(body + str(a), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8), strict=True)) % 11 % 10
    return f"{a}{b}"


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """What stands for a value: permuted digits for numbers (valid check digits stay valid), a keyed tag for the rest."""
    if kind == "phone" and value.lstrip("+").isdigit():
        plus, v = value[: value.startswith("+")], value.lstrip("+")
        return plus + v[0] + feistel(v[1:], key, "phone")
    if kind == "id_number" and value.isdigit():
        if len(value) == 11:
            body = feistel(value[:9], key, "snils")
            return body + (snils_check(body) if value[9:] == snils_check(value[:9]) else feistel(value[9:], key, "snils2"))
        if len(value) == 12:
            body = feistel(value[:10], key, "inn")
            return body + (inn_check(body) if value[10:] == inn_check(value[:10]) else feistel(value[10:], key, "inn2"))
        return feistel(value, key, "id")
    return hmac.new(key, f"{kind}|{value}".encode(), hashlib.sha256).hexdigest()[:TAG]


_NUMBER_STARTS = re.compile(rf"[+(]*\d|\b(?:плюс\s+)?(?:{_NUM})\b", re.I)
_DATED = re.compile(r"\b(?:род(?:ил(?:ся|ась)|\.|ивш)|рожд|выдан|выдач|г\.\s?р\.)", re.I)
_DATE = re.compile(r"(?<![\d.])(\d\d)([./-])(\d\d)\2((?:19|20)\d\d)(?![\d]|[./-]\d)")


def _dates(text: str, key: bytes) -> list[tuple[int, int, str]]:
    """(start, end, new) of the first date after a word of birth or issue, within NEAR characters, and of the one right before such a word; days that don't exist are none."""
    if not _DATED.search(text):
        return []
    found = list(_DATE.finditer(text))
    at = [m.start() for m in found]
    near = {at[i] for m in _DATED.finditer(text) if (i := bisect(at, m.start())) < len(at) and at[i] - m.start() <= NEAR and text[m.start()] not in "гГ"}
    near |= {at[i - 1] for m in _DATED.finditer(text) if (i := bisect(at, m.start())) and m.start() - found[i - 1].end() <= 3}
    out = []
    for m in found:
        if m.start() in near:
            try:
                d = feistel_date(date(int(m.group(4)), int(m.group(3)), int(m.group(1))), key)
            except ValueError:
                continue
            out.append((m.start(), m.end(), f"{d.day:02d}{m.group(2)}{d.month:02d}{m.group(2)}{d.year}"))
    return out


def _shown(item: str, kind: str, code: str, key: bytes) -> tuple[str, str]:
    """What stays before a number (the words that announce it), and its pseudonym in the layout that the number had; an extension is permuted by itself."""
    start = m.start() if kind != "phone" and (m := _NUMBER_STARTS.search(item)) else 0
    head, body = item[:start], item[start:]
    cut = body.lower().find("доб")
    body, ext = (body, "") if cut < 0 else (body[:cut], body[cut:])
    ext = re.sub(r"\d+", lambda m: feistel(m.group(), key, "ext"), ext)
    plain, new = [c for c in body if c.isdecimal()], code.lstrip("+")
    if not plain or len(plain) < len(new):
        return head, f"{code} {ext}".strip() if ext else code
    put = iter(plain[: len(plain) - len(new)] + list(new))  # a country code before the number stays
    return head, "".join(next(put) if c.isdecimal() else c for c in body) + ext


def redact(text: str | None, key: bytes, dates: bool = False) -> str | None:
    """The text with each item replaced by `[KIND pseudonym]`; null stays null, a text without items stays as it is. With ``dates`` days of birth and issue are permuted within their format."""
    if not text:
        return text
    spots = [(a, b, kind, value) for a, b, kind, value in find(text)]
    if dates:
        spots += [(a, b, "", new) for a, b, new in _dates(text, key) if all(b <= x or y <= a for x, y, *_ in spots)]
    out, last = [], 0
    for a, b, kind, value in sorted(spots):
        out.append(text[last:a])
        if not kind:
            out.append(value)
        elif kind in ("phone", "id_number"):
            head, code = _shown(text[a:b], kind, pseudonym(kind, value, key), key)
            out.append(f"{head}[{kind.upper()} {code}]")
        else:
            out.append(f"[{kind.upper()} {pseudonym(kind, value, key)}]")
        last = b
    return "".join([*out, text[last:]])


def items(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, kind: one row per row and kind of item in it. Null and empty texts have none; repeated rows give repeated rows."""
    schema = pa.schema([("i", pa.int32()), ("kind", pa.string())])
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [(i, k) for i, t in enumerate(batch.column(len(keys)).to_pylist()) for k in kinds(t)]
            got = pa.RecordBatch.from_pylist([{"i": i, "kind": k} for i, k in rows], schema=schema)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(got.column("i")) for c in range(len(keys))), got.column("kind")], names=[*keys, "kind"])

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, f"{ddl}, kind string")


def redacted(df: DataFrame, keys: list[str], text: str, key: bytes, name: str = "redacted", dates: bool = False) -> DataFrame:
    """keys and the redacted text of every row. The key is a secret of at least 16 bytes."""
    if len(key) < 16:
        raise ValueError("a key of at least 16 bytes is needed")
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = pa.array([redact(t, key, dates) for t in batch.column(len(keys)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keys))), out], names=[*keys, name])

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, f"{ddl}, `{name}` string")
