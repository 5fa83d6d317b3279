"""Russian personal names: short forms, cases, patronymics, surnames, transliteration."""

from __future__ import annotations

import re
from functools import lru_cache

#: Given names (ё written as е) with their short and pet forms.
GIVEN = {
    "александр": "саша саня сашка шура алекс", "алексей": "леша леха алеша", "анатолий": "толя толик", "андрей": "андрюша", "антон": "антоша тоха",
    "артем": "тема темыч артемка тем", "артур": "", "борис": "боря", "вадим": "вадик", "валерий": "валера", "василий": "вася", "виктор": "витя",
    "виталий": "виталик", "владимир": "вова володя вован вовка", "владислав": "влад владик", "вячеслав": "слава славик", "геннадий": "гена", "георгий": "гоша жора",
    "глеб": "", "григорий": "гриша гриня", "даниил": "даня данил данила", "денис": "дэн", "дмитрий": "дима митя димка димон", "евгений": "женя", "егор": "егорка", "иван": "ваня",
    "игорь": "игорек гарик", "илья": "илюша", "кирилл": "кир", "константин": "костя костик", "лев": "лева", "леонид": "леня", "максим": "макс", "марк": "", "матвей": "мотя",
    "михаил": "миша мишка мишаня", "никита": "", "николай": "коля колян никола", "олег": "олежа", "павел": "паша", "петр": "петя петруха петька", "роман": "рома ромка", "руслан": "",
    "семен": "сема", "сергей": "сережа серега", "станислав": "стас", "степан": "степа", "тимофей": "тима тимоха тимоша", "тимур": "", "федор": "федя федька", "эдуард": "эдик", "юрий": "юра",
    "алена": "", "алина": "", "алла": "", "анастасия": "настя ася настена настюша", "анна": "аня нюра анюта", "валентина": "валя", "варвара": "варя", "вера": "", "вероника": "ника",
    "виктория": "вика", "галина": "галя", "дарья": "даша дарина дашка", "евгения": "", "екатерина": "катя катюша катерина", "елена": "лена леночка алена", "елизавета": "лиза", "жанна": "", "зоя": "",
    "инна": "", "ирина": "ира иришка", "кристина": "", "ксения": "ксюша ксеня ксюха", "лариса": "лара", "любовь": "люба", "людмила": "люда мила люся", "маргарита": "рита",
    "марина": "", "мария": "маша маруся маня мария машка", "надежда": "надя", "наталья": "наташа ната наталия наташка", "нина": "", "оксана": "", "ольга": "оля олечка", "полина": "поля полинка",
    "светлана": "света светик", "софья": "соня софия", "таисия": "тая", "тамара": "тома", "татьяна": "таня танюша татьянка", "ульяна": "уля", "юлия": "юля", "яна": "",
}

_PATRO = re.compile(r"(?:ович|евич|ьич|иныч|ильич|овн|евн|иничн|ичн)(?:а|у|ем|ом|е|ы|ой)?$")
_SURNAME = re.compile(r"(?:(?:ов|ев|ин|ын)(?:а|у|ым|ом|е|ой|ы|ою)?|(?:енк|ейк|ичк)о|чук|юк|(?:ск|цк)(?:ий|ая|ого|ой|ому|ую|им|ом))$")
_LATIN_SURNAME = re.compile(r"(?:ov|ev|in|yn)a?$|enko$|sk(?:iy|y|aya|ii)$|chuk$")
#: Words that end like surnames and may follow a name.
NO_SURNAMES = frozenset("готов готова здоров нов нова такова слова снова основа половина причина машина один одна магазин картина часов метров домов вопросов слов планов столов сначала основной новой старой дин наедине".split())

#: Plurals in the genitive that end like surnames and may stand before a name.
PLURALS = frozenset("процентов листов кубов поддонов праздников рисков маршрутов доступов документов участков объектов подъездов этажей складов отчетов актов договоров проектов заказов контрактов замечаний вопросов пунктов планов сроков дней месяцев годов часов метров литров рублей миллионов миллиардов градусов человек подрядчиков заказчиков поставщиков рабочих мастеров монтажников инженеров инвесторов голосов файлов серверов датчиков насосов кранов лифтов щитов кабелей окон стеклопакетов узлов чертежей расчетов протоколов журналов паспортов макетов сценариев перечней графиков счетов столбов блоков корпусов цехов".split())


def plain(word: str) -> str:
    return word.lower().replace("ё", "е")


def cases(name: str) -> set[str]:
    """The forms of a name in the singular cases."""
    if name == "петр":
        return {"петр", "петра", "петру", "петром", "петре"}
    if name == "лев":
        return {"лев", "льва", "льву", "львом", "льве"}
    if name == "павел":
        return {"павел", "павла", "павлу", "павлом", "павле"}
    if name == "любовь":
        return {"любовь", "любови", "любовью"}
    stem = name[:-1]
    if name.endswith("ия"):
        return {stem + x for x in ("я", "и", "ю", "ей")}
    if name.endswith("ья"):
        return {stem + x for x in ("я", "и", "е", "ю", "ей")}
    if name.endswith("я"):
        return {stem + x for x in ("я", "и", "е", "ю", "ей")}
    if name.endswith("а"):
        return {stem + x for x in ("а", "ы", "и", "е", "у", "ой", "ей")}
    if name.endswith("ий"):
        return {stem + x for x in ("й", "я", "ю", "ем", "и")}
    if name.endswith(("й", "ь")):
        return {name, *(stem + x for x in ("я", "ю", "ем", "е"))}
    if name.endswith("о"):
        return {name}
    return {name + x for x in ("", "а", "у", "ом", "е")}


@lru_cache(maxsize=1)
def forms() -> dict[str, str]:
    """Every form of a full or short given name, and its nominative (full or short)."""
    out: dict[str, str] = {}
    for full, short in GIVEN.items():
        for base in [*short.split(), full]:
            for f in cases(base):
                out.setdefault(f, base)
    for full in GIVEN:
        out[full] = full
    return out


@lru_cache(maxsize=1)
def full_names() -> dict[str, frozenset[str]]:
    """The full names that a full or short form may stand for."""
    out: dict[str, set[str]] = {}
    for full, short in GIVEN.items():
        for base in [full, *short.split()]:
            out.setdefault(base, set()).add(full)
    return {k: frozenset({k}) if k in GIVEN and k != "алена" else frozenset(v) for k, v in out.items()}


#: Letters to Latin, longest spellings first when read back.
LATIN = dict(zip("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye", strict=True)) | {"ё": "e", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}


def to_latin(word: str) -> str:
    return "".join(LATIN.get(c, c) for c in word.lower())


#: Latin letters that look like Cyrillic ones.
LOOKALIKE = str.maketrans("aceopxyABCEHKMOPTX", "асеорхуАВСЕНКМОРТХ")


def unmix(word: str) -> str:
    """A word of both scripts with its look-alike Latin letters made Cyrillic; other words as they are."""
    if word.isascii() or not re.search("[A-Za-z]", word) or not re.search("[а-яёА-ЯЁ]", word):
        return word
    return word.translate(LOOKALIKE)


@lru_cache(maxsize=1)
def latin_forms() -> dict[str, str]:
    return {to_latin(b): b for full, short in GIVEN.items() for b in [full, *short.split()]} | {"artem": "артем", "petr": "петр", "pyotr": "петр", "fyodor": "федор", "fedor": "федор", "nataliya": "наталья", "kseniya": "ксения"}


def is_patronymic(word: str) -> bool:
    return len(word) > 5 and bool(_PATRO.search(word))


def is_surname(word: str) -> bool:
    return len(word) > 3 and bool(_SURNAME.search(word)) and word not in NO_SURNAMES and word not in PLURALS


def is_latin_surname(word: str) -> bool:
    return len(word) > 4 and bool(_LATIN_SURNAME.search(word))


def agree(surname: str, name: str) -> bool:
    """Whether a surname may stand before a given name: one that ends like a man's in the nominative doesn't go with a woman's name, nor the other way round."""
    s, n = plain(surname), plain(name)
    base = forms().get(n, n)
    woman = any(x[-1] in "аяь" and x not in ("никита", "илья", "игорь") for x in full_names().get(base, ()))
    man = any(x[-1] not in "аяь" or x in ("никита", "илья", "игорь") for x in full_names().get(base, ()))
    if re.search(r"(?:ов|ев|ин|ын)$", s):
        return man or not woman
    if re.search(r"(?:ова|ева|ина|ына)$", s) and n == base:
        return woman or not man
    return True
