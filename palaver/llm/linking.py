"""Variant spellings of names: which spellings of one group (a meeting) mean the same person or organisation.

Every distinct spelling is read into parts: given name (short forms, cases, transliteration and single typos included), patronymic, surname, initials, or
the words of an organisation without its legal form. Surnames and organisations are then linked inside a group:

* MinHash over the padded 2-grams of the name, banded; the number of bands is the smallest whose collision curve 1 - (1 - s**r)**b reaches the wanted
  recall at the lowest similarity s that a single typo leaves in a name of more than SHORT letters (tune()). Shorter names have one more key, their sorted letters, which a
  swap of neighbours doesn't change: it leaves 0.25 of the 2-grams of four letters, 0.33 of five, 0.40 of six.
* Candidates are verified by Monge-Elkan similarity of their words and an edit bound.
* Star clustering: a name hangs on a centre one edit away that at least FAR times as many groups have (a typo against a name); signatures, candidates and verification run once
  per distinct name of the corpus, and each group takes up the links of its own names. A centre that the group lacks still joins two of the group's names that hang on it. Two names that
  are both rare are joined inside their group if their given names agree. Two well attested names are never joined, so two real surnames one letter apart stay two. Every rule is a
  ratio of counts or a fixed count of groups, so none moves with the size of the corpus.

A short form (a lone given name, surname, given name with patronymic, initials) means the only full person of the group that it can mean. Candidates are counted
per lookup key, by aggregation; a short form with two or more stays alone. Pairs come from an equi-join on the entity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm import names
from palaver.session import materialise

ROWS = 2
#: Names of so few letters are also keyed by their letters, sorted: a swap of neighbours leaves too few of their 2-grams.
SHORT = 7
RECALL, SIMILARITY = 0.99, 0.42
MONGE_ELKAN = 0.75
#: How many times as many groups have a centre as have a name that hangs on it; a name that fewer groups have is rare.
FAR = RARE = 4
#: Entries that name nobody, and legal forms.
NOBODY = frozenset(
    ["null", "none", "nan", "n/a", "na", "-", "—", "?", "команда", "все", "не указано", "не указан", "не указана", "не определено", "неизвестно", "неизвестный", "нет", "никто", "участники", "коллеги", "все участники", "вся команда", "не назначен", "не назначено", "unknown", "team", "all", "undefined", "спикер"]
)
LEGAL = frozenset("ооо ао ип зао пао оао тоо нко чп ooo ao ip llc ltd inc gmbh".split())
_SPEAKER = re.compile(r"(?i)^\[?\s*(?:спикер|speaker|участник)[\s_№-]*\d*\s*\]?:?$")


def osa(a: str, b: str, most: int = 3) -> int:
    """Edit distance with swaps of neighbours (optimal string alignment), cut off above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    p2, p1 = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(p1[j] + 1, row[j - 1] + 1, p1[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, p2[j - 2] + 1)
            row.append(d)
        p2, p1 = p1, row
    return p1[-1]


def monge_elkan(a: str, b: str) -> float:
    """Mean over the words of either name of the best edit similarity in the other, the smaller of both directions."""
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0
    sim = lambda p, q: 1 - osa(p, q, 9) / max(len(p), len(q))
    return min(sum(max(sim(p, q) for q in y) for p in x) / len(x), sum(max(sim(p, q) for q in x) for p in y) / len(y))


def tune(recall: float = RECALL, at: float = SIMILARITY, rows: int = ROWS) -> int:
    """The smallest number of bands of ``rows`` rows that find a pair of similarity ``at`` with probability ``recall``."""
    b = 1
    while 1 - (1 - at**rows) ** b < recall:
        b += 1
    return b


#: Letters that take several in Latin, as one sign each, so that a typo in a letter is one edit.
ONE_SIGN = {"ж": "Z", "х": "H", "ч": "Q", "ш": "W", "щ": "X", "ю": "U", "я": "A"}
DIGRAPHS = (("shch", "X"), ("zh", "Z"), ("kh", "H"), ("ch", "Q"), ("sh", "W"), ("yu", "U"), ("ya", "A"))
_CODE_SURNAME = re.compile(r"(?:ov|ev|in|yn)a?$|enko$|sk(?:iy|y|aA|oy)$|Quk$")


def fold(latin: str) -> str:
    for a, b in DIGRAPHS:
        latin = latin.replace(a, b)
    return latin


@lru_cache(maxsize=100_000)
def code(word: str) -> str:
    """One spelling for a word in either script: a sign per letter, without soft and hard signs."""
    return fold(word.lower()) if word.isascii() else "".join(ONE_SIGN.get(c) or names.LATIN.get(c, c) for c in word.lower())


def _like_surname(c: str) -> bool:
    return len(c) > 4 and bool(_CODE_SURNAME.search(c)) and not c.endswith("ayn")


@lru_cache(maxsize=1)
def _patronymics() -> frozenset[str]:
    out = set()
    for full in names.GIVEN:
        if full[-1] in "аяь" and full not in ("илья", "никита", "игорь"):
            continue
        stem = {"лев": "львов", "павел": "павлов", "петр": "петров", "игорь": "игорев", "илья": "иль", "никита": "никит", "михаил": "михайлов"}.get(full)
        if stem is None:
            stem = full[:-2] + "ьев" if full.endswith(("лий", "рий", "сий", "ний")) and full not in ("дмитрий",) else full[:-1] + "ев" if full.endswith("й") else full + "ов"
        out |= {stem + "ич", stem + ("на" if stem.endswith(("ов", "ев")) else "инична" if stem == "иль" else "ична")}
    return frozenset(code(x) for x in out)


@lru_cache(maxsize=1)
def _given_latin() -> dict[str, tuple[str, bool]]:
    """Folded form -> (base, whether it is the nominative)."""
    out = {code(f): (b, f == b) for f, b in names.forms().items()}
    out |= {code(b): (b, True) for b in names.forms().values()}
    return out | {fold(f): (b, True) for f, b in names.latin_forms().items()}


@lru_cache(maxsize=100_000)
def _patronymic(word: str, raw: str) -> str | None:
    """The nominative of a patronymic, if the word is one in any case or a typo away from one."""
    known = _patronymics()
    for end, put in (("", ""), ("a", ""), ("u", ""), ("em", ""), ("e", ""), ("y", "a"), ("e", "a"), ("u", "a"), ("oy", "a")):
        if word.endswith(end) and (w := word[: len(word) - len(end)] + put) in known:
            return w
    if names.is_patronymic(raw):
        hits = [p for p in known if abs(len(p) - len(word)) <= 1 and osa(p, word, 1) <= 1]
        return min(hits) if hits else None
    return None


@lru_cache(maxsize=100_000)
def _near(word: str, least: int = 4) -> tuple[str, bool] | None:
    """The given name one typo away; an empty name if there are several."""
    known = _given_latin()
    if word in known or len(word) < least:
        return known.get(word)
    hits = {known[f] for f in known if len(f) >= least and abs(len(f) - len(word)) <= 1 and (f[0] == word[0] or f[-2:] == word[-2:]) and osa(f, word, 1) <= 1}
    fulls = {f for b, _ in hits for f in names.full_names()[b]}
    if len(fulls) > 1:  # a swap of letters is the likelier typo
        swapped = [(b, nom) for f in known if sorted(f) == sorted(word) and osa(f, word, 1) <= 1 for b, nom in [known[f]]]
        best = {f for b, _ in swapped for f in names.full_names()[b]}
        fulls, hits = (best, set(swapped)) if len(best) == 1 else (fulls, hits)
    if len(fulls) == 1:
        return fulls.pop(), any(nom for _, nom in hits)
    return ("", True) if fulls else None


def _surname_like(word: str) -> bool:
    """Whether a lone word looks like a surname; `дизайн` and the like don't."""
    if word.isascii():
        return _like_surname(code(word))
    return names.is_surname(word)


def _nominative(s: str, oblique: bool) -> str:
    """A Latin surname in the nominative, as far as its ending tells."""
    if s.endswith(("ovoy", "evoy", "inoy", "ynoy")):
        return s[:-2] + "a"
    if s.endswith(("ovu", "evu", "inu", "ynu")) or (oblique and s.endswith(("ova", "eva", "ina", "yna"))):
        return s[:-1]
    if s.endswith(("ovym", "evym", "inym", "ynym")):
        return s[:-2]
    return s


def parse(spelling: str) -> dict | None:
    """The parts of a spelling, coded; None if it names nobody.

    kind: p (person), o (organisation) or u (a lone word that may be either); name: surname or organisation words; given: base form; patr, gi, pi, si: patronymic and initials."""
    s = re.sub(r"\([^)]*\)", " ", spelling)
    s = " ".join(s.split())
    if not s or s.lower().replace("ё", "е") in NOBODY or _SPEAKER.match(s) or not re.search(r"[^\W\d_]", s):
        return None
    quoted = bool(re.search(r"[«»\"“”„]", s))
    words = [names.plain(names.unmix(w)) for w in re.findall(r"[^\W_]+(?:-[^\W_]+)*", s)]
    legal = [w for w in words if w in LEGAL]
    if legal or quoted:
        rest = [code(p) for w in words if w not in LEGAL for p in w.split("-")]
        return {"kind": "o", "name": "".join(rest), "given": None, "patr": None, "gi": None, "pi": None, "si": None} if rest else None
    lat = [code(w) for w in words]
    known = _given_latin()
    given = patr = None
    oblique = False
    left, initials = [], []
    for raw, w in zip(words, lat, strict=True):
        if len(raw) == 1 or (len(raw) == 2 and raw in ("yu", "ya", "kh", "zh", "sh", "ch", "ts")):
            initials.append((w[:1], len(left) + (given is not None)))
        elif given is None and w in known:
            given, nom = known[w]
            oblique = not nom
        elif patr is None and len(words) > 1 and (p := _patronymic(w, raw)):
            patr = p
        else:
            left.append(w)
    if given is None and len(left) >= 2 and not initials:
        # a misspelt given name, but only beside what looks like a surname: `Вектор Лифт` is no Виктор
        plausible = [_like_surname(w) or w.endswith(("ovoy", "inoy", "evoy", "ovu", "inu", "evu")) for w in left]
        for last in (False, True):
            for i, w in enumerate(left):
                if plausible[i] is last and any(ok for j, ok in enumerate(plausible) if j != i) and (hit := _near(w)):
                    given, oblique = hit[0], not hit[1]
                    left.pop(i)
                    break
            if given is not None:
                break
    if given == "":  # a misspelt given name that may be several: the surname has to do
        given = None
        if len(left) == 1 and not initials and patr is None:
            return {"kind": "p", "name": _nominative(left[0], oblique), "given": None, "patr": None, "gi": None, "pi": None, "si": None}
    out = {"kind": "p", "name": None, "given": given, "patr": patr, "gi": None, "pi": None, "si": None}
    if left:
        if given is None and patr is None and not initials:
            looks = len(left) == 1 and "-" not in words[0] and _surname_like(words[0])
            name = "".join(p for w in left for p in w.split("-"))
            if looks:
                return out | {"name": _nominative(left[0], False)}
            return out | {"kind": "u" if len(left) == 1 and "-" not in left[0] else "o", "name": name}
        out["name"] = " ".join(_nominative(w, oblique) for w in left)
        if initials:
            letters = [w for w, _ in initials]
            if given is None:
                out["gi"], out["pi"] = letters[0], letters[1] if len(letters) > 1 else None
            else:
                out["pi"] = letters[0]
    elif given is not None and initials:
        out["si"] = initials[0][0]
    elif given is None and patr is None:
        return None
    return out


_SEEDS = np.random.default_rng(20240229).integers(1, 2**61 - 1, (2, 256), dtype=np.uint64)


def signatures(words: list[str], n: int) -> np.ndarray:
    """n MinHash values of the padded 2-grams of each word (a row a word)."""
    texts = [f"^{w}$" for w in words]
    grams = np.array([hash_gram(t[i : i + 2]) for t in texts for i in range(len(t) - 1)], np.uint64)
    starts = np.cumsum([0] + [len(t) - 1 for t in texts[:-1]])
    out = np.empty((len(words), n), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):  # a hash at a time keeps the arrays as small as the batch
            h = grams * (_SEEDS[0, j] | np.uint64(1)) + _SEEDS[1, j]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, j] = np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts)
    return out


@lru_cache(maxsize=100_000)
def hash_gram(g: str) -> int:
    x = 1469598103934665603
    for b in g.encode():
        x = (x ^ b) * 1099511628211 % 2**64
    return x


_PARTS = ["kind", "name", "given", "patr", "gi", "pi", "si"]


@lru_cache(maxsize=200_000)
def _read(spelling: str) -> dict | None:
    return parse(spelling)


def clean_spelling(c: Column | str) -> Column:
    """Outer spaces dropped, inner runs of spaces made one."""
    return F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[\s ]+", " "))


def parsed(spellings: DataFrame) -> DataFrame:
    """grp, spelling and the parts; spellings that name nobody are left out. Each spelling is read once a batch."""
    one = spellings.where("grp IS NOT NULL AND spelling IS NOT NULL AND spelling <> ''").select("grp", "spelling").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("spelling").dictionary_encode()
            parts = [_read(x) for x in d.dictionary.to_pylist()]
            named = pc.take(pa.array([x is not None for x in parts], pa.bool_()), d.indices)
            cols = [pc.take(pa.array([x and x[c] for x in parts], pa.string()), d.indices) for c in _PARTS]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("spelling"), *cols], names=["grp", "spelling", *_PARTS]).filter(named)

    return one.mapInArrow(run, f"grp {spellings.schema['grp'].dataType.simpleString()}, spelling string, " + ", ".join(f"{c} string" for c in _PARTS))


def banded(df: DataFrame, keep: list[str], bands: int) -> DataFrame:
    """keep, band, bh: a row for each band of a row's ``name``; those of at most SHORT letters have one more, of their sorted letters."""
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("name").to_pylist()
            sig = signatures(words, bands * ROWS).reshape(len(words), bands, ROWS)
            with np.errstate(over="ignore"):
                h = sig[:, :, 0].copy()
                for i in range(1, ROWS):
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i]
            short = [i for i, w in enumerate(words) if len(w) <= SHORT]
            at = np.concatenate([np.repeat(np.arange(len(words)), bands), np.array(short, int)])
            band = np.concatenate([np.tile(np.arange(bands, dtype=np.int32), len(words)), np.full(len(short), bands, np.int32)])
            bh = np.concatenate([h.reshape(-1), np.array([hash_gram("".join(sorted(words[i]))) for i in short], np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in keep), pa.array(band), pa.array(bh)], names=[*keep, "band", "bh"])

    return df.select(*keep).mapInArrow(run, f"{ddl}, band int, bh long")


#: Kinds that may mean the same: equal ones, and a lone word with either.
_KINDS = "(kind1 = kind2 OR kind1 = 'u' OR kind2 = 'u')"
#: What the JVM can tell cheaply of one edit (a swap of neighbours is two for it); verified() looks again.
_CLOSE = "abs(length(name1) - length(name2)) <= 1 AND levenshtein(name1, name2, 2) BETWEEN 0 AND 2"


def verified(pairs: DataFrame) -> DataFrame:
    """The pairs (name1, name2) that are one edit apart and alike by Monge-Elkan, with sim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = list(zip(batch.column("name1").to_pylist(), batch.column("name2").to_pylist(), strict=True))
            sim = [monge_elkan(a, b) if osa(a, b, 1) <= 1 else 0.0 for a, b in two]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sim, pa.float64())], names=[*batch.schema.names, "sim"]).filter(pa.array([x >= MONGE_ELKAN for x in sim], pa.bool_()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, f"{ddl}, sim double")


#: Whether two given names or initials may be one person's: equal, one the initial of the other, or one unknown (empty).
_AGREE = "(startswith(g1, g2) OR startswith(g2, g1))"
_KEY = ["grp", "kind", "name", "g"]


def _as(df: DataFrame, i: int, keep: list[str], rest: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` as they are and ``rest`` with a number behind."""
    return df.select(*keep, *(F.col(c).alias(f"{c}{i}") for c in rest))


def _centre(df: DataFrame, order: Column) -> DataFrame:
    """Of the candidates (kind2, name2) of each token (grp, kind1, name1, g1) the first by ``order``."""
    best = df.groupBy("grp", F.col("kind1").alias("kind"), F.col("name1").alias("name"), F.col("g1").alias("g")).agg(F.max_by(F.struct("name2", "kind2"), order).alias("c"))
    return best.select(*_KEY, F.col("c.name2").alias("centre"), F.col("c.kind2").alias("ckind"))


def near_names(counted: DataFrame, bands: int) -> DataFrame:
    """kind1, name1, n1, kind2, name2, n2, sim: distinct names one edit from names that FAR times as many groups have. counted: kind, name, n.

    The join is a shuffle by hint: its sides grow in Python, where Spark's estimates don't see it."""
    cols = ("kind", "name", "n")
    b = banded(counted, list(cols), bands)
    near = _as(b, 1, ["band", "bh"], cols).join(_as(b.where(F.col("n") >= FAR), 2, ["band", "bh"], cols).hint("merge"), ["band", "bh"])
    return verified(near.where(f"n2 >= {FAR} * n1 AND name1 <> name2 AND {_KINDS} AND {_CLOSE}").drop("band", "bh").distinct())


def centres(tokens: DataFrame, bands: int | None = None) -> DataFrame:
    """grp, kind, name, g, centre, ckind: the names of a group that are taken for another one, and that other one (which is taken for itself).

    tokens: grp, kind, name, g (distinct; g: given name, its initial, or empty). How well a name is attested is the number of groups that have it."""
    bands = bands or tune()
    counted = materialise(tokens.groupBy("kind", "name").agg(F.countDistinct("grp").alias("n")))
    # a lone word that is somebody's surname needs no likeness
    same = _as(counted.where("kind = 'u'"), 1, ["name"], ("kind", "n")).join(_as(counted.where("kind = 'p'"), 2, ["name"], ("kind", "n")).hint("merge"), "name")
    same = same.select("kind1", F.col("name").alias("name1"), "n1", "kind2", F.col("name").alias("name2"), "n2", F.lit(1.0).alias("sim"))
    edges = materialise(near_names(counted, bands).unionByName(same))
    # what stands without a full given name goes where the same name with one goes, if the group has that
    whole = _as(tokens.where("length(g) > 1"), 2, ["grp", "kind", "name"], ("g",))
    bare = tokens.where("length(g) <= 1").withColumnRenamed("g", "g1").join(whole.hint("merge"), ["grp", "kind", "name"]).where("startswith(g2, g1)")
    bare = materialise(bare)
    cand = _as(tokens, 1, ["grp"], ("kind", "name", "g")).join(edges.hint("merge"), ["kind1", "name1"])
    cand = materialise(cand.join(bare.select("grp", F.col("kind").alias("kind1"), F.col("name").alias("name1"), "g1").distinct(), ["grp", "kind1", "name1", "g1"], "left_anti"))
    there = cand.join(_as(tokens, 2, ["grp"], ("kind", "name", "g")).hint("merge"), ["grp", "kind2", "name2"]).where(_AGREE)
    here = materialise(_centre(there, F.struct((F.col("g1") == F.col("g2")).alias("s"), "n2", "sim", "name2")))
    # two names of a group that hang on one centre, which the group lacks
    free = cand.where("name1 <> name2").join(here.select("grp", *(F.col(c).alias(f"{c}1") for c in _KEY[1:])), ["grp", "kind1", "name1", "g1"], "left_anti")
    two = free.groupBy("grp", "kind2", "name2", "g1").agg(F.countDistinct("name1").alias("k")).where("k > 1").drop("k")
    away = _centre(free.join(two, ["grp", "kind2", "name2", "g1"]), F.struct("n2", "sim", "name2"))
    moved = materialise(here.unionByName(away))
    moved = _ended(moved.unionByName(_rare(tokens, counted, moved, bands)))
    to = bare.join(moved.withColumnRenamed("g", "g2"), ["grp", "kind", "name", "g2"], "left").groupBy("grp", "kind", "name", F.col("g1").alias("g"))
    to = to.agg(F.collect_set(F.struct(F.coalesce("centre", "name").alias("name2"), F.coalesce("ckind", "kind").alias("kind2"))).alias("c")).where("size(c) = 1 AND c[0].name2 <> name")
    return moved.unionByName(to.select(*_KEY, F.col("c")[0]["name2"].alias("centre"), F.col("c")[0]["kind2"].alias("ckind")))


def _rare(tokens: DataFrame, counted: DataFrame, moved: DataFrame, bands: int) -> DataFrame:
    """Rare names of a group that are still by themselves, taken for a name of the group one edit away with the same given name (firms: none)."""
    few = tokens.join(counted.where(F.col("n") < FAR * RARE).hint("merge"), ["kind", "name"])
    alone = few.where(F.col("n") < RARE).join(moved, _KEY, "left_anti")
    few = few.join(alone.select("grp").distinct(), "grp", "left_semi")
    b = banded(few.select(*_KEY, "n"), [*_KEY, "n"], bands)
    cols = ("kind", "name", "n")
    pair = _as(b, 1, ["grp", "g", "band", "bh"], cols).join(_as(b, 2, ["grp", "g", "band", "bh"], cols).hint("merge"), ["grp", "g", "band", "bh"])
    pair = pair.where(f"n1 < {RARE} AND (n2 > n1 OR (n2 = n1 AND name2 < name1)) AND (length(g) > 1 OR kind1 <> 'p') AND (kind1 = kind2 OR (kind1 <> 'p' AND kind2 <> 'p')) AND {_CLOSE}")
    pair = pair.select("grp", "kind1", "name1", "n1", F.col("g").alias("g1"), "kind2", "name2", "n2").distinct()
    pair = pair.join(moved.select("grp", *(F.col(c).alias(f"{c}1") for c in _KEY[1:])), ["grp", "kind1", "name1", "g1"], "left_anti")
    return _centre(verified(pair), F.struct("n2", "sim", "name2"))


def _ended(moved: DataFrame) -> DataFrame:
    """Every chain of centres followed to its end. A step goes to a better attested name (of equally attested ones, to a smaller one), or from a lone word to a person, so none runs in a circle."""
    while True:
        moved = materialise(moved)
        step = moved.select("grp", F.col("kind").alias("ckind"), F.col("name").alias("centre"), F.col("g").alias("g2"), F.col("centre").alias("c2"), F.col("ckind").alias("k2"))
        on = moved.withColumnRenamed("g", "g1").join(step.hint("merge"), ["grp", "ckind", "centre"]).where(_AGREE)
        on = on.groupBy("grp", "kind", "name", F.col("g1").alias("g")).agg(F.max_by(F.struct("c2", "k2"), F.struct((F.col("g1") == F.col("g2")).alias("s"), "c2")).alias("c"))
        on = materialise(on)
        if on.isEmpty():
            return moved
        moved = moved.join(on.hint("merge"), _KEY, "left").select(*_KEY, F.coalesce("c.c2", "centre").alias("centre"), F.coalesce("c.k2", "ckind").alias("ckind"))


def entities(spellings: DataFrame) -> DataFrame:
    """grp, spelling, entity: the spellings that name somebody, and a key of what they mean in their group.

    spellings: grp, spelling; nulls, empties and entries that name nobody are left out, repeated rows count once."""
    p = materialise(parsed(spellings))  # small next to the texts, and read many times: written out once, which also keeps the plans short
    p = p.withColumn("g", _full_given("given")).withColumn("_g", F.coalesce("g", "gi", F.lit("")))
    c = centres(p.where("name IS NOT NULL").select("grp", "kind", "name", F.col("_g").alias("g")).distinct())
    p = p.join(c.withColumnRenamed("g", "_g"), ["grp", "kind", "name", "_g"], "left").withColumns({"sur": F.coalesce("centre", "name"), "skind": F.coalesce("ckind", "kind")})
    kind = F.when(F.col("kind") == "u", F.when(F.col("skind") == "p", "p").otherwise("o")).otherwise(F.col("kind"))
    p = materialise(p.withColumn("kind", kind))
    orgs = p.where("kind = 'o'").select("grp", "spelling", F.concat(F.lit("o|"), F.coalesce("sur", "name")).alias("entity"))
    people = p.where("kind = 'p'").withColumn("initial", F.substring("g", 1, 1))
    full = people.where("sur IS NOT NULL AND g IS NOT NULL").withColumn("person", F.concat_ws("|", F.lit("p"), "sur", "g"))
    known = full.groupBy("grp", "person", "sur", "g").agg(F.max("patr").alias("patr"))
    # what has a surname and an initial but no full name beside it stands for a person of its own
    half = people.where("sur IS NOT NULL AND g IS NULL AND gi IS NOT NULL")
    keyed = known.select("grp", "person", "sur", "g", F.substring("g", 1, 1).alias("i"), "patr")
    lone = half.join(keyed.select("grp", "sur", F.col("i").alias("gi")).distinct(), ["grp", "sur", "gi"], "left_anti")
    lone = lone.select("grp", F.concat_ws("|", F.lit("h"), "sur", "gi").alias("person"), "sur", F.lit(None).cast("string").alias("g"), F.col("gi").alias("i"), F.lit(None).cast("string").alias("patr")).distinct()
    everyone = materialise(keyed.unionByName(lone))
    keys = F.array(
        F.concat_ws("|", F.lit("s"), "sur"),
        F.concat_ws("|", F.lit("si"), "sur", "i"),
        F.when(F.col("g").isNotNull(), F.concat_ws("|", F.lit("g"), "g")),
        F.when(F.col("g").isNotNull(), F.concat_ws("|", F.lit("gs"), "g", F.substring("sur", 1, 1))),
        F.when(F.col("g").isNull(), F.concat_ws("|", F.lit("gi"), "i")),
        F.when(F.col("g").isNull(), F.concat_ws("|", F.lit("gis"), "i", F.substring("sur", 1, 1))),
    )
    look = everyone.select("grp", "person", "patr", F.explode(keys).alias("key")).where("key IS NOT NULL")
    # per key, and per patronymic of it: how many persons it may mean, and one of them (two are enough to know that it is not one)
    count = look.groupBy("grp", "key", "patr").agg(F.count("*").alias("m"), F.min("person").alias("person")).groupBy("grp", "key").agg(
        F.sum("m").alias("n"),
        F.min("person").alias("one"),
        F.sum(F.when(F.col("patr").isNotNull(), F.col("m"))).alias("with_patr"),
        F.min(F.when(F.col("patr").isNull(), F.col("person"))).alias("one_unknown"),
        F.map_from_entries(F.collect_list(F.when(F.col("patr").isNotNull(), F.struct("patr", F.struct("m", "person"))))).alias("patrs"),
    )
    short = people.where("sur IS NULL OR g IS NULL")
    key = (
        F.when(F.col("sur").isNotNull() & F.col("gi").isNotNull(), F.concat_ws("|", F.lit("si"), "sur", "gi"))
        .when(F.col("sur").isNotNull(), F.concat_ws("|", F.lit("s"), "sur"))
        .when(F.col("g").isNotNull() & F.col("si").isNotNull(), F.concat_ws("|", F.lit("gs"), "g", "si"))
        .when(F.col("g").isNotNull(), F.concat_ws("|", F.lit("g"), "g"))
    )
    short = short.withColumn("key", key).withColumn("ikey", F.when(F.col("sur").isNull() & F.col("g").isNotNull(), F.when(F.col("si").isNotNull(), F.concat_ws("|", F.lit("gis"), "initial", "si")).otherwise(F.concat_ws("|", F.lit("gi"), "initial"))))
    short = short.join(count, ["grp", "key"], "left").withColumn("_p", F.try_element_at("patrs", "patr")).withColumns({"n_patr": F.col("_p.m"), "one_patr": F.col("_p.person")}).drop("patrs", "_p")
    icount = count.select("grp", F.col("key").alias("ikey"), F.col("n").alias("i_n"), F.col("one").alias("i_one"))
    short = short.join(icount, ["grp", "ikey"], "left")
    n0, i0, wp, np_ = (F.coalesce(c, F.lit(0)) for c in ("n", "i_n", "with_patr", "n_patr"))
    fits = F.when(F.col("patr").isNull(), n0).otherwise(n0 - wp + np_)  # those of another patronymic are out
    sole = F.when(F.col("patr").isNull(), F.col("one")).when(np_ > 0, F.col("one_patr")).otherwise(F.col("one_unknown"))
    meant = F.when((fits == 1) & (i0 == 0), sole).when((fits == 0) & (i0 == 1), F.col("i_one")).when((F.col("patr").isNotNull()) & (np_ == 1), F.col("one_patr"))
    own = F.when(fits + i0 == 0, F.concat_ws("|", F.lit("x"), "key")).otherwise(F.concat_ws("|", F.lit("a"), "spelling"))
    shorts = short.select("grp", "spelling", F.coalesce(meant, own).alias("entity"))
    return orgs.unionByName(full.select("grp", "spelling", F.col("person").alias("entity"))).unionByName(shorts)


def _full_given(c: str) -> Column:
    """The Latin full name of a base form; a form that may stand for several names keeps its first by the alphabet."""
    table = {b: code(min(f)) for b, f in names.full_names().items()}
    pairs = [F.lit(x) for kv in sorted(table.items()) for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(c))


def pairs(ents: DataFrame) -> DataFrame:
    """grp, name_a, name_b: the different spellings of one entity, name_a the smaller by code point."""
    a = ents.select("grp", "entity", F.col("spelling").alias("name_a"))
    b = ents.select("grp", "entity", F.col("spelling").alias("name_b"))
    return a.join(b, ["grp", "entity"]).where("name_a < name_b").select("grp", "name_a", "name_b").distinct()
