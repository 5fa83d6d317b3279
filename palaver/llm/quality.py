"""Per-document text quality statistics, and a classifier of natural prose against lists, tables and junk.

The statistics of every document are computed in one pass over its whole text. Gradient-boosted trees (logistic loss, histogram splits) are
trained on the statistics of a bounded sample of the corpus, labelled weakly by structure: clear prose, and structural junk (lists, tables,
records, symbol or letter noise, loops); what neither rule is sure of stays unlabelled. The margin is turned into a probability by a logistic curve fitted
on a small holdout whose documents were read and labelled by hand (holdout.json: statistics and labels only).
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.batches import pieces

#: Most documents that the trees are fitted on, chosen by a hash of the key.
TRAIN_ROWS = 8000
STATS = ["n_words", "mean_word_len", "symbol_ratio", "end_punct_share", "common_share"]
FEATURES = [
    *STATS, "digit_ratio", "n_lines", "line_words", "line_words_median", "marker_share", "delimited_share", "distinct_words", "distinct_sentences", "vowel_share",
    "longest_word", "odd_words", "mixed_words", "top_word_share", "mojibake", "short_lines", "tiny_words", "placeholder_share", "sentence_words", "commas", "types", "long_line_share",
]
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"\s*(?:[-*•·▪◦–+]\s|\[[ xX]?\]|\(?\d{1,3}[.)]\s|[a-zа-я]\)\s)")
_SENT = re.compile(r"[.!?…\n]+")
_VOWEL = re.compile(r"[аеёиоуыэюяaeiouy]")
_LABEL = re.compile(r"^\s*(?:\[\d{1,2}:\d\d(?::\d\d)?\]|\(\d{1,2}:\d\d(?::\d\d)?\)|<\d{1,2}:\d\d(?::\d\d)?>|\[\d+\]|—)?\s*(?:[^\W\d_]+[ -]?№?\d{1,3}\s*:)?\s*")
_HOLE = re.compile(r"&[a-z]+;|</?[a-z]+/?>|\{\{|\[object|\bNaN\b|\bundefined\b|\bnull\b|�")
ENDS = tuple(".!?…»\")")


_MOJI = re.compile(r"[\u0080-ÿ]")
_KNOWN: dict[str, tuple[int, int, int, int]] = {}


def _delimited(x: str) -> bool:
    return "\t" in x or "  " in x or '":' in x or x.count(";") > 1 or x.count("|") > 1 or (x.count(",") > 3 and x.count(", ") < 2)


def _word(w: str) -> tuple[int, int, int, int]:
    """Length, vowels, whether it is odd (very long or without a vowel), whether it mixes letters and digits; kept, as words recur."""
    got = _KNOWN.get(w)
    if got is None:
        v = len(_VOWEL.findall(w))
        if len(_KNOWN) > 200_000:
            _KNOWN.clear()
        got = _KNOWN[w] = (len(w), v, int(len(w) > 16 or (len(w) > 3 and not v)), int(not w.isalpha() and not w.isdigit()))
    return got


def statistics(text: str, common: frozenset[str]) -> list[float]:
    """The values of FEATURES for a text that isn't blank. Words are runs of letters and digits; lines that are blank don't count."""
    lines = [y for x in text.splitlines() if (y := x.strip())]
    low = text.lower()
    count = Counter(_WORD.findall(low))
    n = alnum = vowels = odd = mixed = tiny = usual = longest = top = 0
    for w, c in count.items():
        size, v, o, m = _word(w)
        n += c
        alnum += c * size
        vowels += c * v
        odd += c * o
        mixed += c * m
        if size < 3:
            tiny += c
        if size > longest:
            longest = size
        if c > top:
            top = c
        if w in common:
            usual += c
    solid = max(1, sum(map(len, text.split())))
    digits = sum(map(text.count, "0123456789"))
    bodies = [x[_LABEL.match(x).end() :] for x in lines]
    marks = [_MARK.match(x) for x in lines]
    per = [max(1, len(b.split()) - (2 if m and b.startswith("[ ") else 1 if m else 0)) for b, m in zip(bodies, marks, strict=True)]
    sents = [y for x in _SENT.split(low) if (y := x.strip())]
    cap, rows = max(1, n), max(1, len(lines))
    holes = len(_HOLE.findall(text)) if any(x in text for x in ("&", "</", "<", "{{", "[object", "NaN", "undefined", "null", "�")) else 0
    return [
        float(n),
        alnum / cap,
        max(0.0, solid - alnum) / solid,
        sum(x.endswith(ENDS) for x in lines) / rows,
        usual / cap,
        digits / solid,
        float(len(lines)),
        sum(per) / rows,
        float(sorted(per)[len(per) // 2]) if per else 0.0,
        sum(m is not None for m in marks) / rows,
        sum(map(_delimited, bodies)) / rows,
        len(count) / cap,
        len(set(sents)) / len(sents) if len(sents) > 3 else 1.0,
        vowels / max(1.0, alnum - digits),
        float(longest),
        odd / cap,
        mixed / cap,
        top / cap if n > 5 else 0.0,
        len(_MOJI.findall(text)) / solid,
        sum(x <= 4 for x in per) / rows,
        tiny / cap,
        holes / max(1, text.count(" ") + 1),
        n / max(1, len(sents)),
        text.count(",") / cap,
        float(len(count)),
        sum(len(x) for x, k in zip(bodies, per, strict=True) if k >= 6) / max(1, sum(map(len, bodies))),
    ]


_I = {k: i for i, k in enumerate(FEATURES)}


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 prose, 0 junk by structure, -1 neither is sure."""
    c = lambda k: x[:, _I[k]]
    junk = (
        ((c("n_lines") >= 4) & (c("line_words_median") <= 4) & (c("short_lines") >= 0.75) & (c("long_line_share") < 0.4))
        | ((c("n_lines") >= 3) & (c("delimited_share") >= 0.7))
        | (c("digit_ratio") >= 0.35)
        | (c("symbol_ratio") >= 0.45)
        | ((c("n_words") >= 8) & (c("common_share") < 0.03) & (c("n_lines") <= 3) & (c("digit_ratio") < 0.1))
        | ((c("n_words") >= 8) & (c("distinct_sentences") <= 0.34))
        | (c("top_word_share") >= 0.5)
        | (c("mojibake") >= 0.3)
        | ((c("commas") >= 0.22) & (c("n_words") >= 10) & (c("sentence_words") >= 12))
        | ((c("types") <= 6) & (c("n_words") >= 15))
        | ((c("odd_words") >= 0.3) & (c("n_words") >= 5))
        | (c("placeholder_share") >= 0.3)
    )
    prose = (c("n_words") >= 6) & (c("common_share") >= 0.08) & ((c("line_words_median") >= 5) | (c("long_line_share") >= 0.5)) & (c("symbol_ratio") < 0.2) & (c("digit_ratio") < 0.2) & (c("distinct_sentences") >= 0.5) & (c("mojibake") < 0.05) & (c("delimited_share") < 0.5)
    return np.where(junk, 0, np.where(prose, 1, -1))


class Trees:
    """Gradient-boosted regression trees of depth 3 on the logistic loss."""

    def __init__(self, rounds: int = 100, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[list[tuple]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        p = min(max(y.mean(), 0.01), 0.99)
        self.base = math.log(p / (1 - p))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            g, h = y - q, q * (1 - q) + 1e-6
            nodes, place = [], [(np.arange(len(y)), 0)]
            while place:
                rows, level = place.pop(0)
                best = self._split(binned, g, h, rows, cuts) if level < self.depth else None
                if best is None:
                    v = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
                    nodes.append((-1, 0.0, 0, 0, float(v)))
                    margin[rows] += v
                else:
                    j, b = best
                    nxt = len(nodes) + len(place) + 1
                    nodes.append((j, float(cuts[j][b]), nxt, nxt + 1, 0.0))
                    low = binned[rows, j] <= b
                    place += [(rows[low], level + 1), (rows[~low], level + 1)]
            self.trees.append(nodes)
        return self

    def _split(self, binned, g, h, rows, cuts):
        if len(rows) < 2 * self.least:
            return None
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        best, gain = None, 1e-3
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            k = binned[rows, j]
            gs, hs, ns = (np.cumsum(np.bincount(k, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gr, hr = g[rows].sum() - gs, h[rows].sum() - hs
            value = np.where((ns >= self.least) & (len(rows) - ns >= self.least), gs**2 / (hs + 1.0) + gr**2 / (hr + 1.0) - whole, -1)
            b = int(np.argmax(value))
            if value[b] > gain:
                best, gain = (j, b), value[b]
        return best

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for nodes in self.trees:
            at = np.zeros(len(x), int)
            f, t, lo, hi, v = (np.array(col) for col in zip(*nodes, strict=True))
            for _ in range(self.depth):
                inner = f[at] >= 0
                go = np.where(x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at], lo[at], hi[at])
                at = np.where(inner, go, at)
            out += v[at]
        return out


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b of p = 1 / (1 + exp(-(a * margin + b))): damped Newton steps with smoothed targets and a light pull towards a = 1, b = 0."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, w, home = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0]), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - t * z).sum() + 0.05 * ((w - home) ** 2).sum())

    for _ in range(steps):
        p = 0.5 * (1 + np.tanh(0.5 * (x @ w)))
        grad = x.T @ (p - t) + 0.1 * (w - home)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return float(w[0]), float(w[1])


def holdout() -> tuple[np.ndarray, np.ndarray]:
    d = json.loads((Path(__file__).parent / "holdout.json").read_text())
    return np.array(d["x"], float).reshape(-1, len(FEATURES)), np.array(d["y"], float)


def _common(words: DataFrame) -> frozenset[str]:
    """The words of a small fixed table (its size is checked)."""
    w = words.where("word IS NOT NULL").select(F.lower("word")).distinct().limit(50_001).collect()
    if len(w) > 50_000:
        raise ValueError("the table of common words is too large to hand out")
    return frozenset(r[0] for r in w)


def document_statistics(docs: DataFrame, key: str, text: str, words: DataFrame, model: tuple[Trees, float, float] | None = None) -> DataFrame:
    """key, FEATURES and, with a model, p_prose. A null, empty or blank text has null statistics (n_words is 0) and a null p_prose."""
    common = docs.sparkSession.sparkContext.broadcast(_common(words))
    kind = docs.schema[key].dataType.simpleString()
    names = [*FEATURES, *(["p_prose"] if model else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            some = [i for i, t in enumerate(texts) if t and t.strip()]
            x = np.full((len(texts), len(names)), np.nan)
            x[:, 0] = 0
            if some:
                f = np.array([statistics(texts[i], known) for i in some])
                x[some, : len(FEATURES)] = f
                if model:
                    trees, a, b = model
                    x[some, -1] = 0.5 * (1 + np.tanh(0.5 * (a * trees.margin(f) + b)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64(), from_pandas=True) for c in x.T)], names=[key, *names])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in names))


def train(docs: DataFrame, key: str, text: str, words: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Trees, float, float]:
    """Fits the trees on about ``rows`` documents (fewer if there are fewer) and on every second document of the hand-checked ones, whatever the size of the corpus, and calibrates
    them on the others of these, which no tree has seen. Runs a count and a scan of the sample."""
    n = max(1, docs.count())
    part = int(min(1.0, rows / n) * 2**31)
    sample = docs.where(F.shiftrightunsigned(F.xxhash64(key), 33) < F.lit(part)) if part < 2**31 else docs
    got = document_statistics(sample, key, text, words).where("mean_word_len IS NOT NULL").drop(key).toPandas().to_numpy(float)
    hx, hy = holdout()
    x, y = got.reshape(-1, len(FEATURES)), weak_labels(got.reshape(-1, len(FEATURES)))
    x, y = x[y >= 0], y[y >= 0].astype(float)
    trees = Trees().fit(np.vstack([x, hx[::2]]), np.concatenate([y, hy[::2]]))
    return trees, *(calibrate(trees.margin(hx[1::2]), hy[1::2]) if len(hy) > 1 else (1.0, 0.0))


def classify(docs: DataFrame, key: str, text: str, words: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """document_statistics with p_prose, the calibrated probability that the text as a whole is natural prose."""
    return document_statistics(docs, key, text, words, train(docs, key, text, words, rows))
