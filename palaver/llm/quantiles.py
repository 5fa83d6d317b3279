"""Percentiles of very large numeric columns by deterministic buffer collapsing (Manku, Rajagopalan and Lindsay, 1998).

A sketch holds at most ``b`` sorted buffers of ``k`` values, each with a weight and a level. When a buffer too many arrives, all buffers of
the lowest level (of the two lowest, if there is only one) collapse into one: their weighted values are merged and ``k`` evenly spaced
positions are kept. A collapse into weight W moves no value's rank by more than W/2, so the sum of those halves, which the sketch carries along
(``err``), is a guaranteed bound: of the value returned for rank r, fewer than r + err values are smaller and at least r - err are not greater.
While nothing has collapsed, which holds up to b*k values, answers are exact.

Sketches are built inside the scan's tasks and only they are shuffled, so a group with a third of all rows costs one sketch per task;
they are merged in two steps (64 tasks' sketches at a time, then per group). Sketches of days or partitions may be stored and merged later.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

B, K = 16, 1024
#: Values that a task holds before it hands on what it has; bounds its memory however many groups there are.
HELD = 4_000_000
#: What an open sketch weighs in that count, its Python objects included.
OPEN = 200
FAN_IN = 64


def buffer_size(error: float, most: int) -> int:
    """The buffer size (a power of two) that keeps the rank error of up to ``most`` values a group within ``error`` of their number.

    The weights of all buffers that collapse on one level add up to n / k at most, and each collapse adds half its weight to the bound; every collapse at least doubles the weight, so there are
    log2(n / k) levels at most, and the bound is n log2(n / k) / 2k."""
    k = 2
    while max(0.0, math.log2(max(1.0, most / k))) / (2 * k) > error:
        k *= 2
    return k


class Sketch:
    def __init__(self, b: int = B, k: int = K):
        self.b, self.k, self.n, self.err, self.flip = b, k, 0, 0, 0
        self.full: list[tuple[int, int, np.ndarray]] = []  # level, weight, sorted values
        self.loose = np.empty(0)

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._loosen(values)

    def _loosen(self, values: np.ndarray) -> None:
        self.loose = np.concatenate([self.loose, values])
        while len(self.loose) >= self.k:
            self.full.append((0, 1, np.sort(self.loose[: self.k])))
            self.loose = self.loose[self.k :]
            self._shrink()

    def _shrink(self) -> None:
        while len(self.full) > self.b:
            levels = sorted({x[0] for x in self.full})
            low = [x for x in self.full if x[0] == levels[0]]
            if len(low) == 1:
                low = [x for x in self.full if x[0] <= levels[1]]
            top = max(x[0] for x in low)
            self.full = [x for x in self.full if x[0] > top] + [(top + 1, *self._collapse(low))]

    def _collapse(self, low: list[tuple[int, int, np.ndarray]]) -> tuple[int, np.ndarray]:
        weight = sum(w for _, w, _ in low)
        values = np.concatenate([v for *_, v in low])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(np.repeat([w for _, w, _ in low], self.k)[order])
        first = (weight + 1) // 2
        if weight % 2 == 0:  # the two middle positions take turns, else ranks would drift one way
            first += self.flip
            self.flip ^= 1
        self.err += weight // 2
        return weight, values[order][np.searchsorted(upto, first + weight * np.arange(self.k))]

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.err += other.err
        self.full += other.full
        self._shrink()
        self._loosen(other.loose)

    def at(self, permille: list[int]) -> list[float]:
        values = np.concatenate([self.loose, *(v for *_, v in self.full)])
        weights = np.concatenate([np.ones(len(self.loose), "int64"), *(np.full(len(v), w, "int64") for _, w, v in self.full)])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        ranks = [max(1, -(-self.n * p // 1000)) for p in permille]
        return [float(x) for x in values[order][np.searchsorted(upto, ranks)]]

    def pack(self) -> dict:
        return {"n": self.n, "err": self.err, "flip": self.flip, "b": self.b, "k": self.k, "levels": [x[0] for x in self.full], "weights": [x[1] for x in self.full], "vals": np.concatenate([self.loose, *(v for *_, v in self.full)]).astype("<f8").tobytes()}

    @staticmethod
    def unpack(r: dict) -> Sketch:
        s = Sketch(int(r["b"]), int(r["k"]))
        s.n, s.err, s.flip = int(r["n"]), int(r["err"]), int(r["flip"])
        v = np.frombuffer(r["vals"], "<f8")
        loose = len(v) - s.k * len(r["levels"])
        s.loose = v[:loose]
        s.full = [(int(a), int(w), v[loose + i * s.k : loose + (i + 1) * s.k]) for i, (a, w) in enumerate(zip(r["levels"], r["weights"], strict=True))]
        return s


NAMES = ["n", "err", "flip", "b", "k", "levels", "weights", "vals"]


def _ddl(keys: list[str]) -> str:
    return "task int, " + "".join(f"`{c}` string, " for c in keys) + "metric string, n long, err long, flip int, b int, k int, levels array<int>, weights array<long>, vals binary"


def _arrow(keys: list[str]) -> pa.Schema:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
    return pa.schema([("task", pa.int32()), *((c, pa.string()) for c in keys), ("metric", pa.string()), *zip(NAMES, kinds, strict=True)])


def sketches(df: DataFrame, keys: list[str], metrics: list[str], b: int = B, k: int = K) -> DataFrame:
    """One sketch per task, group of ``keys`` (strings, null is a group of its own) and metric, over the values that are neither null nor NaN."""
    cols = df.select(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keys)), *(F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)))
    inner = [f"k{i}" for i in range(len(keys))]
    schema = _arrow(inner)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, own = TaskContext.get().partitionId(), 0, {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = [{"task": task, **dict(zip(inner, group, strict=True)), "metric": metric, **s.pack()} for (group, metric), s in own.items()]
            for lo in range(0, len(rows), 500):
                yield pa.RecordBatch.from_pylist(rows[lo : lo + 500], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros(batch.num_rows, "int64")
            dicts = []
            for i in range(len(keys)):
                d = batch.column(f"k{i}").dictionary_encode()
                names = [*d.dictionary.to_pylist(), None]
                idx = pa.compute.fill_null(d.indices, len(names) - 1).to_numpy(zero_copy_only=False)
                codes = codes * len(names) + idx
                dicts.append((names, idx))
            order = np.argsort(codes, kind="stable")
            edges = np.flatnonzero(np.diff(codes[order])) + 1
            for part in np.split(order, edges):
                group = tuple(names[idx[part[0]]] for names, idx in dicts)
                for i, m in enumerate(metrics):
                    v = pa.compute.fill_null(batch.column(f"m{i}"), float("nan")).to_numpy(zero_copy_only=False)[part]
                    v = v[~np.isnan(v)]
                    if len(v):
                        if (group, m) not in own:
                            own[group, m] = Sketch(b, k)
                            held += OPEN
                        own[group, m].add(v)
                        held += len(v)
            if held > HELD:
                yield from out()
                own, held = {}, 0
        yield from out()

    return cols.mapInArrow(build, _ddl(inner)).withColumnsRenamed(dict(zip(inner, keys, strict=True)))


def merged(sk: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged to one per group and metric; ``keys`` may be fewer than those they were built with (days into a whole)."""
    sk = sk.select("task", *keys, "metric", *NAMES).withColumn("task", (F.col("task") / FAN_IN).cast("int"))
    return _merge_runs(_merge_runs(sk, keys, ["task"]), keys, []).drop("task")


def _merge_runs(sk: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """Brings the sketches of a group together, sorted, and merges each run of equal keys while it streams by."""
    group = [*keys, "metric", *more]
    schema = _arrow(keys)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sketch, ready, held = None, None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[c] for c in group)
                if sketch is not None and key == now[0]:
                    sketch.merge(Sketch.unpack(r))
                    continue
                if sketch is not None:
                    ready.append(now[1] | sketch.pack())
                    held += len(ready[-1]["vals"])
                    if held > HELD:
                        yield pa.RecordBatch.from_pylist(ready, schema=schema)
                        ready, held = [], 0
                now, sketch = (key, {c: r[c] for c in ["task", *keys, "metric"]}), Sketch.unpack(r)
        if sketch is not None:
            ready.append(now[1] | sketch.pack())
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)

    return sk.repartition(*group).sortWithinPartitions(*group, "task", "n").mapInArrow(join, _ddl(keys))


def percentiles(sk: DataFrame, keys: list[str], permille: list[int]) -> DataFrame:
    """keys, metric, n, one column pNNN per asked permille, and rank_error: the guaranteed bound as a share of n (0: exact)."""
    names = [f"p{p}" for p in permille]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                s = Sketch.unpack(r)
                rows.append({c: r[c] for c in [*keys, "metric"]} | {"n": s.n} | dict(zip(names, s.at(permille), strict=True)) | {"rank_error": s.err / s.n})
            yield pd.DataFrame(rows, columns=[*keys, "metric", "n", *names, "rank_error"])

    return sk.mapInPandas(ask, "".join(f"`{c}` string, " for c in keys) + "metric string, n long, " + "".join(f"{c} double, " for c in names) + "rank_error double")
