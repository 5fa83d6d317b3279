"""Scoring of recognised text against a reference: word and character errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions import text as X


def align_counts(ref: list, hyp: list) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a cheapest alignment; of equal ways a substitution (or match) goes before a deletion, a deletion before an insertion.

    Two rows of costs are kept, with the counts of the way chosen so far packed beside them."""
    n = len(hyp)
    code = {t: i for i, t in enumerate(dict.fromkeys([*ref, *hyp]))}
    h = [code[t] for t in hyp]
    row = [(j, 0, 0, j) for j in range(n + 1)]
    for i, t in enumerate(ref, 1):
        r, left, nxt = code[t], (i, 0, i, 0), []
        nxt.append(left)
        for j in range(1, n + 1):
            c, s, d, k = row[j - 1]
            miss = int(r != h[j - 1])
            best = (c + miss, s + miss, d, k)
            if row[j][0] + 1 < best[0]:
                c, s, d, k = row[j]
                best = (c + 1, s, d + 1, k)
            if left[0] + 1 < best[0]:
                c, s, d, k = left
                best = (c + 1, s, d, k + 1)
            nxt.append(best)
            left = best
        row = nxt
    return row[n][1:]


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("substitutions", "deletions", "insertions", "words")]))
def _word_errors(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(ref, hyp, strict=True):
        x, y = (a or "").split(), (b or "").split()
        rows.append((0, 0, 0, len(x)) if x == y else (*align_counts(x, y), len(x)))
    return pd.DataFrame(np.array(rows, "int32").reshape(-1, 4), columns=["substitutions", "deletions", "insertions", "words"])


def word_errors(ref: Column, hyp: Column) -> Column:
    """Struct of substitutions, deletions, insertions and reference words of the texts in scoring form (a pandas UDF)."""
    return _word_errors(X.scoring_form(ref), X.scoring_form(hyp))


def rate(errors: Column, size: Column, other: Column) -> Column:
    """errors / size; an empty reference gives 0 for an empty other side and 1 for any other."""
    return F.when(size > 0, errors / size).when(other == 0, F.lit(0.0)).otherwise(F.lit(1.0))


def characters(t: Column) -> Column:
    """The scoring form without its spaces, as characters are compared."""
    return F.replace(X.scoring_form(t), F.lit(" "))


def character_errors(ref: Column, hyp: Column) -> Column:
    """Edit distance in characters of the texts in scoring form; spaces don't count."""
    return F.levenshtein(characters(ref), characters(hyp))


def _millionths(c: str, ok: Column) -> Column:
    """The mean of a column's valid values in whole millionths (rounded down): sums of integers, so that the order of the rows can't show."""
    good = ok & F.col(c).isNotNull() & ~F.isnan(c)
    n = F.sum(good.cast("long"))
    return F.floor(F.try_divide(F.sum(F.when(good, F.round(F.col(c) * 1_000_000).cast("long"))).cast("decimal(38,0)"), n)).cast("long")


def averages(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: runs, runs with a valid score, and the mean scores in millionths (0 where there are none)."""
    ok = F.col("werAfter").isNotNull() & ~F.isnan("werAfter")
    return results.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum(ok.cast("int")).alias("scored"), *(F.coalesce(_millionths(c, ok), F.lit(0)).alias(n) for c, n in (("werBefore", "wer_before_ppm"), ("werAfter", "wer_after_ppm"))))


def rolled_up(results: DataFrame) -> DataFrame:
    """Mean scores per model and case, per model, and over all, in one pass (grouping sets); level: 0, 1 and 3."""
    ok = F.col("werAfter").isNotNull() & ~F.isnan("werAfter")
    return results.rollup("model", "caseId").agg(F.count("*").alias("runs"), _millionths("werAfter", ok).alias("wer_after_ppm"), F.grouping_id().cast("int").alias("level"))
