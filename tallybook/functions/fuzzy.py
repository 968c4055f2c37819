"""Edit distances priced by how alike glyphs look.

Plain distances are Spark's own ``levenshtein``.  Weighted ones have no built-in form and run
as Arrow-batched functions over distinct pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Costs of reading one character as another: those that share a glyph, a skeleton, or are smeared (fixed values).
ALIKE = {
    0.1: ("0O", "1I", "1L", "IL", "5S", "8B", "2Z", "6G"),
    0.3: ("0D", "0Q", "DO", "OQ", "CG", "CO", "EF", "HM", "HN", "MW", "UV"),
    0.6: ("PR", "KX"),
}
COSTS = {pair: cost for cost, pairs in ALIKE.items() for a, b in pairs for pair in ((a, b), (b, a))}


def confusion_cost(a: str, b: str) -> float:
    """0 for equal letters whatever their case, else the group's cost, else 1."""
    a, b = a.upper(), b.upper()
    return 0.0 if a == b else COSTS.get((a, b), 1.0)


def letter_cost(a: Column, b: Column) -> Column:
    """``confusion_cost`` of two capital letters as a column."""
    out = F.lit(1.0)
    both = F.concat(a, b)
    for cost, pairs in ALIKE.items():
        out = F.when(both.isin(*[x + y for p in pairs for x, y in (p, p[::-1])]), cost).otherwise(out)
    return F.when(a == b, 0.0).otherwise(out)


def _substitutions(a: str, b: str) -> np.ndarray:
    """Costs of every letter of ``a`` against every letter of ``b``."""
    known = sorted({*a, *b})
    table = np.array([[confusion_cost(x, y) for y in known] for x in known]).reshape(len(known), len(known))
    at = {c: i for i, c in enumerate(known)}
    return table[np.ix_([at[c] for c in a], [at[c] for c in b])] if a and b else np.zeros((len(a), len(b)))


def weighted_distance(a: str, b: str) -> float:
    """Edit distance whose substitutions cost ``confusion_cost``.  A row is made at once: insertions are
    a running minimum."""
    steps = np.arange(len(b) + 1, dtype=float)
    row = steps
    for i, costs in enumerate(_substitutions(a, b), 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + costs)
        new[0] = i
        row = np.minimum.accumulate(new - steps) + steps
    return float(row[-1]) if len(a) else float(len(b))


def substring_cost(needle: str, hay: str) -> tuple[float, int]:
    """Cheapest alignment of ``needle`` with any substring of ``hay``, and where it starts; infinite for a
    needle longer than ``hay``."""
    if not needle or len(needle) > len(hay):
        return (0.0, 0) if not needle else (float("inf"), 0)
    cost, start = np.zeros(len(hay) + 1), np.arange(len(hay) + 1)
    for i, costs in enumerate(_substitutions(needle, hay), 1):
        new, begin = cost + 1, start.copy()
        better = cost[:-1] + costs <= new[1:]
        new[1:][better], begin[1:][better] = (cost[:-1] + costs)[better], start[:-1][better]
        new[0], begin[0] = i, 0
        for j in np.flatnonzero(new[1:] > np.minimum.accumulate(new - np.arange(len(new)))[:-1] + np.arange(1, len(new))) + 1:
            if new[j - 1] + 1 < new[j]:
                new[j], begin[j] = new[j - 1] + 1, begin[j - 1]
        cost, start = new, begin
    at = int(cost[1:].argmin()) + 1
    return float(cost[at]), int(start[at])


@F.pandas_udf(DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict[tuple[str, str], float] = {}
    return pd.Series([None if x is None or y is None else memo.setdefault((x, y), weighted_distance(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """1 minus the weighted distance over the longer length."""
    return 1 - _distance(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def plain_similarity(a: Column, b: Column) -> Column:
    """The same with equal substitution costs, by the built-in distance."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def bigram_share(keyword: Column, text: Column) -> Column:
    """Share of the keyword's distinct letter pairs that the text has."""

    def pairs(c: Column) -> Column:
        return F.when(F.length(c) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))

    own = pairs(keyword)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, pairs(text))) / F.size(own)).otherwise(F.lit(0.0))


def fuzzy_threshold(length: Column) -> Column:
    return F.when(length <= 4, 0.75).when(length <= 6, 0.80).otherwise(0.70)
