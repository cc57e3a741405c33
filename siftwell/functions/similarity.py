"""Matching-block similarity of short names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_characters(text: Column, word: str) -> Column:
    """How many characters of ``word`` a text has too, each as often as both have it."""
    total = F.lit(0)
    for c in sorted(set(word)):
        times = F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
        total = total + F.least(times, F.lit(word.count(c)))
    return total


def matching_ratio(text: Column, word: str) -> Column:
    """Twice the characters in matching blocks over all characters: the longest block, then those to its left and right, and so on."""

    def ratios(texts: pd.Series) -> pd.Series:
        matcher = difflib.SequenceMatcher(b=word)
        out = []
        for t in texts:
            matcher.set_seq1(t)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(ratios, "double")(text)


def close_names(names: DataFrame, column: str, word: str, keep: int = 5, cutoff: float = 0.4) -> DataFrame:
    """The ``keep`` names most like ``word`` (ratio at least ``cutoff``; of equal ones the greater name first), with ``ratio``.

    Blocks match no more characters than the shorter name has, nor more than both have in common, so only names that these bounds
    leave are compared.
    """
    text = F.col(column)
    both = F.length(text) + len(word)
    rows = names.where(text.isNotNull() & (2 * F.least(F.length(text), F.lit(len(word))) / F.greatest(both, F.lit(1)) >= cutoff))
    rows = rows.where(2 * common_characters(text, word) / F.greatest(both, F.lit(1)) >= cutoff)
    rows = rows.withColumn("ratio", matching_ratio(text, word)).where(F.col("ratio") >= cutoff)
    return rows.orderBy(F.desc("ratio"), F.desc(column)).limit(keep)
