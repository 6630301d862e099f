"""Folded words: accents dropped, lower-cased, then the maximal runs of letters and digits."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shipped


def fold_text(s: str) -> str:
    """Drop combining marks of the decomposed text and lower-case it."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()


@shipped
@F.pandas_udf(T.StringType())
def _fold_wide(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold_text(x))


def folded(col: Column) -> Column:
    """Text without accents and in lower case. Plain ASCII stays in the JVM; only other texts visit Python. Null stays null."""
    wide = F.when(col.rlike(r"[^\x00-\x7F]"), col)
    return F.coalesce(_fold_wide(wide), F.lower(col))


def words_of(col: Column) -> Column:
    """Array of the maximal runs of letters and digits, in order; null for null."""
    return F.filter(F.split(col, r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def folded_words(col: Column) -> Column:
    """The folded words of ``col`` in order, repeats kept; empty for a text without letters or digits, null for null."""
    return words_of(folded(col))
