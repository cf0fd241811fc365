"""Text functions: normalization for comparisons, and orders of strings."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize(text: str, case_sensitive: bool = False, accent_sensitive: bool = False) -> str:
    """NFD without marks, in lower case; the flags leave out either step."""
    out = unicodedata.normalize("NFD", text)
    if not accent_sensitive:
        out = "".join(c for c in out if unicodedata.category(c)[0] != "M")
    return out if case_sensitive else out.lower()


@cache
def _others(case_sensitive: bool, accent_sensitive: bool):
    """One function per pair of flags, so that Spark sees equal expressions as equal and evaluates them once."""

    @F.pandas_udf(T.StringType())
    def others(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else normalize(t, case_sensitive, accent_sensitive))

    return others


def normalized(text: Column, case_sensitive: bool = False, accent_sensitive: bool = False) -> Column:
    """normalize() of a column. ASCII rows stay in the JVM; the others go through Arrow."""
    ascii_form = text if case_sensitive else F.lower(text)
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, ascii_form).otherwise(_others(case_sensitive, accent_sensitive)(F.when(~plain, text)))


def utf16_order(text: Column) -> Column:
    """A key that sorts by UTF-16 code units."""
    return F.encode(text, "UTF-16BE")
