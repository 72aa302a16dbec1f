"""Text expressions: provider display names, script detection, search folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = " · "


@F.pandas_udf(T.StringType())
def fold_text(values: pd.Series) -> pd.Series:
    """Compatibility decomposition, case folding and removal of combining marks (no built-in offers NFKD)."""

    def fold(text: str | None) -> str | None:
        if text is None:
            return None
        if text.isascii():
            return text.lower()
        decomposed = unicodedata.normalize("NFKD", text).casefold()
        return "".join(ch for ch in decomposed if not unicodedata.combining(ch))

    return values.map(fold)


def contains_hebrew(text: Column) -> Column:
    return F.coalesce(text.rlike("[\\u0590-\\u05FF]"), F.lit(False))


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def first_text(*columns: Column) -> Column:
    """First non-blank text, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def display_name(name: Column, house_number: Column) -> Column:
    """Name and house number, either of which may be missing."""
    return F.concat_ws(" ", name, blank_to_null(house_number))


def display_text(text: Column, default: str | None = None) -> Column:
    """Underscore-separated provider names as dotted display text; blank input gives the default."""
    parts = F.filter(F.transform(F.split(text, "_"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, SEPARATOR)).otherwise(F.lit(default))
