"""Projection, null handling and text normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabveil.functions import scores, text
from tabveil.roles import NUMBER_SENTINELS, TEXT_SENTINELS


def select_available(df: DataFrame, wanted: Sequence[str], strict: bool = False) -> DataFrame:
    """The wanted columns that exist; ``strict`` stops at a missing one."""
    missing = [c for c in wanted if c not in df.columns]
    if strict and missing:
        raise ValueError(f"columns not in the table: {missing}")
    return df.select(*[c for c in wanted if c in df.columns])


def drop_present(df: DataFrame, unwanted: Sequence[str]) -> DataFrame:
    """Without the listed columns; absent ones do not matter."""
    return df.drop(*unwanted)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without nulls, in all columns or in a subset."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def sentinels_to_null(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    text_values: Sequence[str] = TEXT_SENTINELS,
    number_values: Sequence[int] = NUMBER_SENTINELS,
) -> DataFrame:
    """Sentinel values become null, text and numbers each by their own list."""
    chosen = set(df.columns if columns is None else columns)
    out = []
    for field in df.schema.fields:
        value = F.col(field.name)
        if field.name in chosen and isinstance(field.dataType, T.StringType):
            value = F.when(~value.isin(list(text_values)), value)
        elif field.name in chosen and isinstance(field.dataType, T.NumericType):
            value = F.when(~value.isin(list(number_values)), value)
        out.append(value.alias(field.name))
    return df.select(*out)


def fill_zero(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """0 in place of null in numeric columns."""
    return df.fillna(0, subset=list(subset) if subset else None)


def all_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns as text, null as a category of its own."""
    chosen = set(df.columns if columns is None else columns)
    return df.select(*[text.as_text(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def normalize_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns as trimmed upper-case text with ``NULL`` for missing values."""
    chosen = set(df.columns if columns is None else columns)
    return df.select(*[text.normalized(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def round_scores(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Rounded scores, 0.0 for missing ones."""
    return df.withColumns({c: scores.safe_round(F.col(c), digits) for c in columns})


def default_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scores with 0.0 for missing ones."""
    return df.withColumns({c: scores.zero_if_missing(F.col(c)) for c in columns})


def common_columns(left: DataFrame, right: DataFrame, without: Sequence[str] = ()) -> list[str]:
    """Names found in both tables, in the order of the left one."""
    there = set(right.columns) - set(without)
    return [c for c in left.columns if c in there]


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns under new names."""
    return df.withColumnsRenamed(dict(names))
