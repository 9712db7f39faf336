"""Label encoding: sorted distinct values become 0..k-1."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.functions import text
from tabveil.operators.ordering import dense_codes
from tabveil.session import materialize, settle


def dictionary(tables: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """(feature, value, code) over the union of the tables, nulls as a category.

    Codes are ranks within each column, found without sorting in one task. The
    distinct values are written first: ranks pass over them several times, and the
    planner would else place every value of every row among the ranges.
    """
    distinct = None
    for df in tables:
        texts = df.select(*[text.as_text(F.col(c)).alias(c) for c in columns])
        long = texts.unpivot([], list(columns), "feature", "value")
        distinct = long if distinct is None else distinct.unionByName(long)
    return dense_codes(materialize(distinct.distinct(), "values"))


def encode(df: DataFrame, codes: tuple[DataFrame, bool], columns: Sequence[str], unseen: int | None = None,
           names: Mapping[str, str] | None = None) -> DataFrame:
    """Replace values by their codes; a value not in the dictionary gets ``unseen``.

    ``codes`` is a settled dictionary: broadcast per column if it is small, else
    a plain equi-join per column, whose hot values adaptive execution splits.
    """
    names = names or {}
    codes, small = codes
    out = df
    for c in columns:
        target = names.get(c, c)
        table = codes.filter(F.col("feature") == c).select(
            F.col("value").alias("__value"), F.col("code").alias("__code")
        )
        joined = out.join(F.broadcast(table) if small else table, text.as_text(F.col(c)) == F.col("__value"), "left")
        code = F.col("__code") if unseen is None else F.coalesce(F.col("__code"), F.lit(unseen))
        out = joined.withColumn(target, code).drop("__value", "__code")
    return out


def encode_union(tables: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """All tables encoded with one dictionary over their union."""
    codes = settle(dictionary(tables, columns))
    return [encode(df, codes, columns) for df in tables]


def encode_by_first(first: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """All tables encoded with the first one's dictionary; unseen values get 0."""
    codes = settle(dictionary([first], columns))
    return [encode(df, codes, columns, unseen=0) for df in (first, *others)]
