"""Column domains as tables: feature, value, code.

A domain may have millions of values, so it stays a table in the shared folder;
the driver knows the sizes only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.functions import text
from tabveil.operators.ordering import dense_codes
from tabveil.session import materialize


@dataclass(frozen=True)
class Domain:
    """``table`` has the columns feature, value and code (0 … size - 1).

    With ``rest`` values outside the domain count as that value; without it they
    are an error, as leaving their rows out would bias every count.
    """

    table: DataFrame
    sizes: dict[str, int]
    rest: str | None = None

    @property
    def columns(self) -> list[str]:
        return list(self.sizes)

    def cells(self, a: str, b: str | None = None) -> int:
        return self.sizes[a] * (self.sizes[b] if b else 1)

    def values(self, column: str) -> DataFrame:
        return self.table.filter(F.col("feature") == column).select("value", "code")


def observed_domain(df: DataFrame, columns: Sequence[str]) -> Domain:
    """The distinct values per column, bytewise sorted, nulls as a category.

    Reading the domain off the data is not private; declare it where it can be.
    """
    columns = list(columns)
    texts = df.select(*[text.as_text(F.col(c)).alias(c) for c in columns])
    distinct = texts.unpivot([], columns, "feature", "value").distinct()
    table = materialize(dense_codes(materialize(distinct, "values")), "domain")
    found = {r["feature"]: r["n"] for r in table.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    return Domain(table, {c: found.get(c, 0) for c in columns})


def declared_domain(spark: SparkSession, values: Mapping[str, Sequence[str]], rest: str | None = None) -> Domain:
    """A domain given by the caller, in the given order. ``rest`` is added to the
    columns that do not list it."""
    listed = {c: list(v) if rest is None or rest in v else [*v, rest] for c, v in values.items()}
    rows = [(c, v, i) for c, vs in listed.items() for i, v in enumerate(vs)]
    return Domain(spark.createDataFrame(rows, "feature string, value string, code int"), {c: len(v) for c, v in listed.items()}, rest)


def as_domain(spark: SparkSession, domain: Domain | Mapping[str, Sequence[str]]) -> Domain:
    return domain if isinstance(domain, Domain) else declared_domain(spark, domain)
