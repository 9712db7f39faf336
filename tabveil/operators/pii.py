"""Columns with personal data: detection by pattern, and treatment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabveil.operators.sampling import sample_exact


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    score: float


# --- fixed values: the tax-number pattern, its score and the cut-offs ------
CPF = Pattern("CPF", r"\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11}", 0.8)
SCORE_CUTOFF = 0.4
HIT_SHARE = 0.1
# The same number with no digit on either side of it.
CPF_STRICT = Pattern("CPF", r"(^|\D)(\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11})(\D|$)", 0.8)


def matches(column: Column, patterns: Sequence[Pattern] = (CPF,), cutoff: float = SCORE_CUTOFF) -> Column:
    """True where a pattern of sufficient score occurs anywhere in the text."""
    active = [p for p in patterns if p.score >= cutoff]
    hit = F.lit(False)
    for p in active:
        hit = hit | F.coalesce(column.cast("string").rlike(p.regex), F.lit(False))
    return hit


def cpf_digits(column: Column) -> Column:
    """The 11 digits of the first stand-alone tax number in a text, else null."""
    found = F.regexp_extract(column.cast("string"), CPF_STRICT.regex, 2)
    digits = F.regexp_replace(found, r"\D", "")
    return F.when(F.length(digits) == 11, digits)


def cpf_checks_out(digits: Column) -> Column:
    """Whether both check digits of an 11-digit text are right (modulo 11)."""
    d = [F.substring(digits, i + 1, 1).cast("int") for i in range(11)]
    first = sum(((10 - i) * d[i] for i in range(9)), F.lit(0)) * 10 % 11 % 10
    second = sum(((11 - i) * d[i] for i in range(10)), F.lit(0)) * 10 % 11 % 10
    return (first == d[9]) & (second == d[10])


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def pii_shares(df: DataFrame, columns: Sequence[str] | None = None, patterns: Sequence[Pattern] = (CPF,),
               sample_rows: int | None = None, row_id: str | None = None, seed: int = 42) -> DataFrame:
    """Share of rows per text column that match a pattern; one pass, one row per
    column. ``sample_rows`` looks at an exact sample instead of every row."""
    columns = list(columns or text_columns(df))
    if sample_rows is not None:
        if row_id is None:
            raise ValueError("a sample needs a row id")
        df = sample_exact(df, sample_rows, row_id, seed)
    wide = df.agg(*[F.avg(matches(F.col(c), patterns).cast("double")).alias(c) for c in columns])
    return wide.unpivot([], columns, "feature", "share")


def pii_columns(df: DataFrame, share: float = HIT_SHARE, **kwargs) -> DataFrame:
    """Columns with their hit share and the flag that it exceeds the limit."""
    return pii_shares(df, **kwargs).withColumn("is_pii", F.coalesce(F.col("share") > share, F.lit(False)))


def flagged(report: DataFrame) -> list[str]:
    """Names of the flagged columns (one row per column)."""
    return sorted(r["feature"] for r in report.filter("is_pii").collect())


def drop_flagged(df: DataFrame, report: DataFrame) -> DataFrame:
    """The table without its flagged columns."""
    return df.drop(*flagged(report))


def pii_report(report: DataFrame, action: str = "DROPPED") -> DataFrame:
    """One row with a map from flagged column to what was done with it."""
    entry = F.struct(F.col("feature"), F.lit(action))
    return report.filter("is_pii").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("pii_report"))


def masked(column: Column) -> Column:
    """Letters become X or x, digits n; the shape of the value stays."""
    return F.mask(column)


def hashed(column: Column, salt: str) -> Column:
    """Salted SHA-256; without a secret salt, short values can be guessed."""
    return F.sha2(F.concat(F.lit(salt), column.cast("string")), 256)


def redacted(column: Column, pattern: Pattern = CPF, token: str | None = None) -> Column:
    """Every match replaced by a token."""
    return F.regexp_replace(column, pattern.regex, token or f"<{pattern.name}>")


def treat(df: DataFrame, treatments: Mapping[str, Column]) -> DataFrame:
    """Apply one treatment per column, keeping order and names."""
    return df.select(*[treatments[c].alias(c) if c in treatments else F.col(c) for c in df.columns])
