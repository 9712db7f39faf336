"""Generalisation: years, bins, top-N categories, whole profiles.

None of this is differentially private: the kept categories, the median and the
cut points come straight from the data. A privacy budget spent later covers the
synthesiser only. Pass public categories or cuts where that matters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabveil.functions import text
from tabveil.functions.literals import is_one_of
from tabveil.operators.clean import normalize_text, select_available
from tabveil.operators.ordering import order_statistics
from tabveil.session import BROADCAST_BYTES, BROADCAST_ROWS
from tabveil.roles import (
    BASE_COLUMNS, GENERATION_BINS, IDENTIFIER_COLUMNS, NO_SOURCE_TOKEN, REST_TOKEN, SHORT_REST_TOKEN,
    Strategy, strategy,
)

RANK_SALTS = 64
LITERAL_VALUES = 5_000  # longer lists of kept values go through a join


def birth_year(column: Column, pattern: str = "dd/MM/yyyy") -> Column:
    """Year of a date text; null where the text is no date."""
    return F.year(F.try_to_timestamp(column, F.lit(pattern)))


def with_birth_year(df: DataFrame, source: str, name: str = "year", pattern: str = "dd/MM/yyyy",
                    impute: bool = True) -> DataFrame:
    """Add the birth year, with the median of the known years for unknown ones.

    The exact median keeps one counter per distinct year, of which there are few.
    """
    year = birth_year(F.col(source), pattern)
    if impute:
        median = df.agg(F.median(year)).scalar()
        year = F.coalesce(year.cast("double"), median)
    return df.withColumn(name, year)


def exact_year(year: Column) -> Column:
    """The year as text, decimals cut off."""
    return year.cast("int").cast("string")


def fixed_bins(value: Column, bins: Sequence[tuple[float, float, str]] = GENERATION_BINS) -> Column:
    """Label of the right-closed interval (low, high]; null outside all bins."""
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, name in bins:
        label = label.when((value > low) & (value <= high), name)
    return label


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (feature, value), all columns in one pass, nulls included."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], list(columns), "feature", "value").groupBy("feature", "value").agg(F.count("*").alias("n"))


def top_categories(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """The most frequent values per column, one more than the limit asks for.

    Ties go to the smaller value. Ranking runs first within salts of the value,
    so a column with very many values never meets in one task.
    """
    counts = value_counts(df, list(limits)).filter(F.col("value").isNotNull())
    most = max(limits.values()) + 1
    order = [F.desc("n"), F.asc("value")]
    salt = F.pmod(F.xxhash64("value"), F.lit(RANK_SALTS))
    local = (
        counts.withColumn("salt", salt)
        .withColumn("rank", F.row_number().over(W.partitionBy("feature", "salt").orderBy(*order)))
        .filter(F.col("rank") <= most)
    )
    ranked = local.withColumn("rank", F.row_number().over(W.partitionBy("feature").orderBy(*order)))
    bound = F.create_map(*[x for c, k in limits.items() for x in (F.lit(c), F.lit(k + 1))])
    return (
        ranked.filter((F.col("rank") <= most) & (F.col("rank") <= bound[F.col("feature")]))
        .select("feature", "value", "n", "rank")
    )


def keep_categories(df: DataFrame, kept: Mapping[str, Sequence[str]], rest: str = REST_TOKEN) -> DataFrame:
    """Listed values stay, all others become ``rest``; the columns become text.

    Also the entry for public category lists that cost no privacy.
    """
    literal = {c: v for c, v in kept.items() if len(v) <= LITERAL_VALUES}
    out = df.select(*[
        F.when(is_one_of(c, literal[c]), F.col(c).cast("string")).otherwise(rest).alias(c) if c in literal
        else F.col(c).cast("string").alias(c) if c in kept else F.col(c)
        for c in df.columns
    ])
    for column, values in kept.items():
        if column in literal:
            continue
        # As many rows as the caller listed; the list is on the driver already.
        table = df.sparkSession.createDataFrame([(v, True) for v in values], f"`{column}` string, kept boolean")
        small = len(values) <= BROADCAST_ROWS and sum(len(str(v)) for v in values) * 4 <= BROADCAST_BYTES
        table = F.broadcast(table) if small else table
        out = out.join(table, column, "left").withColumn(
            column, F.when(F.col("kept"), F.col(column)).otherwise(rest)
        ).drop("kept").select(*df.columns)
    return out


def top_n_other(df: DataFrame, limits: Mapping[str, int], rest: str = REST_TOKEN, guard: bool = True) -> DataFrame:
    """Keep the top-N values per column and group the others under ``rest``.

    With ``guard`` a column with at most N values stays as it is, otherwise
    every column is rewritten (nulls then become ``rest``). A rewritten column
    has up to N + 1 values. One small job reads off the kept values: at most
    N + 1 per column.
    """
    limits = {c: n for c, n in limits.items() if c in df.columns}
    if not limits:
        return df
    kept: dict[str, list[str]] = {c: [] for c in limits}
    overfull = set()
    for row in top_categories(df, limits).collect():
        if row["rank"] <= limits[row["feature"]]:
            kept[row["feature"]].append(row["value"])
        else:
            overfull.add(row["feature"])
    chosen = {c: v for c, v in kept.items() if c in overfull or not guard}
    return keep_categories(df, chosen, rest) if chosen else df


def top_15_other(df: DataFrame, columns: Sequence[str], rest: str = SHORT_REST_TOKEN) -> DataFrame:
    """Top-15 rewrite of the given columns, whatever their number of values."""
    return top_n_other(df, {c: 15 for c in columns}, rest=rest, guard=False)


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column."""
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return wide.unpivot([], list(columns), "feature", "n_distinct")
    return value_counts(df, columns).groupBy("feature").agg(F.count("value").alias("n_distinct"))


def cardinality_report(df: DataFrame, columns: Sequence[str] | None = None, bound: int = 50,
                       approximate: bool = False) -> DataFrame:
    """Distinct values per column and whether they are few enough."""
    counts = distinct_counts(df, list(columns or df.columns), approximate)
    # --- fixed values: status labels ---
    status = F.when(F.col("n_distinct") < bound, "✅ SEGURO").otherwise("🚨 ALTO RISCO")
    return counts.withColumn("status", status)


def quantile_cuts(df: DataFrame, column: str, k: int, exact: bool = True) -> list[float]:
    """The k - 1 inner cut points of k bins of equal frequency, without repeats."""
    fractions = [i / k for i in range(1, k)]
    if exact:
        cuts = order_statistics(df, column, fractions).first()["cuts"]
    else:
        cuts = df.agg(F.percentile_approx(column, fractions)).first()[0]
    return sorted({c for c in cuts or [] if c is not None})


def bin_number(value: Column, cuts: Sequence[float]) -> Column:
    """1-based bin of a value; a cut point belongs to the bin below it."""
    number = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, cut in enumerate(cuts):
        number = number.when(value <= cut, i + 1)
    return number.otherwise(len(cuts) + 1)


def quantile_bins(df: DataFrame, column: str, k: int, name: str, exact: bool = True) -> DataFrame:
    """Add the equal-frequency bin of a numeric column."""
    return df.withColumn(name, bin_number(F.col(column), quantile_cuts(df, column, k, exact)))


def with_midpoint(df: DataFrame, bin_column: str, edges: Sequence[float], name: str) -> DataFrame:
    """Add the middle of the bin's interval; bin i spans edges i-1 to i."""
    middle = F.when(F.lit(False), F.lit(None).cast("double"))
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        middle = middle.when(F.col(bin_column) == i + 1, (float(low) + float(high)) / 2)
    return df.withColumn(name, middle)


def apply_wrangling(
    df: DataFrame,
    profile: str | Strategy = "intensive",
    keep: Sequence[str] = (),
    identifiers: Sequence[str] = tuple(IDENTIFIER_COLUMNS),
    base: Sequence[str] = tuple(BASE_COLUMNS),
    birth_date: str = "DT_NASCIMENTO",
    date_pattern: str = "dd/MM/yyyy",
) -> DataFrame:
    """Generalise a record table under a named profile.

    Identifiers go, the birth date becomes a year or a generation, the base
    columns become normalised text and rare values are grouped. Columns in
    ``keep`` (a row id, a target) pass through unchanged; a base column among
    them is treated as usual.
    """
    plan = strategy(profile)
    passed = [c for c in keep if c not in base and c in df.columns]
    held = [F.col(c).alias(f"__{c}") for c in passed]
    used = [c for c in [*base, birth_date] if c in df.columns and c not in identifiers]
    df = df.select(*held, *used)
    if birth_date in df.columns:
        df = with_birth_year(df, birth_date, "__year", date_pattern)
        age = exact_year(F.col("__year")) if plan.exact_year else fixed_bins(F.col("__year"))
        df = df.withColumn("FAIXA_ETARIA", age)
    else:
        df = df.withColumn("FAIXA_ETARIA", F.lit(NO_SOURCE_TOKEN))
    available = [c for c in base if c in df.columns]
    df = normalize_text(select_available(df, [*[f"__{c}" for c in passed], *available]), available)
    df = top_n_other(df, {c: plan.limit_of(c) for c in available if c not in plan.skip})
    return df.withColumnsRenamed({f"__{c}": c for c in passed})


def normalized_label(column: Column) -> Column:
    """A target as normalised text."""
    return text.normalized(column)
