"""Statistical utility of one table against another.

Marginals of all columns come from a single pass: the columns are turned into
(feature, value) rows that collapse by map-side aggregation before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.functions import text
from tabveil.functions.literals import text_array
from tabveil.functions.scores import safe_round
from tabveil.operators.clean import common_columns
from tabveil.operators.expand import set_counts


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], list(columns), "feature", "value").filter(F.col("value").isNotNull())


def _long_pairs(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Counted rows (feature, value, other, n) for column pairs; the feature is the pair's number."""
    long = set_counts(df, columns, pairs).withColumnsRenamed({"set_no": "feature", "k0": "value", "k1": "other"})
    return long.filter(F.col("value").isNotNull() & F.col("other").isNotNull())


def with_share(counts: DataFrame, count: str = "n", name: str = "p", by: Sequence[str] = ("feature",)) -> DataFrame:
    """Add a count's share of its feature's total.

    The totals are one row per feature, which is a number of columns; they reuse
    the shuffle of the counts.
    """
    totals = counts.groupBy(*by).agg(F.sum(count).alias("__total"))
    joined = counts.join(F.broadcast(totals), list(by))
    return joined.withColumn(name, F.col(count) / F.col("__total")).drop("__total")


def marginals(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count and relative frequency per column and value, nulls left out."""
    counts = _long(df, list(columns or df.columns)).groupBy("feature", "value").agg(F.count("*").alias("n"))
    return with_share(counts)


def _aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts and shares of two long tables, whose rows may be counted (n) already; a
    value absent on one side counts 0."""
    keys = [c for c in left.columns if c != "n"]
    n = F.col("n") if "n" in left.columns else F.lit(1)
    tagged = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    counts = tagged.groupBy(*keys).agg(
        F.sum(F.when(F.col("side") == 0, n).otherwise(0)).alias("n_left"), F.sum(F.when(F.col("side") == 1, n).otherwise(0)).alias("n_right")
    )
    totals = counts.groupBy("feature").agg(F.sum("n_left").alias("t_left"), F.sum("n_right").alias("t_right"))
    # One row per feature.
    return counts.join(F.broadcast(totals), "feature").select(
        *keys, "n_left", "n_right",
        F.when(F.col("t_left") > 0, F.col("n_left") / F.col("t_left")).otherwise(0.0).alias("p"),
        F.when(F.col("t_right") > 0, F.col("n_right") / F.col("t_right")).otherwise(0.0).alias("q"),
        (F.col("t_left") > 0).alias("has_left"), (F.col("t_right") > 0).alias("has_right"),
    )


def aligned_marginals(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Both tables' marginals side by side (feature, value, p, q)."""
    columns = list(columns or common_columns(left, right))
    return _aligned(_long(left, columns), _long(right, columns)).drop("has_left", "has_right")


def _half_divergence(x: Column, other: Column) -> Column:
    return F.when(x > 0, x * F.log2(2 * x / (x + other))).otherwise(0.0)


def _distances(aligned: DataFrame) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    divergence = F.sum((_half_divergence(p, q) + _half_divergence(q, p)) / 2)
    distance = F.sqrt(F.least(F.greatest(divergence, F.lit(0.0)), F.lit(1.0)))
    # Undefined where a column has no value at all on one side.
    known = F.bool_and("has_left") & F.bool_and("has_right")
    return aligned.groupBy("feature").agg(F.when(known, distance).alias("jsd"))


def jsd_per_column(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Jensen–Shannon distance (base 2) per column."""
    columns = list(columns or common_columns(left, right))
    return _distances(_aligned(_long(left, columns), _long(right, columns)))


def marginal_utility(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """1 - mean distance over the common columns, one row."""
    return jsd_per_column(left, right, columns).agg((1 - F.avg("jsd")).alias("utility"))


def column_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def jsd_per_pair(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Jensen–Shannon distance of the joint distribution of every column pair."""
    columns = list(columns or common_columns(left, right))
    pairs = column_pairs(columns)
    distances = _distances(_aligned(_long_pairs(left, columns, pairs), _long_pairs(right, columns, pairs)))
    first, second = (text_array([p[i] for p in pairs]) for i in (0, 1))
    return distances.select(
        F.get(first, F.col("feature")).alias("column_a"), F.get(second, F.col("feature")).alias("column_b"), "jsd"
    )


def joint_utility(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """1 - mean distance over all column pairs, one row."""
    return jsd_per_pair(left, right, columns).agg((1 - F.avg("jsd")).alias("utility"))


def mean_gap(original: DataFrame, copies: DataFrame, columns: Sequence[str], by: str = "epsilon") -> DataFrame:
    """|mean(original) - mean(copy)| per column and ε of a family of copies."""
    base = original.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(
        *[F.avg(c).alias(c) for c in columns]
    ).unpivot([], list(columns), "feature", "mean_original")
    means = copies.groupBy(by).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    long = means.unpivot([by], list(columns), "feature", "mean_copy")
    # One row per column.
    joined = long.join(F.broadcast(base), "feature")
    return joined.withColumn("gap", F.abs(F.col("mean_original") - F.col("mean_copy")))


def tables_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: do both tables hold the same rows equally often, in any order.

    Equal rows are counted together before the shuffle, so repeats are cheap.
    """
    if set(left.columns) != set(right.columns):
        return left.sparkSession.range(1).select(F.lit(False).alias("identical"))
    signed = left.withColumn("__side", F.lit(1)).unionByName(right.withColumn("__side", F.lit(-1)))
    surplus = signed.groupBy(*left.columns).agg(F.sum("__side").alias("surplus"))
    return surplus.agg((F.count_if(F.col("surplus") != 0) == 0).alias("identical"))


def dp_gain(df: DataFrame, total: str = "score_total", generalised: str = "score_wrangling") -> DataFrame:
    """Score gained by the private copy over generalisation alone."""
    return df.withColumn("dp_gain", F.round(F.col(total) - F.col(generalised), 4))


def mutual_information(df: DataFrame, target: str, columns: Sequence[str] | None = None,
                       unit: str = "nats") -> DataFrame:
    """Mutual information of each column with the target, nulls as a category.

    Written as H(x) + H(y) - H(x, y): three nested aggregations of one count
    table, with no join against the margins.
    """
    columns = [c for c in (columns or df.columns) if c != target]
    texts = df.select(F.col(target).cast("string").alias("__y"), *[F.col(c).cast("string").alias(c) for c in columns])
    cells = texts.unpivot(["__y"], columns, "feature", "value").groupBy("feature", "value", "__y").agg(
        F.count("*").alias("n")
    )
    n = F.col("n")
    rows = cells.groupBy("feature", "value").agg(F.sum("n").alias("n"), F.sum(n * F.log(n)).alias("xy"))
    per_feature = rows.groupBy("feature").agg(
        F.sum("n").alias("total"), F.sum("xy").alias("xy"), F.sum(n * F.log(n)).alias("x"),
        F.count("value").alias("cardinality"),
    )
    y = texts.groupBy("__y").agg(F.count("*").alias("n")).agg(F.sum(n * F.log(n)).alias("y"))
    total = F.col("total")
    mi = F.greatest((F.col("xy") - F.col("x") - y.scalar()) / total + F.log(total), F.lit(0.0))
    if unit == "bits":
        mi = mi / F.log(F.lit(2.0))
    return per_feature.select("feature", mi.alias("mi"), "cardinality")


def dp_efficiency(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Mutual information per bit of cardinality, best column first."""
    scored = mutual_information(df, target, columns)
    cardinality = F.col("cardinality")
    ratio = F.when(cardinality > 1, F.col("mi") / F.log2(cardinality)).otherwise(0.0)
    return scored.select(
        "feature", safe_round(F.col("mi")).alias("mi_raw"), "cardinality", safe_round(ratio).alias("dp_efficiency")
    ).orderBy(F.desc("dp_efficiency"), "feature")


def as_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as text with nulls as a category, for comparisons that count them."""
    return df.select(*[text.as_text(F.col(c)).alias(c) for c in columns])
