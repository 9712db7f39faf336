"""Exact ranks and cut points without sorting a table in one task.

Each function first counts rows per bucket, which leaves a short table, finds
the bucket that holds the wanted rank, and ranks inside that bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabveil.functions.hashing import leading_int, row_digest
from tabveil.session import small_or_same

DIGEST_DIGITS = 4  # 65,536 buckets of a uniform digest
SPLITS = 256


def sort_key(ids: Sequence[str], seed: int | str) -> Column:
    """The digest followed by the id, so that the order is total."""
    return F.struct(row_digest(ids, seed).alias("digest"), *[F.col(c) for c in ids])


def nth_keys(df: DataFrame, ids: Sequence[str], seed: int | str, wanted: DataFrame, by: Sequence[str] = (),
             ties: bool = False) -> DataFrame:
    """The ``wanted`` smallest sort key, per group. With ``ties`` also ``take`` and
    ``tied``: how many rows with this key belong to the first ones, and how many there are.

    ``wanted`` has the columns ``by`` and ``k`` (one row per group). A group with
    fewer than ``k`` rows, or ``k`` below 1, gives no row. Groups may be of any
    size: the ranked slices are 1/65,536 of a group each.
    """
    by = list(by)
    keys = df.select(*by, sort_key(ids, seed).alias("key"))
    keys = keys.withColumn("bucket", leading_int(F.col("key.digest"), DIGEST_DIGITS))
    filled = keys.groupBy(*by, "bucket").agg(F.count("*").alias("n"))
    running = W.partitionBy(*by).orderBy("bucket")
    spans = filled.withColumn("upto", F.sum("n").over(running))
    if by:
        spans = spans.join(wanted, by)
        cut = (
            spans.filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
            .select(*by, "bucket", (F.col("k") - F.col("upto") + F.col("n")).alias("rank"))
        )
        # One row per group; broadcast if there are few groups, so that the table
        # is filtered where it lies.
        cut, small = small_or_same(cut)
        inside = keys.join(F.broadcast(cut) if small else cut, [*by, "bucket"])
    else:
        k = wanted.select("k").scalar()
        cut = spans.filter(F.col("upto") >= k).agg(
            F.min(F.struct("bucket", (k - F.col("upto") + F.col("n")).alias("rank"))).alias("cut")
        )
        inside = keys.withColumn("cut", cut.scalar()).filter("bucket = cut.bucket").select("key", "bucket", "cut.rank")
    order = W.partitionBy(*by, "bucket").orderBy("key")
    ranked = inside.withColumn("position", F.row_number().over(order))
    if not ties:
        return ranked.filter("position = rank").select(*by, "key")
    near = ranked.withColumns({"before": F.rank().over(order) - 1, "tied": F.count("*").over(W.partitionBy(*by, "bucket", "key"))})
    return near.filter("position = rank").select(*by, "key", (F.col("position") - F.col("before")).alias("take"), "tied")


def split_points(distinct: DataFrame, key: Column, splits: int = SPLITS) -> DataFrame:
    """One row with up to ``splits`` sorted key values that cut the distinct
    keys into ranges of similar length (a uniform draw by digest)."""
    drawn = distinct.select(key.alias("key")).orderBy(F.md5(F.to_json(F.struct("key")))).limit(splits)
    return drawn.agg(F.sort_array(F.collect_list("key")).alias("splits"))


def range_of(distinct: DataFrame, key: Column, splits: int = SPLITS) -> DataFrame:
    """The table with ``key`` and the number of its range, ``range_no``."""
    points = split_points(distinct, key, splits)
    keyed = distinct.withColumns({"key": key, "splits": points.scalar()})
    return keyed.withColumn(
        "range_no", F.size(F.filter("splits", lambda p: p <= F.col("key")))
    ).drop("splits")


def dense_codes(distinct: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """0..k-1 by sorted value within each feature, for distinct pairs."""
    ranged = range_of(distinct.select(feature, value), F.struct(feature, value))
    sizes = ranged.groupBy(feature, "range_no").agg(F.count("*").alias("n"))
    before = sizes.select(
        feature, "range_no",
        (F.sum("n").over(W.partitionBy(feature).orderBy("range_no")) - F.col("n")).alias("before"),
    )
    inner = F.row_number().over(W.partitionBy(feature, "range_no").orderBy(value))
    # `before` has at most SPLITS + 1 rows per feature.
    return (
        ranged.withColumn("inner", inner).join(F.broadcast(before), [feature, "range_no"])
        .select(feature, value, (F.col("before") + F.col("inner") - 1).cast("int").alias("code"))
    )


def order_statistics(df: DataFrame, column: str, fractions: Sequence[float]) -> DataFrame:
    """One row with the exact values at the given fractions of the sorted column.

    The value at fraction f is the smallest one with at least ceil(f·n) rows up
    to it. Equal values are counted together before anything is sorted.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranged = range_of(counts, F.col("v"))
    sizes = ranged.groupBy("range_no").agg(F.sum("n").alias("size"))
    # At most SPLITS + 1 rows, so one task may hold them.
    before = sizes.select("range_no", (F.sum("size").over(W.orderBy("range_no")) - F.col("size")).alias("before"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    inner = F.sum("n").over(W.partitionBy("range_no").orderBy("v"))
    upto = (
        ranged.withColumn("inner", inner).join(F.broadcast(before), "range_no")
        .select("v", (F.col("before") + F.col("inner")).alias("upto"), total.alias("total"))
    )
    reached = [
        F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(float(f)) * F.col("total"))), F.col("v")))
        for f in fractions
    ]
    return upto.agg(F.array(*reached).alias("cuts"))
