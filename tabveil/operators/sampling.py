"""Exact, repeatable samples and splits.

Every draw follows the digest of the row id, so it is the same for any
partitioning and after a lost task. Samples compare each row with a cut key
found beforehand; the big table is filtered in place and never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.functions.hashing import row_uniform
from tabveil.operators.ordering import nth_keys, sort_key
from tabveil.session import lookup


def _one(df: DataFrame, k) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(k).cast("long").alias("k"))


def sample_exact(df: DataFrame, n: int, row_id: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: those with the smallest digests.

    Rows that share an id share a digest; where the cut falls among them, those
    with the smallest hash of all their columns are taken.
    """
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    if n < 1:
        return df.limit(0)
    cut = nth_keys(df, ids, seed, _one(df, n), ties=True).first()  # one row
    if cut is None:
        return df
    kinds = {f.name: f.dataType for f in df.schema.fields}
    last = F.struct(F.lit(cut["key"]["digest"]).alias("digest"), *[F.lit(cut["key"][c]).cast(kinds[c]).alias(c) for c in ids])
    if cut["take"] == cut["tied"]:
        return df.filter(sort_key(ids, seed) <= last)
    tied = df.filter(sort_key(ids, seed).eqNullSafe(last)).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).limit(cut["take"])
    return df.filter(sort_key(ids, seed) < last).unionByName(tied)


def sample_guard(df: DataFrame, row_id: str, max_rows: int | None = None, n: int = 10_000, seed: int = 42) -> DataFrame:
    """The whole table, or a sample of ``n`` once it has more than ``max_rows``."""
    if max_rows is None:
        return df
    total = df.agg(F.count("*")).scalar()
    last = nth_keys(df, [row_id], seed, _one(df, n)).scalar()
    return df.filter((total <= max_rows) | F.coalesce(sort_key([row_id], seed) <= last, F.lit(True)))


def split_random(df: DataFrame, test_fraction: float, row_id: str, seed: int = 42,
                 name: str = "is_test") -> DataFrame:
    """Mark a random share of the rows as test rows; no shuffle."""
    return df.withColumn(name, row_uniform([row_id], seed) < test_fraction)


def train_test(df: DataFrame, test_fraction: float, row_id: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The two sides of a random split."""
    marked = split_random(df, test_fraction, row_id, seed, "__test")
    return marked.filter(~F.col("__test")).drop("__test"), marked.filter("__test").drop("__test")


def split_stratified(df: DataFrame, stratum: str, test_fraction: float, row_id: str, seed: int = 42,
                     name: str = "is_test") -> DataFrame:
    """Mark ``round(fraction · rows)`` rows of each stratum as test rows.

    Rows with a null stratum form a stratum of their own.
    """
    keyed = df.withColumn("__stratum", F.struct(F.col(stratum)))
    wanted = keyed.groupBy("__stratum").agg(F.round(F.lit(test_fraction) * F.count("*")).cast("long").alias("k"))
    cuts = nth_keys(keyed, [row_id], seed, wanted, by=["__stratum"]).withColumnRenamed("key", "__cut")
    marked = lookup(keyed, cuts, ["__stratum"])
    inside = F.coalesce(sort_key([row_id], seed) <= F.col("__cut"), F.lit(False))
    return marked.select(*df.columns, inside.alias(name))


def split_disjoint(df: DataFrame, first: int, second: int | None, row_id: str, seed: int = 42,
                   name: str = "part") -> DataFrame:
    """Two disjoint populations in digest order: ``first`` rows, then ``second``.

    Rows beyond both are left out; ``second=None`` takes all that remain.
    """
    key = sort_key([row_id], seed)
    if first < 1:
        in_first = F.lit(False)
    else:
        in_first = F.coalesce(key <= nth_keys(df, [row_id], seed, _one(df, first)).scalar(), F.lit(True))
    marked = df.withColumn(name, F.when(in_first, "A").otherwise("B"))
    if second is None:
        return marked
    if first + second < 1:
        return marked.limit(0)
    last = nth_keys(df, [row_id], seed, _one(df, first + second)).scalar()
    return marked.filter(F.coalesce(key <= last, F.lit(True)))


def halves(df: DataFrame, row_id: str, seed: int | str = "half") -> tuple[DataFrame, DataFrame]:
    """The table in two disjoint halves by digest."""
    u = row_uniform([row_id], seed)
    return df.filter(u < 0.5), df.filter(u >= 0.5)
