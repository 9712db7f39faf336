"""Exact nearest neighbours on text and numeric columns.

The distance of two rows is the number of text columns on which they differ plus,
per numeric column, their gap as a share of the column's range, at most 1 (Gower).
Of two nulls the gap is 0, of a null and a number 1.

Rows are looked for under each set of agreeing text columns, larger sets first.
Under one set, rows with the same texts lie sorted by the first numeric column in
buckets of 64. A target starts in the bucket where it would stand and goes outward,
one bucket to each side, then two, four and so on. It stops on a side where the set's texts end or
where the gap in the first column alone is too large to better what it has found,
and it skips sets whose missing columns alone are. No bound is guessed and no
candidate is given up, so the result is exact.

Equal rows are searched as one. Sorting is by ranges, so a set of texts that most
rows share is many buckets, not one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabveil.session import materialize

BUCKET = 64
WIDEST = 64  # buckets that a target looks at in one round, from 1 on doubling
PLACE_BITS = 33  # monotonically_increasing_id: the row's number within its partition


def column_ranges(tables: Sequence[DataFrame], numeric: Sequence[str]) -> dict[str, float]:
    """Largest less smallest value of each numeric column over some tables."""
    low, high = {}, {}
    for df in tables:
        row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"l_{c}") for c in numeric],
                     *[F.max(F.col(c).cast("double")).alias(f"h_{c}") for c in numeric]).first()
        for c in numeric:
            if row[f"l_{c}"] is not None:
                low[c], high[c] = min(low.get(c, row[f"l_{c}"]), row[f"l_{c}"]), max(high.get(c, row[f"h_{c}"]), row[f"h_{c}"])
    return {c: high[c] - low[c] if c in low else 0.0 for c in numeric}


def _gap(a: Column, b: Column, extent: float) -> Column:
    """Gap of two numbers as a share of the range, at most 1."""
    apart = F.least(F.abs(a - b) / F.lit(extent), F.lit(1.0)) if extent > 0 else F.when(a == b, 0.0).otherwise(1.0)
    return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull() | b.isNull(), 1.0).otherwise(apart)


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``rank``: how many index rows (``own`` null) stand before a row in the
    order. Sorted by ranges; only counts per range are looked at as a whole."""
    keys = [*order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    dealt = dealt.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.shiftright("seq", PLACE_BITS))
    dealt = materialize(dealt, "sorted")
    is_row = F.when(F.col("own").isNull(), 1).otherwise(0)
    counts = dealt.groupBy("part").agg(F.sum(is_row).alias("k"))
    # One row per range.
    before = counts.select("part", (F.sum("k").over(W.orderBy("part")) - F.col("k")).alias("before"))
    inner = F.sum(is_row).over(W.partitionBy("part").orderBy("seq")) - is_row
    return dealt.withColumn("inner", inner).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("inner")).drop(
        "seq", "part", "inner", "before")


def nearest_mixed(targets: DataFrame, table: DataFrame, text: Sequence[str], numeric: Sequence[str], row_id: str,
                  ranges: Mapping[str, float] | None = None) -> DataFrame:
    """The nearest row of ``table`` for every distinct combination in ``targets``.

    Result: the columns, ``distance`` and ``neighbour`` (its id); equal distances go
    to the smallest id. Text columns must be text without nulls; numbers are
    compared as doubles. ``ranges`` default to those over both tables.
    """
    text, numeric = list(text), list(numeric)
    if not numeric:
        raise ValueError("without a numeric column use nearest")
    extent = dict(ranges or column_ranges([targets, table], numeric))
    texts = F.array(*[F.col(c) for c in text]) if text else F.array().cast("array<string>")
    numbers = F.array(*[F.col(c).cast("double") for c in numeric])
    points = table.groupBy(texts.alias("t"), numbers.alias("v")).agg(F.min(row_id).alias("neighbour"))
    points = materialize(points, "points")
    wanted = targets.select(texts.alias("t"), numbers.alias("v")).distinct()
    wanted = materialize(wanted.withColumn("own", F.monotonically_increasing_id()), "targets")
    id_kind = points.schema["neighbour"].dataType.simpleString()
    best = wanted.select("own", F.lit(None).cast(f"struct<distance:double,neighbour:{id_kind}>").alias("best"))

    def distance(mine_t: str, mine_v: str, row: Column) -> Column:
        differing = F.size(F.filter(F.zip_with(F.col(mine_t), row["t"], lambda x, y: x != y), lambda d: d))
        total = differing.cast("double")
        for i, c in enumerate(numeric):
            total = total + _gap(F.col(mine_v)[i], row["v"][i], extent[c])
        return total

    for d in range(len(text) + 1):
        sets = [list(s) for s in combinations(range(len(text)), len(text) - d)]
        open_ = wanted.join(best, "own").filter(F.col("best").isNull() | (F.col("best.distance") >= d))
        if not open_.limit(1).count():
            break
        chosen = F.array(*[F.array(*[F.lit(i) for i in s]).cast("array<int>") for s in sets])

        def keyed(df: DataFrame, *more: str, chosen: Column = chosen) -> DataFrame:
            every = df.select("t", "v", *more, F.posexplode(chosen).alias("set_no", "places"))
            return every.withColumn("key", F.transform("places", lambda i: F.get(F.col("t"), i))).drop("places")

        none_id, none_own = F.lit(None).cast(id_kind).alias("neighbour"), F.lit(None).cast("long").alias("own")
        both = keyed(points, "neighbour").withColumn("own", none_own).unionByName(keyed(open_, "own").withColumn("neighbour", none_id))
        ranked = materialize(_ranked(both.withColumn("x", F.col("v")[0]), ["set_no", "key", "x"]), "ranked")
        rows = ranked.filter("own IS NULL").withColumn("bucket", F.expr(f"rank div {BUCKET}"))
        entry = F.struct("rank", "set_no", "key", "t", "v", "neighbour")
        buckets = materialize(rows.groupBy("bucket").agg(F.sort_array(F.collect_list(entry)).alias("rows")), "buckets")
        start = ranked.filter("own IS NOT NULL").select("own", "set_no", "key", "t", "v", F.expr(f"rank div {BUCKET}").alias("bucket"))
        state = start.withColumn("step", F.lit(1)).unionByName(start.withColumns({"bucket": F.col("bucket") - 1, "step": F.lit(-1)}))
        width = 1
        while True:
            last = F.col("bucket") + F.col("step") * (width - 1)
            visits = state.withColumn("last", last).withColumn("bucket", F.explode(F.sequence("bucket", "last", F.col("step").cast("long"))))
            met = visits.join(buckets, "bucket")
            mine = F.filter("rows", lambda r: (r["set_no"] == F.col("set_no")) & (r["key"] == F.col("key")))
            found = F.array_min(F.transform("mine", lambda r: F.struct(distance("t", "v", r).alias("distance"), r["neighbour"].alias("neighbour"))))
            edge = F.when(F.col("step") > 0, F.element_at("rows", -1)).otherwise(F.element_at("rows", 1))
            # Whether the texts go on beyond the last bucket of this round.
            goes_on = (F.col("bucket") == F.col("last")) & (F.col("edge.set_no") == F.col("set_no")) & (F.col("edge.key") == F.col("key"))
            bound = F.lit(float(d)) + _gap(F.col("v")[0], F.col("edge.v")[0], extent[numeric[0]])
            met = met.withColumns({"mine": mine, "edge": edge}).select(
                "own", "set_no", "key", "t", "v", "bucket", "step", found.alias("found"), goes_on.alias("goes_on"), bound.alias("bound"))
            met = materialize(met, "met")
            better = met.groupBy("own").agg(F.min("found").alias("found"))
            best = materialize(best.join(better, "own", "left").select("own", F.least("best", "found").alias("best")), "best")
            # Farther rows on this side are at least as far as the last one seen.
            state = met.filter("goes_on").join(best, "own").filter(F.col("best").isNull() | (F.col("bound") <= F.col("best.distance"))).select(
                "own", "set_no", "key", "t", "v", (F.col("bucket") + F.col("step")).alias("bucket"), "step")
            state = materialize(state, "state")
            if not state.limit(1).count():
                break
            width = min(2 * width, WIDEST)
    result = wanted.join(best, "own").filter("best IS NOT NULL")
    return result.select(*[F.col("t")[i].alias(c) for i, c in enumerate(text)], *[F.col("v")[i].alias(c) for i, c in enumerate(numeric)],
                         "best.distance", "best.neighbour")
