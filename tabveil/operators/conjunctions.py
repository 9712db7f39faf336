"""Rows that satisfy conjunctions of equalities and one-sided ranges, counted for
very many conjunctions at once.

A conjunction asks for given texts and, per numeric column, for at most or at least
a value. "At least" becomes "at most" by the sign. Rows and conjunctions share a
group: the column set, the signs and the texts.

- Without a numeric column the counts of the groups are looked up.
- With one, rows and conjunctions are sorted together, and the rows before a
  conjunction are those it counts: one running sum, no pairs.
- With more, the first column is cut into 256 slices by quantiles, with 16 slices
  in a slab. The rows below a value are up to 15 whole slabs, up to 15 whole
  slices and a part of one slice. Whole ones leave a problem with one column less;
  only in the one slice rows are compared with the conjunction itself.

Sorting is by ranges, so neither a group nor a slice is one task.

Beforehand rows that no conjunction of their group can count are left out, where
the conjunctions are few enough to be shown to every task. And of conjunctions that
rows propose, one that only its own row satisfies lies above no other row: rows that
lie above another are left out batch by batch, until few are left to be counted.
Both only leave out what cannot matter, so counts stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabveil.functions import text as texts
from tabveil.session import BROADCAST_BYTES, BROADCAST_ROWS, materialize

SLABS = 16
PIVOTS = 64  # rows of a group and batch that others are held against
CORNERS = 256  # boxes per group that rows are held against
SETTLED = 10_000  # so few rows are not worth another round
PLACE_BITS = 33  # monotonically_increasing_id: the row's number within its partition


@dataclass(frozen=True)
class ColumnSet:
    """The text and the numeric columns of a conjunction."""

    text: tuple[str, ...]
    numeric: tuple[str, ...]


def _group(number: int, signs: Sequence[int], columns: Sequence[str]) -> Column:
    head = F.lit(f"{number}:{''.join('+' if s > 0 else '-' for s in signs)}")
    return F.array(head, *[texts.as_text(F.col(c)) for c in columns])


def _rows(df: DataFrame, sets: Sequence[ColumnSet], q: int) -> DataFrame:
    """g and ys of every row under every set of q numeric columns and all signs.
    A row with a null in one of them satisfies no range and is left out."""
    each = []
    for number, s in enumerate(sets):
        if len(s.numeric) != q:
            continue
        known = F.lit(True)
        for c in s.numeric:
            known = known & F.col(c).isNotNull()
        for signs in product((1, -1), repeat=q):
            ys = F.array(*[F.col(c).cast("double") * sign for c, sign in zip(s.numeric, signs)]).cast("array<double>")
            each.append(F.when(known, F.struct(_group(number, signs, s.text).alias("g"), ys.alias("ys"))))
    return df.select(F.explode(F.array(*each)).alias("row")).filter("row IS NOT NULL").select("row.g", "row.ys")


def _summed(rows: DataFrame) -> DataFrame:
    """Rows (g, ys) or (g, ys, w) as distinct ones with their number."""
    return rows.groupBy("g", "ys").agg((F.sum("w") if "w" in rows.columns else F.count("*")).alias("w"))


def _matrix(column: pa.Array, q: int) -> np.ndarray:
    """A list column of q numbers as a matrix; NaN, the largest number, as infinite."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), q)
    return np.where(np.isnan(flat), np.inf, flat)


def _members(codes: np.ndarray) -> list[np.ndarray]:
    """The places of each code."""
    order = np.argsort(codes, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []


def _not_above(ys: np.ndarray) -> np.ndarray:
    """False for rows that lie above another one, as far as the pivots tell; equal rows stay."""
    left = np.arange(len(ys))
    spread = np.ptp(np.where(np.isinf(ys), 0.0, ys), axis=0)
    height = (ys / np.where(spread > 0, spread, 1.0)).sum(axis=1)
    tried = (ys == np.inf).any(axis=1)  # such a number may stand for NaN, which is not below infinity
    for _ in range(PIVOTS):
        waiting = left[~tried[left]]
        if len(waiting) == 0 or len(left) < 2:
            break
        pivot = ys[waiting[np.argmin(height[waiting])]]
        near = ys[left]
        equal = (near == pivot).all(axis=1)
        tried[left[equal]] = True
        tried[waiting[np.argmin(height[waiting])]] = True
        left = left[equal | ~(near >= pivot).all(axis=1)]
    stays = np.zeros(len(ys), dtype=bool)
    stays[left] = True
    return stays


def _thinned(rows: DataFrame, q: int) -> DataFrame:
    """Rows without those that lie above another one of their group in the same batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, stays = _matrix(batch.column("ys"), q), np.ones(batch.num_rows, dtype=bool)
            for places in _members(batch.column("name").dictionary_encode().indices.to_numpy()):
                if len(places) > 1:
                    stays[places] = _not_above(ys[places])
            yield batch.filter(pa.array(stays)).drop_columns(["name"])

    return rows.withColumn("name", F.to_json("g")).mapInArrow(run, rows.schema)


def _lowest(rows: DataFrame, q: int) -> DataFrame:
    """Rows (g, ys) as (g, ys, w), without most that lie above another one of their
    group. None that lies above no other is left out, nor its number changed."""
    left, n = None, None
    while True:
        left = _summed(_thinned(rows if left is None else left.sortWithinPartitions("g"), q))
        left = materialize(left, "lowest")
        before, n = n, left.count()
        if n <= SETTLED or before is not None and 2 * n > before:
            return left


def once_satisfied(df: DataFrame, wanted: DataFrame, sets: Sequence[ColumnSet]) -> DataFrame:
    """(pid): the conjunctions that exactly one row satisfies; every row of
    ``wanted`` (pid, set_no, g, vs) must be proposed by a row of ``df``."""
    found = None
    for q in sorted({len(s.numeric) for s in sets}):
        mine = _of_width(wanted, sets, q)
        if q:
            rows = _lowest(_rows(df, sets, q), q)
            alone = rows.filter("w = 1").select("g", F.col("ys").alias("vs"))
            mine = materialize(mine.join(alone, ["g", "vs"], "left_semi"), "lowest")
        else:
            rows = _summed(_rows(df, sets, q))
        part = _counted(rows, mine, q).groupBy("pid").agg(F.sum("n").alias("n")).filter("n = 1").select("pid")
        found = part if found is None else found.unionByName(part)
    return found


def _of_width(wanted: DataFrame, sets: Sequence[ColumnSet], q: int) -> DataFrame:
    numbers = [i for i, s in enumerate(sets) if len(s.numeric) == q]
    return wanted.filter(F.col("set_no").isin(numbers)).select("pid", "g", "vs")


def _corners(vs: np.ndarray) -> np.ndarray:
    """At most CORNERS bounds such that what is below a row of ``vs`` is below one of them."""
    vs, boxes = np.unique(vs, axis=0), []
    waiting = [(vs, CORNERS)]
    while waiting:
        part, room = waiting.pop()
        if len(part) <= room:
            boxes.append(part)
        elif room == 1:
            boxes.append(part.max(axis=0, keepdims=True))
        else:
            widest = np.argmax([len(np.unique(part[:, i])) for i in range(part.shape[1])])
            part = part[np.argsort(part[:, widest], kind="stable")]
            waiting += [(part[: len(part) // 2], room // 2), (part[len(part) // 2:], room - room // 2)]
    return np.concatenate(boxes)


def _within_reach(rows: DataFrame, wanted: DataFrame, q: int) -> DataFrame:
    """Rows that some conjunction may count; all rows where there are too many conjunctions."""
    asked = wanted.select(F.xxhash64("g").alias("h"), "vs").limit(BROADCAST_ROWS + 1).toArrow()
    if asked.num_rows > BROADCAST_ROWS or asked.nbytes > BROADCAST_BYTES:
        return rows
    if not asked.num_rows:
        return rows.limit(0)
    asked = asked.combine_chunks()
    hashes, vs = asked.column("h").to_numpy(), _matrix(asked.column("vs").combine_chunks(), q)
    # Groups of one hash share their boxes, which only lets more rows in.
    bounds = {int(hashes[places[0]]): _corners(vs[places]) if q else vs[places[:1]] for places in _members(hashes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, stays = _matrix(batch.column("ys"), q), np.zeros(batch.num_rows, dtype=bool)
            hashes = batch.column("h").to_numpy()
            for places in _members(hashes):
                for bound in bounds.get(int(hashes[places[0]]), ()):
                    stays[places] |= (ys[places] <= bound).all(axis=1)
            yield batch.filter(pa.array(stays)).drop_columns(["h"])

    return rows.withColumn("h", F.xxhash64("g")).mapInArrow(run, rows.schema)


def proposed(df: DataFrame, sets: Sequence[ColumnSet], medians: dict[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """The conjunction that each row proposes under each set: set_no, g, vs and the
    kept columns. A number above the column's median asks for at least, others for
    at most. Rows with a null number propose none under that set."""
    out = None
    for number, s in enumerate(sets):
        known, signs = F.lit(True), []
        for c in s.numeric:
            known = known & F.col(c).isNotNull()
            signs.append(F.when(F.col(c).cast("double") > medians[c], F.lit("-")).otherwise(F.lit("+")))
        head = F.concat(F.lit(f"{number}:"), *signs)
        vs = [F.col(c).cast("double") * F.when(F.col(c).cast("double") > medians[c], -1.0).otherwise(1.0) for c in s.numeric]
        part = df.filter(known).select(
            *keep, F.lit(number).alias("set_no"), F.array(head, *[texts.as_text(F.col(c)) for c in s.text]).alias("g"),
            F.array(*vs).cast("array<double>").alias("vs"))
        out = part if out is None else out.unionByName(part)
    return out


def _counted_by_rank(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pid, n) with one number left: rows of the group up to the value."""
    none = F.lit(None).cast("long")
    firsts = wanted.select("g").distinct().select("g", F.lit(float("-inf")).alias("y"), F.lit(0).alias("kind"), none.alias("pid"), F.lit(0).cast("long").alias("w"))
    data = rows.select("g", F.col("ys")[0].alias("y"), F.lit(1).alias("kind"), none.alias("pid"), "w")
    asks = wanted.select("g", F.col("vs")[0].alias("y"), F.lit(2).alias("kind"), "pid", F.lit(0).cast("long").alias("w"))
    keys = ["g", "y", "kind", "pid"]
    dealt = firsts.unionByName(data).unionByName(asks).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.shiftright("seq", PLACE_BITS))
    dealt = materialize(dealt, "sorted")
    sums = dealt.groupBy("part").agg(F.sum("w").alias("s"))
    # One row per range.
    before = sums.select("part", (F.sum("s").over(W.orderBy("part")) - F.col("s")).alias("before"))
    upto = dealt.withColumn("inner", F.sum("w").over(W.partitionBy("part").orderBy("seq"))).join(F.broadcast(before), "part")
    upto = upto.select("g", "kind", "pid", (F.col("before") + F.col("inner")).alias("upto"))
    starts = upto.filter("kind = 0").select("g", F.col("upto").alias("start"))
    return upto.filter("kind = 2").join(starts, "g").select("pid", (F.col("upto") - F.col("start")).alias("n"))


def _counted(rows: DataFrame, wanted: DataFrame, q: int) -> DataFrame:
    """(pid, n) parts, to be added up, of conjunctions (pid, g, vs) over rows (g, ys, w)."""
    if q == 0:
        return wanted.join(rows.groupBy("g").agg(F.sum("w").alias("n")), "g").select("pid", "n")
    if q == 1:
        return _counted_by_rank(rows, wanted)
    family = F.element_at("g", 1).alias("family")
    fractions = [k / SLABS**2 for k in range(1, SLABS**2)]
    cuts = rows.groupBy(family).agg(F.percentile_approx(F.col("ys")[0], fractions, 10_000).alias("cuts"))  # one row per set and signs
    cuts = F.broadcast(materialize(cuts, "cuts"))

    def sliced(df: DataFrame, numbers: str) -> DataFrame:
        place = F.size(F.filter("cuts", lambda c: c < F.col(numbers)[0]))
        return df.withColumn("family", family).join(cuts, "family").withColumn("slice", place).drop("cuts", "family")

    data, asks = materialize(sliced(rows, "ys"), "sliced"), materialize(sliced(wanted, "vs"), "asked")
    slab, slice_ = F.expr(f"slice div {SLABS}"), F.col("slice")
    nodes = F.array(F.concat(F.lit("slab "), slab), F.concat(F.lit("slice "), slice_))
    below = F.concat(
        F.when(slab > 0, F.transform(F.sequence(F.lit(0).cast("long"), slab - 1), lambda k: F.concat(F.lit("slab "), k))).otherwise(F.array()),
        F.when(slice_ % SLABS > 0, F.transform(F.sequence(slab * SLABS, slice_.cast("long") - 1), lambda k: F.concat(F.lit("slice "), k)))
        .otherwise(F.array()))
    rest = "slice(ys, 2, size(ys) - 1)", "slice(vs, 2, size(vs) - 1)"
    inner = data.select("g", "ys", "w", F.explode(nodes).alias("node")).select(
        F.concat("g", F.array("node")).alias("g"), F.expr(rest[0]).alias("ys"), "w").groupBy("g", "ys").agg(F.sum("w").alias("w"))
    outer = asks.select("pid", "g", "vs", F.explode(below).alias("node")).select(
        "pid", F.concat("g", F.array("node")).alias("g"), F.expr(rest[1]).alias("vs"))
    whole = _counted(inner, outer, q - 1)
    meets = F.forall(F.zip_with("ys", "vs", lambda y, v: y <= v), lambda ok: ok)
    part = asks.select("pid", "g", "vs", "slice").join(data, ["g", "slice"]).filter(meets).groupBy("pid").agg(F.sum("w").alias("n"))
    return whole.unionByName(part)


def count_conjunctions(df: DataFrame, wanted: DataFrame, sets: Sequence[ColumnSet]) -> DataFrame:
    """(pid, hits): how many rows satisfy each conjunction; ``wanted`` has pid,
    set_no, g and vs as ``proposed`` makes them."""
    parts = None
    for q in sorted({len(s.numeric) for s in sets}):
        mine = _of_width(wanted, sets, q)
        rows = _summed(_within_reach(_rows(df, sets, q), mine, q))
        part = _counted(rows, mine, q).select("pid", F.col("n").cast("long").alias("n"))
        parts = part if parts is None else parts.unionByName(part)
    found = parts.groupBy("pid").agg(F.sum("n").alias("n"))
    return wanted.select("pid").join(found, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).alias("hits"))
