"""Exact nearest neighbours on categorical columns, by equal values only.

The distance of two rows is the number of columns on which they differ. Two rows
at distance d agree on a set of m - d columns, so the nearest rows are the
partners on the largest set of columns for which there is any partner. Both
sides collapse to distinct value combinations. No pair of rows is compared, but for
a last few targets.

For few columns both sides are keyed once per column set (2^m sets) and meet in
one hash join. For more, sets are searched best first, from the full set down:
exact partners, then sets that leave out one or two columns, and so on, where only
targets without a partner go on. Rows are dealt out by a few groups of columns, one
of which any partner shares, and the sets of a level are looked up in memory. The
work of a level is the number of its sets, so it is small where rows lie close and
grows with distance.

``by`` names columns that must agree in any case, such as the ε of a family of
copies; they are part of every key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tabveil.session import materialize, spread

ONE_PASS_COLUMNS = 7  # up to so many columns all sets are keyed at once
SLOT_ROWS = 50_000  # of the larger side in a slot, on average
CUT_ROWS = 200_000  # a slot with more rows of a side is cut
FEW_TARGETS = 20_000  # fetched at most
PAIRS_PER_LOOKUP = 150  # so many values are compared in the time of one lookup
PAIRS_AT_ONCE = 2_000_000


def _keyed(df: DataFrame, columns: Sequence[str], first: int = 0) -> DataFrame:
    """One row per column set: its mask, and the values of the set's columns."""
    m = len(columns)
    sets = df.withColumn("mask", F.explode(F.sequence(F.lit(first), F.lit(2**m - 1))))
    inside = {
        f"k{i}": F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col(c)).otherwise("") for i, c in enumerate(columns)
    }
    return sets.withColumns(inside)


def _distance(m: int) -> Column:
    return (F.lit(m) - F.bit_count("mask")).cast("int")


def _in_one_pass(targets: DataFrame, combos: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, columns, distance, neighbour of all targets that agree with a row in any column."""
    m = len(columns)
    keys = [*by, "mask", *[f"k{i}" for i in range(m)]]
    index = _keyed(combos, columns, first=1).groupBy(*keys).agg(F.min("neighbour").alias("neighbour"))
    wanted = _keyed(targets, columns, first=1)
    at = [F.min(F.when(_distance(m) == d, F.col("neighbour"))).alias(f"__at_{d}") for d in range(m)]
    met = wanted.join(index, keys, "left").groupBy(*by, *columns).agg(*at)
    levels = [F.col(f"__at_{d}") for d in range(m)]
    distance = F.when(F.lit(False), F.lit(None).cast("int"))
    for d, level in enumerate(levels):
        distance = distance.when(level.isNotNull(), d)
    return met.select(*by, *columns, distance.alias("distance"), F.coalesce(*levels).alias("neighbour")).filter("neighbour IS NOT NULL")


# --- many columns -------------------------------------------------------------
@dataclass(frozen=True)
class _Layout:
    """Where the number of each column lies: word, first bit, bits."""

    fields: list[tuple[int, int, int]]
    sizes: list[int]

    @property
    def words(self) -> list[str]:
        return [f"__w{k}" for k in range(max(w for w, _, _ in self.fields) + 1)]


def _layout(sizes: Sequence[int]) -> _Layout:
    """Bits enough that numbers of so many values hardly ever clash, in 64-bit words."""
    fields, free = [], []
    for n in sizes:
        bits = 16 if n <= 64 else 32 if n <= 1 << 14 else 64
        word = next((k for k, left in enumerate(free) if left >= bits), len(free))
        if word == len(free):
            free.append(64)
        fields.append((word, 64 - free[word], bits))
        free[word] -= bits
    return _Layout(fields, list(sizes))


def _numbered(sides: Sequence[DataFrame], columns: Sequence[str]) -> tuple[list[DataFrame], _Layout]:
    """The sides with every column as a number, several in a 64-bit word.

    Equal values have equal numbers and, which is checked on the distinct values,
    different ones different numbers.
    """
    places = [str(i) for i in range(len(columns))]
    long = [df.select(*[F.col(c).cast("string").alias(i) for c, i in zip(columns, places)]).unpivot([], places, "at", "value") for df in sides]
    values = materialize(reduce(DataFrame.unionByName, long).distinct().withColumn("at", F.col("at").cast("int")), "values")
    found = {r["at"]: r["n"] for r in values.groupBy("at").agg(F.count("*").alias("n")).collect()}  # columns
    layout, salt = _layout([found.get(i, 0) for i in range(len(columns))]), 0
    masks = [-1 if bits == 64 else (1 << bits) - 1 for _, _, bits in layout.fields]
    while True:
        number = F.xxhash64(F.lit(salt), "at", "value").bitwiseAND(F.get(F.array(*[F.lit(x).cast("long") for x in masks]), F.col("at")))
        if values.groupBy("at", number.alias("number")).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            break
        salt += 1
    words: list[Column | None] = [None] * len(layout.words)
    for i, (c, (word, at, _)) in enumerate(zip(columns, layout.fields)):
        part = F.shiftleft(F.xxhash64(F.lit(salt), F.lit(i), F.col(c).cast("string")).bitwiseAND(F.lit(masks[i]).cast("long")), at)
        words[word] = part if words[word] is None else words[word].bitwiseOR(part)
    return [df.select(*[w.alias(n) for w, n in zip(words, layout.words)], *[c for c in df.columns if c not in columns]) for df in sides], layout


def _column_groups(sizes: Sequence[int], number: int) -> list[list[int]]:
    """The columns in groups that tell rows apart about equally well, the best first."""
    groups, weight = [[] for _ in range(number)], [0.0] * number
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        g = min(range(number), key=lambda g: (weight[g], g))
        groups[g].append(i)
        weight[g] += math.log(max(sizes[i], 1)) + 1e-6
    return [groups[g] for g in sorted(range(number), key=lambda g: -weight[g])]


def _in_memory(layout: _Layout):
    """``unpack``, ``search`` and ``compared`` for tasks, as functions that travel whole:
    the workers need not have this package."""
    words, fields, pairs_at_once = layout.words, layout.fields, PAIRS_AT_ONCE

    def unpack(rows: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
        """One array of numbers per column."""
        columns = [rows.column(n) for n in words]
        whole = [np.concatenate([x.to_numpy() for x in c.chunks]) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c.to_numpy() for c in columns]
        whole = [c.astype(np.int64, copy=False).view(np.uint64) for c in whole]
        return [(whole[w] >> np.uint64(at)) & np.uint64((1 << bits) - 1) for w, at, bits in fields]

    def mixed(numbers: np.ndarray, salt: int) -> np.ndarray:
        """Well spread 64-bit numbers."""
        with np.errstate(over="ignore"):
            x = numbers + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def first_equal(keys: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Places on the own side and the first place there is on the other side under the same key.

        A number is the key, a bit for the own side, and the place in ``low`` bits; so sorting
        brings the first place of the other side to the front of a key.
        """
        keys.sort()
        key = keys >> np.uint64(low + 1)
        later = np.flatnonzero(key[1:] == key[:-1]) + 1
        own = later[(keys[later] >> np.uint64(low)) & np.uint64(1) == 1]
        if not len(own):
            return own, own
        begins = np.arange(len(keys))
        begins[later] = 0
        front = keys[np.maximum.accumulate(begins)[own]]
        met, place = (front >> np.uint64(low)) & np.uint64(1) == 0, np.uint64((1 << low) - 1)
        return (keys[own[met]] & place).astype(np.int64), (front[met] & place).astype(np.int64)

    def search(mine: list[np.ndarray], theirs: list[np.ndarray], fixed: int, levels: Sequence[Sequence[Sequence[int]]], bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distance and place of the nearest of ``theirs`` for each of ``mine`` (-1 for none),
        as far as they agree on all columns but one of the sets left out.

        ``levels`` are sets of growing size; ``theirs`` come by rising id; columns from
        ``fixed`` on agree in any case. A number stands for the values of a set; pairs
        that do not agree in fact are looked up again under other numbers.
        """
        n, k = len(mine[0]), len(theirs[0])
        low = max(n, k).bit_length()
        cut = np.uint64((1 << min(bits, 63 - low)) - 1)
        places = np.concatenate([np.arange(n, dtype=np.uint64) + np.uint64(1 << low), np.arange(k, dtype=np.uint64)])
        both = [np.concatenate(x) for x in zip(mine, theirs)]
        best, place = np.full(n, fixed, dtype=np.int64), np.full(n, -1, dtype=np.int64)

        def hashed(salt: int, some: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
            each = [(mixed(x[some], salt * 1000 + i) & cut) << np.uint64(low + 1) for i, x in enumerate(both)]
            return each, np.bitwise_xor.reduce(each) | places[some]

        for left_out in levels:
            open_ = np.flatnonzero(place < 0)
            if not len(open_):
                break
            some = np.concatenate([open_, np.arange(n, n + k)])
            usual = hashed(0, some)
            for out in left_out:
                (each, keys), salt = usual, 0
                while True:
                    keys = keys.copy()
                    for i in out:
                        keys ^= each[i]
                    who, whom = first_equal(keys, low)
                    gap, wrong = np.zeros(len(who), dtype=np.int64), np.zeros(len(who), dtype=bool)
                    for i, (a, b) in enumerate(zip(mine, theirs) if len(who) else ()):
                        if i in out:
                            gap += a[who] != b[whom]
                        else:
                            wrong |= a[who] != b[whom]
                    better = ~wrong & ((gap < best[who]) | ((gap == best[who]) & (whom < place[who])))
                    best[who[better]], place[who[better]] = gap[better], whom[better]
                    if not wrong.any():
                        break
                    salt += 1
                    each, keys = hashed(salt, some)
        return best, place

    def compared(mine: list[np.ndarray], theirs: list[np.ndarray], fixed: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``search``, by comparing all pairs."""
        best, place = np.full(len(mine[0]), fixed, dtype=np.int64), np.full(len(mine[0]), -1, dtype=np.int64)
        at_once = max(1, pairs_at_once // max(len(theirs[0]), 1))
        for begin in range(0, len(mine[0]), at_once):
            part = slice(begin, begin + at_once)
            gap = np.zeros((len(mine[0][part]), len(theirs[0])), dtype=np.uint16)
            for i, (a, b) in enumerate(zip(mine, theirs)):
                gap += (a[part, None] != b[None, :]) * np.uint16(1 if i < fixed else fixed)
            first = gap.argmin(axis=1)
            least = gap[np.arange(len(first)), first]
            near = least < fixed
            best[part], place[part] = np.where(near, least, fixed), np.where(near, first, -1)
        return best, place

    return unpack, search, compared


def _in_slots(rows: DataFrame, waiting: DataFrame, layout: _Layout, m: int, levels: Sequence[int], n: int, bits: int) -> DataFrame:
    """target, distance, neighbour: the nearest rows as far as they differ in one of ``levels`` columns.

    A row that differs in d columns agrees on one of d + 1 groups of columns, so
    both sides are dealt out by the values of each group. In such a slot all sets
    that hold the group are looked up in memory; nothing is written per set. Slots
    of many rows are cut on both sides, and every piece meets every other.
    """
    groups = _column_groups(layout.sizes[:m], levels[-1] + 1)
    assigned: list[list[list[tuple[int, ...]]]] = [[[] for _ in levels] for _ in groups]
    for k, d in enumerate(levels):
        for out in combinations(range(m), d):
            assigned[next(g for g, cs in enumerate(groups) if not set(cs) & set(out))][k].append(out)
    used = [g for g in range(len(groups)) if any(assigned[g])]
    buckets, count, words, at_once = max(1, math.ceil(n / SLOT_ROWS)), len(groups), layout.words, CUT_ROWS

    def field(i: int) -> Column:
        word, at, width = layout.fields[i]
        moved = F.shiftrightunsigned(words[word], at)
        return moved if width == 64 else moved.bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    fixed = [field(i) for i in range(m, len(layout.fields))]
    slots = F.array(*[F.pmod(F.xxhash64(*[field(i) for i in groups[g]], *fixed), F.lit(buckets)) * count + g for g in used])

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("slot", F.explode(slots))

    sides = [dealt(df) for df in (rows, waiting)]
    large = [df.groupBy("slot").agg(F.count("*").alias(f"n{k}")) for k, df in enumerate(sides)]
    # At most one row per CUT_ROWS rows on either side.
    large = large[0].join(large[1], "slot").filter((F.col("n0") > at_once) | (F.col("n1") > at_once)).collect()
    cuts = {r["slot"]: (math.ceil(r["n0"] / at_once), math.ceil(r["n1"] / at_once)) for r in large}
    if cuts:
        spark = rows.sparkSession
        pieces = F.broadcast(spark.createDataFrame([(s, a, b) for s, (a, b) in cuts.items()], "slot long, a int, b int"))
        for k, (own, other, name) in enumerate((("a", "b", "neighbour"), ("b", "a", "target"))):
            cut = sides[k].join(pieces, "slot", "left").withColumns({"a": F.coalesce("a", F.lit(1)), "b": F.coalesce("b", F.lit(1))})
            cut = cut.withColumn("own", F.pmod(F.xxhash64(name, "slot"), F.col(own)).cast("int"))
            cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            sides[k] = cut.withColumn("piece", F.col("own") * F.col("b") + F.col("other") if k == 0 else F.col("other") * F.col("b") + F.col("own"))
    sides = [df.withColumn("piece", F.col("piece") if cuts else F.lit(0)) for df in sides]
    kept = [*words, "slot", "piece"]
    both = sides[0].select(*kept, "neighbour", F.lit(None).cast("long").alias("target")).unionByName(
        sides[1].select(*kept, F.lit(None).cast(rows.schema["neighbour"].dataType).alias("neighbour"), "target"))
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, buckets * len(used) + sum(a * b for a, b in cuts.values()))
    schema = T.StructType([T.StructField("target", T.LongType()), T.StructField("distance", T.IntegerType()),
                           T.StructField("neighbour", rows.schema["neighbour"].dataType)])

    unpack, search, _ = _in_memory(layout)

    def look(table: pa.Table) -> pa.Table:
        mine, theirs = table.filter(pc.is_valid(table["target"])), table.filter(pc.is_null(table["target"]))
        theirs = theirs.sort_by("neighbour").combine_chunks()
        if not mine.num_rows or not theirs.num_rows:
            best, place = np.zeros(mine.num_rows, dtype=np.int64), np.full(mine.num_rows, -1)
        else:
            best, place = search(unpack(mine), unpack(theirs), m, assigned[table["slot"][0].as_py() % count], bits)
        near = np.flatnonzero(place >= 0)
        return pa.table({"target": mine["target"].take(pa.array(near)), "distance": pa.array(best[near].astype(np.int32)),
                         "neighbour": theirs["neighbour"].take(pa.array(place[near]))})

    found = both.repartition(parts, "slot", "piece").groupBy("slot", "piece").applyInArrow(look, schema)
    return _nearest_found(found)


def _nearest_found(found: DataFrame) -> DataFrame:
    nearest_of = found.groupBy("target").agg(F.min(F.struct("distance", "neighbour")).alias("near"))
    return nearest_of.select("target", "near.distance", "near.neighbour")


def _by_pairs(rows: DataFrame, waiting: pa.Table, layout: _Layout, m: int) -> DataFrame:
    """The same for a few targets, which every row is compared with in place."""
    unpack, _, compared = _in_memory(layout)
    mine, targets = unpack(waiting), waiting["target"].combine_chunks()
    schema = T.StructType([T.StructField("target", T.LongType()), T.StructField("distance", T.IntegerType()),
                           T.StructField("neighbour", rows.schema["neighbour"].dataType)])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.sort_by("neighbour")
            gap, place = compared(mine, unpack(batch), m)
            theirs = batch.column("neighbour").take(pa.array(place, mask=place < 0))
            if best is None:
                best, ids = gap, theirs
                continue
            smaller = pc.fill_null(pc.less(theirs, ids), False).to_numpy(zero_copy_only=False)
            better = (gap < best) | ((gap == best) & smaller)
            best, ids = np.where(better, gap, best), pc.if_else(pa.array(better), theirs, ids)
        if best is not None:
            near = pa.array(np.flatnonzero(best < m))
            yield pa.RecordBatch.from_arrays([targets.take(near), pa.array(best.astype(np.int32)).take(near), ids.take(near)], names=schema.names)

    return _nearest_found(spread(rows).mapInArrow(look, schema))


def _found_by_levels(waiting: DataFrame, combos: DataFrame, columns: Sequence[str], by: Sequence[str], bits: int = 64) -> DataFrame:
    """target, distance, neighbour of all targets that agree with a row in any column."""
    m = len(columns)
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in by], F.lit(True))
    (rows, waiting), layout = _numbered([combos.filter(known & F.col("neighbour").isNotNull()), waiting.filter(known)], [*columns, *by])
    rows, waiting = materialize(rows, "rows"), materialize(waiting, "waiting")
    n, open_, found, low = rows.count(), waiting.count(), None, 0
    while low < m and n and open_:
        # Levels are taken in twos: the rows are dealt out half as often.
        levels = [0] if low == 0 else [d for d in (low, low + 1) if d < m]
        sets = sum(math.comb(m, d) for d in levels)
        few = open_ <= FEW_TARGETS and open_ * n * m <= PAIRS_PER_LOOKUP * sets * (n + open_)
        near = _by_pairs(rows, waiting.toArrow(), layout, m) if few else _in_slots(rows, waiting, layout, m, levels, max(n, open_), bits)
        near = materialize(near, "found")
        found = near if found is None else found.unionByName(near)
        got = near.count()
        if few or got == open_:
            break
        low, open_ = levels[-1] + 1, open_ - got
        waiting = materialize(waiting.join(near.select("target").hint("merge"), "target", "left_anti"), "waiting") if got else waiting
    kind = combos.schema["neighbour"].dataType
    nothing = T.StructType([T.StructField("target", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("neighbour", kind)])
    return combos.sparkSession.createDataFrame([], nothing) if found is None else found


def _written(targets: DataFrame, combos: DataFrame, columns: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    targets = targets.select(*by, *columns, F.monotonically_increasing_id().alias("target"))
    return materialize(targets, "targets"), materialize(combos.select(*by, *columns, "neighbour"), "combinations")


def _by_levels(targets: DataFrame, combos: DataFrame, columns: Sequence[str], by: Sequence[str], bits: int = 64) -> DataFrame:
    """As ``_in_one_pass``, best sets first: rows that differ in no column, then in one
    or two and so on, each time for targets that have no partner yet.

    Every column becomes a number, several in a word, so narrow rows move. The last
    few targets are compared with all rows, once that is less work.
    """
    targets, combos = _written(targets, combos, columns, by)
    found = _found_by_levels(targets, combos, columns, by, bits)
    # The planner goes by the size of the compressed files: nothing here is broadcast.
    return targets.join(found.hint("merge"), "target").select(*by, *columns, "distance", "neighbour")


def nearest(targets: DataFrame, table: DataFrame, columns: Sequence[str], row_id: str,
            payload: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """The nearest row of ``table`` for every distinct combination in ``targets``.

    Result: ``by``, ``columns``, ``distance``, ``neighbour`` (its id) and the
    payload. Equal distances go to the smallest id. The columns must be text
    without nulls (see ``as_text``). A target that agrees with no row in any column
    gets the smallest id of all; one whose ``by`` has no row gets none.
    """
    columns, by, m = list(columns), list(by), len(columns)
    if not columns:
        raise ValueError("nearest neighbours need a column")
    carried = {c: f"__p_{c}" for c in payload}
    # Only the id is ever aggregated, so that all steps are hash aggregations;
    # the payload is a grouping key here and fetched by id at the end.
    rows = table.select(*by, *columns, *[F.col(c).alias(n) for c, n in carried.items()], F.col(row_id).alias("neighbour"))
    rows = rows.groupBy(*by, *columns, *carried.values()).agg(F.min("neighbour").alias("neighbour"))
    combos = rows.groupBy(*by, *columns).agg(F.min("neighbour").alias("neighbour"))
    wanted = targets.select(*by, *columns).distinct()
    if m <= ONE_PASS_COLUMNS:
        met, on = _in_one_pass(wanted, combos, columns, by), [*by, *columns]
    else:
        wanted, combos = _written(wanted, combos, columns, by)
        met, on = _found_by_levels(wanted, combos, columns, by).hint("merge"), ["target"]
    first = combos.groupBy(*by).agg(F.min("neighbour").alias("__first"))
    # One row, or one per value of ``by``.
    every = wanted.join(F.broadcast(first), by) if by else wanted.withColumn("__first", first.scalar())
    found = every.join(met, on, "left").select(
        *by, *columns, F.coalesce("distance", F.lit(m)).alias("distance"), F.coalesce("neighbour", "__first").alias("neighbour"))
    found = found.filter(F.col("neighbour").isNotNull())
    if not carried:
        return found
    fetched = found.join(rows.select(*by, "neighbour", *carried.values()), [*by, "neighbour"])
    return fetched.select(
        *by, *columns, "distance", "neighbour",
        *[F.col(n).alias(c if c not in columns else f"nearest_{c}") for c, n in carried.items()],
    )


def nearest_k(targets: DataFrame, table: DataFrame, columns: Sequence[str], row_id: str, k: int) -> DataFrame:
    """The k nearest rows per distinct combination: ``columns``, ``rank``,
    ``distance``, ``neighbour``.

    Only the k smallest ids of a combination, and of a column set, can be among
    the k nearest, so ranks are limited before every shuffle.
    """
    columns, m = list(columns), len(columns)
    keys = ["mask", *[f"k{i}" for i in range(m)]]

    def first_k(df: DataFrame, by: Sequence[str], *order) -> DataFrame:
        ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
        return ranked.filter(F.col("rank") <= k)

    slim = table.select(*columns, F.col(row_id).alias("neighbour"))
    combos = first_k(slim, columns, "neighbour").drop("rank")
    index = first_k(_keyed(combos, columns).select(*keys, "neighbour"), keys, "neighbour").drop("rank")
    wanted = _keyed(targets.select(*columns).distinct(), columns)
    met = wanted.join(index, keys).groupBy(*columns, "neighbour").agg(F.min(_distance(m)).alias("distance"))
    return first_k(met, columns, "distance", "neighbour").select(*columns, "rank", "distance", "neighbour")
