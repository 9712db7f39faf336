"""A Merkle manifest of a table, and proofs by a recursive query.

Every row is a leaf: the digest of its columns. The leaves of one tree (all rows
with the same value of a column) stand in the order of their ids; two neighbours
become one node of the next level, a last one without neighbour becomes a node
alone, until one is left. The subroots, ordered by their tree's value, are the
leaves of one more tree, whose root stands for the table.

**Built levels are stored** as node rows (tree, level, pos, hash) linked to their
parent (level + 1, pos div 2). Leaves get their places from a range-partitioned
sort and counts per range. Then blocks of 256 neighbours go up eight levels
inside one task each, their tops form the blocks of the next round, so a tree of
n leaves takes log256(n) rounds. No task sees more than a block, whatever the
share of one tree.

**The climb** is a recursive query (WITH RECURSIVE), one row per leaf. A step
takes the row to its ancestor eight levels up: it appends the siblings on the way
and folds the row's hash with them. The rows it joins, ``links``, are derived
from the stored nodes: (tree, block of 256 leaves, step, place, siblings on the
way). Upper nodes are filed under every block of leaves below them, so at each
step a key serves 256 rows, also near the root, where all rows share one path.

Nulls have their own leaf encoding, the null tree comes first, null ids come
before others. Rows with the same id stand in the order of their leaves. Equal
rows are leaves of their own. Very long texts only matter for their digest. An
empty table has no tree and gives an empty result. Columns that are not named are
not read, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabveil.session import materialize

STRIDE = 8  # levels per block
BLOCK = 1 << STRIDE
PLACE_BITS = 33  # monotonically_increasing_id: the row's number within its partition
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def encoded(value: Column) -> Column:
    """A value as text that cannot be mistaken for another: length, colon, value."""
    written = value.cast("string")
    return F.when(written.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def tree_key(value: Column) -> Column:
    """The tree's name: null sorts first, others bytewise."""
    written = value.cast("string")
    return F.when(written.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), written))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the place within the ``tree`` by ``order``, and ``n``, its rows.

    Sorted in ranges; only counts per (range, tree) are looked at as a whole. The
    last sort key tells equal rows apart, so a range boundary may lie between them.
    """
    keys = ["tree", *order, "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    seq = F.monotonically_increasing_id()
    ranged = ranged.drop("tie").withColumn("seq", seq).withColumn("part", F.shiftright("seq", PLACE_BITS))
    ranged = materialize(ranged, "leaves")
    spans = ranged.groupBy("part", "tree").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(W.partitionBy("tree").orderBy("part")) - F.col("m")
    spans = spans.select("part", "tree", "first", before.alias("before"), F.sum("m").over(W.partitionBy("tree")).alias("n"))
    pos = F.col("before") + F.col("seq") - F.col("first")
    return ranged.join(spans, ["part", "tree"]).withColumn("pos", pos).drop("part", "seq", "first", "before")


def parent_of(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def climb_block(hashes: list[bytes], first: int, level: int, n: int) -> tuple[list[list[bytes]], list[list[bytes | None]]]:
    """The levels above a block of neighbours, and for each of them the siblings
    on its way up (None where it goes alone).

    ``first`` is the place of the first one, ``n`` the number of leaves of the tree.
    """
    rows, steps = [hashes], min(STRIDE, max((n - 1).bit_length() - level, 0))
    for _ in range(steps):
        below = rows[-1]
        rows.append([parent_of(below[k:k + 2]) for k in range(0, len(below), 2)])
    ways: list[list[bytes | None]] = []
    for k in range(len(hashes)):
        way = []
        for up in range(steps):
            other = (k >> up) ^ 1
            way.append(rows[up][other] if other < len(rows[up]) else None)
        ways.append(way)
    return rows[1:], ways


def built_round(rows: DataFrame, level: int, carried: Sequence[str]) -> DataFrame:
    """Node rows of one round: the given nodes of ``level`` with their ``way``, and
    the up to eight levels above them. ``top`` marks the root of a tree, ``open``
    nodes on which the next round builds."""
    schema = rows.select("tree", "n", F.lit(0).alias("level"), "pos", "hash", *carried).schema
    kinds = {f.name: f.dataType for f in schema}
    out_schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in schema.names) + ", way array<binary>, top boolean, open boolean"

    def build(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n, first, size = block.column("n")[0].as_py(), block.column("pos")[0].as_py(), block.num_rows
        above, ways = climb_block(block.column("hash").to_pylist(), first, level, n)
        levels, places, hashes = [level] * size, block.column("pos").to_pylist(), block.column("hash").to_pylist()
        for up, line in enumerate(above, 1):
            levels += [level + up] * len(line)
            places += [(first >> up) + k for k in range(len(line))]
            hashes += line
        total, height = len(levels), max((n - 1).bit_length(), 0)
        inner = total - size
        columns = {
            "tree": pa.repeat(block.column("tree")[0], total), "n": pa.repeat(block.column("n")[0], total),
            "level": pa.array(levels, pa.int32()), "pos": pa.array(places, pa.int64()), "hash": pa.array(hashes, pa.binary()),
        }
        for c in carried:
            held = block.column(c).combine_chunks()
            columns[c] = pa.concat_arrays([held, pa.nulls(inner, held.type)])
        columns["way"] = pa.array([*ways, *[None] * inner], pa.list_(pa.binary()))
        columns["top"] = pa.array([k == height for k in levels])
        columns["open"] = pa.array([k == level + STRIDE and k < height for k in levels])
        return pa.table(columns)

    blocks = rows.select("tree", "n", "pos", "hash", *carried).withColumn("block", F.shiftright("pos", STRIDE))
    return blocks.groupBy("tree", "block").applyInArrow(build, out_schema)


def built(rows: DataFrame, carried: Sequence[str] = ()) -> list[DataFrame]:
    """Stored node rows of all trees over placed leaves, one table per round."""
    rounds, level = [], 0
    while True:
        nodes = materialize(built_round(rows, level, carried if level == 0 else ()), f"nodes-{level}")
        rounds.append(nodes)
        rows = nodes.where("open")
        level += STRIDE
        if not rows.limit(1).count():
            return rounds


@dataclass(frozen=True)
class Manifest:
    """``rounds``: node rows of the trees; ``upper``: those of the tree over the
    subroots, whose leaves carry ``below``, the tree they stand for, and its
    size; ``root``: None for an empty table."""

    rounds: list[DataFrame]
    upper: list[DataFrame]
    carried: list[str]
    root: bytes | None

    def nodes(self) -> DataFrame:
        """All node rows: tree (null for the tree over the trees), level, pos,
        hash (hexadecimal) and the parent's level and pos (null at a root)."""
        every = None
        for tables, tree in ((self.rounds, F.col("tree")), (self.upper, F.lit(None).cast("string"))):
            for k, table in enumerate(tables):
                # The first level of a later round is the last one of the round before.
                own = table if k == 0 else table.where(F.col("level") > k * STRIDE)
                up = F.when(~F.col("top"), F.col("level") + 1)
                part = own.select(tree.alias("tree"), "level", "pos", F.lower(F.hex("hash")).alias("hash"), up.alias("parent_level"),
                                  F.when(~F.col("top"), F.shiftright("pos", 1)).alias("parent_pos"))
                every = part if every is None else every.unionByName(part)
        return every

    def links(self) -> DataFrame:
        """The climb's rows: (tree, block, step), ``place`` and ``way`` of the
        ancestor there, the tree's ``subroot`` from the step that starts at it, and
        ``last``."""
        none = F.lit(None).cast("binary")
        parts = []
        for k, table in enumerate(self.rounds[1:], 1):
            wide = STRIDE * (k - 1)
            blocks = F.expr(f"sequence(shiftleft(pos, {wide}), least(shiftleft(pos + 1, {wide}) - 1, (n - 1) div {BLOCK}))")
            parts.append(table.where("way IS NOT NULL").select(
                "tree", F.explode(blocks).alias("block"), F.lit(k).alias("step"), F.col("pos").alias("place"), "way", none.alias("subroot"),
                F.lit(False).alias("last")))
        # Above the subroots: every block of a tree goes the tree's way.
        heads = self.upper[0].where("level = 0").select("below", "below_n", "pos", "hash", "way")
        for k, table in enumerate(self.upper):
            if k == 0:
                ways = heads.withColumn("place", F.col("pos"))
            else:
                way = table.where("way IS NOT NULL").select(F.col("pos").alias("place"), F.col("way"))
                ways = heads.drop("way").withColumn("place", F.shiftright("pos", STRIDE * k)).join(way, "place")
            # A tree of n leaves has as many rounds as strides in its height, one at least.
            taken = F.greatest(F.lit(1), F.ceil(F.length(F.bin(F.col("below_n") - 1)) / STRIDE)).cast("int")
            parts.append(ways.select(
                F.col("below").alias("tree"), F.explode(F.expr(f"sequence(0L, (below_n - 1) div {BLOCK})")).alias("block"),
                (taken + k).alias("step"), "place", "way", F.col("hash").alias("subroot"), F.lit(k == len(self.upper) - 1).alias("last")))
        links = parts[0]
        for part in parts[1:]:
            links = links.unionByName(part)
        return links


def manifest(documents: DataFrame, columns: Sequence[str], tree: str, order: str, altered: Mapping[str, Column] | None = None) -> Manifest:
    """Build the manifest of a table: leaves over ``columns``, one tree per value of
    ``tree``, leaves by ``order``. ``altered`` has other values for some columns,
    with which each leaf is written down a second time, for checks of the proofs."""
    named = {c: F.col(f"`{c}`") for c in columns}
    leaf = leaf_digest(list(named.values()))
    other = leaf_digest([(altered or {}).get(c, named[c]) for c in columns]) if altered else leaf
    rows = documents.select(tree_key(F.col(f"`{tree}`")).alias("tree"), F.col(f"`{order}`").alias("id"), leaf.alias("hash"), other.alias("other"))
    rounds = built(placed(rows, ["id", "hash"]), ["id", "other"])
    tops = None
    for table in rounds:
        part = table.where("top").select("tree", "n", "hash")
        tops = part if tops is None else tops.unionByName(part)
    heads = tops.select(F.lit("").alias("tree"), F.col("tree").alias("below"), F.col("n").alias("below_n"), "hash")
    upper = built(placed(heads, ["below"]), ["below", "below_n"])
    root = upper[-1].where("top").first()  # one row
    return Manifest(rounds, upper, ["id", "other"], bytes(root["hash"]) if root else None)


def folded(start: str, place: str, way: str) -> str:
    """SQL: a hash folded with the siblings on a way, as its place says left or right."""
    pair = "sha2(CASE WHEN x IS NULL THEN lower(hex(s.h)) WHEN s.p % 2 = 1 THEN lower(concat(hex(x), hex(s.h))) ELSE lower(concat(hex(s.h), hex(x))) END, 256)"
    return (f"aggregate({way}, named_struct('h', {start}, 'p', {place}), "
            f"(s, x) -> named_struct('h', unhex({pair}), 'p', shiftright(s.p, 1)), s -> s.h)")


def appended(way: str) -> str:
    """SQL: the siblings on a way, one after the other."""
    return f"aggregate({way}, CAST('' AS binary), (a, x) -> concat(a, coalesce(x, CAST('' AS binary))))"


def proofs(spark: SparkSession, book: Manifest, order: str) -> DataFrame:
    """One row per leaf: id, leaf, subroot, root, ``proof`` (all siblings on the way
    to the root, as bytes), ``folded_root`` (climbed from the altered leaf) and
    ``verified``. Digests are lowercase hexadecimal."""
    leaves = book.rounds[0].where("level = 0")
    if book.root is None:
        kind = leaves.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"`{order}` {kind}, leaf string, subroot string, root string, proof binary, folded_root string, verified boolean")
    links = materialize(book.links(), "links")
    query = f"""
        WITH RECURSIVE climb AS (
            SELECT tree, shiftright(pos, {STRIDE}) AS block, 0 AS step, id, hash AS leaf,
                   {folded('other', 'pos', 'way')} AS reached, {appended('way')} AS proof, CAST(NULL AS binary) AS subroot, false AS last
            FROM {{leaves}}
            UNION ALL
            SELECT c.tree, c.block, c.step + 1, c.id, c.leaf,
                   {folded('c.reached', 'l.place', 'l.way')}, concat(c.proof, {appended('l.way')}), coalesce(l.subroot, c.subroot), l.last
            FROM climb c JOIN {{links}} l ON l.tree = c.tree AND l.block = c.block AND l.step = c.step + 1
        )
        SELECT id, leaf, subroot, proof, reached FROM climb WHERE last"""
    # A row per leaf and step is meant; the limit guards against endless queries.
    held = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        done = materialize(spark.sql(query, leaves=leaves, links=links), "climb")
    finally:
        spark.conf.set(ROW_LIMIT, held) if held is not None else spark.conf.unset(ROW_LIMIT)
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "reached")}
    root = F.lit(book.root.hex())
    return done.select(F.col("id").alias(order), text["leaf"].alias("leaf"), text["subroot"].alias("subroot"), root.alias("root"), "proof",
                       text["reached"].alias("folded_root"), (text["reached"] == root).alias("verified"))
