"""Differentially private synthetic tables from one- and two-way marginals.

The model is a tree over the columns: noisy one-way marginals, a privately
chosen spanning tree of informative column pairs, and noisy two-way marginals of
its edges. Rows are then drawn root first, each column given its parent.

Exact counts of all pairs come from a single pass over the data. A marginal
holds its seen cells and those empty ones whose noise passes a threshold
(``sparse_noise``), so no pair is too wide to be modelled and no step walks a
product of domains. The domain is an input, and a table: it may be large.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabveil.functions import text
from tabveil.functions.hashing import fast_uniform
from tabveil.operators.budget import Ledger
from tabveil.operators.domains import Domain, as_domain, observed_domain
from tabveil.operators.expand import set_counts
from tabveil.operators.noise import gaussian_scale, gumbel_choice, selection_epsilon, zcdp_budget
from tabveil.operators.sparse_noise import Frame, frame, noisy_cells, passing_cells
from tabveil.operators.utility import column_pairs
from tabveil.session import materialize, small_or_same

CHUNK = 4096  # codes summed together first
ROWS_PER_SLOT = 100_000
DEFAULT = -1  # parent code of the intervals used where a parent value has none of its own

# --- exact marginals -------------------------------------------------------
def cell_counts(df: DataFrame, domain: Domain, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Observed cells of all one-way and two-way marginals in one pass.

    Result: ``a``, ``b`` (column names, ``b`` null for one-way), ``code_a``,
    ``code_b``, ``n``. A code is null for a value outside the domain.
    """
    columns = domain.columns
    texts = df.select(*[text.as_text(F.col(c)).alias(c) for c in columns])
    sets = [(c,) for c in columns] + list(pairs)
    counted = set_counts(texts, columns, sets)
    counted = counted.withColumnsRenamed({"k0": "x", "k1": "y"})
    if not pairs:
        counted = counted.withColumn("y", F.lit(""))
    spark = df.sparkSession
    plan = [(i, s[0], s[1] if len(s) > 1 else None) for i, s in enumerate(sets)]
    # One row per marginal.
    plan = F.broadcast(spark.createDataFrame(plan, "set_no int, a string, b string"))
    code_a, code_b = (
        domain.table.select(F.col("feature").alias(c), F.col("value").alias(v), F.col("code").alias(f"code_{c}"))
        for c, v in (("a", "x"), ("b", "y"))
    )
    # The domain's size decides how these joins run.
    named = counted.join(plan, "set_no").select("a", "b", "x", "y", "n")
    return named.join(code_a, ["a", "x"], "left").join(code_b, ["b", "y"], "left").select("a", "b", "code_a", "code_b", "n")


def one_way(cells: DataFrame, domain: Domain) -> DataFrame:
    """All cells of the one-way marginals, empty ones included: a, code_a, n."""
    every = domain.table.select(F.col("feature").alias("a"), F.col("code").alias("code_a"))
    seen = cells.filter("b is null").select("a", "code_a", "n")
    return every.join(seen, ["a", "code_a"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))


def two_way(cells: DataFrame, domain: Domain, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """All cells of the given pairs' marginals, empty ones included; for pairs of
    few values, as it writes out their product."""
    spark = cells.sparkSession
    sizes = [(i, a, b, domain.sizes[b]) for i, (a, b) in enumerate(pairs)]
    table = spark.createDataFrame(sizes, "pair int, a string, b string, kb int")
    ends, total = [], 0
    for a, b in pairs:
        ends.append(total)
        total += domain.cells(a, b)
    starts = "array(" + ", ".join(f"{e}L" for e in ends) + ")"
    numbered = spark.range(total).withColumn("pair", F.expr(f"cast(size(filter({starts}, s -> s <= id)) - 1 AS int)"))
    numbered = numbered.withColumn("i", F.expr(f"id - {starts}[pair]"))
    # One row per pair.
    every = numbered.join(F.broadcast(table), "pair").select(
        "a", "b", F.expr("i div kb").cast("int").alias("code_a"), (F.col("i") % F.col("kb")).cast("int").alias("code_b"))
    seen = cells.filter("b is not null")
    return every.join(seen, ["a", "b", "code_a", "code_b"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)).cast("double")
    )


def with_values(cells: DataFrame, domain: Domain) -> DataFrame:
    """Add the values behind the codes: value_a, and value_b where there is a b."""
    out = cells
    for side in [s for s in ("a", "b") if s in cells.columns]:
        named = domain.table.select(
            F.col("feature").alias(side), F.col("code").alias(f"code_{side}"), F.col("value").alias(f"value_{side}")
        )
        out = out.join(named, [side, f"code_{side}"], "left")
    return out


def numbered_cells(cells: DataFrame, domain: Domain, pairs: Sequence[tuple[str, str]] | None) -> DataFrame:
    """Seen cells under one number each: a, b, cell, n. ``pairs=None`` gives the
    one-way cells, whose ``b`` is empty."""
    if pairs is None:
        return cells.filter("b is null").select("a", F.lit("").alias("b"), F.col("code_a").cast("long").alias("cell"), "n")
    spark = cells.sparkSession
    sizes = [(a, b, domain.sizes[b]) for a, b in pairs]
    # One row per pair.
    named = cells.join(F.broadcast(spark.createDataFrame(sizes, "a string, b string, kb long")), ["a", "b"])
    return named.select("a", "b", (F.col("code_a") * F.col("kb") + F.col("code_b")).alias("cell"), "n")


def coded_cells(noisy: DataFrame, domain: Domain, pairs: Sequence[tuple[str, str]] | None) -> DataFrame:
    """The codes of numbered noisy cells: a, code_a, m, or a, b, code_a, code_b, m."""
    if pairs is None:
        return noisy.select("a", F.col("cell").cast("int").alias("code_a"), "m")
    spark = noisy.sparkSession
    sizes = spark.createDataFrame([(a, b, domain.sizes[b]) for a, b in pairs], "a string, b string, kb long")
    return noisy.join(F.broadcast(sizes), ["a", "b"]).select(
        "a", "b", F.expr("cell div kb").cast("int").alias("code_a"), (F.col("cell") % F.col("kb")).cast("int").alias("code_b"), "m")


def measured(exact: ExactMarginals, pairs: Sequence[tuple[str, str]] | None, scale: float, passing: float | None,
             seed: int | str | None) -> tuple[DataFrame, list[Frame]]:
    """Noisy cells of the one-way marginals (``pairs=None``) or of some pairs, written down."""
    domain = exact.domain
    passing = passing_cells(exact.n, scale) if passing is None else passing
    named = [(c, "") for c in domain.columns] if pairs is None else list(pairs)
    frames = [frame(a, b, domain.cells(a, b or None), scale, passing) for a, b in named]
    noisy = noisy_cells(numbered_cells(exact.cells, domain, pairs), frames, scale, seed)
    return materialize(coded_cells(noisy, domain, pairs), "noisy"), frames


# --- the model -------------------------------------------------------------
def pair_scores(cells: DataFrame, noisy: DataFrame, pairs: Sequence[tuple[str, str]], n: float) -> DataFrame:
    """L1 gap between each pair's counts and the product of its noisy margins.

    ``noisy`` has a, code_a, m; a value without a row counts as zero. Empty cells
    need no row: all products together sum to the product of the two totals, from
    which the seen ones are taken off.
    """
    m = noisy.select("a", "code_a", F.greatest("m", F.lit(0.0)).alias("m"))
    totals = m.groupBy("a").agg(F.sum("m").alias("total"))
    right = m.select(F.col("a").alias("b"), F.col("code_a").alias("code_b"), F.col("m").alias("m_b"))
    seen = cells.filter("b is not null").join(m, ["a", "code_a"], "left").join(right, ["b", "code_b"], "left")
    product = F.coalesce(F.col("m") * F.col("m_b"), F.lit(0.0)) / F.lit(float(max(n, 1)))
    gaps = seen.groupBy("a", "b").agg(F.sum(F.abs(F.col("n") - product) - product).alias("gap"))
    named = cells.sparkSession.createDataFrame(list(pairs), "a string, b string")
    out = named.join(gaps, ["a", "b"], "left").join(totals, "a", "left").join(
        totals.select(F.col("a").alias("b"), F.col("total").alias("total_b")), "b", "left"
    )
    all_products = F.coalesce(F.col("total") * F.col("total_b"), F.lit(0.0)) / F.lit(float(max(n, 1)))
    return out.select("a", "b", (F.coalesce("gap", F.lit(0.0)) + all_products).alias("score"))


def spanning_tree(scores: Sequence[tuple[str, str, float]], columns: Sequence[str], epsilon: float,
                  generator: random.Random) -> list[tuple[str, str]]:
    """Edges chosen one by one with the exponential mechanism, never closing a
    cycle. Runs over column pairs, not rows."""
    part = {c: c for c in columns}
    edges = []
    while True:
        usable = [(a, b, s) for a, b, s in scores if part[a] != part[b]]
        if not usable:
            return edges
        a, b, _ = usable[gumbel_choice([s for *_, s in usable], epsilon, generator)]
        edges.append((a, b))
        old, new = part[b], part[a]
        part = {c: new if p == old else p for c, p in part.items()}


def rooted(columns: Sequence[str], edges: Sequence[tuple[str, str]]) -> list[tuple[str, str | None]]:
    """Columns in drawing order with their parents; a root has none."""
    near: dict[str, list[str]] = {c: [] for c in columns}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    order: list[tuple[str, str | None]] = []
    placed: set[str] = set()
    for root in columns:
        if root in placed:
            continue
        waiting: list[tuple[str, str | None]] = [(root, None)]
        while waiting:
            c, parent = waiting.pop(0)
            if c in placed:
                continue
            placed.add(c)
            order.append((c, parent))
            waiting += [(x, c) for x in near[c] if x not in placed]
    return order


def intervals(weights: DataFrame) -> DataFrame:
    """Weights per (column, parent_code, code) as shares ``p`` and adjoining
    intervals [lo, hi) that tile [0, 1) in each group; a group without positive
    weights gets equal shares.

    A group may have very many codes: stretches of codes are summed first, and
    only their totals are put in order per group.
    """
    clipped = weights.withColumns({"w": F.greatest(F.col("w"), F.lit(0.0)), "chunk": F.floor(F.col("code") / CHUNK)})
    keys = ["column", "parent_code", "chunk"]
    sums = clipped.groupBy(*keys).agg(F.sum("w").alias("s"), F.count("*").alias("k"))
    group = W.partitionBy("column", "parent_code")
    earlier = group.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, F.sum("s").over(group).alias("total"), F.sum("k").over(group).alias("all"),
        F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("before"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k_before"))
    offsets = offsets.withColumn("after", F.lead("before").over(group.orderBy("chunk")))
    near = W.partitionBy(*keys).orderBy("code")
    inner = clipped.withColumns({"running": F.sum("w").over(near), "place": F.row_number().over(near),
                                 "ends": F.lead("code").over(near).isNull()}).join(offsets, keys)
    some = F.col("total") > 0
    share = F.when(some, F.col("w") / F.col("total")).otherwise(1 / F.col("all"))
    # The last interval of a stretch ends where the next stretch begins, in the same number.
    high = F.when(some, F.least(F.col("before") + F.col("running"), F.coalesce("after", "total")) / F.col("total")).otherwise(
        (F.col("k_before") + F.col("place")) / F.col("all"))
    end = F.when(F.col("after").isNull(), F.lit(1.0)).when(some, F.col("after") / F.col("total")).otherwise(
        (F.col("k_before") + F.col("place")) / F.col("all"))
    begin = F.when(some, F.col("before") / F.col("total")).otherwise(F.col("k_before") / F.col("all"))
    bounded = inner.withColumns({"p": share, "hi": F.when(F.col("ends"), end).otherwise(F.least(high, F.lit(1.0))), "begin": begin})
    low = F.coalesce(F.lag("hi").over(near), F.col("begin"))
    return bounded.select("column", "parent_code", "code", "p", low.alias("lo"), "hi")


@dataclass(frozen=True)
class SynthModel:
    """A fitted tree: drawing order, and one interval table (column,
    parent_code, code, p, lo, hi) in the shared folder."""

    domain: Domain
    order: list[tuple[str, str | None]]
    table: DataFrame
    n: int
    epsilon: float
    delta: float
    private: bool
    fit_seconds: float = 0.0
    budget: dict[str, float] = field(default_factory=dict)

    @property
    def edges(self) -> list[tuple[str, str]]:
        return [(p, c) for c, p in self.order if p is not None]


@dataclass(frozen=True)
class ExactMarginals:
    """Exact cell counts kept for several fits. Not for release."""

    domain: Domain
    pairs: list[tuple[str, str]]
    cells: DataFrame
    n: int


def exact_marginals(df: DataFrame, domain: Domain | Mapping[str, Sequence[str]]) -> ExactMarginals:
    """Count the marginals of all columns and all pairs once and write them down.

    Values outside the domain count as its ``rest``; without one they are refused,
    by column, as leaving their rows out would bias what is left.
    """
    domain = as_domain(df.sparkSession, domain)
    pairs = column_pairs(domain.columns)
    cells = materialize(cell_counts(df, domain, pairs), "cells")
    outside = [r["a"] for r in cells.filter("b is null and code_a is null").select("a").distinct().collect()]  # columns
    if outside and domain.rest is None:
        raise ValueError(f"values outside the domain in {sorted(outside)}; declare a rest category")
    if outside:
        codes = {r["feature"]: r["code"] for r in domain.table.filter(F.col("value") == domain.rest).collect()}  # one per column
        rest = F.create_map(*[x for c, k in codes.items() for x in (F.lit(c), F.lit(k))])
        filled = cells.withColumns({
            "code_a": F.coalesce("code_a", rest[F.col("a")]),
            "code_b": F.when(F.col("b").isNotNull(), F.coalesce("code_b", rest[F.coalesce("b", F.lit(domain.columns[0]))])),
        })
        cells = materialize(filled.groupBy("a", "b", "code_a", "code_b").agg(F.sum("n").alias("n")), "cells")
    rows = cells.filter(F.col("b").isNull() & (F.col("a") == domain.columns[0])).agg(F.sum("n")).first()[0]
    return ExactMarginals(domain, pairs, cells, int(rows or 0))


def conditional_weights(noisy_one: DataFrame, noisy_two: DataFrame | None, order: Sequence[tuple[str, str | None]],
                        domain: Domain) -> DataFrame:
    """(column, parent_code, code, w): the noisy weights of every group of values.

    ``noisy_one``: a, code_a, m. ``noisy_two``: a, b, code_a, code_b, m with each
    pair stored once. Under ``DEFAULT`` each column has its own marginal, which
    serves roots and parent values that have no weight of their own.
    """
    spark = noisy_one.sparkSession
    own = noisy_one.select(F.col("a").alias("column"), F.lit(DEFAULT).alias("parent_code"), F.col("code_a").alias("code"), F.col("m").alias("w"))
    # Columns; those whose noise left nothing above zero draw from all their values alike.
    held = {r["column"] for r in own.filter("w > 0").select("column").distinct().collect()}
    bare = [c for c in domain.columns if c not in held]
    weights = own.filter("w > 0")
    if bare:
        alike = domain.table.filter(F.col("feature").isin(bare)).select(
            F.col("feature").alias("column"), F.lit(DEFAULT).alias("parent_code"), "code", F.lit(1.0).alias("w"))
        weights = weights.unionByName(alike)
    links = [(p, c) for c, p in order if p is not None]
    if not links:
        return weights
    wanted = F.broadcast(spark.createDataFrame(links, "parent string, column string"))  # one row per column
    both_ways = noisy_two.select(
        F.col("a").alias("parent"), F.col("b").alias("column"), F.col("code_a").alias("parent_code"), F.col("code_b").alias("code"), "m",
    ).unionByName(noisy_two.select(
        F.col("b").alias("parent"), F.col("a").alias("column"), F.col("code_b").alias("parent_code"), F.col("code_a").alias("code"), "m",
    ))
    kept = both_ways.filter("m > 0").join(wanted, ["parent", "column"], "left_semi")
    return weights.unionByName(kept.select("column", "parent_code", "code", F.col("m").alias("w")))


def full_tables(table: DataFrame, order: Sequence[tuple[str, str | None]], domain: Domain) -> DataFrame:
    """Conditional tables with every cell written out, for columns of few values:
    column, parent_code (0 at a root), code, p."""
    spark, out = table.sparkSession, None
    for column, parent in order:
        mine = table.filter(F.col("column") == column).select("parent_code", "code", "p")
        own = mine.filter(F.col("parent_code") == DEFAULT).select("code", F.col("p").alias("own_p"))
        groups = mine.filter(F.col("parent_code") != DEFAULT)
        held = groups.select("parent_code", F.lit(True).alias("held")).distinct()
        k = domain.sizes[column]
        cells = spark.range(k * (domain.sizes[parent] if parent else 1)).select(
            F.expr(f"cast(id div {k} AS int)").alias("parent_code"), (F.col("id") % k).cast("int").alias("code"))
        cells = cells.join(own, "code", "left").join(held, "parent_code", "left").join(groups, ["parent_code", "code"], "left")
        p = F.coalesce(F.when(F.col("held"), F.col("p")).otherwise(F.col("own_p")), F.lit(0.0)) if parent else F.coalesce("own_p", F.lit(0.0))
        part = cells.select(F.lit(column).alias("column"), "parent_code", "code", p.alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def model_table(noisy_one: DataFrame, noisy_two: DataFrame | None, order: Sequence[tuple[str, str | None]], domain: Domain) -> DataFrame:
    return intervals(conditional_weights(noisy_one, noisy_two, order, domain))


def _exact(df: DataFrame | ExactMarginals, domain: Domain | Mapping[str, Sequence[str]] | None) -> ExactMarginals:
    if isinstance(df, ExactMarginals):
        return df
    return exact_marginals(df, observed_domain(df, df.columns) if domain is None else domain)


def _scored(exact: ExactMarginals, noisy_one: DataFrame) -> list[tuple[str, str, float]]:
    if not exact.pairs:
        return []
    found = pair_scores(exact.cells, noisy_one, exact.pairs, exact.n).collect()  # one row per column pair
    return sorted((r["a"], r["b"], float(r["score"])) for r in found)


def fit(df: DataFrame | ExactMarginals, domain: Domain | Mapping[str, Sequence[str]] | None = None, epsilon: float = 1.0,
        delta: float = 1e-6, seed: int | None = None, passing: float | None = None, ledger: Ledger | None = None,
        release: str | None = None) -> SynthModel:
    """Fit the tree under (epsilon, delta).

    A third of the budget each goes to the one-way marginals, the choice of the
    edges and the two-way marginals. ``passing`` empty cells (few beside the
    rows, by default) are expected to pass the noise threshold of a marginal. ``seed=None`` is private; a
    seed makes the run repeatable and the model NOT private. With a ``ledger`` the
    budget is taken from it, as ``release``, before anything is measured.
    """
    started = time.perf_counter()
    if ledger is not None:
        ledger.spend(release or f"fit eps={epsilon}", zcdp_budget(epsilon, delta))
    exact = _exact(df, domain)
    domain, columns = exact.domain, exact.domain.columns
    part = zcdp_budget(epsilon, delta) / 3
    scale_one = gaussian_scale(len(columns), part)
    noisy_one, _ = measured(exact, None, scale_one, passing, seed)
    edge_epsilon = selection_epsilon(max(len(columns) - 1, 1), part)
    generator = random.SystemRandom() if seed is None else random.Random(seed)
    edges = spanning_tree(_scored(exact, noisy_one), columns, edge_epsilon, generator)
    order = rooted(columns, edges)
    scale_two = gaussian_scale(max(len(edges), 1), part)
    noisy_two = measured(exact, edges, scale_two, passing, seed)[0] if edges else None
    table = materialize(model_table(noisy_one, noisy_two, order, domain), "model")
    return SynthModel(
        domain, order, table, exact.n, epsilon, delta, seed is None, time.perf_counter() - started,
        {"rho": 3 * part, "scale_one_way": scale_one, "edge_epsilon": edge_epsilon, "scale_two_way": scale_two},
    )


# --- drawing rows ----------------------------------------------------------
def filed_intervals(model: SynthModel, n: int, rows_per_slot: int = ROWS_PER_SLOT) -> tuple[DataFrame, dict[str, int]]:
    """Each interval under every equal slice of [0, 1) it touches, and the number
    of slices of each column's default group.

    Result: column, parent_code, slice, lo, hi, code, value, and ``next``: the
    number of slices that each child column has under this value (absent where it
    has no group for it). A group has as many slices as intervals, or more where
    over ``rows_per_slot`` rows are expected in one; so a value that most rows
    share is drawn from in many places.
    """
    spark = model.table.sparkSession
    parents = {c: p for c, p in model.order}
    sizes = model.table.groupBy("column", "parent_code").agg(F.count("*").alias("k"))
    own = model.table.filter(F.col("parent_code") == DEFAULT).select(
        F.col("column").alias("parent"), F.col("code").alias("parent_code"), F.col("p").alias("mass"))
    tree = F.broadcast(spark.createDataFrame([(c, p) for c, p in parents.items()], "column string, parent string"))  # one row per column
    expected = F.coalesce(F.col("mass"), F.when(F.col("parent_code") == DEFAULT, 1.0).otherwise(0.0)) * F.lit(float(n))
    sliced = sizes.join(tree, "column").join(own, ["parent", "parent_code"], "left").select(
        "column", "parent", "parent_code", F.greatest(F.col("k"), F.ceil(expected / rows_per_slot)).cast("long").alias("slices"))
    sliced = materialize(sliced, "slices")
    default = {r["column"]: r["slices"] for r in sliced.filter(F.col("parent_code") == DEFAULT).collect()}  # one per column
    after = sliced.filter(F.col("parent_code") != DEFAULT).groupBy(F.col("parent").alias("column"), F.col("parent_code").alias("code")).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "slices"))).alias("next"))  # children of one column
    cells = model.table.filter("lo < hi").join(sliced.select("column", "parent_code", "slices"), ["column", "parent_code"])
    values = model.domain.table.select(F.col("feature").alias("column"), "code", "value")
    cells = cells.join(values, ["column", "code"], "left").join(after, ["column", "code"], "left")
    touched = F.sequence(F.floor(F.expr("lo * slices")), F.least(F.floor(F.expr("hi * slices")), F.expr("slices - 1")))
    filed = cells.select("column", "parent_code", "lo", "hi", "code", "value", "next", F.explode(touched).alias("slice"))
    return materialize(filed, "slots"), default


def generate(model: SynthModel, n: int | None = None, seed: int = 42, row_id: str = "row_id",
             uniform: Callable[[Column, str], Column] = fast_uniform, partitions: int | None = None,
             broadcast: bool | None = None, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Draw ``n`` rows (as many as were fitted by default).

    Per column, a row finds its interval by an equi-join on its parent's value and
    its slice of [0, 1), and compares the few intervals filed there. Where a
    column's intervals are small they are broadcast and nothing is shuffled;
    otherwise rows and intervals meet by shuffle, no slice having more than about
    ``rows_per_slot`` rows. ``broadcast`` forces one way; the rows are the same.
    Drawing uses the private model only, so its seed costs no privacy.
    """
    spark = model.table.sparkSession
    n = model.n if n is None else n
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    rows = rows.withColumnRenamed("id", row_id)
    filed, default = filed_intervals(model, n, rows_per_slot)
    children: dict[str, list[str]] = {c: [c2 for c2, p in model.order if p == c] for c, _ in model.order}
    drawn: list[str] = []
    for column, parent in model.order:
        u = uniform(F.col(row_id), f"{seed}-{column}")
        if parent is None:
            group, slices = F.lit(DEFAULT), F.lit(default[column])
        else:
            own = F.col(f"s_{column}")
            group, slices = F.when(own.isNull(), F.lit(DEFAULT)).otherwise(F.col(f"c_{parent}")), F.coalesce(own, F.lit(default[column]))
        place = F.least(F.floor(u * slices), slices - 1).cast("long")
        keyed = rows.select("*", u.alias("__u"), group.alias("__group"), place.alias("__place"))
        slots = filed.filter(F.col("column") == column).select(
            F.col("parent_code").alias("__g"), F.col("slice").alias("__s"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"),
            F.col("code").alias(f"c_{column}"), F.col("value").alias(f"v_{column}"),
            *[F.col("next")[c].alias(f"s_{c}") for c in children[column]])
        if broadcast is not False:
            slots, small = small_or_same(slots)
            slots = F.broadcast(slots) if small or broadcast else slots
        else:
            slots = slots.hint("merge")
        inside = ((F.col("__group") == F.col("__g")) & (F.col("__place") == F.col("__s")) & (F.col("__lo") <= F.col("__u"))
                  & (F.col("__u") < F.col("__hi")))
        rows = keyed.join(slots, inside)
        drawn.append(f"v_{column}")
        # A code and the sizes below it are needed until its children are drawn.
        waiting = [c for c, p in model.order if f"v_{c}" not in drawn]
        codes = [f"c_{c}" for c, _ in model.order if f"v_{c}" in drawn and set(children[c]) & set(waiting)]
        below = [f"s_{c}" for c, p in model.order if c in waiting and p is not None and f"v_{p}" in drawn]
        rows = rows.select(row_id, *drawn, *codes, *below)
    return rows.select(row_id, *[F.col(f"v_{c}").alias(c) for c in model.domain.columns])


def epsilon_sweep(df: DataFrame, domain: Domain | Mapping[str, Sequence[str]], epsilons: Sequence[float], delta: float = 1e-6,
                  n: int | None = None, seed: int | None = None, draw_seed: int = 42, ledger: Ledger | None = None) -> DataFrame:
    """One synthetic copy per ε, stacked with an ``epsilon`` column.

    The exact marginals are counted once. Releasing several copies costs the sum
    of their budgets; a ``ledger`` adds them up and refuses what it cannot cover,
    before the first copy is made.
    """
    if ledger is not None:
        ledger.check(sum(zcdp_budget(e, delta) for e in epsilons))
    exact = exact_marginals(df, domain)
    out = None
    for epsilon in epsilons:
        copy = generate(fit(exact, epsilon=epsilon, delta=delta, seed=seed, ledger=ledger), n, draw_seed)
        copy = copy.withColumn("epsilon", F.lit(float(epsilon)))
        out = copy if out is None else out.unionByName(copy)
    return out
