"""A fit in rounds: choose the pair that the model so far fits worst, measure it, refit.

The loop follows AIM (McKenna et al., VLDB 2022) within tree models. A candidate
is a pair that joins two parts of the tree, or an edge that may be measured
again. Its score is the L1 gap between its true counts and what the model says,
less the error that measuring it would bring; so where the budget is small, wide
noisy pairs lose against narrow ones. After each round

- the measurements of a pair are averaged by their precision,
- the marginals of its two columns are averaged with the sums of the pair's table,
- an edge whose table differs from the product of its marginals by no more than
  noise alone would is left out of the model: its columns are drawn apart,
- a round that taught nothing doubles the budget of the next.

All decisions after a measurement look at noisy tables only. Neighbours differ by
one row; the row count is public.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.operators.budget import Ledger
from tabveil.operators.domains import Domain
from tabveil.operators.noise import gaussian_scale, gumbel_choice, zcdp_budget
from tabveil.operators.sparse_noise import passing_cells
from tabveil.operators.synthesis import ExactMarginals, SynthModel, _exact, _scored, measured, model_table, rooted
from tabveil.session import materialize

ONE_WAY_SHARE, CHOICE_SHARE = 0.2, 0.1
MEAN_ABSOLUTE = math.sqrt(2 / math.pi)  # of a standard normal


@dataclass(frozen=True)
class Round:
    """What one round did: the pair, its budget, noise, and what it changed."""

    pair: tuple[str, str]
    rho: float
    scale: float
    change: float
    expected_noise: float


@dataclass
class _Edge:
    table: DataFrame  # a, b, code_a, code_b, m
    precision: float
    change: float
    noise: float


def _averaged(tables: Sequence[tuple[DataFrame, float]], keys: Sequence[str]) -> DataFrame:
    """Noisy tables of the same cells, weighted by precision; a cell without row is 0."""
    total = sum(p for _, p in tables)
    parts = None
    for table, precision in tables:
        part = table.select(*keys, (F.col("m") * F.lit(precision / total)).alias("m"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*keys).agg(F.sum("m").alias("m"))


def _gap_to_product(edge: DataFrame, margins: DataFrame, n: float) -> float:
    """L1 distance between a noisy pair table and the product of the marginals."""
    left = margins.select("a", "code_a", F.greatest("m", F.lit(0.0)).alias("m_a"))
    right = left.select(F.col("a").alias("b"), F.col("code_a").alias("code_b"), F.col("m_a").alias("m_b"))
    product = F.coalesce(F.col("m_a") * F.col("m_b"), F.lit(0.0)) / F.lit(max(n, 1.0))
    seen = edge.join(left, ["a", "code_a"], "left").join(right, ["b", "code_b"], "left")
    row = seen.agg(F.sum(F.abs(F.col("m") - product) - product).alias("gap"), F.first("a").alias("a"), F.first("b").alias("b")).first()
    if row["gap"] is None:
        return 0.0
    sums = {r["a"]: r["s"] for r in left.groupBy("a").agg(F.sum("m_a").alias("s")).collect()}  # one per column
    return float(row["gap"]) + sums.get(row["a"], 0.0) * sums.get(row["b"], 0.0) / max(n, 1.0)


def _refitted(margins: DataFrame, precision: dict[str, float], edge: DataFrame, pair: tuple[str, str], pair_precision: float,
              domain: Domain) -> DataFrame:
    """The marginals of the pair's columns averaged with the sums of its table."""
    parts = [margins.select("a", "code_a", "m", F.lit(None).cast("double").alias("sum"))]
    for column, code, other in ((pair[0], "code_a", pair[1]), (pair[1], "code_b", pair[0])):
        gained = pair_precision / domain.sizes[other]
        weight = gained / (precision[column] + gained)
        precision[column] += gained
        sums = edge.groupBy(F.col(code).alias("code_a")).agg(F.sum("m").alias("s"))
        parts.append(sums.select(F.lit(column).alias("a"), "code_a", F.lit(0.0).alias("m"), (F.col("s") * F.lit(weight)).alias("sum")))
        parts[0] = parts[0].withColumn("m", F.when(F.col("a") == column, F.col("m") * F.lit(1 - weight)).otherwise(F.col("m")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return materialize(every.groupBy("a", "code_a").agg((F.sum("m") + F.coalesce(F.sum("sum"), F.lit(0.0))).alias("m")), "margins")


def fit_adaptive(df: DataFrame | ExactMarginals, domain: Domain | Mapping[str, Sequence[str]] | None = None, epsilon: float = 1.0,
                 delta: float = 1e-6, seed: int | None = None, passing: float | None = None, ledger: Ledger | None = None,
                 release: str | None = None) -> tuple[SynthModel, list[Round]]:
    """A tree fitted in rounds under (epsilon, delta), and what each round did.

    ``seed=None`` is private; a seed makes the run repeatable and NOT private.
    """
    started = time.perf_counter()
    rho = zcdp_budget(epsilon, delta)
    if ledger is not None:
        ledger.spend(release or f"adaptive fit eps={epsilon}", rho)
    exact = _exact(df, domain)
    domain, columns, n = exact.domain, exact.domain.columns, float(exact.n)
    generator = random.SystemRandom() if seed is None else random.Random(seed)
    # A single column has nothing to choose.
    first = rho * ONE_WAY_SHARE if exact.pairs else rho
    scale_one = gaussian_scale(len(columns), first)
    margins, _ = measured(exact, None, scale_one, passing, seed)
    precision = {c: 1 / scale_one**2 for c in columns}
    left = rho - first
    share = left / max(len(columns) - 1, 1)
    part = {c: c for c in columns}
    edges: dict[tuple[str, str], _Edge] = {}
    rounds: list[Round] = []

    def expected_noise(pair: tuple[str, str], scale: float) -> float:
        # Rows are public, so the number of cells that can matter is too.
        return MEAN_ABSOLUTE * scale * min(domain.cells(*pair), (passing_cells(n, scale) if passing is None else passing) + n)

    while exact.pairs and left > rho * 1e-9:
        cost = min(share, left)
        if left - cost < cost / 2:
            cost = left
        scale = gaussian_scale(1, cost * (1 - CHOICE_SHARE))
        gaps = {(a, b): s for a, b, s in _scored(exact, margins)}
        for pair, edge in edges.items():
            gaps[pair] = _true_gap(exact, pair, edge.table)
        usable = [p for p in sorted(gaps) if part[p[0]] != part[p[1]] or p in edges]
        worth = [gaps[p] - expected_noise(p, scale) for p in usable]
        pair = usable[gumbel_choice(worth, math.sqrt(8 * cost * CHOICE_SHARE), generator)]
        table, frames = measured(exact, [pair], scale, passing, None if seed is None else f"{seed}-{len(rounds)}")
        new = 1 / scale**2
        if pair in edges:
            old = edges[pair]
            change = _change(old.table, table)
            table = materialize(_averaged([(old.table, old.precision), (table, new)], ["a", "b", "code_a", "code_b"]), "edge")
            edge = _Edge(table, old.precision + new, 0.0, 0.0)
        else:
            change = _gap_to_product(table, margins, n)
            edge = _Edge(table, new, 0.0, 0.0)
            gone, kept = part[pair[1]], part[pair[0]]
            part = {c: kept if p == gone else p for c, p in part.items()}
        noise = expected_noise(pair, scale)
        if frames[0].share >= 1:
            margins = _refitted(margins, precision, table, pair, new, domain)
        edge.change, edge.noise = _gap_to_product(edge.table, margins, n), expected_noise(pair, 1 / math.sqrt(edge.precision))
        edges[pair] = edge
        rounds.append(Round(pair, cost, scale, change, noise))
        left -= cost
        if change <= noise:
            share *= 2
    # Edges that noise alone would explain are not drawn along.
    told = [p for p, e in edges.items() if e.change > e.noise]
    order = rooted(columns, told)
    tables = None
    for p in told:
        tables = edges[p].table if tables is None else tables.unionByName(edges[p].table)
    table = materialize(model_table(margins, tables, order, domain), "model")
    budget = {"rho": rho, "scale_one_way": scale_one, "rounds": float(len(rounds))}
    return SynthModel(domain, order, table, exact.n, epsilon, delta, seed is None, time.perf_counter() - started, budget), rounds


def _true_gap(exact: ExactMarginals, pair: tuple[str, str], table: DataFrame) -> float:
    """L1 gap between a pair's counts and its noisy table; sensitivity 1."""
    seen = exact.cells.filter((F.col("a") == pair[0]) & (F.col("b") == pair[1])).select("code_a", "code_b", F.col("n").cast("double").alias("x"))
    both = seen.unionByName(table.select("code_a", "code_b", (-F.greatest("m", F.lit(0.0))).alias("x")))
    return float(both.groupBy("code_a", "code_b").agg(F.sum("x").alias("x")).agg(F.sum(F.abs("x"))).first()[0] or 0.0)


def _change(old: DataFrame, new: DataFrame) -> float:
    """L1 distance between two noisy tables of a pair."""
    both = old.select("code_a", "code_b", "m").unionByName(new.select("code_a", "code_b", (-F.col("m")).alias("m")))
    return float(both.groupBy("code_a", "code_b").agg(F.sum("m").alias("m")).agg(F.sum(F.abs("m"))).first()[0] or 0.0)
