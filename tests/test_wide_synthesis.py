"""Wide marginals, drawing by shuffle, rounds, and values outside the domain."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tabveil.functions.hashing import fast_uniform
from tabveil.operators import adaptive, sparse_noise, synthesis, utility
from tabveil.operators.domains import declared_domain, observed_domain


@pytest.mark.parametrize("n,p", [(1, 0.5), (32, 1.0), (2560, 0.0125), (10**9, 3.2e-8)])
def test_binomial_steps(n, p):
    steps = sparse_noise.binomial_steps(n, p)
    assert steps == sorted(steps) and len(steps) <= n
    # The mean of a number whose distribution function has these steps.
    assert sum(1 - s for s in steps) == pytest.approx(n * p, rel=1e-6)


def test_normal_quantile(spark):
    from statistics import NormalDist

    shares = [1e-300, 1e-20, 1e-9, 0.001, 0.074, 0.0751, 0.3, 0.5, 0.8, 0.925, 0.9999, 1 - 1e-9]
    rows = spark.createDataFrame([(u,) for u in shares], "u double").select(F.expr(sparse_noise.normal_quantile("u")).alias("x")).collect()
    assert [r["x"] for r in rows] == pytest.approx([NormalDist().inv_cdf(u) for u in shares], rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("seed", [None, 3])
def test_empty_cells_pass_as_often_as_they_should(spark, seed):
    frames = [sparse_noise.frame("x", "y", 300_000, 2.0, passing=3_000), sparse_noise.frame("x", "z", 777, 2.0, passing=3_000)]
    cells = sparse_noise.empty_cells(spark, frames, 2.0, seed)
    rows = {r["b"]: r for r in cells.groupBy("b").agg(F.count("*").alias("n"), F.countDistinct("cell").alias("k"), F.min("m").alias("low"),
                                                      F.max("cell").alias("top"), F.avg("m").alias("mean"), F.avg("cell").alias("middle")).collect()}
    wide, narrow = rows["y"], rows["z"]
    assert abs(wide["n"] - 3000) < 6 * math.sqrt(3000) and wide["k"] == wide["n"] and wide["low"] >= frames[0].threshold
    assert wide["top"] < 300_000 and wide["middle"] == pytest.approx(150_000, rel=0.05)
    # Mean of a normal beyond its threshold: density over share.
    z = frames[0].threshold / 2.0
    assert wide["mean"] == pytest.approx(2.0 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / frames[0].share, rel=0.02)
    # A marginal with few cells keeps all of them, with plain noise.
    assert narrow["n"] == narrow["k"] == 777 and abs(narrow["mean"]) < 0.4


@pytest.fixture(scope="module")
def wide(spark):
    i = F.col("id") % 2000
    return spark.range(20_000).select(i.cast("string").alias("x"), F.concat(F.lit("y"), i).alias("y"), (F.col("id") % 3).cast("string").alias("z"))


def test_a_wide_pair_keeps_its_edge(spark, wide):
    """4,000,000 cells, one value of y per value of x."""
    model = synthesis.fit(wide, epsilon=8.0, seed=2)
    assert ("x", "y") in model.edges
    assert model.table.count() < 40_000  # far from the product
    rows = synthesis.generate(model)
    assert rows.count() == 20_000
    assert rows.filter(F.concat(F.lit("y"), F.col("x")) == F.col("y")).count() > 12_000


def test_drawing_by_shuffle_gives_the_same_rows(spark, wide):
    model = synthesis.fit(wide, epsilon=2.0, seed=1)
    plain = synthesis.generate(model, 5_000, broadcast=True)
    dealt = synthesis.generate(model, 5_000, broadcast=False, rows_per_slot=40)
    assert "Broadcast" not in dealt._jdf.queryExecution().executedPlan().toString()
    assert dealt.count() == 5_000 and utility.tables_equal(plain, dealt).first()[0]


def test_a_value_most_rows_share_is_drawn_in_many_slices(spark):
    hot = spark.range(3000).select(F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("a"), (F.col("id") % 4).cast("string").alias("b"))
    model = synthesis.fit(hot, epsilon=20.0, seed=1)
    filed, default = synthesis.filed_intervals(model, 3000, rows_per_slot=50)
    drawn = spark.range(3000).withColumn("u", fast_uniform(F.col("id"), "42-a"))
    per_slice = drawn.groupBy(F.floor(F.col("u") * default["a"])).count().agg(F.max("count")).first()[0]
    assert default["a"] >= 60 and per_slice < 120
    assert max(r["n"] for r in filed.groupBy("column").agg(F.max("slice").alias("n")).collect()) >= 50


def test_values_outside_the_domain(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("new", "y"), ("other", None)], "p string, q string")
    with pytest.raises(ValueError, match="'p'"):
        synthesis.exact_marginals(rows, {"p": ["a", "b"], "q": ["x", "y", "NULL"]})
    exact = synthesis.exact_marginals(rows, declared_domain(spark, {"p": ["a", "b"], "q": ["x", "y"]}, rest="REST"))
    assert exact.n == 4
    counts = {(r["a"], r["value_a"]): r["n"] for r in synthesis.with_values(synthesis.one_way(exact.cells, exact.domain), exact.domain).collect()}
    assert counts == {("p", "a"): 1, ("p", "b"): 1, ("p", "REST"): 2, ("q", "x"): 2, ("q", "y"): 1, ("q", "REST"): 1}


def test_intervals_over_several_stretches(spark):
    """More codes than are summed together first: still without gaps."""
    weights = spark.range(10_000).select(F.lit("c").alias("column"), F.lit(-1).alias("parent_code"), F.col("id").cast("int").alias("code"),
                                         (1 + F.col("id") % 7).cast("double").alias("w"))
    rows = synthesis.intervals(weights).orderBy("code").collect()
    assert rows[0]["lo"] == 0.0 and rows[-1]["hi"] == 1.0
    assert all(a["hi"] == b["lo"] for a, b in zip(rows, rows[1:]))
    total = sum(1 + k % 7 for k in range(10_000))
    assert max(abs(r["hi"] - r["lo"] - (1 + r["code"] % 7) / total) for r in rows) < 1e-12


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        a = "a0" if rng.random() < 0.5 else f"a{rng.randrange(1, 4)}"
        rows.append((a, "b" + a[1] if rng.random() < 0.9 else "b9", f"c{rng.randrange(3)}", f"d{rng.randrange(40)}"))
    table = spark.createDataFrame(rows, "a string, b string, c string, d string").cache()
    return table, synthesis.exact_marginals(table, observed_domain(table, table.columns))


def _mean_pair_error(table, model):
    return utility.jsd_per_pair(table, synthesis.generate(model)).agg(F.avg("jsd")).first()[0]


@pytest.mark.parametrize("epsilon", [0.3, 2.0])
def test_rounds_fit_better_than_one_shot(mixed, epsilon):
    table, exact = mixed
    once, rounds = [], []
    for seed in range(2):
        once.append(_mean_pair_error(table, synthesis.fit(exact, epsilon=epsilon, seed=seed)))
        model, done = adaptive.fit_adaptive(exact, epsilon=epsilon, seed=seed)
        rounds.append(_mean_pair_error(table, model))
        # Rounds and first marginals cost the whole budget and no more.
        assert sum(r.rho for r in done) + adaptive.ONE_WAY_SHARE * model.budget["rho"] == pytest.approx(model.budget["rho"])
        assert done[0].pair == ("a", "b") and ("a", "b") in [tuple(sorted(e)) for e in model.edges]
    assert statistics.mean(rounds) < statistics.mean(once)


def test_rounds_on_one_column(spark):
    model, done = adaptive.fit_adaptive(spark.createDataFrame([("a",), ("b",)], "x string"), epsilon=1.0)
    assert done == [] and synthesis.generate(model, 10).count() == 10
