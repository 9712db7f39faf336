import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tabveil.operators import noise, synthesis, utility

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        a = "a0" if rng.random() < 0.5 else f"a{rng.randrange(1, 4)}"
        rows.append((a, "b" + a[1] if rng.random() < 0.9 else "b9", f"c{rng.randrange(3)}"))
    return spark.createDataFrame(rows, "a string, b string, c string").cache()


@pytest.fixture(scope="module")
def domain(table):
    found = {c: sorted(r[c] for r in table.select(c).distinct().collect()) for c in COLUMNS}
    found["c"] = [*found["c"], "c_never_seen"]
    return found


def test_budget():
    rho = noise.zcdp_budget(1.0, 1e-6)
    # The conversion rho + 2·sqrt(rho·ln(1/delta)) gives epsilon back.
    assert rho + 2 * math.sqrt(rho * math.log(1e6)) == pytest.approx(1.0)
    assert noise.gaussian_scale(4, rho) == pytest.approx(math.sqrt(4 / (2 * rho)))
    each = noise.selection_epsilon(3, rho)
    assert 3 * each**2 / 8 == pytest.approx(rho)
    for bad in ((0, 1e-6), (1, 0), (1, 1)):
        with pytest.raises(ValueError):
            noise.zcdp_budget(*bad)


@pytest.mark.parametrize("seed", [None, 5])
def test_noise_has_the_asked_scale(spark, seed):
    df = spark.range(20000).select(F.col("id").alias("k"), F.lit(10.0).alias("n"))
    drawn = [r.m for r in noise.add_gaussian(df, "n", 3.0, "m", ["k"], seed).select("m").collect()]
    assert statistics.mean(drawn) == pytest.approx(10.0, abs=0.15)
    assert statistics.stdev(drawn) == pytest.approx(3.0, rel=0.05)


def test_exponential_mechanism_prefers_high_scores():
    rng = random.Random(1)
    picks = [noise.gumbel_choice([0.0, 5.0, 10.0], 1.0, rng) for _ in range(3000)]
    share = picks.count(2) / len(picks)
    want = math.exp(5) / (1 + math.exp(2.5) + math.exp(5))
    assert share == pytest.approx(want, abs=0.03)


def test_marginals_include_empty_cells(spark, table, domain):
    exact = synthesis.exact_marginals(table, domain)
    assert exact.n == 3000
    one = synthesis.one_way(exact.cells, exact.domain).collect()
    assert len(one) == sum(map(len, domain.values()))
    assert {r.n for r in one if r.a == "c" and r.code_a == len(domain["c"]) - 1} == {0.0}
    two = synthesis.two_way(exact.cells, exact.domain, [("a", "c")]).collect()
    assert len(two) == len(domain["a"]) * len(domain["c"])
    assert sum(r.n for r in two) == 3000


def test_pair_scores_by_hand(spark, table, domain):
    exact = synthesis.exact_marginals(table, domain)
    margins = synthesis.one_way(exact.cells, exact.domain).withColumnRenamed("n", "m")
    got = {(r.a, r.b): r.score for r in synthesis.pair_scores(exact.cells, margins, exact.pairs, exact.n).collect()}
    rows = table.collect()
    for a, b in exact.pairs:
        want = 0.0
        for x in domain[a]:
            for y in domain[b]:
                both = sum(r[a] == x and r[b] == y for r in rows)
                want += abs(both - sum(r[a] == x for r in rows) * sum(r[b] == y for r in rows) / 3000)
        assert got[(a, b)] == pytest.approx(want)
    assert max(got, key=got.get) == ("a", "b")


def test_tree_spans(spark):
    edges = synthesis.spanning_tree([("a", "b", 9.0), ("a", "c", 1.0), ("b", "c", 1.0)], COLUMNS, 1e6, random.Random(1))
    assert len(edges) == 2 and ("a", "b") in edges
    order = synthesis.rooted(COLUMNS, edges)
    assert [c for c, _ in order][0] == "a" and {c for c, _ in order} == set(COLUMNS)


def test_rows_and_values_stay_in_the_domain(spark, table, domain):
    for epsilon in (0.01, 10.0):
        syn = synthesis.generate(synthesis.fit(table, domain, epsilon=epsilon))
        rows = syn.collect()
        assert len(rows) == 3000 and len({r.row_id for r in rows}) == 3000
        assert all(r[c] in domain[c] for r in rows for c in COLUMNS)


def test_intervals_tile_the_unit_range(spark, table, domain):
    model = synthesis.fit(table, domain, epsilon=0.05)
    groups = {}
    for r in model.table.orderBy("column", "parent_code", "code").collect():
        groups.setdefault((r["column"], r["parent_code"]), []).append((r["lo"], r["hi"]))
    for cells in groups.values():
        assert cells[0][0] == 0.0 and cells[-1][1] == 1.0
        assert all(before[1] == after[0] for before, after in zip(cells, cells[1:]))


def test_drawing_is_repeatable_and_noise_is_not(spark, table, domain):
    model = synthesis.fit(table, domain, epsilon=1.0)
    a = synthesis.generate(model, 400, partitions=1)
    b = synthesis.generate(model, 400, partitions=9)
    assert utility.tables_equal(a, b).first()[0]
    assert not utility.tables_equal(a, synthesis.generate(model, 400, seed=7)).first()[0]
    other = synthesis.fit(table, domain, epsilon=1.0)
    assert model.private and other.private
    assert not utility.tables_equal(model.table.select("code", "p"), other.table.select("code", "p")).first()[0]
    first, second = (synthesis.fit(table, domain, epsilon=1.0, seed=4) for _ in range(2))
    assert not first.private
    assert utility.tables_equal(first.table.drop("lo", "hi"), second.table.drop("lo", "hi")).first()[0]


def test_error_falls_with_epsilon(spark, table, domain):
    exact = synthesis.exact_marginals(table, domain)
    scores = {}
    for epsilon in (0.01, 1.0, 100.0):
        runs = [
            utility.joint_utility(table, synthesis.generate(synthesis.fit(exact, epsilon=epsilon, seed=s))).first()[0]
            for s in range(3)
        ]
        scores[epsilon] = statistics.mean(runs)
    assert scores[0.01] < scores[1.0] < scores[100.0] and scores[100.0] > 0.9


def test_sweep_stacks_copies(spark, table, domain):
    sweep = synthesis.epsilon_sweep(table, domain, [0.1, 10.0], n=200)
    assert {(r["epsilon"], r["count"]) for r in sweep.groupBy("epsilon").count().collect()} == {(0.1, 200), (10.0, 200)}
