import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tabveil.operators import risk
from tabveil.operators.neighbours import nearest, nearest_k


# s, n, risk, low, high as printed in recorded runs
@pytest.mark.parametrize("s,n,value,low,high", [
    (31, 100, 0.3170, 0.2278, 0.4063), (2, 100, 0.0378, 0.0055, 0.0700), (57, 100, 0.5674, 0.4722, 0.6627),
    (0, 100, 0.0185, 0.0, 0.0370), (39, 100, 0.3941, 0.3002, 0.4880), (57, 500, 0.1169, 0.0890, 0.1448),
    (0, 500, 0.0038, 0.0, 0.0076), (72, 500, 0.1467, 0.1159, 0.1775), (82, 500, 0.1666, 0.1341, 0.1990),
    (500, 500, 0.9962, None, 1.0),
])
def test_recorded_risks(spark, s, n, value, low, high):
    row = risk.with_risk(spark.createDataFrame([(s, n)], "successes long, n long")).first()
    assert round(row["risk"], 4) == value and round(row["ci_high"], 4) == high
    assert low is None or round(row["ci_low"], 4) == low


def test_longer_recorded_digits(spark):
    df = spark.createDataFrame([(63, 500), (86, 500), (2, 500)], "successes long, n long")
    got = [r["risk"] for r in risk.with_risk(df).orderBy("successes").collect()]
    assert got == pytest.approx([0.00778167, 0.12885150, 0.17450078], abs=1e-8)


def test_no_attack_no_risk(spark):
    row = risk.with_risk(spark.createDataFrame([(0, 0)], "successes long, n long")).first()
    assert row["risk"] is None


def people(n, seed, sizes=(3, 4, 2, 5)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.35  # one combination holds a third of the rows
        rows.append((i, *["v0" if hot else f"v{rng.randrange(k)}" for k in sizes], f"s{rng.randrange(3)}"))
    return rows


COLUMNS = ["a", "b", "c", "d"]
SCHEMA = "id long, a string, b string, c string, d string, secret string"


def gap(x, y):
    return sum(u != v for u, v in zip(x, y))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_against_all_pairs(spark, seed):
    ori, syn = people(60, seed), people(40, seed + 100, sizes=(4, 5, 3, 6))
    found = nearest(spark.createDataFrame(ori, SCHEMA), spark.createDataFrame(syn, SCHEMA), COLUMNS, "id", ["secret"])
    got = {tuple(r[c] for c in COLUMNS): (r["distance"], r["neighbour"], r["secret"]) for r in found.collect()}
    want = {}
    for row in ori:
        d, i, s = min((gap(row[1:5], other[1:5]), other[0], other[5]) for other in syn)
        want[row[1:5]] = (d, i, s)
    assert got == want


@pytest.mark.parametrize("k", [1, 3, 7])
def test_nearest_k_against_all_pairs(spark, k):
    ori, syn = people(50, 5), people(45, 6)
    found = nearest_k(spark.createDataFrame(ori, SCHEMA), spark.createDataFrame(syn, SCHEMA), COLUMNS, "id", k)
    got = {}
    for r in found.collect():
        got.setdefault(tuple(r[c] for c in COLUMNS), {})[r["rank"]] = (r["distance"], r["neighbour"])
    for row in ori:
        want = sorted((gap(row[1:5], other[1:5]), other[0]) for other in syn)[:k]
        assert [got[row[1:5]][i + 1] for i in range(k)] == want


def test_target_that_matches_nothing(spark):
    ori = spark.createDataFrame([(1, "p", "q", "r", "s", "x")], SCHEMA)
    syn = spark.createDataFrame([(9, "1", "2", "3", "4", "y"), (8, "1", "2", "3", "4", "z")], SCHEMA)
    row = nearest(ori, syn, COLUMNS, "id", ["secret"]).first()
    assert (row["distance"], row["neighbour"], row["secret"]) == (4, 8, "z")
    assert nearest(ori, syn.limit(0), COLUMNS, "id").count() == 0


def test_inference_of_a_determined_secret(spark):
    df = spark.createDataFrame(people(200, 9), SCHEMA).withColumn("secret", F.concat("a", "b"))
    row = risk.inference(df, df, ["a", "b"], "secret", "id", "id").first()
    assert row["n"] == row["successes"] == 200
    drawn = risk.inference(df, df, ["a", "b"], "secret", "id", "id", n_attacks=50).first()
    assert drawn["n"] == drawn["successes"] == 50


def test_linkability_needs_disjoint_parts(spark):
    df = spark.createDataFrame(people(20, 1), SCHEMA)
    with pytest.raises(ValueError):
        risk.linkability(df, df, ["a"], ["a"], "id", "id")


@pytest.mark.parametrize("k", [1, 2])
def test_linkability_against_all_pairs(spark, k):
    ori, syn = people(60, 21), people(50, 22)
    row = risk.linkability(spark.createDataFrame(ori, SCHEMA), spark.createDataFrame(syn, SCHEMA), ["a", "b"], ["c", "d"],
                           "id", "id", k=k).first()

    def near(row, lo, hi):
        return {i for _, i in sorted((gap(row[lo:hi], o[lo:hi]), o[0]) for o in syn)[:k]}

    hits = sum(bool(near(r, 1, 3) & near(r, 3, 5)) for r in ori)
    assert (row["n"], row["successes"]) == (60, hits)


def singled(ori, syn, sets, index):
    hits = {}
    for no, s in enumerate(sets):
        pick = lambda r: tuple(r[index[c]] for c in s)
        seen, there = Counter(map(pick, syn)), Counter(map(pick, ori))
        hits.update({(no, v): there[v] for v, n in seen.items() if n == 1})
    return hits


def test_singling_out_all_predicates(spark):
    ori, syn = people(80, 31), people(70, 32)
    sets = list(combinations(COLUMNS, 3))
    hits = singled(ori, syn, sets, {c: i + 1 for i, c in enumerate(COLUMNS)})
    row = risk.singling_out_multivariate(spark.createDataFrame(ori, SCHEMA), spark.createDataFrame(syn, SCHEMA), COLUMNS).first()
    assert (row["n"], row["successes"]) == (len(hits), sum(h == 1 for h in hits.values()))


@pytest.mark.parametrize("n", [3, 12, 500])
def test_drawn_attacks_do_not_depend_on_the_batch(spark, n, monkeypatch):
    ori = spark.createDataFrame(people(80, 31), SCHEMA)
    syn = spark.createDataFrame(people(70, 32), SCHEMA)
    rows = []
    for batch in (1, 4, 40):
        monkeypatch.setattr(risk, "CANDIDATES_PER_ATTACK", batch)
        rows.append(tuple(risk.singling_out_multivariate(ori, syn, COLUMNS, n_attacks=n, syn_id="id").first()))
    assert rows[0] == rows[1] == rows[2] and rows[0][1] <= n


def test_univariate_extremes(spark):
    ori = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("y", 9.0)], "t string, v double")
    syn = spark.createDataFrame([("x", 1.5), ("z", 5.0)], "t string, v double")
    got = {(r["feature"], r["operator"], r["value"]): r["hits"] for r in risk.univariate_predicates(ori, syn, ["t"], ["v"]).collect()}
    assert got == {("t", "=", "x"): 1, ("t", "=", "z"): 0, ("v", "<=", "1.5"): 1, ("v", ">=", "5.0"): 1}
    row = risk.singling_out_univariate(ori, syn, ["t"], ["v"]).first()
    assert (row["n"], row["successes"]) == (4, 3)


def test_ladder_lists_every_rung(spark):
    ori = spark.createDataFrame(people(80, 31), SCHEMA)
    syn = spark.createDataFrame(people(70, 32), SCHEMA)
    ladder = risk.attribute_ladder(ori, syn, {"all": COLUMNS, "three": COLUMNS[:3]}).collect()
    assert {r["rung"] for r in ladder} == {"all", "three"}
    alone = risk.singling_out_multivariate(ori, syn, COLUMNS[:3]).first()
    three = next(r for r in ladder if r["rung"] == "three")
    assert (three["n"], three["successes"]) == (alone["n"], alone["successes"])
    assert [r["privacy_score"] for r in ladder] == sorted(r["privacy_score"] for r in ladder)
