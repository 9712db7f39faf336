import os
import random

import pytest
from pyspark.sql import functions as F

from tabveil.operators import conjunctions, risk
from tabveil.operators.conjunctions import ColumnSet, count_conjunctions, once_satisfied, proposed
from tabveil.sources.commits import EpsilonStore

SETS = [ColumnSet(("t",), ()), ColumnSet(("t",), ("x",)), ColumnSet((), ("x", "y")), ColumnSet(("t", "s"), ("x", "y", "z")), ColumnSet((), ("z",))]
SCHEMA = "id long, t string, s string, x double, y int, z long"


def _table(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice(["p", "q"]), rng.choice([None, float(rng.randrange(50)), rng.random() * 50]),
             rng.randrange(9), rng.randrange(1000)) for i in range(n)]


def _satisfied(row, g, vs, s):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    value = dict(zip(names, row))
    if [("NULL" if value[c] is None else value[c]) for c in s.text] != list(g[1:]):
        return False
    signs = [1 if k == "+" else -1 for k in g[0].split(":")[1]]
    return all(value[c] is not None and k * value[c] <= v for c, k, v in zip(s.numeric, signs, vs))


def test_counts_against_every_row(spark):
    rows, asks = _table(1, 900), _table(2, 80)
    medians = {"x": 25.0, "y": 4.0, "z": 500.0}
    wanted = proposed(spark.createDataFrame(asks, SCHEMA), SETS, medians, keep=["id"])
    wanted = wanted.withColumn("pid", F.col("id") * 10 + F.col("set_no")).drop("id").cache()
    found = {r["pid"]: r["hits"] for r in count_conjunctions(spark.createDataFrame(rows, SCHEMA), wanted, SETS).collect()}
    every = wanted.collect()
    assert len(found) == len(every) > 300
    for r in every:
        assert found[r["pid"]] == sum(_satisfied(row, r["g"], r["vs"], SETS[r["set_no"]]) for row in rows)


def test_no_rows(spark):
    some, none = spark.createDataFrame(_table(3, 20), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert risk.conjunction_predicates(some, none, SETS).count() == 0
    assert {r["hits"] for r in risk.conjunction_predicates(none, some, SETS).collect()} == {0}
    assert risk.singling_out_conjunctions(some, none, SETS).first()["risk"] is None


def test_drawn_conjunctions(spark):
    left, right = (spark.createDataFrame(_table(s, 200), SCHEMA) for s in (4, 5))
    every = risk.conjunction_predicates(left, right, SETS)
    drawn = risk.conjunction_predicates(left, right, SETS, n_attacks=25)
    assert drawn.count() == 25 and drawn.exceptAll(every).count() == 0


@pytest.fixture
def people(spark):
    rng = random.Random(8)
    rows = [(i, *[rng.choice("abc") for _ in range(5)]) for i in range(200)]
    return spark.createDataFrame(rows, "row_id long, p string, q string, r string, s string, secret string")


def test_a_store_with_damaged_and_missing_copies(spark, people, tmp_path):
    store = EpsilonStore(spark, str(tmp_path / "copies"))
    for e in (10.0, 1.0, 0.1):
        store.write(people.filter(F.col("row_id") % 7 != int(e)), e)
    entry = store.steps()["1.0"]
    os.remove(os.path.join(entry.path.removeprefix("file:"), next(iter(entry.files))))
    columns = ["p", "q", "r", "s"]
    rows = risk.audit_store(people, store, [10.0, 1.0, 0.1, 0.01], columns, columns, ["p", "q"], ["r", "s"], "secret").collect()
    status = {r["epsilon"]: r["status"] for r in rows}
    assert status == {10.0: "ok", 1.0: "damaged", 0.1: "ok", 0.01: "missing"} and len(rows) == 12
    for r in rows:
        assert (r["n"] is None) == (r["status"] != "ok")
        if r["status"] != "ok":
            continue
        # The same attack on this copy alone.
        copy = people.filter(F.col("row_id") % 7 != int(r["epsilon"]))
        alone = {
            risk.SINGLING_OUT: lambda c=copy: risk.singling_out_multivariate(people, c, columns),
            risk.LINKABILITY: lambda c=copy: risk.linkability(people, c, ["p", "q"], ["r", "s"], "row_id", "row_id"),
            risk.INFERENCE: lambda c=copy: risk.inference(people, c, columns, "secret", "row_id", "row_id"),
        }[r["attack"]]().first()
        assert (r["n"], r["successes"]) == (alone["n"], alone["successes"])


def test_a_store_without_copies(spark, people, tmp_path):
    store = EpsilonStore(spark, str(tmp_path / "none"))
    rows = risk.audit_store(people, store, [1.0], ["p", "q", "r"], ["p", "q"], ["p"], ["q"], "secret").collect()
    assert {r["status"] for r in rows} == {"missing"} and {r["n"] for r in rows} == {None}


def test_conjunctions_of_one_row_against_every_row(spark):
    rows = [*_table(6, 700), *_table(7, 60), *_table(7, 60)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)] + [(-1, "b", "p", float("nan"), 8, 999), (-2, "b", "q", -0.0, 0, 0), (-3, "b", "q", 0.0, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = proposed(df, SETS, {"x": 25.0, "y": 4.0, "z": 500.0}).distinct().withColumn("pid", F.monotonically_increasing_id()).localCheckpoint()
    counts = {r["pid"]: r["hits"] for r in count_conjunctions(df, wanted, SETS).collect()}
    found = {r["pid"] for r in once_satisfied(df, wanted, SETS).collect()}
    assert found == {pid for pid, hits in counts.items() if hits == 1} and len(found) > 20


def test_few_rows_are_left_to_be_counted(spark):
    """Of 40,000 rows with two numbers next to none can be alone under its bounds."""
    df = spark.range(40_000, numPartitions=4).select(F.rand(1).alias("x"), F.rand(2).alias("y"))
    sets = [ColumnSet((), ("x", "y"))]
    rows = conjunctions._rows(df, sets, 2)
    lowest = conjunctions._lowest(rows, 2)
    assert lowest.count() < 1_000
    asks = lowest.filter("w = 1").select(F.monotonically_increasing_id().alias("pid"), "g", F.col("ys").alias("vs"))
    assert conjunctions._within_reach(rows, asks, 2).count() < 4_000
