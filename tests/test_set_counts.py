import random
from itertools import combinations

from pyspark.sql import functions as F

from tabveil.operators import expand


def test_counts_are_those_of_the_single_rows(spark, monkeypatch):
    monkeypatch.setattr(expand, "ROWS_AT_ONCE", 50)
    monkeypatch.setattr(expand, "DENSE", 40)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, ""]), rng.choice([1, 2, None]), str(rng.randrange(200)), rng.choice("xyz")) for _ in range(400)]
    columns = ["p", "q", "r", "s"]
    df = spark.createDataFrame(rows, "p string, q int, r string, s string").repartition(3)
    sets = [("p",), *combinations(columns, 2), *combinations(columns, 3), tuple(columns)]
    keys = expand.key_columns(sets)
    slow = expand.per_set(df, columns, sets).groupBy(*keys).agg(F.count("*").alias("n"))
    fast = expand.set_counts(df, columns, sets)
    assert sorted(map(repr, fast.collect())) == sorted(map(repr, slow.select(*fast.columns).collect()))
    assert expand.set_counts(df.limit(0), columns, sets).count() == 0


def test_cells_not_rows_leave_the_tasks(spark):
    """Each set of columns makes a row of its cells, not one of every row."""
    df = spark.range(30_000, numPartitions=1).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 2).alias("c"))
    sets = list(combinations(["a", "b", "c"], 2))
    plan = expand.set_counts(df, ["a", "b", "c"], sets)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    assert expand.set_counts(df, ["a", "b", "c"], sets).agg(F.sum("n")).first()[0] == 90_000
