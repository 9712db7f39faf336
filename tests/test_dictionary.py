"""Dictionaries of values, made once however many rows the tables have."""

from pyspark.sql import functions as F

from tabveil.operators.encode import dictionary, encode_union


def test_ranks_pass_over_distinct_values_only(spark):
    """No row is placed among the ranges: what ranks the values does not read the tables any more."""
    rows = spark.range(5000).select((F.col("id") % 7).cast("string").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 40).alias("b"))
    codes = dictionary([rows.filter("b < 20 OR b IS NULL"), rows.filter("b >= 20")], ["a", "b"])
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    found = {c: [r["value"] for r in codes.filter(F.col("feature") == c).orderBy("code").collect()] for c in "ab"}
    assert found == {"a": [str(i) for i in range(7)], "b": sorted([*map(str, range(40)), "NULL"])}
    assert [t.agg(F.max("a"), F.max("b"), F.count("*")).first()[:] for t in encode_union([rows], ["a", "b"])] == [(6, 40, 5000)]
