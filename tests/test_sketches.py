import pytest
from pyspark.sql import functions as F

from tabveil.operators import generalize, sketches
from tabveil.sources.commits import CommittedTable


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(60_000).select(
        (F.col("id") * 7919 % 50_021).alias("many"), (F.col("id") % 30).cast("string").alias("few"), (F.rand(3) * 100).alias("x"),
        F.lit(None).cast("double").alias("none"), (F.col("id") % 3).alias("part")).cache()


def test_merged_parts_equal_the_whole(spark, numbers, tmp_path):
    columns = ["many", "few", "x", "none"]
    store = sketches.SketchStore(CommittedTable(spark, str(tmp_path / "s")))
    for p in range(3):
        assert store.add(numbers.filter(F.col("part") == p), f"part-{p}", columns)
    assert not store.add(numbers, "part-1", columns)
    kept = store.sketches()
    assert kept.count() == 12
    exact = {r["feature"]: r["n_distinct"] for r in generalize.distinct_counts(numbers, columns).collect()}
    found = {r["feature"]: r for r in sketches.distinct_estimates(kept).collect()}
    for c in columns:
        assert abs(found[c]["n_distinct"] - exact.get(c, 0)) <= 0.04 * exact.get(c, 0)
    assert found["few"]["n_distinct"] == 30 and found["few"]["status"].endswith("SEGURO") and found["many"]["status"].endswith("RISCO")
    rows = {r["feature"]: (r["rows"], r["nulls"]) for r in sketches.merged(kept).collect()}
    assert rows["none"] == (60_000, 60_000) and rows["many"] == (60_000, 0)


def test_quantiles_within_their_bound(spark, numbers):
    parts = sketches.sketch(numbers, ["x", "many", "none", "few"], by=["part"])
    fractions = [0.1, 0.5, 0.9]
    cuts = {r["feature"]: r["cuts"] for r in sketches.quantiles(parts, fractions).collect()}
    assert set(cuts) == {"x", "many"}
    for c, values in cuts.items():
        for f, v in zip(fractions, values):
            assert numbers.filter(F.col(c) <= v).count() / 60_000 == pytest.approx(f, abs=0.02)
    by_part = sketches.quantiles(parts, [0.5], by=["part"]).collect()
    assert len(by_part) == 6
    binned = sketches.sketched_bins(numbers, parts, "x", 4, "bin").groupBy("bin").count().collect()
    assert len(binned) == 4 and all(abs(r["count"] - 15_000) < 1_500 for r in binned)
    assert {r["bin"] for r in sketches.sketched_bins(numbers.limit(5), parts, "none", 4, "bin").collect()} == {None}


def test_an_empty_part(spark, numbers):
    empty = sketches.sketch(numbers.limit(0), ["x", "few"])
    both = empty.unionByName(sketches.sketch(numbers, ["x", "few"]))
    assert {r["feature"]: r["n_distinct"] for r in sketches.distinct_estimates(both).collect()}["few"] == 30
    assert sketches.quantiles(empty, [0.5]).collect() == []
