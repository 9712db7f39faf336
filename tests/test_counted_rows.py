"""Boosted trees on counted rows: few rows reach the fit, and the scores are those of all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabveil.operators import predictive
from tabveil.operators.encode import encode_union
from tabveil.operators.features import weighted_rows
from tabveil.plans import anonymize

FEATURES = ["a", "b"]


def rows(spark, n, shift=0):
    """Twelve kinds of rows with unequal numbers and labels that the kind settles by a majority only."""
    df = spark.range(n).select((F.col("id") + shift).alias("id"))
    cell = F.least(F.pmod(F.xxhash64("id", F.lit("a")), F.lit(5)), F.lit(3))
    return df.select(
        "id", F.when(cell > 0, F.concat(F.lit("v"), cell)).alias("a"), F.pmod(F.xxhash64("id", F.lit("b")), F.lit(3)).alias("b"),
        ((cell + F.pmod(F.xxhash64("id", F.lit("y")), F.lit(4))) > 3).cast("int").alias("y"))


@pytest.fixture
def fitted(monkeypatch):
    """Rows and partitions of every table that goes into a fit or a score."""
    found, real = [], predictive.assemble

    def assemble(*args, **kwargs):
        table = real(*args, **kwargs)
        found.append((table.count(), table.rdd.getNumPartitions()))
        return table

    monkeypatch.setattr(predictive, "assemble", assemble)
    return found


def test_boosted_score_counts_equal_rows(spark, fitted):
    train, test = rows(spark, 600), rows(spark, 300, 10_000)
    got = predictive.train_score(train, test, FEATURES, "y", rounds=3).first()
    assert max(n for n, _ in fitted) <= 24
    codes = [t.select(*FEATURES, "y") for t in (train, test)]
    left, right = (predictive.assemble(t, FEATURES, "y") for t in encode_union(codes, FEATURES))
    want = predictive.score_model(predictive.boosted(3).fit(left), right).first()
    assert got["n"] == 300 and got == pytest.approx(want)


def test_searched_score_counts_equal_rows_of_a_fold(spark, fitted):
    train, test = rows(spark, 600), rows(spark, 300, 10_000)
    got, found = predictive.expert_scores(train, test, FEATURES, "y", rounds=2, depths=(1, 3), rates=(0.1,))
    assert max(n for n, _ in fitted) <= 3 * 24
    left, right = encode_union([train.select(*FEATURES, "y"), test.select(*FEATURES, "y")], FEATURES)
    left, right = predictive.assemble(weighted_rows(left, "y"), FEATURES, "y", ["weight"]), predictive.assemble(right, FEATURES, "y")
    model = predictive.boosted(2, found["maxDepth"], found["stepSize"], weight="weight").fit(left)
    assert got.first() == pytest.approx(predictive.score_model(model, right).first())


def test_retention_counts_rows_of_copies(spark, fitted):
    copies = rows(spark, 400, 50_000).withColumn("epsilon", F.lit(1.0))
    got = anonymize.retention_report(rows(spark, 600), rows(spark, 300, 10_000), copies, [1.0], FEATURES, "y", ["a"], rounds=2).collect()
    assert len(got) == 2 and max(n for n, _ in fitted) <= 24


def test_many_rows_are_dealt_out_for_a_fit(spark, monkeypatch):
    monkeypatch.setattr(predictive, "ROWS_PER_TASK", 20)
    (codes,) = encode_union([rows(spark, 600)], FEATURES)
    assert predictive.assemble(codes, FEATURES, "y").rdd.getNumPartitions() == 30
