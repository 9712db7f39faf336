import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabveil.functions.scores import excess_risk, privacy_score
from tabveil.operators import encode, predictive, utility


def frame(spark, rows):
    return spark.createDataFrame(rows, "a string, b string")


@pytest.fixture(scope="module")
def tables(spark):
    left = frame(spark, [("x", "1")] * 30 + [("y", "2")] * 10 + [(None, "3")] * 5)
    right = frame(spark, [("x", "2")] * 10 + [("z", "2")] * 10)
    return left, right


def distance(p, q):
    keys = set(p) | set(q)
    tp, tq = sum(p.values()), sum(q.values())
    total = 0.0
    for k in keys:
        x, y = p.get(k, 0) / tp, q.get(k, 0) / tq
        m = (x + y) / 2
        total += sum(v * math.log2(v / m) / 2 for v in (x, y) if v)
    return math.sqrt(total)


def test_jsd_by_hand_and_symmetric(spark, tables):
    left, right = tables
    got = {r["feature"]: r["jsd"] for r in utility.jsd_per_column(left, right).collect()}
    assert got["a"] == pytest.approx(distance({"x": 30, "y": 10}, {"x": 10, "z": 10}))
    assert got["b"] == pytest.approx(distance({"1": 30, "2": 10, "3": 5}, {"2": 20}))
    back = {r["feature"]: r["jsd"] for r in utility.jsd_per_column(right, left).collect()}
    assert back == pytest.approx(got)
    assert all(0 <= v <= 1 for v in got.values())


def test_table_against_itself(spark, tables):
    left, _ = tables
    assert utility.marginal_utility(left, left).first()[0] == 1.0
    assert utility.joint_utility(left, left).first()[0] == 1.0


def test_disjoint_values_and_all_null_column(spark):
    left = frame(spark, [("x", None)] * 3)
    right = frame(spark, [("y", "1")] * 4)
    got = {r["feature"]: r["jsd"] for r in utility.jsd_per_column(left, right).collect()}
    assert got["a"] == pytest.approx(1.0) and got.get("b") is None


def test_joint_sees_what_marginals_do_not(spark):
    left = frame(spark, [("x", "1"), ("y", "2")] * 10)
    right = frame(spark, [("x", "2"), ("y", "1")] * 10)
    assert utility.marginal_utility(left, right).first()[0] == pytest.approx(1.0)
    pairs = utility.jsd_per_pair(left, right).collect()
    assert [(r.column_a, r.column_b) for r in pairs] == [("a", "b")] and pairs[0].jsd == pytest.approx(1.0)


def test_mutual_information_limits(spark):
    rows = [(f"v{i % 4}", f"w{i % 2}", "c") for i in range(400)] + [(None, "w0", "c")] * 40
    df = spark.createDataFrame(rows, "t string, half string, constant string").withColumn("copy", F.col("t"))
    got = {r["feature"]: r for r in utility.mutual_information(df, "t").collect()}
    shares = [100 / 440] * 4 + [40 / 440]
    entropy = -sum(p * math.log(p) for p in shares)
    assert got["copy"]["mi"] == pytest.approx(entropy)
    assert got["copy"]["cardinality"] == 4
    assert got["constant"]["mi"] == pytest.approx(0.0, abs=1e-12)
    assert 0 < got["half"]["mi"] < entropy
    bits = {r["feature"]: r["mi"] for r in utility.mutual_information(df, "t", unit="bits").collect()}
    assert bits["copy"] == pytest.approx(entropy / math.log(2))
    ranked = utility.dp_efficiency(df, "t").collect()
    assert ranked[-1]["feature"] == "constant" and ranked[-1]["dp_efficiency"] == 0.0


def test_tables_equal_counts_repeats(spark):
    a = frame(spark, [("x", "1"), ("x", "1"), (None, "2")])
    b = frame(spark, [(None, "2"), ("x", "1"), ("x", "1")])
    assert utility.tables_equal(a, b).first()[0]
    assert not utility.tables_equal(a, b.distinct()).first()[0]
    assert not utility.tables_equal(a, b.drop("b")).first()[0]


@pytest.mark.parametrize("total,base,gain", [(0.9962, 0.9942, 0.0020), (0.9962, 0.9962, 0.0), (0.9962, 0.9922, 0.0040),
                                             (0.9962, 0.9957, 0.0005)])
def test_recorded_gains(spark, total, base, gain):
    df = spark.createDataFrame([(total, base)], "score_total double, score_wrangling double")
    assert utility.dp_gain(df).first()["dp_gain"] == gain


def test_recorded_retention_and_scores(spark):
    df = spark.createDataFrame([(0.2, None, 0.5), (None, None, None)], "a double, b double, c double")
    got = df.select(privacy_score(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()
    assert [r.s for r in got] == [0.5, 1.0]
    ex = df.select(excess_risk(F.col("c"), F.col("a")).alias("e")).first()["e"]
    assert ex == pytest.approx(0.375)


def test_scores_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0)] * 6 + [(1, 0)] * 2 + [(2, 3)] * 2, "y int, p int")
    got = predictive.prediction_scores(df, "y", "p").first()
    assert got["n"] == 10 and got["accuracy"] == pytest.approx(0.6)
    assert got["weighted_precision"] == pytest.approx(0.6 * 6 / 8)
    assert got["weighted_f1"] == pytest.approx(0.6 * 2 * 0.75 / 1.75)


def test_f1_agrees_with_mllib(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    df = spark.range(500).select(
        (F.col("id") % 3).cast("double").alias("label"), (F.col("id") * 7 % 5 % 3).cast("double").alias("prediction")
    )
    ours = predictive.prediction_scores(df, "label", "prediction").first()["weighted_f1"]
    assert ours == pytest.approx(MulticlassClassificationEvaluator(metricName="f1").evaluate(df))


def test_encoding(spark):
    first = spark.createDataFrame([("b",), ("a",), (None,), ("z",)], "v string")
    second = spark.createDataFrame([("a",), ("new",)], "v string")
    one, two = encode.encode_by_first(first, [second], ["v"])
    assert sorted(r.v for r in one.collect()) == [0, 1, 2, 3]
    assert sorted(r.v for r in two.collect()) == [0, 1]  # NULL < a < b < z; "new" folds into 0
    one, two = encode.encode_union([first, second], ["v"])
    assert Counter(r.v for r in two.collect()) == {1: 1, 3: 1}
