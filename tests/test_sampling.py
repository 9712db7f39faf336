import hashlib
from collections import Counter

from pyspark.sql import functions as F

from tabveil.operators import sampling


def ordered(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), i))


def ids(df):
    return {r["id"] for r in df.collect()}


def test_sample_is_exact_and_independent_of_partitions(spark):
    want = set(ordered(range(5000))[:333])
    for partitions in (1, 7):
        assert ids(sampling.sample_exact(spark.range(0, 5000, 1, partitions), 333, "id")) == want
    assert sampling.sample_exact(spark.range(10), 50, "id").count() == 10
    assert sampling.sample_exact(spark.range(10), 0, "id").count() == 0
    assert sampling.sample_exact(spark.range(0), 5, "id").count() == 0


def test_guard(spark):
    df = spark.range(300)
    assert sampling.sample_guard(df, "id", max_rows=300, n=10).count() == 300
    assert sampling.sample_guard(df, "id", max_rows=299, n=10).count() == 10
    assert sampling.sample_guard(df, "id").count() == 300


def test_random_split_is_disjoint_and_complete(spark):
    train, test = sampling.train_test(spark.range(4000), 0.2, "id")
    a, b = ids(train), ids(test)
    assert not a & b and len(a | b) == 4000 and 700 < len(b) < 900


def test_stratified_split_with_hot_and_null_strata(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2000, "hot").when(F.col("id") < 2990, "mid").alias("s"))
    marked = sampling.split_stratified(df, "s", 0.2, "id")
    assert marked.columns == ["id", "s", "is_test"]
    assert Counter(r.s for r in marked.filter("is_test").collect()) == {"hot": 400, "mid": 198, None: 2}
    hot = {r.id for r in marked.filter("is_test and s = 'hot'").collect()}
    assert hot == set(ordered(range(2000))[:400])


def test_disjoint_populations(spark):
    df = spark.range(1500)
    parts = {r.id: r.part for r in sampling.split_disjoint(df, 200, 800, "id").collect()}
    order = ordered(range(1500))
    assert parts == {i: "A" if k < 200 else "B" for k, i in enumerate(order[:1000])}
    assert sampling.split_disjoint(df, 200, None, "id").count() == 1500
    assert Counter(r.part for r in sampling.split_disjoint(df, 0, 10, "id").collect()) == {"B": 10}


def test_repeated_ids_do_not_make_a_sample_larger(spark):
    df = spark.createDataFrame([(7, k) for k in range(5)] + [(8, 0), (None, 1), (None, 2)], "id long, k int")
    for n in range(1, 9):
        rows = [tuple(r) for r in sampling.sample_exact(df, n, "id").collect()]
        assert len(rows) == n and len(set(rows)) == n
    assert sampling.sample_exact(df, 3, "id").collect() == sampling.sample_exact(df.repartition(3), 3, "id").collect()
