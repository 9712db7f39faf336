from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabveil.functions import scores, text
from tabveil.operators import clean, features, generalize, pii
from tabveil.operators.ordering import dense_codes, order_statistics
from tabveil.roles import require_columns


def values(df, column="x"):
    return [r[column] for r in df.orderBy("i").collect()]


def rows_of(spark, items, kind="string"):
    return spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}")


def test_normalize_trims_all_white_space(spark):
    df = rows_of(spark, ["  são paulo\t\n", "nan", "NaN ", None, "", "null"])
    assert values(clean.normalize_text(df, ["x"])) == ["SÃO PAULO", "NULL", "NULL", "NULL", "", "NULL"]


def test_sentinels_by_type_and_column(spark):
    df = spark.createDataFrame([(-1, "-1", "-3"), (5, "#NE", "ok"), (None, "NÃO DIVULGÁVEL", None)], "a int, b string, c string")
    assert clean.sentinels_to_null(df, ["a", "b"]).collect() == [(None, None, "-3"), (5, None, "ok"), (None, None, None)]
    assert clean.sentinels_to_null(df).first() == (None, None, None)


def test_safe_round(spark):
    df = rows_of(spark, [None, float("nan"), 0.123456], "double")
    assert values(clean.round_scores(df, ["x"])) == [0.0, 0.0, 0.1235]


def test_strict_selection(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        clean.select_available(df, ["id", "gone"], strict=True)
    with pytest.raises(ValueError):
        require_columns(df, ["gone"])


def test_bin_edges(spark):
    df = rows_of(spark, [0.0, 1.0, 1960.0, 1961.0, 1975.0, 1976.0, 2005.0, 2006.0, 2026.0, 2027.0, None], "double")
    got = values(df.select("i", generalize.fixed_bins(F.col("x")).alias("x")))
    assert got == [None, "BOOMER", "BOOMER", "GEN_X", "GEN_X", "MILLENNIAL_FALDA", "GEN_Z", "NEW_GEN", "NEW_GEN", None, None]


def test_birth_year_and_median(spark):
    df = rows_of(spark, ["31/12/1980", "01/02/1990", "1990-02-01", None, "31/02/1990"])
    assert values(generalize.with_birth_year(df, "x", "y", impute=False), "y") == [1980, 1990, None, None, None]
    assert values(generalize.with_birth_year(df, "x", "y"), "y") == [1980.0, 1990.0, 1985.0, 1985.0, 1985.0]
    empty = generalize.with_birth_year(df.filter("i > 2"), "x", "y")
    assert values(empty, "y") == [None, None]


@pytest.mark.parametrize("limit", [2, 3, 50])
def test_top_n_keeps_the_most_frequent(spark, limit):
    items = ["hot"] * 300 + [f"v{i % 40}" for i in range(120)] + ["b", "b", "b", "b", "a", "a", "a", "a"] + [None] * 3
    df = rows_of(spark, items)
    got = Counter(values(generalize.top_n_other(df, {"x": limit})))
    counts = Counter(x for x in items if x is not None)
    kept = {v for v, _ in sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:limit]}
    if len(counts) <= limit:
        assert got == Counter(items)
    else:
        want = Counter(x if x in kept else "OUTROS_GRUPOS" for x in items)
        assert got == want and len(got) <= limit + 1


def test_top_n_by_join_for_long_lists(spark, monkeypatch):
    df = rows_of(spark, [f"v{i % 30}" for i in range(200)] + [None])
    plain = values(generalize.top_n_other(df, {"x": 10}))
    monkeypatch.setattr(generalize, "LITERAL_VALUES", 5)
    assert values(generalize.top_n_other(df, {"x": 10})) == plain


def test_unguarded_top_n_rewrites_nulls(spark):
    df = rows_of(spark, ["a", "b", None])
    assert values(generalize.top_15_other(df, ["x"])) == ["a", "b", "OUTROS"]


def test_wrangling_profiles(spark):
    people = spark.createDataFrame(
        [(i, f"name {i}", f" city {i % 80} ", f"{1 + i % 28:02d}/01/{1950 + i % 60}", f"P{i % 50}") for i in range(400)],
        "SQ_CANDIDATO int, NM_CANDIDATO string, NM_UE string, DT_NASCIMENTO string, SG_PARTIDO string",
    )
    intensive = generalize.apply_wrangling(people, "intensive", keep=["SQ_CANDIDATO"])
    assert intensive.columns == ["SQ_CANDIDATO", "NM_UE", "SG_PARTIDO", "FAIXA_ETARIA"]
    assert intensive.select("SG_PARTIDO").distinct().count() == 31
    assert intensive.select("NM_UE").distinct().count() == 51
    exact = generalize.apply_wrangling(people, "high_fidelity")
    assert exact.select("NM_UE").distinct().count() == 80
    assert "1950" in {r[0] for r in exact.select("FAIXA_ETARIA").distinct().collect()}


def test_order_statistics_with_a_hot_value(spark):
    items = [7.0] * 500 + [float(i) for i in range(1000)] + [None] * 5
    df = rows_of(spark, items, "double").repartition(5)
    ordered = sorted(x for x in items if x is not None)
    fractions = [0.0, 0.001, 0.25, 0.5, 0.75, 1.0]
    import math

    want = [ordered[max(1, math.ceil(f * len(ordered))) - 1] for f in fractions]
    assert order_statistics(df, "x", fractions).first()["cuts"] == want


def test_dense_codes_are_sorted_ranks(spark):
    pairs = [(f, f"v{i:04d}") for f in ("a", "b") for i in range(900 if f == "a" else 3)]
    got = {(r.feature, r.value): r.code for r in dense_codes(spark.createDataFrame(pairs, "feature string, value string")).collect()}
    want = {(f, v): sorted(x for g, x in pairs if g == f).index(v) for f, v in pairs}
    assert got == want


def test_quantile_bins_and_midpoints(spark):
    df = rows_of(spark, [float(i) for i in range(1, 101)] + [None], "double")
    cuts = generalize.quantile_cuts(df, "x", 4)
    assert cuts == [25.0, 50.0, 75.0]
    binned = generalize.quantile_bins(df, "x", 4, "b")
    assert Counter(values(binned, "b")) == {1: 25, 2: 25, 3: 25, 4: 25, None: 1}
    assert values(generalize.with_midpoint(binned, "b", [1.0, *cuts, 100.0], "m"), "m")[0] == 13.0
    assert generalize.quantile_cuts(df, "x", 4, exact=False)[1] in (50.0, 51.0)


def test_labels_and_titles(spark):
    df = rows_of(spark, ["Eleito por média", "NÃO ELEITO", None, "Suplente"])
    assert values(df.select("i", text.contains_flag(F.col("x"), "ELEITO").alias("x"))) == [1, 1, 0, 0]
    assert values(df.select("i", text.contains_flag(F.col("x"), "ELEITO", "NÃO").alias("x"))) == [1, 0, 0, 0]
    names = rows_of(spark, ["Pedro Silva", "Dr. Ana", "irmã Maria", "João", None])
    assert values(names.select("i", text.title_flag(F.col("x")).alias("x"))) == [1, 1, 1, 0, 0]
    assert values(names.select("i", text.title_flag(F.col("x"), whole_word=True).alias("x"))) == [0, 1, 1, 0, 0]


def test_group_size_with_hot_and_null_keys(spark):
    items = ["hot"] * 400 + ["cold"] * 3 + [None] * 200
    sized = features.group_size(rows_of(spark, items), ["x"], "i", "n")
    assert Counter((r.x, r.n) for r in sized.collect()) == {("hot", 400): 400, ("cold", 3): 3, (None, None): 200}


def test_lookup_without_broadcast(spark, monkeypatch):
    from tabveil import session

    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    sized = features.group_size(rows_of(spark, ["a"] * 5 + ["b"]), ["x"], "i", "n")
    assert Counter(r.n for r in sized.collect()) == {5: 5, 1: 1}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = session.lookup(spark.range(3), spark.range(3), ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan


def test_class_weight(spark):
    df = rows_of(spark, [0, 0, 0, 1], "int")
    assert features.class_weight(df, "x").first()["weight"] == 3.0
    assert features.class_weight(df.filter("x = 0"), "x").first()["weight"] == 1.0
    assert values(features.weighted_rows(df, "x"), "weight") == [1.0, 1.0, 1.0, 3.0]


def test_cpf(spark):
    df = rows_of(spark, ["cpf 529.982.247-25.", "52998224725", "111.444.777-36", "card 4111111111111111", None, "none"])
    assert values(df.select("i", pii.matches(F.col("x")).alias("x"))) == [True, True, True, True, False, False]
    digits = df.withColumn("x", pii.cpf_digits(F.col("x")))
    assert values(digits) == ["52998224725", "52998224725", "11144477736", None, None, None]
    assert values(digits.select("i", pii.cpf_checks_out(F.col("x")).alias("x"))) == [True, True, False, None, None, None]


def test_pii_sample_and_threshold(spark):
    df = spark.createDataFrame([(i, "52998224725" if i % 10 == 0 else "x", "ok") for i in range(100)], "i int, a string, b string")
    assert pii.flagged(pii.pii_columns(df)) == []  # 10 % is not more than 10 %
    assert pii.flagged(pii.pii_columns(df, share=0.05)) == ["a"]
    sampled = pii.pii_shares(df, sample_rows=50, row_id="i")
    assert {r["feature"] for r in sampled.collect()} == {"a", "b"}
    assert pii.drop_flagged(df, pii.pii_columns(df, share=0.05)).columns == ["i", "b"]


def test_status_labels(spark):
    df = rows_of(spark, [0.05, 0.051, 0.2, 0.3988, 0.51, None], "double")
    bands = values(df.select("i", scores.risk_band(F.col("x")).alias("x")))
    assert [b and b.split()[1] for b in bands] == ["INSIGNIFICANTE", "MODERADO", "MODERADO", "ALTO", "CRÍTICO", None]
    lights = values(df.select("i", scores.traffic_light(F.col("x")).alias("x")))
    assert [b and b.split()[1] for b in lights] == ["Seguro", "Moderado", "Vulnerabilidade", "Vulnerabilidade", "Vulnerabilidade", None]


def test_kept_values_may_hold_quotes(spark):
    items = ["it's"] * 5 + ["back\\slash"] * 4 + ['say "hi"'] * 3 + ["x", "y"]
    got = Counter(values(generalize.top_n_other(rows_of(spark, items), {"x": 3})))
    assert got == {"it's": 5, "back\\slash": 4, 'say "hi"': 3, "OUTROS_GRUPOS": 2}


def test_top_categories_of_numbers(spark):
    df = spark.createDataFrame([(1, 0.5)] * 3 + [(2, 1.5)] * 2 + [(3, 2.5), (None, None)], "a int, b double")
    rows = generalize.top_n_other(df, {"a": 1, "b": 2}).groupBy("a", "b").count().collect()
    assert {(r["a"], r["b"]): r["count"] for r in rows} == {
        ("1", "0.5"): 3, ("OUTROS_GRUPOS", "1.5"): 2, ("OUTROS_GRUPOS", "OUTROS_GRUPOS"): 2}
