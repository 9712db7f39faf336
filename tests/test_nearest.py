"""Neighbour searches against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tabveil.operators import neighbours
from tabveil.operators.mixed import column_ranges, nearest_mixed


def _text_rows(seed, n, columns, values, shift=0):
    rng = random.Random(seed)
    return [(shift + i, *[f"{c}{rng.randrange(values[c % len(values)])}" for c in range(columns)]) for i in range(n)]


def _schema(columns):
    return "id long, " + ", ".join(f"c{i} string" for i in range(columns))


def _expected(targets, rows):
    out = {}
    for _, *t in targets:
        gaps = [(sum(x != y for x, y in zip(t, s)), i) for i, *s in rows]
        out[tuple(t)] = min(gaps)
    return out


@pytest.mark.parametrize("columns,values", [(4, [3]), (9, [2, 5, 30]), (18, [2, 40])])
def test_nearest_by_sets(spark, columns, values):
    """Also more columns than all sets could be keyed for at once."""
    rows, targets = _text_rows(1, 150, columns, values), _text_rows(2, 60, columns, values, 1000)
    if columns == 18:  # near rows with a few changes, so that few levels are walked
        rng = random.Random(9)
        targets = [(i, *[v if rng.random() < 0.9 else "other" for v in rng.choice(rows)[1:]]) for i, *_ in targets]
    names = [f"c{i}" for i in range(columns)]
    found = neighbours.nearest(spark.createDataFrame(targets, _schema(columns)), spark.createDataFrame(rows, _schema(columns)), names, "id")
    assert {tuple(r[c] for c in names): (r["distance"], r["neighbour"]) for r in found.collect()} == _expected(targets, rows)


def test_false_partners_are_found_out(spark):
    """Numbers of few bits stand for many values; the check and new numbers settle it."""
    names = [f"c{i}" for i in range(8)]
    rows, targets = _text_rows(3, 80, 8, [4]), _text_rows(4, 30, 8, [4], 500)
    combos = spark.createDataFrame(rows, _schema(8)).groupBy(*names).agg(F.min("id").alias("neighbour"))
    met = neighbours._by_levels(spark.createDataFrame(targets, _schema(8)).select(*names).distinct(), combos, names, [], bits=20)
    want = {k: v for k, v in _expected(targets, rows).items() if v[0] < 8}
    assert {tuple(r[c] for c in names): (r["distance"], r["neighbour"]) for r in met.collect()} == want


@pytest.mark.parametrize("columns", [3, 8])
def test_nearest_within_a_group(spark, columns):
    names = [f"c{i}" for i in range(columns)]
    rows, targets = _text_rows(5, 90, columns, [3]), _text_rows(6, 20, columns, [3], 500)
    table = spark.createDataFrame([(*r, float(r[0] % 3)) for r in rows], _schema(columns) + ", epsilon double")
    wanted = spark.createDataFrame([(*t, e) for t in targets for e in (0.0, 1.0, 2.0, 7.0)], _schema(columns) + ", epsilon double")
    found = neighbours.nearest(wanted, table, names, "id", by=["epsilon"]).collect()
    got = {(r["epsilon"], tuple(r[c] for c in names)): (r["distance"], r["neighbour"]) for r in found}
    want = {(float(e), k): v for e in range(3) for k, v in _expected(targets, [r for r in rows if r[0] % 3 == e]).items()}
    assert got == want  # nothing for the ε without rows


def _gap(a, b, extent):
    if a is None or b is None:
        return 0.0 if a is b else 1.0
    if extent == 0:
        return 0.0 if a == b else 1.0
    return min(abs(a - b) / extent, 1.0)


@pytest.mark.parametrize("texts,numbers,hot", [(0, 1, False), (2, 1, False), (2, 1, True), (3, 2, True), (1, 3, False)])
def test_mixed_distance(spark, texts, numbers, hot):
    rng = random.Random(texts * 10 + numbers)

    def draw(n, shift):
        rows = []
        for i in range(n):
            t = ["same" if hot and rng.random() < 0.8 else f"v{rng.randrange(4)}" for _ in range(texts)]
            v = [None if rng.random() < 0.05 else float(rng.choice([rng.randrange(1000), rng.randrange(20)])) for _ in range(numbers)]
            rows.append((shift + i, *t, *v))
        return rows

    rows, targets = draw(700, 0), draw(60, 5000)
    t_names, v_names = [f"t{i}" for i in range(texts)], [f"v{i}" for i in range(numbers)]
    schema = "id long, " + ", ".join([f"{c} string" for c in t_names] + [f"{c} double" for c in v_names])
    left, right = spark.createDataFrame(targets, schema), spark.createDataFrame(rows, schema)
    extent = column_ranges([left, right], v_names)
    found = {tuple(r[c] for c in [*t_names, *v_names]): (round(r["distance"], 9), r["neighbour"])
             for r in nearest_mixed(left, right, t_names, v_names, "id").collect()}
    for _, *mine in targets:
        best = min((sum(x != y for x, y in zip(mine[:texts], r[1:1 + texts]))
                    + sum(_gap(mine[texts + k], r[1 + texts + k], extent[c]) for k, c in enumerate(v_names)), r[0]) for r in rows)
        got = found[tuple(mine)]
        assert got[0] == pytest.approx(best[0], abs=1e-9)
        assert got[1] == best[1] or numbers > 1  # sums in another order may part ties of several gaps
    assert len(found) == len({tuple(t[1:]) for t in targets})


def test_mixed_distance_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id long, t string, v double")
    some = spark.createDataFrame([(1, "a", 1.0)], "id long, t string, v double")
    assert nearest_mixed(some, empty, ["t"], ["v"], "id").collect() == []
    assert nearest_mixed(empty, some, ["t"], ["v"], "id").collect() == []


def test_many_columns_broadcast_no_finds(spark):
    """Small files may hold many rows, so what was found level by level meets the targets by sorting."""
    columns = [f"c{i}" for i in range(9)]
    table = spark.range(40).select("id", *[(F.col("id") % (i + 2)).cast("string").alias(c) for i, c in enumerate(columns)])
    plan = neighbours.nearest(table, table, columns, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
