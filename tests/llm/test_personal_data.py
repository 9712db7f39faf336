"""Spans that the judge adds: evidence it learns from, forms it finds without it, overlaps against a plain search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabveil.llm import pii_boost


def secret_rows(n=240):
    """Every other text holds a key after a cue word; the rest only long words."""
    draw = random.Random(5)
    rows = []
    for i in range(n):
        key = "".join(draw.choice("0123456789abcdef") for _ in range(40))
        word = "".join(draw.choice("abcdefghijklm") for _ in range(draw.randint(16, 30)))
        rows.append((i, f'see token = "{key}" here' if i % 2 else f"a {word} of 3 parts"))
    return rows


def test_secrets_are_found_with_and_without_cue(spark):
    bare = "f00dfacecafe0123456789abcdef0123456789ab"
    judge = pii_boost.fit(spark.createDataFrame(secret_rows(), "id long, body string"))
    assert list(judge.thresholds) == [pii_boost.ALL_KINDS.index("secret")]
    rows = [*secret_rows(), (9001, f"it was {bare} then"), (9002, "verylongwordofnothing at all"), (9004, "")]
    found = {r["id"]: r for r in pii_boost.with_spans(spark.createDataFrame(rows, "id long, body string"), judge).collect()}
    spans = {i: [(r["body"][s["start"]:s["stop"]], pii_boost.ALL_KINDS[s["kind"]]) for s in r["added"]] for i, r in found.items()}
    assert spans[9001] == [(bare, "secret")]
    assert [spans[i] for i in (9002, 9004)] == [[], []]
    assert [i for i in range(240) if len(spans[i]) != i % 2] == []
    assert all(r["base"] == [] for r in found.values())


@pytest.mark.parametrize("text,kind,wanted", [
    ("GB82 WEST 1234 5698 7654 32", "iban", True), ("GB83 WEST 1234 5698 7654 32", "iban", False), ("DE89370400440532013000", "iban", True),
    ("me [at] host [dot] com", "email", True), ("a(at)b.qqqq", "email", False), ("10 . 0 . 0 . 1", "ip", True), ("10 . 0 . 0 . 999", "ip", False),
    ("4111_1111_1111_1111", "card", True), ("4111_1111_1111_1112", "card", False)])
def test_evidence_of_loose_forms(spark, text, kind, wanted):
    rows = spark.createDataFrame([(f"x {text} y",)], "body string").select(F.expr(pii_boost.candidates(labelled=True)).alias("found")).first()["found"]
    mine = [c for c in rows if c["kind"] == pii_boost.ALL_KINDS.index(kind)]
    assert [c["label"] for c in mine] == [float(wanted)]


def test_apart_against_plain_search(spark):
    draw = random.Random(2)
    spans = lambda n: sorted({(a := draw.randrange(5000), a + draw.randint(1, 40), draw.randrange(3)) for _ in range(n)})
    cases = [(spans(n), spans(m)) for n, m in [(0, 0), (0, 5), (5, 0), (1, 1), (200, 130), (300, 64), (90, 65), (400, 20)]]
    kind = "array<struct<start:int,stop:int,kind:int>>"
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], f"id int, a {kind}, b {kind}")
    found = {r["id"]: [tuple(s) for s in r["kept"]] for r in df.select("id", F.expr(pii_boost.apart("a", "b")).alias("kept")).collect()}
    for i, (a, b) in enumerate(cases):
        assert found[i] == [s for s in a if not any(x[0] < s[1] and s[0] < x[1] for x in b)]


@pytest.mark.parametrize("n", [1, 10, 500, 999, 5000])
def test_the_smallest_by_counting(spark, n):
    places = spark.range(1000).select(F.xxhash64("id").alias("place"))
    kept = places.where(pii_boost.smallest(places, n)).count()
    assert kept <= n and kept >= min(n, 1000) // 2


def test_fit_reads_the_candidates_of_all_documents(spark, monkeypatch):
    """Every document gives its one candidate to the fit or to the thresholds."""
    seen = {}
    keep = pii_boost.materialize
    monkeypatch.setattr(pii_boost, "materialize", lambda df, label: seen.setdefault(label, keep(df, label)))
    docs = spark.range(25_000).select("id", F.lit("token abcdefghijklmnopqrst").alias("body"))
    pii_boost.fit(docs)
    assert seen["candidates"].agg(F.sum("weight")).first()[0] == 25_000
    assert not hasattr(pii_boost, "FIT_ROWS")
