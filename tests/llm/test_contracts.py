"""The operators' queries against the plain versions, on the small tables and on odd rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabveil.llm import catalog, mixing, ngram_join, pii_boost, quality_rules, sentence_spans, suffix_dedup, toxicity, url_rules, warc_zip
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_suffix_dedup": "doc_id,n_bytes,n_removed,n_spans,kept_sha256",
    "op2_decontaminate": "doc_id,n_words,n_hit,n_items,items_sha256,contaminated",
    "op3_url_rules": "page_id,host,path,rule,verdict",
    "op4_pii_boost": "doc_id,n_email,n_ip,n_card,n_phone,base_sha256",
    "op5_ngram_join": "doc_id,n_shingles,component_id",
    "op7_warc_zip": "page_id,payload_bytes,payload_digest,record_type,refers_to",
    "op10_quality_rules": "doc_id,n_words,word_chars,n_symbols,n_dup_lines,n_repeat_words,base_failed",
}
DOC_SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, label string, key string, id string, body string"


def odd_texts() -> list[str | None]:
    draw = random.Random(7)
    words = [f"w{i}é" if i % 9 == 0 else f"word{i}" for i in range(300)]
    passage = " ".join(draw.choice(words) for _ in range(110))
    base = [draw.choice(words) for _ in range(120)]
    near = base.copy()
    near[60] = "changed"
    chain = near.copy()
    chain[10], chain[100] = "other", "more"
    long = " ".join(draw.choice(words) for _ in range(40_000))
    return [None, "", " \t\n", "one", "one", "Two words", " ".join(base), " ".join(near), " ".join(chain), " ".join(base), passage,
            "start " + passage + " end. " + passage, "a" * 1200, "a" * 399, "Ein Satz. " * 60, long, long + " tail",
            "mail a.b@c.example.com or x@y, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111, call +49 30 1234567 now", "\n".join(["same line"] * 9 + ["else"])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of odd rows: nulls, empty and long texts, repeated rows, clashing names."""
    root = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, None if i % 4 == 0 else "s1", None, None, "x", "k", "i", "b") for i, t in enumerate(odd_texts())]
    spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{root}/documents.parquet")
    items = [(1, odd_texts()[10]), (2, "one"), (3, None), (4, ""), (5, "Two words"), (6, " ".join(odd_texts()[6].split()[20:40]))]
    spark.createDataFrame([(i, t, 0, "p") for i, t in items], "item_id long, text string, pos long, part string").write.parquet(f"{root}/benchmark.parquet")
    urls = [None, "", "no host", "http://A.Example.COM/de/x?y", "http://example.com", "https://x.org/fr/", "https://x.org/FR/", "http://example.net/en/a#b",
            "http://badexample.net/", "://net", "http://net/", "http://org/fr/#", "http://example.net/en", "http://a.b.net?x=://c.org/fr/"]
    pages = [(i, u, [None, "", "<p>é</p>", "long " * 9000][i % 4], "h", "p") for i, u in enumerate(urls)]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string, payload string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([(i, i % 3 == 0) for i in range(len(rows))], "doc_id long, flag boolean").select(
        "doc_id", F.col("flag").cast("int").alias("toxic"), F.lit("x").alias("text")).write.parquet(f"{root}/labels.parquet")
    return root


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "pages", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return root


def rows_of(spark, root, name, columns):
    return [tuple(r) for r in spark.read.parquet(f"{root}/{name}.parquet").select(*columns).collect()]


def expected(spark, root, name):
    docs = rows_of(spark, root, "documents", ["doc_id", "text"])
    if name == "op2_decontaminate":
        return brute.op2(docs, rows_of(spark, root, "benchmark", ["item_id", "text"]))
    if name == "op3_url_rules":
        return brute.op3(rows_of(spark, root, "pages", ["page_id", "url"]), catalog.URL_RULES)
    if name == "op7_warc_zip":
        return brute.op7(rows_of(spark, root, "pages", ["page_id", "url", "html"]))
    return getattr(brute, name.split("_")[0])(docs)


@pytest.mark.parametrize("name", list(COLUMNS))
@pytest.mark.parametrize("where", ["small", "odd"])
def test_contract(spark, folder, name, where):
    root = SMALL if where == "small" else folder
    found = catalog.QUERIES[name](spark, root).select(*COLUMNS[name].split(",")).collect()
    assert Counter(map(tuple, found)) == Counter(expected(spark, root, name))


@pytest.mark.parametrize("name", [*catalog.QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    run = corpus_pipeline.run if name == "pipeline" else catalog.QUERIES[name]
    assert run(spark, empty).collect() == []


@pytest.mark.parametrize("name", ["op6_mixing", "op8_sentence_spans", "op9_toxicity", "pipeline"])
def test_odd_rows_do_not_stop(spark, folder, name):
    run = corpus_pipeline.run if name == "pipeline" else catalog.QUERIES[name]
    found = run(spark, folder).collect()
    if name in ("op8_sentence_spans", "op9_toxicity"):
        assert sorted(r["doc_id"] for r in found) == list(range(len(odd_texts())))
    if name == "op9_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)


def test_null_and_repeated_ids(spark):
    """Null ids and repeated rows come back once for each row that went in."""
    docs = spark.createDataFrame([(None, "a b c d e f g"), (None, None), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, None)], "doc_id long, text string")
    for found in (ngram_join.near_duplicates(docs), quality_rules.ledger(docs), pii_boost.find(docs), toxicity.score(docs, toxicity.fit(
            docs, spark.createDataFrame([(3, 1)], "doc_id long, toxic int")))):
        assert Counter(r["doc_id"] for r in found.collect()) == Counter([None, None, 3, 3, 4])
    kept = ngram_join.keep_one(docs).collect()
    assert Counter(r["doc_id"] for r in kept)[4] == 1


def test_chain_of_links_is_one_component(spark):
    """Neighbours in a chain are linked, its ends are not; the chain is one component."""
    words = [f"x{i}" for i in range(400)]
    rows = [(k, " ".join(words[20 * k:20 * k + 200])) for k in range(10)]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, found)) == Counter(brute.op5(rows))
    assert {r["component_id"] for r in found} == {0}


def test_near_copies_in_one_large_group(spark):
    """Many near copies around the threshold, against all pairs."""
    draw = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(240):
        mine = base.copy()
        for at in draw.sample(range(150), draw.choice([1, 2, 3, 4, 5])):
            mine[at] = f"n{draw.randrange(10**9)}"
        rows.append((k, " ".join(mine)))
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, found)) == Counter(brute.op5(rows))


def test_first_copy_can_stay(spark):
    """By previous factors only later copies go."""
    text = " ".join(f"tok{i}" for i in range(120))
    rows = [(1, text), (2, "x " + text), (3, "short")]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep="first").collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == {r[0]: r[2] for r in brute.op1(rows, first=True)}


def test_sentence_runs(spark):
    run = "The first sentence stands here quite alone. The second sentence follows it at once. The third sentence closes this little run."
    rows = [(1, run), (2, "Something else begins this other text. " + run), (3, "The second sentence follows it at once."), (4, None)]
    found = {r["doc_id"]: r for r in sentence_spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["n_removed"] == 0 and found[3]["n_removed"] == 0
    assert found[2]["n_removed"] == 3


def test_ledger_ablation(spark):
    texts = ["few words", "a b c d e f g h " * 20, " ".join(f"w{i}" for i in range(40)), None]
    book = quality_rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    bits = {r["doc_id"]: r["fail_bits"] for r in book.collect()}
    assert bits[0] & 1 and bits[3] & 1 and bits[1] & 2 and bits[2] == 0
    assert quality_rules.ablation(book).count() == len(quality_rules.POLICIES["v1"])
    with pytest.raises(Exception):
        quality_rules.mask_of("no such policy")


def test_mixture_reaches_entropy_and_limit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed, _ = mixing.mix(docs)
    shares = [r["t"] for r in mixed.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()]
    p = np.array(shares) / sum(shares)
    assert -(p * np.log(p)).sum() >= 0.9 * np.log(len(p)) or mixed.agg(F.max("epoch")).first()[0] + 1 >= 4
    assert mixed.agg(F.max("epoch")).first()[0] <= 4


def test_packages_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 70_000), (2, "http://b/", "é"), (3, None, "é"), (4, "http://c/", None)], "page_id long, url string, html string")
    found = {r["record_id"]: r for r in warc_zip.read_packages(spark, warc_zip.store(pages)).collect()}
    assert {str(k) for k in found} == {"1", "2", "3", "4"}
    kinds = {str(k): r["record_type"] for k, r in found.items()}
    assert kinds == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_held_out_accuracy(spark):
    # The 6 toxic rows held out at sf0.01 are too few: there the model calls every text clean.
    root = "/root/testdata/sf0.1"
    found = catalog.op9_toxicity(spark, root).join(spark.read.parquet(f"{root}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out")
    good, n, toxic = found.agg(F.avg((F.col("predicted") == F.col("toxic").cast("int")).cast("int")), F.count("*"), F.avg(F.col("toxic").cast("int"))).first()
    # Better than calling every text clean.
    assert n >= 50 and good > 0.9 and good > 1 - toxic, (good, n, toxic)


def test_no_rules_gives_the_default(spark):
    urls = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string")
    found = url_rules.judge(urls, url_rules.rule_table(spark, []))
    assert {r["verdict"] for r in found.collect()} == {"allow"}


def test_redaction_keeps_clean_texts(spark):
    docs = spark.createDataFrame([(1, "nothing here"), (2, "write to a.b@example.com today"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in pii_boost.redact(docs).collect()}
    assert found == {1: "nothing here", 2: "write to <EMAIL> today", 3: None}
