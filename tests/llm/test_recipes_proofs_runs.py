"""Chunk recipes, Merkle manifest and periodic runs against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabveil.llm import catalog, chunk_recipes, merkle, periodic_runs
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]
COLUMNS = {
    "op11_chunk_recipes": "doc_id,keep_id,group_size,kept,text_sha256",
    "op12_merkle_manifest": "doc_id,leaf,subroot,root,proof_sha256,folded_root,verified",
    "op13_periodic_runs": "doc_id,n_runs,start,length,period,exponent_milli,runs_sha256,collapsed_sha256",
}
SCHEMA = ("doc_id long, source string, lang string, n_chars long, text string, id long, chunk string, tree string, hash string, pos long, "
          "runs string, recipe string, step int")


def odd_rows():
    draw = random.Random(5)
    words = [f"w{i}é" if i % 9 == 0 else f"word{i}y" for i in range(300)]
    long = " ".join(draw.choice(words) for _ in range(30_000))
    texts = [None, "", " ", " \t\n", "one", "one", "one\x0btwo", "one two", " one two", "a " * 40, "a b " * 30 + "c " * 9, "x y z " * 3 + "x y",
             long, long.replace(" ", "\n"), long + " tail", "x" * 5000, "x" * 5001, "é" * 3000, "a b c d " * 5 + "e " + "a b c d " * 5, "d  d\td d d d"]
    # A word with periods inside periods.
    inner = "p p q " * 4
    texts += [inner * 5 + "end", "k l " * 4, "k l " * 3 + "k", "k l " * 4 + "k"]
    rows = [(i, f"s{i % 3}" if i % 5 else None, [None, "", "en", "dé", "z"][i % 5], None if i % 7 == 2 else i, t) for i, t in enumerate(texts)]
    rows += [(None, "s", "en", 1, "one two"), (None, None, None, None, None), (3, "s", "en", 5, "one  two"), rows[7], rows[7], (-4, "s", "en", 2**63 - 1, "z")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("odd-new"))
    spark.createDataFrame([(*r, 1, "c", "t", "h", 2, "r", "p", 3) for r in odd_rows()], SCHEMA).write.parquet(f"{root}/documents.parquet")
    return root


def expected(rows, name):
    return getattr(brute, name.split("_")[0])(rows if name.startswith("op12") else [(r[0], r[4]) for r in rows])


@pytest.mark.parametrize("name", list(COLUMNS))
@pytest.mark.parametrize("where", ["small", "odd"])
def test_contract(spark, folder, name, where):
    root = SMALL if where == "small" else folder
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select(*LEAF).collect()]
    found = catalog.QUERIES[name](spark, root).select(*COLUMNS[name].split(",")).collect()
    assert Counter(map(tuple, found)) == Counter(expected(rows, name))


@pytest.mark.parametrize("name", list(COLUMNS))
def test_empty_tables(spark, folder, tmp_path, name):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    assert found.collect() == [] and set(COLUMNS[name].split(",")) <= set(found.columns)


def test_identifiers_that_collide_are_not_used(spark):
    """Short identifiers stand for several chunks; the dictionary shows it and a wider one is taken."""
    docs = spark.createDataFrame([(i, f"text {i % 40} " + "filling words " * (i % 3)) for i in range(120)], "doc_id long, text string")
    narrow = (lambda c: F.lit(0), lambda c: F.pmod(F.xxhash64(c), F.lit(8)), lambda c: F.length(c), lambda c: c.cast("binary"))
    assert chunk_recipes.verified_identifier(docs, identifiers=narrow) is narrow[-1]
    rows = [tuple(r) for r in docs.collect()]
    found = chunk_recipes.mark(docs, identifiers=narrow).select(*COLUMNS["op11_chunk_recipes"].split(","))
    assert Counter(map(tuple, found.collect())) == Counter(brute.op11(rows))


def test_texts_come_back_from_recipes(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    back = chunk_recipes.restore(chunk_recipes.recipes(docs), chunk_recipes.dictionary(docs))
    rows = docs.select("doc_id", chunk_recipes.normalised().alias("want")).join(back, "doc_id").collect()
    assert len(rows) == docs.count() and all(r["want"] == r["text"] and brute.sha(r["text"]) == r["text_sha256"] for r in rows)


def test_shared_passages_share_chunks(spark):
    """A changed beginning changes the first chunks only."""
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 8))) for _ in range(500)]
    body = " ".join(draw.choice(words) for _ in range(3000))
    docs = spark.createDataFrame([(1, body), (2, "other beginning of it " + body)], "doc_id long, text string")
    a, b = (set(r["recipe"]) for r in chunk_recipes.recipes(docs).collect())
    assert len(a & b) > 0.8 * len(a)


def test_one_group_with_most_rows(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 != 0, F.lit("copy  of all")).otherwise(
        F.concat(F.lit("own "), F.col("id"))).alias("text"))
    found = chunk_recipes.mark(docs).groupBy("group_size").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k"), F.min("keep_id"))
    assert {tuple(r)[:3] for r in found.collect()} == {(4000, 4000, 1), (1, 2000, 2000)}


def test_deep_and_many_trees(spark):
    """A tree of three rounds, many small trees, and trees over trees of two rounds."""
    rows = [(i, "s", None if i % 11 == 0 else f"l{i}" if i % 100 < 12 else "en", i, f"t{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    book = merkle.manifest(docs, LEAF, "lang", "doc_id")
    found = merkle.proofs(spark, book, "doc_id").collect()
    want = {r[0]: r for r in brute.op12(rows)}
    assert len(found) == 3000
    for r in found:
        w = want[r["doc_id"]]
        assert (r["leaf"], r["subroot"], r["root"], brute.sha(bytes(r["proof"]).hex())) == w[1:5] and r["verified"]
    nodes = book.nodes()
    # Every node but the root of a tree has its parent among the rows.
    up = nodes.select(F.coalesce("tree", F.lit("?")).alias("tree"), "level", "pos", "hash")
    linked = nodes.where("parent_level IS NOT NULL").select(F.coalesce("tree", F.lit("?")).alias("tree"), F.col("parent_level").alias("level"),
                                                            F.col("parent_pos").alias("pos"))
    assert linked.join(up, ["tree", "level", "pos"], "left_anti").count() == 0
    assert up.count() == up.select("tree", "level", "pos").distinct().count()


def test_three_rounds_in_one_tree(spark):
    rows = [(i, "s", "en", i, "") for i in range(70_000)]
    docs = spark.range(70_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.col("id").alias("n_chars"),
                                      F.lit("").alias("text"))
    book = merkle.manifest(docs, LEAF, "lang", "doc_id", {"n_chars": F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    assert len(book.rounds) == 3
    found = merkle.proofs(spark, book, "doc_id")
    want = brute.op12(rows)
    assert book.root.hex() == want[0][3]
    assert {(r["doc_id"] % 2 == 1) == r["verified"] for r in found.select("doc_id", "verified").collect()} == {True}
    proofs = {r["doc_id"]: brute.sha(bytes(r["proof"]).hex()) for r in found.select("doc_id", "proof").collect()}
    assert all(proofs[w[0]] == w[4] for w in want)


@pytest.mark.parametrize("seed", range(4))
def test_runs_in_random_words(spark, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(150):
        n = draw.randint(0, 120)
        w = [draw.choice("ab") if draw.random() < 0.9 else "c" for _ in range(n)]
        if n > 10:
            unit = [draw.choice("abc") for _ in range(draw.randint(1, 12))]
            at = draw.randrange(n)
            w[at:at] = unit * draw.randint(3, 7)
        rows.append((1000 * seed + i, " ".join(w)))
    found = periodic_runs.find(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", F.size("runs").alias("n"), F.sha2(periodic_runs.listing(), 256).alias("r"), F.sha2("collapsed", 256).alias("c")).collect()
    want = {}
    for i, text in rows:
        # None as id: nothing is planted.
        want[i] = brute.op13([(None, text)])[0]
    for r in found:
        w = want[r["doc_id"]]
        assert (r["n"], r["r"], r["c"]) == (w[1], w[6], w[7])


def test_a_long_text_of_one_word_is_quick(spark):
    """200,000 equal words: one run, found in sorted passes, not by comparing pairs."""
    docs = spark.createDataFrame([(1, "w " * 200_000), (2, "a b " * 100_000)], "doc_id long, text string")
    found = {r["doc_id"]: r["runs"] for r in periodic_runs.find(docs).collect()}
    assert [tuple(r) for r in found[1]] == [(0, 200_000, 1)] and [tuple(r) for r in found[2]] == [(0, 200_000, 2)]
