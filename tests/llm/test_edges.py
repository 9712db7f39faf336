"""Rows without ids, repeated ids, odd hosts, missed targets, falling sums: against plain versions."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabveil.llm import catalog, mixing, sentence_spans, suffix_dedup, toxicity, url_rules, warc_zip
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_control_characters_in_hosts(spark):
    hosts = ["x.net", "x.net\x01b", "x.net\x02", "x.net\x02l", "a\x01.net", "a\x02e.b.net", "\x01net", "net\x01", "b.net\x00"]
    rows = [(i % 4 or None, f"http://{h}/de/x") for i, h in enumerate(hosts)]
    rules = [("block", "net", "/"), ("allow", "b.net", "/de/"), ("block", "net\x02l", "/")]
    urls = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, verdict string, host string")
    found = url_rules.judge(urls, url_rules.rule_table(spark, rules)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, found)) == Counter(brute.op3(rows, rules))


def test_archive_rows_without_ids_and_odd_ids(spark):
    rows = [(None, "u", "same"), ("b", "u", "same"), (None, "u", "only"), (None, "u", "only"), ("a b\r\nx: %", "u", "own"), ("%", None, None), ("", "u", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id string, url string, html string, payload string")
    found = Counter((r["record_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_zip.read_packages(spark, warc_zip.store(pages)).collect())
    assert found == Counter([(None, 4, "revisit", "b"), ("b", 4, "response", None), (None, 4, "response", None), (None, 4, "response", None),
                             ("a b\r\nx: %", 3, "response", None), ("%", 0, "revisit", ""), ("", 0, "response", None)])


def plain_sentences(text):
    """(start, end, words) of each sentence, in characters."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    out = []
    for i, (a, b) in enumerate(words):
        if not i or text[words[i - 1][1] - 1] in ".!?" or "\n" in text[words[i - 1][1]:a]:
            out.append([a, b, []])
        out[-1][1] = b
        out[-1][2].append(text[a:b].translate(brute.LOWER))
    return out


def plain_spans(rows, size=2):
    """(id, text, sentences, removed) with documents in the order of their ids."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        found = plain_sentences(text)
        gone, mine = [False] * len(found), set()
        for k in range(len(found) - size + 1):
            run = tuple(w for s in found[k:k + size] for w in s[2])
            if run in seen or run in mine:
                gone[k:k + size] = [True] * size
            mine.add(run)
        seen |= mine
        kept, at = [], 0
        for k, g in enumerate(gone):
            if g:
                kept.append(text[at:found[k][0]])
                at = found[k + 1][0] if k + 1 < len(found) else len(text)
        out.append((i, "".join(kept) + text[at:] if text is not None else None, len(found), sum(gone)))
    return out


def odd_sentences():
    draw = random.Random(5)
    stock = [" ".join(draw.choice("ab cd Éf gh".split()) for _ in range(draw.randrange(1, 5))) + draw.choice(".!?\n") for _ in range(30)]
    rows = [(i, draw.choice([" ", "  ", "\t"]).join(draw.choice(stock) for _ in range(draw.randrange(1, 9)))) for i in range(150)]
    return rows + [(150, None), (151, ""), (152, " \n "), (153, "One."), (154, " ".join(stock) * 200), (155, "Yes. No."), (156, "Yes. No.")]


@pytest.mark.parametrize("where", ["small", "odd"])
def test_sentence_spans_against_plain(spark, where):
    if where == "small":
        rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
        found = catalog.op8_sentence_spans(spark, SMALL)
    else:
        rows = odd_sentences()
        found = sentence_spans.dedup(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, id int"))
    assert Counter(map(tuple, found.select("doc_id", "text", "n_sentences", "n_removed").collect())) == Counter(plain_spans(rows))


def test_sentence_spans_without_ids(spark):
    rows = [(None, "A b. C d."), (None, "A b. C d. E f."), (3, "x. A b. C d."), (3, "Z z. Y y."), (4, None)]
    found = Counter((r["doc_id"], r["n_removed"]) for r in sentence_spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found[(3, 2)] == 1 and found[(3, 0)] == 1 and found[(4, 0)] == 1
    # One of the rows without an id keeps the run.
    assert sorted(n for (i, n), c in found.items() for _ in range(c) if i is None) == [0, 2]


def test_falling_sums_take_linear_time_and_agree():
    draw = np.random.default_rng(4)

    def plain(x):
        """Take the best segment, shortest first, then look left and right of it."""
        if not len(x) or x.max() <= 0:
            return []
        sums = np.concatenate([[0], np.cumsum(x)])
        best = max((sums[b] - sums[a], a - b, -a) for a in range(len(x)) for b in range(a + 1, len(x) + 1))
        a = -best[2]
        b = a - best[1]
        return plain(x[:a]) + [(a, b)] + [(c + b, d + b) for c, d in plain(x[b:])]

    for _ in range(300):
        # Uneven values, so that no two sums are equal.
        x = draw.integers(-5, 5, draw.integers(0, 25)) + draw.random() / 7
        x = x + draw.random(len(x)) / 1000
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(x)]
        wanted = plain(x)
        assert sorted(got) == sorted(wanted), x
    fall = np.tile([1.0, -1.5], 100_000)
    began = time.time()
    assert len(toxicity.maximal_segments(fall)) == 100_000
    assert time.time() - began < 5


def entropies(shares, a):
    w = [p ** a for p in shares]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


@pytest.mark.parametrize("sizes, entropy, limit, outcome", [
    ([900, 60, 30, 10], 0.8, None, "met"), ([900, 60, 30, 10], 0.8, 1.5, "repetition"), ([250, 250, 260, 240], 0.9, None, "met"),
    ([250, 250, 260, 240], 0.2, 2.0, "repetition"), ([250, 250, 250, 250], 0.5, 4.0, "ties"), ([700, 300], 1.0, None, "met"),
    ([500, 300, 200], None, 1.3, "met"), ([5], 0.9, 4.0, "met")])
def test_mixture_meets_its_target_or_says_why(spark, sizes, entropy, limit, outcome):
    rows = [(10_000 * s + i, f"s{s}", "w " * 5) for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed, found = mixing.mix(docs, entropy=entropy, max_epochs=limit, blocks=512)
    shares = [n / sum(sizes) for n in sizes]
    assert found.outcome == outcome
    assert found.entropy == pytest.approx(entropies(shares, found.exponent), abs=1e-6)
    if outcome == "met" and entropy is not None:
        assert found.entropy == pytest.approx(entropy * math.log(len(sizes)), abs=1e-6)
    if limit is not None:
        assert found.max_epochs <= limit * (1 + 1e-6)
    # Every source comes within half a block of its budget.
    tokens = {r["source"]: r["t"] for r in mixed.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    total = 5 * sum(sizes)
    w = [p ** found.exponent for p in shares]
    blocks = defaultdict(Counter)
    for r in docs.select("source", mixing.block_of("doc_id", 1, 512).alias("b")).collect():
        blocks[r["source"]][r["b"]] += 5
    for s, x in enumerate(w):
        slack = max(blocks[f"s{s}"].values())
        assert abs(tokens.get(f"s{s}", 0) - total * x / sum(w)) <= slack
    # A document's passes are epochs 0, 1, ... without a gap.
    passes = mixed.groupBy("doc_id").agg(F.max("epoch").alias("m"), F.count("*").alias("n"), F.countDistinct("epoch").alias("d"))
    assert passes.where("n <> m + 1 OR d <> n").count() == 0


def test_mixture_of_odd_rows(spark):
    rows = [(None, None, "a b"), (None, None, "a b"), (1, "s", None), (2, "t", ""), (3, "s", "c d e " * 20_000), (3, "s", "f")]
    mixed, found = mixing.mix(spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, source string, text string, key int, block int"),
                              entropy=None, max_epochs=1.0)
    assert found.exponent == pytest.approx(1.0, abs=1e-6)
    assert {(r["doc_id"], r["n_tokens"]) for r in mixed.collect()} <= {(None, 2), (3, 60_000), (3, 1)}
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), budget_ratio=3.0, max_epochs=2.0)


def test_shared_and_missing_ids_keep_their_own_bytes(spark):
    draw = random.Random(11)
    fresh = lambda n: "".join(draw.choice("abcdefghij klmnop") for _ in range(n))
    passage, short = fresh(450), fresh(260)
    texts = [(3, fresh(700) + passage), (3, fresh(900)), (None, passage + fresh(50)), (None, fresh(800)), (4, "é" + short + fresh(90)),
             (5, fresh(30) + short), (6, None), (6, ""), (None, None), (7, fresh(420)), (7, None)]
    texts[10] = (7, texts[9][1])  # a repeated row
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in texts], "doc_id long, text string, h string, size int, at int")
    found = suffix_dedup.remove_repeats(docs, also=(200,)).collect()
    plain = {n: [(texts[r[0]][0], *r[1:]) for r in brute.op1([(i, t) for i, (_, t) in enumerate(texts)], n)] for n in (400, 200)}
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), brute.sha(bytes(r["kept"])), r["n_also"][0]) for r in found)
    assert got == Counter((*a, b[2]) for a, b in zip(plain[400], plain[200]))


def test_shorter_repeats_of_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = catalog.op1_suffix_dedup(spark, SMALL).select("doc_id", "n_repeated_200").collect()
    assert Counter(map(tuple, found)) == Counter((r[0], r[2]) for r in brute.op1(rows, 200))


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_groups_of_windows(spark, keep):
    """Quotes in ever different surroundings, settled window by window, agree with the plain version."""
    draw = random.Random(13)
    fresh = lambda n: "".join(draw.choice("abcdefghij klmnop") for _ in range(n))
    passage = fresh(90)
    rows = [(i, fresh(40) + passage[:draw.randrange(60, 91)] + fresh(40)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.remove_repeats(docs, length=48, keep=keep, max_classes=3).collect()
    assert Counter((r["doc_id"], r["n_removed"], brute.sha(bytes(r["kept"]))) for r in found) == Counter(
        (r[0], r[2], r[4]) for r in brute.op1(rows, 48, first=keep == "first"))


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_windows_come_back_as_ranges(spark, keep):
    """Cut, doubled and nested quotes: right bytes, and a few ranges of a text instead of one row for each window."""
    draw = random.Random(17)
    fresh = lambda n: "".join(draw.choice("abcdefghij klmnop") for _ in range(n))
    passage = fresh(150)
    rows = [(i if i % 9 else None, fresh(40) + passage[draw.randrange(0, 30):draw.randrange(110, 151)] + fresh(40)) for i in range(50)]
    rows += [(100 + i, fresh(9) + passage[:100] + fresh(30) + passage[20:] + fresh(20)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix_dedup.remove_repeats(docs, length=48, keep=keep, max_classes=3).collect()
    if keep == "none":
        plain = brute.op1([(i, t) for i, (_, t) in enumerate(rows)], 48)
    else:  # rows without an id go first, in the order of their digests
        hashes = [r[0] for r in docs.sparkSession.createDataFrame([(t,) for _, t in rows], "text string").select(F.xxhash64("text")).collect()]
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, hashes[i]))
        plain = brute.op1([(n, rows[i][1]) for n, i in enumerate(order)], 48, first=True)
    assert Counter((r["n_removed"], brute.sha(bytes(r["kept"]))) for r in found) == Counter((r[2], r[4]) for r in plain)
    key = F.struct(F.col("doc_id").alias("own"), F.xxhash64("text").alias("body_hash"))
    spans = suffix_dedup.repeated_spans(docs.select(key.alias("id"), F.col("text").cast("binary").alias("body")), [(48, 19)], keep, 3)
    assert spans.count() < 16 * len(rows)


@pytest.mark.parametrize("length", [16, 48, 200, 400])
def test_ranks_are_suffix_order(length):
    draw = np.random.default_rng(length)
    data = np.tile(draw.integers(0, 256, 700, dtype=np.uint8), 4)
    data[draw.integers(0, len(data), 9)] = 0
    starts = np.arange(len(data) - length + 1)
    strings = [data[i:i + length].tobytes() for i in starts]
    names = {s: i for i, s in enumerate(sorted(set(strings)))}
    rank = suffix_dedup.capped_ranks(data, starts, length)
    assert rank.tolist() == [names[s] for s in strings]
    previous, following = suffix_dedup.neighbour_factors(rank, length)
    first, last = {s: strings.index(s) for s in names}, {s: i for i, s in enumerate(strings)}
    assert (previous > 0).tolist() == [first[s] < i for i, s in enumerate(strings)]
    assert (following > 0).tolist() == [last[s] > i for i, s in enumerate(strings)]
