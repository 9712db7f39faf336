"""Substring dedup over runs of consecutive sentences.

Every run of several consecutive sentences is hashed, all runs meet in one
join by hash, and a sentence that lies in any run seen before, in a document
with a smaller id or earlier in its own, is removed. The first copy stays.

A sentence ends behind ``.``, ``!`` or ``?`` before white space, and at a line
feed. Runs are compared by their words with A-Z lower-cased. All runs count,
however short; ``min_words`` is for callers who want to pass over short ones. Null
and empty texts have no sentences and come back as they were. A long text has as
many runs as sentences. Documents are told apart by id and text: rows without an
id come before all others, rows with one id are ordered by a digest of their
texts, and rows equal in both keep the same text. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm import textbytes as tb
from tabveil.session import materialize

SENTENCES = 2
MIN_WORDS = 1
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True


def sentence_runs(texts: tb.Texts, size: int, min_words: int) -> tuple[tb.Pieces, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of a slice; then hash and first sentence of each run, and whether its text had it before."""
    words = tb.words(texts)
    n = len(words)
    if not n:
        none = np.zeros(0, np.int64)
        return tb.Pieces(none, none, none, none.astype(np.uint64)), none.astype(np.uint64), none, none.astype(bool)
    feeds = np.concatenate([[0], np.cumsum(texts.data == 10)])
    fresh = np.ones(n, bool)
    fresh[1:] = (words.row[1:] != words.row[:-1]) | STOPS[texts.data[words.end[:-1] - 1]] | (feeds[words.start[1:]] > feeds[words.end[:-1]])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], n)
    up, down = tb.powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * up[:n])])
    sentences = tb.Pieces(words.start[first], words.end[last - 1], words.row[first], np.zeros(len(first), np.uint64))
    k = len(first) - size + 1
    if k <= 0:
        none = np.zeros(0, np.int64)
        return sentences, none.astype(np.uint64), none, none.astype(bool)
    begin, stop = first[:k], last[size - 1:]
    at = np.flatnonzero((words.row[begin] == words.row[stop - 1]) & (stop - begin >= min_words))
    hashes = tb.mix((sums[stop[at]] - sums[begin[at]]) * down[begin[at]] + (stop - begin)[at].astype(np.uint64))
    _, later = tb.repeats(sentences.row[at], hashes)
    return sentences, hashes, at, later


def run_rows(documents: DataFrame, size: int, min_words: int) -> DataFrame:
    """(run, id): every run of every document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tb.slices(batch.column("body")):
                sentences, hashes, at, later = sentence_runs(texts, size, min_words)
                rows = sentences.row[at][~later] + texts.first_row
                yield pa.RecordBatch.from_arrays([pa.array(hashes[~later].view(np.int64)), batch.column("id").take(pa.array(rows))],
                                                 names=["run", "id"])

    kind = documents.schema["id"].dataType.simpleString()
    return documents.select("id", "body").mapInArrow(run, f"run long, id {kind}")


def dedup(documents: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """Id, text without repeated sentences, number of sentences and of removed ones, and the removed byte ranges.

    The first document of a run comes from a map-side aggregation; only runs in
    several documents are joined back, so a run that a third of the documents
    share is one row on one side and split by adaptive execution on the other.
    """
    # Never null, also where its parts are; ordered by id first.
    key = F.struct(F.col(id_column).alias("own"), F.xxhash64(text).alias("body_hash"))
    picked = documents.select(key.alias("id"), F.col(text).alias("body"))
    runs = run_rows(picked, size, min_words)
    firsts = runs.groupBy("run").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("run", "first")
    # Written first: a join between plain shuffles is one whose hot partitions can be split.
    firsts = materialize(firsts, "firsts")
    later = runs.join(firsts, "run").where(F.col("id") > F.col("first"))
    per_doc = later.groupBy("id").agg(F.collect_set("run").alias("runs"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("runs")
            for texts in tb.slices(batch.column("body")):
                sentences, hashes, at, own = sentence_runs(texts, size, min_words)
                row = sentences.row[at]
                ends = np.searchsorted(row, np.arange(len(texts) + 1))
                drop = own.copy()
                for i in np.flatnonzero(np.diff(ends)):
                    if known[texts.first_row + int(i)].is_valid:
                        wanted = np.asarray(known[texts.first_row + int(i)].values)
                        drop[ends[i]:ends[i + 1]] |= np.isin(hashes[ends[i]:ends[i + 1]], wanted.view(np.uint64))
                gone = tb.covered(at[drop], size, len(sentences))
                out_text, spans = [], []
                edge = np.searchsorted(sentences.row, np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    lo, hi = texts.offsets[i], texts.offsets[i + 1]
                    mine = np.flatnonzero(gone[edge[i]:edge[i + 1]]) + edge[i]
                    keep, where, pieces = lo, [], []
                    for j in mine:
                        pieces.append(texts.data[keep:sentences.start[j]].tobytes())
                        # With the white space behind it, up to the next sentence.
                        keep = sentences.start[j + 1] if j + 1 < edge[i + 1] else hi
                        where.append(f"{sentences.start[j] - lo}:{sentences.end[j] - lo}")
                    pieces.append(texts.data[keep:hi].tobytes())
                    whole = batch.column("body")[texts.first_row + i]
                    out_text.append(b"".join(pieces).decode() if len(mine) else whole.as_py())
                    spans.append(",".join(where))
                n = np.diff(edge)
                counts = np.add.reduceat(np.append(gone, False), np.minimum(edge[:-1], len(gone))) * (n > 0) if len(gone) else n
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(texts.first_row, len(texts)), pa.array(out_text, pa.string()), pa.array(n.astype(np.int64)),
                     pa.array(counts.astype(np.int64)), pa.array(spans, pa.string())],
                    names=["id", "text", "n_sentences", "n_removed", "removed"])

    kind = picked.schema["id"].dataType.simpleString()
    joined = picked.join(per_doc, "id", "left").select("id", "body", "runs")
    found = joined.mapInArrow(clean, f"id {kind}, text string, n_sentences long, n_removed long, removed string")
    return found.select(F.col("id.own").alias(id_column), "text", "n_sentences", "n_removed", "removed")
