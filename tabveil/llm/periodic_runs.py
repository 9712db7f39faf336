"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart are
the same) that is at least four periods and six words long and cannot be made
longer at either end.

Words get numbers by their bytes. Then every factor of 1, 2, 4, 8 … words gets a
name, the pair of the names of its halves, so equal names mean equal factors. Per
length L each factor's successor is the next place of the same name, wanted where
both lie within 2L words. A run of period q is seen at the length L with
q <= L < 2q: all successors inside it are exactly q away, so the places i, i+q,
i+2q … form an arithmetic progression, and its first places follow one another
without a gap. Each such stretch proposes q as a period and is extended to the
end of its last successor. A stretch stops only where the period does, so the run
is maximal; runs proposed by several lengths are kept once.

Names are made for all texts of a slice of a batch at once and never cross a
text. Memory is bounded by a slice, or by one text where that is longer; work is
n log n sorted numbers per text. Texts stay where they are, nothing is shuffled.

Null texts and texts without words have no runs and collapse to the empty text;
null ids stay null, repeated rows give repeated results, and an empty table an
empty one. Columns of the input other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.llm import textbytes as tb

PERIODS, LEAST_WORDS = 4, 6


def word_values(texts: tb.Texts, words: tb.Pieces) -> pa.Array:
    """The words of a slice as an Arrow array; between two words lies one gap."""
    edges = np.empty(2 * len(words) + 1, np.int32)
    edges[:-1:2], edges[1::2] = words.start, words.end
    edges[-1] = words.end[-1] if len(words) else 0
    both = pa.BinaryArray.from_buffers(pa.binary(), 2 * len(words), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(texts.data))])
    return both.take(pa.array(np.arange(0, 2 * len(words), 2)))


def runs_of(names: np.ndarray, row: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in numbered words; ``row`` rises and
    ``counts`` has the words of each row."""
    found = [np.zeros((0, 3), np.int64)]
    at, length = np.arange(len(names)), 1
    while len(at):
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        i, j = order[:-1], order[1:]
        gap = at[j] - at[i]
        near = same & (gap <= length) & (row[at[i]] == row[at[j]])
        step = np.zeros(len(at), np.int64)
        step[i[near]] = gap[near]
        # Stretches of neighbouring places with the same step.
        new = np.ones(len(at), bool)
        new[1:] = (step[1:] != step[:-1]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        q = step[first]
        words = at[last] - at[first] + length + q
        good = (q > 0) & (words >= np.maximum(PERIODS * q, LEAST_WORDS))
        found.append(np.stack([at[first], words, q], axis=1)[good])
        # Factors of twice the length, where both halves lie in one text and the
        # text has room for four periods of more than ``length`` words.
        here = np.searchsorted(at, at + length)
        ok = (here < len(at)) & (counts[row[at]] > PERIODS * length)
        ok[ok] &= at[here[ok]] == at[ok] + length
        ok[ok] &= row[at[ok]] == row[at[ok] + length]
        dense = np.empty(len(at), np.int64)
        dense[order] = np.concatenate([[0], np.cumsum(~same)])
        names = dense[ok] * len(at) + dense[here[ok]]
        at, length = at[ok], 2 * length
    every = np.unique(np.concatenate(found), axis=0)
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


def echoed(row_first: np.ndarray, counts: np.ndarray, draws: list[int | None]) -> np.ndarray:
    """For each word the word that stands there after planting repetitions.

    A text of n words with a draw g repeats from word a = g mod n on, with period
    1 + floor((n - a) / (3 + g mod 8)).
    """
    order = np.arange(int(counts.sum()))
    for first, n, g in zip(row_first, counts, draws):
        if g is not None and n:
            a = g % int(n)
            p = 1 + (int(n) - a) // (3 + g % 8)
            order[first + a:first + n] = first + a + np.arange(int(n) - a) % p
    return order


def run_slice(texts: tb.Texts, draws: list[int | None]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Runs and collapsed texts of a slice, and its texts' numbers of words."""
    words = tb.words(texts, lower=False)
    rows = len(texts)
    counts = words.counts(rows)
    starts = np.concatenate([[0], np.cumsum(counts)])
    values = word_values(texts, words)
    if any(g is not None for g in draws):
        values = values.take(pa.array(echoed(starts[:-1], counts, draws)))
    names = np.asarray(values.dictionary_encode().indices).astype(np.int64)
    start, length, period = runs_of(names, words.row, counts)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = np.cumsum(edges[:-1]) == 0
    row = words.row[start]
    spans = pa.StructArray.from_arrays(
        [pa.array(start - starts[row]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    listed = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), spans)
    left = np.concatenate([[0], np.cumsum(np.bincount(words.row[kept], minlength=rows))]).astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), values.filter(pa.array(kept))), b" ")
    return listed, collapsed.cast(pa.string()), counts


def find(documents: DataFrame, id_column: str = "doc_id", text: str = "text", echo: Column | None = None) -> DataFrame:
    """One row per document: id, n_words, ``runs`` (start, length, period by start,
    then period) and ``collapsed``, the words joined by one space, without those
    that any run holds after its first period.

    ``echo`` plants repetitions first, as ``echoed`` states, where it is not null;
    a test of detection on texts whose runs are known.
    """
    planted = F.lit(None) if echo is None else echo
    picked = documents.select(F.col(f"`{id_column}`").alias("id"), planted.cast("long").alias("echo"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = batch.column("echo").to_pylist()
            for texts in tb.slices(batch.column("text")):
                stop = texts.first_row + len(texts)
                listed, collapsed, counts = run_slice(texts, draws[texts.first_row:stop])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(texts.first_row, len(texts)), pa.array(counts.astype(np.int64)), listed, collapsed],
                    names=["id", "n_words", "runs", "collapsed"])

    kind = picked.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length / period, compared as exact fractions;
    ties go to the smaller start, then period. Null without runs."""
    return F.expr(
        f"aggregate({runs}, cast(null AS struct<start:bigint,length:bigint,period:bigint>), "
        "(best, r) -> CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)")


def listing(runs: str = "runs") -> Column:
    """Every run as ``start,length,period`` and a line feed, in order."""
    return F.expr(f"array_join(transform({runs}, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
