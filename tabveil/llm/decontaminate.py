"""Benchmark decontamination with a positional inverted index.

Documents are indexed by term: postings (term, id, position) of the terms that
probe the benchmark. Every window of an item is probed by its rarest terms, by
their counts over all documents; a window with a term that no document has
cannot occur. Posting lists are shifted by the term's place in the item, so
terms of one occurrence meet on one diagonal (item, position minus place), and
a diagonal that has all probes of a window is compared word by word with
the document. Hits are exact phrases; ``proximity`` gives looser ones.

The benchmark is taken in blocks of at most BLOCK_WORDS words, so what tasks
hold of it is bounded; a larger benchmark takes more passes.

Words are maximal runs of ASCII letters and digits and of all other non-ASCII
characters, A-Z lower-cased, compared by 64-bit hashes. Null and empty texts
have no words; items without words are never found. An item shorter than a
window is one window. Items that are given twice count once in the list of
items. Rows that share an id are judged each by its own text. Extra columns
are ignored; without documents or items the result has no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabveil.llm import textbytes as tb
from tabveil.session import materialize

WINDOW = 13
PROBES = 2
BLOCK_WORDS = 1_000_000


@dataclass
class Items:
    """A block of benchmark items: ids as text, word borders, word hashes."""

    ids: list[str]
    edges: np.ndarray
    words: np.ndarray

    @property
    def vocabulary(self) -> np.ndarray:
        return np.unique(self.words)


def _item_words(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    picked = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("body")).where(F.col("item").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tb.slices(batch.column("body")):
                words = tb.words(texts, tb.NO_WORD)
                edge = np.searchsorted(words.row, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").slice(texts.first_row, len(texts)),
                     pa.array([words.hash[a:b].view(np.int64) for a, b in zip(edge[:-1], edge[1:])], pa.list_(pa.int64()))], names=["item", "words"])

    return picked.mapInArrow(run, "item string, words array<long>").where(F.size("words") > 0).dropDuplicates()


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_words`` words, one at a time in the driver."""
    items = materialize(_item_words(benchmark, item_id, text), "items")
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // block_words)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows:
            continue
        lists = rows["words"].combine_chunks()
        yield Items(rows["item"].to_pylist(), np.asarray(lists.offsets).astype(np.int64),
                    np.asarray(lists.values).astype(np.int64).view(np.uint64))


def term_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often all documents use each of the sorted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(terms), np.int64)
        for batch in batches:
            for texts in tb.slices(batch.column("body")):
                found = tb.words(texts, tb.NO_WORD).hash
                at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
                totals += np.bincount(at[terms[at] == found], minlength=len(terms))
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], names=["term", "n"])

    rows = docs.select("body").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(terms), np.int64)
    counts[np.asarray(rows["term"])] = np.asarray(rows["n"])
    return counts


def choose_probes(items: Items, counts: dict[int, int], window: int, probes: int) -> list[tuple[int, int, int, int, int]]:
    """(item, probe, term, place, size of the probe): the rarest terms of each window that can occur.

    Neighbouring windows mostly share their rarest terms, so equal probes of an item are kept once.
    """
    out, seen = [], {}
    for i in range(len(items.ids)):
        words = items.words[items.edges[i]:items.edges[i + 1]].view(np.int64).tolist()
        n = [counts.get(w, 0) for w in words]
        size = min(window, len(words))
        for s in range(len(words) - size + 1):
            places = sorted(range(s, s + size), key=lambda j: (n[j], j))[:probes]
            if n[places[0]] == 0 or (i, tuple(sorted(places))) in seen:
                continue
            probe = seen[(i, tuple(sorted(places)))] = len(seen)
            out += [(i, probe, words[j], j, len(places)) for j in places]
    return out


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The index: (term, id, pos) of the given sorted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tb.slices(batch.column("body")):
                words = tb.words(texts, tb.NO_WORD)
                at = np.minimum(np.searchsorted(terms, words.hash), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == words.hash)
                edge = np.searchsorted(words.row, np.arange(len(texts)))
                rows = words.row[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.hash[hit].view(np.int64)), batch.column("id").take(pa.array(rows + texts.first_row)), pa.array(hit - edge[rows])],
                    names=["term", "id", "pos"])

    return docs.mapInArrow(run, f"term long, id {docs.schema['id'].dataType.simpleString()}, pos long")


def phrase_candidates(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, item, shift): diagonals on which all terms of some probe lie, from shifted and intersected posting lists."""
    shifted = index.join(probes, "term").select("id", "item", "probe", "size", (F.col("pos") - F.col("place")).alias("shift"))
    met = shifted.groupBy("id", "item", "probe", "shift", "size").agg(F.count(F.lit(1)).alias("n"))
    # Rows that share an id may bring a term twice, so more than the probe's size counts too.
    return met.where("n >= size").select("id", "item", "shift").distinct()


def proximity(index: DataFrame, probes: DataFrame, slop: int = 8, min_terms: int = 2) -> DataFrame:
    """(id, item, pos, n_terms): places where ``min_terms`` different probe terms of an item lie within ``slop`` words."""
    near = index.join(probes.select("term", "item").distinct(), "term").distinct()
    within = Window.partitionBy("id", "item").orderBy("pos").rangeBetween(-slop, 0)
    return near.select("id", "item", "pos", F.size(F.collect_set("term").over(within)).alias("n_terms")).where(F.col("n_terms") >= min_terms)


def probe_table(docs: DataFrame, items: Items, window: int = WINDOW, probes: int = PROBES) -> DataFrame | None:
    """The probes of a block as a table (item, probe, term, place, size); none if no window can occur."""
    vocabulary = items.vocabulary
    counts = term_counts(docs, vocabulary)
    chosen = choose_probes(items, dict(zip(vocabulary.view(np.int64).tolist(), counts.tolist())), window, probes)
    return docs.sparkSession.createDataFrame(chosen, "item int, probe int, term long, place int, size int") if chosen else None


def _occurrences(docs: DataFrame, items: Items, window: int, probes: int) -> DataFrame | None:
    table = probe_table(docs, items, window, probes)
    if table is None:
        return None
    terms = np.unique(np.asarray(table.select("term").toArrow()["term"]).astype(np.int64).view(np.uint64))
    index = materialize(postings(docs, terms), "postings")
    # The probes of a block are bounded by BLOCK_WORDS x window x probes rows at the very most.
    return phrase_candidates(index, table)


def _check(items: Items, window: int):
    """Word ranges of a text's words that equal a window on one of the given diagonals."""

    def found(words: np.ndarray, item: int, shift: int) -> np.ndarray:
        own = items.words[items.edges[item]:items.edges[item + 1]]
        low, high = max(0, shift), min(len(words), shift + len(own))
        size = min(window, len(own))
        if high - low < size:
            return np.zeros(0, np.int64)
        same = words[low:high] == own[low - shift:high - shift]
        runs = np.concatenate([[0], np.cumsum(same)])
        return np.flatnonzero(runs[size:] - runs[:-size] == size) + low

    return found


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, probes: int = PROBES, block_words: int = BLOCK_WORDS,
                  keep: list[str] | None = None) -> DataFrame:
    """Id, number of words, of hit words, the items with occurring windows, and the hit word ranges.

    Columns named in ``keep`` come along with each row.
    """
    keep = keep or []
    kept_names = [f"keep_{i}" for i in range(len(keep))]
    docs = documents.select(F.col(id_column).alias("id"), F.col(text).alias("body"))
    picked = documents.select(F.col(id_column).alias("id"), F.col(text).alias("body"), *[F.col(c).alias(k) for c, k in zip(keep, kept_names)])
    kind = docs.schema["id"].dataType.simpleString()
    current = picked.withColumn("items", F.lit(None).cast("array<string>")).withColumn("hits", F.lit(None).cast("array<struct<start:long,end:long>>"))
    base = current.columns

    for items in item_blocks(benchmark, item_id, item_text, block_words):
        candidates = _occurrences(docs, items, window, probes)
        if candidates is None:
            continue
        per_doc = candidates.groupBy("id").agg(F.collect_list(F.struct("item", "shift")).alias("tries"))
        joined = current.alias("d").join(per_doc.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")), "left").select(
            *[F.col(f"d.{c}") for c in base], "tries")
        schema = joined.drop("tries").schema
        current = joined.mapInArrow(_matcher(items, window, base), schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tb.slices(batch.column("body")):
                mine = batch.slice(texts.first_row, len(texts))
                n = tb.words(texts, tb.NO_WORD).counts(len(texts))
                hit, names, spans = [], [], []
                for i in range(len(texts)):
                    names.append(sorted(set(mine.column("items")[i].as_py() or [])))
                    ranges = mine.column("hits")[i].as_py() or []
                    edges = np.zeros(n[i] + 1, np.int64)
                    for r in ranges:
                        edges[r["start"]] += 1
                        edges[r["end"]] -= 1
                    flips = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edges) > 0, [0]]).astype(np.int8)))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in flips.reshape(-1, 2)])
                    hit.append(sum(s["end"] - s["start"] for s in spans[-1]))
                yield pa.RecordBatch.from_arrays(
                    [mine.column("id"), *[mine.column(k) for k in kept_names], pa.array(n.astype(np.int64)), pa.array(hit, pa.int64()),
                     pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["id", *kept_names, "n_words", "n_hit", "items", "hits"])

    kinds = "".join(f", {k} {picked.schema[k].dataType.simpleString()}" for k in kept_names)
    out = current.mapInArrow(count, f"id {kind}{kinds}, n_words long, n_hit long, items array<string>, hits array<struct<start:long,end:long>>")
    return out.withColumnsRenamed({"id": id_column} | dict(zip(kept_names, keep)))


def _matcher(items: Items, window: int, base: list[str]):
    """Adds the block's hits to the columns ``items`` and ``hits``."""
    check = _check(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tries = batch.column("tries")
            names, hits = batch.column("items").to_pylist(), batch.column("hits").to_pylist()
            body = batch.column("body")
            for i in range(batch.num_rows):
                if not tries[i].is_valid:
                    continue
                data, offsets = tb.column_bytes(body.slice(i, 1))
                words = tb.words(tb.Texts(data, offsets, 0), tb.NO_WORD).hash
                for item, shift in zip(tries[i].values.field("item").to_pylist(), tries[i].values.field("shift").to_pylist()):
                    starts = check(words, item, shift)
                    if len(starts):
                        size = min(window, int(items.edges[item + 1] - items.edges[item]))
                        cut = np.flatnonzero(np.diff(starts) > 1)
                        first, last = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]
                        names[i] = (names[i] or []) + [items.ids[item]]
                        hits[i] = (hits[i] or []) + [{"start": int(a), "end": int(b) + size} for a, b in zip(first, last)]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.list_(pa.string())) if c == "items" else pa.array(hits, span) if c == "hits" else batch.column(c) for c in base],
                names=base)

    return run


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least one word in twenty lies in a benchmark window."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever these are called."""
    plain = documents.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(documents.columns)])
    judged = decontaminate(plain.withColumns({"judged_id": F.col(f"own_{documents.columns.index(id_column)}"),
                                              "judged_text": F.col(f"own_{documents.columns.index(text)}")}),
                           benchmark, "judged_id", "judged_text", keep=plain.columns)
    return judged.where(~contaminated()).select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(documents.columns)])
