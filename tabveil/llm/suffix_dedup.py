"""Removal of repeated byte strings by longest-previous-factor arrays.

A string of ``length`` bytes is judged by its place in suffix order: the
previous smaller position next to it gives an earlier match, the next one a
later match. ``keep="first"`` removes what has an earlier match, ``keep="none"``
what has any.

Suffixes are not all sorted. Every window of ``length`` bytes has an anchor, the
leftmost of its byte grams with the least hash, which depends on the window's
content only; so equal windows lie in equal anchor groups. Anchors are one in
some hundred bytes, are counted map-side, and only groups that occur again go on.
Members of a group with equal surroundings are settled by counting. Of the
others one context per class is cut out of the texts, and the contexts of whole
groups meet in bounded chunks, where a suffix array capped at ``length`` is
built by doubling. Groups with more than MAX_CLASSES classes (a passage that a
third of all documents quote, each in its own surroundings) are settled window by
window in a map-side aggregation instead, so no group is ever held in one task.
Successive windows that the same texts of a batch share are a run, whose places are
listed once and come back as ranges.

Contexts and hot windows are compared by 64-bit hashes within groups of equal
64-bit anchor hashes, all else byte by byte. Several lengths are judged in one
pass, their anchors in groups of their own; texts move once for all of them.

Null and empty texts have no windows. Rows are told apart by id and a digest of
the text, so rows that share an id, or have none, keep their own spans; rows equal
in both are copies of each other, and with ``keep="first"`` neither is the later
one. Rows without an id come before all others. Very long texts go through in
slices of their own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm import textbytes as tb
from tabveil.session import materialize

LENGTH = 400
GRAM = 160
MAX_CLASSES = 1_000
# Sorting so many bytes stays in a core's cache, and four of their ranks fit in one key.
CHUNK_BYTES = 60_000


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by running minima within blocks."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchor_slice(texts: tb.Texts, length: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of a slice: row, gram hash, context hash, first window and number of further ones."""
    n = len(texts.data)
    sizes = texts.sizes
    good = np.flatnonzero(sizes >= length)
    if not len(good):
        none = np.zeros(0, np.int64)
        return {"row": none, "h": none, "ctx": none, "at": none, "span": none}
    sums = tb.prefix_hash(texts.data)
    start = np.arange(n - gram + 1)
    grams = tb.range_hash(sums, start, start + gram)
    keys = (grams >> np.uint64(32) << np.uint64(32)) | start.astype(np.uint64)
    least = (sliding_least(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edges = np.zeros(n + 1, np.int8)
    edges[texts.offsets[:-1][good]] += 1
    edges[texts.offsets[1:][good] - length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(edges[:n]) > 0)
    anchor = least[windows]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(windows)) - 1
    low, high = windows[first], windows[last]
    row = np.searchsorted(texts.offsets, low, "right") - 1
    return {"row": row, "h": grams[anchor[first]].view(np.int64), "ctx": tb.range_hash(sums, low, high + length).view(np.int64),
            "at": low - texts.offsets[row], "span": high - low}


def find_anchors(documents: DataFrame, lengths: Sequence[tuple[int, int]]) -> DataFrame:
    """(h, ctx, id, at, span, size) of every anchor of every text, for each (length, gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tb.slices(batch.column("body")):
                for length, gram in lengths:
                    found = anchor_slice(texts, length, gram)
                    ids = batch.column("id").take(pa.array(found["row"] + texts.first_row))
                    # Groups of different lengths never meet.
                    h = tb.mix(found["h"].view(np.uint64) ^ np.uint64(length)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array(found["ctx"]), ids, pa.array(found["at"]), pa.array(found["span"]),
                         pa.array(np.full(len(h), length, np.int32))], names=["h", "ctx", "id", "at", "span", "size"])

    return documents.mapInArrow(run, f"h long, ctx long, id {documents.schema['id'].dataType.simpleString()}, at long, span long, size int")


def capped_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the strings of ``length`` bytes at ``starts``; equal strings share one.

    Each round ranks strings of as many times the bytes as ranks fit in a 64-bit key.
    """

    def ranked(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        sorted_keys = keys[order]
        step = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
        rank = np.empty(len(keys), np.uint64)
        rank[order] = step.astype(np.uint64)
        return rank

    n = len(data)
    wide = np.zeros(n + length, np.uint64)
    wide[:n] = data
    size, bits = 1, 8
    while size < length:
        times = min(64 // bits, -(-length // size))
        reach = min(size * times, length)
        # The last part may overlap the one before: strings equal up to there are so in the overlap, too.
        parts = [min(i * size, reach - size) for i in range(times)]
        keys = np.zeros(len(starts) if reach == length else n, np.uint64)
        for part in parts:
            keys = keys << np.uint64(bits) | (wide[starts + part] if reach == length else wide[part:part + n])
        rank = ranked(keys)
        if reach == length:
            return rank
        wide[:n], size, bits = rank, reach, n.bit_length()


def neighbour_factors(rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and next factor of each of the suffixes, given in text order, capped at ``length``.

    Suffixes that agree up to the cap are ordered by position, so the previous
    smaller position of a suffix is its left neighbour in suffix order and the
    nearest larger one its right neighbour. A factor is ``length`` where the
    neighbour has the same capped string, otherwise it is shorter and reported as 0.
    """
    ordered = np.sort(rank << np.uint64(32) | np.arange(len(rank), dtype=np.uint64))
    order = (ordered & np.uint64(0xFFFFFFFF)).astype(np.int64)
    same = ordered[1:] >> np.uint64(32) == ordered[:-1] >> np.uint64(32)
    previous, following = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    previous[order[1:]] = np.where(same, length, 0)
    following[order[:-1]] = np.where(same, length, 0)
    return previous, following


def match_contexts(rows: list[dict], length: int) -> list[tuple[int, int, int, bool]]:
    """(row, first window, last window, with an earlier match) of the repeated windows in a chunk of contexts in text order."""
    data = np.frombuffer(b"".join(r["context"] for r in rows), np.uint8)
    sizes = np.array([len(r["context"]) for r in rows])
    begin = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(rows)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    rank = capped_ranks(data, begin[owner] + inside, length)
    previous, following = neighbour_factors(rank, length)
    found = []
    for flags, earlier in ((previous >= length, True), (following >= length, False)):
        at = np.flatnonzero(flags)
        if not len(at):
            continue
        cut = np.flatnonzero((np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]]))
        first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
        found += [(int(owner[a]), int(inside[a]), int(inside[b]), earlier) for a, b in zip(first, last)]
    return found


def _cut_contexts(reps: DataFrame, documents: DataFrame) -> DataFrame:
    """Contexts of representatives, or the windows of those in hot groups, cut out of the texts.

    Equal windows of a batch of texts become one row, and each run of windows one row
    with the lists of its places, so a passage that very many texts quote is few rows
    before it moves.
    """
    id_kind = documents.schema["id"].dataType.simpleString()
    wanted = reps.groupBy("id").agg(F.collect_list(F.struct("h", "at", "span", "size", "hot")).alias("cuts"))
    joined = documents.join(wanted, "id").select("id", "body", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The table is written before it is read, so a repeated task cannot mix up the numbers of its runs.
        run_no = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("id")
            data, offsets = tb.column_bytes(batch.column("body"))
            rows, out, parts = [], {c: [] for c in ("h", "at", "size", "context")}, []
            for i in range(batch.num_rows):
                text, sums = data[offsets[i]:offsets[i + 1]], None
                for cut in batch.column("cuts")[i].as_py():
                    length = cut["size"]
                    low, high = cut["at"], cut["at"] + cut["span"] + length
                    if not cut["hot"]:
                        rows.append(i)
                        for column, value in zip(out.values(), (cut["h"], low, length, text[low:high].tobytes())):
                            column.append(value)
                        continue
                    sums = tb.prefix_hash(text) if sums is None else sums
                    start = np.arange(low, high - length + 1)
                    windows = tb.range_hash(sums, start, start + length).view(np.int64)
                    parts.append((np.full(len(start), cut["h"]), windows, np.full(len(start), i), start, np.full(len(start), length)))
            yield _filled(
                len(rows), ids.type, h=pa.array(out["h"], pa.int64()), id=ids.take(pa.array(rows, pa.int64())), at=pa.array(out["at"], pa.int64()),
                size=pa.array(out["size"], pa.int32()), context=pa.array(out["context"], pa.binary()))
            if parts:
                windows, runs = _window_rows(ids, run_no, *(np.concatenate(c) for c in zip(*parts)))
                run_no += runs.num_rows
                yield windows
                yield runs

    return joined.mapInArrow(
        run, f"h long, id {id_kind}, at long, size int, context binary, window long, n long, run long, step int, ids array<{id_kind}>, ats array<long>")


def _filled(length: int, id_kind: pa.DataType, /, **columns: pa.Array) -> pa.RecordBatch:
    """So many rows with some of the columns of cut contexts; the others are null."""
    kinds = {"h": pa.int64(), "id": id_kind, "at": pa.int64(), "size": pa.int32(), "context": pa.binary(), "window": pa.int64(), "n": pa.int64(),
             "run": pa.int64(), "step": pa.int32(), "ids": pa.list_(id_kind), "ats": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(length, kind) for c, kind in kinds.items()], names=list(kinds))


def _window_rows(ids: pa.Array, run_no: int, h: np.ndarray, window: np.ndarray, row: np.ndarray, at: np.ndarray,
                 size: np.ndarray) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """One row for each different window, with its first place, run and number in the run; one for each run, with its places.

    A window is followed by another in its run if every place of the one is a byte
    before a place of the other and the other has no more.
    """
    used = np.unique(row)
    by_id = sorted(used.tolist(), key=lambda i: (ids[i]["own"].is_valid, *ids[i].as_py().values()))
    standing = np.empty(len(ids), np.int64)
    standing[by_id] = np.arange(len(by_id))
    order = np.lexsort((at, standing[row], h))
    h, window, row, at, size = h[order], window[order], row[order], at[order], size[order]
    m = len(h)
    order = np.lexsort((window, h))  # stable, so places of a window stay in order
    first = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (window[order][1:] != window[order][:-1])]))
    counts = np.diff(np.append(first, m))
    kind = np.empty(m, np.int64)
    kind[order] = np.repeat(np.arange(len(first)), counts)
    follows = np.full(m, -1)
    follows[:-1] = np.where((h[1:] == h[:-1]) & (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1), kind[1:], -1)
    follows = follows[order]
    after = follows[first]
    linked = (np.minimum.reduceat(follows, first) == np.maximum.reduceat(follows, first)) & (after >= 0) & (counts[after] == counts)
    # In the order of their first places, a window comes right behind the one it follows.
    place = order[first]
    in_text = np.argsort(place)
    opens = np.concatenate([[True], ~linked[in_text[:-1]]])
    run = np.empty(len(first), np.int64)
    run[in_text] = np.cumsum(opens) - 1
    starts = np.flatnonzero(opens)
    step = np.empty(len(first), np.int64)
    step[in_text] = np.arange(len(first)) - starts[run[in_text]]
    windows = _filled(
        len(first), ids.type, h=pa.array(h[place]), id=ids.take(pa.array(row[place])), at=pa.array(at[place]), size=pa.array(size[place], pa.int32()),
        window=pa.array(window[place]), n=pa.array(counts), run=pa.array(run_no + run), step=pa.array(step, pa.int32()))
    heads = in_text[starts]
    edges = np.append(0, np.cumsum(counts[heads]))
    listed = order[np.arange(edges[-1]) - np.repeat(edges[:-1] - first[heads], counts[heads])]
    edges = pa.array(edges, pa.int32())
    runs = _filled(
        len(heads), ids.type, size=pa.array(size[place[heads]], pa.int32()), run=pa.array(run_no + np.arange(len(heads))),
        ids=pa.ListArray.from_arrays(edges, ids.take(pa.array(row[listed]))), ats=pa.ListArray.from_arrays(edges, pa.array(at[listed])))
    return windows, runs


def _places(again: DataFrame) -> DataFrame:
    """(id, low, high, size, earlier): the listed places of runs, as ranges of the windows that repeat.

    Places are in order, so only a run's first can be the first of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps_of = batch.column("steps")
            sizes, edges = np.asarray(batch.column("size")), np.asarray(batch.column("ats").offsets)
            taken, low, high, size, earlier = [], [], [], [], []
            for i in range(batch.num_rows):
                found = steps_of[i].values
                step, leads = np.asarray(found.field("step")), np.asarray(found.field("leads"))
                order = np.argsort(step)
                step, leads = step[order], leads[order]
                apart = np.diff(step) != 1
                ranges = []
                for cuts, places, later in ((apart | (leads[1:] != leads[:-1]), slice(edges[i], edges[i] + 1), ~leads),
                                            (apart, slice(edges[i] + 1, edges[i + 1]), np.ones(len(step), bool))):
                    cut = np.flatnonzero(cuts)
                    a, b = np.concatenate([[0], cut + 1]), np.append(cut, len(step) - 1)
                    ranges.append((places, step[a], step[b], later[a]))
                for places, a, b, later in ranges:
                    at = np.arange(places.start, places.stop)
                    taken.append(np.repeat(at, len(a)))
                    low.append(np.tile(a, len(at))), high.append(np.tile(b, len(at)))
                    size.append(np.full(len(at) * len(a), sizes[i])), earlier.append(np.tile(later, len(at)))
            if not taken:
                continue
            taken, size = np.concatenate(taken), np.concatenate(size)
            ids, ats = batch.column("ids").values.take(pa.array(taken)), np.asarray(batch.column("ats").values)[taken]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(ats + np.concatenate(low)), pa.array(ats + np.concatenate(high) + size), pa.array(size, pa.int32()),
                 pa.array(np.concatenate(earlier))],
                names=["id", "low", "high", "size", "earlier"])

    return again.mapInArrow(run, f"id {again.schema['ids'].dataType.elementType.simpleString()}, low long, high long, size int, earlier boolean")


def _match_groups(contexts: DataFrame) -> DataFrame:
    """(id, low, high, size, earlier): repeated strings in contexts, whole groups of one length per chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def flush():
            length = held[0]["size"]
            held.sort(key=lambda r: (r["id"]["own"] is not None, *r["id"].values(), r["at"]))
            found = match_contexts(held, length)
            return pa.RecordBatch.from_arrays(
                [pa.array([held[f[0]]["id"] for f in found], kind), pa.array([held[f[0]]["at"] + f[1] for f in found], pa.int64()),
                 pa.array([held[f[0]]["at"] + f[2] + length for f in found], pa.int64()),
                 pa.array([length] * len(found), pa.int32()), pa.array([f[3] for f in found], pa.bool_())],
                names=["id", "low", "high", "size", "earlier"])

        for batch in batches:
            kind = batch.column("id").type
            for row in batch.to_pylist():
                if held and row["h"] != last and (size > CHUNK_BYTES or row["size"] != held[0]["size"]):
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row["context"]), row["h"]
        if held:
            yield flush()

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.select("h", "id", "at", "size", "context").repartition(parts, "h").sortWithinPartitions("size", "h")
    return dealt.mapInArrow(run, f"id {contexts.schema['id'].dataType.simpleString()}, low long, high long, size int, earlier boolean")


def repeated_spans(documents: DataFrame, lengths: Sequence[tuple[int, int]] = ((LENGTH, GRAM),), keep: str = "none",
                   max_classes: int = MAX_CLASSES) -> DataFrame:
    """(id, low, high, size): byte ranges to remove from documents (id, body) for each (length, gram); they may overlap."""
    anchors = materialize(find_anchors(documents, lengths), "anchors")
    groups = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("least"), F.max("ctx").alias("most"))
    # Written first: a join between plain shuffles is one whose hot partitions can be split.
    groups = materialize(groups.where("n > 1").select("h", (F.col("least") != F.col("most")).alias("differs")), "groups")
    members = materialize(anchors.join(groups, "h"), "members")
    classes = members.groupBy("h", "ctx", "differs", "size").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at")).alias("first"), F.first("span").alias("span"))
    classes = materialize(classes.select("h", "ctx", "differs", "size", "n", "first.id", "first.at", "span"), "classes")
    mixed = classes.where("differs")
    hot = mixed.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > max_classes).select("h", F.lit(True).alias("hot"))
    reps = mixed.join(hot, "h", "left").select("h", "id", "at", "span", "size", F.coalesce("hot", F.lit(False)).alias("hot"))
    contexts = materialize(_cut_contexts(reps, documents), "contexts")
    matched = _match_groups(contexts.where("context is not null"))
    windows = contexts.where("window is not null")
    known = windows.groupBy("h", "window").agg(F.sum("n").alias("n"), F.min(F.struct("id", "at")).alias("f"))
    known = materialize(known.where("n > 1").select("h", "window", "f"), "known")
    leads = F.struct("id", "at") == F.col("f")
    # One row per run; it has no more windows than a text has bytes.
    steps = windows.join(known, ["h", "window"]).groupBy("run").agg(F.collect_list(F.struct("step", leads.alias("leads"))).alias("steps"))
    again = _places(contexts.where("ids is not null").select("run", "size", "ids", "ats").join(steps, "run").select("ids", "ats", "size", "steps"))
    several = classes.where("n > 1").select("h", "ctx", F.col("id").alias("first"), F.col("at").alias("first_at"))
    # Members of a class of several repeat as a whole; only the first has no earlier copy here.
    whole = members.join(several, ["h", "ctx"]).select(
        "id", F.col("at").alias("low"), (F.col("at") + F.col("span") + F.col("size")).alias("high"), "size",
        (~(F.col("id").eqNullSafe(F.col("first")) & (F.col("at") == F.col("first_at")))).alias("earlier"))
    found = matched.unionByName(again).unionByName(whole)
    if keep == "first":
        found = found.where("earlier")
    elif keep != "none":
        raise ValueError("keep must be first or none")
    return found.select("id", "low", "high", "size")


def remove_repeats(documents: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None,
                   keep: str = "none", max_classes: int = MAX_CLASSES, also: Sequence[int] = ()) -> DataFrame:
    """Id, byte size, bytes and maximal runs removed, remaining bytes, and the removed runs.

    ``also`` names further lengths: ``n_also`` has the bytes that strings of each
    of them would remove, which are not removed.
    """
    if min(length, *also, length) < 16:
        raise ValueError("length must be 16 or more")
    lengths = [(length, gram or max(8, length * GRAM // LENGTH)), *[(n, max(8, n * GRAM // LENGTH)) for n in also if n != length]]
    # Never null, also where its parts are; ordered by id first.
    key = F.struct(F.col(id_column).alias("own"), F.xxhash64(text).alias("body_hash"))
    picked = documents.select(key.alias("id"), F.col(text).cast("binary").alias("body"))
    spans = repeated_spans(picked, lengths, keep, max_classes)
    per_doc = spans.groupBy("id").agg(F.collect_set(F.struct("low", "high", "size")).alias("spans"))
    joined = picked.join(per_doc, "id", "left").select("id", "body", "spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column("body"))
            spans_of = batch.column("spans")
            kept, removed, runs, others = [], [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i]:offsets[i + 1]]
                mine = spans_of[i]
                if not mine.is_valid:
                    kept.append(text.tobytes()), removed.append(0), runs.append([]), others.append([0] * len(also))
                    continue
                low, high, size = (np.asarray(mine.values.field(c)) for c in ("low", "high", "size"))

                def within(wanted: int) -> np.ndarray:
                    edges = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edges, low[size == wanted], 1)
                    np.add.at(edges, high[size == wanted], -1)
                    return np.cumsum(edges[:-1]) > 0

                gone = within(length)
                others.append([int(within(n).sum()) for n in also])
                kept.append(text[~gone].tobytes())
                removed.append(int(gone.sum()))
                flips = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                runs.append([{"start": int(a), "end": int(b)} for a, b in flips.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(others, pa.list_(pa.int64()))],
                names=["id", "n_bytes", "n_removed", "kept", "removed", "n_also"])

    kind = picked.schema["id"].dataType.simpleString()
    found = joined.mapInArrow(
        clean, f"id {kind}, n_bytes long, n_removed long, kept binary, removed array<struct<start:long,end:long>>, n_also array<long>")
    return found.select(F.col("id.own").alias(id_column), "n_bytes", "n_removed", "kept", "removed", "n_also")
