"""Exact Jaccard self-join of shingle sets that skips by set relations.

Texts with equal sets are one set. Sets are ordered by a common token order, and
two sets that are similar enough share a token within a prefix of each. Index
lists of prefix tokens hold (set, size, position).

* Index skipping: a list entry is passed over by sizes and by the position of the
  token in both sets, which bounds the overlap that is still possible; of the
  tokens that a similar pair must share only the first few bring it up.
* Answer skipping: in a first round every set is compared only with the leading
  set of its most shared lists, the one that has the list's token earliest and so
  has the fewest tokens of its own. A set that is linked with a leader takes over the
  leader's component as its answer, and in the second round entries of one
  component are never compared with each other: only lists that hold several
  components are gone through, and there only entries outside of the list's
  largest component meet the others.

The token order puts frequent tokens last. Frequencies come from counts over all
documents and the order only decides speed: any order gives all links. Tokens of
the frequent list go to Spark's joins as rows; lists of the other tokens are
short and are built from packed blocks, where tokens that occur once vanish.

A null or empty text has an empty set, is linked with nothing and is its own
component. Rows with equal ids are joined by their sets like others. A null id
is never the least. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabveil.llm import textbytes as tb
from tabveil.llm.graph import components
from tabveil.session import materialize

SIZE = 5
THRESHOLD = 75  # per cent
FREQUENT = 200_000  # tokens of the order's tail, at most
FREQUENT_FROM = 16
ROUND_ONE = 2  # leaders that a set is compared with in the first round
FIRST_SHARED = 1  # common tokens by which a pair is found in the second round; any number finds all
LAST_SEEN = 6  # list tokens before an entry that it carries; any number finds all
POSTINGS_PER_PART = 2_000_000


def shingle_sets(texts: tb.Texts, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted within rows; a shorter text is one shingle."""
    words = tb.words(texts)
    hashes, at = tb.windows(words, size)
    rows = words.row[at]
    counts = words.counts(len(texts))
    extra = [(hashes, rows)]
    for k in range(1, size):
        if (counts == k).any():
            h, first = tb.windows(words, k)
            mine = counts[words.row[first]] == k
            extra.append((tb.mix(h[mine] + np.uint64(k)), words.row[first[mine]]))
    if len(extra) > 1:
        hashes, rows = (np.concatenate(x) for x in zip(*extra))
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    edges = np.searchsorted(rows, np.arange(len(texts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            hashes[a:b].sort()
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[fresh], hashes[fresh]


def set_keys(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row borders, sizes and two 64-bit keys of each set; equal sets have equal keys."""
    edges = np.searchsorted(rows, np.arange(n + 1))
    sizes = np.diff(edges)
    keys = []
    for salt in (0x632BE59BD9B4E019, 0x9E6C63D0876A9A47):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(hashes ^ np.uint64(salt)))])
        keys.append(tb.mix(sums[edges[1:]] - sums[edges[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return edges, sizes, keys[0], keys[1]


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """Sets (id, n, key, check) and, as rows with a token, local counts of tokens that several sets of a slice have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tb.slices(batch.column("body")):
                n = len(texts)
                rows, hashes = shingle_sets(texts, size)
                _, sizes, key, check = set_keys(rows, hashes, n)
                first = np.zeros(n, bool)
                first[np.unique(key, return_index=True)[1]] = True
                token, count = np.unique(hashes[first[rows]], return_counts=True)
                token, count = token[count > 1], count[count > 1]
                ids, k = batch.column("id").slice(texts.first_row, n), len(token)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes), pa.array(key), pa.array(check), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                    names=["id", "n", "key", "check", "token", "count"])
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(k, ids.type), *[pa.nulls(k, pa.int64())] * 3, pa.array(token.view(np.int64)), pa.array(count.astype(np.int64))],
                    names=["id", "n", "key", "check", "token", "count"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, key long, check long, token long, count long")


def _prefixes(docs: DataFrame, size: int, threshold: int, frequent: np.ndarray, parts: int) -> DataFrame:
    """Prefix entries: packed blocks per part for rare tokens, rows (token, key, n, pos) for frequent ones.

    ``frequent`` has the frequent tokens, the most frequent last.
    """
    order = np.argsort(frequent)
    known = frequent[order]
    top = np.uint64(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tb.slices(batch.column("body")):
                rows, hashes = shingle_sets(texts, size)
                edges, sizes, key, _ = set_keys(rows, hashes, len(texts))
                place = hashes >> np.uint64(1)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    hit = known[at] == hashes
                    place[hit] = top | order[at[hit]].astype(np.uint64)
                for i in np.unique(rows[place >= top]).tolist():
                    place[edges[i]:edges[i + 1]].sort()
                first = np.zeros(len(texts), bool)
                first[np.unique(key, return_index=True)[1]] = True
                length = (sizes - (threshold * sizes + 99) // 100 + 1) * (first & (sizes > 0))
                owner = np.repeat(np.arange(len(texts)), length)
                pos = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                token = place[edges[owner] + pos]
                often = token >= top
                part = ((token >> np.uint64(31)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                low = ((token >> np.uint64(31)) * np.uint64(parts) & np.uint64(0xFFFFFFFF)) ^ (token & np.uint64(0x7FFFFFFF))
                rare = np.flatnonzero(~often)
                rare = rare[np.argsort(part[rare], kind="stable")]
                cut = np.searchsorted(part[rare], np.arange(parts + 1))
                blocks, where = [], np.flatnonzero(np.diff(cut))
                for p in where.tolist():
                    mine = rare[cut[p]:cut[p + 1]]
                    who, count = np.unique(owner[mine], return_counts=True)
                    head = np.array([len(who), len(mine)], np.uint32)
                    blocks.append(b"".join([head.tobytes(), key[who].tobytes(), sizes[who].astype(np.uint32).tobytes(), count.astype(np.uint32).tobytes(),
                                            low[mine].astype(np.uint32).tobytes(), np.minimum(pos[mine], 65535).astype(np.uint16).tobytes()]))
                o, k, m = np.flatnonzero(often), len(blocks), int(often.sum())
                # A frequent token's rows are dealt out by the sets that have it.
                spread = (tb.mix(token[o] ^ key[owner[o]].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
                names = ["part", "block", "token", "key", "n", "pos"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where.astype(np.int32)), pa.array(blocks, pa.binary()), *[pa.nulls(k, pa.int64())] * 4], names=names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spread), pa.nulls(m, pa.binary()), pa.array(token[o].view(np.int64)), pa.array(key[owner[o]]),
                     pa.array(sizes[owner[o]]), pa.array(pos[o])], names=names)

    return docs.mapInArrow(run, "part int, block binary, token long, key long, n long, pos long")


def unpack(block: bytes) -> list[np.ndarray]:
    docs, entries = np.frombuffer(block, np.uint32, 2).tolist()
    out, at = [], 8
    for kind, n in ((np.int64, docs), (np.uint32, docs), (np.uint32, docs), (np.uint32, entries), (np.uint16, entries)):
        out.append(np.frombuffer(block, kind, n, at))
        at += out[-1].nbytes
    key, size, count, token, pos = out
    return [token, np.repeat(key, count), np.repeat(size, count), pos]


def _lists(prefixes: DataFrame, parts: int) -> DataFrame:
    """(token, key, n, pos) of all prefix tokens that several sets may have, each set once per token.

    Rare tokens come whole to one part, where those of a single set vanish; frequent
    ones are spread over all parts by set and pass through.
    """
    names = ["token", "key", "n", "pos"]

    def parted(token, key, n, pos) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(token), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo:lo + 50_000].astype(np.int64)) for c in (token, key, n, pos)], names=names)

    def once(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
        token, key, n, pos = (np.concatenate(x) for x in zip(*columns))
        order = np.lexsort((key, token))
        token, key, n, pos = token[order], key[order], n[order], pos[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        return [c[new] for c in (token, key, n, pos)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, often, part = [], [], 0
        for batch in batches:
            packed = batch.column("block").is_valid().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(packed).tolist():
                part = batch.column("part")[i].as_py()
                rare.append(unpack(batch.column("block")[i].as_buffer()))
            rows = batch.filter(pa.array(~packed))
            if rows.num_rows:
                often.append([np.asarray(rows.column(c)).astype(np.int64) for c in names])
        if often:
            yield from parted(*once(often))
        if rare:
            token, key, n, pos = once(rare)
            again = np.zeros(len(token), bool)
            same = token[1:] == token[:-1]
            again[1:] |= same
            again[:-1] |= same
            # Frequent tokens are negative, so these cannot meet them.
            yield from parted((np.int64(part) << np.int64(32)) + token[again].astype(np.int64), key[again], n[again], pos[again])

    return prefixes.repartitionById(parts, F.col("part")).mapInArrow(run, "token long, key long, n long, pos long")


TOKEN_BYTES = 6  # two different tokens of a pair of sets are equal in these with a chance of 2^-48


def short_tokens(packed) -> np.ndarray:
    """Sorted tokens from their packed leading bytes."""
    table = np.frombuffer(packed, np.uint8).reshape(-1, TOKEN_BYTES)
    wide = np.zeros((len(table), 8), np.uint8)
    wide[:, 2:] = table
    return wide.view(">u8").ravel().astype(np.uint64)


def verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by exact overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (short_tokens(batch.column(c)[i].as_buffer()) for c in ("set_a", "set_b"))
                x, y = (x, y) if len(x) < len(y) else (y, x)
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good[i] = 100 * shared >= threshold * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("set_a"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("set_b"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(run, "a long, b long")


def _sets_of(keys: DataFrame, reps: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(key, tokens) of the given sets, each from one of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tb.slices(batch.column("body")):
                rows, hashes = shingle_sets(texts, size)
                edges, _, key, _ = set_keys(rows, hashes, len(texts))
                leading = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
                # Another row with this id may have another text.
                wanted = np.flatnonzero(key == np.asarray(batch.column("key").slice(texts.first_row, len(texts))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[wanted]), pa.array([leading[edges[i]:edges[i + 1]].tobytes() for i in wanted], pa.binary())], names=["key", "tokens"])

    ids = reps.join(keys, "key").select("id", "key")
    wanted = docs.alias("d").join(ids.alias("i"), F.col("d.id").eqNullSafe(F.col("i.id"))).select("d.body", "i.key")
    return wanted.mapInArrow(run, "key long, tokens binary")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that are links, from the sets of their own keys only."""
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    return verify(pairs, materialize(_sets_of(keys, reps, docs, size), "sets"), threshold)


def _needed(threshold: int) -> Column:
    """How many list tokens two similar sets share.

    Of the two, the set whose prefix ends first shares its prefix tokens in the lists
    or not at all; what else it can share lies behind its prefix.
    """
    return F.ceil((F.col("x_n") + F.col("y_n")) * threshold / (100 + threshold)) - F.ceil(F.greatest("x_n", "y_n") * threshold / 100) + 1


def _may_meet(threshold: int) -> Column:
    """Can two sets with a common token be similar, and is it early enough to be one of their first common ones?

    ``upto`` counts a set's list tokens up to this one and ``after`` those behind it.
    Up to a common token both sets share list tokens only. Behind it that holds for
    the prefix that ends first, and which one does is not known here: the other set
    may share any of its tokens. Where the sets share a list token shortly before this
    one, they were held against each other there, by weaker bounds.
    """
    listed = {s: F.col(f"{s}_after") + F.ceil(F.col(f"{s}_n") * threshold / 100) - 1 for s in "xy"}
    left = {s: F.col(f"{s}_n") - F.col(f"{s}_pos") - 1 for s in "xy"}
    most = F.least("x_upto", "y_upto") + F.greatest(F.least(listed["x"], left["y"]), F.least(listed["y"], left["x"]))
    return (100 * F.least("x_n", "y_n") >= threshold * F.greatest("x_n", "y_n")) \
        & (100 * most >= threshold * (F.col("x_n") + F.col("y_n") - most)) \
        & (F.least("x_after", "y_after") >= _needed(threshold) - FIRST_SHARED) \
        & ~F.arrays_overlap("x_last", "y_last")


LIST_COLUMNS = ("key", "n", "pos", "upto", "after", "label", "last")


def link_sets(docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Profile (id, n, key, check) of all documents (id, body), and (key, label) of linked sets."""
    spark = docs.sparkSession
    profile = materialize(_profile(docs, size), "profile")
    sets = profile.where("token is null and n > 0")
    often = profile.where("token is not null").groupBy("token").agg(F.sum("count").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    # A fixed bound on what the driver holds; other tokens keep the order of their hashes.
    frequent = np.asarray(often.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()["token"]).astype(np.int64).view(np.uint64)[::-1].copy()
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * (100 - threshold) // 100 // POSTINGS_PER_PART + 1)
    lists = materialize(_lists(_prefixes(docs, size, threshold, frequent, parts), parts), "lists")
    reps = materialize(sets.groupBy("key").agg(F.min("id").alias("id")), "reps")

    # Round one: the leading set of a list and size band, for the longest lists of each set.
    banded = lists.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / threshold))))
    leaders = banded.groupBy("token", "band").agg(F.min(F.struct("pos", "key"))["key"].alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    # Written first, as the other sides of list joins: joins between plain shuffles can be split where they are hot.
    leaders = materialize(leaders, "leaders")
    # Only a choice of what to try first: leaders that share at least a twentieth of a set's tokens.
    followed = banded.join(leaders, ["token", "band"]).where(F.col("key") != F.col("leader")).groupBy("key", "leader", "n").agg(
        F.max("members").alias("members"), F.count(F.lit(1)).alias("shared")).where(20 * F.col("shared") >= F.col("n"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("members"), F.desc("shared"), "leader"))
    tried = followed.withColumn("rank", rank).where(F.col("rank") <= ROUND_ONE).select(F.col("leader").alias("a"), F.col("key").alias("b"))
    tried = materialize(tried, "tried")
    links = materialize(_verified(tried, reps, docs, size, threshold), "links")
    labels = components(links)

    # Round two: lists with several components; the largest one's entries do not meet each other.
    marked = lists.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    spread = marked.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("token")
    spread = materialize(spread, "spread")
    # What a set can share with another component lies in these lists or behind its prefix.
    own = Window.partitionBy("key")
    mixed = marked.join(spread, "token").withColumns({
        "upto": F.count(F.lit(1)).over(own.orderBy("pos")),
        "after": F.count(F.lit(1)).over(own) - F.rank().over(own.orderBy("pos")),
        "last": F.collect_list("token").over(own.orderBy("pos").rowsBetween(-LAST_SEEN, -1))})
    mixed = materialize(mixed, "mixed")
    shares = mixed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(
        F.max(F.struct("c", "label"))["label"].alias("major"))
    shares = materialize(shares, "shares")
    flagged = mixed.join(shares, "token")
    minor = flagged.where("label != major").select("token", *[F.col(c).alias(f"x_{c}") for c in LIST_COLUMNS])
    other = flagged.select("token", *[F.col(c).alias(f"y_{c}") for c in LIST_COLUMNS], (F.col("label") == F.col("major")).alias("y_major"))
    meet = minor.join(other, "token").where(
        (F.col("x_label") != F.col("y_label")) & (F.col("y_major") | (F.col("x_key") < F.col("y_key")))
        & _may_meet(threshold))
    # Two sets that share one of the last tokens before this one have met there, or cannot be similar.
    pairs = meet.select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b")).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    late = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    late = materialize(_verified(late, reps, docs, size, threshold), "links")
    return sets.select("id", "n", "key", "check").unionByName(profile.where("token is null and n = 0").select("id", "n", "key", "check")), \
        components(links.unionByName(late))


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """Id, set size and component (the least id reachable by links) of every document."""
    docs = documents.select(F.col(id_column).alias("id"), F.col(text).cast("binary").alias("body"))
    profile, labels = link_sets(docs, size, threshold)
    sets = profile.where("n > 0").groupBy("key", "check", "n").agg(F.min("id").alias("least"))
    joined = sets.join(labels.select(F.col("node").alias("key"), "label"), "key", "left")
    of_label = joined.where("label is not null").groupBy("label").agg(F.min("least").alias("component"))
    named = joined.join(of_label, "label", "left").select("key", "check", "n", F.coalesce("component", "least").alias("component"))
    return profile.join(named, ["key", "check", "n"], "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(documents: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, the one with the least id; rows that share an id stay together."""
    found = near_duplicates(documents, id_column, text, size, threshold)
    dropped = found.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("dropped_id")).distinct()
    return documents.join(dropped, documents[id_column] == dropped["dropped_id"], "left_anti").select(*documents.columns)
