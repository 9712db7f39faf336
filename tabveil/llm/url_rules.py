"""URL filters: a sort-merge range join of urls and nested prefix rules.

A host is reversed by label, so a rule's host becomes a prefix and the hosts it
covers one interval of sorted keys. Urls and rules are dealt into key ranges,
sorted, and swept once with a stack of the rules whose interval is open. The
stack holds one chain of nested hosts, and the longest rule on it whose path
fits decides.

Nulls and texts without ``://`` have an empty host and path and match no rule.
Repeated urls and ids are judged each, null ids too. Control characters in a host
are characters like others. Rules given twice count once; of two equal rules
the blocking one counts. An empty rule table gives the default to all urls, an
empty table of urls an empty result. Further columns of either table are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels are closed by a character that no label holds: within labels it is written otherwise.
LABEL_END = "\x01"
ESCAPE = "\x02"
SAMPLE_PER_RANGE = 32


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each closed: ``a.b.net`` gives ``net|b|a|``; an empty host the empty key."""
    plain = F.replace(F.replace(host, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(LABEL_END), F.lit(ESCAPE + "l"))
    labels = F.reverse(F.split(plain, r"\.", -1))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, LABEL_END), F.lit(LABEL_END)))


def _splits(keys: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Range borders from the urls with the smallest hashes: at most SAMPLE_PER_RANGE per range reach the driver."""
    sample = keys.select("key", "salt").orderBy(F.xxhash64("salt"), "salt", "key").limit(ranges * SAMPLE_PER_RANGE).collect()
    drawn = sorted((r["key"], r["salt"]) for r in sample)
    step = len(drawn) / ranges
    return sorted({drawn[int(i * step)] for i in range(1, ranges)}) if drawn else []


def judge(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url",
          default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Id, host, path, rule and verdict of every url.

    ``rules`` has the columns host, path and verdict (allow or block). Rows are
    dealt by (key, salt), so a host with a third of all urls spreads over many
    ranges; a rule goes to each range that its interval touches.
    """
    spark = urls.sparkSession
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = urls.select(F.col(id_column).alias("id"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    # Binary keys sort the same in Spark and Python.
    keyed = keyed.withColumn("key", host_key(F.col("host"))).withColumn(
        "salt", F.xxhash64(F.col("path"), F.col("id"), F.monotonically_increasing_id()))
    borders = _splits(keyed, ranges)

    def encoded(text: str) -> bytes:
        return text.encode()

    cuts = [(encoded(k), s) for k, s in borders]
    deal = _dealer(cuts)
    schema = (f"part int, key binary, kind int, salt long, id {keyed.schema['id'].dataType.simpleString()}, "
              "host string, path string, verdict string")
    ordered = ["key", "salt", "id", "host", "path"]
    dealt = keyed.select(F.col("key").cast("binary").alias("key"), *ordered[1:]).mapInArrow(deal, schema)
    strict = rules.select(host_key(F.col("host")).cast("binary").alias("key"), F.col("host").alias("host"), F.col("path").alias("path"),
                          F.col("verdict").alias("verdict")).where(F.col("key").isNotNull() & F.col("path").isNotNull())
    strict = strict.groupBy("key", "host", "path").agg(F.max("verdict").alias("verdict"))
    id_type = keyed.schema["id"].dataType
    touched = strict.mapInArrow(_spreader(cuts), "part int, key binary, host string, path string, verdict string").select(
        "part", "key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("salt"), F.lit(None).cast(id_type).alias("id"),
        "host", "path", "verdict")
    events = dealt.unionByName(touched).repartitionById(ranges, F.col("part"))
    swept = events.sortWithinPartitions("part", "key", "kind", "salt").mapInArrow(
        _sweeper(default), f"id {id_type.simpleString()}, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("id", id_column)


def _dealer(cuts: Sequence[tuple[bytes, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, salts = batch.column("key").to_pylist(), batch.column("salt").to_pylist()
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bisect_right(cuts, x) for x in zip(keys, salts)], pa.int32()), batch.column("key"),
                 pa.array([1] * n, pa.int32()), batch.column("salt"), batch.column("id"), batch.column("host"),
                 batch.column("path"), pa.nulls(n, pa.string())],
                names=["part", "key", "kind", "salt", "id", "host", "path", "verdict"])
    return run


def _spreader(cuts: Sequence[tuple[bytes, int]]):
    """Each rule once for every range that its interval [key, key + 0xFF) touches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(part, r["key"], r["host"], r["path"], r["verdict"]) for r in batch.to_pylist()
                   for part in range(bisect_right(cuts, (r["key"], -(2**63))), bisect_right(cuts, (r["key"] + b"\xff", 0)) + 1)]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.binary(), pa.string(), pa.string(), pa.string()])],
                names=["part", "key", "host", "path", "verdict"])
    return run


def _sweeper(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nested hosts, each with its rules by path and the lengths of those paths.
        stack: list[tuple[bytes, str, dict[str, str], set[int]]] = []
        part = None
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in ("part", "key", "kind", "host", "path", "verdict")}
            picked, rules, verdicts = [], [], []
            for i, key in enumerate(rows["key"]):
                if rows["part"][i] != part:
                    part, stack = rows["part"][i], []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if rows["kind"][i] == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, rows["host"][i], {}, set()))
                    stack[-1][2][rows["path"][i]] = rows["verdict"][i]
                    stack[-1][3].add(len(rows["path"][i]))
                    continue
                path = rows["path"][i]
                fits = [(len(h) + n, len(h), h + path[:n], own[path[:n]]) for _, h, own, lengths in stack
                        for n in lengths if n <= len(path) and path[:n] in own]
                picked.append(i)
                best = max(fits) if fits else (0, 0, None, default)
                rules.append(best[2])
                verdicts.append(best[3])
            at = pa.array(picked, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in ("id", "host", "path")] + [pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["id", "host", "path", "rule", "verdict"])
    return run


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "host string, path string, verdict string")
