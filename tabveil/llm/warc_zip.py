"""WARC records inside ZIP packages, written and read by ranges.

A package holds one WARC file of separately compressed records and one index
of them, both *stored*, so every record is a byte range of the package itself.
The reader finds the end-of-central-directory record (and its ZIP64 form),
lists the members, reads the index member and then fetches single records by
range; nothing is extracted. Large packages are read by many tasks.

Payload nulls and empty payloads are records with an empty block; a long one is a
record like others. Repeated rows give repeated records; rows that share the
smallest id of their payload are responses each. Ids may hold any character. Rows
without an id revisit the smallest id with their payload, and are responses where
none has one. Further columns are ignored. An empty table gives no package and no row.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.session import materialize, scratch_path

# Fixed values of the formats.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
ZIP64_EXTRA, MAX32, MAX16 = 1, 0xFFFFFFFF, 0xFFFF
RECORD_ID = "urn:page:"
PACKAGE_BYTES = 256 << 20
RUN_BYTES = 4 << 20


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, for tasks and driver alike."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


@dataclass(frozen=True)
class Member:
    """A member of a package: name, method, and where its bytes lie."""

    name: str
    method: int
    size: int
    packed: int
    header: int
    crc: int


class PackageWriter:
    """Appends stored members one after another; sizes are filled in by ZIP64 directories."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.members, self.begun = sink, 0, [], None

    def write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> int:
        # Bit 3: sizes and checksum follow the data, as they are not known yet.
        extra = struct.pack("<HHQQ", ZIP64_EXTRA, 16, 0, 0)
        self.begun = [name, self.at, 0, 0]
        raw = name.encode()
        self.write(struct.pack("<4s5HIIIHH", LOCAL, 45, 8 | 0x800, 0, 0, 0x21, 0, MAX32, MAX32, len(raw), len(extra)) + raw + extra)
        return self.at

    def put(self, data: bytes) -> None:
        self.begun[2] = zlib.crc32(data, self.begun[2])
        self.begun[3] += len(data)
        self.write(data)

    def finish_member(self) -> None:
        name, header, crc, size = self.begun
        self.write(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))
        self.members.append(Member(name, 0, size, size, header, crc))

    def close(self) -> None:
        begin = self.at
        for m in self.members:
            raw, extra = m.name.encode(), struct.pack("<HHQQQ", ZIP64_EXTRA, 24, m.size, m.packed, m.header)
            self.write(struct.pack("<4s6HIIIHHHHHII", CENTRAL, 45, 45, 8 | 0x800, 0, 0, 0x21, m.crc, MAX32, MAX32, len(raw), len(extra),
                                   0, 0, 0, 0, MAX32) + raw + extra)
        size, end64 = self.at - begin, self.at
        n = len(self.members)
        self.write(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, begin))
        self.write(struct.pack("<4sIQI", LOCATOR64, 0, end64, 1))
        self.write(struct.pack("<4sHHHHIIH", END, 0, 0, MAX16, MAX16, MAX32, MAX32, 0))


def read_range(source, offset: int, size: int) -> bytes:
    source.seek(offset)
    data = source.read(size)
    if len(data) != size:
        raise ValueError(f"{size} bytes wanted at {offset}, {len(data)} found")
    return data


def directory(source, total: int) -> list[Member]:
    """The members of a package, from its central directory, plain or ZIP64."""
    tail_at = max(0, total - 22 - MAX16)
    tail = read_range(source, tail_at, total - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, begin = struct.unpack_from("<HII", tail, at + 10)
    if count == MAX16 or size == MAX32 or begin == MAX32:
        locator = read_range(source, tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = read_range(source, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, size, begin = struct.unpack_from("<QQQ", end64, 32)
    raw, pos, members = read_range(source, begin, size), 0, []
    for _ in range(count):
        if raw[pos:pos + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, crc = struct.unpack_from("<H", raw, pos + 10)[0], struct.unpack_from("<I", raw, pos + 16)[0]
        packed, unpacked, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, pos + 20)
        header = struct.unpack_from("<I", raw, pos + 42)[0]
        name = raw[pos + 46:pos + 46 + n_name].decode()
        extra, e = raw[pos + 46 + n_name:pos + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, length = struct.unpack_from("<HH", extra, e)
            if tag == ZIP64_EXTRA:
                # Only the fields that did not fit are present, in this order.
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                unpacked = next(wide) if unpacked == MAX32 else unpacked
                packed = next(wide) if packed == MAX32 else packed
                header = next(wide) if header == MAX32 else header
            e += 4 + length
        members.append(Member(name, method, unpacked, packed, header, crc))
        pos += 46 + n_name + n_extra + n_note
    return members


def data_offset(source, member: Member) -> int:
    """Where a member's bytes begin: behind its local header, whose lengths are its own."""
    head = read_range(source, member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


NO_ID = "%"  # no quoted text is this


def id_text(page_id) -> str:
    """An id as it stands in headers and indexes: quoted, so it has no space or line break."""
    return NO_ID if page_id is None else quote(str(page_id), safe="")


def id_back(stated: str | None) -> str | None:
    """The id behind ``id_text``; none for a missing header and for a row without one."""
    quoted = None if stated is None else stated.strip("<>").removeprefix(RECORD_ID)
    return None if quoted in (None, NO_ID) else unquote(quoted)


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record: a response, or a revisit that names the record with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join((url or "").split()) or "urn:none"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_ID}{id_text(page_id)}>",
            f"WARC-Target-URI: {target}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD_ID}{id_text(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_fields(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse_record(raw: bytes) -> dict:
    """Fields and payload of a record; a response's digest is checked against its payload."""
    cut = raw.index(b"\r\n\r\n")
    head = parse_fields(raw[:cut])
    block = raw[cut + 4:cut + 4 + int(head["content-length"])]
    http_end = block.index(b"\r\n\r\n")
    http = parse_fields(block[:http_end])
    stated = head["warc-payload-digest"].removeprefix("sha1:")
    response, payload = head["warc-type"] == "response", block[http_end + 4:]
    if response and (digest_of(payload) != stated or len(payload) != int(http["content-length"])):
        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    return {"record_id": id_back(head["warc-record-id"]), "record_type": head["warc-type"], "payload_digest": stated,
            "payload_bytes": int(http["content-length"]), "refers_to": id_back(head.get("warc-refers-to")),
            "url": head["warc-target-uri"], "payload": payload if response else None}


def mark_revisits(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload: str = "html",
                  min_bytes: int = 0) -> DataFrame:
    """Id, url, payload and the id of the first record with the same payload, where that is another.

    A row without an id revisits the smallest id that has its payload; where none
    has one, and for rows that share the smallest id, each is a response.

    The smallest id per payload comes from a map-side aggregation of digests; the
    join back moves ids and digests only, so a payload with a third of all rows
    is split by adaptive execution.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    firsts = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    # Written first: a join between plain shuffles is one whose hot partitions can be split.
    firsts = materialize(firsts, "firsts")
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(other, F.col("first"))).select("id", "url", "payload", "refers_to")


def write_packages(marked: DataFrame, folder: str) -> DataFrame:
    """Write packages below ``folder``; one row (path, records) for each.

    A task writes under a name of its own attempt and lists what it finished, so
    a retried task leaves at most an unlisted file.
    """
    id_type = marked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        package, index, name, n = None, [], "", 0

        def finish():
            package.finish_member()
            package.begin("indexes/index.cdx")
            package.put("".join(index).encode())
            package.finish_member()
            package.close()
            package.sink.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "records"])

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, refers = (batch.column(c)[row].as_py() for c in ("id", "url", "payload", "refers_to"))
                if package is None:
                    name, index, n = f"{folder}/{uuid.uuid4().hex}.wacz", [], 0
                    package = PackageWriter(fs.open_output_stream(f"{base}/{os.path.basename(name)}"))
                    begun = package.begin("archive/data.warc.gz")
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = squeeze.compress(record(page, url, payload, refers)) + squeeze.flush()
                index.append(f"{id_text(page)} {package.at - begun} {len(packed)}\n")
                package.put(packed)
                n += 1
                if package.at > PACKAGE_BYTES:
                    yield finish()
                    package = None
        if package is not None:
            yield finish()

    return marked.select("id", "url", "payload", F.col("refers_to").cast(id_type)).mapInArrow(run, "path string, records long")


def list_ranges(paths: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Runs of neighbouring records (path, offset, lengths) from the indexes of packages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inner = open_store(path)
                found = []
                with fs.open_input_file(inner) as source:
                    members = {m.name: m for m in directory(source, source.size())}
                    archive, index = members["archive/data.warc.gz"], members["indexes/index.cdx"]
                    if archive.method or index.method:
                        raise ValueError(f"{path}: members must be stored")
                    begun = data_offset(source, archive)
                    text = read_range(source, data_offset(source, index), index.size).decode()
                start, size, lengths = 0, 0, []
                for line in text.splitlines():
                    _, offset, length = line.rsplit(" ", 2)
                    if lengths and size + int(length) > run_bytes:
                        found.append((path, begun + start, lengths))
                        start, size, lengths = int(offset), 0, []
                    start = start if lengths else int(offset)
                    size += int(length)
                    lengths.append(int(length))
                if lengths:
                    found.append((path, begun + start, lengths))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()),
                     pa.array([f[2] for f in found], pa.list_(pa.int64()))], names=["path", "offset", "lengths"])

    return paths.select("path").mapInArrow(run, "path string, offset long, lengths array<long>")


def read_records(ranges: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the given runs, each fetched by one range read."""
    fields = {"record_id": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(),
              "refers_to": pa.string(), "url": pa.string()} | ({"payload": pa.binary()} if with_payload else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, inner = open_store(row["path"])
                with fs.open_input_file(inner) as source:
                    raw, at, parsed = read_range(source, row["offset"], sum(row["lengths"])), 0, []
                for length in row["lengths"]:
                    parsed.append(parse_record(zlib.decompress(raw[at:at + length], 31)))
                    at += length
                yield pa.RecordBatch.from_arrays([pa.array([p[f] for p in parsed], t) for f, t in fields.items()], names=list(fields))

    spark_types = {f: {pa.int64(): "long", pa.binary(): "binary"}.get(t, "string") for f, t in fields.items()}
    return ranges.mapInArrow(run, ", ".join(f"{f} {t}" for f, t in spark_types.items()))


def store(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload: str = "html", min_bytes: int = 0,
          folder: str | None = None) -> DataFrame:
    """Write all pages as packages; returns their paths, kept as a table in the shared folder."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    fs, base = open_store(folder)
    fs.create_dir(base, recursive=True)
    listed = write_packages(mark_revisits(pages, id_column, url_column, payload, min_bytes), folder)
    listed.write.mode("error").parquet(f"{folder}/_packages")
    return spark.read.schema(listed.schema).parquet(f"{folder}/_packages")


def read_packages(spark: SparkSession, paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the listed packages, dealt out by runs of a few MB."""
    runs = list_ranges(paths)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_records(runs.repartition(parts, "path", "offset"), with_payload)
