"""Operator 10: WARC records in ZIP-packaged archives, written and read back by ranges.

Writing: payloads of at least MIN_BYTES that are equal form a group; the record with the least
page_id is the response, the others revisit it. Each task packs its records, gzipped one by one,
into stored members of one archive with an index member per data member, and ends it with the
central directory, in ZIP64 form where sizes or counts need it. An archive counts only if its
task's rows, one a data member, reach the written manifest, so retried tasks leave no double records.

Reading: a task takes some members of the manifest, so an archive spreads over tasks. The end of an archive gives its central directory (plain or ZIP64); index members give
each record's range in its stored data member; ranges are read in place, without extraction,
neighbours together up to READ_BYTES.

Equal payloads meet by digest; a digest of a large share of all rows is joined by broadcast, so its
rows do not move to one task for it.

Defined results: null html is an empty payload; records with equal least page_id and payload are
all responses; null page_id counts as greatest; null url is written as empty; empty tables give
empty results; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucera.llm.common import HOT_SHARE, Work, new_path, small_batches, table

MIN_BYTES = 100
MEMBER_BYTES, READ_BYTES = 4 << 20, 1 << 20
#: Members that a reading task takes, where there are enough for all cores.
TASK_MEMBERS = 16
_U32, _U16 = 0xFFFFFFFF, 0xFFFF


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# ZIP ---------------------------------------------------------------------


class ZipWriter:
    """Stored members onto a stream that only moves forward."""

    def __init__(self, out, force64: bool = False):
        self.out, self.at, self.entries, self.force64 = out, 0, [], force64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, offset, n = name.encode(), zlib.crc32(data), self.at, len(data)
        big = self.force64 or n >= _U32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        size = _U32 if big else n
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.entries.append((raw, crc, n, offset))

    def close(self) -> None:
        start = self.at
        for raw, crc, n, offset in self.entries:
            big = self.force64 or n >= _U32 or offset >= _U32
            extra = struct.pack("<HHQQQ", 1, 24, n, n, offset) if big else b""
            size, place = (_U32, _U32) if big else (n, offset)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        size, count = self.at - start, len(self.entries)
        if self.force64 or count >= _U16 or start >= _U32 or size >= _U32:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
            count, size, start = _U16, _U32, _U32
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, size, start, 0))


class ZipReader:
    """Members of an archive behind read(offset, size); only directories and ranges are read."""

    def __init__(self, read, length: int):
        self.read = read
        tail_at = max(0, length - (1 << 16) - 22)
        tail = read(tail_at, length - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP archive")
        count, size, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        if count == _U16 or size == _U32 or start == _U32:
            locator = tail_at + end - 20
            found = read(locator, 20) if locator >= 0 else b""
            if found[:4] == b"PK\x06\x07":
                (end64,) = struct.unpack("<Q", found[8:16])
                count, size, start = struct.unpack("<QQQ", read(end64, 56)[32:56])
        self.members = dict(self._entries(read(start, size), count))

    @staticmethod
    def _entries(data: bytes, count: int):
        at = 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, _, _, crc, packed, size, n, m, k = struct.unpack("<HHHIIIHHH", data[at + 10 : at + 34])
            (offset,) = struct.unpack("<I", data[at + 42 : at + 46])
            name, extra = data[at + 46 : at + 46 + n].decode(), data[at + 46 + n : at + 46 + n + m]
            at += 46 + n + m + k
            e = 0
            while e + 4 <= len(extra):
                tag, width = struct.unpack("<HH", extra[e : e + 4])
                if tag == 1:
                    body, p = extra[e + 4 : e + 4 + width], 0
                    if size == _U32:
                        size, p = struct.unpack("<Q", body[p : p + 8])[0], p + 8
                    if packed == _U32:
                        packed, p = struct.unpack("<Q", body[p : p + 8])[0], p + 8
                    if offset == _U32:
                        offset = struct.unpack("<Q", body[p : p + 8])[0]
                e += 4 + width
            yield name, {"method": method, "crc": crc, "size": size, "packed": packed, "offset": offset}

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        m = self.members[name]
        if m["method"]:
            raise ValueError(f"{name} is compressed; ranges need stored members")
        head = self.read(m["offset"], 30)
        n, extra = struct.unpack("<HH", head[26:30])
        return m["offset"] + 30 + n + extra

    def member(self, name: str) -> bytes:
        data = self.read(self.start(name), self.members[name]["size"])
        if zlib.crc32(data) != self.members[name]["crc"]:
            raise ValueError(f"{name}: checksum differs")
        return data


# WARC --------------------------------------------------------------------


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit carries no payload but its length and digest."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, folder: str, force64: bool = False) -> DataFrame:
    """pages (page_id, url, html, digest, refers_to) -> manifest rows (name, member, records) of one archive a task."""

    def run(batches):
        zipped, sink, path, members = None, None, None, []
        data, index = io.BytesIO(), []

        def flush():
            nonlocal data, index
            if index:
                zipped.add(f"archive/data-{len(members):06d}.warc.gz", data.getvalue())
                zipped.add(f"indexes/data-{len(members):06d}.cdxj", "\n".join(index).encode())
                members.append(len(index))
                data, index = io.BytesIO(), []

        for batch in batches:
            for row in batch.to_pylist():
                if zipped is None:
                    fs, base = _filesystem(folder)
                    fs.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.wacz"
                    sink = fs.open_output_stream(path)
                    zipped = ZipWriter(sink, force64)
                packed = _gzip(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["refers_to"]))
                index.append(json.dumps({"offset": data.tell(), "length": len(packed)}))
                data.write(packed)
                if data.tell() >= MEMBER_BYTES:
                    flush()
        if zipped is not None:
            flush()
            zipped.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"name": [path.rsplit("/", 1)[1]] * len(members), "member": [f"data-{k:06d}" for k in range(len(members))], "records": members})

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "name string, member string, records long")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the manifest's archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def records(f, z, member):
        base = z.start(f"archive/{member}.warc.gz")
        spans = [json.loads(x) for x in z.member(f"indexes/{member}.cdxj").decode().split("\n")]
        i = 0
        while i < len(spans):
            j = i + 1
            while j < len(spans) and spans[j]["offset"] + spans[j]["length"] - spans[i]["offset"] <= READ_BYTES:
                j += 1
            lo = spans[i]["offset"]
            block = f.read_at(spans[j - 1]["offset"] + spans[j - 1]["length"] - lo, base + lo)
            for s in spans[i:j]:
                yield parse_record(zlib.decompress(block[s["offset"] - lo : s["offset"] - lo + s["length"]], 31))
            i = j

    def archives(batches, fs, base):
        """Records of all members asked for; an archive's directory is read once for neighbouring members."""
        last, f, z = None, None, None
        for batch in batches:
            for name, member in zip(batch.column("name").to_pylist(), batch.column("member").to_pylist(), strict=True):
                if name != last:
                    if f is not None:
                        f.close()
                    last, f = name, fs.open_input_file(f"{base}/{name}")
                    z = ZipReader(lambda offset, n, f=f: f.read_at(n, offset), f.size())
                yield from records(f, z, member)
        if f is not None:
            f.close()

    def run(batches):
        rows = []
        for head, payload in archives(batches, *_filesystem(folder)):
            revisit = head["WARC-Type"] == "revisit"
            rows.append((
                int(head["X-Page-ID"]) if head["X-Page-ID"] else None,
                int(head["X-Payload-Length"]) if revisit else len(payload),
                head["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
                head["WARC-Type"], int(head["X-Refers-To-Page"]) if revisit else None,
            ))
            if len(rows) >= 5000:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    def _rows(rows):
        names, kinds = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # as many tasks as members, up to twice the cores; beyond, some members a task
    members, cores = manifest.count(), manifest.sparkSession.sparkContext.defaultParallelism
    spread = manifest.select("name", "member").repartition(max(1, min(members, 2 * cores), members // TASK_MEMBERS), "name", "member")
    return spread.sortWithinPartitions("name", "member").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_revisits(pages: DataFrame, work: Work) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    groups = work.save(rows.filter(F.col("bytes") >= MIN_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    # fewer than HOT_SHARE digests are hot; their rows get keys of their own and stay spread
    few = groups.filter(hot).select(F.col("digest").alias("d0"), F.col("first").alias("f0"), F.lit(True).alias("is_hot"))
    rest = groups.filter(~hot).select(F.col("digest").alias("d1"), F.col("first").alias("f1"))
    joined = rows.join(F.broadcast(few), F.col("digest") == F.col("d0"), "left")
    key = F.when(F.col("is_hot"), F.concat_ws("-", "digest", F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("digest"))
    joined = joined.withColumn("key", key).join(rest, F.col("key") == F.col("d1"), "left").withColumn("first", F.coalesce("f0", "f1"))
    refers = F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first"))
    return joined.withColumn("refers_to", refers).select("page_id", "url", "html", "digest", "refers_to")


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    folder = new_path(spark, "op10-archives")
    work = Work(spark, "op10")
    manifest = work.save(write_archives(with_revisits(table(spark, sf_dir, "pages"), work), folder), "manifest")
    return read_archives(manifest, folder)


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""
