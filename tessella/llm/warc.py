"""WARC archives with a two-level capture index.

Archives are WARC/1.1 files of gzip members, a member a record, so that a record is read by a range of bytes. They are
rows (file, body, captures) of a table in the shared folder, written and read by Spark wherever that folder lies; `export`
copies them to real files.

The capture index has a line a record, sorted by the URL with its host reversed, in zlib blocks of BLOCK_LINES lines: the
second level. The first level is the sparse directory of the first and last key of each run of blocks; a lookup is a binary
search there, the reading of one or a few blocks, and range reads of the captures found.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import materialize, slices, table

FILE_BYTES = 16 << 20
BLOCK_LINES = 3000
#: Lines of the sparse directory (some 100 bytes each), which every task of a search holds: it has one for a run of
#: consecutive blocks, of one block up to this number of blocks, of as many more beyond.
DIRECTORY_ROWS = 250_000
#: Repeated payloads up to so many are broadcast (some 60 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Pages have no capture time.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_URL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)(?::(\d*))?([^#]*)")


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port and path. What is no URL sorts by itself, and null as empty."""
    if url is None:
        return ""
    found = _URL.match(url.strip())
    if not found:
        return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url.strip())
    host, port, rest = found.groups()
    host = host.lower().removeprefix("www.").rstrip(".")
    port = f":{port}" if port and port not in ("80", "443") else ""
    rest = rest if rest.startswith("/") else "/" + rest
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", ",".join(reversed(host.split("."))) + port + ")" + rest)


def _member(kind: str, page_id, url: str | None, digest: str, size: int, payload: bytes, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """A record of an archive: its headers (lower case), payload (bytes; none for a revisit) and payload_bytes."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(rest) != len(block) + 4 or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it states")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
    if headers["warc-type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != stated or headers["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError("a payload that is not what its record states")
    return {"headers": headers, "payload": payload, "payload_bytes": stated}


def _page(urn: str | None) -> int | None:
    number = urn[len("<urn:page:") : -1] if urn else "None"
    return None if number == "None" else int(number)


def write(pages: DataFrame, revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """pages: page_id, url, html (null: empty). A table of archives: file, body, captures (key, page_id, offset, length).

    Of rows with equal payloads of revisit_bytes or more, those with the smallest page_id are responses (several, where a
    page_id is repeated) and the others revisits; a null page_id counts as the largest.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload"))
    again = p.where(F.octet_length("payload") >= revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "first")
    again = materialize(again, "repeated-payloads")
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = p.join(again, "sha1", "left").select("page_id", "url", "payload", F.unhex("sha1").alias("sha1"), "first", F.expr("first IS NOT NULL AND NOT page_id <=> first").alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        body: list[bytes] = []
        captures: list[dict] = []
        at = 0

        def file() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:05d}.warc.gz"]), pa.array([b"".join(body)], pa.binary()), pa.array([captures], kind)], ["file", "body", "captures"])

        for batch in batches:
            for part_rows, _, _ in slices([batch], "payload"):
                for row in part_rows.to_pylist():
                    digest = base64.b32encode(row["sha1"]).decode()
                    kind, payload = ("revisit", b"") if row["revisit"] else ("response", row["payload"])
                    member = _member(kind, row["page_id"], row["url"], digest, len(row["payload"]), payload, row["first"])
                    body.append(member)
                    captures.append({"key": surt(row["url"]), "page_id": row["page_id"], "offset": at, "length": len(member)})
                    at += len(member)
                    if at >= file_bytes:
                        yield file()
                        body, captures, at, k = [], [], 0, k + 1
        if body:
            yield file()

    schema = "file string, body binary, captures array<struct<key:string,page_id:long,offset:long,length:long>>"
    return materialize(rows.mapInArrow(run, schema), "warc")


def index(archives: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The second level: block, first (its first key), last, n and data (compressed lines), sorted by key over all blocks."""
    lines = archives.select("file", F.inline("captures")).select("key", "page_id", "file", "offset", "length")
    # by key and place, so that a key of many captures is split too
    lines = lines.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, have = TaskContext.get().partitionId(), 0, []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            data = zlib.compress("\n".join(f"{key} {page} {file} {offset} {length}" for key, page, file, offset, length in rows).encode())
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) | k]), pa.array([rows[0][0]]), pa.array([rows[-1][0]]), pa.array([len(rows)]), pa.array([data], pa.binary())], ["block", "first", "last", "n", "data"])

        for batch in batches:
            have += zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            while len(have) >= block_lines:
                yield block(have[:block_lines])
                have, k = have[block_lines:], k + 1
        if have:
            yield block(have)

    return materialize(lines.mapInArrow(run, "block long, first string, last string, n long, data binary"), "captures")


def captures(blocks: DataFrame) -> DataFrame:
    """The lines of index blocks: key, page_id, file, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [x.rsplit(" ", 4) for x in zlib.decompress(data.as_py()).decode().split("\n")]
                key, page, file, offset, length = zip(*rows, strict=True)
                ids = [None if x == "None" else int(x) for x in page]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids, pa.int64()), pa.array(file), pa.array(list(map(int, offset))), pa.array(list(map(int, length)))], ["key", "page_id", "file", "offset", "length"])

    return blocks.select("data").mapInArrow(run, "key string, page_id long, file string, offset long, length long")


def read(found: DataFrame, archives: DataFrame) -> DataFrame:
    """Range reads of captures (file, offset, length): page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    ranges = found.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))  # as many as a file has records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column(0)[i].as_buffer()
                view, ranges = memoryview(body), sorted((r["offset"], r["length"]) for r in batch.column(1)[i].as_py())
                for a in range(0, len(ranges), 500):
                    got = [parse(view[o : o + n]) for o, n in ranges[a : a + 500]]
                    heads = [g["headers"] for g in got]
                    revisit = [h["warc-type"] == "revisit" for h in heads]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([_page(h["warc-record-id"]) for h in heads], pa.int64()), pa.array([h.get("warc-target-uri") for h in heads], pa.string()),
                        pa.array([None if r else g["payload"] for g, r in zip(got, revisit, strict=True)], pa.binary()), pa.array([g["payload_bytes"] for g in got], pa.int64()),
                        pa.array([h["warc-payload-digest"].removeprefix("sha1:") for h in heads]), pa.array([h["warc-type"] for h in heads]),
                        pa.array([_page(h.get("warc-refers-to")) for h in heads], pa.int64()),
                    ], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    both = archives.select("file", "body").join(ranges, "file").select("body", "ranges")
    return both.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def keyed(urls: DataFrame) -> DataFrame:
    """urls: url. Each once, with its key."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())], ["url", "key"])

    return urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(keys, "url string, key string")


def search(keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """keys: key. The captures of these keys, each once: key, page_id, file, offset, length."""
    asked = keys.select("key").distinct()
    spans = blocks.select("block", "first", "last")
    long = max(1, -(-spans.count() // DIRECTORY_ROWS))
    at = F.col("block").bitwiseAND((1 << 32) - 1)  # the block's place in its task
    spans = spans.withColumn("run", F.col("block") - at % long)
    runs = spans.groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    directory = sorted((r["first"], r["last"], r["run"]) for r in runs.toLocalIterator())
    first, last, number = ([d[i] for d in directory] for i in range(3))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key in batch.column(0).to_pylist():
                i = bisect.bisect_left(last, key)  # the first run that ends at the key or after it
                while i < len(first) and first[i] <= key:
                    out.append((key, number[i]))
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], ["key", "run"])

    hits = materialize(asked.mapInArrow(find, "key string, run long"), "lookup")
    needed = spans.join(hits, "run").where("key BETWEEN first AND last").select("block").distinct()
    return captures(blocks.join(needed, "block", "left_semi")).join(hits.select("key").distinct(), "key", "left_semi")


def lookup(urls: DataFrame, blocks: DataFrame) -> DataFrame:
    """urls: url. Each with its captures: url, key, page_id, file, offset, length; URLs without captures have no row."""
    asked = materialize(keyed(urls), "asked")
    return asked.join(search(asked, blocks), "key").select("url", "key", "page_id", "file", "offset", "length")


def export(archives: DataFrame, folder: str) -> list[str]:
    """Copies archives to files, one at a time through the driver; for folders that the driver can write."""
    names = []
    for row in archives.select("file", "body").toLocalIterator():
        with open(f"{folder}/{row['file']}", "wb") as f:
            f.write(row["body"])
        names.append(row["file"])
    return names


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages, written to archives and read back: its URL is looked up in the capture index, and each capture is read once."""
    pages = table(spark, sf_dir, "pages")
    archives = write(pages)
    found = search(keyed(pages), index(archives))
    return read(found, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
