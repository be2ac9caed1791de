"""Substring deduplication by content-defined chunks.

A gear rolling hash runs over each text's bytes; a chunk ends where the hash falls under a bound, so chunk ends depend on
the REACH bytes before them only and insertions move chunks without changing them. Chunks are deduplicated by their
128-bit XXH3 digest: the occurrence in the least document (and place) stays. Chunks that repeat are removed only in runs of
RUN bytes or more, so that a few words that two texts share by chance stay; with run=0 every repeated chunk goes, and the
bytes of all of them are reported whatever the run.

Rows of frequent digests are dealt to several tasks (`frequent_join`), so none gets all copies of a common chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .suffix import keyed
from .util import digests, discard, frequent_join, materialize, mix64, signed, slices, table

#: Bytes of a chunk: least, on average beyond the least, most. Bytes that the hash depends on.
LEAST, MEAN, MOST, REACH = 8, 20, 1024, 16
RUN = 80

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: sum of table[byte] << age over the last REACH bytes of the text, found by doubling."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    h, w = _GEAR[data], 1
    while w < REACH:
        older = np.where(place[w:] >= w, h[:-w] << np.uint32(w), np.uint32(0))
        h = h.copy()
        h[w:] += older
        w *= 2
    return h


def cut(offsets: np.ndarray, data: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all texts (ascending) and the text of each."""
    marks = np.flatnonzero(gear(offsets, data) < np.uint32((1 << 32) // mean)) + 1
    ends: list[int] = []
    texts: list[int] = []
    first = np.searchsorted(marks, offsets, "right").tolist()
    bounds, marks_ = offsets.tolist(), marks.tolist()
    for t in range(len(bounds) - 1):
        last, stop = bounds[t], bounds[t + 1]
        had = len(ends)
        for c in marks_[first[t] : first[t + 1]]:
            if c - last >= least:
                while c - last > most:
                    last += most
                    ends.append(last)
                ends.append(c)
                last = c
        while stop - last > most:
            last += most
            ends.append(last)
        if last < stop:
            ends.append(stop)
        texts += [t] * (len(ends) - had)
    return np.array(ends, np.int64), np.array(texts, np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """docs: doc_id, rid, text. doc_id, rid, start, end, d1, d2 (the digest). Null and empty texts have no chunks; rows with one id have chunks each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, data in slices(batches, "text"):
            ends, text = cut(offsets, data)
            if not len(ends):
                continue
            start = np.concatenate([[0], ends[:-1]])  # texts without bytes have no chunk, so each begins where the last ended
            digest = [pa.array(signed(x)) for x in digests(data, start, ends)]
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *(pa.array((x - offsets[text]).astype(np.int32)) for x in (start, ends)), *digest], ["doc_id", "rid", "start", "end", "d1", "d2"])

    return docs.select("doc_id", "rid", "text").mapInArrow(run, "doc_id long, rid long, start int, end int, d1 long, d2 long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """The chunks that occur more than once: doc_id, rid, start, end, first (whether it is the occurrence that stays), source (the doc_id of that).

    The result reads written tables only; rows without doc_id come last among the occurrences of a chunk.
    """
    every = chunks(docs)
    # most chunks occur once: half of the digest tells, and only what is left is written
    twice = materialize(every.groupBy("d1").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "repeated-halves")
    total = twice.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    again = materialize(frequent_join(every, twice, ["d1"], total), "repeated-chunks")
    held = again.groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "start")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    stays = materialize(held.select("d1", "d2", "f", "c"), "repeated-digests")
    both = frequent_join(again, stays, ["d1", "d2"], total)
    found = materialize(both.select("doc_id", "rid", "start", "end", F.expr("doc_id <=> f.doc_id AND rid = f.rid AND start = f.start").alias("first"), F.col("f.doc_id").alias("source")), "repeats")
    discard(twice, again, stays)
    return found


def deduplicated(docs: DataFrame, repeated: DataFrame, run: int = RUN) -> DataFrame:
    """docs: doc_id, rid, text. Adds n_bytes, n_chunked (bytes of all repeated chunks), n_repeated (those in runs of `run` bytes), n_removed (those of them that stay elsewhere), n_spans, sources (the documents where they stay), kept_sha256 and kept (binary).

    Rows equal in doc_id and text fare alike: each keeps the first occurrences that it holds.
    """
    own = repeated.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("start", "end", "first", "source")).alias("parts"))
    both = docs.alias("d").join(own.alias("o"), F.expr("d.doc_id <=> o.doc_id AND d.rid = o.rid"), "left")
    both = both.select("d.doc_id", "d.rid", F.encode("d.text", "UTF-8").alias("body"), F.col("parts").cast("array<struct<start:int,end:int,first:boolean,source:long>>"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            lists = batch.column(3)
            offsets, inner = lists.offsets.to_numpy(), lists.values
            start, end, first, source = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for i in range(batch.num_rows):
                body = batch.column(2)[i].as_buffer()
                view, n, every = memoryview(body), len(body), 0
                a, b, f, s = (x[offsets[i] : offsets[i + 1]] for x in (start, end, first, source))
                if len(a):
                    order = np.argsort(a, kind="stable")
                    a, b, f, s = a[order], b[order], f[order].astype(bool), s[order]
                    new = np.concatenate([[True], a[1:] != b[:-1]])
                    no, every = np.cumsum(new) - 1, int((b - a).sum())
                    size = np.bincount(no, weights=b - a)[no] >= run
                    a, b, f, s = a[size], b[size], f[size], s[size]
                if not len(a):
                    rows.append((n, every, 0, 0, 0, [], hashlib.sha256(view).hexdigest(), body.to_pybytes()))
                    continue
                repeated_ = int((b - a).sum())
                a, b, s = a[~f], b[~f], s[~f]
                spans = int(np.concatenate([[True], a[1:] != b[:-1]]).sum()) if len(a) else 0
                left = b"".join([view[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), n], strict=True)])
                at = sorted({int(x) for x in s if x is not None and x == x})
                rows.append((n, every, repeated_, n - len(left), spans, at, hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.binary())
            names = ["doc_id", "rid", "n_bytes", "n_chunked", "n_repeated", "n_removed", "n_spans", "sources", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    return both.mapInArrow(work, "doc_id long, rid long, n_bytes long, n_chunked long, n_repeated long, n_removed long, n_spans long, sources array<long>, kept_sha256 string, kept binary")


def op2_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as UTF-8 (null: empty). Runs of repeated chunks under RUN bytes stay; n_chunked counts them too."""
    docs = keyed(table(spark, sf_dir, "documents"))
    return deduplicated(docs, repeated_chunks(docs)).drop("rid", "kept")
