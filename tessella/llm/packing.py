"""Packing documents into batches of optimal length buckets.

Lengths are tokens of the byte-level tokenizer (tokens.Words), or whatever `pack` is given. The global histogram of lengths (one aggregation) goes to the driver: it has one entry a distinct length, and as d
distinct lengths need d * (d + 1) / 2 tokens at least, it grows with the square root of the corpus at most. Dynamic
programming over it finds the `buckets` boundaries that minimise padding exactly. Inside a bucket of padded length p
each batch holds budget // p rows (one at least). Ranks inside a bucket are exact and global, found in two steps so
that no bucket meets in one task: rows are dealt to groups of about GROUP_ROWS by a hash of the id, and the groups'
counts are summed up in front of them. A batch is formed as a matrix of ids, a row a document, padded to the bucket's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import Words
from .util import materialize, slices, table, texts

BUCKETS = 8
#: Tokens of a batch with its padding; a longer document is a batch of its own.
BUDGET = 65_536
#: The id that fills rows up; ids are less.
PAD = 2**32 - 1
GROUP_ROWS = 1_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The largest lengths of at most `buckets` buckets, least padding first, then fewest buckets; lengths ascend.

    cost(i, j) of a bucket over entries i..j is lengths[j] * rows - tokens. It satisfies the quadrangle inequality, so
    each layer is solved by divide and conquer, a level of the recursion at a time.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.float64)
    length = lengths.astype(np.float64)
    best = length * rows[1:] - tokens[1:]
    choice: list[np.ndarray] = []
    reached = [best[-1]]
    for _ in range(min(buckets, n) - 1):
        prev = np.concatenate([[np.inf], best])  # prev[i]: entries before i, in one bucket less
        now, arg = np.full(n, np.inf), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, least, most = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(least, min(j, most) + 1)
            c = prev[i] + length[j] * (rows[j + 1] - rows[i]) - (tokens[j + 1] - tokens[i])
            at = int(np.argmin(c))
            now[j], arg[j] = c[at], i[at]
            todo += [(lo, j - 1, least, int(i[at])), (j + 1, hi, int(i[at]), most)]
        choice.append(arg)
        best = now
        reached.append(best[-1])
    k = int(np.argmin(reached))
    cuts, j = [], n - 1
    for arg in reversed(choice[:k]):
        cuts.append(int(lengths[j]))
        j = int(arg[j]) - 1
    cuts.append(int(lengths[j]))
    return cuts[::-1]


def encoded(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """docs: doc_id, text (null: no tokens). doc_id and n_tokens, with keep_ids also ids (binary, little-endian unsigned 32-bit numbers)."""
    names = ["doc_id", "n_tokens", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Words.load(path)
        for part, offsets, data in slices(batches, "text", 4 << 20):
            ids = coder.encode([t or "" for t in part.column(1).to_pylist()], offsets, data)
            cols = [part.column(0), pa.array([len(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())] if keep_ids else [])], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long" + (", ids binary" if keep_ids else ""))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """docs: doc_id, n_tokens and perhaps more, which stays. Adds bucket, pad_to, batch (in the bucket, from 0), slot (in the batch, from 0).

    Each input row is one output row: repeated ids are placed apart and null ids are placed like others, in no order of
    their own. Rows without tokens count as of length 0, in the bucket of least length.
    """
    d = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("n_tokens", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)))
    # rows without id are dealt by where they are written, so that they don't meet
    d = materialize(d.withColumn("deal_", F.xxhash64("doc_id", "n_tokens", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))), "lengths")
    histogram = d.groupBy("n_tokens").count().toArrow()
    lengths, counts = (np.array(histogram.column(c).to_pylist(), np.int64) for c in ("n_tokens", "count"))
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    cuts = boundaries(lengths, counts, buckets) or [0]
    held = [int(counts[(lengths <= c) & (lengths > b)].sum()) for b, c in zip([-1, *cuts[:-1]], cuts, strict=True)]
    groups = F.element_at(F.array(*(F.lit(max(1, n // GROUP_ROWS)) for n in held)), F.col("bucket") + 1)
    bucket = F.lit(len(cuts) - 1)
    for b in range(len(cuts) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= cuts[b], F.lit(b)).otherwise(bucket)
    dealt = d.withColumn("bucket", bucket).withColumn("part_", F.pmod("deal_", groups))
    ranked = dealt.withColumn("r_", F.row_number().over(Window.partitionBy("bucket", "part_").orderBy("doc_id", "n_tokens")) - 1)
    before = dealt.groupBy("bucket", "part_").count().withColumn("before_", F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pad = F.element_at(F.array(*(F.lit(c).cast("long") for c in cuts)), F.col("bucket") + 1)
    placed = ranked.join(before.select("bucket", "part_", "before_"), ["bucket", "part_"]).withColumn("pad_to", pad).withColumn("rank_", F.col("before_") + F.col("r_"))
    size = F.greatest(F.floor(F.lit(budget) / F.greatest("pad_to", F.lit(1))), F.lit(1)).cast("long")
    return placed.select("doc_id", "n_tokens", *(c for c in docs.columns if c not in ("doc_id", "n_tokens")), "bucket", "pad_to", F.floor(F.col("rank_") / size).alias("batch"), (F.col("rank_") % size).alias("slot"))


def formed(packed: DataFrame) -> DataFrame:
    """packed: what `pack` gives of rows with ids. A row a batch: bucket, batch, pad_to, doc_ids, lengths and ids (a matrix of pad_to columns, PAD behind each row's end)."""
    rows = packed.groupBy("bucket", "batch", "pad_to").agg(F.sort_array(F.collect_list(F.struct("slot", "doc_id", "n_tokens", "ids"))).alias("rows"))  # BUDGET ids or one row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, held = batch.column(2)[i].as_py(), batch.column(3)[i].values
                n, raw = held.field("n_tokens").to_numpy(), held.field("ids").to_pylist()
                out = np.full((len(n), width), PAD, "<u4")
                out[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(raw), "<u4")
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(3)), pa.array([held.field("doc_id").to_pylist()], kind), pa.array([n], kind), pa.array([out.tobytes()], pa.binary())], ["bucket", "batch", "pad_to", "doc_ids", "lengths", "ids"])

    return rows.mapInArrow(run, "bucket int, batch long, pad_to long, doc_ids array<long>, lengths array<long>, ids binary")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, lengths in tokens."""
    return pack(encoded(texts(table(spark, sf_dir, "documents")), _tokenizer()))


def packed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of every row of documents: bucket, batch, pad_to, n_rows, n_tokens, padding, doc_ids and the crc32 of the matrix."""
    b = formed(pack(encoded(texts(table(spark, sf_dir, "documents")), _tokenizer(), keep_ids=True)))
    n = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return b.select("bucket", "batch", "pad_to", F.size("doc_ids").alias("n_rows"), n.alias("n_tokens"), (F.size("doc_ids") * F.col("pad_to") - n).alias("padding"), "doc_ids", F.crc32("ids").alias("ids_crc32"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the batches."""
    return pack(encoded(texts(docs), _tokenizer()))
