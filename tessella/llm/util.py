"""What the operators share: text batches as flat bytes, tables in the shared folder, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python works on slices of about so many bytes of text, whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 18

_made: list[tuple[SparkSession, str]] = []
_paths: dict[int, tuple[weakref.ref, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own and a cluster an error."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone
            return


def materialize(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage ends there and a lost executor loses nothing.

    narrow: rows of a few ids, which an eighth of the shuffle partitions (6 at least) write, as fewer files; they are
    shuffled to them, so that what makes them keeps all its tasks.
    """
    spark = df.sparkSession
    if narrow:
        df = df.repartition(max(6, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = fresh(spark, label)
    df.write.parquet(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    _paths[id(table_)] = (weakref.ref(table_), path)
    return table_


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more: what was made of them is written."""
    for t in tables:
        ref, path = _paths.pop(id(t), (None, None))
        if ref is not None and ref() is t:
            _delete(t.sparkSession, path)
            _made.remove((t.sparkSession, path))


#: Written tables of at most so many rows of a few ids (some 30 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df (written already), broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: A key with more than one in so many of all rows is frequent; there are fewer such keys than that. Its rows are dealt to SALTS tasks.
FREQUENT, SALTS = 20_000, 64


def frequent_join(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of rows with written keys (on, c: how often the key occurs in total rows, and more), the same way at every size.

    Frequent keys, fewer than FREQUENT by their definition, are broadcast to mark their rows, which are dealt to SALTS parts by
    a hash of their other columns; each part meets a copy of the key. So no task gets all rows of a key, and rows are read once.
    """
    often = F.col("c") > total / FREQUENT
    few = keys.where(often).select(*on, F.lit(True).alias("often_"))
    part = F.pmod(F.xxhash64(*(c for c in rows.columns if c not in on)), F.lit(SALTS))
    dealt = rows.join(F.broadcast(few), on, "left").select(*rows.columns, F.when(F.col("often_"), part).otherwise(0).cast("long").alias("part_"))
    copies = keys.withColumn("part_", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("c")
    return dealt.join(copies.withColumn("part_", F.col("part_").cast("long")).hint("shuffle_merge"), [*on, "part_"]).drop("part_")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n, start = len(column), column.offset
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(offsets, np.int64 if large else np.int32)[start : start + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return o - o[0], bytes_


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose text is about limit bytes (one row at least), with offsets and bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, data = flat(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
            j = min(max(j, i + 1), i + 20_000, n)
            yield batch.slice(i, j - i), offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
            i = j


def texts(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id (long), text (string) and further columns, whatever else the table has."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any span of a byte array by two products: prefix sums of byte * base**i modulo 2**64, moved to place 0 by the inverse power.

    For choosing places only: spans of different bytes can have one hash, for every base. What must tell bytes apart uses `digests` or `hashes`.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self._powers.get(self.base)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            up[0] = down[0] = 1
            have = self._powers[self.base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        return have

    def prefix(self, data: np.ndarray) -> np.ndarray:
        up, _ = self._tables(len(data) + 1)
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self._tables(len(prefix))
        return (prefix[end] - prefix[start]) * down[start]


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit XXH3 digest of each span, as two numbers."""
    whole, one = data.tobytes(), xxhash.xxh3_128_digest
    raw = b"".join([one(whole[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


#: Spans of more bytes are hashed one at a time.
_LONG = 128
_PART = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)  # masks of the first k bytes


def eights(data: np.ndarray) -> np.ndarray:
    """The number in the eight bytes from each place on (little-endian; zeros beyond the end), one place more than bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: eight bytes at a time go through a bijection that spreads every bit, so each state depends on all bytes so far."""
    size = end - start
    at, h = eights(data), mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    go, k = np.flatnonzero(size <= _LONG), 0
    while len(go):
        x = at[start[go] + k] & _PART[np.minimum(size[go] - k, 8)]
        h[go] = mix64((h[go] ^ x) + np.uint64(0xD6E8FEB86659FD93))
        k += 8
        go = go[size[go] > k]
    long = np.flatnonzero(size > _LONG)
    if len(long):
        whole = data.tobytes()
        h[long] = [xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return h


def arrow_list(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and each row's length."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """(id, component_id) for every id in edges (a, b): the smallest id reachable.

    Alternates large-star and small-star steps: each moves every node's links to the least neighbour, so the
    number of links never grows and the rounds grow with the logarithm of the longest path. Each round is a
    Parquet table in the shared folder; minima are aggregated before they are shuffled.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label, narrow=True)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = materialize(small.where("a <> b").distinct(), label, narrow=True)
        # a forest of stars: no centre has a link of its own, and each leaf has one
        deep = new.select("b").distinct().join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        twice = 0 if deep else new.groupBy("a").count().where("count > 1").limit(1).count()
        e = new
        if not deep and not twice:
            break
    else:
        raise RuntimeError(f"components of {label} did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
