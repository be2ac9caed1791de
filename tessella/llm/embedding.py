"""Near-duplicate vectors by an inverted multi-index.

Each half of a vector has its own codebook (k-means on a bounded sample, `sample_rows`); pairs of codes form a product
grid of cells, and every row lies in one. A row visits cells in ascending order of how far its halves would have to move
to get there (multi-sequence traversal of the two sorted lists of squared margins). Each visit adds the share of the row's
possible neighbours that the cell holds, if a neighbour at the threshold lies in an evenly spread direction; the traversal
of a row ends when the shares reach the target recall. A pair is found if either of its rows visits the other's cell. Pairs
of the sample, held against brute force, widen the spread until the recall measured on them is high enough, too. Every row found is verified by its cosine in double precision.

Equal vectors are one class with a count. A cell's rows are dealt to chunks, so tasks compare blocks of bounded size, and
a block returns sums of links and a spanning forest of them, no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import components, materialize, table

COSINE = 0.95
SAMPLE_ROWS = 20_000
#: Rows of a cell that the codebooks aim at, and their largest size.
CELL_ROWS, CODES = 200, 256
#: Recall at which a row's traversal ends, the recall to be measured on pairs of the sample (either row finds a pair), and how many pairs.
TARGET, MEASURED, PAIRS = 0.99, 0.999, 4000
#: Rows and visitors of a cell that meet in one block.
BLOCK_ROWS, BLOCK_VISITS = 1024, 4096
#: How much of a normal distribution lies beyond each of these places.
_PLACES = np.linspace(0, 9, 1801)
_BEYOND = np.array([math.erfc(z / math.sqrt(2)) / 2 for z in _PLACES])


@dataclass
class Index:
    size: int  #: dimensions
    half: int
    books: tuple[np.ndarray, np.ndarray]
    spread: float  #: standard deviation, in any direction, of a neighbour at the threshold
    cosine: float

    def margins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row, and for each half the squared distance (n, codes) that it would have to move to reach each code's region."""
        cells, out = np.zeros(len(x), np.int64), []
        for book, part in zip(self.books, (x[:, : self.half], x[:, self.half :]), strict=True):
            d = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            own = d.argmin(1)
            between = np.sqrt(np.maximum(((book[:, None] - book[None]) ** 2).sum(2), 1e-30))
            m = (d - d[np.arange(len(x)), own][:, None]) / (2 * between[own])
            m[np.arange(len(x)), own] = 0
            out.append(m * m)
            cells = cells * len(book) + own
        return cells, out[0], out[1]

    def shares(self, margins: np.ndarray) -> np.ndarray:
        """For sorted squared margins of a half, the share of a row's neighbours in each code's region; they sum to 1."""
        share = np.interp(np.sqrt(margins) / self.spread, _PLACES, _BEYOND, right=0.0)
        share[:, 0] = np.maximum(1 - share[:, 1:].sum(1), 0.5)
        return share / share.sum(1)[:, None]

    def visits(self, x: np.ndarray, target: float = TARGET) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each row's cell and reach (the squared movement at which it stops), and (row, cell) of all visits."""
        cells, one, two = self.margins(x)
        first, second = one.argsort(1), two.argsort(1)
        one, two = np.take_along_axis(one, first, 1), np.take_along_axis(two, second, 1)
        p, q = self.shares(one), self.shares(two)
        width = two.shape[1]
        two = np.concatenate([two, np.full((len(x), 1), np.inf)], 1)
        reach, seen, last = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        place = np.zeros(one.shape, np.int64)  # for each place of the first list, the next one of the second
        front = one + two[:, :1]  # what that next cell takes
        rows, found, live = [], [], np.arange(len(x))
        while len(live):
            i = front[live].argmin(1)
            cost = front[live, i]
            # a row stops in a gap, so that rounding can't change what it visits
            stop = np.isinf(cost) | ((seen[live] >= target) & (cost > last[live] * (1 + 1e-6) + 1e-12))
            end = live[stop]
            reach[end] = np.where(np.isinf(cost[stop]), np.inf, (last[end] + cost[stop]) / 2)
            live, i, cost = live[~stop], i[~stop], cost[~stop]
            j = place[live, i]
            rows.append(live)
            found.append(first[live, i] * width + second[live, j])
            seen[live] += p[live, i] * q[live, j]
            last[live] = cost
            place[live, i] = j + 1
            front[live, i] = one[live, i] + two[live, j + 1]
        return cells, reach, np.concatenate(rows), np.concatenate(found)

    def recall(self, one: np.ndarray, two: np.ndarray) -> float:
        """The share of pairs of rows of which one visits the other's cell."""
        (a, reach, _, _), (b, back, _, _) = self.visits(one), self.visits(two)
        return float((self.visited(one, reach, b) | self.visited(two, back, a)).mean())

    def visited(self, x: np.ndarray, reach: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether each row visits the cell beside it."""
        _, one, two = self.margins(x)
        every, width = np.arange(len(x)), len(self.books[1])
        return one[every, cell // width] + two[every, cell % width] <= reach


def unit(raw: list[bytes], size: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, size)
    x = x / np.abs(x).max(1)[:, None]  # squares of very large or small components would leave the range
    return x / np.sqrt((x * x).sum(1))[:, None]


def _means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means: seeds are spread evenly over the sample, which is in hash order."""
    book = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = ((book * book).sum(1) - 2 * x @ book.T).argmin(1)
        n = np.bincount(own, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, own, x)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


def fit(vectors: DataFrame, size: int, rows: int, cosine: float = COSINE, sample_rows: int = SAMPLE_ROWS) -> Index:
    """vectors: rep, body. Codebooks from about sample_rows rows of least id hash."""
    sample = vectors.select(F.xxhash64("rep").alias("h"), "body")
    if rows > sample_rows:
        sample = sample.where(F.col("h") <= F.lit(-(2**63) + int(sample_rows / rows * 2**64)))
    got = sample.limit(2 * sample_rows).toArrow()
    order = np.argsort(got.column(0).to_numpy())
    x = unit(got.column(1).to_pylist(), size)[order]
    half = max(size // 2, 1)
    k = int(np.clip(np.sqrt(rows / CELL_ROWS), 1, CODES))
    index = Index(size, half, (_means(x[:, :half], k), _means(x[:, half:], k)), max(math.sqrt((2 - 2 * cosine) / size), 1e-9), cosine)
    pairs = []
    for a in range(0, min(len(x), 4000), 500):
        i, j = np.nonzero(x[a : a + 500] @ x.T >= cosine)
        pairs.append(np.stack([i[j > i + a] + a, j[j > i + a]]))
    one, two = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)
    one, two = one[:PAIRS], two[:PAIRS]
    while len(one) >= 100 and index.recall(x[one], x[two]) < MEASURED:
        index.spread *= 1.25
    return index


def links(vectors: DataFrame, index: Index) -> DataFrame:
    """vectors: rep, weight (rows of the class), body (doubles). Rows (kind 0: id, n: links that a block found; kind 1: id, n: an id that it is linked with by found links)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                cells, reach, rows, found = index.visits(unit(part.column(2).to_pylist(), index.size))
                take = pa.array(np.concatenate([np.arange(part.num_rows), rows]))
                role = np.concatenate([np.zeros(part.num_rows, np.int32), np.ones(len(rows), np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cells, found])), pa.array(role), pa.array(cells).take(take), pa.array(reach).take(take), *(part.column(c).take(take) for c in range(3))], ["cell", "role", "own", "reach", "rep", "weight", "body"])

    placed = materialize(vectors.select("rep", "weight", "body").mapInArrow(place, "cell long, role int, own long, reach double, rep long, weight long, body binary"), "visits")
    # as many rows as cells, CODES squared at most
    sizes = placed.groupBy("cell").agg(F.ceil(F.count_if(F.col("role") == 0) / BLOCK_ROWS).alias("data"), F.ceil(F.count_if(F.col("role") == 1) / BLOCK_VISITS).alias("visits")).where("data > 0")
    dealt = placed.join(F.broadcast(materialize(sizes, "cells")), "cell")
    one = F.pmod(F.xxhash64("rep"), F.when(F.col("role") == 0, F.col("data")).otherwise(F.col("visits")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("role") == 0, F.col("visits")).otherwise(F.col("data")) - 1))
    dealt = dealt.select("*", one.alias("mine"), other.alias("theirs"))
    dealt = dealt.select("cell", F.when(F.col("role") == 0, F.col("mine")).otherwise(F.col("theirs")).alias("d"), F.when(F.col("role") == 0, F.col("theirs")).otherwise(F.col("mine")).alias("q"), "role", "own", "reach", "rep", "weight", "body")
    rows = dealt.repartition("cell", "d", "q").sortWithinPartitions("cell", "d", "q", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            t = pa.Table.from_batches(parts).combine_chunks()
            role, own, reach, rep, weight = (t.column(c).to_numpy() for c in ("role", "own", "reach", "rep", "weight"))
            x = unit(t.column("body").to_pylist(), index.size)
            n = int((role == 0).sum())
            if not n or n == len(x):
                return None
            cell = t.column("cell")[0].as_py()
            i, j = np.nonzero(x[n:] @ x[:n].T >= index.cosine)
            i += n
            # a pair counts once: in the greater cell's visit to the lesser only if the lesser doesn't visit the greater
            keep = np.where(own[i] == cell, rep[i] < rep[j], own[i] < cell)
            back = np.flatnonzero(own[i] > cell)
            if len(back):
                keep[back] = ~index.visited(x[j[back]], reach[j[back]], own[i[back]])
            i, j = i[keep], j[keep]
            if not len(i):
                return None
            ids, at = np.unique(rep, return_inverse=True)
            a, b = at[i], at[j]
            count = np.zeros(len(ids), np.int64)
            np.add.at(count, a, weight[j])
            np.add.at(count, b, weight[i])
            some = np.flatnonzero(count)
            sub = np.full(len(ids), -1)
            sub[some] = np.arange(len(some))
            low, high = _star(sub[a], sub[b], ids[some])
            kinds = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(low), np.int32)])
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([ids[some], low])), pa.array(np.concatenate([count[some], high]))], ["kind", "id", "n"])

        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(3)])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                now = tuple(key[:, a].tolist())
                if now != at and held:
                    if (out := block(held)) is not None:
                        yield out
                    held = []
                at = now
                held.append(batch.slice(a, b - a))
        if held and (out := block(held)) is not None:
            yield out

    return materialize(rows.mapInArrow(compare, "kind int, id long, n long"), "embedding-links")


def _star(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between places of ids (ascending), one to the least id for each other id of a component."""
    at = np.arange(len(ids))
    while True:
        new = at.copy()
        np.minimum.at(new, a, at[b])
        np.minimum.at(new, b, at[a])
        new = np.minimum(new, new[new])
        if (new == at).all():
            break
        at = new
    moved = at != np.arange(len(ids))
    return ids[moved], ids[at[moved]]


def near_vectors(table_: DataFrame, cosine: float = COSINE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """table_: vec_id, embedding. A row a vector: vec_id, n_links (other vectors of cosine or more), component_id, kept.

    Vectors that are null or zero, hold null or non-finite components, or are of another than the most frequent length
    link with nothing; so do rows without vec_id. Rows that share a vec_id count as that many vectors.
    """
    v = table_.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))
    v = v.withColumn("sound", sound)
    size = v.where("sound").groupBy(F.size("e").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = size["size"] if size else 0
    v = v.withColumn("e", F.when(F.col("sound") & (F.size("e") == size), F.transform("e", lambda x: x + 0.0)))
    classes = v.where("e IS NOT NULL").groupBy("e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy()
            body = flat.reshape(batch.num_rows, size) if batch.num_rows else flat
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in body], pa.binary())], ["rep", "weight", "body"])

    packed = materialize(classes.select("rep", "weight", "e").mapInArrow(pack, "rep long, weight long, body binary"), "vectors")
    rows = packed.count()
    if not rows:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = links(packed, fit(packed, size, rows, cosine, sample_rows))
    counts = found.where("kind = 0").groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.where("kind = 1").select(F.col("id").alias("a"), F.col("n").alias("b")), "embedding")
    named = materialize(classes.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("e", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "vector-classes")
    return v.select("vec_id", "e").join(named, "e", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.expr("coalesce(component_id, vec_id) <=> vec_id").alias("kept"))


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
