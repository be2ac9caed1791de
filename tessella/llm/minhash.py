"""Near-duplicate texts by bottom-k sketches.

A text's set of distinct 5-word shingles is hashed once per shingle by one hash function; its sketch is the K least
hashes. Texts with equal sets are one class from then on (an aggregation by a 128-bit sum of the set), so copies cost
nothing further. Retained hashes form inverted lists. A class stays only in the lists of its rarest hashes, as many as
make sure that two sketches with COMMON hashes in common meet (prefix filtering); texts at the threshold have fewer than
COMMON of K in common with a probability under 2e-6. That keeps what many texts share, such as frequent passages, from
forming long lists.

Classes that share a list go on with their full sets. Their lists are narrowed by exact prefix filtering: a set takes part
with its rarest shingles only, as many as any set of the needed similarity must share one of. Overlaps are taken from these
lists in two steps. First every member is paired with LEADERS members of its list, so a list gives as many pairs as it has
members, and links found unite most of each group of near copies. Then the pairs that could still unite two components are
formed: those with a member outside a list's largest component. Pairs pass the estimate of their similarity from the
sketch of the union, then full sets are compared exactly. Components follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shingles import shingle_sets
from .util import arrow_list, components, materialize, mix64, signed, slices, small, table, texts

K, COMMON = 32, 12
WORDS = 5
PERCENT = 75
LEADERS = 16
#: A leader's set goes with so many others at most to one task's run.
CHUNK = 200
#: Members of a list in open components that a task pairs with as many others.
BLOCK = 2_000


def sketches(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, n (size of the set), s1 and s2 (the set's 128-bit sum) and sketch (its k least hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, data in slices(batches, "text"):
            sets = shingle_sets(offsets, data, words)
            n = np.array([len(s) for s in sets])
            every = np.concatenate(sets)
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(every ^ np.uint64(salt)))])
                ends = np.cumsum(n)
                sums.append(pa.array(signed(total[ends] - total[ends - n])))
            least = [s[:k] for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *sums, arrow_list(signed(np.concatenate(least)), np.array([len(x) for x in least]), pa.int64())], ["doc_id", "n", "s1", "s2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch array<long>")


def lists(classes: DataFrame, k: int = K, common: int = COMMON) -> DataFrame:
    """Inverted lists: v (a retained hash), rep, n and at of the classes that keep it among their rarest."""
    m = F.size("sketch")
    return _rarest(classes.select("rep", "n", m.alias("m"), (m - F.least(F.lit(common), _needed(m)) + 1).alias("prefix"), F.explode("sketch").alias("v")))


def exact_lists(sets: DataFrame) -> DataFrame:
    """The same of full sets: v (a shingle), rep, n and at (v's place, from 1, in rep's shingles from the rarest). Sets of the needed similarity share one of these lists at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, data in slices(batches, "set"):
            n = np.diff(offsets) // 8
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(np.frombuffer(data.tobytes(), np.int64))], ["rep", "n", "v"])

    n = F.col("n")
    return _rarest(sets.select("rep", "set").mapInArrow(run, "rep long, n long, v long").select("rep", "n", n.alias("m"), (n - _needed(n) + 1).alias("prefix"), "v"))


def _needed(n):
    """Of n hashes, those that a set of the needed similarity has too."""
    return F.ceil(n * PERCENT / 100)


def _rarest(held: DataFrame) -> DataFrame:
    """held: v, rep, n, m (values of rep) and prefix. The rows of each rep's prefix rarest values that others have too."""
    shared = held.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    own = Window.partitionBy("rep")
    ranked = held.join(shared, "v").withColumn("q", F.row_number().over(own.orderBy("f", "v"))).withColumn("twice", F.count(F.lit(1)).over(own))
    return ranked.withColumn("at", F.expr("m - twice + q")).where("at <= prefix").select("v", "rep", "n", "at")


def _near(n: str, at: str, m: str, be: str):
    """What the threshold allows for sets of n and m shingles whose first common one is at these places: those after it must do."""
    return F.expr(f"(1 + least({n} - {at}, {m} - {be})) * {100 + PERCENT} >= ({n} + {m}) * {PERCENT}")


def leader_pairs(entries: DataFrame) -> DataFrame:
    """(hub, b): each member of a list with LEADERS members."""
    chosen = entries.groupBy("v").agg(F.array(*(F.min(F.struct(F.xxhash64("rep", F.lit(i)).alias("h"), F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("at").alias("hub_at"))) for i in range(LEADERS))).alias("leaders"))
    pairs = entries.join(chosen, "v").select("rep", "n", "at", F.explode("leaders").alias("l")).select("l.*", F.col("rep").alias("b"), "n", "at")
    return pairs.where("hub <> b").where(_near("n", "at", "hub_n", "hub_at")).select("hub", "b").distinct()


def open_pairs(entries: DataFrame, component: DataFrame) -> DataFrame:
    """(hub, b): pairs of a list in two components, one member outside the list's largest."""
    own = materialize(entries.join(component.withColumnRenamed("id", "rep"), "rep", "left").select("v", "rep", "n", "at", F.coalesce("component_id", "rep").alias("c")), "listed")
    count = own.groupBy("v", "c").agg(F.count(F.lit(1)).alias("members"))
    lists_ = count.groupBy("v").agg(F.max(F.struct("members", "c")).alias("most"), F.sum("members").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    major = lists_.select("v", F.col("most.c").alias("major"), blocks(F.col("all")).alias("columns"), blocks(F.col("all") - F.col("most.members")).alias("rows"))
    rest = materialize(own.join(major, "v"), "open-lists", narrow=True)
    # a list's pairs lie in a grid of blocks of members by blocks of members, so no task pairs all of a long list
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = rest.where("c <> major").select("v", dealt("rows").alias("row"), each("columns").alias("column"), F.col("rep").alias("b"), F.col("n").alias("b_n"), F.col("at").alias("b_at"), F.col("c").alias("b_c"))
    every = rest.select("v", each("rows").alias("row"), dealt("columns").alias("column"), "rep", "n", "at", "c", "major")
    cross = every.join(some, ["v", "row", "column"]).where("c <> b_c AND (c = major OR rep < b)").where(_near("n", "at", "b_n", "b_at"))
    return cross.select(F.col("rep").alias("hub"), "b").distinct()


def estimated(pairs: DataFrame, classes: DataFrame, common: int = COMMON, k: int = K) -> DataFrame:
    """The pairs whose union's sketch has as many common hashes as the threshold makes sure of."""
    s = classes.select(F.col("rep"), "sketch")
    both = small(pairs).join(s.withColumnRenamed("rep", "hub").withColumnRenamed("sketch", "x"), "hub")
    both = both.join(s.withColumnRenamed("rep", "b").withColumnRenamed("sketch", "y"), "b").select("hub", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            x, y = batch.column(2), batch.column(3)
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            xv, yv = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
            for i in range(batch.num_rows):
                a, b = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                both = np.sort(np.concatenate([a, b]))
                same = both[1:] == both[:-1]
                if len(a) < k and len(b) < k:  # whole sets
                    keep[i] = 100 * same.sum() >= PERCENT * (len(both) - same.sum())
                else:
                    place = np.flatnonzero(np.concatenate([[True], ~same]))  # of the union's hashes
                    last = both[place[k - 1]] if len(place) >= k else both[-1]
                    keep[i] = (same & (both[1:] <= last)).sum() >= min(common, np.ceil(PERCENT / 100 * min(len(a), len(b))))
            yield batch.select(["hub", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "hub long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and set (sorted hashes, as binary) of the documents in wanted (rep)."""
    mine = docs.join(small(wanted).withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, data in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(offsets, data)], pa.binary())], ["rep", "set"])

    return mine.select("doc_id", "text").mapInArrow(run, "rep long, set binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b): pairs whose full sets have 100 * intersection >= PERCENT * union.

    Each run of rows is one hub's set, then its partners' sets; a hub of many partners has several runs, so no task
    gets all of them, and a task holds two sets at a time.
    """
    p = materialize(pairs, "estimated", narrow=True)
    large = materialize(p.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks")).where("chunks > 1"), "large-hubs", narrow=True)
    dealt = p.join(small(large), "hub", "left").select("hub", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("chunks")), F.lit(0).cast("long")).alias("chunk"))
    dealt = materialize(dealt, "dealt", narrow=True)
    others = small(dealt).join(sets.withColumnRenamed("rep", "b"), "b").select("hub", "chunk", F.col("b").alias("id"), F.lit(1).alias("role"), "set")
    runs = small(materialize(dealt.select("hub", "chunk").distinct(), "runs", narrow=True))
    hubs = runs.join(sets.withColumnRenamed("rep", "hub"), "hub").select("hub", "chunk", F.col("hub").alias("id"), F.lit(0).alias("role"), "set")
    rows = hubs.unionByName(others).repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[np.ndarray] = []
        at = None
        for batch in batches:
            a, b = [], []
            hub, chunk, ids, role = (batch.column(i).to_numpy() for i in range(4))
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                if (hub[i], chunk[i]) != at:
                    own, at = [], (hub[i], chunk[i])
                if role[i] == 0:
                    own.append(x.copy())
                    continue
                for y in own:  # several only if rows share a doc_id
                    common = len(x) + len(y) - len(np.union1d(x, y)) if len(x) + len(y) < 64 else int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * common >= PERCENT * (len(x) + len(y) - common):
                        a.append(hub[i])
                        b.append(ids[i])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return materialize(rows.select("hub", "chunk", "id", "role", "set").mapInArrow(run, "a long, b long"), "links", narrow=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. A row a document: doc_id, n_shingles, component_id (least doc_id reachable by links), kept.

    Null, empty and wordless texts have an empty set and link with nothing. Rows that share a doc_id are one node. Rows
    without doc_id link with equal texts only in that their component_id is that of their set's class; it is null, and
    kept true, if no row of the class has an id.
    """
    rows = materialize(sketches(docs), "sketches")
    classes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    named = classes.where("rep IS NOT NULL")
    entries = materialize(lists(named), "lists")
    met = entries.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select("v")
    sets = materialize(full_sets(docs, materialize(entries.join(met, "v", "left_semi").select("rep").distinct(), "listed-ids", narrow=True)), "sets")
    entries = materialize(exact_lists(sets), "exact-lists")
    first = materialize(leader_pairs(entries), "leaders", narrow=True)
    links = verified(estimated(first, named), sets)
    so_far = components(links, "near")
    second = materialize(open_pairs(entries, so_far), "open", narrow=True)
    tested = first.select(F.least("hub", "b").alias("l"), F.greatest("hub", "b").alias("g"))
    second = second.join(tested, (F.least("hub", "b") == F.col("l")) & (F.greatest("hub", "b") == F.col("g")), "left_anti")
    more = verified(estimated(materialize(second, "untested", narrow=True), named), sets)
    found = components(so_far.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more), "near")
    found = small(materialize(found, "components", narrow=True))
    by_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", F.col("n").alias("n_"), F.coalesce("component_id", "rep").alias("c"))
    return rows.join(by_class, (rows.s1 == by_class.s1) & (rows.s2 == by_class.s2) & (rows.n == by_class.n_), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"), F.expr("coalesce(c, doc_id) <=> doc_id").alias("kept")
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents."""
    return near_duplicates(texts(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that of least doc_id, with all columns of docs. Rows that share its doc_id stay."""
    found = materialize(near_duplicates(texts(docs)).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct(), "near-duplicates", narrow=True)
    return docs.join(small(found), F.col("doc_id") == F.col("gone_id"), "left_anti")
