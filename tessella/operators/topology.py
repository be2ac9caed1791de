"""Adjacency of faces: corners, opposite corners, edges, seams, fans, loops and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import next_corner, previous_corner
from ..tables import written


def corners(faces: DataFrame) -> DataFrame:
    """mesh_id, corner, face_idx, tip, src, snk: the edge opposite to a corner runs from src to snk."""
    p = [F.col(c) for c in ("p0", "p1", "p2")]
    rows = F.array(*(F.struct(F.lit(k).alias("k"), p[k].alias("tip"), p[(k + 1) % 3].alias("src"), p[(k + 2) % 3].alias("snk")) for k in range(3)))
    out = faces.select("mesh_id", "face_idx", F.inline(rows))
    return out.select("mesh_id", (F.col("face_idx") * 3 + F.col("k")).alias("corner"), "face_idx", "tip", "src", "snk")


def opposite(faces: DataFrame) -> DataFrame:
    """corners and opp (null on a boundary): in order of corners, each half-edge pairs with the first reversed one that still waits and has another tip.

    Degenerate faces have no opposites. An edge of two half-edges is settled by aggregates over it, without a join; edges of more
    are walked in order, an edge by one task that holds two numbers for each half-edge that waits.
    """
    edge = Window.partitionBy("mesh_id", "a", "b")
    sound = (F.col("tip") != F.col("src")) & (F.col("src") != F.col("snk")) & (F.col("snk") != F.col("tip"))
    own = lambda c: F.when(sound, F.col(c))
    c = corners(faces).withColumn("a", F.least("src", "snk")).withColumn("b", F.greatest("src", "snk"))
    c = c.withColumn("n", F.count_if(sound).over(edge)).withColumn("other", F.sum(own("corner")).over(edge) - F.col("corner"))
    unlike = (F.min(own("tip")).over(edge) != F.max(own("tip")).over(edge)) & (F.min(own("src")).over(edge) != F.max(own("src")).over(edge))
    c = c.withColumn("pair", F.when(sound & (F.col("n") == 2) & unlike, F.col("other")))
    walked = _waiting(c.where(sound & (F.col("n") > 2)).select("mesh_id", "a", "b", "corner", "src", "tip"))
    out = c.select("mesh_id", "corner", "face_idx", "tip", "src", "snk", "pair").join(walked, ["mesh_id", "corner"], "left")
    return out.select("mesh_id", "corner", "face_idx", "tip", "src", "snk", F.coalesce("pair", "mate").alias("opp"))


def _waiting(half_edges: DataFrame) -> DataFrame:
    """mesh_id, corner, mate: half-edges of crowded edges, each with the first waiting one of the other direction and another tip."""
    rows = half_edges.repartition("mesh_id", "a", "b").sortWithinPartitions("mesh_id", "a", "b", "corner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waits = None, {}
        for batch in batches:
            out: list[tuple] = []
            for mesh, a, b, corner, src, tip in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (mesh, a, b) != at:
                    at, waits = (mesh, a, b), {a: [], b: []}
                row = waits[b if src == a else a]
                mate = next((k for k, (_, t) in enumerate(row) if t != tip), None)
                if mate is None:
                    waits[src].append((corner, tip))
                else:
                    other, _ = row.pop(mate)
                    out += [(mesh, corner, other), (mesh, other, corner)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["mesh_id", "corner", "mate"])

    return rows.mapInArrow(run, "mesh_id long, corner long, mate long")


def swings(adjacent: DataFrame) -> DataFrame:
    """mesh_id, corner, swing: the corner of the same vertex in the face over the edge opposite to the next corner. A face's corners meet by face."""
    own = F.struct("corner", "opp")
    face = adjacent.groupBy("mesh_id", "face_idx").agg(*(F.max(F.when(F.col("corner") % 3 == k, own)).alias(f"c{k}") for k in range(3)))
    rows = F.array(*(F.struct(F.col(f"c{k}.corner").alias("corner"), next_corner(F.col(f"c{(k + 1) % 3}.opp")).alias("swing")) for k in range(3)))
    return face.select("mesh_id", F.inline(rows))


def edges(faces: DataFrame) -> DataFrame:
    """mesh_id, a < b, uses: undirected edges and how many faces have them."""
    return corners(faces).groupBy("mesh_id", F.least("src", "snk").alias("a"), F.greatest("src", "snk").alias("b")).agg(F.count(F.lit(1)).alias("uses"))


def edge_report(faces: DataFrame) -> DataFrame:
    e = edges(faces)
    return e.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("uses") == 1).alias("boundary_edges"), F.count_if(F.col("uses") > 2).alias("nonmanifold_edges"))


def valence(faces: DataFrame) -> DataFrame:
    """mesh_id, vertex, corners, neighbours."""
    c = corners(faces)
    count = c.groupBy("mesh_id", F.col("tip").alias("vertex")).agg(F.count(F.lit(1)).alias("corners"))
    e = edges(faces).where("a <> b")
    near = e.select("mesh_id", F.explode(F.array("a", "b")).alias("vertex")).groupBy("mesh_id", "vertex").agg(F.count(F.lit(1)).alias("neighbours"))
    return count.join(near, ["mesh_id", "vertex"], "left").select("mesh_id", "vertex", "corners", F.coalesce("neighbours", F.lit(0)).cast("long").alias("neighbours"))


def seams(adjacent: DataFrame, corner_values: DataFrame) -> DataFrame:
    """adjacent (of opposite()) with is_seam: a boundary, or an edge whose ends have other values in its two faces.

    corner_values: mesh_id, corner, val.
    """
    # the three values of a face on one row, so that a corner meets them with its own face and once with the opposite one
    k = F.col("corner") % 3
    face = corner_values.groupBy("mesh_id", F.expr("corner div 3").alias("face_")).agg(*(F.max(F.when(k == i, F.struct("val"))).alias(f"v{i}") for i in range(3)))
    c, o = F.col("corner"), F.col("opp")
    x = adjacent.withColumn("face_", F.expr("corner div 3")).join(face, ["mesh_id", "face_"], "left")
    x = x.withColumn("own_", F.array("v0", "v1", "v2")).drop("face_", "v0", "v1", "v2").withColumn("face_", F.expr("opp div 3"))
    x = x.join(face, ["mesh_id", "face_"], "left").withColumn("their_", F.array("v0", "v1", "v2"))
    at = lambda values, corner: F.get(values, (corner % 3).cast("int"))["val"]
    same = at("own_", next_corner(c)).eqNullSafe(at("their_", previous_corner(o))) & at("own_", previous_corner(c)).eqNullSafe(at("their_", next_corner(o)))
    return x.select(*adjacent.columns, (o.isNull() | ~same).alias("is_seam"))


def least_labels(nodes: DataFrame, links: DataFrame, label: str, rounds: int = 64) -> DataFrame:
    """nodes: mesh_id, node; links: mesh_id, a, b. mesh_id, node, label (the least node reachable).

    Labels go over the links and then jump to the label's label, so rounds grow with the logarithm of the longest path.
    """
    both = written(links.select("mesh_id", "a", "b").unionByName(links.select("mesh_id", F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), label)
    now = written(nodes.select("mesh_id", "node", F.col("node").alias("label")), label)
    for _ in range(rounds):
        near = both.join(now.select("mesh_id", F.col("node").alias("b"), "label"), ["mesh_id", "b"]).groupBy("mesh_id", F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = now.join(near, ["mesh_id", "node"], "left").select("mesh_id", "node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = least.select("mesh_id", F.col("node").alias("new"), F.col("new").alias("top"))
        after = written(least.join(jump, ["mesh_id", "new"]).select("mesh_id", "node", F.col("label").alias("old"), F.least("new", "top").alias("label")), label)
        moved = after.where("old <> label").limit(1).count()
        now = after.select("mesh_id", "node", "label")
        if not moved:
            return now
    raise RuntimeError(f"labels of {label} did not settle in {rounds} rounds")


def face_components(adjacent: DataFrame) -> DataFrame:
    """mesh_id, face_idx, component: the least face reachable over shared edges."""
    links = adjacent.where("opp IS NOT NULL").select("mesh_id", F.col("face_idx").alias("a"), F.expr("opp div 3").alias("b"))
    out = least_labels(adjacent.select("mesh_id", F.col("face_idx").alias("node")).distinct(), links, "face-components")
    return out.select("mesh_id", F.col("node").alias("face_idx"), F.col("label").alias("component"))


#: Corners that are put together in one go, at least; a vertex is not divided.
FAN_ROWS = 100_000


def fans(adjacent: DataFrame, cut: bool = False) -> DataFrame:
    """mesh_id, corner, fan: the least corner of the fan around a vertex, by swinging over shared edges (with cut, not over seams).

    Each fan is a vertex of its own: a vertex that two separate fans share splits. A fan lies around one vertex, so corners meet
    by vertex, once: each has at most one corner on its left, and chains of these are closed by doubling. A task holds two numbers
    for each corner of a vertex.
    """
    c, o = F.col("corner"), F.col("opp")
    over = F.when(o.isNotNull() & ~F.col("is_seam"), o) if cut else o
    links = adjacent.select("mesh_id", F.col("snk").alias("v"), previous_corner(c).alias("corner"), next_corner(over).alias("left"))
    rows = links.repartition("mesh_id", "v").sortWithinPartitions("mesh_id", "v")

    def closed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        mesh, corner = t.column("mesh_id").to_numpy(), t.column("corner").to_numpy()
        left = t.column("left").fill_null(-1).to_numpy()
        order = np.lexsort((corner, mesh))
        # places of (mesh, left) among (mesh, corner)
        both = np.stack([mesh[order], corner[order]])
        number = np.cumsum(np.concatenate([[0], (both[0, 1:] != both[0, :-1]).astype(np.int64)])) if len(order) else np.zeros(0, np.int64)
        top = int(max(corner.max(initial=0), left.max(initial=0))) + 1
        keys = number * top + both[1]
        asked = number * top + left[order]
        at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
        has = (left[order] >= 0) & (keys[at] == asked) if len(keys) else np.zeros(0, bool)
        ahead = np.where(has, at, np.arange(len(keys)))
        back = np.arange(len(keys))
        back[at[has]] = np.flatnonzero(has)
        least = np.arange(len(keys))
        for _ in range(len(keys).bit_length() + 1):
            least = np.minimum(least, np.minimum(least[ahead], least[back]))
            ahead, back = ahead[ahead], back[back]
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(both[1][least])], ["mesh_id", "corner", "fan"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if n >= FAN_ROWS and batch.num_rows:  # up to where the vertex changes
                key = np.stack([batch.column(k).to_numpy() for k in range(2)])
                last = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in range(2)]
                other = np.flatnonzero((key != np.array(last)[:, None]).any(0))
                if len(other):
                    yield closed([*held, batch.slice(0, int(other[0]))])
                    batch, held, n = batch.slice(int(other[0])), [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield closed(held)

    return rows.mapInArrow(run, "mesh_id long, corner long, fan long")


def split_vertices(adjacent: DataFrame, fan: DataFrame) -> DataFrame:
    """mesh_id, fan, vertex: the first fan of a vertex keeps its id, others get new ids at the end in order of corners."""
    f = adjacent.select("mesh_id", "corner", "tip").join(fan, ["mesh_id", "corner"]).groupBy("mesh_id", "fan").agg(F.min("tip").alias("tip"))
    f = f.withColumn("rn", F.row_number().over(Window.partitionBy("mesh_id", "tip").orderBy("fan")))
    top = f.groupBy("mesh_id").agg((F.max("tip") + 1).alias("n"))
    extra = f.where("rn > 1").withColumn("k", F.row_number().over(Window.partitionBy("mesh_id").orderBy("fan")) - 1)
    out = f.join(extra.select("mesh_id", "fan", "k"), ["mesh_id", "fan"], "left").join(top, "mesh_id")
    return out.select("mesh_id", "fan", F.when(F.col("rn") == 1, F.col("tip")).otherwise(F.col("n") + F.col("k")).alias("vertex"))


def boundary_loops(adjacent: DataFrame) -> DataFrame:
    """mesh_id, corner, loop: boundary half-edges (the corners that face them), joined where they end the same fan: loops that only touch at a vertex stay apart."""
    b = adjacent.where("opp IS NULL AND tip <> src AND src <> snk AND snk <> tip")
    c = F.col("corner")
    ends = b.select("mesh_id", "corner", F.explode(F.array(next_corner(c), previous_corner(c))).alias("end_"))
    ends = written(ends.join(fans(adjacent).select("mesh_id", F.col("corner").alias("end_"), "fan"), ["mesh_id", "end_"]), "boundary-ends")
    hub = ends.groupBy("mesh_id", "fan").agg(F.min("corner").alias("hub"))
    links = ends.join(hub, ["mesh_id", "fan"]).select("mesh_id", F.col("corner").alias("a"), F.col("hub").alias("b"))
    out = least_labels(b.select("mesh_id", F.col("corner").alias("node")), links, "boundary-loops")
    return out.select("mesh_id", F.col("node").alias("corner"), F.col("label").alias("loop"))
