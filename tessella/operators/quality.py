"""Distances between meshes and figures of compression."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import point_triangle_distance
from ..tables import written

#: Rounds of the search for far faces, at most.
LEVELS = 20
#: Faces that go to each task as a whole, at most; some 300 KB.
FEW_FACES = 4096


def triangles(faces: DataFrame, positions: DataFrame) -> DataFrame:
    """mesh_id, face_idx and ax to cz. positions: mesh_id, point_idx, x, y, z."""
    long = faces.select("mesh_id", "face_idx", F.posexplode(F.array("p0", "p1", "p2")).alias("k", "point_idx")).join(positions, ["mesh_id", "point_idx"])
    return long.groupBy("mesh_id", "face_idx").agg(*(F.max(F.when(F.col("k") == k, F.col(c).cast("double"))).alias(f"{v}{c}") for k, v in enumerate("abc") for c in "xyz"))


def nearest_face(points: DataFrame, tris: DataFrame, cell: float, rings: int = 1) -> DataFrame:
    """mesh_id, point_idx, dist: distance to the nearest face of the mesh, however far; null without such a face or with a place that is not finite.

    Points meet faces by an equi-join on grid cells: a face lies in all cells of its bounding box, a point looks in its cell
    and those around. Distances up to rings * cell are proven by that; points without one go down the tree of `far_face`.
    Where there are few faces in all, each task has them, and no point moves.
    """
    few = tris.where(_finite(f"{v}{c}" for v in "abc" for c in "xyz")).select("mesh_id", *(F.col(f"{v}{c}").cast("double") for v in "abc" for c in "xyz")).limit(FEW_FACES + 1).toArrow()
    if few.num_rows <= FEW_FACES:
        return _among(points, few)

    def cells(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long"))

    t = tris = tris.where(_finite(f"{v}{c}" for v in "abc" for c in "xyz"))
    for c in "xyz":
        corner = [F.col(f"{v}{c}") for v in "abc"]
        t = t.withColumn(f"g{c}", F.explode(cells(F.least(*corner), F.greatest(*corner))))
    sound = p = points.select("mesh_id", "point_idx", *(F.col(c).cast("double") for c in "xyz")).where(_finite("xyz"))
    for c in "xyz":
        p = p.withColumn(f"g{c}", F.explode(cells(F.col(c) - rings * cell, F.col(c) + rings * cell)))
    near = _least(p.join(t, ["mesh_id", "gx", "gy", "gz"])).where(F.col("dist") <= rings * cell)
    near = written(near, "near-faces")
    left = written(sound.join(near, ["mesh_id", "point_idx"], "left_anti"), "far-points")
    best = near.unionByName(far_face(left, tris, cell)) if left.limit(1).count() else near
    return points.select("mesh_id", "point_idx").join(best, ["mesh_id", "point_idx"], "left")


def _among(points: DataFrame, few: pa.Table) -> DataFrame:
    """nearest_face for faces that each task has: those whose box is nearer than some face's middle are measured."""
    mesh = np.array([-1 if m is None else m for m in few.column("mesh_id").to_pylist()], np.int64)
    known = few.column("mesh_id").is_valid().to_numpy()
    corners = np.stack([few.column(k).to_numpy() for k in range(1, 10)], 1).reshape(-1, 3, 3) if len(mesh) else np.zeros((0, 3, 3))
    own = {int(m): corners[known & (mesh == m)] for m in np.unique(mesh[known])}
    rows = points.select("mesh_id", "point_idx", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields[:2]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([-1 if m is None else m for m in batch.column(0).to_pylist()], np.int64)
            p = np.stack([batch.column(k).fill_null(float("nan")).to_numpy(zero_copy_only=False) for k in range(2, 5)], 1)
            sound = np.isfinite(p).all(1) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            dist, has = np.zeros(len(p)), np.zeros(len(p), bool)
            for m in np.unique(at[sound]).tolist():
                t = own.get(m)
                if t is None:
                    continue
                asked, step = np.flatnonzero(sound & (at == m)), max(1, 500_000 // len(t))
                for k in range(0, len(asked), step):
                    dist[asked[k : k + step]] = _nearest(p[asked[k : k + step]], t)
                has[asked] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dist, mask=~has)], ["mesh_id", "point_idx", "dist"])

    return rows.mapInArrow(run, f"mesh_id {types['mesh_id']}, point_idx {types['point_idx']}, dist double")


def _nearest(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The distance of each point to the nearest of some triangles."""
    low, high, middle = t.min(1), t.max(1), t.mean(1)
    least, most = np.zeros((len(p), len(t))), np.zeros((len(p), len(t)))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for c in range(3):
            x = p[:, c, None]
            gap = np.maximum(np.maximum(low[:, c] - x, x - high[:, c]), 0)
            least += gap * gap
            most += (x - middle[:, c]) ** 2
        rounding = 1e-14 * max(np.abs(p).max(), np.abs(t).max())
        bound = np.sqrt(most.min(1)) * (1 + 1e-9) + rounding
        point, face = np.nonzero(~(least > (bound * bound)[:, None]))
        d = triangle_distance(p[point], t[face])
    return np.fmin.reduceat(d, np.searchsorted(point, np.arange(len(p))))


def triangle_distance(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """functions.columns.point_triangle_distance for rows of points and triangles."""
    dot = lambda x, y: x[:, 0] * y[:, 0] + x[:, 1] * y[:, 1] + x[:, 2] * y[:, 2]

    def segment(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        d = v - u
        n = dot(d, d)
        along = np.where(n > 0, np.clip(dot(p - u, d) / np.where(n > 0, n, 1), 0.0, 1.0), 0.0)
        e = p - (u + d * along[:, None])
        return dot(e, e)

    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    ab, ac, ap = b - a, c - a, p - a
    n = np.cross(ab, ac)
    nn = dot(n, n)
    safe = np.where(nn > 0, nn, 1)
    w, v, height = dot(np.cross(ab, ap), n) / safe, dot(np.cross(ap, ac), n) / safe, dot(ap, n)
    inside = (nn > 0) & (w >= 0) & (v >= 0) & (v + w <= 1)
    return np.sqrt(np.where(inside, height * height / safe, np.minimum(np.minimum(segment(a, b), segment(b, c)), segment(c, a))))


def _finite(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in columns))


def _least(pairs: DataFrame) -> DataFrame:
    """The least distance of each point over its pairs with faces."""
    d = point_triangle_distance([F.col(c) for c in "xyz"], *([F.col(f"{v}{c}") for c in "xyz"] for v in "abc"))
    return pairs.select("mesh_id", "point_idx", d.alias("d")).groupBy("mesh_id", "point_idx").agg(F.min("d").alias("dist"))


def far_face(points: DataFrame, tris: DataFrame, cell: float) -> DataFrame:
    """mesh_id, point_idx, dist: the exact nearest face at any distance, down a tree of boxes; places must be finite.

    Each face lies in the cell of its middle, and a box bounds the faces of a cell; eight cells have a parent, up to one of a
    mesh. A point keeps the boxes whose nearest place is not beyond the farthest place of any box of that level, as a face
    lies in each. Cells are as large as a mesh's extent over 2 ** LEVELS at least, so that there are that many rounds at most.
    """
    for c in "xyz":
        corner = [F.col(f"{v}{c}") for v in "abc"]
        tris = tris.withColumn(f"l{c}", F.least(*corner)).withColumn(f"h{c}", F.greatest(*corner))
    around = tris.groupBy("mesh_id").agg(*(F.min(f"l{c}").alias(f"o{c}") for c in "xyz"), F.greatest(*(F.max(f"h{c}") - F.min(f"l{c}") for c in "xyz")).alias("extent"))
    around = written(around.select("*", F.greatest(F.lit(float(cell)), F.col("extent") / (1 << LEVELS)).alias("side")), "mesh-boxes")
    levels = int(around.agg(F.max(F.floor(F.col("extent") / F.col("side")))).first()[0] or 0).bit_length()
    place = [F.floor(((F.col(f"l{c}") + F.col(f"h{c}")) / 2 - F.col(f"o{c}")) / F.col("side")).cast("long").alias(f"g{c}") for c in "xyz"]
    faces = written(tris.join(around, "mesh_id").select("mesh_id", *place, *(f"{v}{c}" for v in "abclh" for c in "xyz")), "face-cells")
    bounds = [f(f"{v}{c}").alias(f"{v}{c}") for v, f in (("l", F.min), ("h", F.max)) for c in "xyz"]
    boxes = [written(faces.groupBy("mesh_id", "gx", "gy", "gz").agg(*bounds), "boxes")]
    for _ in range(levels):
        up = boxes[-1].select("mesh_id", *(F.shiftright(f"g{c}", 1).alias(f"g{c}") for c in "xyz"), *(f"{v}{c}" for v in "lh" for c in "xyz"))
        boxes.append(written(up.groupBy("mesh_id", "gx", "gy", "gz").agg(*bounds), "boxes"))
    x = [F.col(c) for c in "xyz"]
    low, high = ([F.col(f"{v}{c}") for c in "xyz"] for v in "lh")
    least = reduce(add, (F.pow(F.greatest(a - p, p - b, F.lit(0.0)), F.lit(2.0)) for p, a, b in zip(x, low, high, strict=True)))
    most = reduce(add, (F.pow(F.greatest(F.abs(p - a), F.abs(p - b)), F.lit(2.0)) for p, a, b in zip(x, low, high, strict=True)))
    front = points.select("mesh_id", "point_idx", "x", "y", "z", *(F.lit(0).cast("long").alias(f"u{c}") for c in "xyz"))
    for level in reversed(boxes):
        down = level.select("*", *(F.shiftright(f"g{c}", 1).alias(f"u{c}") for c in "xyz"))
        met = front.join(down, ["mesh_id", "ux", "uy", "uz"]).withColumn("least", least)
        met = met.withColumn("bound", F.min(most).over(Window.partitionBy("mesh_id", "point_idx"))).where(F.col("least") <= F.col("bound") * (1 + 1e-9))
        front = written(met.select("mesh_id", "point_idx", "x", "y", "z", *(F.col(f"g{c}").alias(f"u{c}") for c in "xyz")), "boxes-of-points")
    return _least(front.select("mesh_id", "point_idx", "x", "y", "z", *(F.col(f"u{c}").alias(f"g{c}") for c in "xyz")).join(faces, ["mesh_id", "gx", "gy", "gz"]))


def squared_distance(points: DataFrame, tris: DataFrame, cell: float, rings: int = 1) -> DataFrame:
    """mesh_id, total (sum of squares of the distances; null if one is missed), missed (points without any face, or not finite)."""
    near = nearest_face(points, tris, cell, rings)
    missed = F.count_if(F.col("dist").isNull())
    return near.groupBy("mesh_id").agg(F.when(missed == 0, F.sum(F.col("dist") * F.col("dist"))).alias("total"), missed.alias("missed"))


def l2_distance(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], cell: float, rings: int = 1) -> DataFrame:
    """Symmetric distance of meshes by id; each side is (faces, positions)."""
    there = squared_distance(a[1], triangles(*b), cell, rings).select("mesh_id", F.col("total").alias("t1"), F.col("missed").alias("m1"))
    back = squared_distance(b[1], triangles(*a), cell, rings).select("mesh_id", F.col("total").alias("t2"), F.col("missed").alias("m2"))
    return there.join(back, "mesh_id").select("mesh_id", F.sqrt(F.col("t1") + F.col("t2")).alias("l2"), (F.col("m1") + F.col("m2")).alias("missed"))


def compression(before: Column, after: Column) -> tuple[Column, Column]:
    """Ratio and percentage saved; null where nothing was stored."""
    ratio = F.try_divide(before.cast("double"), after.cast("double"))
    return ratio, F.try_divide((before - after).cast("double"), before.cast("double")) * 100


def spectra(faces: DataFrame, digits: int = 6) -> DataFrame:
    """mesh_id, spectrum: eigenvalues of the Laplacian of edges, ascending. Equal for meshes that differ by names of points only.

    A mesh is a group of an Arrow function: this is for small meshes, as the matrix has edges squared entries.
    """

    def run(group: pa.Table) -> pa.Table:
        t = np.stack([group.column(c).to_numpy() for c in ("p0", "p1", "p2")], 1)
        pairs = np.sort(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]]), 1)
        edges, at = np.unique(pairs, axis=0, return_inverse=True)
        points = np.unique(edges)
        down, up = np.zeros((len(points), len(edges))), np.zeros((len(edges), len(t)))
        for k in range(2):
            down[np.searchsorted(points, edges[:, k]), np.arange(len(edges))] = 2 * k - 1
        for k, (a, b) in enumerate(((0, 1), (1, 2), (2, 0))):
            up[at.reshape(-1)[k * len(t) : (k + 1) * len(t)], np.arange(len(t))] = np.where(t[:, a] < t[:, b], 1, -1)
        values = np.linalg.eigvalsh(down.T @ down + up @ up.T).round(digits) + 0.0
        return pa.table({"mesh_id": group.column("mesh_id")[:1], "spectrum": pa.array([values.tolist()], pa.list_(pa.float64()))})

    return faces.select("mesh_id", "p0", "p1", "p2").groupBy("mesh_id").applyInArrow(run, "mesh_id long, spectrum array<double>")
