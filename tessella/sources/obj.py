"""OBJ files as points and faces. Files are read by Spark, whole, each by one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, kind string, idx long, p0 long, p1 long, p2 long, x float, y float, z float, nx float, ny float, nz float, u float, v float"


def parse(text: str) -> tuple[list[dict], list[tuple[int, int, int]]]:
    """Points (one for each distinct v/vt/vn, in order of first use) and triangles (polygons as fans) of the first model."""
    lists: dict[str, list[list[float]]] = {"v": [], "vt": [], "vn": []}
    names: dict[tuple, int] = {}
    points, triangles, models = [], [], 0
    for line in text.replace("\\\n", " ").splitlines():
        words = line.split("#", 1)[0].split()
        if not words:
            continue
        if words[0] in lists:
            lists[words[0]].append([float(x) for x in words[1:4]])
        elif words[0] in ("o", "g") and triangles:
            models += 1
        elif words[0] == "f" and not models:
            own = []
            for ref in words[1:]:
                parts = (ref.split("/") + ["", ""])[:3]
                key = tuple((int(p) - 1 if int(p) > 0 else len(lists[k]) + int(p)) if p else None for p, k in zip(parts, ("v", "vt", "vn"), strict=True))
                if key not in names:
                    names[key] = len(points)
                    p = dict(zip("xyz", lists["v"][key[0]], strict=True))
                    if key[1] is not None:
                        p |= dict(zip("uv", lists["vt"][key[1]][:2], strict=True))
                    if key[2] is not None:
                        p |= dict(zip(("nx", "ny", "nz"), lists["vn"][key[2]], strict=True))
                    points.append(p)
                own.append(names[key])
            triangles += [(own[0], own[k], own[k + 1]) for k in range(1, len(own) - 1)]
    return points, triangles


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """Rows of both kinds: point (idx, x to v) and face (idx, p0 to p2)."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "float": pa.float32()}
    types = [kinds[f.split()[1]] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                points, triangles = parse(body.as_py().decode())
                rows = [{"kind": "point", "idx": k, **p} for k, p in enumerate(points)] + [{"kind": "face", "idx": k, "p0": t[0], "p1": t[1], "p2": t[2]} for k, t in enumerate(triangles)]
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), *(pa.array([r.get(c) for r in part], t) for c, t in zip(names[1:], types[1:], strict=True))], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.obj").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def meshes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """faces and points with a mesh_id by file (a hash of its name)."""
    m = rows.withColumn("mesh_id", F.xxhash64("file"))
    points = m.where("kind = 'point'").select("mesh_id", F.col("idx").alias("point_idx"), "x", "y", "z", "nx", "ny", "nz", "u", "v")
    return m.where("kind = 'face'").select("mesh_id", F.col("idx").alias("face_idx"), "p0", "p1", "p2"), points
