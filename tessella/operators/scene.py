"""Scene graphs: closure, world transforms, instances, textures, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import matrix_multiply
from ..tables import written


def closure(edges: DataFrame, key: str = "scene_id", rounds: int = 32) -> DataFrame:
    """key, ancestor, node, depth: each way down, by doubling: ways of up to 2**k edges are joined with each other."""
    ways = edges.where("parent IS NOT NULL").select(key, F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("depth"))
    ways, longest = written(ways, "closure"), 1
    for _ in range(rounds):
        on = ways.where(F.col("depth") == longest).select(key, F.col("ancestor").alias("mid"), F.col("node").alias("n2"), F.col("depth").alias("d2"))
        more = ways.select(key, "ancestor", F.col("node").alias("mid"), F.col("depth").alias("d1")).join(on, [key, "mid"]).select(key, "ancestor", F.col("n2").alias("node"), (F.col("d1") + F.col("d2")).alias("depth"))
        new = written(more, "closure")
        if not new.limit(1).count():
            return ways
        ways, longest = written(ways.unionByName(new), "closure"), longest * 2
    raise RuntimeError("the scene graph is deeper than it can be, or has a cycle")


def world_matrices(nodes: DataFrame, key: str = "scene_id", rounds: int = 64) -> DataFrame:
    """nodes: key, node, parent (null: a root), m (16 doubles). Adds world: the product of the matrices from the root down.

    Pointer doubling: each node has the product up to some ancestor; joining with that ancestor's doubles the way.
    """
    now = written(nodes.select(key, "node", F.col("parent").alias("up"), F.col("m").alias("world")), "world")
    for _ in range(rounds):
        if not now.where("up IS NOT NULL").limit(1).count():
            return nodes.join(now.select(key, "node", "world"), [key, "node"])
        top = now.select(key, F.col("node").alias("up"), F.col("up").alias("next"), F.col("world").alias("w"))
        both = now.join(top, [key, "up"], "left")
        now = written(both.select(key, "node", F.when(F.col("up").isNotNull(), F.col("next")).alias("up"), F.when(F.col("w").isNull(), F.col("world")).otherwise(matrix_multiply(F.col("w"), F.col("world"))).alias("world")), "world")
    raise RuntimeError("the scene graph has a cycle")


def distinct_instances(instances: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Instances (mesh_idx, material_idx) once each, the first by ordinal, numbered in that order."""
    first = instances.groupBy(*keys, "mesh_idx", "material_idx").agg(F.min(ordinal).alias(ordinal))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal)) - 1)


def dense_ids(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """id of each distinct value (such as a sampler), 0 for the least."""
    return rows.withColumn("id", F.dense_rank().over(Window.partitionBy(*keys).orderBy(value)) - 1)


def running_offsets(parts: DataFrame, keys: list[str], ordinal: str, length: str, align: int = 4) -> DataFrame:
    """Adds offset: where each part starts if all are laid one after another, padded."""
    w = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum((F.ceil(F.col(length) / align) * align).cast("long")).over(w), F.lit(0)).cast("long"))


def counted_before(rows: DataFrame, keys: list[str], ordinal: str, flag: str) -> DataFrame:
    """Adds number: of the rows with the flag, those before this one (null without the flag)."""
    w = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("number", F.when(F.col(flag), F.count_if(F.col(flag)).over(w)))
