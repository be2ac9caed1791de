"""glTF documents over the driver's tables, one a customer with orders, and the queries that read them.

Nodes are a customer's orders; the buffer holds their keys as 32-bit integers, read by accessors of several types and strides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import base64
from ..sources import gltf
from ..tables import table
from .catalog import query


def _little(column):
    """A 32-bit integer as eight hexadecimal digits, the low byte first."""
    h = F.lpad(F.hex(column), 8, "0")
    return F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))


def scenes(spark: SparkSession, sf_dir: str, external: bool = False) -> DataFrame:
    """path, content and, for external buffers, place and buffer."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(c, F.struct(k.alias("key"), F.col("o_orderpriority").alias("name"), F.when(k % 7 != 0, k % 3).alias("mesh"), F.array(*(x.cast("double") for x in (k % 100, c % 10, F.lit(1)))).alias("translation")).alias("o"))
    own = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o")).alias("o")).withColumn("n", F.size("o"))
    nodes = F.transform("o", lambda o: o.dropFields("key"))
    buffer = F.unhex(F.array_join(F.transform("o", lambda o: _little(o["key"])), ""))
    uri = F.concat(F.lit("keys-"), c.cast("string"), F.lit(".bin")) if external else F.concat(F.lit("data:application/octet-stream;base64,"), base64(buffer))
    # mesh m has m + 1 primitives; the normals' accessor differs by primitive
    primitive = lambda m, p: F.struct(
        F.struct(F.lit(0).alias("POSITION"), F.lit(1 + p % 2).alias("NORMAL")).alias("attributes"), F.when((c + m + p) % 3 != 0, (c + m + p) % 2).alias("material"),
    )
    meshes = F.array(*(F.struct(F.array(*(primitive(m, p) for p in range(m + 1))).alias("primitives")) for m in range(3)))
    texture = lambda at: F.struct(at.cast("int").alias("index"))
    material = lambda name, pbr, normal, extensions: F.struct(F.lit(name).alias("name"), pbr.alias("pbrMetallicRoughness"), normal.alias("normalTexture"), extensions.alias("extensions"))
    pbr = lambda metallic, colour: F.struct(metallic.alias("metallicFactor"), colour.alias("baseColorTexture"))
    none = F.lit(None).cast("struct<index:int>")
    unlit = F.when(c % 2 == 0, F.map_from_arrays(F.array(F.lit("KHR_materials_unlit")), F.array(F.create_map().cast("map<string,string>"))))
    materials = F.array(
        material("m0", pbr(F.lit(0.5), F.when(c % 4 != 0, texture(c % 4))), none, F.lit(None).cast("map<string,map<string,string>>")),
        material("m1", pbr(F.lit(None).cast("double"), none), texture(c % 3), unlit),
    )
    accessor = lambda view, kind, shape, count: F.struct(F.lit(view).alias("bufferView"), F.lit(kind).alias("componentType"), F.lit(shape).alias("type"), count.cast("int").alias("count"))
    accessors = F.array(accessor(0, 5125, "SCALAR", F.col("n")), accessor(0, 5123, "VEC2", F.col("n")), accessor(1, 5121, "SCALAR", F.ceil(F.col("n") / 2)))
    view = lambda stride: F.struct(F.lit(0).alias("buffer"), F.lit(stride).cast("int").alias("byteStride"), (4 * F.col("n")).alias("byteLength"))
    doc = F.struct(
        F.struct(F.lit("2.0").alias("version")).alias("asset"), nodes.alias("nodes"), meshes.alias("meshes"), materials.alias("materials"), accessors.alias("accessors"),
        F.array(view(None), view(8)).alias("bufferViews"), F.array(F.struct((4 * F.col("n")).alias("byteLength"), uri.alias("uri"))).alias("buffers"),
    )
    out = own.select(F.concat(F.lit("scenes/"), c.cast("string"), F.lit(".gltf")).alias("path"), F.encode(F.to_json(doc), "UTF-8").alias("content"), *([F.concat(F.lit("scenes/"), uri).alias("place"), buffer.alias("buffer")] if external else []))
    return out


_FILES = "f AS (SELECT o_custkey AS c, 'scenes/' || o_custkey || '.gltf' AS file FROM orders GROUP BY ALL)"
_NODES = "nodes AS (SELECT 'scenes/' || o_custkey || '.gltf' AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, o_orderkey AS k, o_custkey AS c, o_orderpriority AS name, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 3 END AS mesh FROM orders)"
_PARTS = "parts AS (SELECT file, c, m, p, CASE WHEN (c + m + p) % 3 <> 0 THEN (c + m + p) % 2 END AS material FROM f, (VALUES (0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)) v(m, p))"
_MATERIALS = """materials AS (SELECT file, 0::BIGINT AS material, 'm0' AS name, 0.5::DOUBLE AS metallic, CASE WHEN c % 4 <> 0 THEN (c % 4)::INT END AS color_texture, NULL::INT AS normal_texture, false AS unlit FROM f
  UNION ALL SELECT file, 1, 'm1', 1.0, NULL, (c % 3)::INT, c % 2 = 0 FROM f)"""
_ACCESSORS = """WITH o AS (SELECT 'scenes/' || o_custkey || '.gltf' AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, o_orderkey AS k FROM orders)
SELECT path, 0::BIGINT AS accessor, r AS "row", k::DOUBLE AS a, NULL::DOUBLE AS b FROM o
UNION ALL SELECT path, 1, r, (k % 65536)::DOUBLE, (k // 65536)::DOUBLE FROM o
UNION ALL SELECT path, 2, r // 2, (k % 256)::DOUBLE, NULL FROM o WHERE r % 2 = 0"""


@query(f"WITH {_NODES} SELECT file, idx, name, mesh, (k % 100)::DOUBLE AS tx, (c % 10)::DOUBLE AS ty FROM nodes")
def gltf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("matrix")
    return gltf.tables(scenes(spark, sf_dir)).where("kind = 'node'").select("file", "idx", "name", "mesh", m[3].alias("tx"), m[7].alias("ty"))


@query(f"WITH {_FILES}, {_NODES}, {_PARTS} SELECT DISTINCT n.file, n.idx AS node, n.mesh, p.material FROM nodes n JOIN parts p ON n.file = p.file AND n.mesh = p.m")
def gltf_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gltf.instances(gltf.tables(scenes(spark, sf_dir)))


@query(f"WITH {_FILES}, {_MATERIALS} SELECT *, 1.0::DOUBLE AS roughness, false AS double_sided, 'OPAQUE' AS alpha_mode, 0.5::DOUBLE AS alpha_cutoff FROM materials")
def gltf_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = gltf.materials(gltf.tables(scenes(spark, sf_dir)))
    return m.select("file", "material", "name", "metallic", "color_texture", "normal_texture", "unlit", "roughness", "double_sided", "alpha_mode", "alpha_cutoff")


@query(f"""WITH {_FILES}, {_MATERIALS} SELECT file, texture, max(n)::INT AS channels FROM (SELECT file, color_texture AS texture, 4 AS n FROM materials UNION ALL SELECT file, normal_texture, 3 FROM materials)
WHERE texture IS NOT NULL GROUP BY ALL""")
def gltf_texture_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gltf.texture_uses(gltf.materials(gltf.tables(scenes(spark, sf_dir))))


@query(f"WITH {_FILES} SELECT file, 'NORMAL' AS name, 2::BIGINT AS kinds FROM f")
def gltf_type_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gltf.type_conflicts(gltf.tables(scenes(spark, sf_dir)))


@query(f"WITH {_FILES} SELECT file, 'KHR_materials_unlit' AS extensions FROM f WHERE c % 2 = 0")
def gltf_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gltf.extension_names(gltf.tables(scenes(spark, sf_dir))).select("file", F.array_join("extensions", ",").alias("extensions"))


def _accessors(docs: DataFrame) -> DataFrame:
    return gltf.accessor_rows(docs).select("path", "accessor", "row", F.get("value", F.lit(0)).alias("a"), F.get("value", F.lit(1)).alias("b"))


@query(_ACCESSORS)
def gltf_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessors of 32-bit scalars, 16-bit pairs and 8-bit scalars at a stride, in buffers of data URIs."""
    return _accessors(scenes(spark, sf_dir))


@query(_ACCESSORS)
def gltf_external_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from buffers in files of their own."""
    s = scenes(spark, sf_dir, external=True)
    return _accessors(gltf.gathered(s, s.select(F.col("place").alias("path"), F.col("buffer").alias("content"))))


@query(f"WITH {_FILES} SELECT file AS path, 'keys-' || c || '.bin' AS uri, 'scenes/keys-' || c || '.bin' AS place FROM f")
def gltf_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gltf.dependencies(scenes(spark, sf_dir, external=True))
