"""glTF and GLB: parsing, tables of a document, geometry of primitives, and writing with compressed primitives.

Documents are binary values, so files come from spark.read.format("binaryFile") wherever they lie.
"""

from __future__ import annotations

import base64
import json
import posixpath
import re
import struct
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import COMPONENT_SIZES, IDENTITY, TYPE_COMPONENTS
from . import drc

#: Fixed values of the formats.
GLB_MAGIC, GLB_VERSION, JSON_CHUNK, BIN_CHUNK = 0x46546C67, 2, 0x4E4F534A, 0x004E4942
COMPRESSION = "KHR_draco_mesh_compression"
KNOWN = {"KHR_materials_unlit", "KHR_texture_transform", "KHR_materials_variants", "KHR_lights_punctual", "EXT_mesh_features", "EXT_structural_metadata", "EXT_texture_webp", "EXT_mesh_gpu_instancing", "KHR_mesh_quantization", "KHR_materials_specular", "KHR_materials_ior"}
DTYPES = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}


def parse(data: bytes, files: Callable[[str], bytes] | None = None) -> tuple[dict, list[bytes]]:
    """The document and its buffers. Buffers are the GLB's own, data URIs, or what files(uri) gives."""
    own = b""
    if data[:4] == b"glTF":
        magic, version, length = struct.unpack_from("<III", data)
        if version != GLB_VERSION or length > len(data):
            raise ValueError("a GLB file of another version, or cut short")
        at, doc = 12, None
        while at + 8 <= length:
            size, kind = struct.unpack_from("<II", data, at)
            body = data[at + 8 : at + 8 + size]
            if kind == JSON_CHUNK:
                doc = json.loads(body)
            elif kind == BIN_CHUNK:
                own = body
            at += 8 + size
        if doc is None:
            raise ValueError("a GLB file without a document")
    else:
        doc = json.loads(data)
    return doc, [own if "uri" not in b else resolve(b["uri"], files) for b in doc.get("buffers", [])]


def resolve(uri: str, files: Callable[[str], bytes] | None = None) -> bytes:
    if uri.startswith("data:"):
        return base64.b64decode(uri.split(",", 1)[1])
    if files is None:
        raise ValueError(f"no way to read {uri}")
    return files(uri)


def uris(node) -> Iterator[str]:
    """All uri members of a document, at any depth, other than data."""
    if isinstance(node, dict):
        for k, v in node.items():
            if k == "uri" and isinstance(v, str) and not v.startswith("data:"):
                yield v
            else:
                yield from uris(v)
    elif isinstance(node, list):
        for v in node:
            yield from uris(v)


def unsupported(doc: dict) -> list[str]:
    """What a document needs that can't be read."""
    out = [f"extension {e}" for e in doc.get("extensionsRequired", []) if e not in KNOWN]
    out += ["sparse accessor" for a in doc.get("accessors", []) if "sparse" in a]
    out += ["morph targets" for m in doc.get("meshes", []) for p in m.get("primitives", []) if p.get("targets")]
    out += [f"primitive mode {p['mode']}" for m in doc.get("meshes", []) for p in m.get("primitives", []) if p.get("mode", 4) != 4]
    return sorted(set(out))


def accessor(doc: dict, buffers: list[bytes], index: int) -> np.ndarray:
    """Rows of an accessor, strided or not. Rows beyond the buffer are an error."""
    a = doc["accessors"][index]
    n, k, kind = a["count"], TYPE_COMPONENTS[a["type"]], a["componentType"]
    if "bufferView" not in a:
        return np.zeros((n, k), DTYPES[kind])
    view = doc["bufferViews"][a["bufferView"]]
    size = COMPONENT_SIZES[kind] * k
    step, start = view.get("byteStride", size), view.get("byteOffset", 0) + a.get("byteOffset", 0)
    buffer = buffers[view["buffer"]]
    if n and start + step * (n - 1) + size > len(buffer):
        raise ValueError(f"accessor {index} reaches beyond its buffer")
    rows = np.lib.stride_tricks.as_strided(np.frombuffer(buffer, np.uint8)[start:], (n, size), (step, 1)) if n else np.zeros((0, size), np.uint8)
    return np.ascontiguousarray(rows).view(DTYPES[kind]).reshape(n, k)


def primitive(doc: dict, buffers: list[bytes], p: dict) -> tuple[list[tuple], list[drc.Attribute], list[str]]:
    """Triangles, attributes and their names in the document. Without indices, points follow one another."""
    if COMPRESSION in p.get("extensions", {}):
        raise ValueError("a primitive that is compressed already")
    names = p["attributes"]
    position = accessor(doc, buffers, names["POSITION"]).astype(np.float32)
    index = accessor(doc, buffers, p["indices"])[:, 0].astype(np.int64) if "indices" in p else np.arange(len(position))
    attributes, kept = [drc.Attribute("POSITION", position)], ["POSITION"]
    for name in sorted(names):
        kind = "NORMAL" if name == "NORMAL" else "TEXTURE_COORDINATE" if name == "TEXCOORD_0" else "CUSTOM" if name.startswith("_FEATURE_ID_") else None
        if kind:
            attributes.append(drc.Attribute(kind, accessor(doc, buffers, names[name]).astype(np.int64 if kind == "CUSTOM" else np.float32), 1))
            kept.append(name)
    return [tuple(t) for t in index[: len(index) // 3 * 3].reshape(-1, 3).tolist()], attributes, kept


def node_matrix(node: dict) -> list[float]:
    """16 numbers row by row; documents store matrices column by column."""
    if "matrix" in node:
        m = np.array(node["matrix"], float).reshape(4, 4).T
    else:
        x, y, z, w = node.get("rotation", [0, 0, 0, 1])
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        m = np.array(IDENTITY).reshape(4, 4)
        m[:3, :3] = r * np.array(node.get("scale", [1, 1, 1]), float)
        m[:3, 3] = node.get("translation", [0, 0, 0])
    return m.reshape(-1).tolist()


def glb(doc: dict, body: bytes) -> bytes:
    """A GLB container: the document padded with blanks, the buffer with zeros."""
    text = json.dumps(doc, separators=(",", ":"), ensure_ascii=False).encode()
    text += b" " * (-len(text) % 4)
    body += b"\0" * (-len(body) % 4)
    chunks = struct.pack("<II", len(text), JSON_CHUNK) + text + (struct.pack("<II", len(body), BIN_CHUNK) + body if body else b"")
    return struct.pack("<III", GLB_MAGIC, GLB_VERSION, 12 + len(chunks)) + chunks


def transcode(data: bytes, files: Callable[[str], bytes] | None = None, bits: dict[str, int] | None = None) -> bytes:
    """The document as GLB with every primitive compressed (options are honoured), images in the buffer."""
    doc, buffers = parse(data, files)
    if bad := unsupported(doc):
        raise ValueError("; ".join(bad))
    new = json.loads(json.dumps(doc))
    body, views, accessors = bytearray(), [], []

    def view(part: bytes) -> int:
        body.extend(b"\0" * (-len(body) % 4))
        views.append({"buffer": 0, "byteOffset": len(body), "byteLength": len(part)})
        body.extend(part)
        return len(views) - 1

    done: dict[str, dict] = {}
    for mesh in new.get("meshes", []):
        for k, p in enumerate(mesh["primitives"]):
            same = json.dumps([p["attributes"], p.get("indices"), p.get("material")], sort_keys=True)
            if same not in done:  # work on equal primitives is shared
                triangles, attributes, names = primitive(doc, buffers, p)
                stream = drc.encode(triangles, attributes, bits)
                ids = {}
                for number, (a, name) in enumerate(zip(attributes, names, strict=True)):
                    kind = {1: "SCALAR", 2: "VEC2", 3: "VEC3", 4: "VEC4"}[a.values.shape[1]]
                    acc = {"componentType": 5125 if a.kind == "CUSTOM" else 5126, "count": len(a.values), "type": kind}
                    if a.kind == "POSITION":
                        acc |= {"min": [float(x) for x in a.values.min(0)], "max": [float(x) for x in a.values.max(0)]}
                    accessors.append(acc)
                    ids[name] = (len(accessors) - 1, number)
                accessors.append({"componentType": 5125, "count": 3 * len(triangles), "type": "SCALAR"})
                done[same] = {"attributes": {n: i for n, (i, _) in ids.items()}, "indices": len(accessors) - 1, "extension": {"bufferView": view(stream), "attributes": {n: i for n, (_, i) in ids.items()}}}
            d = done[same]
            mesh["primitives"][k] = {**p, "attributes": d["attributes"], "indices": d["indices"], "mode": 4, "extensions": {**p.get("extensions", {}), COMPRESSION: d["extension"]}}
    def moved(index: int) -> int:
        """A buffer view copied as it is."""
        v = doc["bufferViews"][index]
        start = v.get("byteOffset", 0)
        return view(buffers[v["buffer"]][start : start + v["byteLength"]])

    def kept(index: int) -> int:
        """An accessor with its rows, laid close together."""
        a = {k: x for k, x in doc["accessors"][index].items() if k != "byteOffset"}
        accessors.append(a | {"bufferView": view(accessor(doc, buffers, index).tobytes())})
        return len(accessors) - 1

    for skin in new.get("skins", []):
        if "inverseBindMatrices" in skin:
            skin["inverseBindMatrices"] = kept(skin["inverseBindMatrices"])
    for sampler in (x for a in new.get("animations", []) for x in a["samplers"]):
        sampler |= {k: kept(sampler[k]) for k in ("input", "output")}
    for node in new.get("nodes", []):
        if instances := node.get("extensions", {}).get("EXT_mesh_gpu_instancing"):
            instances["attributes"] = {k: kept(i) for k, i in instances["attributes"].items()}
    for table in new.get("extensions", {}).get("EXT_structural_metadata", {}).get("propertyTables", []):
        for prop in table.get("properties", {}).values():
            prop |= {k: moved(prop[k]) for k in ("values", "arrayOffsets", "stringOffsets") if k in prop}
    for image in new.get("images", []):
        if "bufferView" in image:
            image["bufferView"] = moved(image["bufferView"])
        elif "uri" in image:
            uri = image.pop("uri")
            part = resolve(uri, files)
            image["bufferView"] = view(part)
            image.setdefault("mimeType", "image/png" if part[:4] == b"\x89PNG" else "image/jpeg" if part[:3] == b"\xff\xd8\xff" else "image/webp")
    new["accessors"], new["bufferViews"] = accessors, views
    new["buffers"] = [{"byteLength": len(body) + -len(body) % 4}]
    for key in ("extensionsUsed", "extensionsRequired"):
        new[key] = sorted({*new.get(key, []), COMPRESSION} if done else set(new.get(key, [])))
        if not new[key]:
            del new[key]
    return glb({k: v for k, v in new.items() if v != []}, bytes(body))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, content of .gltf and .glb files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gl[tb]*").option("recursiveFileLookup", "true").load(path).select("path", "content")


def beside(path: str, uri: str) -> str:
    """The path of what a document names, relative to the document's folder unless it has a scheme of its own."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri):
        return uri
    scheme, host, rest = re.fullmatch(r"(?s)(?:([^/]*://)([^/]*))?(.*)", path).groups()
    return (scheme or "") + (host or "") + posixpath.normpath(posixpath.join(posixpath.dirname(rest), unquote(uri)))


def dependencies(docs: DataFrame) -> DataFrame:
    """path, uri, place: files that documents name, each once a document. Documents that can't be parsed name none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    own = sorted(set(uris(parse(body.as_py(), lambda uri: b"")[0])))
                except ValueError:
                    own = []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own, pa.string()), pa.array([beside(name, u) for u in own], pa.string())], ["path", "uri", "place"])

    return docs.select("path", "content").mapInArrow(run, "path string, uri string, place string")


def gathered(docs: DataFrame, files: DataFrame) -> DataFrame:
    """path, content, files (uri to bytes): documents with the files (path, content) that they name, by equi-joins.

    A document and what it names must fit a Python worker. Files that are not there stay out of the map.
    """
    found = dependencies(docs).join(files.select(F.col("path").alias("place"), F.col("content").alias("body")), "place")
    own = found.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("uri", "body"))).alias("files"))
    return docs.select("path", "content").join(own, "path", "left")


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """gathered() of the documents below a folder and all other files there."""
    rest = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("NOT lower(path) RLIKE '[.]gl(tf|b)$'")
    return gathered(documents(spark, path), rest)


def _each(docs: DataFrame, f: Callable[[str, bytes, Callable[[str], bytes]], pa.RecordBatch], schema: str) -> DataFrame:
    """f(path, content, files) of every document; without a column of files, none can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = dict(batch.column(2)[k].as_py() or []) if batch.num_columns > 2 else {}

                def read(uri: str, own: dict[str, bytes] = own) -> bytes:
                    if uri not in own:
                        raise ValueError(f"no way to read {uri}")
                    return own[uri]

                yield f(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), read)

    return docs.select("path", "content", *(["files"] if "files" in docs.columns else [])).mapInArrow(run, schema)


#: Rows of small documents go on together.
BATCH_ROWS = 2_000
TABLES = "file string, kind string, idx long, name string, parent long, mesh long, material long, mode long, matrix array<double>, body string, error string"


def tables(docs: DataFrame) -> DataFrame:
    """A row for each node, primitive, attribute (idx: its accessor), compressed part (idx: its view), accessor, view, material, texture, image and sampler (body: its JSON), and for what can't be read (error)."""
    names = [x.split()[0] for x in TABLES.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.string(), pa.string()]

    def rows(name: str, data: bytes) -> Iterator[dict]:
        try:
            doc, _ = parse(data, lambda uri: b"")
        except ValueError as e:
            yield {"kind": "error", "error": str(e)}
            return
        for bad in unsupported(doc):
            yield {"kind": "error", "error": bad}
        parents = {c: i for i, n in enumerate(doc.get("nodes", [])) for c in n.get("children", [])}
        for i, n in enumerate(doc.get("nodes", [])):
            yield {"kind": "node", "idx": i, "name": n.get("name"), "parent": parents.get(i), "mesh": n.get("mesh"), "matrix": node_matrix(n), "body": json.dumps(n)}
        for i, m in enumerate(doc.get("meshes", [])):
            for p in m["primitives"]:
                for attribute, number in sorted(p["attributes"].items()):
                    yield {"kind": "attribute", "idx": number, "name": attribute, "mesh": i, "body": json.dumps(doc["accessors"][number]) if number < len(doc.get("accessors", [])) else None}
                if COMPRESSION in p.get("extensions", {}):
                    yield {"kind": "compressed", "idx": p["extensions"][COMPRESSION]["bufferView"], "mesh": i}
                yield {"kind": "primitive", "idx": i, "name": m.get("name"), "mesh": i, "material": p.get("material"), "mode": p.get("mode", 4), "body": json.dumps(p)}
        for kind, key in (("accessor", "accessors"), ("view", "bufferViews"), ("material", "materials"), ("texture", "textures"), ("image", "images"), ("sampler", "samplers")):
            for i, x in enumerate(doc.get(key, [])):
                yield {"kind": kind, "idx": i, "name": x.get("name"), "body": json.dumps(x)}
        for i, uri in enumerate(uris(doc)):
            yield {"kind": "dependency", "idx": i, "name": uri}

    def together(own: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in own], k) for c, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[dict] = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own += ({"file": name, **r} for r in rows(name, body.as_py()))
                if len(own) >= BATCH_ROWS:
                    yield together(own)
                    own = []
            if own:
                yield together(own)

    return docs.select("path", "content").mapInArrow(run, TABLES)


def compressed_parts(docs: DataFrame) -> DataFrame:
    """path, part, drc: the compressed primitives of documents, with buffers of their own or from files (gathered)."""

    def parts(name: str, body: bytes, files: Callable[[str], bytes]) -> pa.RecordBatch:
        doc, buffers = parse(body, files)
        own = sorted({p["extensions"][COMPRESSION]["bufferView"] for m in doc.get("meshes", []) for p in m["primitives"] if COMPRESSION in p.get("extensions", {})})
        views = [doc["bufferViews"][i] for i in own]
        cut = [buffers[v["buffer"]][v.get("byteOffset", 0) : v.get("byteOffset", 0) + v["byteLength"]] for v in views]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own, pa.int64()), pa.array(cut, pa.binary())], ["path", "part", "drc"])

    return _each(docs, parts, "path string, part long, drc binary")


def accessor_rows(docs: DataFrame) -> DataFrame:
    """path, accessor, row, value (doubles), error: all rows of all accessors; one that can't be read has one row with its reason."""
    names = ["path", "accessor", "row", "value", "error"]

    def read(name: str, body: bytes, files: Callable[[str], bytes]) -> pa.RecordBatch:
        at, rows, values, errors = [], [], [], []
        try:
            doc, buffers = parse(body, files)
        except ValueError as e:
            doc, at, rows, values, errors = {}, [None], [None], [None], [str(e)]
        for i in range(len(doc.get("accessors", []))):
            try:
                own = accessor(doc, buffers, i).astype(float).tolist()
                at, rows, values, errors = at + [i] * len(own), rows + list(range(len(own))), values + own, errors + [None] * len(own)
            except (ValueError, KeyError, IndexError) as e:
                at, rows, values, errors = at + [i], rows + [None], values + [None], errors + [f"{type(e).__name__}: {e}"]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(rows, pa.int64()), pa.array(values, pa.list_(pa.float64())), pa.array(errors, pa.string())], names)

    return _each(docs, read, "path string, accessor long, row long, value array<double>, error string")


def type_conflicts(tables_: DataFrame) -> DataFrame:
    """Attributes of one name whose accessors differ in component type, shape or normalisation; feature ids may differ."""
    kind = F.struct(F.get_json_object("body", "$.componentType"), F.get_json_object("body", "$.type"), F.coalesce(F.get_json_object("body", "$.normalized"), F.lit("false")))
    own = tables_.where("kind = 'attribute' AND NOT startswith(name, '_FEATURE_ID_')")
    return own.groupBy("file", "name").agg(F.count_distinct(kind).alias("kinds")).where("kinds > 1")


def transcoded(docs: DataFrame, bits: dict[str, int] | None = None) -> DataFrame:
    """path, glb, before, after, status: documents as GLB with compressed primitives; before counts the files they name (gathered), status says why one can't be read."""

    def run(name: str, data: bytes, files: Callable[[str], bytes]) -> pa.RecordBatch:
        used, out, status = {}, None, "done"

        def read(uri: str) -> bytes:
            used[uri] = files(uri)
            return used[uri]

        try:
            out = transcode(data, read, bits)
        except (ValueError, KeyError, IndexError) as e:
            status = f"{type(e).__name__}: {e}"
        before = len(data) + sum(map(len, used.values()))
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out], pa.binary()), pa.array([before]), pa.array([len(out) if out else None], pa.int64()), pa.array([status])], ["path", "glb", "before", "after", "status"])

    return _each(docs, run, "path string, glb binary, before long, after long, status string")


def loose(data: bytes, stem: str, resources: str | None = None) -> list[tuple[str, bytes]]:
    """A GLB as files, each with its name: stem.gltf, stem.bin with all buffers, and, given a folder of resources, an image a file there."""
    doc, buffers = parse(data)
    doc, body, views, number = json.loads(json.dumps(doc)), bytearray(), [], {}
    images = {i["bufferView"] for i in doc.get("images", []) if "bufferView" in i} if resources is not None else set()
    out = []

    def cut(i: int) -> bytes:
        v = doc["bufferViews"][i]
        return buffers[v["buffer"]][v.get("byteOffset", 0) : v.get("byteOffset", 0) + v["byteLength"]]

    for i, v in enumerate(doc.get("bufferViews", [])):
        if i not in images:
            body.extend(b"\0" * (-len(body) % 4))
            number[i] = len(views)
            views.append(v | {"buffer": 0, "byteOffset": len(body)})
            body.extend(cut(i))
    for k, image in enumerate(doc.get("images", [])):
        if image.get("bufferView") in images:
            ending = image.get("mimeType", "image/png").rpartition("/")[2].replace("jpeg", "jpg")
            out.append((f"{resources.strip('/')}/{posixpath.basename(stem)}-{k}.{ending}".lstrip("/"), cut(image.pop("bufferView"))))
            image["uri"] = out[-1][0]

    def renumbered(node, names=("bufferView",)):
        if isinstance(node, list):
            return [renumbered(x, names) for x in node]
        if isinstance(node, dict):
            return {k: number[x] if k in names and isinstance(x, int) else renumbered(x, (*names, "values", "arrayOffsets", "stringOffsets") if k == "propertyTables" else names) for k, x in node.items()}
        return node

    doc = renumbered({k: x for k, x in doc.items() if k not in ("bufferViews", "buffers")})
    if views:
        doc |= {"bufferViews": views, "buffers": [{"byteLength": len(body), "uri": posixpath.basename(stem) + ".bin"}]}
        out.append((stem + ".bin", bytes(body)))
    folder = posixpath.dirname(stem)
    return [(stem + ".gltf", json.dumps(doc, ensure_ascii=False).encode())] + [(n if n == stem + ".bin" or not folder else f"{folder}/{n}", b) for n, b in out]


def report(done: DataFrame) -> DataFrame:
    """What became of each document, with its ratio."""
    return done.select("path", "status", "before", "after", F.try_divide(F.col("before").cast("double"), F.col("after").cast("double")).alias("ratio"))


_MAP = "struct<index:int,texCoord:int,scale:double,strength:double,extensions:map<string,string>>"
_MATERIAL = f"struct<name:string,doubleSided:boolean,alphaMode:string,alphaCutoff:double,emissiveFactor:array<double>,normalTexture:{_MAP},occlusionTexture:{_MAP},emissiveTexture:{_MAP},pbrMetallicRoughness:struct<baseColorFactor:array<double>,metallicFactor:double,roughnessFactor:double,baseColorTexture:{_MAP},metallicRoughnessTexture:{_MAP}>,extensions:map<string,string>>"


def materials(tables_: DataFrame) -> DataFrame:
    """Materials of documents with the format's defaults, the textures that they use, and whether they are unlit or have other extensions."""
    m = F.from_json("body", _MATERIAL)
    pbr = m["pbrMetallicRoughness"]
    names = F.coalesce(F.map_keys(m["extensions"]), F.array().cast("array<string>"))
    default = lambda c, v: F.coalesce(c, F.lit(v)) if not isinstance(v, list) else F.coalesce(c, F.array(*map(F.lit, v)))
    return tables_.where("kind = 'material'").select(
        "file", F.col("idx").alias("material"), F.coalesce("name", F.lit("")).alias("name"),
        default(pbr["baseColorFactor"], [1.0] * 4).alias("base_color"), default(pbr["metallicFactor"], 1.0).alias("metallic"), default(pbr["roughnessFactor"], 1.0).alias("roughness"),
        default(m["emissiveFactor"], [0.0] * 3).alias("emissive"), default(m["doubleSided"], False).alias("double_sided"), default(m["alphaMode"], "OPAQUE").alias("alpha_mode"), default(m["alphaCutoff"], 0.5).alias("alpha_cutoff"),
        pbr["baseColorTexture"]["index"].alias("color_texture"), pbr["metallicRoughnessTexture"]["index"].alias("metallic_texture"), m["normalTexture"]["index"].alias("normal_texture"), m["occlusionTexture"]["index"].alias("occlusion_texture"),
        F.array_contains(names, "KHR_materials_unlit").alias("unlit"), F.sort_array(names).alias("extensions"),
    )


def texture_uses(materials_: DataFrame) -> DataFrame:
    """file, texture, channels: textures once each; one that only occludes needs one channel, one that is also metallic and rough three, colours four."""
    use = F.array(*(F.struct(F.col(c).alias("texture"), F.lit(n).alias("n")) for c, n in (("color_texture", 4), ("metallic_texture", 3), ("normal_texture", 3), ("occlusion_texture", 1))))
    return materials_.select("file", F.inline(use)).where("texture IS NOT NULL").groupBy("file", "texture").agg(F.max("n").alias("channels"))


def mesh_features(tables_: DataFrame) -> DataFrame:
    """file, mesh, ordinal, label, feature_count, null_id, attribute, property_table, texture, channels of primitives' feature id sets."""
    sets = F.from_json(F.get_json_object("body", "$.extensions.EXT_mesh_features.featureIds"), "array<struct<label:string,featureCount:int,nullFeatureId:int,attribute:string,propertyTable:int,texture:struct<index:int,texCoord:int,channels:array<int>>>>")
    own = tables_.where("kind = 'primitive'").select("file", "mesh", F.posexplode(sets).alias("ordinal", "f"))
    f = F.col("f")
    return own.select("file", "mesh", "ordinal", f["label"].alias("label"), f["featureCount"].alias("feature_count"), f["nullFeatureId"].alias("null_id"), F.regexp_extract(f["attribute"], r"(\d+)$", 1).cast("int").alias("attribute"), f["propertyTable"].alias("property_table"), f["texture"]["index"].alias("texture"), F.coalesce(f["texture"]["channels"], F.when(f["texture"].isNotNull(), F.array(F.lit(0)))).alias("channels"))


def instances(tables_: DataFrame) -> DataFrame:
    """file, node, mesh, material: what each node shows, each pair once."""
    nodes = tables_.where("kind = 'node' AND mesh IS NOT NULL").select("file", F.col("idx").alias("node"), "mesh")
    parts = tables_.where("kind = 'primitive'").select("file", "mesh", "material")
    return nodes.join(parts, ["file", "mesh"]).select("file", "node", "mesh", "material").distinct()


def extension_names(tables_: DataFrame) -> DataFrame:
    """file, extensions: names that nodes, primitives and materials use, sorted."""
    keys = F.json_object_keys(F.get_json_object("body", "$.extensions"))
    return tables_.select("file", F.explode(keys).alias("name")).groupBy("file").agg(F.sort_array(F.collect_set("name")).alias("extensions"))
