"""Compressed meshes: a mesh of triangles and attributes as one binary value, and back as far as its parts go.

Each mesh is a group of an Arrow function: quantization needs the whole mesh's bounds and coding is a walk.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.entropy import CLERS_CODES, decode_flags, decode_symbols, encode_flags, encode_symbols, pack_bits, read_bits, read_varint, varint
from ..operators.quantize import bits_of
from ..operators.walks import NONE, Cut, Surface, Walk, after, before, order, symbols

#: Fixed values of the format.
TYPES = {"POSITION": 0, "NORMAL": 1, "COLOR": 2, "TEXTURE_COORDINATE": 3, "CUSTOM": 4, "TANGENT": 5, "MATERIAL": 6, "JOINT": 7, "WEIGHT": 8}
SCHEMES = {"delta": 0, "parallelogram": 1, "uv": 5, "normal": 6}
TRANSFORMS = {"difference": 0, "wrapped": 1, "oct_orthogonal": 3}
PAIRS = {"POSITION": ("parallelogram", "wrapped"), "NORMAL": ("normal", "oct_orthogonal"), "TEXTURE_COORDINATE": ("uv", "wrapped"), "CUSTOM": ("parallelogram", "wrapped")}
MAGIC, VERSION, TRIANGLES, EDGEBREAKER, FLOAT32 = b"DRACO", (2, 2), 1, 1, 9


@dataclass
class Attribute:
    kind: str
    values: np.ndarray  #: points x components, float32 (or integers for CUSTOM)
    domain: int = 0  #: 0 by position, 1 by corner


def octahedral(x: np.ndarray) -> np.ndarray:
    """Places on the 255 grid of directions (rows of three), in 32-bit floats; as functions.columns does for columns."""
    x = x.astype(np.float32)
    total = np.abs(x).sum(1, dtype=np.float32)
    y = x[:, 1:] / np.where(total > 0, total, 1)[:, None]
    folded = np.where(y < 0, np.abs(y[:, ::-1]) - 1, 1 - np.abs(y[:, ::-1])).astype(np.float32)
    q = ((np.where(x[:, :1] < 0, folded, y) + np.float32(1)) * np.float32(127)).astype(np.int64)
    u, v = q[:, 0], q[:, 1]
    ends = ((u == 0) & (v == 0)) | ((u == 255) & (v == 0)) | ((u == 0) & (v == 255))
    side = ((u == 0) & (v > 127)) | ((u == 255) & (v < 127))
    base = ~side & (((v == 255) & (u < 127)) | ((v == 0) & (u > 127)))
    return np.where(ends[:, None], 255, np.stack([np.where(base, 254 - u, u), np.where(side, 254 - v, v)], 1))


def quantized(a: Attribute, bits: int | None = None) -> tuple[np.ndarray, bytes]:
    """Integers a point, and what a reader needs to undo it."""
    bits = bits_of(a.kind, bits)
    if a.kind == "NORMAL":
        return octahedral(a.values), bytes([8])
    if bits is None:
        return a.values.astype(np.int64), b""
    x = a.values.astype(np.float32)
    low = np.minimum(x.min(0, initial=0), np.float32(0))
    extent = np.float32((np.maximum(x.max(0, initial=0), np.float32(0)) - low).max())
    d = x - low
    if extent:
        d = d / extent
    q = (d * np.float32((1 << bits) - 1) + np.float32(0.5)).astype(np.int64)
    return q, low.astype("<f4").tobytes() + struct.pack("<fB", extent, bits)


def _ids(values: np.ndarray) -> list[int]:
    """A number for each row, equal rows alike, in order of first appearance."""
    names: dict[bytes, int] = {}
    return [names.setdefault(x.tobytes(), len(names)) for x in np.ascontiguousarray(values) + 0]


def _zigzag(v: int) -> int:
    return 2 * v if v >= 0 else -2 * v - 1


def _div(a: int, b: int) -> int:
    """Towards zero."""
    return a // b if (a >= 0) == (b >= 0) else -(-a // b)


def _turned(p: list[int], o: list[int]) -> list[int]:
    """Residual on the octahedral grid."""
    p, o = [x - 127 for x in p], [x - 127 for x in o]
    sign = lambda x: (x > 0) - (x < 0)
    if abs(p[0]) + abs(p[1]) > 127:
        p, o = ([-sign(a[0] * a[1]) * a[1] + sign(a[0]) * 127, -sign(a[0] * a[1]) * a[0] + sign(a[1]) * 127] for a in (p, o))
    while p != [0, 0] and not (p[0] < 0 and p[1] <= 0):
        p, o = [-p[1], p[0]], [-o[1], o[0]]
    return [(a - b) % 255 if a < b else a - b for a, b in zip(o, p, strict=True)]


class _Coder:
    """Predicts the values of one attribute along its order."""

    def __init__(self, table: Surface | Cut, point: list[int], q: np.ndarray, position: np.ndarray):
        self.t, self.point, self.q, self.pos = table, point, q.tolist(), position.tolist()
        self.rank = [-1] * len(table.first)
        self.last = NONE
        self.flags: list[bool] = []

    def value(self, c: int) -> list[int]:
        return self.q[self.point[c]]

    def known(self, c: int) -> bool:
        return self.rank[self.t.vert[c]] >= 0

    def previous(self) -> list[int]:
        return self.value(self.t.first[self.last]) if self.last != NONE else [0] * len(self.q[0])

    def parallelogram(self, c: int) -> list[int]:
        o = self.t.opp[c]
        if o != NONE:
            k = c % 3
            n, p = c - 2 if k == 2 else c + 1, c + 2 if k == 0 else c - 1
            rank, vert, q, point = self.rank, self.t.vert, self.q, self.point
            if rank[vert[n]] >= 0 and rank[vert[p]] >= 0 and rank[vert[o]] >= 0:
                return [a + b - d for a, b, d in zip(q[point[n]], q[point[p]], q[point[o]], strict=True)]
        return self.previous()

    def delta(self, c: int) -> list[int]:
        return self.previous()

    def place(self, c: int) -> np.ndarray:
        return np.array(self.pos[self.point[c]], object)

    def normal(self, c: int) -> list[int]:
        start = c
        while (n := self.t.left(start)) not in (NONE, c):
            start = n
        total, x = np.zeros(3, object), start
        while x != NONE:
            a, b = self.place(after(x)) - self.place(c), self.place(before(x)) - self.place(c)
            total = total + np.array([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]], object)
            x = self.t.right(x)
            if x == start:
                break
        size = sum(map(abs, total))
        if size > 1 << 29:
            total = [_div(int(v), size // (1 << 29)) for v in total]
        out = [0, 0]
        if any(total):
            n = np.array([float(v) for v in total])
            out = octahedral((n / np.sqrt((n * n).sum())).astype(np.float32)[None])[0].tolist()
        own = self.value(c)
        flip = sum((a - b) ** 2 for a, b in zip(out, own, strict=True)) > sum((-a - b) ** 2 for a, b in zip(out, own, strict=True))
        self.flags.append(flip)
        return [-a for a in out] if flip else out

    def uv(self, c: int) -> list[int]:
        k = c % 3
        n, p = c - 2 if k == 2 else c + 1, c + 2 if k == 0 else c - 1
        rank, vert, q, point = self.rank, self.t.vert, self.q, self.point
        near = rank[vert[n]] >= 0
        fallback = q[point[n]] if near else self.previous()
        if not (near and rank[vert[p]] >= 0):
            return fallback
        nu, pu = q[point[n]], q[point[p]]
        if nu == pu:
            return pu
        (cx, cy, cz), (nx, ny, nz), (px, py, pz) = (self.pos[point[x]] for x in (c, n, p))
        px, py, pz, cx, cy, cz = px - nx, py - ny, pz - nz, cx - nx, cy - ny, cz - nz
        n2, along = px * px + py * py + pz * pz, px * cx + py * cy + pz * cz
        if not n2:
            return fallback
        (u, v), (du, dv) = nu, (pu[0] - nu[0], pu[1] - nu[1])
        most, far = 2**63 - 1, abs(along)
        if max(abs(u), abs(v)) > most // n2 or far > most // max(abs(du), abs(dv)) or far > most // max(abs(px), abs(py), abs(pz)):
            return fallback
        xu, xv = u * n2 + du * along, v * n2 + dv * along
        ox, oy, oz = cx - _div(px * along, n2), cy - _div(py * along, n2), cz - _div(pz * along, n2)
        height = int(math.sqrt((ox * ox + oy * oy + oz * oz) * n2))
        hu, hv = dv * height, -du * height
        a, b = [_div(xu + hu, n2), _div(xv + hv, n2)], [_div(xu - hu, n2), _div(xv - hv, n2)]
        u, v = q[point[c]]
        nearer = (u - a[0]) ** 2 + (v - a[1]) ** 2 < (u - b[0]) ** 2 + (v - b[1]) ** 2
        self.flags.append(nearer)
        return a if nearer else b

    def run(self, corners: list[int], scheme: str) -> tuple[list[list[int]], list[list[int]]]:
        """Values and predictions along the corners."""
        own, pred, vert, q, point, rank = [], [], self.t.vert, self.q, self.point, self.rank
        guess = getattr(self, scheme)
        for k, c in enumerate(corners):
            pred.append(guess(c))
            own.append(q[point[c]])
            v = vert[c]
            rank[v], self.last = k, v
        return own, pred


def _flag_stream(flags: list[bool], zero: int | None = None) -> bytes:
    zero = zero or min(max(int(flags.count(False) / len(flags) * 256 + 0.5) if flags else 0, 1), 255)
    body = encode_flags(flags, zero)
    return bytes([zero]) + varint(len(body)) + body


def _connectivity(s: Surface, w: Walk, cuts: list[Cut]) -> bytes:
    out = [b"\0", varint(len(s.first)), varint(len(s.vert) // 3), bytes([len(cuts)]), varint(len(w.symbols)), varint(w.symbols.count("S")), varint(len(w.splits))]
    last = 0
    for merging, split, _ in w.splits:
        out += (varint(merging - last), varint(merging - split))
        last = merging
    out.append(pack_bits([(1, int(right)) for _, _, right in w.splits]))
    codes = pack_bits([CLERS_CODES[x] for x in reversed(w.symbols)])
    out += (varint(len(codes)), codes, _flag_stream(w.inner_starts[::-1]))
    opp, done, edges = s.opp, [False] * (len(s.opp) // 3), []
    for c in reversed(w.corners):
        done[c // 3] = True
        edges += [x for x in (c, after(c), before(c)) if opp[x] != NONE and not done[opp[x] // 3]]
    out += [_flag_stream([cut.seam[x] for x in edges][::-1]) for cut in cuts]
    return b"".join(out)


def encode(triangles: list[tuple[int, int, int]], attributes: list[Attribute], bits: dict[str, int] | None = None, metadata: bool = False) -> bytes:
    """triangles of points; attributes by point, one of them POSITION. Degenerate triangles are left out; quantization bits may be given by type."""
    attributes = sorted(attributes, key=lambda a: a.kind != "POSITION")
    if not attributes or attributes[0].kind != "POSITION":
        raise ValueError("a mesh needs positions")
    place = _ids(attributes[0].values)
    triangles = [t for t in triangles if len({place[p] for p in t}) == 3]
    names = {v: k for k, v in enumerate(sorted({place[p] for t in triangles for p in t}))}
    s = Surface([tuple(names[place[p]] for p in t) for t in triangles])
    w = symbols(s)
    point = [p for t in triangles for p in t]
    values = [_ids(a.values) for a in attributes]
    cuts = [Cut(s, [v[p] for p in point]) for v in values[1:]]
    out = [MAGIC, bytes([*VERSION, TRIANGLES, EDGEBREAKER]) + (b"\0\x80" + bytes(4) if metadata else b"\0\0"), _connectivity(s, w, cuts), bytes([len(attributes)])]
    for k, a in enumerate(attributes):
        out.append(bytes([(k - 1) & 255, a.domain, 0]))
    for k, a in enumerate(attributes):
        out.append(bytes([1, TYPES[a.kind], FLOAT32 if a.kind != "CUSTOM" else 6, a.values.shape[1], 0, k, 3 if a.kind == "NORMAL" else 1 if a.kind == "CUSTOM" else 2]))
    position = quantized(attributes[0], (bits or {}).get("POSITION"))[0]
    for a, table in zip(attributes, [s, *cuts], strict=True):
        scheme, transform = PAIRS.get(a.kind, ("delta", "difference"))
        q, info = quantized(a, (bits or {}).get(a.kind))
        coder = _Coder(table, point, q, position)
        own, pred = coder.run(order(table, w), scheme)
        if transform == "wrapped":
            low, high = min(map(min, own), default=0), max(map(max, own), default=0)
            codes, tail = _wraps(own, pred, low, high), struct.pack("<ii", low, high)
        elif transform == "oct_orthogonal":
            codes, tail = [x for o, p in zip(own, pred, strict=True) for x in _turned(p, o)], struct.pack("<II", 255, 127)
        else:
            codes, tail = [_zigzag(x - y) for o, p in zip(own, pred, strict=True) for x, y in zip(o, p, strict=True)], b""
        meta = b""
        if scheme == "normal":
            meta = _flag_stream(coder.flags)
            tail, meta = tail + meta, b""
        elif scheme == "uv":
            turns = [a == b for a, b in zip(coder.flags, [*coder.flags[1:], True], strict=False)]
            changes = sum(a != b for a, b in zip(coder.flags, [True, *coder.flags], strict=False))
            zero = min(max(int(changes / (len(coder.flags) + 0.001) * 256 + 0.5), 1), 255)
            meta = struct.pack("<I", len(turns)) + _flag_stream(turns, zero)
        out += (bytes([SCHEMES[scheme], TRANSFORMS[transform], 1]), encode_symbols(codes), meta, tail, info)
    return b"".join(out)


def _wraps(own: list[list[int]], pred: list[list[int]], low: int, high: int) -> list[int]:
    """wrap of each value; in 64-bit integers, if the predictions fit."""
    flat = [y for p in pred for y in p]
    if max(map(abs, flat), default=0) >= 1 << 62:
        return [wrap(x, y, low, high) for o, p in zip(own, pred, strict=True) for x, y in zip(o, p, strict=True)]
    span = high - low + 1
    d = np.array([x for o in own for x in o], np.int64) - np.clip(np.array(flat, np.int64), low, high)
    d = np.where(d > span // 2 - (span % 2 == 0), d - span, np.where(d < -(span // 2), d + span, d))
    return np.where(d >= 0, 2 * d, -2 * d - 1).tolist()


def wrap(x: int, pred: int, low: int, high: int) -> int:
    span = high - low + 1
    d = x - min(max(pred, low), high)
    if d > span // 2 - (span % 2 == 0):
        d -= span
    elif d < -(span // 2):
        d += span
    return _zigzag(d)


def header(data: bytes) -> dict:
    """The parts of a compressed mesh: version, counts, symbols in order of the walk, attributes with their codes."""
    if data[:5] != MAGIC:
        raise ValueError("no compressed mesh")
    out: dict = {"version": tuple(data[5:7]), "geometry": data[7], "method": data[8]}
    out["metadata"] = bool(data[10] & 128)  # an empty list, if there
    at = 16 if out["metadata"] else 12  # past the kind of traversal
    out["vertices"], at = read_varint(data, at)
    out["faces"], at = read_varint(data, at)
    n_data, at = data[at], at + 1
    n, at = read_varint(data, at)
    out["splits_coded"], at = read_varint(data, at)
    splits, at = read_varint(data, at)
    out["splits"] = splits
    for _ in range(2 * splits):
        _, at = read_varint(data, at)
    at += -(-splits // 8)
    size, at = read_varint(data, at)
    bits, names, walk = int.from_bytes(data[at : at + size], "little"), {v: k for k, v in CLERS_CODES.items()}, []
    for _ in range(n):
        code = (3, bits & 7) if bits & 1 else (1, 0)
        walk.append(names[code])
        bits >>= code[0]
    out["symbols"], at = walk[::-1], at + size
    for _ in range(1 + n_data):
        size, body = read_varint(data, at + 1)
        at = body + size
    count, at = data[at], at + 1
    at += 3 * count
    kinds = {v: k for k, v in TYPES.items()}
    heads = [data[at + 7 * k : at + 7 * k + 7] for k in range(count)]
    out["attributes"] = [{"kind": kinds[h[1]], "components": h[3]} for h in heads]
    out["at"] = at + 7 * count
    return out


def inspected(streams: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vertices, faces, attributes, splits, symbols (a count each) of compressed meshes (column drc)."""
    fields = [f for f in streams.schema if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", vertices long, faces long, attributes long, splits long, symbols map<string,long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [header(x) for x in batch.column(len(fields)).to_pylist()]
            counts = [list(Counter(h["symbols"]).items()) for h in heads]
            cols = [pa.array([h["vertices"] for h in heads], pa.int64()), pa.array([h["faces"] for h in heads], pa.int64()), pa.array([len(h["attributes"]) for h in heads], pa.int64()), pa.array([h["splits"] for h in heads], pa.int64()), pa.array(counts, pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *cols], [*(f.name for f in fields), "vertices", "faces", "attributes", "splits", "symbols"])

    return streams.select(*(f.name for f in fields), "drc").mapInArrow(run, schema)


def sequential_indices(triangles: list[tuple[int, int, int]], points: int) -> bytes:
    """Plain connectivity: each index in 8, 16, a varint's or 32 bits, by the number of points."""
    flat = [i for t in triangles for i in t]
    if points < 1 << 21 and points >= 1 << 16:
        return b"".join(map(varint, flat))
    return np.array(flat, "<u1" if points < 1 << 8 else "<u2" if points < 1 << 16 else "<u4").tobytes()


def encode_meshes(faces: DataFrame, points: DataFrame) -> DataFrame:
    """faces: mesh_id, face_idx, p0, p1, p2; points: mesh_id, point_idx, x, y, z and, if there, nx, ny, nz, u, v. mesh_id, drc. What a point of a mesh lacks (null), the whole mesh goes without."""
    have = [c for c in ("nx", "ny", "nz", "u", "v") if c in points.columns]

    def run(key: tuple, f: pa.Table, p: pa.Table) -> pa.Table:
        f, p = f.sort_by("face_idx"), p.sort_by("point_idx")
        place = {i: k for k, i in enumerate(p.column("point_idx").to_pylist())}
        triangles = [tuple(place[i] for i in t) for t in zip(*(f.column(c).to_pylist() for c in ("p0", "p1", "p2")), strict=True)]
        column = lambda names: np.stack([p.column(c).to_numpy().astype(np.float32) for c in names], 1)
        attributes = [Attribute("POSITION", column("xyz"))]
        whole = {c for c in have if not p.column(c).null_count}
        if whole >= {"nx", "ny", "nz"}:
            attributes.append(Attribute("NORMAL", column(("nx", "ny", "nz")), 1))
        if whole >= {"u", "v"}:
            attributes.append(Attribute("TEXTURE_COORDINATE", column("uv"), 1))
        return pa.table({"mesh_id": pa.array([key[0].as_py()], pa.int64()), "drc": pa.array([encode(triangles, attributes)], pa.binary())})

    f = faces.select("mesh_id", "face_idx", "p0", "p1", "p2").groupBy("mesh_id")
    own = points.select(F.col("mesh_id").alias("mesh_id"), "point_idx", "x", "y", "z", *have)  # a column of its own, if both come from one table
    return f.cogroup(own.groupBy("mesh_id")).applyInArrow(run, "mesh_id long, drc binary")


__all__ = ["Attribute", "decode_flags", "decode_symbols", "encode", "encode_meshes", "header", "read_bits"]
