"""Scalar functions as columns: corners, vectors, integers, octahedral mapping, names and codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


# Corners: corner 3 * face + k is the k-th of its face.


def next_corner(c: Column) -> Column:
    return c - c % 3 + (c + 1) % 3


def previous_corner(c: Column) -> Column:
    return c - c % 3 + (c + 2) % 3


def face_of(c: Column) -> Column:
    return F.floor(c / 3).cast("long")


# Vectors as lists of columns.

Vector = list[Column]


def add(a: Vector, b: Vector) -> Vector:
    return [x + y for x, y in zip(a, b, strict=True)]


def sub(a: Vector, b: Vector) -> Vector:
    return [x - y for x, y in zip(a, b, strict=True)]


def scale(a: Vector, k: Column) -> Vector:
    return [x * k for x in a]


def dot(a: Vector, b: Vector) -> Column:
    return reduce(lambda x, y: x + y, (x * y for x, y in zip(a, b, strict=True)))


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def array_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


# Integers.


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2 ... to 0, 1, 2, 3 ..."""
    return F.when(v >= 0, v * 2).otherwise(-v * 2 - 1)


def unzigzag(v: Column) -> Column:
    return F.when(v % 2 == 0, F.floor(v / 2)).otherwise(-F.floor((v + 1) / 2)).cast("long")


def bit_length(v: Column) -> Column:
    """Bits of a number that is not negative; 0 for 0."""
    return F.when(v > 0, F.length(F.bin(v))).otherwise(0)


def varint_length(v: Column) -> Column:
    """Bytes of a LEB128 number."""
    return F.greatest(F.ceil(bit_length(v) / 7), F.lit(1)).cast("int")


def int_sqrt(v: Column) -> Column:
    """floor(sqrt(v)), put right where doubles are too coarse."""
    s = F.floor(F.sqrt(v.cast("double"))).cast("long")
    return F.when(s * s > v, s - 1).when((s + 1) * (s + 1) <= v, s + 1).otherwise(s)


def padded(n: Column, to: int = 4) -> Column:
    return (F.ceil(n / to) * to).cast("long")


def base64(b: Column) -> Column:
    """One line, whatever its length: Spark breaks lines after 76 characters."""
    return F.translate(F.base64(b), "\r\n", "")


# Octahedral mapping, in 32-bit floats.


def octahedral(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """A direction on the unfolded octahedron, each coordinate from -1 to 1; the half with x < 0 is folded outwards."""
    total = F.abs(x) + F.abs(y) + F.abs(z)
    u, v = y / total, z / total
    u, v = f32(u), f32(v)
    one = f32(1)
    folded = [F.when(a < 0, F.abs(b) - one).otherwise(one - F.abs(b)) for a, b in ((u, v), (v, u))]
    return F.when(x < 0, folded[0]).otherwise(u).cast("float"), F.when(x < 0, folded[1]).otherwise(v).cast("float")


def octahedral_inverse(u: Column, v: Column) -> Vector:
    """The unit direction of a place on the octahedron."""
    over = F.abs(u) + F.abs(v) > 1
    sign = lambda a: F.when(a > 0, 1.0).otherwise(-1.0)
    d = [1 - F.abs(u) - F.abs(v), F.when(over, (1 - F.abs(v)) * sign(u)).otherwise(u), F.when(over, (1 - F.abs(u)) * sign(v)).otherwise(v)]
    n = norm(d)
    return [x / n for x in d]


def canonical(u: Column, v: Column) -> tuple[Column, Column]:
    """One name for each place on a border of the 255 grid, where two lie on the same direction."""
    corner = ((u == 0) & (v == 0)) | ((u == 255) & (v == 0)) | ((u == 0) & (v == 255))
    y = F.when((u == 0) & (v > 127), 254 - v).when((u == 255) & (v < 127), 254 - v).otherwise(v)
    vertical = ((u == 0) & (v > 127)) | ((u == 255) & (v < 127))
    x = F.when(vertical, u).when((v == 255) & (u < 127), 254 - u).when((v == 0) & (u > 127), 254 - u).otherwise(u)
    return F.when(corner, 255).otherwise(x), F.when(corner, 255).otherwise(y)


# Names and codes.


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def scene_format(name: Column) -> Column:
    e = extension(name)
    return F.when(e.isin("gltf", "glb"), F.lit("gltf")).when(e.isin("usd", "usda", "usdc", "usdz"), F.lit("usd")).when(e == "ply", F.lit("ply")).when(e == "obj", F.lit("obj")).otherwise("unknown")


def image_format(body: Column) -> Column:
    """By the first bytes; fixed values of the formats."""
    start = lambda n, at=1: F.hex(F.substring(body, at, n))
    return (
        F.when(start(8) == "89504E470D0A1A0A", F.lit("png"))
        .when(start(3) == "FFD8FF", F.lit("jpeg"))
        .when((start(4) == "52494646") & (start(4, 9) == "57454250"), F.lit("webp"))
        .when(start(12) == "AB4B5458203230BB0D0A1A0A", F.lit("ktx2"))
        .when(start(2) == "7342", F.lit("basis"))
        .otherwise("none")
    )


def mime_type(format_: Column) -> Column:
    return F.when(format_ == "png", F.lit("image/png")).when(format_ == "jpeg", F.lit("image/jpeg")).when(format_ == "webp", F.lit("image/webp")).when(format_ == "ktx2", F.lit("image/ktx2")).when(format_ == "basis", F.lit("image/basis"))


#: Fixed values of glTF.
FILTER_CODES = {"nearest": 9728, "linear": 9729, "nearest_mipmap_nearest": 9984, "linear_mipmap_nearest": 9985, "nearest_mipmap_linear": 9986, "linear_mipmap_linear": 9987}
WRAP_CODES = {"clamp_to_edge": 33071, "mirrored_repeat": 33648, "repeat": 10497}
COMPONENT_SIZES = {5120: 1, 5121: 1, 5122: 2, 5123: 2, 5125: 4, 5126: 4}
TYPE_COMPONENTS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}


def coded(name: Column, codes: dict) -> Column:
    pairs = [x for k, v in codes.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), name)


# Transforms: 4 x 4 matrices as arrays of 16 doubles, row by row.


def matrix_multiply(a: Column, b: Column) -> Column:
    return F.array(*(reduce(lambda x, y: x + y, (a[4 * i + k] * b[4 * k + j] for k in range(4))) for i in range(4) for j in range(4)))


def transposed(m: Column) -> Column:
    return F.array(*(m[4 * j + i] for i in range(4) for j in range(4)))


def trs_matrix(t: Vector, q: Vector, s: Vector) -> Column:
    """Translation, rotation (a unit quaternion x, y, z, w) and scale as one matrix."""
    x, y, z, w = q
    r = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    rows = [[r[i][j] * s[j] for j in range(3)] + [t[i]] for i in range(3)] + [[F.lit(0.0)] * 3 + [F.lit(1.0)]]
    return F.array(*(x for row in rows for x in row))


IDENTITY = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]


def is_identity(m: Column) -> Column:
    return m == F.array(*map(F.lit, IDENTITY))


def is_translation_only(m: Column) -> Column:
    return reduce(lambda a, b: a & b, (m[i] == IDENTITY[i] for i in range(16) if i not in (3, 7, 11)))


def winding(m: Column) -> Column:
    """Sign of the determinant of the linear part: -1 if faces turn over."""
    rows = [[m[4 * i + j] for j in range(3)] for i in range(3)]
    return F.signum(dot(rows[0], cross(rows[1], rows[2]))).cast("int")


# Distances.


def point_triangle_distance(p: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """From a point to the nearest place of a triangle: to its inside, or else to the nearest edge (a segment)."""

    def segment(u: Vector, v: Vector) -> Column:
        d = sub(v, u)
        n = dot(d, d)
        t = F.when(n > 0, F.least(F.greatest(dot(sub(p, u), d) / F.when(n > 0, n), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        e = sub(p, add(u, scale(d, t)))
        return dot(e, e)

    ab, ac, ap = sub(b, a), sub(c, a), sub(p, a)
    n = cross(ab, ac)
    nn = dot(n, n)
    safe = F.when(nn > 0, nn)
    w = dot(cross(ab, ap), n) / safe
    v = dot(cross(ap, ac), n) / safe
    inside = (nn > 0) & (w >= 0) & (v >= 0) & (v + w <= 1)
    height = dot(ap, n)
    return F.sqrt(F.when(inside, height * height / safe).otherwise(F.least(segment(a, b), segment(b, c), segment(c, a))))


def texture_transform_is_default(offset: Column, rotation: Column, scale: Column, tex_coord: Column) -> Column:
    """Whether a texture transform (arrays of two; null: not given) changes nothing."""
    two = lambda c, v: F.coalesce(c == F.array(F.lit(v), F.lit(v)), F.lit(True))
    return two(offset, 0.0) & F.coalesce(rotation == 0.0, F.lit(True)) & two(scale, 1.0) & tex_coord.isNull()
