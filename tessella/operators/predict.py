"""Predictions from values coded before, and residuals.

Every value is known before any is predicted, so once the coding order is a rank column, predictions are joins and lags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import canonical, cross, dot, int_sqrt, octahedral, sub, zigzag

TRANSFORMS = {"none": 255, "difference": 0, "wrapped": 1, "oct_orthogonal": 3}


def delta(values: DataFrame, keys: list[str], columns: list[str], rank: str = "rank") -> DataFrame:
    """pred_c: the value before, 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(rank)
    return values.select("*", *(F.lag(c, 1, 0).over(w).alias(f"pred_{c}") for c in columns))


def difference(orig: Column, pred: Column) -> Column:
    return zigzag(orig - pred)


def wrapped(orig: Column, pred: Column, low: Column, high: Column) -> Column:
    """The difference to the prediction held within bounds, wrapped to half the range on either side, zig-zag."""
    span = high - low + 1
    least = -F.floor(span / 2)
    most = F.floor(span / 2) - F.when(span % 2 == 0, 1).otherwise(0)
    d = orig - F.least(F.greatest(pred, low), high)
    return zigzag(F.when(d > most, d - span).when(d < least, d + span).otherwise(d)).cast("long")


def unwrapped(code: Column, pred: Column, low: Column, high: Column) -> Column:
    d = F.when(code % 2 == 0, F.floor(code / 2)).otherwise(-F.floor((code + 1) / 2))
    v = F.least(F.greatest(pred, low), high) + d
    span = high - low + 1
    return F.when(v > high, v - span).when(v < low, v + span).otherwise(v).cast("long")


def wrapped_residuals(values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """res_c of columns and their pred_c; the bounds are those of all columns together, a row a key."""
    b = values.groupBy(*keys).agg(F.min(F.least(*columns) if len(columns) > 1 else F.col(columns[0])).alias("low"), F.max(F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])).alias("high"))
    return values.join(b, keys).select(*values.columns, *(wrapped(F.col(c), F.col(f"pred_{c}"), F.col("low"), F.col("high")).alias(f"res_{c}") for c in columns))


def parallelogram(order: DataFrame, adjacent: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """order: mesh_id, rank, corner, vertex. values: mesh_id, vertex and columns. Adds columns and pred_c.

    Across the edge opposite to a corner, the prediction is next + previous - the far tip if all three have a lower rank;
    else the value before in the order; else 0.
    """
    v = order.select("mesh_id", "rank", F.col("vertex").alias("vtx")).join(values.withColumnRenamed("vertex", "vtx"), ["mesh_id", "vtx"])
    own = order.join(values, ["mesh_id", "vertex"])
    around = own.join(adjacent.select("mesh_id", "corner", F.col("src").alias("nv"), F.col("snk").alias("pv"), "opp"), ["mesh_id", "corner"], "left")
    around = around.join(adjacent.select("mesh_id", F.col("corner").alias("opp"), F.col("tip").alias("ov")), ["mesh_id", "opp"], "left")
    for name in ("n", "p", "o"):
        side = v.select("mesh_id", F.col("vtx").alias(f"{name}v"), F.col("rank").alias(f"{name}r"), *(F.col(c).alias(f"{name}_{c}") for c in columns))
        around = around.join(side, ["mesh_id", f"{name}v"], "left")
    known = F.coalesce((F.col("nr") < F.col("rank")) & (F.col("pr") < F.col("rank")) & (F.col("or") < F.col("rank")), F.lit(False))
    w = Window.partitionBy("mesh_id").orderBy("rank")
    preds = (F.when(known, F.col(f"n_{c}") + F.col(f"p_{c}") - F.col(f"o_{c}")).otherwise(F.lag(c, 1, 0).over(w)).alias(f"pred_{c}") for c in columns)
    return around.select("mesh_id", "rank", "corner", "vertex", *columns, *preds)


def vertex_normals(faces: DataFrame, positions: DataFrame) -> DataFrame:
    """mesh_id, vertex, nx, ny, nz: sums of the cross products of the faces around, in 64-bit integers. positions: point_idx, x, y, z (integers)."""
    long = faces.select("mesh_id", "face_idx", F.posexplode(F.array("p0", "p1", "p2")).alias("k", "point_idx")).join(positions, "point_idx")
    f = long.groupBy("mesh_id", "face_idx").agg(*(F.max(F.when(F.col("k") == k, F.col(c).cast("long"))).alias(f"{c}{k}") for k in range(3) for c in "xyz"), *(F.max(F.when(F.col("k") == k, F.col("point_idx"))).alias(f"v{k}") for k in range(3)))
    p = [[F.col(f"{c}{k}") for c in "xyz"] for k in range(3)]
    n = cross(sub(p[1], p[0]), sub(p[2], p[0]))
    rows = f.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex"), *(x.alias(f"n{c}") for x, c in zip(n, "xyz", strict=True)))
    return rows.groupBy("mesh_id", "vertex").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"))


def predicted_normal(nx: Column, ny: Column, nz: Column) -> tuple[Column, Column]:
    """The octahedral place of a sum of normals, brought under 2**29 first; (0, 0) for no direction."""
    total = F.abs(nx) + F.abs(ny) + F.abs(nz)
    by = F.greatest(F.floor(total / (1 << 29)), F.lit(1))
    cut = [F.when(total > (1 << 29), F.signum(x) * F.floor(F.abs(x) / by)).otherwise(x).cast("long") for x in (nx, ny, nz)]
    none = (cut[0] == 0) & (cut[1] == 0) & (cut[2] == 0)
    x, y, z = (F.when(none, F.lit(1)).otherwise(c).cast("double") for c in cut)
    n = F.sqrt(x * x + y * y + z * z)
    u, v = octahedral(*((a / n).cast("float") for a in (x, y, z)))
    a, b = canonical(*(((t + F.lit(1).cast("float")) * F.lit(127).cast("float")).cast("int") for t in (u, v)))
    return F.when(none, 0).otherwise(a), F.when(none, 0).otherwise(b)


def oct_orthogonal(orig: tuple[Column, Column], pred: tuple[Column, Column]) -> tuple[Column, Column]:
    """Differences on the octahedral grid (0 to 254), after turning both so that the prediction lies in one quadrant.

    Both are centred; if the prediction is outside the inner diamond both turn inside out; then both turn by quarters, at
    most three, until the prediction is in the third quadrant. Negative differences go up by 255.
    """
    one = 127
    p, o = [x - one for x in pred], [x - one for x in orig]
    outer = F.abs(p[0]) + F.abs(p[1]) > one

    def inside_out(a):
        s = -F.signum(a[0] * a[1]).cast("int")
        return [s * a[1] + F.signum(a[0]).cast("int") * one, s * a[0] + F.signum(a[1]).cast("int") * one]

    o = [F.when(outer, x).otherwise(y) for x, y in zip(inside_out(o), o, strict=True)]
    p = [F.when(outer, x).otherwise(y) for x, y in zip(inside_out(p), p, strict=True)]
    # a quarter clockwise is (x, y) -> (-y, x); how many bring p to x < 0, y <= 0
    x, y = p
    turns = F.when((x == 0) & (y == 0), 0).when((x < 0) & (y <= 0), 0).when((x >= 0) & (y < 0), 3).when((x > 0) & (y >= 0), 2).otherwise(1)
    turn = lambda a: [F.when(turns == 0, a[0]).when(turns == 1, -a[1]).when(turns == 2, -a[0]).otherwise(a[1]), F.when(turns == 0, a[1]).when(turns == 1, a[0]).when(turns == 2, -a[1]).otherwise(-a[0])]
    d = sub(turn(o), turn(p))
    return tuple(F.when(v < 0, v + 255).otherwise(v) for v in d)


def predicted_uv(uv: list[Column], next_uv: list[Column], prev_uv: list[Column], pos: list[Column], next_pos: list[Column], prev_pos: list[Column], known: Column, fallback: list[Column]) -> tuple[Column, Column, Column]:
    """u, v and orientation (null where not used): the tip is projected on the opposite edge in space and carried to the
    plane of texture coordinates, on the side that is nearer to the value. All in 64-bit integers; products that
    overflow, like neighbours that aren't known, lead to the fallback. Equal ends of the edge predict that place.
    """

    def trunc_div(a: Column, b: Column) -> Column:
        """Integer division towards zero."""
        return ((a - a % b) / b).cast("long")

    same = (next_uv[0] == prev_uv[0]) & (next_uv[1] == prev_uv[1])
    pn, cn = sub(prev_pos, next_pos), sub(pos, next_pos)
    n2 = dot(pn, pn)
    safe = F.when(n2 > 0, n2)
    along = dot(pn, cn)
    pn_uv = sub(prev_uv, next_uv)
    x_uv = [F.try_add(F.try_multiply(a, n2), F.try_multiply(b, along)) for a, b in zip(next_uv, pn_uv, strict=True)]
    foot = [a + trunc_div(F.try_multiply(b, along), safe) for a, b in zip(next_pos, pn, strict=True)]
    off = sub(pos, foot)
    height = int_sqrt(F.try_multiply(dot(off, off), n2))
    cx = [F.try_multiply(pn_uv[1], height), F.try_multiply(-pn_uv[0], height)]
    sides = [[trunc_div(F.try_add(a, b), safe) for a, b in zip(x_uv, cx, strict=True)], [trunc_div(F.try_subtract(a, b), safe) for a, b in zip(x_uv, cx, strict=True)]]
    miss = [dot(sub(uv, s), sub(uv, s)) for s in sides]
    first = miss[0] < miss[1]
    use = known & ~same & first.isNotNull()
    out = [F.when(known & same, p).when(use, F.when(first, a).otherwise(b)).otherwise(f) for p, a, b, f in zip(prev_uv, *sides, fallback, strict=True)]
    return out[0], out[1], F.when(use, first)
