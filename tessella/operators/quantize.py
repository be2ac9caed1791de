"""Bounds, quantization to integers and back, in 32-bit floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import canonical, f32, octahedral

#: Bits by type of attribute; others are passed through or, like positions, get BITS.
BITS = {"TEXTURE_COORDINATE": 10, "NORMAL": 8}
DEFAULT_BITS = 11


def bits_of(att_type: str, override: int | None = None) -> int | None:
    """None: values pass through."""
    return override if override else None if att_type == "CUSTOM" else BITS.get(att_type, DEFAULT_BITS)


def bounds(values: DataFrame, keys: list[str], columns: list[str], seed_zero: bool = False) -> DataFrame:
    """keys, min_c and max_c of each column, and range, the largest extent; with seed_zero both start from 0."""
    low = lambda c: F.least(F.min(c), f32(0)) if seed_zero else F.min(c)
    high = lambda c: F.greatest(F.max(c), f32(0)) if seed_zero else F.max(c)
    out = values.groupBy(*keys).agg(*(low(c).alias(f"min_{c}") for c in columns), *(high(c).alias(f"max_{c}") for c in columns))
    extents = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in columns]
    return out.withColumn("range", F.greatest(*extents) if len(extents) > 1 else extents[0])


def quantized(v: Column, low: Column, extent: Column, bits: int) -> Column:
    """trunc((v - low) / extent * (2**bits - 1) + 0.5); with no extent the difference is not scaled."""
    d = v - low
    return F.when(extent == 0, (d * f32((1 << bits) - 1) + f32(0.5)).cast("int")).otherwise((d / F.when(extent != 0, extent) * 1).cast("float") * f32((1 << bits) - 1) + f32(0.5)).cast("int")


def dequantized(q: Column, low: Column, extent: Column, bits: int) -> Column:
    return (q.cast("float") * extent / f32((1 << bits) - 1)).cast("float") + low


def quantize(values: DataFrame, keys: list[str], columns: list[str], bits: int, seed_zero: bool = True) -> DataFrame:
    """Each column as q_c; bounds are a few numbers a key and are joined back."""
    b = bounds(values, keys, columns, seed_zero)
    out = values.join(b, keys) if keys else values.crossJoin(F.broadcast(b))  # one row
    return out.select(*values.columns, *(quantized(F.col(c), F.col(f"min_{c}"), F.col("range"), bits).alias(f"q_{c}") for c in columns))


def quantize_normals(x: Column, y: Column, z: Column, bits: int = 8) -> tuple[Column, Column]:
    """Places on the octahedral grid of 2 * (2**(bits - 1) - 1); borders have one name."""
    grid = f32((1 << (bits - 1)) - 1)
    u, v = octahedral(x, y, z)
    return canonical(*(((a + f32(1)) * grid).cast("int") for a in (u, v)))
