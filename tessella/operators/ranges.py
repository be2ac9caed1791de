"""Sets of half-open ranges as rows (key, start, end): unions, intersections, and ranges of consecutive numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges that overlap or touch become one: a new one starts past the greatest end so far."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.where("start < end").withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int"))
    return marked.withColumn("no", F.sum("new").over(w)).groupBy(*keys, "no").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("no")


def intersection(ranges: DataFrame, keys: list[str], part: str, parts: int) -> DataFrame:
    """What all of so many sets (column part) have in common: where the running count of sets is full."""
    own = union(ranges, [*keys, part])
    events = own.select(*keys, F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))))
    steps = events.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(*keys).orderBy("at")
    depth = steps.withColumn("depth", F.sum("step").over(w)).withColumn("next", F.lead("at").over(w))
    return union(depth.where(F.col("depth") == parts).select(*keys, F.col("at").alias("start"), F.col("next").alias("end")), keys)


def runs(numbers: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Ranges of consecutive numbers."""
    w = Window.partitionBy(*keys).orderBy(number)
    own = numbers.select(*keys, number).distinct().withColumn("island", F.col(number) - F.row_number().over(w))
    return own.groupBy(*keys, "island").agg(F.min(number).alias("start"), (F.max(number) + 1).alias("end")).drop("island")
