"""Nearest lines of another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import written


def _steps(lo: Column, hi: Column, cell: float) -> Column:
    return F.sequence(F.floor(lo / cell).cast("bigint"), F.floor(hi / cell).cast("bigint"))


def _dealt(segments: DataFrame, cell: float) -> DataFrame:
    """Segments in each grid cell that they pass: row by row of cells, and there from end to end."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = segments.withColumn("cy", F.explode(_steps(low, high, cell)))

    def x(y: Column) -> Column:
        return F.coalesce(F.col("ax") + F.try_divide(y - F.col("ay"), F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax")), F.col("ax"))

    flat = F.col("ay") == F.col("by")
    a = F.when(flat, F.col("ax")).otherwise(x(F.greatest(low, F.col("cy") * cell)))
    z = F.when(flat, F.col("bx")).otherwise(x(F.least(high, (F.col("cy") + 1) * cell)))
    return rows.withColumn("cx", F.explode(_steps(F.least(a, z) - cell * 1e-9, F.greatest(a, z) + cell * 1e-9, cell)))


def nearest_lines(points: DataFrame, lines: DataFrame, key: str, line: str, cell: float, most: float) -> DataFrame:
    """points (key, x, y) with the line (line, points) nearest to each and its distance, ties to the lesser line; NULL
    if there is none within `most`.

    Points look for segments in the 3 x 3 cells around them. Whatever lies within one cell's width is found there, so
    a nearest one that is no farther is proved to be the nearest. Points without one look again with cells twice as
    wide, up to `most`: rounds grow with the log of the farthest, and only points that are far from all lines go on.
    Lines that are NULL, empty or have a single vertex, and points without a place, are never matched."""
    vertices = lines.where(F.size("points") > 1).select(line, F.posexplode(F.arrays_zip(F.slice("points", F.lit(1), F.size("points") - 1).alias("a"), F.slice("points", F.lit(2), F.size("points") - 1).alias("b"))).alias("pos", "s"))
    segments = written(vertices.select(F.col(line).alias("line"), F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")).where("ax is not null and ay is not null and bx is not null and by is not null"))
    waiting = written(points.select(F.col(key).alias("key"), "x", "y").where("x is not null and y is not null"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    distance = F.hypot(F.col("ax") + t * dx - F.col("x"), F.col("ay") + t * dy - F.col("y"))
    found = None
    while not waiting.isEmpty():
        at = waiting.withColumn("k", F.explode(around)).select("key", "x", "y", (F.floor(F.col("x") / cell) + F.col("k.i")).alias("cx"), (F.floor(F.col("y") / cell) + F.col("k.j")).alias("cy"))
        near = at.join(_dealt(segments, cell), ["cx", "cy"]).select("key", F.struct(distance.alias("distance"), "line").alias("m")).where(F.col("m.distance") <= min(cell, most))
        best = written(near.groupBy("key").agg(F.min("m").alias("m")))
        found = best if found is None else found.unionByName(best)
        if cell >= most:
            break
        waiting, cell = written(waiting.join(best, "key", "left_anti")), 2 * cell
    if found is None:
        return points.select("*", F.lit(None).cast(lines.schema[line].dataType).alias("line"), F.lit(None).cast("double").alias("distance"))
    return points.join(found.withColumnRenamed("key", key), key, "left").select(*[points[c] for c in points.columns], F.col("m.line").alias("line"), F.col("m.distance").alias("distance"))
