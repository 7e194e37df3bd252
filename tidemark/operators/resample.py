"""Resampling of pixel tables between grids, and mosaics. Targets look up their sources by equality joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lines import projected
from tidemark.functions.raster import to_db
from tidemark.operators.graph import exploded

#: Kinds of values whose mean has a meaning; decibels are logarithms and have none.
MEANABLE = ("linear_power", "reflectance", "elevation", "unitless")


@dataclass(frozen=True)
class Affine:
    """A grid of width x height pixels in a system: x = c + a * col + b * row, y = f + d * col + e * row at corners."""

    width: int
    height: int
    epsg: int
    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    def __post_init__(self) -> None:
        if self.width < 0 or self.height < 0 or not self.a * self.e - self.b * self.d:
            raise ValueError("a grid needs a size, and axes that differ")

    def place(self, row: Column, col: Column) -> tuple[Column, Column]:
        """The centre of a pixel in the grid's system."""
        return self.c + self.a * (col + 0.5) + self.b * (row + 0.5), self.f + self.d * (col + 0.5) + self.e * (row + 0.5)

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column, counted from the centre of the first pixel, of a place."""
        det = self.a * self.e - self.b * self.d
        col = (self.e * (x - self.c) - self.b * (y - self.f)) / det
        row = (self.a * (y - self.f) - self.d * (x - self.c)) / det
        return row - 0.5, col - 0.5


def _sought(spark: SparkSession, source: Affine, target: Affine) -> DataFrame:
    """row, col of all target pixels, with the place y, x in the source that each looks up; NULL outside of it."""
    cells = spark.range(target.height).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, target.width - 1)).cast("bigint"))).alias("col")).where(F.lit(target.width > 0))
    at = cells.select("row", "col", F.struct(*[c.alias(n) for c, n in zip(target.place(F.col("row"), F.col("col")), "xy", strict=True)]).alias("t"))
    at = at.select("row", "col", F.struct(*[c.alias(n) for c, n in zip(projected(F.col("t.x"), F.col("t.y"), target.epsg, source.epsg), "xy", strict=True)]).alias("s"))
    y, x = source.pixel(F.col("s.x"), F.col("s.y"))
    at = at.select("row", "col", y.alias("y"), x.alias("x"))
    inside = (F.col("y") >= -0.5) & (F.col("y") < source.height - 0.5) & (F.col("x") >= -0.5) & (F.col("x") < source.width - 0.5)
    return at.select("row", "col", F.when(inside, F.col("y")).alias("y"), F.when(inside, F.col("x")).alias("x"))


def _keys(y: Column, x: Column) -> list[Column]:
    """sr, sc of the source pixel at a place; outside of the source, where there is none, places that no source has. A
    turned grid may lie outside for the most part, and without keys of their own all those pixels meet in one task."""
    return [F.coalesce(v.cast("bigint"), -2 - F.col(own)).alias(n) for v, own, n in ((y, "row", "sr"), (x, "col", "sc"))]


def warp_nearest(pixels: DataFrame, source: Affine, target: Affine) -> DataFrame:
    """row, col, value of the target grid: each pixel takes the source pixel under its centre, in whatever system; NULL
    outside of the source or where that is NULL. No value is made that the source doesn't hold."""
    t = _sought(pixels.sparkSession, source, target).select("row", "col", *_keys(F.floor(F.col("y") + 0.5), F.floor(F.col("x") + 0.5)))
    s = pixels.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    return t.join(exploded(s), ["sr", "sc"], "left").select("row", "col", F.when(F.col("sr") >= 0, F.col("value")).alias("value"))


def warp_labels(pixels: DataFrame, source: Affine, target: Affine, ignore: int, known: list[int] | None = None) -> DataFrame:
    """warp_nearest() for classes: what is not observed becomes `ignore`; a class that isn't known is an error."""
    label = F.col("value")
    if known is not None:
        label = F.when(label.isNull() | label.isin([*known, ignore]), label).otherwise(F.raise_error(F.concat(F.lit("unknown class "), label.cast("string"))))
    return warp_nearest(pixels.withColumn("value", label), source, target).withColumn("value", F.coalesce("value", F.lit(ignore)))


def warp_bilinear(pixels: DataFrame, source: Affine, target: Affine, least_weight: float = 1 - 1e-6, domain: str = "linear_power") -> DataFrame:
    """row, col, value of the target grid from the four source pixels around each centre, in whatever system.

    Invalid source pixels are left out of the mean; a target is valid if they make up no more than 1 - least_weight of
    the weight that lies within the source (1 - 1e-6: strict, 0.5: majority). Decibels are refused, as the mean of
    logarithms is not that of the power: warp first, then to_db()."""
    if domain not in MEANABLE:
        raise ValueError(f"{domain} values have no mean; resample linear power and convert afterwards")
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    t = _sought(pixels.sparkSession, source, target).withColumn("k", corner)
    t = t.select("row", "col", "y", "x", *_keys(F.floor("y") + F.col("k.a"), F.floor("x") + F.col("k.b")))
    held = F.col("sr").between(0, source.height - 1) & F.col("sc").between(0, source.width - 1)
    w = F.when(held, (1 - F.abs(F.col("sr") - F.col("y"))) * (1 - F.abs(F.col("sc") - F.col("x")))).otherwise(0.0)
    s = pixels.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col("value").cast("double").alias("value"))
    sums = t.withColumn("w", w).join(exploded(s), ["sr", "sc"], "left").groupBy("row", "col").agg(F.sum("w").alias("whole"), F.sum(F.when(F.col("value").isNotNull(), F.col("w"))).alias("ok"), F.sum(F.col("w") * F.col("value")).alias("total"))
    return sums.select("row", "col", F.when(F.col("ok") >= least_weight * F.col("whole"), F.try_divide("total", "ok")).alias("value"))


def warp_to_db(pixels: DataFrame, source: Affine, target: Affine, least_weight: float = 1 - 1e-6) -> DataFrame:
    """Linear power on the target grid in decibels, in that order."""
    return warp_bilinear(pixels, source, target, least_weight).withColumn("value", to_db(F.col("value")))


def _targets(pixels: DataFrame, factor: float) -> DataFrame:
    """row, col and source place y, x of every pixel of the grid whose pixels are `factor` source pixels wide."""
    size = pixels.agg(F.max("row"), F.max("col")).first()
    rows, cols = (int((n + 1) // factor) if n is not None else 0 for n in size)
    spark = pixels.sparkSession
    grid = spark.range(rows).select(F.col("id").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(cols - 1, 0)).cast("bigint"))))
    return grid.withColumns({"y": (F.col("row") + 0.5) * factor - 0.5, "x": (F.col("col") + 0.5) * factor - 0.5})


def nearest(pixels: DataFrame, factor: float) -> DataFrame:
    """Each target takes the pixel under its centre: no value is invented."""
    t = _targets(pixels, factor).select("row", "col", F.floor(F.col("y") + 0.5).cast("bigint").alias("sr"), F.floor(F.col("x") + 0.5).cast("bigint").alias("sc"))
    s = pixels.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    return t.join(exploded(s), ["sr", "sc"], "left").select("row", "col", "value")


def bilinear(pixels: DataFrame, factor: float, least_weight: float = 1 - 1e-6) -> DataFrame:
    """Weights of the four pixels around; invalid ones are left out, and a target is valid from least_weight on
    (1 - 1e-6: strict, 0.5: majority)."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    t = _targets(pixels, factor).withColumn("k", corner)
    t = t.select("row", "col", "y", "x", (F.floor("y") + F.col("k.a")).cast("bigint").alias("sr"), (F.floor("x") + F.col("k.b")).cast("bigint").alias("sc"))
    s = pixels.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    w = F.greatest(F.lit(0.0), 1 - F.abs(F.col("sr") - F.col("y"))) * F.greatest(F.lit(0.0), 1 - F.abs(F.col("sc") - F.col("x")))
    sums = t.join(exploded(s), ["sr", "sc"]).withColumn("w", w).groupBy("row", "col").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("w"))).alias("ok"), F.sum(F.col("w") * F.col("value")).alias("total"))
    return sums.select("row", "col", F.when(F.col("ok") >= least_weight, F.col("total") / F.col("ok")).alias("value"))


def mosaic(pixels: DataFrame, positive_only: bool = False) -> DataFrame:
    """The first valid value of each pixel in the order of items (row, col, item, value)."""
    usable = pixels.where("value > 0" if positive_only else "value is not null")
    return usable.groupBy("row", "col").agg(F.min_by("value", "item").alias("value"))
