"""Plane and geographic geometry on Columns: rectangles in closed form, rings as arrays of (x, y) structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a point; south of the equator 327xx."""
    zone = F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1))
    return 32600 + zone + F.when(lat < 0, 100).otherwise(0)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def coverage(box: tuple[Column, Column, Column, Column], aoi: tuple[float, float, float, float]) -> Column:
    """Fraction of the rectangle `aoi` (x0, y0, x1, y1) that a box covers, within 0 and 1; NULL for an invalid box."""
    x0, y0, x1, y1 = box
    area = (aoi[2] - aoi[0]) * (aoi[3] - aoi[1])
    shared = overlap(x0, x1, F.lit(aoi[0]), F.lit(aoi[2])) * overlap(y0, y1, F.lit(aoi[1]), F.lit(aoi[3]))
    return F.when((x1 >= x0) & (y1 >= y0), F.least(F.lit(1.0), shared / area))


def coverage_status(fraction: Column) -> Column:
    return F.when(fraction.isNull(), "UNVERIFIABLE").when(fraction >= 1 - 1e-9, "FULL").when(fraction > 0, "PARTIAL").otherwise("NONE")


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a ring by ray casting: an edge counts where it is crossed upwards or downwards."""
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if ay != by:
            crossed = (F.lit(ay) > y) != (F.lit(by) > y)
            inside = inside != (crossed & (x < (bx - ax) * (y - ay) / (by - ay) + ax))
    return inside


def snapped(lo: Column, hi: Column, resolution: float) -> tuple[Column, Column]:
    """Bounds widened to multiples of the resolution."""
    return F.floor(lo / resolution) * resolution, F.ceil(hi / resolution) * resolution


def buffered_degrees(lat: Column, km: float) -> tuple[Column, Column]:
    """Degrees of longitude and latitude that km spans at a latitude."""
    return F.lit(km) / (111.32 * F.cos(F.radians(lat))), F.lit(km / 111.32) + lat * 0


def tiles(box: tuple[float, float, float, float], size: float, slack: float = 1e-9) -> list[tuple[float, float, float, float]]:
    """Equal tiles of a box; the last of a row or column ends at the edge."""

    def cuts(a: float, b: float) -> list[float]:
        out = [a]
        while out[-1] + size < b - slack:
            out.append(out[-1] + size)
        return [*out, b]

    xs, ys = cuts(box[0], box[2]), cuts(box[1], box[3])
    return [(x0, y0, x1, y1) for y0, y1 in zip(ys, ys[1:], strict=False) for x0, x1 in zip(xs, xs[1:], strict=False)]


def nearest_within(points: DataFrame, targets: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """points (id, x, y) with target_id and distance of the nearest target (id, x, y) within the radius, ties to the
    smaller id. Cells are as wide as the radius, so a target is looked for in 3 x 3 cells by equality."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = points.withColumn("k", F.explode(around)).select(key, "x", "y", (cell("x") + F.col("k.i")).alias("cx"), (cell("y") + F.col("k.j")).alias("cy"))
    t = targets.select(F.col(key).alias("target_id"), F.col("x").alias("tx"), F.col("y").alias("ty"), cell("x").alias("cx"), cell("y").alias("cy"))
    near = spread.join(t, ["cx", "cy"]).withColumn("distance", F.hypot(F.col("tx") - F.col("x"), F.col("ty") - F.col("y"))).where(F.col("distance") <= radius)
    best = near.groupBy(key).agg(F.min(F.struct("distance", "target_id")).alias("b"))
    return points.join(best, key, "left").select(*[points[c] for c in points.columns], F.col("b.target_id").alias("target_id"), F.col("b.distance").alias("distance"))
