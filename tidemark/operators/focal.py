"""Focal kernels on pixel tables (row, col, value). Rows are cut into blocks with a halo, so that no window holds a
whole raster column; NULL is an invalid pixel and missing pixels count as absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.raster import Feature, feature_columns


def _blocks(pixels: DataFrame, halo: int, rows: int) -> DataFrame:
    """Each pixel in its block and, near an edge, in the neighbouring one; `home` marks the former."""
    block = F.floor(F.col("row") / rows).cast("long")
    near = F.array_distinct(F.array(F.floor((F.col("row") - halo) / rows).cast("long"), block, F.floor((F.col("row") + halo) / rows).cast("long")))
    return pixels.withColumn("block", F.explode(near)).withColumn("home", F.col("block") == block)


def _along(row_offset: int) -> Window:
    return Window.partitionBy("block", "col").orderBy("row").rangeBetween(row_offset, row_offset)


def boxcar_mean(pixels: DataFrame, window: int, rows: int = 1024) -> DataFrame:
    """Mean of the valid pixels in a window x window square, clipped at edges; an invalid centre stays invalid."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    if window <= 1:
        return pixels.select("row", "col", F.col("value").alias("mean"))
    r = window // 2
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-r, r)
    down = Window.partitionBy("block", "col").orderBy("row").rangeBetween(-r, r)
    sums = pixels.withColumns({"s": F.sum("value").over(across), "n": F.count("value").over(across)})
    both = _blocks(sums, r, rows).withColumns({"s": F.sum("s").over(down), "n": F.sum("n").over(down)}).where("home")
    return both.select("row", "col", F.when(F.col("value").isNotNull(), F.col("s") / F.col("n")).alias("mean"))


def _neighbours(pixels: DataFrame, rows: int) -> DataFrame:
    """v with a row and a column offset in its name for the 3 x 3 pixels around each (n, p, z: -1, 1, 0), and h, which
    is NULL where there is no such pixel, for the four nearest."""
    across = Window.partitionBy("row").orderBy("col")
    at = lambda k: F.first("value").over(across.rangeBetween(k, k))
    there = lambda k: F.first(F.lit(1)).over(across.rangeBetween(k, k))
    wide = pixels.withColumns({"left": at(-1), "right": at(1), "hzn": there(-1), "hzp": there(1)})
    blocks = _blocks(wide, 1, rows)
    names = {"n": -1, "z": 0, "p": 1}
    out = {f"v{a}{b}": F.first(c).over(_along(k)) for a, k in names.items() for b, c in (("n", "left"), ("z", "value"), ("p", "right"))}
    edges = {f"h{a}z": F.first(F.lit(1)).over(_along(k)) for a, k in (("n", -1), ("p", 1))}
    return blocks.withColumns(out | edges).where("home")


def horn_slope(pixels: DataFrame, resolution: float, rows: int = 1024) -> DataFrame:
    """Slope in degrees by Horn's 3 x 3 kernel; NULL at borders and wherever one of the nine pixels is invalid."""
    if resolution <= 0:
        raise ValueError("the resolution must be positive")
    c = F.col
    dx = (c("vnp") + 2 * c("vzp") + c("vpp") - c("vnn") - 2 * c("vzn") - c("vpn")) / (8 * resolution)
    dy = (c("vpn") + 2 * c("vpz") + c("vpp") - c("vnn") - 2 * c("vnz") - c("vnp")) / (8 * resolution)
    slope = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    return _neighbours(pixels, rows).select("row", "col", F.when(c("vzz").isNotNull(), slope).alias("slope"))


def feature_stack(pixels: DataFrame, plan: Sequence[Feature], resolution: float) -> DataFrame:
    """row, col and the features of a plan, in its order, from pixels (row, col and the plan's input columns).

    A feature is NULL wherever one of its inputs is, and nothing is clipped to a feature's span. Slopes are taken from
    blocks of rows; all other features are Columns of the same pixel, so that only the inputs that are named are read."""
    out = pixels
    for f in plan:
        if f.transform == "slope_horn_degrees":
            slope = horn_slope(pixels.select("row", "col", F.col(f.inputs[0]).alias("value")), resolution)
            out = out.join(slope.select("row", "col", F.col("slope").alias(f.name)), ["row", "col"])
    return out.select("row", "col", *[c.alias(n) for n, c in feature_columns(plan).items()])


def central_slope(pixels: DataFrame, resolution: float, rows: int = 1024) -> DataFrame:
    """Slope in degrees by central differences, one-sided beside pixels that are absent: another kernel than
    horn_slope(). An invalid pixel that a difference needs makes the slope NULL."""

    def gradient(a: str, b: str) -> Column:
        before, here, after = F.col(f"v{a}"), F.col("vzz"), F.col(f"v{b}")
        has_before, has_after = F.col(f"h{a}").isNotNull(), F.col(f"h{b}").isNotNull()
        return F.when(has_before & has_after, (after - before) / (2 * resolution)).when(has_after, (after - here) / resolution).when(has_before, (here - before) / resolution)

    n = _neighbours(pixels, rows)
    dx, dy = gradient("zn", "zp"), gradient("nz", "pz")
    return n.select("row", "col", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"))


def erode4(pixels: DataFrame, times: int = 1, rows: int = 1024) -> DataFrame:
    """Iterated erosion of a 0/1 value by the four neighbours; outside the raster counts as 0."""
    out = pixels
    for _ in range(times):
        around = [F.coalesce(F.col(x), F.lit(0)) for x in ("vnz", "vpz", "vzn", "vzp", "vzz")]
        out = _neighbours(out, rows).select("row", "col", F.least(*around).alias("value"))
    return out
