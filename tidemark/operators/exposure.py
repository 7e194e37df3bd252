"""Exposure of lines, polygons and points to a class raster, closures and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import exploded

EPS = 1e-6
#: Road status by priority, the first that any part of a way has.
PRIORITY = ("CANDIDATE_EXPOSED", "NOT_OBSERVED", "NOT_CANDIDATE", "OUTSIDE_GRID")


def line_status(length: Column, flooded: Column, unknown: Column, outside: Column, rule: float = 10.0) -> Column:
    enough = F.least(F.lit(rule), length) - EPS
    return F.when(outside >= length - EPS, "NOT_OBSERVED").when(flooded >= enough, "EXPOSED").when(unknown >= enough, "UNKNOWN").otherwise("NOT_EXPOSED")


def polygon_status(pixels: Column, flooded: Column, unknown: Column, least: int = 1) -> Column:
    return F.when(pixels == 0, "NOT_OBSERVED").when(flooded >= least, "EXPOSED").when(unknown >= least, "UNKNOWN").otherwise("NOT_EXPOSED")


def not_candidate(length: Column, candidate: Column, unobserved: Column, outside: Column) -> Column:
    return F.greatest(F.lit(0.0), length - candidate - unobserved - outside)


def removed(length: Column, flooded: Column, unknown: Column, threshold: float, block_unknown: bool, outside: Column | None = None) -> Column:
    """Whether a piece closes: flooded (or, if pessimistic, unknown) for the threshold or its whole length; never, if it
    is known to lie outside the grid, where nothing was looked at."""
    enough = F.least(F.lit(threshold), length) - EPS
    hit = (flooded >= enough) | (unknown >= enough) if block_unknown else flooded >= enough
    closed = (length > 0) & hit
    return closed if outside is None else closed & ~F.coalesce(outside, F.lit(False))


def closure_label(closed: Column, closed_pessimistic: Column) -> Column:
    return F.when(closed, "CLOSED_CANDIDATE").when(closed_pessimistic, "CLOSED_ONLY_IF_UNOBSERVED").otherwise("OPEN")


def road_quantities(pieces: DataFrame, way: str) -> DataFrame:
    """Summed lengths per way (NULL counts as 0, a NULL way is a way) and its status by priority."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(PRIORITY) for x in (s, i)])
    sums = [F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("length", "candidate", "unobserved")]
    return pieces.groupBy(way).agg(*sums, F.min_by("status", order[F.col("status")]).alias("status"), F.count("*").alias("parts"))


def by_status_and_total(rows: DataFrame, group: str, status: str, length: str, statuses: list[str]) -> DataFrame:
    """Count and length of every status in every group, zero where absent, and of the group as status ALL."""
    found = rows.groupingSets([[F.col(group), F.col(status)], [F.col(group)]], F.col(group), F.col(status)).agg(F.count("*").alias("n"), F.sum(length).alias("length"), F.grouping_id().alias("g"))
    found = found.select(group, F.when(F.col("g") > 0, "ALL").otherwise(F.col(status)).alias(status), "n", "length")
    dense = rows.select(group).distinct().withColumn(status, F.explode(F.array(*map(F.lit, [*statuses, "ALL"]))))
    return dense.join(found, [group, status], "left").select(group, status, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("length", F.lit(0.0)).alias("length"))


def sensitivity(pieces: DataFrame, thresholds: list[float]) -> DataFrame:
    """Closed pieces and length under each threshold, candidate and pessimistic, in one pass."""
    rows = pieces.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    enough = F.least(F.col("threshold"), F.col("length")) - EPS
    some = F.col("length") > 0
    closed, worse = some & (F.col("flooded") >= enough), some & ((F.col("flooded") >= enough) | (F.col("unknown") >= enough))
    return rows.groupBy("threshold").agg(F.count_if(closed).alias("closed"), F.sum(F.when(closed, F.col("length")).otherwise(0.0)).alias("closed_length"), F.count_if(worse).alias("pessimistic"), F.sum(F.when(worse, F.col("length")).otherwise(0.0)).alias("pessimistic_length"))


def sample_points(points: DataFrame, classes: DataFrame, pixel: float, outside: int = -1) -> DataFrame:
    """points (x, y, ...) with the class of the pixel under each; outside the grid: -1."""
    at = points.withColumns({"row": F.floor(F.col("y") / pixel).cast("bigint"), "col": F.floor(F.col("x") / pixel).cast("bigint")})
    return at.join(exploded(classes.select("row", "col", "class")), ["row", "col"], "left").withColumn("class", F.coalesce("class", F.lit(outside)))


def measure_lines(lines: DataFrame, classes: DataFrame, key: str, pixel: float, step: float) -> DataFrame:
    """key, class, metres: each segment (x0, y0, x1, y1) is cut into max(1, ceil(length / step)) parts whose midpoints
    are looked up; a line without length isn't sampled."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    cut = lines.withColumn("len", length).where("len > 0").withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("len") / step)).cast("int"))
    parts = cut.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("t", (F.col("i") + 0.5) / F.col("n"))
    points = parts.select(key, (F.col("len") / F.col("n")).alias("share"), (F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0"))).alias("y"))
    return sample_points(points, classes, pixel).groupBy(key, "class").agg(F.sum("share").alias("metres"))


def measure_boxes(boxes: DataFrame, classes: DataFrame, key: str, pixel: float) -> DataFrame:
    """key, class, pixels: pixels that a rectangle (x0, y0, x1, y1) touches, counted by class; outside the grid none."""
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / pixel).cast("bigint"), F.floor(F.col(b) / pixel).cast("bigint"))
    at = boxes.select(key, F.explode(cells("y0", "y1")).alias("row"), "x0", "x1").select(key, "row", F.explode(cells("x0", "x1")).alias("col"))
    return at.join(exploded(classes), ["row", "col"]).groupBy(key, "class").agg(F.count("*").alias("pixels"))


def _edges(rings: DataFrame, key: str) -> DataFrame:
    """The edges (ax, ay, bx, by) of closed rings (key, points); several rings of a key are its parts and holes."""

    def edge(p: Column, i: Column) -> Column:
        q = F.get("points", (i + 1) % F.size("points"))
        return F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))

    return rings.select(key, F.explode(F.transform("points", edge)).alias("e")).select(key, "e.*")


def _steps(lo: Column, hi: Column, pixel: float, more: int = 0) -> Column:
    return F.sequence(F.floor(lo / pixel).cast("bigint") - more, F.floor(hi / pixel).cast("bigint") + more)


def cells_inside(rings: DataFrame, key: str, pixel: float) -> DataFrame:
    """key, row, col of the pixels whose centre lies in a polygon (even-odd over all rings of a key).

    Each edge gives its crossing with each row of centres it passes; a row's crossings in order are the ends of its
    runs, so the work grows with the outline and the pixels found, not with the extent. Rings that are NULL, empty or
    flat have none."""
    y = (F.col("row") + 0.5) * pixel
    at = _edges(rings, key).where("ay <> by").withColumn("row", F.explode(_steps(F.least("ay", "by"), F.greatest("ay", "by"), pixel)))
    x = (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    ends = at.where((F.col("ay") > y) != (F.col("by") > y)).groupBy(key, "row").agg(F.sort_array(F.collect_list(x)).alias("x"))
    pair = F.transform(F.sequence(F.lit(0), (F.size("x") / 2).cast("int") - 1), lambda i: F.struct(F.get("x", 2 * i).alias("a"), F.get("x", 2 * i + 1).alias("z")))
    runs = ends.select(key, "row", F.explode(pair).alias("run")).select(key, "row", "run.*")
    cells = runs.withColumn("col", F.explode(_steps(F.col("a"), F.col("z"), pixel, 1)))
    centre = (F.col("col") + 0.5) * pixel
    return cells.where((centre >= F.col("a")) & (centre < F.col("z"))).select(key, "row", "col")


def cells_touched(rings: DataFrame, key: str, pixel: float) -> DataFrame:
    """key, row, col of all pixels that a polygon touches: those its edges pass, and those whose centre is inside."""
    lo, hi = F.least("ay", "by"), F.greatest("ay", "by")
    at = _edges(rings, key).withColumn("row", F.explode(_steps(lo, hi, pixel)))

    def x(y: Column) -> Column:
        return F.coalesce(F.col("ax") + F.try_divide(y - F.col("ay"), F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax")), F.col("ax"))

    flat = F.col("ay") == F.col("by")
    a = F.when(flat, F.col("ax")).otherwise(x(F.greatest(lo, F.col("row") * pixel)))
    z = F.when(flat, F.col("bx")).otherwise(x(F.least(hi, (F.col("row") + 1) * pixel)))
    passed = at.select(key, "row", F.explode(_steps(F.least(a, z), F.greatest(a, z), pixel)).alias("col"))
    return passed.unionByName(cells_inside(rings, key, pixel)).distinct()


def measure_rings(rings: DataFrame, classes: DataFrame, key: str, pixel: float, all_touched: bool = True) -> DataFrame:
    """key, class, pixels: pixels of a polygon counted by class; a polygon outside the grid has no row."""
    cells = (cells_touched if all_touched else cells_inside)(rings, key, pixel)
    return cells.join(exploded(classes.select("row", "col", "class")), ["row", "col"]).groupBy(key, "class").agg(F.count("*").alias("pixels"))
