"""Overlay of polygons of many tables: areas of unions, intersections and other combinations, by slabs between events.

Edges are cut into bands of their group. Events of a band are the ends of its edges and the places where edges cross;
between neighbouring events no edges cross, so that edges in order of x bound trapezoids, and running sums over them
tell how many polygons of each layer cover what lies between. All steps are equality joins, windows and sums."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import written

Layer = Callable[[str], Column]
#: From the depth of layers (polygons that cover a place) and their totals (polygons of the group): whether it counts.
Measure = Callable[[Layer, Layer], Column]


def ring_edges(rings: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep and the edges (ax, ay, bx, by) of closed rings (points); a ring with a NULL, NaN or infinite coordinate has none."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    sound = rings.where(F.coalesce(F.forall("points", lambda p: finite(p["x"]) & finite(p["y"])), F.lit(False)))

    def edge(p: Column, i: Column) -> Column:
        q = F.get("points", (i + 1) % F.size("points"))
        return F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))

    return sound.select(*keep, F.inline(F.transform("points", edge)))


def _x(y: Column, of: str = "") -> Column:
    x0, y0, x1, y1 = (F.col(f"{of}{c}") for c in ("x0", "y0", "x1", "y1"))
    return x0 + (x1 - x0) * ((y - y0) / (y1 - y0))


def _bands(rings: DataFrame, layers: Sequence[str], per_band: int) -> DataFrame:
    """Upward edges (x0, y0, x1, y1) of (g, layer, poly) in each band they pass, with their part [a, z] there."""
    e = ring_edges(rings, ["g", "layer", "poly"]).where("ay <> by")
    low, high = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    up = F.col("ay") < F.col("by")
    e = e.select("g", "layer", "poly", F.when(up, low).otherwise(high).alias("p"), F.when(up, high).otherwise(low).alias("q"))
    e = e.select("g", "layer", "poly", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("q.x").alias("x1"), F.col("q.y").alias("y1"))
    box = e.groupBy("g").agg(F.count("*").alias("n"), F.min("y0").alias("south"), F.max("y1").alias("north"), F.min(F.least("x0", "x1")).alias("west"), F.max(F.greatest("x0", "x1")).alias("east"))
    polys = rings.groupBy("g").agg(*[F.countDistinct(F.when(F.col("layer") == name, F.col("poly"))).alias(f"total_{name}") for name in layers])
    placed = e.join(box, "g").join(polys, "g").withColumn("bands", F.ceil(F.col("n") / per_band))
    high_ = (F.col("north") - F.col("south")) / F.col("bands")
    at = lambda y: F.greatest(F.lit(0), F.least(F.col("bands") - 1, F.floor((F.col(y) - F.col("south")) / high_)))
    cut = placed.withColumn("band", F.explode(F.sequence(F.greatest(F.lit(0), at("y0") - 1), F.least(F.col("bands") - 1, at("y1") + 1))))
    edge_of = lambda k: F.when(k >= F.col("bands"), F.col("north")).otherwise(F.col("south") + k * high_)
    cut = cut.withColumns({"a": F.greatest("y0", edge_of(F.col("band"))), "z": F.least("y1", edge_of(F.col("band") + 1))}).where("z > a")
    cell = lambda x: F.floor((x - F.col("west")) / F.greatest(F.lit(1e-300), (F.col("east") - F.col("west")) / F.col("bands")))
    xa, xz = _x(F.col("a")), _x(F.col("z"))
    return cut.select("g", "band", "layer", "poly", "x0", "y0", "x1", "y1", "a", "z", cell(F.least(xa, xz)).alias("c0"), cell(F.greatest(xa, xz)).alias("c1"), *[f"total_{name}" for name in layers])


def _slabs(cut: DataFrame) -> DataFrame:
    """g, band, low, high between neighbouring events. Equal edges are one for finding crossings; others meet in cells."""
    shape = ["x0", "y0", "x1", "y1", "a", "z"]
    cells = cut.select("g", "band", "c0", "c1", *shape).distinct().withColumn("cell", F.explode(F.sequence("c0", "c1")))
    p, q = (cells.select("g", "band", "cell", *[F.col(c).alias(f"{k}{c}") for c in shape], F.struct(*shape).alias(k)) for k in "pq")
    both = p.join(q, ["g", "band", "cell"]).where("p < q")
    low, high = F.greatest("pa", "qa"), F.least("pz", "qz")
    both = both.select("g", "band", *[f"{k}{c}" for k in "pq" for c in shape[:4]], low.alias("low"), high.alias("high")).where("low < high")
    gap = lambda y: _x(F.col(y), "p") - _x(F.col(y), "q")
    met = both.select("g", "band", "low", "high", gap("low").alias("d"), gap("high").alias("e")).where("d * e < 0")
    met = met.select("g", "band", (F.col("low") + (F.col("high") - F.col("low")) * F.col("d") / (F.col("d") - F.col("e"))).alias("y"))
    events = cut.select("g", "band", F.explode(F.array("a", "z")).alias("y")).unionByName(met).distinct()
    after = F.lead("y").over(Window.partitionBy("g", "band").orderBy("y"))
    return events.select("g", "band", F.col("y").alias("low"), after.alias("high")).where("high is not null")


def overlay_areas(rings: DataFrame, by: Sequence[str], layers: Sequence[str], measures: dict[str, Measure], per_band: int = 16) -> DataFrame:
    """by, and per measure the area of the places for which it holds.

    rings: by, layer, poly, points (array of x, y). The rings of one (by, layer, poly) are a polygon's parts and holes
    (even-odd); polygons of a layer may overlap. A measure takes depth(layer), the number of the layer's polygons over
    a place, and total(layer), their number in the group. Bands hold about per_band edges that begin there, so a large
    group is spread over many. Defined results: keys may be NULL and are a group of their own; rings that are NULL,
    empty, flat or have a coordinate that is not finite have no area; a group without any has areas of 0."""
    rings = rings.select(F.struct(*by).alias("g"), "layer", "poly", "points")
    cut = written(_bands(rings, layers, per_band))
    slabs = _slabs(cut)
    strip = cut.join(slabs, ["g", "band"]).where("a <= low and z >= high")
    strip = strip.select("g", "band", "low", "layer", "poly", (F.col("high") - F.col("low")).alias("height"), _x((F.col("low") + F.col("high")) / 2).alias("x"), *[f"total_{name}" for name in layers]).repartition("g", "band", "low")
    slab = Window.partitionBy("g", "band", "low")
    nth = F.row_number().over(Window.partitionBy("g", "band", "low", "layer", "poly").orderBy("x"))
    strip = strip.withColumn("turn", F.when(nth % 2 == 1, 1).otherwise(-1))
    upto = slab.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    depths = {f"depth_{name}": F.sum(F.when(F.col("layer") == name, F.col("turn")).otherwise(0)).over(upto) for name in layers}
    gaps = strip.withColumns(depths | {"area": (F.lead("x").over(slab.orderBy("x")) - F.col("x")) * F.col("height")})
    depth, total = (lambda name: F.col(f"depth_{name}")), (lambda name: F.col(f"total_{name}"))
    sums = gaps.groupBy("g").agg(*[F.coalesce(F.sum(F.when(m(depth, total), F.col("area"))), F.lit(0.0)).alias(name) for name, m in measures.items()])
    every = rings.select("g").distinct().alias("r").join(sums.alias("s"), F.col("r.g") == F.col("s.g"), "left")
    return every.select(*[F.col(f"r.g.{c}").alias(c) for c in by], *[F.coalesce(f"s.{name}", F.lit(0.0)).alias(name) for name in measures])


def literal_ring(points: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def _footprints(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """The different rings of each group as polygons; one that is NULL counts, though nothing lies in it."""
    return items.select(*by, F.lit("item").alias("layer"), F.coalesce(F.to_json("points"), F.lit("")).alias("poly"), "points").distinct()


def union_coverage(items: DataFrame, by: Sequence[str], aoi: Sequence[tuple[float, float]]) -> DataFrame:
    """by and coverage: the fraction of the area of interest that the union of a group's items (by, points)
    covers, within 0 and 1. Equal footprints count once; a ratio of areas does not change with the scale of an axis."""
    rings = _footprints(items, by)
    target = items.select(*by).distinct().select(*by, F.lit("aoi").alias("layer"), F.lit("").alias("poly"), literal_ring(aoi).alias("points"))
    areas = overlay_areas(rings.unionByName(target), by, ["item", "aoi"], {"aoi": lambda d, _: d("aoi") > 0, "shared": lambda d, _: (d("aoi") > 0) & (d("item") > 0)})
    return areas.select(*by, F.least(F.lit(1.0), F.coalesce(F.try_divide("shared", "aoi"), F.lit(0.0))).alias("coverage"))


def segment_distance(a: str, b: str) -> Column:
    """Distance of two segments (prefix + ax, ay, bx, by) that don't cross: the least of an end from the other segment."""

    def off(px: str, py: str, s: str) -> Column:
        x, y, ax, ay, bx, by = map(F.col, (px, py, f"{s}ax", f"{s}ay", f"{s}bx", f"{s}by"))
        dx, dy = bx - ax, by - ay
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.hypot(ax + t * dx - x, ay + t * dy - y)

    return F.least(*[off(f"{p}{e}x", f"{p}{e}y", s) for p, s in ((a, b), (b, a)) for e in "ab"])


def common_clearance(items: DataFrame, by: Sequence[str], aoi: Sequence[tuple[float, float]], inset: float) -> DataFrame:
    """by, common_area (of what all items of a group cover), shared_area (of that, within the area of interest), covered
    (it holds all of it, to 1e-9), clearance (least distance from it to the boundary, 0 unless covered) and accepted.

    A boundary nearest to the inside of an intersection is the nearest of its members' boundaries, so that distances
    are taken to the items' own edges, and the intersection is never built."""
    if not inset >= 0 or inset == float("inf"):
        raise ValueError("the inset is a finite distance, 0 at least")
    rings = _footprints(items, by)
    groups = items.select(*by).distinct()
    target = groups.select(*by, F.lit("aoi").alias("layer"), F.lit("").alias("poly"), literal_ring(aoi).alias("points"))
    every: Measure = lambda d, n: d("item") == n("item")
    areas = overlay_areas(rings.unionByName(target), by, ["item", "aoi"], {"common_area": every, "shared_area": lambda d, n: every(d, n) & (d("aoi") > 0), "aoi": lambda d, _: d("aoi") > 0})
    prefixed = lambda df, p: ring_edges(df, by).select(F.struct(*by).alias("_group"), *[F.col(c).alias(f"{p}{c}") for c in ("ax", "ay", "bx", "by")])
    near = prefixed(rings, "i_").join(prefixed(target, "t_"), "_group").groupBy("_group").agg(F.min(segment_distance("i_", "t_")).alias("off"))
    covered = F.col("shared_area") >= F.col("aoi") * (1 - 1e-9)
    both = areas.withColumn("_group", F.struct(*by)).join(near, "_group", "left")
    clearance = F.when(covered, F.coalesce("off", F.lit(0.0))).otherwise(0.0)
    return both.select(*by, "common_area", "shared_area", covered.alias("covered"), clearance.alias("clearance"), (covered & (clearance >= inset)).alias("accepted"))
