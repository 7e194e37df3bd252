"""Line lens: each part is a line around three sides of its box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import lines as L
from tidemark.functions.raster import quantised
from tidemark.operators import accounting, graph, nearest, roads
from tidemark.plans.common import Lens, table
from tidemark.plans.places import _B, TRIANGLE, boxes, classes

lens = Lens()
_Q = lambda x, s="1e3": f"CAST(floor(({x}) * {s} + 0.5) AS BIGINT)"
_V = f"""{_B}, v AS (SELECT id, 0 AS pos, x0 AS x, y0 AS y FROM b UNION ALL SELECT id, 1, x1, y0 FROM b UNION ALL SELECT id, 2, x1, y1 FROM b UNION ALL SELECT id, 3, x0, y1 FROM b)"""


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    corners = F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1"))
    return boxes(spark, sf_dir).select("id", corners.alias("points"), "x0", "y0")


_PIECES = f"""{_V}, j AS (SELECT *, pos IN (0, 3) OR count(*) OVER (PARTITION BY x, y) > 1 AS junction FROM v),
s AS (SELECT *, sum(CASE WHEN junction THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part, lead(x) OVER (PARTITION BY id ORDER BY pos) AS nx, lead(y) OVER (PARTITION BY id ORDER BY pos) AS ny FROM j)"""


@lens(f"{_PIECES} SELECT id, CAST(part AS BIGINT) AS part, {_Q('min_by(x, pos)')} AS ux, {_Q('min_by(y, pos)')} AS uy, {_Q('max_by(nx, pos)')} AS vx, {_Q('max_by(ny, pos)')} AS vy, {_Q('sum(sqrt(power(nx - x, 2) + power(ny - y, 2)))')} AS length FROM s WHERE nx IS NOT NULL GROUP BY id, part")
def n_road_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = roads.pieces(outlines(spark, sf_dir), "id")
    return p.select("id", "part", *[quantised(F.col(f"{n}.{c}"), 1e3).alias(f"{n}{c}") for n in "uv" for c in "xy"], quantised(F.col("length"), 1e3).alias("length"))


@lens()
def n_shrunk_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose component shrinks when pieces of over 30 metres close."""
    p = graph.written(roads.pieces(outlines(spark, sf_dir), "id").select(F.to_json("u").alias("a"), F.to_json("v").alias("b"), "length"))
    return roads.shrunk_components(graph.components(p), graph.components(p.where("length <= 30")))


@lens(f"""{_V}, s AS (SELECT id, pos, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v WINDOW w AS (PARTITION BY id ORDER BY pos)),
l AS (SELECT *, sqrt(power(nx - x, 2) + power(ny - y, 2)) AS len FROM s WHERE nx IS NOT NULL), o AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
least(1, greatest(0, coalesce(((200 - x) * (nx - x) + (205 - y) * (ny - y)) / nullif(power(nx - x, 2) + power(ny - y, 2), 0), 0))) AS t FROM l),
d AS (SELECT id, sqrt(power(x + t * (nx - x) - 200, 2) + power(y + t * (ny - y) - 205, 2)) AS dist, start + t * len AS along FROM o)
SELECT id, {_Q('min(dist)')} AS distance, {_Q('min_by(along, (dist, along))')} AS along, min(dist) <= 40 AS near FROM d GROUP BY id""")
def b_nearest_on_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.lit(200.0), F.lit(205.0)
    near = outlines(spark, sf_dir).select("id", L.nearest_point(F.col("points"), x, y).alias("n"))
    return near.select("id", quantised(F.col("n.distance"), 1e3).alias("distance"), quantised(F.col("n.along"), 1e3).alias("along"), (F.col("n.distance") <= 40).alias("near"))


_N = [repr(a) for a in L.ALPHA]
_XI, _ETA = "atan2(t, cos(lam))", "atanh(sin(lam) / sqrt(1 + t * t))"


@lens(f"""{_B}, g AS (SELECT id, radians(x0 / 90 - 2) AS lam, radians(y0 / 10 - 25) AS phi, y0 / 10 - 25 < 0 AS south FROM b), t AS (SELECT *, sinh(atanh(sin(phi)) - {L.ECCENTRIC!r} * atanh({L.ECCENTRIC!r} * sin(phi))) AS t FROM g), z AS (SELECT id, south, {_XI} AS xi, {_ETA} AS eta FROM t)
SELECT id, {_Q(f"500000 + {L.SCALE * L.RADIUS!r} * (eta + " + " + ".join(f"{a} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_N, 1)) + ")", "100")} AS east,
{_Q(f"{L.SCALE * L.RADIUS!r} * (xi + " + " + ".join(f"{a} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_N, 1)) + ") + CASE WHEN south THEN 1e7 ELSE 0 END", "100")} AS north FROM z""")
def b_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone 45 (87 degrees east) in centimetres."""
    east, north = L.utm(F.col("x0") / 90 - 2 + 87, F.col("y0") / 10 - 25, F.lit(45))
    return boxes(spark, sf_dir).select("id", quantised(east, 100).alias("east"), quantised(north, 100).alias("north"))


@lens()
def b_polygon_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each box inside a triangle; held against plain clipping in the tests."""
    o = outlines(spark, sf_dir)
    return o.select("id", F.try_divide(L.area(L.clipped(F.col("points"), TRIANGLE)), L.area(F.col("points"))).alias("share"))


@lens(f"{_B} SELECT id, {_Q('2 * (x1 - x0) + (y1 - y0)')} AS length, {_Q('least(10, 2 * (x1 - x0) + (y1 - y0))')} AS first10 FROM b")
def b_line_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each line and of its first ten metres."""
    p = F.col("points")
    return outlines(spark, sf_dir).select("id", quantised(L.length(p), 1e3).alias("length"), quantised(L.length(L.part(p, F.lit(0.0), F.lit(10.0))), 1e3).alias("first10"))


@lens(f"""{_B}, l AS (SELECT id, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy FROM b), p AS (SELECT vec_id AS point, 200 + CAST(embedding[1] AS DOUBLE) * 2000 AS x, 50 + CAST(embedding[2] AS DOUBLE) * 2000 AS y FROM embeddings),
m AS (SELECT point, id, x, y, x0, y0, dx, dy, least(1, greatest(0, coalesce(((x - x0) * dx + (y - y0) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM p, l),
d AS (SELECT point, id, sqrt(power(x0 + t * dx - x, 2) + power(y0 + t * dy - y, 2)) AS distance FROM m)
SELECT point, CASE WHEN min(distance) <= 500 THEN {_Q('min(distance)')} END AS distance FROM d GROUP BY point""")
def b_nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far points are from the nearest of all diagonals of boxes, up to 500 metres."""
    diagonal = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y1"))])
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point"), (200 + F.col("embedding")[0].cast("double") * 2000).alias("x"), (50 + F.col("embedding")[1].cast("double") * 2000).alias("y"))
    found = nearest.nearest_lines(points, boxes(spark, sf_dir).select("id", diagonal.alias("points")), "point", "id", 20.0, 500.0)
    return found.select("point", quantised(F.col("distance"), 1e3).alias("distance"))


@lens(f"""WITH c AS (SELECT vec_id AS row, unnest(range(64)) AS col, unnest(embedding) AS e FROM embeddings), i AS (SELECT e > 0 AS valid, e > 0.1 AS candidate FROM c WHERE (col + 0.5) * 10 > 40.3 AND (row + 0.5) * 10 > 20.7 AND ((col + 0.5) * 10 - 40.3) / 800 + ((row + 0.5) * 10 - 20.7) / 600 < 1),
n AS (SELECT count(*) AS centers, count(*) FILTER (valid) AS valid, count(*) FILTER (candidate) AS candidates FROM i)
SELECT 240000000 AS geometric, {_Q('240000 * (1 - power(200.3 / 800, 2))')} AS delivered, centers, (SELECT count(*) * 64 FROM embeddings) - centers AS outside, valid, centers - valid AS delivered_but_invalid, candidates,
{_Q('candidates / valid', '1e6')} AS candidates_of_valid, {_Q('candidates * 100 / 240000', '1e6')} AS candidates_of_geometric FROM n""")
def b_scope_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle that reaches beyond the raster's right edge: its area, what is delivered of it, and its pixels."""
    c = classes(spark, sf_dir).select("row", "col", (F.col("class") > 0).alias("valid"), (F.col("class") == 2).alias("candidate"))
    height = table(spark, sf_dir, "embeddings").count()
    out = accounting.scope_accounting(c, [(40.3, 20.7), (840.3, 20.7), (40.3, 620.7)], 10.0, 64, height)
    return out.select(*[quantised(F.col(n), 1e3).alias(n) for n in ("geometric", "delivered")], "centers", "outside", "valid", "delivered_but_invalid", "candidates", *[quantised(F.col(n), 1e6).alias(n) for n in ("candidates_of_valid", "candidates_of_geometric")])
