"""Road graphs: lines cut into pieces at junctions, and points snapped to the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import geo


def pieces(lines: DataFrame, way: str, places: int = 2) -> DataFrame:
    """way, part, u, v (nodes as (x, y)), length of the pieces between junctions. lines: way, points.

    Vertices are nodes by their rounded coordinates. A junction is the first or last vertex of a line, or a node that
    occurs more than once, in this line or another. A piece may have u = v or no length; such pieces aren't routable."""
    at = lines.select(way, F.size("points").alias("n"), F.posexplode("points").alias("pos", "p"))
    at = at.select(way, "n", "pos", F.struct(F.round("p.x", places).alias("x"), F.round("p.y", places).alias("y")).alias("node"))
    often = at.groupBy("node").agg(F.count("*").alias("times")).where("times > 1").select("node", F.lit(True).alias("shared"))
    marked = at.join(often, "node", "left").withColumn("junction", F.coalesce("shared", F.lit(False)) | (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1))
    along = Window.partitionBy(way).orderBy("pos")
    steps = marked.withColumns({"part": F.sum(F.col("junction").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("node").over(along)}).where("next is not null")
    step = F.hypot(F.col("next.x") - F.col("node.x"), F.col("next.y") - F.col("node.y"))
    return steps.groupBy(way, "part").agg(F.min_by("node", "pos").alias("u"), F.max_by("next", "pos").alias("v"), F.sum(step).alias("length"))


def snapped(points: DataFrame, graph: DataFrame, radius: float = 500.0) -> DataFrame:
    """points (id, x, y) with node and distance of the nearest node within the radius, ties to the lesser node."""
    nodes = graph.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", "id.x", "id.y")
    return geo.nearest_within(points, nodes, radius).select(*points.columns, F.col("target_id").alias("node"), "distance")


def shrunk_components(before: DataFrame, after: DataFrame) -> DataFrame:
    """node, before, after: nodes whose component has fewer nodes after closures (labels: node, component)."""
    sized = lambda d, n: d.join(d.groupBy("component").agg(F.count("*").alias(n)), "component").select("node", n)
    both = sized(before, "before").join(sized(after, "after"), "node", "left").withColumn("after", F.coalesce("after", F.lit(1)))
    return both.where("after < before")
