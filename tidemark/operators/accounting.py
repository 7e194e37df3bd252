"""Areas of interest against a raster, with every denominator by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.exposure import cells_inside
from tidemark.operators.graph import exploded
from tidemark.operators.overlay import literal_ring, overlay_areas


def scope_accounting(pixels: DataFrame, aoi: Sequence[tuple[float, float]], pixel: float, width: int, height: int) -> DataFrame:
    """One row on an area of interest and a raster of width x height pixels from (0, 0).

    Three areas are kept apart: the geometric one of the polygon; the delivered one, which the raster's window reaches;
    and that of the pixels whose centre lies inside. Pixels (row, col, valid, candidate) are counted inside only, and
    each ratio names what it is a share of; one without a denominator is NULL. A pixel that the table lacks is not
    valid; a polygon without area gives zeros and NULL ratios."""
    spark = pixels.sparkSession
    window = [(0.0, 0.0), (width * pixel, 0.0), (width * pixel, height * pixel), (0.0, height * pixel)]
    rings = spark.range(1).select(F.lit(0).alias("k"), F.inline(F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(n).alias("poly"), literal_ring(r).alias("points")) for n, r in (("aoi", aoi), ("window", window))])))
    areas = overlay_areas(rings, ["k"], ["aoi", "window"], {"geometric": lambda d, _: d("aoi") > 0, "delivered": lambda d, _: (d("aoi") > 0) & (d("window") > 0)})
    inside = cells_inside(rings.where("layer = 'aoi'"), "k", pixel).where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    seen = inside.join(exploded(pixels.select("row", "col", "valid", "candidate")), ["row", "col"], "left")
    tally = seen.agg(F.count("*").alias("centers"), F.count_if(F.col("valid")).alias("valid"), F.count_if(F.col("valid") & F.col("candidate")).alias("candidates")).withColumn("k", F.lit(0))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    both = areas.join(tally, "k").withColumn("delivered", F.least("delivered", "geometric"))
    return both.select(
        "geometric", "delivered", (F.col("geometric") - F.col("delivered")).alias("unobserved"), share("delivered", "geometric").alias("delivered_of_geometric"),
        "centers", (F.col("centers") * pixel * pixel).alias("center_area"), (F.lit(width * height) - F.col("centers")).alias("outside"), "valid", (F.col("centers") - F.col("valid")).alias("delivered_but_invalid"), share("valid", "centers").alias("valid_of_centers"),
        "candidates", share("candidates", "valid").alias("candidates_of_valid"), share("candidates", "centers").alias("candidates_of_centers"), F.try_divide(F.col("candidates") * pixel * pixel, F.col("geometric")).alias("candidates_of_geometric"),
    )
