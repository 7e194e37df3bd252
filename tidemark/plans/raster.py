"""Raster lens: row = vec_id div 2, col = place in the embedding; even vec_ids are the scene before, odd ones after.
Values at or below zero have no logarithm, as backscatter does."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import optical
from tidemark.functions import raster as R
from tidemark.operators import change, focal, graph, outline, resample, stats, tensors
from tidemark.plans.common import Lens, table
from tidemark.sources import raster as files

lens = Lens()


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, pre, post: scenes are joined by row before their pixels are exploded."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).cast("bigint").alias("row"), (F.col("vec_id") % 2).alias("side"), "embedding")
    pre, post = e.where("side = 0").select("row", F.col("embedding").alias("pre")), e.where("side = 1").select("row", F.col("embedding").alias("post"))
    cells = pre.join(post, "row").select("row", F.posexplode(F.arrays_zip("pre", "post")).alias("col", "x"))
    return cells.select("row", F.col("col").cast("bigint").alias("col"), R.valid(F.col("x.pre")).alias("pre"), R.valid(F.col("x.post")).alias("post"))


def dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels: vv from even cols, vh from odd ones."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).cast("bigint").alias("row"), (F.col("vec_id") % 2).alias("side"), "embedding")
    pre, post = e.where("side = 0").select("row", F.col("embedding").alias("pre")), e.where("side = 1").select("row", F.col("embedding").alias("post"))
    joined = pre.join(post, "row")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("pre") / 2).cast("int") - 1), lambda i: F.struct(*[F.get(c, 2 * i + k).cast("double").alias(n) for c, k, n in (("pre", 0, "pre_vv"), ("post", 0, "post_vv"), ("pre", 1, "pre_vh"), ("post", 1, "post_vh"))]))
    return joined.select("row", F.posexplode(pairs).alias("col", "x")).select("row", F.col("col").cast("bigint").alias("col"), "x.*")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raster with invalid pixels: row = vec_id, value NULL at or below zero."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "x"))
    return e.select("row", F.col("col").cast("bigint").alias("col"), F.when(F.col("x") > 0, F.col("x").cast("double")).alias("value"))


_PLANES = """WITH p AS (SELECT vec_id // 2 AS row, vec_id % 2 AS side, unnest(range(64)) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
c AS (SELECT a.row, a.col, a.v AS pre, b.v AS post FROM p a JOIN p b ON a.row = b.row AND a.col = b.col AND a.side = 0 AND b.side = 1)"""
_DUAL = _PLANES + """, d AS (SELECT a.row, a.col // 2 AS col, a.pre AS pre_vv, a.post AS post_vv, b.pre AS pre_vh, b.post AS post_vh FROM c a JOIN c b ON a.row = b.row AND b.col = a.col + 1 WHERE a.col % 2 = 0),
g AS (SELECT *, CASE WHEN pre_vv > 0 AND post_vv > 0 THEN 10 * log10(post_vv / pre_vv) END AS dvv, CASE WHEN pre_vh > 0 AND post_vh > 0 THEN 10 * log10(post_vh / pre_vh) END AS dvh FROM d)"""
_GRID = """WITH g AS (SELECT vec_id AS row, unnest(range(64)) AS col, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), v AS (SELECT row, col, CASE WHEN x > 0 THEN x END AS value FROM g)"""
_Q = lambda x, s="1e4": f"CAST(floor(({x}) * {s} + 0.5) AS BIGINT)"
_RATIO = "CASE WHEN pre > 0 AND post > 0 THEN 10 * log10(post / pre) END"


@lens(f"{_PLANES} SELECT row, col, {_Q(_RATIO)} AS ratio FROM c")
def r_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes(spark, sf_dir).select("row", "col", R.quantised(R.log_ratio_db(F.col("post"), F.col("pre"))).alias("ratio"))


@lens(f"{_PLANES} SELECT row, col, {_Q('CASE WHEN pre > 0 THEN 10 * log10(pre) END')} AS pre_db, {_Q('CASE WHEN post > 0 THEN 10 * log10(post) END')} AS post_db, {_Q('post - pre')} AS diff, {_Q('least(pre, 0.15)')} AS clipped, {_Q('pre * 0.5 + 0.1')} AS reflectance, {_Q('coalesce(CASE WHEN pre > 0 THEN pre END, -9999)')} AS filled FROM c")
def r_decibels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pre, post = F.col("pre"), F.col("post")
    return planes(spark, sf_dir).select("row", "col", R.quantised(R.to_db(pre)).alias("pre_db"), R.quantised(R.to_db(post)).alias("post_db"), R.quantised(R.difference(post, pre)).alias("diff"), R.quantised(R.clipped(pre)).alias("clipped"), R.quantised(R.reflectance(pre, 0.5, 0.1)).alias("reflectance"), R.quantised(R.with_nodata(F.when(pre > 0, pre), -9999.0)).alias("filled"))


@lens(f"{_PLANES} SELECT row, col, {_Q('(abs(post) - abs(pre)) / nullif(abs(post) + abs(pre), 0)')} AS nd FROM c")
def r_norm_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes(spark, sf_dir).select("row", "col", R.quantised(R.normalized_difference(F.abs("post"), F.abs("pre"))).alias("nd"))


_RADAR = {"sentinel1_before": {"vv": "pre_vv", "vh": "pre_vh"}, "sentinel1_after": {"vv": "post_vv", "vh": "post_vh"}}
_STACKED = {"s1_vv_pre": "CASE WHEN pre_vv > 0 THEN pre_vv END", "s1_vh_pre": "CASE WHEN pre_vh > 0 THEN pre_vh END", "s1_vv_change_db": "dvv", "s1_vh_change_db": "dvh", "s1_vv_vh_ratio_db_pre": "CASE WHEN pre_vv > 0 AND pre_vh > 0 THEN 10 * log10(pre_vv / pre_vh) END", "s1_vv_vh_ratio_db_post": "CASE WHEN post_vv > 0 AND post_vh > 0 THEN 10 * log10(post_vv / post_vh) END"}


def radar_stack(spark: SparkSession, sf_dir: str, decibels: bool) -> DataFrame:
    """Radar templates over both polarisations, from linear power or from its decibels."""
    plan = R.feature_plan(["s1_change_db", "s1_backscatter_pre", "s1_co_cross_ratio_db_pre", "s1_co_cross_ratio_db_post"], _RADAR, ["vv", "vh"], decibels=decibels)
    given = {c: R.to_db(F.col(c)) if decibels else F.when(F.col(c) > 0, F.col(c)) for roles in _RADAR.values() for c in roles.values()}
    return focal.feature_stack(dual(spark, sf_dir).withColumns(given), plan, 10.0)


@lens(f"{_DUAL} SELECT row, col, " + ", ".join(f"{_Q(x)} AS {n}" for n, x in _STACKED.items()) + " FROM g")
def r_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of linear power."""
    stack = radar_stack(spark, sf_dir, False)
    return stack.select("row", "col", *[R.quantised(F.col(c)).alias(c) for c in stack.columns[2:]])


_IN_DB = _STACKED | {c: f"CASE WHEN {p} > 0 THEN 10 * log10({p}) END" for c, p in (("s1_vv_pre", "pre_vv"), ("s1_vh_pre", "pre_vh"))}


@lens(f"{_DUAL} SELECT row, col, " + ", ".join(f"CAST(floor(({x}) * 1e3 + 0.5001) AS BIGINT) AS {n}" for n, x in _IN_DB.items()) + " FROM g")
def r_features_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same templates where backscatter comes in decibels: differences, with the same meaning as ratios of power.
    Rounded off the half, which engines that subtract logarithms reach differently."""
    stack = radar_stack(spark, sf_dir, True)
    return stack.select("row", "col", *[F.floor(F.col(c) * 1e3 + 0.5001).cast("bigint").alias(c) for c in stack.columns[2:]])


_CASE = "CASE WHEN dvv IS NULL OR dvh IS NULL THEN 255 WHEN dvv <= -3 AND dvh <= -3 THEN 1 ELSE 0 END"


@lens(f"{_DUAL} SELECT row, col, {_CASE} AS candidate FROM g")
def r_change_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    vv, vh = R.log_ratio_db(F.col("post_vv"), F.col("pre_vv")), R.log_ratio_db(F.col("post_vh"), F.col("pre_vh"))
    return dual(spark, sf_dir).select("row", "col", F.coalesce(change.candidate(vv, vh), F.lit(change.NODATA)).alias("candidate"))


@lens(f"{_DUAL}, k AS (SELECT {_CASE} AS c FROM g) SELECT count(*) AS pixels, count(*) FILTER (c <> 255) AS valid, count(*) FILTER (c = 1) AS candidates, {_Q('count(*) FILTER (c = 1) / count(*) FILTER (c <> 255)', '1e6')} AS share, {_Q('count(*) FILTER (c = 1) * 100.0 / 1e6', '1e6')} AS candidate_km2, {_Q('count(*) FILTER (c = 255) / count(*)', '1e6')} AS nodata_share FROM k")
def r_candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("candidate")
    n, valid, hit = F.count("*"), F.count_if(c != 255), F.count_if(c == 1)
    return r_change_candidates(spark, sf_dir).agg(n.alias("pixels"), valid.alias("valid"), hit.alias("candidates"), R.quantised(F.try_divide(hit, valid), 1e6).alias("share"), R.quantised(hit * 100.0 / 1e6, 1e6).alias("candidate_km2"), R.quantised((n - valid) / n, 1e6).alias("nodata_share"))


@lens(f"{_DUAL}, k AS (SELECT row, col, {_CASE} AS c, CASE WHEN (row + col) % 5 = 0 THEN 0 ELSE 1 END AS v, CASE WHEN col BETWEEN 4 AND 27 THEN 1 ELSE 0 END AS a FROM g) SELECT count(*) FILTER (c = 1 AND v <> 1) AS candidate_outside_valid, count(*) FILTER (c = 1 AND a <> 1) AS candidate_outside_aoi, count(*) FILTER (v = 1 AND a <> 1) AS valid_outside_aoi, count(*) FILTER (c = 1) AS candidates, count(*) FILTER (c = 1 AND v = 1 AND a = 1) AS inside FROM k")
def r_leak_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, v, a = F.col("candidate") == 1, (F.col("row") + F.col("col")) % 5 != 0, F.col("col").between(4, 27)
    return r_change_candidates(spark, sf_dir).agg(F.count_if(c & ~v).alias("candidate_outside_valid"), F.count_if(c & ~a).alias("candidate_outside_aoi"), F.count_if(v & ~a).alias("valid_outside_aoi"), F.count_if(c).alias("candidates"), F.count_if(c & v & a).alias("inside"))


@lens(f"{_PLANES}, k AS (SELECT row, col, CASE WHEN pre > 0 THEN 10 * log10(pre) END AS a, CASE WHEN post > 0 THEN 10 * log10(post) END AS b, (row * 7 + col) % 40 AS s FROM c) SELECT row, col, CASE WHEN a IS NULL OR b IS NULL OR s > 20 THEN 255 WHEN b < -10 AND NOT a < -10 AND b - a <= -3 THEN 2 WHEN a < -10 AND b < -10 THEN 1 ELSE 0 END AS class FROM k")
def r_three_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    slope = (F.col("row") * 7 + F.col("col")) % 40
    return planes(spark, sf_dir).select("row", "col", change.three_class(R.to_db(F.col("pre")), R.to_db(F.col("post")), slope, water=-10.0).alias("class"))


_PERCENTS = [1, 5, 25, 50, 75, 95, 99]


@lens(f"{_PLANES}, r AS (SELECT {_Q(_RATIO)} AS q FROM c) SELECT CAST(p AS DOUBLE) AS percent, {_Q('CASE ' + ' '.join(f'WHEN p = {p} THEN quantile_cont(q, {p / 100})' for p in _PERCENTS) + ' END', '100')} AS value FROM r, (SELECT unnest([{', '.join(map(str, _PERCENTS))}]) AS p) WHERE q IS NOT NULL GROUP BY p")
def r_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.percentiles(r_log_ratio(spark, sf_dir), "ratio", _PERCENTS)
    return out.select("percent", R.quantised(F.col("value"), 100).alias("value"))


@lens(f"{_GRID} SELECT col, count(value) AS n, {_Q('avg(value)')} AS mean, {_Q('stddev_pop(value)')} AS std FROM v GROUP BY col")
def r_band_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pooled_stats(grid(spark, sf_dir), ["col"]).select("col", "n", R.quantised(F.col("mean")).alias("mean"), R.quantised(F.col("std")).alias("std"))


@lens(f"{_GRID}, s AS (SELECT col, avg(value) AS m, stddev_pop(value) AS d FROM v GROUP BY col) SELECT row, v.col, {_Q('coalesce((value - m) / nullif(d, 0), 0)')} AS z FROM v JOIN s ON v.col = s.col")
def r_z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    s = stats.pooled_stats(g, ["col"]).select("col", "mean", "std")
    return g.join(s, "col").select("row", "col", R.quantised(R.z_score(F.col("value"), F.col("mean"), F.col("std"))).alias("z"))


@lens(f"""{_GRID}, w AS (SELECT row, col, value, sum(value) OVER h AS s, count(value) OVER h AS n FROM v WINDOW h AS (PARTITION BY row ORDER BY col RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
x AS (SELECT row, col, value, sum(s) OVER h AS s, sum(n) OVER h AS n FROM w WINDOW h AS (PARTITION BY col ORDER BY row RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT row, col, {_Q('CASE WHEN value IS NOT NULL THEN s / n END')} AS mean FROM x""")
def r_boxcar3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.boxcar_mean(grid(spark, sf_dir), 3).select("row", "col", R.quantised(F.col("mean")).alias("mean"))


def _near(table: str, value: str) -> str:
    names = {"n": -1, "z": 0, "p": 1}
    return ", ".join(f"max({value}) FILTER (WHERE n.row = {table}.row + ({r}) AND n.col = {table}.col + ({c})) AS v{a}{b}" for a, r in names.items() for b, c in names.items())


_HOOD = f", h AS (SELECT v.row, v.col, {_near('v', 'n.value')} FROM v JOIN v n ON n.row BETWEEN v.row - 1 AND v.row + 1 AND n.col BETWEEN v.col - 1 AND v.col + 1 GROUP BY v.row, v.col)"
_HORN = "degrees(atan(sqrt(power((vnp + 2 * vzp + vpp - vnn - 2 * vzn - vpn) / 80, 2) + power((vpn + 2 * vpz + vpp - vnn - 2 * vnz - vnp) / 80, 2))))"


@lens(f"{_GRID}{_HOOD} SELECT row, col, {_Q(f'CASE WHEN vzz IS NOT NULL THEN {_HORN} END')} AS slope FROM h")
def r_horn_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.horn_slope(grid(spark, sf_dir), 10.0).select("row", "col", R.quantised(F.col("slope")).alias("slope"))


@lens(f"""{_GRID}{_HOOD} SELECT row, col, {_Q('vzz')} AS dem_elevation, {_Q(f'CASE WHEN vzz IS NOT NULL THEN {_HORN} END')} AS dem_slope_degrees FROM h""")
def r_features_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = R.feature_plan(["dem_slope_degrees", "dem_elevation"], {"dem": {"elevation": "value"}})
    return focal.feature_stack(grid(spark, sf_dir), plan, 10.0).select("row", "col", *[R.quantised(F.col(f.name)).alias(f.name) for f in plan])


_THERE = ", ".join(f"count(*) FILTER (n.row = v.row + {r} AND n.col = v.col + {c}) AS {name}" for name, r, c in (("west", 0, -1), ("east", 0, 1), ("up", -1, 0), ("down", 1, 0)))
_EDGED = f", e AS (SELECT v.row, v.col, {_THERE} FROM v JOIN v n ON n.row BETWEEN v.row - 1 AND v.row + 1 AND n.col BETWEEN v.col - 1 AND v.col + 1 GROUP BY v.row, v.col)"
_GRADIENT = lambda a, b, before, after: f"CASE WHEN e.{before} * e.{after} = 1 THEN ({b} - {a}) / 20 WHEN e.{after} = 1 THEN ({b} - vzz) / 10 ELSE (vzz - {a}) / 10 END"


@lens(f"{_GRID}{_HOOD}{_EDGED} SELECT h.row, h.col, {_Q('degrees(atan(sqrt(power(' + _GRADIENT('vzn', 'vzp', 'west', 'east') + ', 2) + power(' + _GRADIENT('vnz', 'vpz', 'up', 'down') + ', 2))))')} AS slope FROM h JOIN e ON h.row = e.row AND h.col = e.col")
def r_central_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.central_slope(grid(spark, sf_dir), 10.0).select("row", "col", R.quantised(F.col("slope")).alias("slope"))


@lens(_GRID.replace("CASE WHEN x > 0 THEN x END", "CASE WHEN x > -0.1 THEN 1 ELSE 0 END") + f"{_HOOD} SELECT row, col, least(coalesce(vnz, 0), coalesce(vpz, 0), coalesce(vzn, 0), coalesce(vzp, 0), vzz) AS core FROM h")
def r_erode4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "x"))
    bits = e.select("row", F.col("col").cast("bigint").alias("col"), (F.col("x").cast("double") > -0.1).cast("int").alias("value"))
    return focal.erode4(bits).select("row", "col", F.col("value").alias("core"))


@lens()
def r_sieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL that spreads labels over regions takes minutes on the whole raster; brute force in the tests stands for it."""
    bits = grid(spark, sf_dir).select("row", "col", F.coalesce((F.col("value") > 0.05).cast("int"), F.lit(0)).alias("value"))
    return change.sieve(bits, 10)


@lens()
def r_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composed rule: decibels, three classes, sieve; held against brute force in the tests."""
    slope = ((F.col("row") * 7 + F.col("col")) % 40).cast("double")
    return change.classified(planes(spark, sf_dir).withColumn("slope", slope), 1, -8.0, -1.0, 30.0, 10)


_CORNERS = "(VALUES (0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8)) k(dr, dc, bit)"


@lens(f"""{_GRID}, c AS (SELECT row, col, CASE WHEN x > 0.1 THEN 2 WHEN x > -0.1 THEN 1 ELSE 0 END AS value FROM g), q AS (SELECT value, row + dr AS y, col + dc AS x, sum(bit) AS m FROM c, {_CORNERS} GROUP BY ALL),
s AS (SELECT value, count(*) FILTER (m IN (1, 2, 4, 8)) AS one, count(*) FILTER (m IN (7, 11, 13, 14)) AS three, count(*) FILTER (m IN (6, 9)) AS crossed FROM q GROUP BY value)
SELECT s.value, CAST((one - three + 2 * crossed) // 4 AS BIGINT) AS rings_less_holes, one + three + 2 * crossed AS corners, n AS area FROM s JOIN (SELECT value, count(*) AS n FROM c GROUP BY value) USING (value)""")
def r_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of a class raster; SQL counts corners of 2 x 2 pixels, from which outer rings less holes follow."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "x"))
    x = F.col("x").cast("double")
    classes = e.select("row", F.col("col").cast("bigint").alias("col"), F.when(x > 0.1, 2).when(x > -0.1, 1).otherwise(0).alias("value"))
    per = outline.class_summary(outline.outlines(classes))
    return per.select("value", (F.col("outer") - F.col("holes")).alias("rings_less_holes"), "corners", F.col("area").cast("bigint").alias("area"))


@lens("""SELECT vec_id AS row, col, CAST(b AS INTEGER) AS band, CASE WHEN b = 1 THEN q WHEN q % 7 <> 0 THEN -q END AS value FROM (SELECT vec_id, unnest(range(64)) AS col, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 1e3 + 0.5) AS BIGINT) AS q FROM embeddings), (VALUES (1), (2)) t(b)
WHERE vec_id >= (SELECT count(*) // 4 FROM embeddings) AND col BETWEEN 8 AND 40""")
def k_raster_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene of two bands written as one file and read again: the window from a quarter of its height on, columns 8 to 40."""
    e = table(spark, sf_dir, "embeddings")
    height = e.count()
    q = R.quantised(F.col("x").cast("double"), 1e3)
    scene = e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "x")).select("row", "col", q.alias("first"), F.when(q % 7 != 0, -q).alias("second"))
    path = f"{graph.shared_dir(spark)}/scene-{uuid.uuid4().hex}.tif"
    files.write_pixels(scene, path, files.Grid(64, height, 32645, 10.0, -10.0, 300000.0, 3100000.0, -32768.0), ["first", "second"], "i2", 16, 2)
    graph.removed_at_exit(spark, path)
    window = files.read_pixels(spark, path).where((F.col("row") >= height // 4) & (F.col("col") >= 8) & (F.col("col") <= 40))
    return window.select("row", "col", "band", F.col("value").cast("bigint").alias("value"))


@lens(f"""{_GRID}, t AS (SELECT r.i AS row, c.i AS col, (r.i + 0.5) * 1.5 - 0.5 AS y, (c.i + 0.5) * 1.5 - 0.5 AS x FROM range(CAST(floor((SELECT max(row) + 1 FROM v) / 1.5) AS BIGINT)) r(i), range(42) c(i))
SELECT t.row, t.col, {_Q('value')} AS value FROM t LEFT JOIN v ON v.row = CAST(floor(y + 0.5) AS BIGINT) AND v.col = CAST(floor(x + 0.5) AS BIGINT)""")
def r_nearest_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.nearest(grid(spark, sf_dir), 1.5).select("row", "col", R.quantised(F.col("value")).alias("value"))


@lens(f"""{_GRID}, t AS (SELECT r.i AS row, c.i AS col, (r.i + 0.5) * 0.75 - 0.5 AS y, (c.i + 0.5) * 0.75 - 0.5 AS x FROM range(CAST(floor((SELECT max(row) + 1 FROM v) / 0.75) AS BIGINT)) r(i), range(85) c(i)),
n AS (SELECT t.row, t.col, sum(w) AS weight, sum(CASE WHEN value IS NOT NULL THEN w END) AS ok, sum(w * value) AS total FROM (SELECT t.*, v.value, greatest(0, 1 - abs(v.row - y)) * greatest(0, 1 - abs(v.col - x)) AS w FROM t JOIN v ON v.row BETWEEN CAST(floor(y) AS BIGINT) AND CAST(floor(y) AS BIGINT) + 1 AND v.col BETWEEN CAST(floor(x) AS BIGINT) AND CAST(floor(x) AS BIGINT) + 1) t GROUP BY t.row, t.col)
SELECT row, col, {_Q('CASE WHEN ok >= 1 - 1e-6 THEN total / ok END')} AS value FROM n""")
def r_bilinear_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bilinear(grid(spark, sf_dir), 0.75).select("row", "col", R.quantised(F.col("value")).alias("value"))


_TURN = (12.0, -5.0, 5.0, 12.0)  # the target's axes, a pixel of 13 metres turned against the source's of 10
_SOUGHT = f"""{_GRID}, n AS (SELECT count(*) AS h FROM embeddings), t AS (SELECT r.i AS row, c.i AS col, ({_TURN[2]} * (c.i + 0.5) + {_TURN[3]} * (r.i + 0.5) - 40) / 10 - 0.5 AS y, (100 + {_TURN[0]} * (c.i + 0.5) + {_TURN[1]} * (r.i + 0.5)) / 10 - 0.5 AS x
FROM (SELECT unnest(range(h // 4)) AS i FROM n) r, range(60) c(i)), u AS (SELECT *, y >= -0.5 AND y < h - 0.5 AND x >= -0.5 AND x < 63.5 AS inside FROM t, n),
k AS (SELECT u.*, CAST(floor(y) AS BIGINT) + a AS sr, CAST(floor(x) AS BIGINT) + b AS sc FROM u, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b)),
w AS (SELECT k.row, k.col, inside, value, CASE WHEN sr BETWEEN 0 AND h - 1 AND sc BETWEEN 0 AND 63 THEN (1 - abs(sr - y)) * (1 - abs(sc - x)) ELSE 0 END AS w FROM k LEFT JOIN v ON v.row = sr AND v.col = sc),
m AS (SELECT row, col, bool_and(inside) AS inside, sum(w) AS whole, sum(w) FILTER (value IS NOT NULL) AS ok, sum(w * value) AS total FROM w GROUP BY row, col)"""


@lens(f"{_SOUGHT} SELECT row, col, {_Q('CASE WHEN inside AND ok >= 0.5 * whole THEN total / ok END')} AS value FROM m")
def r_warp_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene on a grid that is turned and has other pixels; half the weight must be observed."""
    g = grid(spark, sf_dir)
    height = table(spark, sf_dir, "embeddings").count()
    source = resample.Affine(64, height, 32645, 10.0, 0.0, 300000.0, 0.0, 10.0, 3100000.0)
    target = resample.Affine(60, height // 4, 32645, _TURN[0], _TURN[1], 300100.0, _TURN[2], _TURN[3], 3099960.0)
    return resample.warp_bilinear(g, source, target, 0.5).select("row", "col", R.quantised(F.col("value")).alias("value"))


_CODES = "SELECT vec_id % 7 AS tile, CAST(floor(abs(CAST(x AS DOUBLE)) * 40) AS INTEGER) AS scl FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)"
_TABLE = "CASE " + " ".join(f"WHEN scl = {k} THEN '{c}'" for k, (_, c) in optical.CLASSES.items()) + " ELSE 'unexpected' END"


@lens(f"WITH s AS ({_CODES}) SELECT tile, {_TABLE} AS category, count(*) AS n, count(*) FILTER (scl IN (4, 5, 6, 7)) AS observable FROM s GROUP BY 1, 2")
def r_scl_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("tile"), F.explode("embedding").alias("x")).withColumn("scl", F.floor(F.abs(F.col("x").cast("double")) * 40).cast("int"))
    return codes.groupBy("tile", optical.category(F.col("scl")).alias("category")).agg(F.count("*").alias("n"), F.count_if(optical.observable(F.col("scl"))).alias("observable"))


@lens("""WITH p AS (SELECT vec_id % 50 AS row, vec_id, unnest(range(64)) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT row, col, CAST(floor(min_by(v, vec_id) * 1e4 + 0.5) AS BIGINT) AS value FROM p WHERE v > 0 GROUP BY row, col""")
def r_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("row"), F.col("vec_id").alias("item"), F.posexplode("embedding").alias("col", "x"))
    return resample.mosaic(e.select("row", F.col("col").cast("bigint").alias("col"), "item", F.col("x").cast("double").alias("value")), positive_only=True).select("row", "col", R.quantised(F.col("value")).alias("value"))


_DB = {"pre_vv": (-14.0, -8.0), "post_vh": (-11.0, -9.0), "post_vv": None}


@lens(_DUAL + ", f AS (SELECT " + ", ".join(f"CASE WHEN {c} > 0 THEN 10 * log10({c}) END AS {c}" for c in _DB) + " FROM d), n AS (SELECT count(*) FILTER (" + " AND ".join(f"{c} IS NOT NULL" for c in _DB) + ") AS all_valid, count(*) FILTER (" + " OR ".join(f"{c} IS NOT NULL" for c in _DB) + ") AS any_valid FROM f) " + " UNION ALL ".join(f"SELECT all_valid, any_valid, '{c}' AS feature, (SELECT count({c}) FROM f) AS valid, (SELECT count(*) - count({c}) FROM f) AS invalid, " + (f"(SELECT count(*) FILTER ({c} < {r[0]} OR {c} > {r[1]}) FROM f)" if r else "NULL::BIGINT") + " AS outside FROM n" for c, r in _DB.items()))
def r_feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.feature_report(dual(spark, sf_dir).select(*[R.to_db(F.col(c)).alias(c) for c in _DB]), _DB)


@lens(f"{_PLANES} SELECT row // 16 AS block_row, CAST(col // 16 AS BIGINT) AS block_col, count(*) AS pixels, count(*) FILTER (pre > 0) AS pre, count(*) FILTER (post > 0) AS post, count(*) FILTER (pre > 0 AND post > 0) AS joint FROM c GROUP BY ALL")
def r_block_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = [F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("pre", "post")]
    return stats.block_coverage(planes(spark, sf_dir).select("row", "col", *lit), ["pre", "post"], 16)


_T = _DUAL + """, l AS (SELECT row, col, row // 16 AS sample, pre_vv, pre_vh, post_vv, post_vh, CASE WHEN least(pre_vv, pre_vh, post_vv, post_vh) > 0 THEN (row * 7 + col) % 3 ELSE 3 END AS target FROM d)"""


def _planes_of_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample (tiles of 16 rows), row, col, role, polarisation, value: a row per channel and pixel."""
    channels = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(p).alias("polarisation"), F.col(f"{r}_{p}").alias("value")) for r, p in tensors.CHANNELS])
    tiles = dual(spark, sf_dir).select(F.floor(F.col("row") / 16).alias("sample"), "row", "col", F.explode(channels).alias("x"))
    return tiles.select("sample", "row", "col", "x.*")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels in order, and the target: pixels with a value at or below zero are ignored, others have a made label."""
    stack = tensors.channel_stack(_planes_of_tiles(spark, sf_dir))
    valid = F.least(*[F.col(f"{r}_{p}") for r, p in tensors.CHANNELS]) > 0
    return stack.withColumn("target", tensors.target((F.col("row") * 7 + F.col("col")) % 3, valid))


@lens(f"{_T} SELECT sample, row, col, " + ", ".join(f"{_Q(f'{r}_{p}')} AS {r}_{p}" for r, p in tensors.CHANNELS) + ", target FROM l")
def r_channel_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("sample", "row", "col", *[R.quantised(F.col(f"{r}_{p}")).alias(f"{r}_{p}") for r, p in tensors.CHANNELS], "target")


@lens(f"""{_T}, b AS (SELECT *, strpos('0123456789abcdef', sha256('epoch-1:' || sample)[1]) - 1 AS h FROM l),
f AS (SELECT *, CASE WHEN h % 2 = 1 THEN 31 - col ELSE col END AS c, CASE WHEN h // 2 % 2 = 1 THEN 15 - row % 16 ELSE row % 16 END AS r, h // 4 AS t FROM b)
SELECT sample, CASE t WHEN 0 THEN r WHEN 1 THEN 31 - c WHEN 2 THEN 15 - r ELSE c END AS row, CASE t WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN 31 - c ELSE 15 - r END AS col, {_Q("pre_vv")} AS pre_vv, {_Q("post_vh")} AS post_vh, target FROM f""")
def r_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 16 x 32 pixels, each turned by its own draw; channels and target move alike."""
    tiles = samples(spark, sf_dir).withColumn("row", F.col("row") % 16)
    moved = tensors.augmented(tiles, "sample", F.lit(16), F.lit(32), "epoch-1")
    return moved.select("sample", "row", "col", R.quantised(F.col("pre_vv")).alias("pre_vv"), R.quantised(F.col("post_vh")).alias("post_vh"), "target")


@lens(f"{_DUAL}, k AS (SELECT row, col, {_CASE} AS c, pre_vv > 0 AND post_vv > 0 AS v FROM g) SELECT CASE WHEN v AND c = 255 THEN 'unobserved_but_valid' WHEN c <> 255 AND NOT v THEN 'observed_but_invalid' ELSE 'agree' END AS state, count(*) AS n FROM k GROUP BY 1")
def r_mask_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate mask against a valid mask that knows of the first channel only."""
    classes = change.require_classes(r_change_candidates(spark, sf_dir).withColumnRenamed("candidate", "value"), change.CANDIDATES)
    valid = dual(spark, sf_dir).select("row", "col", ((F.col("pre_vv") > 0) & (F.col("post_vv") > 0)).cast("int").alias("valid"))
    return change.disagreements(classes, valid)
