"""Catalogue lens: events are scenes. orbit = user_id mod 7 (unknown where event_id is a multiple of 11), direction =
user_id mod 2 (unknown for multiples of 5), level L1C for multiples of 3, cloud = value, coverage = props.k / 100."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.raster import quantised
from tidemark.functions.temporal import Plan, days_apart
from tidemark.operators import overlay, selection
from tidemark.plans.common import Lens, table

lens = Lens()
PLAN = Plan(dt.datetime(2024, 1, 15), 5, 5)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = e.select(
        F.col("event_id").alias("scene_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("sensor"), F.col("value").alias("cloud"),
        F.when(F.col("event_id") % 11 != 0, (F.col("user_id") % 7).cast("int")).alias("orbit"), F.when(F.col("event_id") % 5 != 0, (F.col("user_id") % 2).cast("int")).alias("direction"),
        F.when(F.col("event_id") % 3 == 0, "L1C").otherwise("L2A").alias("level"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("coverage"),
    )
    return selection.plan_sides(out.withColumn("tier", F.when(F.col("level") == "L2A", 0).otherwise(1)), PLAN)


_S = """WITH s AS (SELECT event_id AS scene_id, ts, event_type AS sensor, value AS cloud, CASE WHEN event_id % 11 <> 0 THEN CAST(user_id % 7 AS INTEGER) END AS orbit,
CASE WHEN event_id % 5 <> 0 THEN CAST(user_id % 2 AS INTEGER) END AS direction, CASE WHEN event_id % 3 = 0 THEN 'L1C' ELSE 'L2A' END AS level, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS tier,
CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS coverage, abs(date_diff('microsecond', TIMESTAMP '2024-01-15', ts)) AS off,
CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15' THEN 'before' WHEN ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-20' THEN 'after' END AS side FROM events)"""
_G1 = _S + """, g AS (SELECT *, CASE WHEN side IS NULL THEN 'OUTSIDE_WINDOW' WHEN orbit IS NULL THEN 'ORBIT_UNKNOWN' WHEN coverage IS NULL OR coverage < 0.3 THEN 'INSUFFICIENT_COVERAGE' END AS reason FROM s),
p AS (SELECT b.sensor, b.scene_id AS before_id, a.scene_id AS after_id, greatest(b.off, a.off) AS worst, b.off + a.off AS total,
row_number() OVER (PARTITION BY b.sensor ORDER BY greatest(b.off, a.off), b.off + a.off, b.ts, a.ts, b.scene_id, a.scene_id) AS rn
FROM g b JOIN g a ON b.sensor = a.sensor AND b.orbit = a.orbit AND coalesce(b.direction = a.direction, true) WHERE b.side = 'before' AND a.side = 'after' AND b.reason IS NULL AND a.reason IS NULL)"""
_G2 = _S + """, g AS (SELECT *, orbit AS tile, CASE WHEN side IS NULL THEN 'OUTSIDE_WINDOW' WHEN cloud IS NULL OR cloud > 60 THEN 'CLOUD' WHEN coverage IS NULL OR coverage < 0.3 THEN 'INSUFFICIENT_COVERAGE' WHEN orbit IS NULL THEN 'TILE_UNKNOWN' END AS reason FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY tier, cloud, off, ts, scene_id) AS rk FROM g WHERE reason IS NULL),
p AS (SELECT b.sensor, b.tile, b.scene_id AS before_id, a.scene_id AS after_id, CASE WHEN b.level <> a.level THEN 1 ELSE 0 END AS mixed,
row_number() OVER (PARTITION BY b.sensor, b.tile ORDER BY CASE WHEN b.level <> a.level THEN 1 ELSE 0 END, greatest(b.rk, a.rk), least(b.rk, a.rk), b.scene_id, a.scene_id) AS rn
FROM r b JOIN r a ON b.sensor = a.sensor AND b.tile = a.tile WHERE b.side = 'before' AND a.side = 'after')"""


@lens(f"{_S} SELECT scene_id, side, CAST(off AS BIGINT) AS off, CAST(floor(off / 864e6 + 0.5) AS BIGINT) AS days FROM s")
def c_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return scenes(spark, sf_dir).select("scene_id", "side", "off", days_apart(split, F.col("ts")).alias("days"))


def _radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = [("OUTSIDE_WINDOW", F.col("side").isNotNull()), ("ORBIT_UNKNOWN", F.col("orbit").isNotNull()), ("INSUFFICIENT_COVERAGE", F.col("coverage") >= 0.3)]
    return selection.gated(scenes(spark, sf_dir), gates)


@lens(f"{_G1} SELECT sensor, before_id, after_id, CAST(worst AS BIGINT) AS worst, CAST(total AS BIGINT) AS total FROM p WHERE rn = 1")
def c_s1_pairs_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.radar_pairs(_radar(spark, sf_dir).where("reason is null"), "sensor")


@lens(f"{_G1}, c AS (SELECT before_id AS id FROM p WHERE rn = 1 UNION SELECT after_id FROM p WHERE rn = 1) SELECT scene_id, coalesce(reason, CASE WHEN scene_id IN (SELECT id FROM c) THEN 'SELECTED' ELSE 'NOT_TOP_RANKED' END) AS reason FROM g")
def c_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _radar(spark, sf_dir)
    return selection.with_outcome(judged, selection.radar_pairs(judged.where("reason is null"), "sensor"))


@lens(f"{_G2} SELECT sensor, tile, before_id, after_id, mixed FROM p WHERE rn = 1")
def c_s2_pairs_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = [("OUTSIDE_WINDOW", F.col("side").isNotNull()), ("CLOUD", F.col("cloud") <= 60), ("INSUFFICIENT_COVERAGE", F.col("coverage") >= 0.3), ("TILE_UNKNOWN", F.col("orbit").isNotNull())]
    judged = selection.gated(scenes(spark, sf_dir), gates).where("reason is null")
    return selection.optical_pairs(judged.withColumn("tile", F.col("orbit")), "sensor")


@lens("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
SELECT p.event_id, (SELECT max_by(v.event_id, (v.ts, v.event_id)) FROM v WHERE v.user_id = p.user_id AND v.ts < p.ts AND v.ts >= p.ts - INTERVAL 2 DAY) AS view_id FROM p""")
def c_asof_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    left, right = (e.where(F.col("event_type") == t).select("event_id", "user_id", "ts") for t in ("purchase", "view"))
    return selection.as_of(left, right, "user_id", "ts", "event_id", 2 * 86_400_000_000).select("event_id", F.col("matched").alias("view_id"))


#: Footprints are rectangles 30 x 20 in a system (s, t) that is turned against (x, y) with sine 0.6; so is the target.
_TARGET = (20.0, 10.0, 60.0, 40.0)
_PASSES = _S + """, f AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(scene_id * 7 % 60 - 5 AS DOUBLE) AS s0, CAST(scene_id * 3 % 45 - 5 AS DOUBLE) AS t0 FROM s),
k AS (SELECT sensor, orbit, direction, day, arg_min(scene_id, (ts, scene_id)) AS scene_id, min(ts) AS ts, count(*) AS items, list_sort(list_distinct(flatten(list([greatest(s0, 20), least(s0 + 30, 60)])))) AS xs, list_sort(list_distinct(flatten(list([greatest(t0, 10), least(t0 + 20, 40)])))) AS ys, list({'s': s0, 't': t0}) AS boxes FROM f GROUP BY ALL),
h AS (SELECT k.* EXCLUDE (xs, ys), ys, unnest(xs[: -2]) AS x0, unnest(xs[2 :]) AS x1 FROM k), v AS (SELECT * EXCLUDE (ys), unnest(ys[: -2]) AS y0, unnest(ys[2 :]) AS y1 FROM h),
u AS (SELECT sensor, orbit, direction, day, sum((x1 - x0) * (y1 - y0)) AS area FROM v WHERE x0 >= 20 AND x1 <= 60 AND y0 >= 10 AND y1 <= 40 AND len(list_filter(boxes, lambda b: b.s <= x0 AND b.s + 30 >= x1 AND b.t <= y0 AND b.t + 20 >= y1)) > 0 GROUP BY ALL),
a AS (SELECT k.* EXCLUDE (xs, ys, boxes), coalesce(u.area, 0) / 1200 AS coverage FROM k LEFT JOIN u ON k.sensor = u.sensor AND k.orbit IS NOT DISTINCT FROM u.orbit AND k.direction IS NOT DISTINCT FROM u.direction AND k.day = u.day)"""


def turned(s: Column, t: Column) -> Column:
    return F.struct((0.8 * s - 0.6 * t).alias("x"), (0.6 * s + 0.8 * t).alias("y"))


def target_ring() -> list[tuple[float, float]]:
    s0, t0, s1, t1 = _TARGET
    return [(0.8 * s - 0.6 * t, 0.6 * s + 0.8 * t) for s, t in ((s0, t0), (s1, t0), (s1, t1), (s0, t1))]


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenes with day and points, a footprint that is turned against the axes."""
    s, t = (F.col("scene_id") * 7 % 60 - 5).cast("double"), (F.col("scene_id") * 3 % 45 - 5).cast("double")
    points = F.array(turned(s, t), turned(s + 30, t), turned(s + 30, t + 20), turned(s, t + 20))
    return scenes(spark, sf_dir).withColumns({"day": F.col("ts").cast("date").cast("string"), "points": points})


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.acquisitions(footprints(spark, sf_dir), ["sensor", "orbit", "direction", "day"], target_ring())


@lens(f"{_PASSES} SELECT sensor, orbit, direction, day, scene_id AS first_id, items, CAST(floor(coverage * 1e4 + 0.5) AS BIGINT) AS coverage FROM a")
def c_acquisition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of a day and track, and how much of the target their united footprints cover."""
    out = passes(spark, sf_dir)
    return out.select("sensor", "orbit", "direction", "day", F.col("scene_id").alias("first_id"), "items", F.floor(F.col("coverage") * 1e4 + 0.5).cast("bigint").alias("coverage"))


_CLEAR = _S + """, f AS (SELECT *, CAST(scene_id % 3 + 9 * coalesce(orbit, 3) AS DOUBLE) AS s0, CAST(scene_id % 4 AS DOUBLE) AS t0 FROM s),
m AS (SELECT sensor, orbit, max(s0) AS x0, min(s0) + 60 AS x1, max(t0) AS y0, min(t0) + 45 AS y1 FROM f GROUP BY ALL),
g AS (SELECT *, greatest(0, x1 - x0) * greatest(0, y1 - y0) AS common_area, greatest(0, least(x1, 66) - greatest(x0, 30)) * greatest(0, least(y1, 24) - greatest(y0, 20)) AS shared_area, least(30 - x0, x1 - 66, 20 - y0, y1 - 24) AS off FROM m)"""


@lens(_CLEAR + """ SELECT sensor, orbit, CAST(floor(common_area * 1e3 + 0.5) AS BIGINT) AS common_area, CAST(floor(shared_area * 1e3 + 0.5) AS BIGINT) AS shared_area, shared_area > 144 - 1e-6 AS covered,
CASE WHEN shared_area > 144 - 1e-6 THEN CAST(floor(off * 1e3 + 0.5) AS BIGINT) ELSE 0 END AS clearance, shared_area > 144 - 1e-6 AND off >= 2.5 AS accepted FROM g""")
def c_swath_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all footprints (60 x 45) of a sensor and orbit share, and how far inside it a small target lies."""
    s, t = (F.col("scene_id") % 3 + 9 * F.coalesce("orbit", F.lit(3))).cast("double"), (F.col("scene_id") % 4).cast("double")
    wide = scenes(spark, sf_dir).select("sensor", "orbit", F.array(turned(s, t), turned(s + 60, t), turned(s + 60, t + 45), turned(s, t + 45)).alias("points"))
    small = [(0.8 * s - 0.6 * t, 0.6 * s + 0.8 * t) for s, t in ((30, 20), (66, 20), (66, 24), (30, 24))]
    out = overlay.common_clearance(wide, ["sensor", "orbit"], small, 2.5)
    return out.select("sensor", "orbit", *[quantised(F.col(c), 1e3).alias(c) for c in ("common_area", "shared_area", "clearance")], "covered", "accepted")


@lens("""WITH d AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN value < 20 THEN 'SUCCESS' WHEN value < 40 THEN 'FAILED' ELSE 'NOT_ATTEMPTED' END AS st FROM events)
SELECT user_id, day, CASE WHEN count(*) FILTER (st = 'NOT_ATTEMPTED') = count(*) THEN 'NOT_ATTEMPTED' WHEN count(*) FILTER (st = 'SUCCESS') = count(*) THEN 'COMPLETE' WHEN count(*) FILTER (st = 'FAILED') = count(*) THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM d GROUP BY ALL""")
def c_download_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("value") < 20, "SUCCESS").when(F.col("value") < 40, "FAILED").otherwise("NOT_ATTEMPTED")
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("day"), state.alias("st"))
    return e.groupBy("user_id", "day").agg(selection.rollup_status(F.col("st")).alias("status"))


@lens("SELECT * EXCLUDE (rn) FROM (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def c_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return selection.distinct_on(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@lens("SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 100")
def c_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the catalogue: 50 rows after the first 100, by time and id."""
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").offset(100).limit(50).select("event_id", "user_id")


@lens(_PASSES + """, w AS (SELECT *, CAST(day AS DATE) AS d FROM a WHERE coverage >= 0.4996), p AS (SELECT b.sensor, b.scene_id AS pre_id, a.scene_id AS post_id,
row_number() OVER (PARTITION BY b.sensor ORDER BY a.ts, a.scene_id, b.ts DESC, b.scene_id DESC) AS rn FROM w b JOIN w a ON b.sensor = a.sensor AND b.orbit IS NOT DISTINCT FROM a.orbit AND b.direction IS NOT DISTINCT FROM a.direction
WHERE a.d > DATE '2024-01-15' AND a.d <= DATE '2024-01-27' AND b.d >= DATE '2023-12-10' AND b.d < DATE '2024-01-15') SELECT sensor, pre_id, post_id FROM p WHERE rn = 1""")
def c_earliest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of passes, each named by its earliest scene; half the target must be covered by a pass's scenes together."""
    out = passes(spark, sf_dir).withColumnRenamed("first_ts", "ts")
    return selection.earliest_pairs(out, "sensor", F.lit(dt.date(2024, 1, 15)), 12, 36, 0.4996)
