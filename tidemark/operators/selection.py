"""Catalogue selection: gates with a reason for each row that fails, pairs of scenes before and after an event.

A pair's rank is monotone in the rank of either side, so the best pair of a group is made of the best scene of each
side within every combination of what the pair must agree on. Sides are reduced by aggregation before they are joined:
no table of all pairs is made."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.temporal import Plan
from tidemark.operators.overlay import union_coverage


def gated(scenes: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """scenes with reason, the name of the first gate whose condition does not hold (NULL counts as failing)."""
    reason = F.lit(None).cast("string")
    for name, passes in reversed(gates):
        reason = F.when(~F.coalesce(passes, F.lit(False)), name).otherwise(reason)
    return scenes.withColumn("reason", reason)


def radar_pairs(scenes: DataFrame, by: str) -> DataFrame:
    """The best pair of each group `by`: equal orbit, directions equal or one of them unknown.

    scenes: by, scene_id, ts, off (distance to the event), orbit, direction, side. Order of pairs: larger distance,
    sum of distances, times before and after, ids. Returns by, before_id, after_id, worst, total."""
    least = F.min(F.struct("off", "ts", "scene_id")).alias("best")
    sides = scenes.groupBy(by, "orbit", "direction", "side").agg(least)
    b, a = (sides.where(F.col("side") == s).alias(s) for s in ("before", "after"))
    same = (F.col(f"before.{by}") == F.col(f"after.{by}")) & (F.col("before.orbit") == F.col("after.orbit"))
    towards = F.coalesce(F.col("before.direction") == F.col("after.direction"), F.lit(True))
    x, y = F.col("before.best"), F.col("after.best")
    rank = F.struct(F.greatest(x["off"], y["off"]).alias("worst"), (x["off"] + y["off"]).alias("total"), x["ts"].alias("t0"), y["ts"].alias("t1"), x["scene_id"].alias("before_id"), y["scene_id"].alias("after_id"))
    best = b.join(a, same & towards).groupBy(F.col(f"before.{by}").alias(by)).agg(F.min(rank).alias("p"))
    return best.select(by, "p.before_id", "p.after_id", "p.worst", "p.total")


def optical_pairs(scenes: DataFrame, by: str) -> DataFrame:
    """The best pair of each group and tile. scenes: by, tile, scene_id, ts, off, level, tier, cloud, side.

    A side ranks by (tier, cloud, distance, time, id); a pair by whether its levels differ, its worse side, its better
    side. Returns by, tile, before_id, after_id, mixed."""
    side = F.struct("tier", "cloud", "off", "ts", "scene_id")
    sides = scenes.groupBy(by, "tile", "level", "side").agg(F.min(side).alias("best"))
    b, a = (sides.where(F.col("side") == s).alias(s) for s in ("before", "after"))
    x, y = F.col("before.best"), F.col("after.best")
    rank = F.struct((F.col("before.level") != F.col("after.level")).cast("int").alias("mixed"), F.greatest(x, y).alias("worse"), F.least(x, y).alias("better"), x["scene_id"].alias("before_id"), y["scene_id"].alias("after_id"))
    same = (F.col(f"before.{by}") == F.col(f"after.{by}")) & (F.col("before.tile") == F.col("after.tile"))
    best = b.join(a, same).groupBy(F.col(f"before.{by}").alias(by), F.col("before.tile").alias("tile")).agg(F.min(rank).alias("p"))
    return best.select(by, "tile", "p.before_id", "p.after_id", "p.mixed")


def with_outcome(judged: DataFrame, pairs: DataFrame) -> DataFrame:
    """scene_id and reason of every scene: its gate, SELECTED, or NOT_TOP_RANKED."""
    chosen = pairs.select(F.explode(F.array("before_id", "after_id")).alias("scene_id")).distinct().withColumn("chosen", F.lit(True))
    reason = F.coalesce("reason", F.when(F.col("chosen"), "SELECTED"), F.lit("NOT_TOP_RANKED"))
    return judged.join(chosen, "scene_id", "left").select("scene_id", reason.alias("reason"))


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, value: str, within_micros: int) -> DataFrame:
    """left with the latest earlier `value` of right per key (as `matched`), none if it is more than within_micros old.

    Both sides are ordered together once, so no range join is made."""
    both = left.select(by, ts, F.struct(*left.columns).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(0).alias("is_right"))
    both = both.unionByName(right.select(by, ts, F.lit(None).cast(both.schema["row"].dataType).alias("row"), F.col(value).alias("v"), F.lit(1).alias("is_right")))
    earlier = Window.partitionBy(by).orderBy(ts, "is_right", "v").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("is_right") == 1, F.struct(F.col(ts).alias("t"), "v")), ignorenulls=True).over(earlier)
    found = both.withColumn("last", last).where("is_right = 0")
    near = F.timestamp_diff("MICROSECOND", F.col("last.t"), F.col(ts)) <= within_micros
    return found.select("row.*", F.when(near, F.col("last.v")).alias("matched"))


def acquisitions(items: DataFrame, keys: list[str], aoi: Sequence[tuple[float, float]]) -> DataFrame:
    """One row per acquisition, the items (keys, scene_id, ts, points) of one pass: scene_id and first_ts of the earliest,
    number of items, and the fraction of the area of interest that their united footprints cover. Keys may be NULL; an
    item without a usable footprint counts as one and covers nothing."""
    covered = union_coverage(items, keys, aoi)
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    passes = items.groupBy(*keys).agg(F.min(F.struct("ts", "scene_id")).alias("first"), F.count("*").alias("items"))
    joined = passes.alias("p").join(covered.alias("c"), functools.reduce(Column.__and__, same))
    return joined.select(*[F.col(f"p.{k}").alias(k) for k in keys], F.col("p.first.scene_id").alias("scene_id"), F.col("p.first.ts").alias("first_ts"), "items", "coverage")


def rollup_status(status: Column) -> Column:
    """Aggregate of download states: empty or none tried, all well, all failed, or some of each."""
    n, ok, failed, idle = F.count(status), F.count_if(status == "SUCCESS"), F.count_if(status == "FAILED"), F.count_if(status == "NOT_ATTEMPTED")
    return F.when(idle == n, "NOT_ATTEMPTED").when(ok == n, "COMPLETE").when(failed == n, "FAILED").otherwise("PARTIAL")


def distinct_on(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def plan_sides(scenes: DataFrame, plan: Plan) -> DataFrame:
    return scenes.withColumns({"side": plan.side(F.col("ts")), "off": plan.offset(F.col("ts"))})


def with_paths(scenes: DataFrame, paths: DataFrame) -> DataFrame:
    """scenes with the path of each (scene_id, path). A scene without exactly one path is an error when rows are read."""
    one = paths.groupBy("scene_id").agg(F.min("path").alias("path"), F.count("path").alias("_paths"))
    joined = scenes.join(one, "scene_id", "left")
    wrong = F.raise_error(F.concat(F.lit("not one path for scene "), F.coalesce("scene_id", F.lit("NULL"))))
    return joined.withColumn("path", F.when(F.col("_paths") == 1, F.col("path")).otherwise(wrong)).drop("_paths")


def earliest_pairs(scenes: DataFrame, by: str, event: Column, post_days: int, pre_days: int, least: float) -> DataFrame:
    """Per group the earliest scene after the event that has one before it on the same track, with the latest such one.

    scenes: by, scene_id, ts, orbit, direction, coverage; to judge whole passes give acquisitions(). Days count, not times: after is (event, event + post_days],
    before [event - pre_days, event). An unknown orbit or direction is a track of its own; of equal times the smaller
    id is the earlier. The sides are reduced per track in one aggregation; a group without a pair has no row."""
    day, one = F.col("ts").cast("date"), F.struct("ts", "scene_id")
    pre = F.max(F.when((day >= F.date_sub(event, pre_days)) & (day < event), one)).alias("pre")
    post = F.min(F.when((day > event) & (day <= F.date_add(event, post_days)), one)).alias("post")
    tracks = scenes.where(F.col("coverage") >= least).groupBy(by, "orbit", "direction").agg(pre, post)
    best = tracks.where("pre is not null and post is not null").groupBy(by).agg(F.min(F.struct("post", "pre")).alias("p"))
    return best.select(by, F.col("p.pre.scene_id").alias("pre_id"), F.col("p.post.scene_id").alias("post_id"))
