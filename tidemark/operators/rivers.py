"""River topology: reaches (id, next_down, upland, ord_stra), next_down 0 at a terminal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import doubled, path_totals, walked


def children(reaches: DataFrame) -> DataFrame:
    """id and the sorted ids that flow into it."""
    return reaches.where("next_down <> 0").groupBy(F.col("next_down").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))


def _walk(starts: DataFrame, steps: DataFrame, most: int, stops: list[int] | None = None) -> DataFrame:
    """start, step, id of paths from each start along steps (id, to); a path that returns to its start is an error.
    A path ends at a stop that it comes to, not at one where it starts. Rounds grow with the log of the longest path."""
    at_stop = F.col("id").isin(stops or [])
    tables = doubled(steps.where(~at_stop))
    out = walked(starts.select(F.col("id").alias("start"), "id"), tables)
    if stops:
        beyond = starts.where(at_stop).join(steps, "id").select(F.col("id").alias("start"), F.col("to").alias("id"))
        out = out.unionByName(walked(beyond, tables).withColumn("step", F.col("step") + 1))
        if not out.where("step > 0 and id = start").isEmpty():
            raise ValueError("the river network has a cycle")
    if not out.where(F.col("step") > most).isEmpty():
        raise ValueError(f"a path has more than {most} steps")
    return out


def _once(reaches: DataFrame) -> DataFrame:
    """reaches; an id that occurs twice is an error."""
    twice = reaches.groupBy("id").count().where("count > 1").select("id").take(1)
    if twice:
        raise ValueError(f"reach {twice[0]['id']} occurs twice")
    return reaches


def _downward(reaches: DataFrame) -> DataFrame:
    present = reaches.select(F.col("id").alias("to"))
    return reaches.where("next_down <> 0").select("id", F.col("next_down").alias("to")).join(present, "to", "left_semi")


def downstream(reaches: DataFrame, stop_at: list[int] | None = None, most: int = 100_000) -> DataFrame:
    """start, step, id of the way down from every reach, up to a terminal, an absent reach or a stop that is come to
    (included)."""
    return _walk(_once(reaches), _downward(reaches), most, stop_at)


def downstream_totals(reaches: DataFrame) -> DataFrame:
    """start, reaches, total (summed upland) and last of the way down from every reach, without writing ways out."""
    sums = path_totals(_downward(_once(reaches)), reaches.select("id", F.col("upland").alias("value")))
    return sums.select(F.col("id").alias("start"), F.col("places").alias("reaches"), "total", "last")


def stop_reasons(paths: DataFrame, reaches: DataFrame, stop_at: list[int] | None = None) -> DataFrame:
    """start, last, steps and reason: caller_stop_reach, no_downstream_connection, or that the next reach is absent."""
    last = paths.groupBy("start").agg(F.max(F.struct("step", "id")).alias("l")).select("start", F.col("l.id").alias("id"), F.col("l.step").alias("steps"))
    stopped = F.col("id").isin(stop_at or []) & (F.col("steps") > 0)
    absent = F.concat(F.lit("reach_"), F.col("next_down").cast("string"), F.lit("_absent_from_loaded_set"))
    reason = F.when(stopped, "caller_stop_reach").when(F.col("next_down") == 0, "no_downstream_connection").otherwise(absent)
    return last.join(reaches.select("id", "next_down"), "id").select("start", F.col("id").alias("last"), "steps", reason.alias("reason"))


def main_stem(reaches: DataFrame, most: int = 10_000) -> DataFrame:
    """start, step, id of the way up from every reach, at each fork into the largest upland area, ties to the higher
    Strahler order (ord_stra) and then to the smaller id."""
    best = reaches.where("next_down <> 0").groupBy(F.col("next_down").alias("id")).agg(F.min_by("id", F.struct(-F.col("upland"), -F.col("ord_stra"), F.col("id"))).alias("to"))
    return _walk(_once(reaches), best, most)


def path_summary(paths: DataFrame, reaches: DataFrame) -> DataFrame:
    """Per start: reaches, summed upland, and upland at the first and last of them."""
    j = paths.join(reaches.select("id", "upland"), "id")
    return j.groupBy("start").agg(F.count("*").alias("reaches"), F.sum("upland").alias("total"), F.min_by("upland", "step").alias("first"), F.max_by("upland", "step").alias("last"))
