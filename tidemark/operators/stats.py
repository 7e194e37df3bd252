"""Pooled statistics, exact percentiles, confusion metrics and comparisons."""

from __future__ import annotations

import bisect
import functools
import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import written


def pooled_stats(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean and population deviation of valid values per group, from mergeable sums."""
    sums = pixels.groupBy(*by).agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    mean = F.try_divide("s", "n")
    return sums.select(*by, "n", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide("ss", "n") - mean * mean, F.lit(0.0))).alias("std"))


def percentiles(values: DataFrame, column: str, percents: list[float]) -> DataFrame:
    """percent, value: exact percentiles by linear interpolation; NULL values don't count, and without any there is no row.

    Values are counted first and dealt into ranges. How many rows each range holds tells which ranges have the wanted
    ranks, and only in these are the counts summed up in order; so no task sees all values, be they as many as rows."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    placed = written(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sizes = sorted(placed.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row per range
    total, ends = sum(r["n"] for r in sizes), list(itertools.accumulate(r["n"] for r in sizes))
    asked = []
    for percent in percents if total else []:
        at = percent / 100 * (total - 1)
        for rank, share in ((math.floor(at), math.floor(at) + 1 - at), (math.ceil(at), at - math.floor(at))):
            k = bisect.bisect_right(ends, rank)
            asked.append((float(percent), sizes[k]["part"], rank - ends[k] + sizes[k]["n"], float(share)))
    ranks = values.sparkSession.createDataFrame(asked, "percent double, part int, rank long, share double")
    inside = placed.where(F.col("part").isin(sorted({a[1] for a in asked})))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("last", upto).join(ranks, "part").where((F.col("rank") < F.col("last")) & (F.col("rank") >= F.col("last") - F.col("n")))
    return found.groupBy("percent").agg(F.sum(F.col("v") * F.col("share")).alias("value"))


def confusion(pairs: DataFrame, truth: str, pred: str, n_classes: int, ignore: int | None = None) -> DataFrame:
    """truth, pred, n: counts after rows with NULL or ignored truth are dropped; predictions are clamped to classes."""
    kept = pairs.where(F.col(truth).isNotNull() & ((F.col(truth) != ignore) if ignore is not None else F.lit(True)))
    clamped = F.greatest(F.lit(0), F.least(F.lit(n_classes - 1), F.col(pred)))
    return kept.groupBy(F.col(truth).alias("truth"), clamped.alias("pred")).agg(F.count("*").alias("n"))


def class_scores(counts: DataFrame, n_classes: int) -> DataFrame:
    """IoU, precision, recall, F1 and support of each class from confusion(); an undefined ratio is NULL."""
    rows = counts.withColumn("class", F.explode(F.array(*map(F.lit, range(n_classes)))))
    t, p, n = F.col("truth") == F.col("class"), F.col("pred") == F.col("class"), F.col("n")
    sums = rows.groupBy("class").agg(F.sum(F.when(t & p, n).otherwise(0)).alias("tp"), F.sum(F.when(~t & p, n).otherwise(0)).alias("fp"), F.sum(F.when(t & ~p, n).otherwise(0)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "class", F.try_divide(tp, tp + fp + fn).alias("iou"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"),
    )


def overall_scores(scores: DataFrame, counts: DataFrame) -> DataFrame:
    """Means over supported classes, micro IoU and pixel accuracy."""
    means = scores.where("support > 0").agg(F.avg("iou").alias("mean_iou"), F.avg("f1").alias("macro_f1"))
    hit, n = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")
    return means.crossJoin(counts.agg(F.try_divide(hit, n).alias("accuracy"), F.try_divide(hit, 2 * n - hit).alias("micro_iou")))


def close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal to within an absolute or a relative tolerance."""
    gap = F.abs(a - b)
    return (gap <= tolerance) | (gap / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12)) <= tolerance)


def cross_check(recorded: DataFrame, recomputed: DataFrame, key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """key, state of every key of two tables: match, differs, only_recorded or only_recomputed."""
    both = recorded.select(key, F.col(value).alias("a"), F.lit(1).alias("x")).join(recomputed.select(key, F.col(value).alias("b"), F.lit(1).alias("y")), key, "full_outer")
    state = F.when(F.col("y").isNull(), "only_recorded").when(F.col("x").isNull(), "only_recomputed").when(close(F.col("a"), F.col("b"), tolerance), "match").otherwise("differs")
    return both.select(key, state.alias("state"))


def feature_report(pixels: DataFrame, ranges: dict[str, tuple[float, float] | None]) -> DataFrame:
    """One row per feature column: valid and invalid pixels, valid ones outside its range (NULL without a range), and
    the pixels at which all features or any feature is valid. Nothing is clipped. No pixels give zeros."""
    rows = []
    for name, span in ranges.items():
        c = F.col(name)
        outside = F.count_if((c < span[0]) | (c > span[1])) if span else F.lit(None).cast("bigint")
        rows.append(F.struct(F.lit(name).alias("feature"), F.count(c).alias("valid"), F.count_if(c.isNull()).alias("invalid"), outside.alias("outside")))
    known = [F.col(c).isNotNull() for c in ranges]
    every, some = functools.reduce(Column.__and__, known), functools.reduce(Column.__or__, known)
    one = pixels.agg(F.array(*rows).alias("r"), F.count_if(every).alias("all_valid"), F.count_if(some).alias("any_valid"))
    return one.select("all_valid", "any_valid", F.inline("r"))


def block_coverage(pixels: DataFrame, sources: list[str], block: int = 512) -> DataFrame:
    """Per block of the raster: pixels, valid pixels of each source, and those valid in all sources (joint)."""
    joint = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in sources])
    at = [F.floor(F.col(c) / block).cast("bigint").alias(f"block_{c}") for c in ("row", "col")]
    return pixels.groupBy(*at).agg(F.count("*").alias("pixels"), *[F.count(c).alias(c) for c in sources], F.count_if(joint).alias("joint"))
