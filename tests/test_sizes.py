"""How work is dealt where rows are made by explode(), whose number Spark doesn't know."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import change, resample


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["b_polygon_touched", "b_polygon_centres", "b_raster_rect_counts", "b_line_measure", "b_point_class", "r_bilinear_strict", "r_nearest_warp", "r_warp_turned"])
def test_exploded_rows_are_not_broadcast(spark, sf_dir, name):
    """Their tables look small to Spark, however many rows they have: a broadcast takes all of them through the driver."""
    plans = plan(entry.queries()[name](spark, sf_dir)).replace("BroadcastNestedLoopJoin", "")
    assert "SortMergeJoin" in plans and "BroadcastHashJoin" not in plans


def test_targets_outside_of_the_source_are_spread(spark):
    """Most of a turned grid may lie outside; without a key, its pixels would all be joined by one task."""
    px = spark.range(64).select(F.lit(0).cast("bigint").alias("row"), F.col("id").alias("col"), F.col("id").cast("double").alias("value"))
    source, target = resample.Affine(64, 1, 32645, 10.0, 0.0, 0.0, 0.0, 10.0, 0.0), resample.Affine(64, 40, 32645, 10.0, 0.0, 0.0, 0.0, 10.0, 0.0)
    expected = {(r, c): float(c) if r == 0 else None for r in range(40) for c in range(64)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = resample.warp_nearest(px, source, target).withColumn("task", F.spark_partition_id()).collect()
        assert {(r["row"], r["col"]): r["value"] for r in met} == expected
        assert len({r["task"] for r in met if r["row"] > 0}) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {(r["row"], r["col"]): r["value"] for r in resample.warp_bilinear(px, source, target).collect()} == expected


def test_regions_join_up_only_across_blocks(spark, monkeypatch):
    """The graph that is relaxed in rounds has no link within a block, and block sizes change no result."""
    spec = [(r, c, int((r * 7 + c * c * 3 + r * c) % 5 < 2)) for r in range(40) for c in range(9)]
    px = spark.createDataFrame(spec, "row bigint, col bigint, value int")
    links, real = [], change.components
    monkeypatch.setattr(change, "components", lambda met: links.append(met.count()) or real(met))
    out = {}
    for block in (3, 7, 512):
        monkeypatch.setattr(change, "BLOCK", block)
        out[block] = sorted(map(tuple, change.sieve(px, 6).collect()))
    assert out[3] == out[7] == out[512] and len(out[3]) == 360 and links[2] == 0 < links[1] < links[0]
