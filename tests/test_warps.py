"""Warps between turned grids and between zones against plain loops; projections there and back."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import lines
from tidemark.operators import resample


def test_projections_come_back(spark):
    rows = [(e, n, z) for z in (32644, 32645, 32733) for e in (170000.0, 500000.0, 812345.6) for n in (1000.0, 3100000.0, 8_900_000.0)]
    df = spark.createDataFrame(rows, "e double, n double, z int")
    for z in (32644, 32645, 32733):
        there = df.where(F.col("z") == z).select("e", "n", *[c.alias(k) for c, k in zip(lines.projected(F.col("e"), F.col("n"), z, 4326), ("lon", "lat"), strict=True)])
        back = there.select("e", "n", "lat", *[c.alias(k) for c, k in zip(lines.projected(F.col("lon"), F.col("lat"), 4326, z), ("x", "y"), strict=True)])
        for r in back.collect():
            assert abs(r["x"] - r["e"]) < 1e-3 and abs(r["y"] - r["n"]) < 1e-3 and (r["lat"] < 0) == (z == 32733)
    known = spark.range(1).select(*[c.alias(k) for c, k in zip(lines.projected(F.lit(500000.0), F.lit(4982950.400), 32631, 4326), "xy", strict=True)]).first()
    assert known["x"] == pytest.approx(3, abs=1e-9) and known["y"] == pytest.approx(45, abs=1e-7)
    with pytest.raises(ValueError, match="3857"):
        lines.projected(F.lit(0.0), F.lit(0.0), 4326, 3857)


def plain(values, source, target, across, least):
    """Nearest and bilinear values of each target pixel; across: from a target place to the source's system."""
    out, det = {}, source.a * source.e - source.b * source.d
    for r in range(target.height):
        for c in range(target.width):
            x, y = across(target.c + target.a * (c + 0.5) + target.b * (r + 0.5), target.f + target.d * (c + 0.5) + target.e * (r + 0.5))
            sx = (source.e * (x - source.c) - source.b * (y - source.f)) / det - 0.5
            sy = (source.a * (y - source.f) - source.d * (x - source.c)) / det - 0.5
            if not (-0.5 <= sy < source.height - 0.5 and -0.5 <= sx < source.width - 0.5):
                out[r, c] = (None, None)
                continue
            whole = ok = total = 0.0
            for i in (math.floor(sy), math.floor(sy) + 1):
                for j in (math.floor(sx), math.floor(sx) + 1):
                    if 0 <= i < source.height and 0 <= j < source.width:
                        w = (1 - abs(i - sy)) * (1 - abs(j - sx))
                        whole += w
                        if not math.isnan(values[i, j]):
                            ok, total = ok + w, total + w * values[i, j]
            near = values[math.floor(sy + 0.5), math.floor(sx + 0.5)]
            out[r, c] = (None if math.isnan(near) else near, total / ok if ok and ok >= least * whole else None)
    return out


@pytest.mark.parametrize("kind", ["turned", "zone"])
def test_warps_equal_a_plain_loop(spark, kind):
    values = np.random.default_rng(6).normal(size=(14, 17))
    values[3:5, 6], values[0, 0], values[13, 16] = np.nan, np.nan, np.nan
    source = resample.Affine(17, 14, 32645, 100.0, 0.0, 200000.0, 0.0, -100.0, 3100000.0)
    if kind == "turned":
        target, across = resample.Affine(20, 16, 32645, 70.0, -40.0, 200400.0, -40.0, -70.0, 3100100.0), lambda x, y: (x, y)
    else:
        corner = spark.range(1).select(*[c.alias(k) for c, k in zip(lines.projected(F.lit(200000.0), F.lit(3100000.0), 32645, 32644), "xy", strict=True)]).first()
        target = resample.Affine(19, 15, 32644, 90.0, 0.0, corner["x"] - 60, 0.0, -95.0, corner["y"] + 70)
        cells = [(r, c, target.c + target.a * (c + 0.5), target.f + target.e * (r + 0.5)) for r in range(15) for c in range(19)]
        df = spark.createDataFrame(cells, "r int, c int, x double, y double")
        known = {(q["x"], q["y"]): (q["u"], q["v"]) for q in df.select("x", "y", *[c.alias(k) for c, k in zip(lines.projected(F.col("x"), F.col("y"), 32644, 32645), "uv", strict=True)]).collect()}
        across = lambda x, y: known[x, y]
    table = spark.createDataFrame([(r, c, None if math.isnan(v := float(values[r, c])) else v) for r in range(14) for c in range(17)], "row bigint, col bigint, value double")
    for least in (1 - 1e-6, 0.5):
        want = plain(values, source, target, across, least)
        got = {(r["row"], r["col"]): r["value"] for r in resample.warp_bilinear(table, source, target, least).collect()}
        assert got == {k: None if v is None else pytest.approx(v, abs=1e-9) for k, (_, v) in want.items()}
    assert sum(v is not None for _, v in want.values()) > 60
    near = {(r["row"], r["col"]): r["value"] for r in resample.warp_nearest(table, source, target).collect()}
    assert near == {k: v for k, (v, _) in want.items()}
    labels = resample.warp_labels(table.withColumn("value", (F.col("value") > 0).cast("int")), source, target, 255, [0, 1])
    assert {(r["row"], r["col"]): r["value"] for r in labels.collect()} == {k: 255 if v is None else int(v > 0) for k, (v, _) in want.items()}


def test_what_is_refused(spark):
    g = resample.Affine(2, 2, 32645, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    px = spark.createDataFrame([(0, 0, 7.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, -1.0)], "row bigint, col bigint, value double")
    with pytest.raises(ValueError, match="no mean"):
        resample.warp_bilinear(px, g, g, domain="db")
    with pytest.raises(ValueError, match="axes"):
        resample.Affine(2, 2, 32645, 1.0, 2.0, 0.0, 2.0, 4.0, 0.0)
    with pytest.raises(Exception, match="unknown class"):
        resample.warp_labels(px, g, g, 255, [1]).collect()
    assert [r["value"] for r in resample.warp_to_db(px, g, g).orderBy("row", "col").collect()] == [pytest.approx(10 * math.log10(7)), 0.0, 0.0, None]
