"""Nearest lines against all pairs; percentiles over ranges; areas by scope."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import accounting, nearest, stats


def off(x, y, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = min(1, max(0, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.hypot(a[0] + t * dx - x, a[1] + t * dy - y)


def test_nearest_line_equals_all_pairs(spark):
    rng = random.Random(3)
    lines = [(i, [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(rng.randrange(2, 5))]) for i in range(25)]
    lines += [(90, lines[0][1]), (91, [(0.0, 0.0)]), (92, []), (93, None), (94, [(7.0, 7.0), (7.0, 7.0)]), (95, [(-60.0, 3.0), (60.0, 3.0)]), (96, [(3.0, -60.0), (3.0, 60.0)])]
    points = [(i, rng.uniform(-80, 80), rng.uniform(-80, 80)) for i in range(60)] + [(100, 900.0, 900.0), (101, None, 1.0), (102, 7.0, 7.0), (103, 3.0, 3.0), (104, 1e6, 0.0)]
    df = spark.createDataFrame(points, "p int, x double, y double")
    got = {r["p"]: (r["line"], r["distance"]) for r in nearest.nearest_lines(df, spark.createDataFrame(lines, "l int, points array<struct<x: double, y: double>>"), "p", "l", 5.0, 5000.0).collect()}
    for p, x, y in points:
        every = [(min(off(x, y, a, b) for a, b in zip(v, v[1:], strict=False)), i) for i, v in lines if v and len(v) > 1] if x is not None else []
        best = min(every, default=(9e9, None))
        if best[0] > 5000:
            assert got[p] == (None, None)
        else:
            assert got[p][1] == pytest.approx(best[0], abs=1e-9) and got[p][0] == min(i for d, i in every if d <= best[0] + 1e-12)


def test_percentiles_of_many_values(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 100) for _ in range(3000)] + [5.0] * 500
    got = {r["percent"]: r["value"] for r in stats.percentiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(7), "v", [0, 1, 33.3, 50, 99.9, 100]).collect()}
    ranked = sorted(values)
    for p, v in got.items():
        at = p / 100 * (len(ranked) - 1)
        low, high = ranked[math.floor(at)], ranked[math.ceil(at)]
        assert v == pytest.approx(low + (high - low) * (at - math.floor(at)), abs=1e-9)
    assert len(got) == 6


def test_scopes_without_area_or_pixels(spark):
    none = spark.createDataFrame([], "row bigint, col bigint, valid boolean, candidate boolean")
    flat = accounting.scope_accounting(none, [(0.0, 0.0), (5.0, 0.0)], 1.0, 4, 4).first()
    assert (flat["geometric"], flat["centers"], flat["outside"], flat["delivered_of_geometric"], flat["valid_of_centers"]) == (0.0, 0, 16, None, None)
    box = accounting.scope_accounting(none, [(2.0, 2.0), (8.0, 2.0), (8.0, 4.0), (2.0, 4.0)], 1.0, 4, 4).first()
    assert (box["geometric"], box["delivered"], box["unobserved"], box["centers"], box["valid"], box["delivered_but_invalid"]) == (pytest.approx(12), pytest.approx(4), pytest.approx(8), 4, 0, 4)


def test_letters_of_any_script_end_no_word(spark):
    df = spark.createDataFrame([("The édestroyed bridge is isolatedé.",), ("The bridge is destroyed.",)], "t string")
    got = [len(r["c"]) for r in df.select(text.screen_claims(F.col("t"), {"destroyed": "x", "isolated": "y"}, (), ("not",), 5).alias("c")).collect()]
    assert got == [0, 1]
