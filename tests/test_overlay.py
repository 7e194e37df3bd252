"""Overlay areas against a plain sweep over exact fractions, and identities of areas."""

import itertools
import random
from fractions import Fraction as Q

import pytest
from pyspark.sql import functions as F

from tidemark.operators import overlay

SCHEMA = "k int, j string, layer string, poly string, points array<struct<x: double, y: double>>"


def sweep(polygons, holds):
    """Area where holds(depth per layer), polygons: (layer, rings)."""
    edges = [(layer, i, *sorted(((Q(ay), Q(ax)), (Q(by), Q(bx))))) for i, (layer, rings) in enumerate(polygons) for ring in rings for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True) if ay != by]
    x = lambda e, y: e[2][1] + (e[3][1] - e[2][1]) * (y - e[2][0]) / (e[3][0] - e[2][0])
    ys = {p[0] for e in edges for p in e[2:]}
    for e, f in itertools.combinations(edges, 2):
        low, high = max(e[2][0], f[2][0]), min(e[3][0], f[3][0])
        if low < high and (d := x(e, low) - x(f, low)) * (g := x(e, high) - x(f, high)) < 0:
            ys.add(low + (high - low) * d / (d - g))
    total = Q(0)
    for low, high in itertools.pairwise(sorted(ys)):
        active = sorted(((x(e, (low + high) / 2), e[0], e[1]) for e in edges if e[2][0] <= low and e[3][0] >= high))
        inside = set()
        for (a, layer, i), (b, *_) in itertools.pairwise(active):
            inside ^= {(layer, i)}
            if holds({name: sum(k == name for k, _ in inside) for name in ("a", "b")}):
                total += (b - a) * (high - low)
    return float(total)


MEASURES = {
    "union": lambda d, _: (d("a") > 0) | (d("b") > 0), "shared": lambda d, _: (d("a") > 0) & (d("b") > 0), "a": lambda d, _: d("a") > 0, "b": lambda d, _: d("b") > 0,
    "twice": lambda d, _: d("a") >= 2, "all_a": lambda d, n: d("a") == n("a"),
}


@pytest.mark.parametrize("per_band", [1, 16])
def test_areas_equal_an_exact_sweep(spark, per_band):
    rng = random.Random(8)
    ring = lambda n, s=10.0: [(round(rng.uniform(0, s), 2), round(rng.uniform(0, s), 2)) for _ in range(n)]
    groups = {(1, None): [("a", [ring(3)]) for _ in range(4)] + [("b", [ring(5)]) for _ in range(3)]}
    groups[2, "x"] = [("a", [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)], [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]]), ("b", [[(3.0, 3.0), (9.0, 3.0), (9.0, 9.0), (3.0, 9.0)]]), ("a", [[(8.0, 0.0), (9.0, 0.0), (9.0, 8.0), (8.0, 8.0)]])]
    groups[None, "y"] = [("a", [[(0.0, 0.0), (6.0, 1.0), (5.0, 5.0)]])] * 3 + [("b", [ring(8)]), ("b", [ring(4, 0.5)])]
    rows = [(*g, layer, f"{layer}{i}", r) for g, polygons in groups.items() for i, (layer, rings) in enumerate(polygons) for r in rings]
    rows += [(3, "z", "a", "1", []), (3, "z", "a", "2", None), (3, "z", "b", "1", [(0.0, 0.0), (3.0, 0.0)]), (3, "z", "b", "2", [(0.0, 0.0), (float("nan"), 1.0), (1.0, 1.0)]), (3, "z", "b", "3", [(0.0, None), (2.0, 1.0), (1.0, 1.0)])]
    got = {(r["k"], r["j"]): r for r in overlay.overlay_areas(spark.createDataFrame(rows, SCHEMA), ["k", "j"], ["a", "b"], MEASURES, per_band).collect()}
    assert set(got) == {*groups, (3, "z")} and all(got[3, "z"][m] == 0 for m in MEASURES)
    for g, polygons in groups.items():
        n = sum(layer == "a" for layer, _ in polygons)
        holds = {"union": lambda d: d["a"] or d["b"], "shared": lambda d: d["a"] and d["b"], "a": lambda d: d["a"], "b": lambda d: d["b"], "twice": lambda d: d["a"] >= 2, "all_a": lambda d, n=n: d["a"] == n}
        for name, h in holds.items():
            assert got[g][name] == pytest.approx(sweep(polygons, h), rel=1e-9, abs=1e-9), (g, name)
        assert got[g]["union"] + got[g]["shared"] == pytest.approx(got[g]["a"] + got[g]["b"])


def test_coverage_and_clearance(spark):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    halves = [("h", "1", box(0.0, 0.0, 6.0, 10.0)), ("h", "2", box(4.0, 0.0, 10.0, 10.0)), ("h", "2", box(4.0, 0.0, 10.0, 10.0)), ("f", "1", box(-5.0, -3.0, 15.0, 12.0)), ("f", "2", [(-9.0, -9.0), (30.0, -9.0), (-9.0, 30.0)]), ("n", "1", box(50.0, 50.0, 60.0, 60.0)), ("o", "1", None)]
    items = spark.createDataFrame(halves, "g string, id string, points array<struct<x: double, y: double>>")
    aoi = box(0.0, 0.0, 10.0, 10.0)
    assert {r["g"]: round(r["coverage"], 9) for r in overlay.union_coverage(items, ["g"], aoi).collect()} == {"h": 1.0, "f": 1.0, "n": 0.0, "o": 0.0}
    got = {r["g"]: r for r in overlay.common_clearance(items, ["g"], aoi, 0.5).collect()}
    assert (round(got["h"]["common_area"], 9), round(got["h"]["shared_area"], 9), got["h"]["covered"], got["h"]["clearance"]) == (20.0, 20.0, False, 0.0)
    assert got["f"]["covered"] and got["f"]["clearance"] == pytest.approx(2 ** -0.5) and got["f"]["accepted"]
    assert not got["n"]["accepted"] and got["n"]["common_area"] == pytest.approx(100)
    wide = overlay.common_clearance(items, ["g"], aoi, 0.75).where(F.col("accepted")).count()
    assert wide == 0
    with pytest.raises(ValueError):
        overlay.common_clearance(items, ["g"], aoi, -1.0)
