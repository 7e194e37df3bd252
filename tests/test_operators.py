"""Operators against brute force and on hand-made cases."""

import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo, raster, records, temporal, text
from tidemark.operators import change, exposure, focal, governance, graph, rivers, sampling, selection, stats
from tidemark.plans import network


def pixels(spark, rows):
    return spark.createDataFrame([(r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], "row bigint, col bigint, value int")


def test_sieve_removes_specks_and_fills_gaps(spark):
    g = [[0] * 12 for _ in range(12)]
    for r in range(2, 9):
        for c in range(1, 7):
            g[r][c] = 1
    g[5][3] = 0
    g[10][10] = 1
    out = {(r["row"], r["col"]): r["value"] for r in change.sieve(pixels(spark, g), 10).collect()}
    assert out[5, 3] == 1 and out[10, 10] == 0 and out[2, 1] == 1 and out[0, 0] == 0


def test_regions_equal_flood_fill(spark):
    rng = random.Random(3)
    g = [[int(rng.random() < 0.45) for _ in range(15)] for _ in range(15)]
    seen, sizes = {}, {}
    for r in range(15):
        for c in range(15):
            if (r, c) in seen:
                continue
            todo, members = [(r, c)], {(r, c)}
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        p = (y + dy, x + dx)
                        if p not in members and 0 <= p[0] < 15 and 0 <= p[1] < 15 and g[p[0]][p[1]] == g[r][c]:
                            members.add(p)
                            todo.append(p)
            for m in members:
                seen[m] = (r, c)
                sizes[m] = len(members)
    assert {(x["row"], x["col"]): x["size"] for x in change.regions(pixels(spark, g)).collect()} == sizes


def test_boxcar_across_blocks(spark):
    rng = random.Random(5)
    g = [[rng.choice([None, rng.randrange(9)]) for _ in range(7)] for _ in range(11)]
    got = {(x["row"], x["col"]): x["mean"] for x in focal.boxcar_mean(pixels(spark, g).withColumn("value", F.col("value").cast("double")), 5, rows=3).collect()}
    for r in range(11):
        for c in range(7):
            near = [g[y][x] for y in range(max(0, r - 2), min(11, r + 3)) for x in range(max(0, c - 2), min(7, c + 3)) if g[y][x] is not None]
            assert got[r, c] == (None if g[r][c] is None else pytest.approx(sum(near) / len(near)))


def test_slope_of_a_plane(spark):
    plane = spark.createDataFrame([(r, c, 10.0 * c) for r in range(5) for c in range(6)], "row bigint, col bigint, value double")
    horn = {(x["row"], x["col"]): x["slope"] for x in focal.horn_slope(plane, 10.0, rows=2).collect()}
    assert horn[2, 2] == pytest.approx(45) and horn[0, 2] is None
    assert all(x["slope"] == pytest.approx(45) for x in focal.central_slope(plane, 10.0, rows=2).collect())


def test_central_slope_tells_invalid_from_absent(spark):
    rows = [(0, c, v) for c, v in enumerate([0.0, 10.0, None, 30.0, 40.0])] + [(1, c, 10.0 * c) for c in range(5)]
    got = {(x["row"], x["col"]): x["slope"] for x in focal.central_slope(spark.createDataFrame(rows, "row bigint, col bigint, value double"), 10.0).collect()}
    # a neighbour that is invalid makes the difference invalid; the pixel itself counts only at edges
    assert [got[0, c] is None for c in range(5)] == [False, True, True, True, False] and got[0, 0] == pytest.approx(45)
    assert got[1, 2] is None and got[1, 1] == pytest.approx(45)


def scene(spark, pre, post, slope):
    cells = [(r, c, pre.get((r, c), -8.0), post.get((r, c), -8.0), slope.get((r, c), 0.0)) for r in range(20) for c in range(20)]
    lin = lambda x: None if x is None else 10 ** (x / 10)
    return spark.createDataFrame([(r, c, lin(a), lin(b), s) for r, c, a, b, s in cells], "row bigint, col bigint, pre double, post double, slope double")


def test_change_rule(spark):
    """Cases of the rule: flood, permanent, too small a change, receded, steep, unobserved, not dark enough."""
    pre, post = {(0, 1): -21.0, (0, 2): -16.0, (0, 3): -22.0, (1, 1): None}, {(0, 0): -22.0, (0, 1): -23.0, (0, 2): -18.5, (0, 3): -9.0, (1, 2): -15.0}
    got = {(x["row"], x["col"]): x["class"] for x in change.classified(scene(spark, pre, post, {(1, 0): 35.0}), least=1).collect()}
    assert [got[0, c] for c in range(4)] == [2, 1, 0, 0] and [got[1, c] for c in range(4)] == [255, 255, 0, 0]


def test_change_rule_sieves(spark):
    patch = {(r, c): -22.0 for r in range(10, 14) for c in range(10, 14)} | {(2, 2): -22.0}
    got = {(x["row"], x["col"]): x["class"] for x in change.classified(scene(spark, {}, patch, {(11, 11): 40.0}), least=10).collect()}
    assert got[2, 2] == 0 and got[11, 11] == 255 and all(got[k] == 2 for k in patch if k not in ((2, 2), (11, 11)))


def test_records(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(records.json_number(F.col("x"))).collect()] == ["1.5", "NaN", "Infinity", "-Infinity", None]
    assert [r[0] for r in df.select(records.plain(F.col("x"))).collect()] == [1.5, None, float("inf"), float("-inf"), None]
    texts = spark.createDataFrame([('{"a": NaN}',), ('{"a": "NaN", "b": 1}',), ('{"a": [-Infinity]}',), (None,)], "t string")
    assert [r[0] for r in texts.select(records.json_constants(F.col("t"))).collect()] == [["NaN"], [], ["-Infinity"], None]
    lists = spark.createDataFrame([(["b", "a", "b", None, None],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in lists.select(records.ordered_distinct(F.col("v"))).collect()] == [["b", "a", None], [], None]
    assert [r[0] for r in lists.select(records.required_and_more(["a", "z"], F.col("v"))).collect()] == [["a", "z", "b", None], ["a", "z"], ["a", "z"]]


def test_paths_of_scenes(spark):
    scenes = spark.createDataFrame([("s1", 1), ("s2", 2)], "scene_id string, n int")
    paths = spark.createDataFrame([("s1", "/a"), ("s2", "/b"), ("s3", "/c")], "scene_id string, path string")
    assert sorted((r["scene_id"], r["path"]) for r in selection.with_paths(scenes, paths).collect()) == [("s1", "/a"), ("s2", "/b")]
    for bad in (paths.where("scene_id <> 's2'"), paths.unionByName(paths.where("scene_id = 's1'"))):
        with pytest.raises(Exception, match="one path"):
            selection.with_paths(scenes, bad).collect()


def test_shortest_paths_equal_a_heap_search(spark, sf_dir):
    edges = network.edges(spark, sf_dir).select("u", "v", "length")
    hubs = network._hubs(spark, sf_dir)
    near = {}
    for u, v, n in map(tuple, edges.collect()):
        for a, b in ((u, v), (v, u)):
            near.setdefault(a, {})[b] = min(n, near.get(a, {}).get(b, n))
    heap = [(0.0, h["node"]) for h in hubs.collect()]
    best = {}
    while heap:
        d, x = heapq.heappop(heap)
        if x in best:
            continue
        best[x] = d
        for y, n in near.get(x, {}).items():
            if y not in best:
                heapq.heappush(heap, (d + n, y))
    got = {r["node"]: r["distance"] for r in graph.shortest_paths(edges, hubs).collect()}
    assert got == {k: v for k, v in best.items()}


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in graph.components(links).collect()} == {0}
    assert graph.components(links.limit(0)).count() == 0


def test_connectivity_order(spark):
    rows = [(1, None, None, None), (1, 5.0, None, None), (1, 5.0, 6.0, None), (1, 5.0, 8.0, 9.0), (1, 0.0, 0.0, 0.0), (1, 5.0, 6.0, 6.0)]
    df = spark.createDataFrame(rows, "n int, b double, o double, p double")
    got = [r[0] for r in df.select(graph.connectivity(*map(F.col, "nbop"))).collect()]
    assert got == ["INSUFFICIENT_DATA", "CUT_OFF", "UNKNOWN", "DISRUPTED", "CONNECTED", "CONNECTED"]


def test_claims_equal_brute_force(spark):
    texts = [
        "The bridge is destroyed. It is not destroyed; the road is impassable!", "Potentially cut off, but cut off.", "never be classified as dry, safe, unaffected, flood-free or connected",
        "no claim here\nundamaged", "one two three four five six seven eight nine ten eleven twelve not a b c d e f g h i j k l isolated", "", None, "undestroyed destroyed",
    ]

    def brute(t):
        low = (t or "").lower()
        for p in text.ALLOWED:
            low = low.replace(p.lower(), "\0" * len(p))
        out = []
        for term in text.FORBIDDEN:
            for m in re.finditer(rf"(?<!\w){re.escape(term)}(?!\w)", low):
                clause = re.split(r"[.;:!?\n]", low[: m.start()])[-1]
                words = re.findall(r"[\w'-]+", clause)[-12:]
                if not {x for w in words for x in (w, w.rstrip("-"))} & set(text.CUES):
                    out.append((m.start(), term))
        return sorted(out)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [(x["position"], x["term"]) for x in r["c"] or []] for r in df.select("i", text.screen_claims(F.col("t")).alias("c")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_statuses(spark):
    df = spark.createDataFrame([(8.0, 8.0, 0.0, 0.0), (100.0, 9.0, 20.0, 0.0), (100.0, 9.0, 9.0, 0.0), (0.0, 0.0, 0.0, 0.0), (50.0, 20.0, 0.0, 50.0)], "l double, f double, u double, o double")
    assert [r[0] for r in df.select(exposure.line_status(*map(F.col, "lfuo"))).collect()] == ["EXPOSED", "UNKNOWN", "NOT_EXPOSED", "NOT_OBSERVED", "NOT_OBSERVED"]


def test_rivers(spark):
    r = spark.createDataFrame([(1, 0, 9.0), (2, 1, 5.0), (3, 1, 7.0), (4, 3, 7.0), (5, 3, 7.0), (6, 99, 1.0)], "id bigint, next_down bigint, upland double").withColumn("ord_stra", F.when(F.col("id") == 5, 3).otherwise(2))
    stem = {(x["start"], x["step"]): x["id"] for x in rivers.main_stem(r).collect()}
    assert [stem.get((1, i)) for i in range(4)] == [1, 3, 5, None]  # of equal areas the higher order
    reasons = {x["start"]: (x["last"], x["reason"]) for x in rivers.stop_reasons(rivers.downstream(r, [3]), r, [3]).collect()}
    end, stop = "no_downstream_connection", "caller_stop_reach"
    assert reasons == {1: (1, end), 2: (1, end), 3: (1, end), 4: (3, stop), 5: (3, stop), 6: (6, "reach_99_absent_from_loaded_set")}
    with pytest.raises(ValueError, match="cycle"):
        rivers.downstream(spark.createDataFrame([(1, 2, 0.0, 1), (2, 1, 0.0, 1)], r.schema)).count()


def test_largest_remainder_minimum(spark):
    counts = spark.createDataFrame([("a", 98), ("b", 1), ("c", 1)], "g string, n bigint")
    assert {r["g"]: r["allocated"] for r in sampling.largest_remainder(counts, "g", 10, 1).collect()} == {"a": 8, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        sampling.largest_remainder(counts, "g", 101)


def test_quarantined_twice(spark):
    q = spark.createDataFrame([(1, "x"), (1, "y")], "id int, reason_code string")
    with pytest.raises(ValueError, match="twice"):
        sampling.partition_eligible(spark.range(3), q, "id")


def test_feature_plans_are_strict():
    """Roles are expanded in order, derived features come last, and nothing is guessed."""
    bound = {"sentinel1_before": {"vv": "a", "vh": "b"}, "sentinel1_after": {"vv": "c", "vh": "d"}, "sentinel2_before": {"green": "e", "nir": "f"}, "sentinel2_after": {"green": "g", "nir": "h"}}
    plan = raster.feature_plan(["s2_ndwi_change", "s1_change_db", "s2_ndwi_post", "s2_ndwi_pre", "s1_change_db"], bound, ["vh", "vv"], decibels=False)
    assert [(f.name, f.transform, f.inputs) for f in plan] == [
        ("s1_vh_change_db", "log_ratio_db", ("d", "b")), ("s1_vv_change_db", "log_ratio_db", ("c", "a")), ("s2_ndwi_pre", "normalized_difference", ("e", "f")), ("s2_ndwi_post", "normalized_difference", ("g", "h")),
        ("s2_ndwi_change", "derived_difference", ("s2_ndwi_post", "s2_ndwi_pre")),
    ]
    assert [f.transform for f in raster.feature_plan(["s1_change_db", "s1_co_cross_ratio_db_pre"], bound, ["vv"], decibels=True)] == ["difference", "cross_pol_difference_db"]
    for enabled, more, what in (
        ([], {}, "no feature"), (["nope"], {}, "unknown"), (["s1_change_db"], {"decibels": True}, "polarisation roles"), (["s1_change_db"], {"polarisations": ["vv"]}, "decibels"), (["s2_reflectance_pre"], {}, "band roles"),
        (["s2_reflectance_pre"], {"bands": ["red"]}, "not bound"), (["s2_ndwi_change", "s2_ndwi_pre"], {}, "isn't enabled"), (["s2_reflectance_pre"], {"bands": ["nir", "nir"]}, "one name"),
    ):
        with pytest.raises(ValueError, match=what):
            raster.feature_plan(enabled, bound, **more)
    assert len(raster.TEMPLATES) == 19


def test_invalid_stays_null(spark):
    df = spark.createDataFrame([(1.0, -1.0), (float("nan"), 2.0), (float("inf"), 2.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    v = df.select(raster.valid(F.col("a"), 0.0).alias("a"), raster.log_ratio_db(F.col("a"), F.col("b")).alias("r"), raster.normalized_difference(F.col("a"), F.col("b")).alias("n")).collect()
    assert [x["a"] for x in v] == [1.0, None, None, None, None] and v[0]["n"] is None and v[3]["n"] is None and v[0]["r"] is None


def test_windows_exclude_the_event_day():
    import datetime as dt

    plan = temporal.Plan(dt.datetime(2024, 1, 10, 7), 5, 5)
    assert plan.before[1] == dt.datetime(2024, 1, 10) and plan.after[0] == dt.datetime(2024, 1, 11)
    with pytest.raises(ValueError):
        temporal.Plan(dt.datetime(2024, 1, 10), 0, 5)


def test_geometry(spark):
    df = spark.createDataFrame([(87.3, 26.1), (-179.9, -5.0), (180.0, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(geo.utm_epsg(F.col("x"), F.col("y"))).collect()] == [32645, 32701, 32660]
    assert len(geo.tiles((0.0, 0.0, 0.25, 0.1), 0.1)) == 3 and geo.tiles((0.0, 0.0, 0.25, 0.1), 0.1)[-1][2] == 0.25


def test_verdicts(spark):
    df = spark.createDataFrame([("a", "COMPLETE"), ("a", "BLOCKED"), ("b", "COMPLETE"), ("c", "INVALID")], "g string, s string")
    assert dict(map(tuple, governance.verdict(df, "g", "s").select("g", "verdict").collect())) == {"a": "LIMITED", "b": "OPERATIONAL", "c": "NOT_READY"}
    with pytest.raises(ValueError, match="missing"):
        governance.require_columns(df, ["x"])


def test_percentiles_of_ties_and_nothing(spark):
    df = spark.createDataFrame([(5,), (5,), (5,), (9,), (None,)], "v bigint")
    assert {r["percent"]: r["value"] for r in stats.percentiles(df, "v", [0, 50, 90, 100]).collect()} == {0.0: 5.0, 50.0: 5.0, 90.0: pytest.approx(7.8), 100.0: 9.0}
    assert stats.percentiles(df.limit(0), "v", [50]).count() == 0


def test_rollup_of_downloads(spark):
    rows = [("a", "SUCCESS"), ("a", "FAILED"), ("b", "FAILED"), ("c", "FAILED"), ("c", "NOT_ATTEMPTED"), ("d", "NOT_ATTEMPTED")]
    df = spark.createDataFrame(rows, "g string, s string").groupBy("g").agg(selection.rollup_status(F.col("s")).alias("r"))
    assert dict(map(tuple, df.collect())) == {"a": "PARTIAL", "b": "FAILED", "c": "PARTIAL", "d": "NOT_ATTEMPTED"}


def test_polygon_coverage_equals_clipping(spark, sf_dir):
    from tidemark.plans import places, roads

    def clip(ring, convex):
        for (ax, ay), (bx, by) in zip(convex, convex[1:] + convex[:1], strict=True):
            side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: E731, B023
            out = []
            for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
                if side(p) >= 0:
                    out.append(p)
                if (side(p) >= 0) != (side(q) >= 0):
                    t = side(p) / (side(p) - side(q))
                    out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            ring = out
        return ring

    def area(ring):
        return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2

    want = {}
    for r in roads.outlines(spark, sf_dir).collect():
        ring = [(p["x"], p["y"]) for p in r["points"]]
        want[r["id"]] = pytest.approx(area(clip(ring, places.TRIANGLE)) / area(ring)) if area(ring) else None
    assert {r["id"]: r["share"] for r in roads.b_polygon_coverage(spark, sf_dir).collect()} == want


def test_utm_of_known_points(spark):
    from tidemark.functions import lines

    df = spark.createDataFrame([(87.0, 0.0, 45), (3.0, 45.0, 31)], "x double, y double, z int")
    got = df.select(*lines.utm(F.col("x"), F.col("y"), F.col("z"))).collect()
    assert got[0][0] == pytest.approx(500000) and got[0][1] == pytest.approx(0) and got[1][1] == pytest.approx(4982950.400, abs=0.01)


def test_parts_of_a_line(spark):
    from tidemark.functions import lines

    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 0.0), (4.0, 4.0)],)], "p array<struct<x: double, y: double>>")
    r = df.select(lines.part(F.col("p"), F.lit(3.0), F.lit(6.0)).alias("a"), lines.nearest_point(F.col("p"), F.lit(5.0), F.lit(2.0)).alias("n"), lines.without_repeats(F.col("p")).alias("w")).first()
    assert [tuple(p) for p in r["a"]] == [(3, 0), (4, 0), (4, 2)] and tuple(r["n"]) == (1.0, 6.0) and len(r["w"]) == 3


def test_pieces_between_junctions(spark):
    from tidemark.operators import roads

    df = spark.createDataFrame([("a", [(0.0, 0.0), (5.0, 0.0), (10.0, 0.0)]), ("b", [(5.001, 0.001), (5.0, 7.0)])], "way string, points array<struct<x: double, y: double>>")
    got = roads.pieces(df, "way")
    assert sorted((r["way"], r["part"], r["length"]) for r in got.collect()) == [("a", 1, 5.0), ("a", 2, 5.0), ("b", 1, 7.0)]
    snap = roads.snapped(spark.createDataFrame([(1, 5.0, 3.0), (2, 99.0, 99.0)], "id int, x double, y double"), got, 4.0)
    assert {r["id"]: r["distance"] for r in snap.collect()} == {1: 3.0, 2: None}


def test_polygons_with_holes_equal_brute_force(spark):
    outer, hole = [(0.3, 0.2), (9.7, 1.1), (5.2, 4.4), (8.9, 9.6), (0.6, 7.7)], [(2.1, 2.2), (4.1, 2.4), (3.3, 5.9)]
    rows = [("a", outer), ("a", hole), ("flat", [(1.0, 1.0), (3.0, 1.0)]), ("none", []), ("null", None)]
    rings = spark.createDataFrame(rows, "k string, points array<struct<x: double, y: double>>")

    def inside(x, y):
        found = False
        for ring in (outer, hole):
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                found ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return found

    def passed(r, c):  # an edge cut to the pixel leaves a piece
        for ring in (outer, hole):
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                lo, hi = 0.0, 1.0
                for a, d, least in ((ax, bx - ax, c), (ay, by - ay, r)):
                    near, far = sorted(((least - a) / d, (least + 1 - a) / d))
                    lo, hi = max(lo, near), min(hi, far)
                if lo <= hi:
                    return True
        return False

    cells = [(r, c) for r in range(-1, 12) for c in range(-1, 12)]
    centres = {p for p in cells if inside(p[1] + 0.5, p[0] + 0.5)}
    assert {(x["k"], x["row"], x["col"]) for x in exposure.cells_inside(rings, "k", 1.0).collect()} == {("a", *p) for p in centres}
    touched = [(x["k"], x["row"], x["col"]) for x in exposure.cells_touched(rings, "k", 1.0).collect()]
    assert len(touched) == len(set(touched)) and set(touched) == {("a", *p) for p in cells if p in centres or passed(*p)} | {("flat", 1, c) for c in (1, 2, 3)}


def test_earliest_pair_needs_a_track(spark):
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, 15, 6) + dt.timedelta(days=d)
    rows = [("g", 1, at(1), 1, 0, 1.0), ("g", 2, at(2), 2, 0, 1.0), ("g", 3, at(-3), 2, 0, 1.0), ("g", 4, at(-2), 2, 0, 0.5), ("g", 5, at(0), 1, 0, 1.0), ("g", 6, at(-40), 1, 0, 1.0), ("h", 7, at(13), 1, 0, 1.0), ("h", 8, at(-1), 1, 0, None)]
    df = spark.createDataFrame(rows, "g string, scene_id int, ts timestamp, orbit int, direction int, coverage double")
    assert list(map(tuple, selection.earliest_pairs(df, "g", F.lit(dt.date(2024, 1, 15)), 12, 36, 0.9).collect())) == [("g", 3, 2)]
