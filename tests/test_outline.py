"""Outlines burnt again, and nested sieves against a plain reading of the rule."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import change, exposure, outline


def table(spark, grid, kind="int"):
    return spark.createDataFrame([(r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], f"row bigint, col bigint, value {kind}")


def regions(grid, steps):
    of, sizes = {}, []
    for start in ((r, c) for r, row in enumerate(grid) for c in range(len(row))):
        if start in of:
            continue
        stack, n = [start], 0
        of[start] = len(sizes)
        while stack:
            r, c = stack.pop()
            n += 1
            for y, x in steps:
                q = (r + y, c + x)
                if q not in of and 0 <= q[0] < len(grid) and 0 <= q[1] < len(grid[0]) and grid[q[0]][q[1]] == grid[r][c]:
                    of[q] = of[start]
                    stack.append(q)
        sizes.append(n)
    return of, sizes


EIGHT = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x]


def sieved(grid, least):
    of, size = regions(grid, EIGHT)
    value = {i: grid[r][c] for (r, c), i in of.items()}
    big = {}
    for r in range(len(grid)):
        for c in range(len(grid[0])):
            for y, x in ((-1, 0), (-1, -1), (-1, 1), (0, -1)):
                i, j = of[r, c], of.get((r + y, c + x))
                if j is not None and i != j:
                    for a, b in ((i, j), (j, i)):
                        if a not in big or size[big[a]] < size[b]:
                            big[a] = b
    out = {}
    for p, i in of.items():
        out[p] = value[i]
        if size[i] < least:
            seen, j = {i}, big.get(i)
            while j is not None and size[j] < least and j not in seen:
                seen.add(j)
                j = big.get(j)
            if j is not None and size[j] >= least:
                out[p] = value[j]
    return out


def test_nested_sieve(spark):
    ring = [[0] * 9 for _ in range(9)]
    for r in (3, 4, 5):
        for c in (3, 4, 5):
            ring[r][c] = int((r, c) != (4, 4))
    got = change.sieve(table(spark, ring), 10)
    assert got.count() == 81 and got.where("value = 1").isEmpty()
    rng = random.Random(5)
    for least, share, n in ((10, 0.5, 14), (6, 0.3, 20), (40, 0.5, 9), (1000, 0.4, 6)):
        grid = [[int(rng.random() < share) for _ in range(n)] for _ in range(n)]
        nested = [[int(max(abs(r - n // 2), abs(c - n // 2)) % 2 == 0) for c in range(n)] for r in range(n)]
        for g in (grid, nested):
            assert {(r["row"], r["col"]): r["value"] for r in change.sieve(table(spark, g), least).collect()} == sieved(g, least)
    assert change.sieve(table(spark, []), 10).count() == 0


def test_composed_rule_sieves_nested_regions(spark):
    """The ring of eight flood pixels round a dry one vanishes from the composed rule, too."""
    flood = {(r, c) for r in (3, 4, 5) for c in (3, 4, 5)} - {(4, 4)}
    rows = [(r, c, 1.0, 1e-3 if (r, c) in flood else 1.0, 0.0) for r in range(9) for c in range(9)]
    df = spark.createDataFrame(rows, "row bigint, col bigint, pre double, post double, slope double")
    assert change.classified(df).where("class <> 0").isEmpty() and change.classified(df, least=1).where("class = 2").count() == 8


@pytest.mark.parametrize("seed", range(3))
def test_outlines_burn_back_to_the_raster(spark, seed):
    rng = random.Random(seed)
    n = (5, 9, 16)[seed]
    grid = [[rng.choice((0, 1, 1, 2, None)) if seed < 2 else int((r // 3 + c // 4) % 2 and not 5 < r < 9) for c in range(n)] for r in range(n)]
    corners = outline.outlines(table(spark, grid))
    rings = outline.rings(corners).collect()
    steps = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    of, _ = regions(grid, steps)
    outer = [r for r in rings if r["area"] > 0]
    assert len(outer) == len({i for (r, c), i in of.items() if grid[r][c] is not None})
    for r in rings:  # corners only, joined at right angles; the area is the ring's own
        p = [(q["x"], q["y"]) for q in r["points"]]
        assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2 == r["area"]
        assert all((a[0] == b[0]) != (a[1] == b[1]) and (a[0] == b[0]) != (b[0] == c[0]) for a, b, c in zip(p, p[1:] + p[:1], p[2:] + p[:2], strict=True))
    burnt = exposure.cells_inside(outline.rings(corners).withColumn("k", F.col("value")), "k", 1.0)
    assert sorted((r["k"], r["row"], r["col"]) for r in burnt.collect()) == sorted((v, r, c) for r, row in enumerate(grid) for c, v in enumerate(row) if v is not None)


def test_outline_of_nothing_and_one_long_snake(spark):
    assert outline.outlines(table(spark, [[None, None]])).count() == 0 and outline.outlines(table(spark, [])).count() == 0
    snake = [[1 if r % 2 == 0 or c == (0 if r % 4 == 1 else 39) else 0 for c in range(40)] for r in range(40)]
    per = {r["value"]: r for r in outline.class_summary(outline.outlines(table(spark, snake))).collect()}
    assert (per[1]["outer"], per[1]["holes"], per[1]["area"]) == (1, 0, sum(map(sum, snake)))


def test_edges_are_joined_up_only_across_blocks(spark, monkeypatch):
    """Rounds see only chains of edges that leave their block, and block sizes change no corner, ring or area."""
    rng = random.Random(11)
    grid = [[rng.choice((None, "a", "a", "b", "c")) if 5 < r < 16 else "a" if c % 4 or r == 20 else "b" for c in range(13)] for r in range(21)]
    px = table(spark, grid, "string").select((F.col("row") - 4).alias("row"), (F.col("col") - 7).alias("col"), "value")
    seen, real = [], outline._joined
    monkeypatch.setattr(outline, "_joined", lambda chains: seen.append(chains.count()) or real(chains))
    out = {}
    for block in (1, 3, 7, 512):
        monkeypatch.setattr(outline, "BLOCK", block)
        out[block] = sorted(tuple(r) for r in outline.outlines(px).collect())
    assert out[1] == out[3] == out[7] == out[512] and len({r[1] for r in out[512]}) > 20
    assert seen[3] < seen[2] < seen[1] < seen[0]
    places = {}
    for _, ring, position, x, y, _ in out[3]:
        places.setdefault(ring, []).append((position, x, y))
    for ring in places.values():
        ring.sort()
        for (p, x, y), (q, u, v) in zip(ring, ring[1:]):
            assert abs(x - u) + abs(y - v) == q - p and (x == u or y == v)


def test_composed_rule_shuffles_only_pixels_of_small_regions_at_its_end(spark):
    rng = random.Random(3)
    data = [(r, c, rng.choice([0.2, 0.9]), rng.choice([0.001, 0.3]), 5.0) for r in range(12) for c in range(12)]
    df = spark.createDataFrame(data, "row bigint, col bigint, pre double, post double, slope double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = change.classified(df, least=4)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(region") == plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    flood = sieved([[int(data[12 * r + c][3] < 0.01) for c in range(12)] for r in range(12)], 4)
    assert {(r["row"], r["col"]): int(r["class"] == 2) for r in got.collect()} == flood
