"""Outlines of class rasters: polygons of equal values as rings of corners."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.graph import written

#: Steps (x, y) of the directions east, north, west, south; a left turn is the next direction.
_STEP = ((1, 0), (0, 1), (-1, 0), (0, -1))
#: Where the edges of a pixel begin, by direction.
_BEGIN = ((0, 0), (1, 0), (1, 1), (0, 1))
#: Rows and columns of the blocks in which edges are followed.
BLOCK = 512
_TRACED = ("chain", "position", "x", "y", "next", "lowest", "edges", "area")


def _boundary(block: pd.DataFrame, low_row: int, low_col: int, width: int) -> tuple[np.ndarray, ...]:
    """pixel, edge, next, dir, before, x, y of the unit edges around the block's own pixels, by edge, with the pixel on the left.

    A pixel has an edge towards each neighbour of another value. Where its end is reached, an edge turns left if the
    pixel ahead has another value, else goes on if the one to the right of that has, else turns right; so pixels that meet
    at a corner only are apart, and regions 4-connected. Before an edge is what leads to it by that rule. Edges are numbered
    by where they begin and their direction."""
    row, col = block["row"].to_numpy(np.int64) - low_row, block["col"].to_numpy(np.int64) - low_col
    code, own = pd.factorize(block["value"])[0], np.flatnonzero(block["home"].to_numpy(bool))
    key = (row + 1) * (width + 2) + col + 1
    sorting = np.argsort(key)
    key, by_key = key[sorting], code[sorting]
    r, c, v = row[own], col[own], code[own]

    def same(dx: int, dy: int) -> np.ndarray:
        sought = (r + dy + 1) * (width + 2) + c + dx + 1
        at = np.minimum(np.searchsorted(key, sought), len(key) - 1)
        return (key[at] == sought) & (by_key[at] == v)

    around = {(dx, dy): same(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
    parts = []
    for d, (dx, dy) in enumerate(_STEP):
        (rx, ry), (x, y) = _STEP[d - 1], _BEGIN[d]
        turn = lambda on, across: np.where(~on, 1, np.where(across, -1, 0))
        to = (d + turn(around[dx, dy], around[dx + rx, dy + ry])) % 4
        before = (d - turn(around[-dx, -dy], around[rx - dx, ry - dy])) % 4
        here = ((r + y) * width + c + x) * 4 + d
        there = ((r + y + dy) * width + c + x + dx) * 4 + to
        mine = ~around[rx, ry]
        parts.append([z[mine] for z in (own, here, there, np.full(len(r), d), before, c + x + low_col, r + y + low_row)])
    found = [np.concatenate(z) for z in zip(*parts, strict=True)]
    order = np.argsort(found[1])
    return tuple(z[order] for z in found)


def _chained(edge: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per edge: the last one of its chain, how many follow up to that, and whether the chain is a ring. A chain ends where
    the next edge isn't among the (sorted) edges, and a ring before its least edge. Pointers are followed by doubling."""
    n = len(edge)
    at = np.minimum(np.searchsorted(edge, to), n - 1)
    ahead = np.where(edge[at] == to, at, -1)
    least, jump, live, moved = np.arange(n), ahead.copy(), np.flatnonzero(ahead >= 0), True
    while moved:
        lower, after = np.minimum(least[live], least[jump[live]]), jump[jump[live]]
        moved = bool((lower < least[live]).any() or (after < 0).any())
        least[live], jump[live] = lower, after
        live = live[after >= 0]
    ring = jump >= 0
    ends = (ahead < 0) | (ring & (ahead == least))
    last, left, jump = np.where(ends, np.arange(n), ahead), (~ends).astype(np.int64), np.where(ends, -1, ahead)
    live = np.flatnonzero(~ends)
    while len(live):
        there = jump[live]
        more, end, after = left[there], last[there], jump[there]
        left[live], last[live], jump[live] = left[live] + more, end, after
        live = live[after >= 0]
    return last, left, ring


def _traced_block(low_row: int, low_col: int, width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For a block with its halo: corners (next is NULL; lowest, edges and area are NULL unless their ring lies within the
    block) and chains that leave it (position: the place of their lowest edge). A chain is named by its first edge."""

    def traced(block: pd.DataFrame) -> pd.DataFrame:
        pixel, edge, to, direction, before, x, y = _boundary(block, low_row, low_col, width)
        n = len(edge)
        last, left, ring = _chained(edge, to) if n else (np.arange(0), np.arange(0), np.zeros(0, bool))
        edges, area, first = np.bincount(last, minlength=n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(area, last, np.where(direction == 1, x, np.where(direction == 3, -x, 0)))
        position = edges[last] - 1 - left
        first[last[position == 0]] = edge[position == 0]
        lowest, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lowest[last[::-1]], place[last[::-1]] = edge[::-1], position[::-1]  # edges are sorted: the least is set last
        value = block["value"].to_numpy()
        c, e = np.flatnonzero(direction != before), np.flatnonzero((left == 0) & ~ring)
        within = lambda z: pd.array(z[last[c]], "Int64").copy()
        corners = {"value": value[pixel[c]], "chain": first[last[c]], "position": position[c], "x": x[c], "y": y[c], "next": pd.array([pd.NA] * len(c), "Int64")}
        for name, z in (("lowest", lowest), ("edges", edges), ("area", area)):
            corners[name] = within(z)
            corners[name][~ring[c]] = pd.NA
        chains = {"value": value[pixel[e]], "chain": first[e], "position": place[e], "x": x[e], "y": y[e], "next": pd.array(to[e], "Int64"), "lowest": pd.array(lowest[e], "Int64"), "edges": pd.array(edges[e], "Int64"), "area": pd.array(area[e], "Int64")}
        return pd.concat([pd.DataFrame(corners), pd.DataFrame(chains)], ignore_index=True)

    return traced


def _joined(chains: DataFrame) -> DataFrame:
    """chain, ring, edges, area, shift of chains (chain, next, lowest, place, edges, area) that make up rings: shift is what
    to add to a place on the chain for its place on the ring, modulo the edges of the ring.

    Pointers are doubled: each round doubles the stretch over which a chain knows the least edge, and then the edges up
    to the ring's last chain, so rounds grow with the log of the most chains of a ring."""
    known = written(chains.select("chain", "next", F.col("lowest").alias("ring"), F.lit(0).alias("same")))
    while not known.where("same = 0").isEmpty():
        ahead = known.select(F.col("chain").alias("next"), F.col("next").alias("after"), F.col("ring").alias("other"))
        known = written(known.join(ahead, "next").select("chain", F.col("after").alias("next"), F.least("ring", "other").alias("ring"), (F.col("other") >= F.col("ring")).cast("int").alias("same")))
    named = chains.join(known.select("chain", "ring"), "chain")
    whole = named.groupBy("ring").agg(F.sum("edges").alias("all"), F.sum("area").alias("sum"), F.max(F.when(F.col("lowest") == F.col("ring"), F.col("chain"))).alias("first"), F.max(F.when(F.col("lowest") == F.col("ring"), F.col("place"))).alias("place"))
    named = written(named.drop("place").join(whole, "ring"))
    # cut before the chain of the least edge: `next` is NULL at the last chain, and `left` counts the edges up to its end
    rest = written(named.select("chain", F.when(F.col("next") != F.col("first"), F.col("next")).alias("next"), F.col("edges").alias("left")))
    while not rest.where("next is not null").isEmpty():
        ahead = rest.select(F.col("chain").alias("next"), F.col("next").alias("after"), F.col("left").alias("more"))
        rest = written(rest.join(ahead, "next", "left").select("chain", F.col("after").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    placed = named.join(rest.select("chain", "left"), "chain")
    return placed.select("chain", "ring", F.col("all").alias("edges"), F.col("sum").alias("area"), (F.col("all") - F.col("left") - F.col("place")).alias("shift"))


def outlines(pixels: DataFrame) -> DataFrame:
    """value, ring, position, x, y, area: the corners, in order, of all rings around regions of equal value.

    pixels: row, col, value; NULL values have no outline; a pixel is a square of side 1 from (col, row). Outer rings turn
    left and have the positive area that they enclose, holes a negative one; a ring is named by its least edge.
    Edges are followed within blocks of pixels first; only the chains that leave their block are then joined up in rounds,
    so that what these shuffle grows with the edges of blocks. A repeated pixel is an error of the caller; an empty raster
    has no rings."""
    low = pixels.agg(F.coalesce(F.min("row"), F.lit(0)), F.coalesce(F.min("col"), F.lit(0)), F.coalesce(F.max("col"), F.lit(0))).first()
    blocks = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / BLOCK), F.floor((F.col(c) + 1) / BLOCK)))
    near = pixels.where("value is not null").select("row", "col", "value", blocks("row").alias("by")).withColumn("bx", blocks("col"))
    near = near.withColumn("home", (F.col("by") == F.floor(F.col("row") / BLOCK)) & (F.col("bx") == F.floor(F.col("col") / BLOCK)))
    made = StructType([pixels.schema["value"], *[StructField(c, LongType()) for c in _TRACED]])
    traced = written(near.groupBy("by", "bx").applyInPandas(_traced_block(low[0], low[1], low[2] - low[1] + 2), made))
    chains = traced.where("next is not null").select("chain", "next", "lowest", F.col("position").alias("place"), "edges", "area")
    corners = traced.where("next is null")
    across = corners.where("edges is null").drop("edges", "area").join(_joined(chains), "chain")
    place = F.pmod(F.col("position") + F.col("shift"), F.col("edges"))
    at = (F.col("x").cast(pixels.schema["col"].dataType).alias("x"), F.col("y").cast(pixels.schema["row"].dataType).alias("y"), "area")
    inside = corners.where("edges is not null").select("value", F.col("chain").alias("ring"), "position", *at)
    return inside.unionByName(across.select("value", "ring", place.alias("position"), *at))


def rings(corners: DataFrame) -> DataFrame:
    """value, ring, points, area: outlines() as closed rings, one row each, as vector features hold them."""
    ordered = F.sort_array(F.collect_list(F.struct("position", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    points = F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return corners.groupBy("value", "ring").agg(points.alias("points"), F.first("area").alias("area"))


def class_summary(corners: DataFrame) -> DataFrame:
    """Per value: outer rings, holes, corners and area."""
    per = corners.groupBy("value", "ring").agg(F.first("area").alias("area"), F.count("*").alias("corners"))
    return per.groupBy("value").agg(F.count_if(F.col("area") > 0).alias("outer"), F.count_if(F.col("area") < 0).alias("holes"), F.sum("corners").alias("corners"), F.sum("area").alias("area"))
