"""Shortest paths by bounds on the distance: what is read, and what no choice of bounds may change."""

import math
import random

import pytest

from tidemark.operators import graph


def relaxed(spec, hubs):
    """Least (distance, hub, previous) per scenario, group and node, by plain relaxation."""
    best = {}
    for s, g, n, hub in hubs:
        best[s, g, n] = min(best.get((s, g, n), (0.0, hub, -1)), (0.0, hub, -1))
    while True:
        before = dict(best)
        for (s, g, n), (d, hub, _) in before.items():
            for r, a, b, length in spec:
                for u, v in ((a, b), (b, a)):
                    if r == s and u == n and u != v and length > 0:
                        best[s, g, v] = min(best.get((s, g, v), (math.inf, 0, 0)), (d + length, hub, u))
        if best == before:
            return best


@pytest.mark.parametrize("first", [0.02, 1.0])
def test_phases_settle_nodes_and_leave_their_arcs_out(spark, monkeypatch, first):
    """Bounds change no distance, hub or previous node; what a phase leaves over are fewer arcs each time."""
    rng = random.Random(3)
    spec = [(s, rng.randrange(40), rng.randrange(40), float(rng.choice((1, 2, 2, 3, 5, 40)))) for s in ("a", "b") for _ in range(90)]
    spec += [("a", 100 + i, 101 + i, 1000.0) for i in range(3)] + [("a", 200, 201, 1.0), ("c", 1, 2, 1.0)]
    hubs = [(s, g, n, n) for s in ("a", "b") for g, n in (("x", 0), ("x", 7), ("y", 3))] + [("a", "y", 100, 100), ("d", "x", 5, 5)]
    monkeypatch.setattr(graph, "FIRST_BOUND", first)
    real, left = graph.written, []

    def counted(df):
        out = real(df)
        if out.columns == ["s", "u", "v", "length"] or out.columns == ["s", "v", "u", "length"]:
            left.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    edges, sources = spark.createDataFrame(spec, "s string, u int, v int, length double"), spark.createDataFrame(hubs, "s string, g string, node int, hub int")
    got = {(r["s"], r["g"], r["node"]): (r["distance"], r["hub"], -1 if r["previous"] is None else r["previous"]) for r in graph.shortest_paths(edges, sources, ["s"], ["g"]).collect()}
    assert got == relaxed(spec, hubs)
    assert left[1:] == sorted(left[1:], reverse=True) and left[-1] < left[0] / 4
    assert len(left) > 3 or first == 1.0


def test_lengths_without_end(spark):
    """Bounds end where lengths do not: infinite and undefined lengths are the largest, as in Spark."""
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, math.inf), (3, 4, math.nan), (8, 9, 1.0)], "u int, v int, length double")
    got = {r["node"]: str(r["distance"]) for r in graph.shortest_paths(edges, spark.createDataFrame([(1, 1)], "node int, hub int")).collect()}
    assert got == {1: "0.0", 2: "1.0", 3: "inf", 4: "nan"}
