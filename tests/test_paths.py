"""Paths by doubling, and relaxations over several scenarios and groups."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, rivers


def test_a_long_chain_in_few_rounds(spark, monkeypatch):
    n, rounds = 600, []
    inner = graph.written
    monkeypatch.setattr(graph, "written", lambda df: (rounds.append(1), inner(df))[1])
    chain = spark.range(1, n + 1).select("id", (F.col("id") % n + 1).alias("to")).where(F.col("id") < n)
    tables = graph.doubled(chain)
    places = graph.walked(spark.createDataFrame([(1, 1), (500, 500), (n, n), (99_999, 99_999)], "start long, id long"), tables)
    got = {}
    for r in places.collect():
        got.setdefault(r["start"], []).append((r["step"], r["id"]))
    assert sorted(got[1]) == [(i, i + 1) for i in range(n)] and sorted(got[500])[-1] == (100, n) and got[n] == [(0, n)] and got[99_999] == [(0, 99_999)]
    assert len(rounds) < 30
    totals = {r["id"]: tuple(r)[1:] for r in graph.path_totals(chain, spark.range(1, n + 1).select("id", F.lit(2).alias("value"))).collect()}
    assert totals[1] == (n, 2 * n, n) and totals[n] == (1, 2, n)
    ring = chain.unionByName(spark.createDataFrame([(n, 5)], "id long, to long"))
    for broken in (lambda: graph.doubled(ring), lambda: graph.path_totals(ring, spark.range(1, n + 1).select("id", F.lit(2).alias("value")))):
        with pytest.raises(ValueError, match="cycle"):
            broken()


def test_stops_and_repeated_reaches(spark):
    schema = "id long, next_down long, upland double, ord_stra int"
    r = spark.createDataFrame([(1, 2, 1.0, 1), (2, 3, 2.0, 1), (3, 4, 3.0, 1), (4, 9, 4.0, 1)], schema)
    got = sorted((x["start"], x["step"], x["id"]) for x in rivers.downstream(r, [3]).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 4), (4, 0, 4)]
    assert {x["start"]: (x["reaches"], x["total"], x["last"]) for x in rivers.downstream_totals(r).collect()} == {1: (4, 10, 4), 2: (3, 9, 4), 3: (2, 7, 4), 4: (1, 4, 4)}
    with pytest.raises(ValueError, match="reach 1 occurs twice"):
        rivers.downstream(r.unionByName(r.limit(1)))
    with pytest.raises(ValueError, match="more than 2"):
        rivers.downstream(r, most=2)


@pytest.mark.parametrize("merge", [2])
def test_labels_equal_single_runs_and_routes_add_up(spark, merge):
    rng = random.Random(9)
    rows = [(s, rng.randrange(14), rng.randrange(14), float(rng.randrange(0, 9))) for s in "ab" for _ in range(40)]
    edges = spark.createDataFrame(rows, "s string, u int, v int, length double")
    hubs = [("a", "x", 0, 7), ("a", "y", 3, 8), ("a", "y", 4, 9), ("b", "x", 0, 7), ("b", "y", 13, 1)]
    paths = graph.written(graph.shortest_paths(edges, spark.createDataFrame(hubs, "s string, g string, node int, hub int"), ["s"], ["g"], merge))
    got = {(r["s"], r["g"], r["node"]): (r["distance"], r["hub"], r["previous"]) for r in paths.collect()}
    for s, g in {(h[0], h[1]) for h in hubs}:
        own = [(h[2], h[3]) for h in hubs if h[:2] == (s, g)]
        single = graph.shortest_paths(edges.where(F.col("s") == s).drop("s"), spark.createDataFrame(own, "node int, hub int"))
        assert {r["node"]: (r["distance"], r["hub"], r["previous"]) for r in single.collect()} == {k[2]: v for k, v in got.items() if k[:2] == (s, g)}
    shortest = {}
    for s, u, v, length in rows:
        if u != v and length > 0:
            shortest[s, u, v] = shortest[s, v, u] = min(length, shortest.get((s, u, v), 99))
    legs = {}
    for r in graph.routes(paths, paths.select("s", "g", "node"), ["s", "g"]).collect():
        legs.setdefault((r["s"], r["g"], r["start"]), []).append((r["step"], r["u"], r["v"]))
    for k, (distance, _, previous) in got.items():
        way = sorted(legs.get(k, []))
        assert [x[0] for x in way] == list(range(len(way))) and (not way) == (previous is None)
        assert all(a[2] == b[1] for a, b in zip(way, way[1:], strict=False)) and sum(shortest[k[0], u, v] for _, u, v in way) == distance


def test_components_keep_lone_nodes_and_are_ranked(spark):
    nodes = spark.createDataFrame([(i,) for i in range(9)], "node bigint")
    left = spark.createDataFrame([(0, 1, 500.0), (0, 1, 400.0), (2, 3, 900.0), (3, 4, 0.0), (5, 5, 7.0)], "u bigint, v bigint, length double")
    labels = graph.scenario_components(nodes, left)
    assert {r["node"]: r["component"] for r in labels.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5, 6: 6, 7: 7, 8: 8}
    assert [tuple(r) for r in graph.component_roads(labels, left, 4).collect()] == [(2, 3, 0.9), (0, 2, 0.9), (5, 1, 0.007), (6, 1, 0.0)]
    assert graph.component_roads(labels, left).count() == 6
    assert graph.component_roads(graph.scenario_components(nodes.limit(0), left.limit(0)), left.limit(0), 5).count() == 0
