"""Components by contraction: results, and how the graph shrinks."""

import random

from tidemark.operators import graph


def test_graph_shrinks_from_round_to_round(spark, monkeypatch):
    """Each round's graph has at most half the nodes of the one before; names are least nodes, of strings, too."""
    rng = random.Random(9)
    chain = rng.sample(range(1000, 1200), 150)
    links = [*zip(chain, chain[1:]), *((i, i + 1) for i in range(0, 60)), *((5000 + i % 3, 2000 + i) for i in range(40)), (7, 7), (9000, 9000), (8001, 8000), (8000, 8001)]
    links += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(260)]
    least = {n: n for a, b in links if a != b for n in (a, b)}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if a != b and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                moved = True
    real, nodes = graph.written, []

    def counted(df):
        out = real(df)
        if out.columns == ["a", "b"]:
            nodes.append(len({n for r in out.collect() for n in r}))
        return out

    monkeypatch.setattr(graph, "written", counted)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == least
    assert nodes[0] == len(least) and nodes[-1] == 0 and len(nodes) > 2
    assert all(2 * after <= before for before, after in zip(nodes, nodes[1:]))
    words = graph.components(df.selectExpr("cast(a as string) a", "cast(b as string) b")).collect()
    groups = {}
    for node, root in least.items():
        groups.setdefault(root, set()).add(str(node))
    assert {r["node"]: r["component"] for r in words} == {n: min(g) for g in groups.values() for n in g}
