"""Hard negatives against all pairs, SQL, and on rows that take no part."""

import math
import random

import numpy as np
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from tidemark.llm import negatives, registry, search

SCHEMA = "vec_id bigint, embedding array<double>, label int, id int, no int, anchor boolean"


def brute(rows, is_anchor, k=5, low=80, high=100, scale=256):
    usable = [(i, [math.floor(scale * x) for x in v], y) for i, v, y, *_ in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], {}
    for i, v, y in sorted({(i, tuple(v), y) for i, v, y in usable if is_anchor(i)}, key=lambda a: (a[0], a[2], a[1])):
        no = seen[i] = seen.get(i, 0) + 1
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, w, z in usable if j != i]
        for place, (s, p, _) in enumerate(sorted(x for x in scored if x[2] == y)[:k], 1):
            fits = sorted(x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s)
            out += [(i, p, rank, n, -s, -t, no, place) for rank, (t, n, _) in enumerate(fits[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 1024), (37, 3)])
def test_hard_negatives(spark, blocks):
    rng = random.Random(3)
    rows = [(i, [rng.choice((rng.gauss(0, 1), 0.5, 0.0)) for _ in range(rng.choice((6, 6, 6, 4)))], rng.choice((0, 0, 0, 1, 2, None)), 1, 1, True) for i in range(300)]
    rows += [(i, rows[7][1], i % 3, 1, 1, True) for i in range(300, 340)] + [rows[10], rows[10], (20, [0.25] * 6, 1, 1, 1, True), (40, [0.0] * 6, 0, 1, 1, True), (60, [], 0, 1, 1, True)]
    rows += [(None, [1.0] * 6, 0, 1, 1, True), (400, None, 0, 1, 1, True), (401, [1.0, None], 0, 1, 1, True), (402, [float("nan")], 0, 1, 1, True), (403, [float("inf")], 1, 1, 1, True), (404, [1e307], 1, 1, 1, True)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, block=blocks[0], anchor_block=blocks[1])
    assert sorted(map(tuple, got.collect())) == brute([r for r in rows if r[0] != 404], lambda i: i % 10 == 0)
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


def test_walks_stop_early_and_lose_nothing():
    """On clustered rows the walk ends before the lists do, with the same rows as a full scan."""
    rng, read = np.random.default_rng(2), []
    vectors = np.floor(rng.normal(size=(2000, 4)) * 50)
    of = negatives.Lists(np.arange(2000), vectors)
    product = of.product
    of.product = lambda rows, dims, anchor: (read.append(len(rows)), product(rows, dims, anchor))[1]
    for _ in range(50):
        anchor = np.floor(rng.normal(size=4) * 50)
        score, may = vectors @ anchor, rng.random(2000) < 0.5
        high = np.sort(score)[-rng.integers(1, 50)]
        for (rows, scores), (low, high_) in zip(negatives.threshold_search(of, anchor, may, [(-np.inf, np.inf), (0.8 * high, high)], 5), [(-np.inf, np.inf), (0.8 * high, high)], strict=True):
            inside = np.flatnonzero(may & (score >= low) & (score <= high_))
            want = inside[np.lexsort((inside, -score[inside]))][:5]
            assert rows.tolist() == want.tolist() and scores.tolist() == score[want].tolist()
    assert sum(read) < 0.5 * 50 * 2000


def test_large_components(spark):
    """Sums beyond 2^53 stay exact; scores beyond 64 bits are an error and not another number."""
    rows = [(0, [1e7, 1e-2]), (1, [1e7, 2e-2]), (2, [1e7, 3e-2]), (3, [1e17, -1e17]), (4, [-1e7, 5.0])]
    table = spark.createDataFrame([(i, v, i % 2, 1, 1, True) for i, v in rows], SCHEMA)
    for scale, op in ((256, lambda: negatives.mine(table.where("vec_id <> 3"), F.col("vec_id") == 0, low=0)), (64, lambda: search.exact_topk(table.where("vec_id <> 3"), F.col("vec_id") == 0))):
        whole = {i: [math.floor(scale * x) for x in v] for i, v in rows}
        product = lambda i: sum(a * b for a, b in zip(whole[0], whole[i], strict=True))
        got = op().collect()
        assert got and all(r["negative_score" if scale == 256 else "score"] == product(r["negative_id" if scale == 256 else "vec_id"]) for r in got)
    for df in (search.exact_topk(table, F.col("vec_id") == 3), search.exact_topk(spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 1.0])], "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0)):
        with pytest.raises(Exception, match="too large|too big|Overflow"):
            df.collect()


def test_query_equals_sql(spark, sf_dir):
    assert spark_rows(registry.queries()["op11_hard_negatives"](spark, sf_dir)) == duck_rows(registry.oracle_sql()["op11_hard_negatives"], sf_dir)
