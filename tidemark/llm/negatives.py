"""Hard-negative mining: Fagin's threshold algorithm over the sorted components of blocks of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scope, written
from tidemark.llm.search import matrix, quantise

#: Doubles hold every whole number below this.
EXACT = 1 << 53


class Lists:
    """Rows of a block with, for each dimension, the rows in ascending order of their component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.largest = float(np.abs(vectors).max(initial=0))

    def exact(self, anchor: np.ndarray) -> bool:
        return float(np.abs(anchor).sum()) * max(1.0, self.largest) < EXACT

    def product(self, rows: np.ndarray, dims: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Sums over dims of the components of rows (one row, or one for each dimension) times those of the anchor:
        doubles where these are exact, else Python's whole numbers."""
        x = self.vectors[rows[:, None], dims] if rows.ndim == 1 else self.vectors[rows, dims]
        if self.exact(anchor):
            return x @ anchor[dims]
        return np.array([sum(int(p) * int(q) for p, q in zip(row, anchor[dims], strict=True)) for row in x], dtype=object)


def _kth(scores: np.ndarray, k: int) -> int | float | None:
    return np.sort(scores)[-k] if len(scores) >= k else None


def threshold_search(lists: Lists, anchor: np.ndarray, may: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window [low, high] of scores, the rows and scores of the k best rows where `may` holds (ties by id).

    Sorted access goes down the lists of all dimensions in step, each from the end that the sign of the anchor's
    component favours; rows met for the first time are scored by random access. No row that is still unseen can score
    above the threshold, the product of the anchor with the components last read, so the walk ends as soon as the
    threshold is strictly below the k-th best score in every window, or below the window itself."""
    n = len(lists.ids)
    dims = np.flatnonzero(anchor) if anchor.any() else np.zeros(1, np.int64)
    from_top = anchor[dims] > 0
    seen, rows, scores = np.zeros(n, dtype=bool), [np.zeros(0, np.int64)], [np.zeros(0)]
    depth, step = 0, 16
    while depth < n:
        upto = min(n, depth + step)
        at = np.arange(depth, upto)[:, None]
        met = lists.order[np.where(from_top, n - 1 - at, at), dims]
        fresh = np.zeros(n, dtype=bool)
        fresh[met.ravel()] = True
        fresh &= ~seen
        seen |= fresh
        rows.append(np.flatnonzero(fresh & may))
        scores.append(lists.product(rows[-1], dims, anchor))
        every, threshold = np.concatenate(scores), lists.product(met[-1:], dims, anchor)[0]
        kth = [_kth(every[(every >= low) & (every <= high)], k) for low, high in windows]
        if all(threshold < low or (x is not None and threshold < x) for x, (low, _) in zip(kth, windows, strict=True)):
            break
        depth, step = upto, 2 * step
    row, score = np.concatenate(rows), np.concatenate(scores)
    out = []
    for low, high in windows:
        inside = np.flatnonzero((score >= low) & (score <= high))
        place = np.unique(score[inside], return_inverse=True)[1]
        best = inside[np.lexsort((lists.ids[row[inside]], -place))[:k]]
        out.append((row[best], score[best]))
    return out


def score_window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * positive <= 100 * s <= high * positive; low above high if there are none."""
    return -(-low * positive // 100), high * positive // 100


def longs(values: list[int] | np.ndarray) -> pa.Array:
    """Whole numbers as longs; one that does not fit is an error."""
    return pa.array([int(x) for x in values], pa.int64())


def _by_blocks(anchors: DataFrame, rows: DataFrame, n_anchor_blocks: int, n_row_blocks: int, find: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """find(anchors, rows) for each pair of a block of anchors and a block of rows."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = anchors.withColumn("rb", every(n_row_blocks))
    right = rows.withColumn("ab", every(n_anchor_blocks))
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(find, schema)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = 4096, anchor_block: int = 1024,
) -> DataFrame:
    """Negatives of each row where is_anchor holds and each of its positives.

    Components become floor(scale * x); scores are exact inner products with the anchor, higher ones first, ties by
    the smaller id. Positives are the first rows of other ids with the anchor's label; negatives of a positive are the
    first rows of other labels whose score is between low and high percent of the positive's.

    Rows and anchors are dealt into blocks of about `block` and `anchor_block` rows, and each pair of blocks is one
    bounded group that is searched by the threshold algorithm: first for positives, within the rows of the anchor's
    label, then for the windows of all its positives at once. Blocks give at most `negatives` rows a window, so what
    is ranked over the cluster is the winners of blocks.

    Defined results: rows with a null id, label or vector, or with a component that is null or not finite (times
    scale, too), take no part; shorter vectors count as padded with zeros; equal ids are one another's own; repeated
    rows count one by one as positives and negatives, and once as anchors, while an id with several vectors or labels
    is an anchor for each of them (anchor_no, from 1); an anchor without another row of its label, or without rows in
    a positive's window, has no row; a returned score beyond 64 bits is an error; an empty table gives no rows; other
    columns are ignored. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score, then
    anchor_no and positive_rank."""
    with scope() as keep:
        base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), quantise(F.col(vec_col), scale).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
        base = written(base.where("id is not null and label is not null and vec is not null"))
        n, n_anchors, width = base.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
        width, n_row_blocks, n_anchor_blocks = max(1, width), max(1, -(-n // block)), max(1, -(-n_anchors // anchor_block))
        # the row's place is hashed, too: rows that share an id are spread
        rows = base.select("id", "label", "vec", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_row_blocks)).alias("rb"))
        anchors = base.where("anchor").select("id", "label", "vec").distinct().withColumn("no", F.row_number().over(Window.partitionBy("id").orderBy("label", "vec")))
        anchors = written(anchors.withColumn("ab", F.pmod(F.xxhash64("id", F.lit("anchor")), F.lit(n_anchor_blocks))))

        def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
            found: list[tuple] = []
            ids, vecs, labels = np.asarray(right["id"]), matrix(right["vec"], width), np.asarray(right["label"])
            lists: dict = {}
            for id_, no, label, anchor in zip(left["id"].to_pylist(), left["no"].to_pylist(), np.asarray(left["label"]), matrix(left["vec"], width), strict=True):
                if label not in lists:
                    own = labels == label
                    lists[label] = Lists(ids[own], vecs[own])
                of = lists[label]
                for row, score in threshold_search(of, anchor, of.ids != id_, [(-np.inf, np.inf)], positives):
                    found += [(id_, no, int(of.ids[r]), int(s)) for r, s in zip(row, score, strict=True)]
            a, no, p, s = zip(*found, strict=True) if found else [()] * 4
            return pa.table({"id": longs(a), "no": pa.array(no, pa.int32()), "positive": longs(p), "score": longs(s)})

        near = _by_blocks(anchors, rows, n_anchor_blocks, n_row_blocks, find_positives, "id long, no int, positive long, score long")
        first = Window.partitionBy("id", "no").orderBy(F.desc("score"), "positive")
        near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
        near = near.groupBy("id", "no").agg(F.sort_array(F.collect_list(F.struct("place", "positive", "score"))).alias("positives"))
        asked = written(anchors.join(near, ["id", "no"]))

        def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
            found: list[tuple] = []
            ids, labels = np.asarray(right["id"]), np.asarray(right["label"])
            of = Lists(ids, matrix(right["vec"], width))
            for id_, no, label, anchor, own in zip(left["id"].to_pylist(), left["no"].to_pylist(), np.asarray(left["label"]), matrix(left["vec"], width), left["positives"].to_pylist(), strict=True):
                bounds = [score_window(p["score"], low, high) for p in own]
                open_ = [i for i, (a, b) in enumerate(bounds) if a <= b]
                best = threshold_search(of, anchor, labels != label, [bounds[i] for i in open_], negatives) if open_ and len(ids) else []
                for i, (row, score) in zip(open_, best, strict=False):
                    found += [(id_, no, own[i]["place"], own[i]["positive"], own[i]["score"], int(ids[r]), int(s)) for r, s in zip(row, score, strict=True)]
            a, no, place, p, ps, n, ns = zip(*found, strict=True) if found else [()] * 7
            return pa.table({"id": longs(a), "no": pa.array(no, pa.int32()), "place": pa.array(place, pa.int32()), "positive": longs(p), "positive_score": longs(ps), "negative": longs(n), "negative_score": longs(ns)})

        hard = _by_blocks(asked, rows, n_anchor_blocks, n_row_blocks, find_negatives, "id long, no int, place int, positive long, positive_score long, negative long, negative_score long")
        order = Window.partitionBy("id", "no", "place").orderBy(F.desc("negative_score"), "negative")
        hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        return keep(hard.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score", F.col("no").alias("anchor_no"), F.col("place").alias("positive_rank")))


def relabelled(vectors: DataFrame) -> DataFrame:
    """vectors with the label of every seventh id moved on by one, modulo ten."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def digest(vectors: DataFrame) -> DataFrame:
    """Negatives of every hundredth vector: anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_no, positive_rank."""
    return mine(relabelled(vectors), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.vec, c.vec) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS INTEGER) AS positive_rank FROM s WHERE same),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score WHERE p.positive_rank <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, 1 AS anchor_no, positive_rank FROM n WHERE rank <= 5
"""
