"""Exact top-k inner products with an impact-ordered, score-at-a-time index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OUT = "query_id long, query_no int, vec_id long, score long"


def quantise(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a whole double; null for a vector that is null, or holds null, NaN, infinity
    or a number whose product with scale is infinite. From 2^53 on every double is whole, so floor has nothing to do."""
    usable = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    whole = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    return F.when(usable, F.transform(vec, lambda x: whole(x.cast("double") * scale)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole doubles, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pc.list_value_length(column))
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = np.asarray(column.flatten())
    return out


def posting_segments(vectors: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Postings (row, dimension, impact) by descending quantised impact, which is the bit length of |impact|."""
    level = np.frexp(vectors)[1]
    rows, dims = np.nonzero(level)
    order = np.argsort(-level[rows, dims], kind="stable")
    rows, dims = rows[order], dims[order]
    of = level[rows, dims]
    return [(int(n), rows[of == n], dims[of == n], vectors[rows[of == n], dims[of == n]]) for n in sorted(set(of.tolist()), reverse=True)]


def exact_scores(queries: np.ndarray, vectors: np.ndarray, most: float) -> np.ndarray:
    """Inner product of each pair of rows: doubles where sums up to `most` are exact in them, else Python's whole numbers."""
    if most < 1 << 53:
        return np.einsum("ij,ij->i", queries, vectors)
    return np.array([sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for q, v in zip(queries, vectors, strict=True)], dtype=object)


def score_block(qid: np.ndarray, queries: np.ndarray, cid: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score of the k best candidates of one block for each query: segments are added to all accumulators by descending
    impact until few candidates can still be among the best; those are scored again exactly.

    What is not yet added to an accumulator is at most (largest open impact) * (L1 norm of the query on the open
    dimensions), so a candidate whose upper bound lies below the k-th lower bound is out for certain."""
    most = float(np.abs(queries).sum(1).max(initial=0) * max(1, np.abs(vectors).max(initial=0)))
    kind = np.float32 if most < 1 << 24 else np.float64
    q, size = queries.astype(kind), np.abs(queries).astype(kind)
    acc = np.zeros((len(qid), len(cid)), dtype=kind)
    open_l1 = np.repeat(size.sum(1)[:, None], len(cid), 1)
    own = qid[:, None] == cid[None, :]
    slack = 0 if most < 1 << 53 else float(most) * 1e-9
    possible = ~own
    for level, rows, dims, values in posting_segments(vectors) if most < 1e300 else []:  # beyond, sums are infinite and prove nothing
        part = np.zeros(vectors.shape, dtype=kind)
        part[rows, dims] = values
        acc += q @ part.T
        part[rows, dims] = 1
        open_l1 -= size @ part.T
        rest = (2.0 ** (level - 1) - 1) * open_l1 + slack
        low = np.where(own, -np.inf, acc - rest)
        kth = np.partition(low, -k, axis=1)[:, -k] if len(cid) > k else np.full(len(qid), -np.inf)
        possible = (acc + rest >= kth[:, None]) & ~own
        if possible.sum() <= 4 * k * len(qid):
            break
    qi, ci = np.nonzero(possible)
    exact = np.concatenate([exact_scores(queries[qi[i : i + 100_000]], vectors[ci[i : i + 100_000]], most) for i in range(0, len(qi), 100_000)] or [np.zeros(0)])
    order = np.lexsort((cid[ci], -np.unique(exact, return_inverse=True)[1], qi))
    qi, ci, exact = qi[order], ci[order], exact[order]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[best], cid[ci[best]], exact[best]


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096, query_no: bool = False) -> DataFrame:
    """For each row where is_query holds, the k rows of other ids with the highest integer inner products.

    Rows and queries are dealt by hash into blocks of about `block` rows, and each pair of a query block and a row
    block is one bounded group. Ties go to the smaller id. Defined results: null ids, and vectors that are null or
    hold null or non-finite components (times scale, too), take no part; shorter vectors count as padded with zeros; equal ids are one
    another's own; repeated query rows are searched once, and an id with several different vectors is searched once
    for each, so it has ranks 1 to k as many times (query_no, from 1 in the order of the id's quantised vectors, tells
    them apart and is returned on request); as candidates, repeated rows count one by one; with fewer candidates than
    k all are returned; a returned score beyond 64 bits is an error; an empty table gives no rows. Other columns of the input are ignored. Returns query_id, rank,
    vec_id, score."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), quantise(F.col(vec_col), scale).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and vec is not null")
    n, nq, width = base.agg(F.count("*"), F.count_if("q"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    row_blocks, query_blocks = max(1, -(-n // block)), max(1, -(-nq // block))
    width = max(1, width)
    base = base.withColumn("salt", F.xxhash64("id", F.lit("block")))
    rows = base.select("id", "vec", F.pmod("salt", F.lit(row_blocks)).alias("cb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"))
    padded = F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vec")))
    queries = base.where("q").select("id", padded.alias("vec"), "salt").distinct().withColumn("no", F.row_number().over(Window.partitionBy("id").orderBy("vec")))
    queries = queries.select("id", "no", "vec", F.pmod("salt", F.lit(query_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("cb"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        cid, cand = np.asarray(right["id"]), matrix(right["vec"], width)
        for i in range(0, len(left) if len(cid) else 0, 512):
            part = left.slice(i, 512)
            qid = np.asarray(part["id"])
            at, *best = score_block(qid, matrix(part["vec"], width), cid, cand, k)
            found.append((qid[at], np.asarray(part["no"])[at], *best))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 4
        parts[3] = np.array([int(x) for x in parts[3]], dtype=np.int64)  # an error where it does not fit
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table({name: pa.array(x, kind) for name, x, kind in zip(("query_id", "query_no", "vec_id", "score"), parts, kinds, strict=True)})

    found = queries.groupBy("qb", "cb").cogroup(rows.groupBy("qb", "cb")).applyInArrow(score, _OUT)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", *(["query_no"] if query_no else []), "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
