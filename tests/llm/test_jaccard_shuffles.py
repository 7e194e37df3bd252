"""Which sets meet in groups, and how often texts are shuffled, in the near-duplicate operator."""

import random

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard
from tidemark.llm.common import text_bytes


def sets_of(texts, n=1):
    return jaccard.shingle_sets(*text_bytes(pa.array(texts)), n)


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("rid"), "text")


def test_one_common_shingle_far_back_makes_no_group(spark):
    texts = [" ".join([f"common{i // 2}", *(f"w{i}x{k}" for k in range(99 + i % 2))]) for i in range(80)]
    sets = sets_of(texts)
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    got = jaccard._groups(jaccard._prefixes(rows_of(spark, texts), 1, 75, nothing, 8), 8, 75)
    got = {r["sig"] for r in got.collect()}
    want, prefixed = set(), 0
    for a, b in zip(sets[::2], sets[1::2], strict=True):
        t = np.intersect1d(a, b)[0]
        i, j = np.searchsorted(a, t) + 1, np.searchsorted(b, t) + 1
        if i <= len(a) - jaccard.least_overlap(len(a), 75) + 1 and j <= len(b) - jaccard.least_overlap(len(b), 75) + 1:
            prefixed += 1
            if i <= jaccard.leading(len(a), 75):
                want |= {jaccard.set_hash(a), jaccard.set_hash(b)}
    assert got == want and len(want) < 2 * prefixed


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_links_at_the_threshold(spark, percent):
    rng, vocabulary = random.Random(5), [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = rng.sample(vocabulary, rng.randrange(3, 30))
        for _ in range(5):
            less = rng.sample(base, max(1, len(base) - rng.randrange(0, 5)))
            texts.append(" ".join(less + rng.sample(vocabulary, rng.randrange(0, 4))))
    sets = [set(s.tolist()) for s in sets_of(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_links"] for r in jaccard.counted_links(docs, n=1, percent=percent, least_frequent=4, most_frequent=20).collect()}
    different = {frozenset(s) for s in sets}
    want = [sum(x != s and 100 * len(x & s) >= percent * len(x | s) for x in different) for s in sets]
    assert got == dict(enumerate(want)) and 0 < sum(w > 0 for w in want) < len(want)


def test_texts_are_shuffled_once(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        plan = cp.drop_near_duplicates(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the documents, and the keys that stay
        scanned = docs.select(F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("sig"), F.xxhash64("doc_id", "text").alias("rid"), F.lit(b"").alias("map"))
        nodes = jaccard._nodes(docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text"), scanned, scanned.select("sig"))
        lines = nodes._jdf.queryExecution().executedPlan().toString().split("\n")
        texts = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        above, at = 0, depth(lines[texts])
        for line in reversed(lines[:texts]):
            if depth(line) < at:
                at = depth(line)
                above += "Exchange" in line
        assert above == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
