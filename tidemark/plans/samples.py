"""Sample, metric and record lenses: documents are samples of the activation `source`, those labelled toxic are
quarantined by language; labels compare quality (truth) with toxic (prediction); orders are stage records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.raster import quantised
from tidemark.operators import governance, sampling, stats
from tidemark.plans.common import Lens, table

lens = Lens()
BUDGET = 150
_Q = lambda x, s="1e4": f"CAST(floor(({x}) * {s} + 0.5) AS BIGINT)"
_E = """WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id), s AS (SELECT d.doc_id, source, CASE d.doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, CASE WHEN toxic = 1 THEN 'TOXIC_' || upper(lang) END AS reason_code FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
n AS (SELECT source, count(*) AS n FROM s WHERE split = 'train' AND reason_code IS NULL GROUP BY source), q AS (SELECT *, CAST(150 AS DOUBLE) * n / sum(n) OVER () AS exact FROM n),
a AS (SELECT source, n, CAST(floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, source) <= 150 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM q),
p AS (SELECT s.source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('tile:' || doc_id), doc_id) AS rk FROM s WHERE split = 'train' AND reason_code IS NULL) s JOIN a ON a.source = s.source WHERE rk <= allocated)"""


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("split"))
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    quarantine = d.join(bad, "doc_id", "left_semi").select("doc_id", F.concat(F.lit("TOXIC_"), F.upper("lang")).alias("reason_code"))
    return sampling.partition_eligible(d, quarantine, "doc_id").select("doc_id", "source", "split", "reason_code")


def _allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = eligible(spark, sf_dir).where("split = 'train' and reason_code is null")
    return sampling.largest_remainder(train.groupBy("source").agg(F.count("*").alias("n")), "source", BUDGET)


@lens(f"{_E} SELECT * FROM s")
def s_quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible(spark, sf_dir)


@lens(f"{_E} SELECT split, reason_code, count(*) AS n FROM s WHERE reason_code IS NOT NULL GROUP BY ALL")
def s_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible(spark, sf_dir).where("reason_code is not null").groupBy("split", "reason_code").agg(F.count("*").alias("n"))


@lens(f"{_E} SELECT * FROM a")
def s_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allocation(spark, sf_dir)


@lens(f"{_E} SELECT * FROM p")
def s_seeded_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = eligible(spark, sf_dir).where("split = 'train' and reason_code is null").select("source", "doc_id")
    return sampling.seeded_pick(train, _allocation(spark, sf_dir), "source", "doc_id", "tile")


@lens(f"{_E} SELECT count(*) AS samples, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS digest FROM p")
def s_manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the seeded pick; its size is the budget."""
    ids = F.collect_list(F.col("doc_id").cast("string"))
    return s_seeded_pick(spark, sf_dir).agg(F.count("*").alias("samples"), T.ids_digest(ids).alias("digest"))


_M = "WITH c AS (SELECT coalesce(quality, 3) AS truth, least(1, greatest(0, toxic)) AS pred, count(*) AS n FROM labels WHERE coalesce(quality, 3) <> 3 GROUP BY ALL), k AS (SELECT unnest([0, 1]) AS class), t AS (SELECT class, coalesce(sum(n) FILTER (truth = class AND pred = class), 0) AS tp, coalesce(sum(n) FILTER (truth <> class AND pred = class), 0) AS fp, coalesce(sum(n) FILTER (truth = class AND pred <> class), 0) AS fn FROM c, k GROUP BY class), u AS (SELECT class, tp / nullif(tp + fp + fn, 0) AS iou, tp / nullif(tp + fp, 0) AS pr, tp / nullif(tp + fn, 0) AS rc, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, tp + fn AS support FROM t)"


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.confusion(table(spark, sf_dir, "labels").withColumn("truth", F.coalesce("quality", F.lit(3))), "truth", "toxic", 2, ignore=3)


@lens(f"{_M} SELECT truth, pred, n FROM c")
def m_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir)


@lens(f"{_M} SELECT class, {_Q('iou')} AS iou, {_Q('pr')} AS precision, {_Q('rc')} AS recall, {_Q('f1')} AS f1, CAST(support AS BIGINT) AS support FROM u")
def m_iou_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.class_scores(_confusion(spark, sf_dir), 2)
    return out.select("class", *[quantised(F.col(c)).alias(c) for c in ("iou", "precision", "recall", "f1")], "support")


@lens(f"{_M} SELECT {_Q('avg(iou)')} AS mean_iou, {_Q('avg(f1)')} AS macro_f1, (SELECT {_Q('sum(n) FILTER (truth = pred) / sum(n)')} FROM c) AS accuracy, (SELECT {_Q('sum(n) FILTER (truth = pred) / (2 * sum(n) - sum(n) FILTER (truth = pred))')} FROM c) AS micro_iou FROM u WHERE support > 0")
def m_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _confusion(spark, sf_dir)
    out = stats.overall_scores(stats.class_scores(c, 2), c)
    return out.select(*[quantised(F.col(x)).alias(x) for x in ("mean_iou", "macro_f1", "accuracy", "micro_iou")])


@lens("""WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1), b AS (SELECT o_custkey AS k, sum(CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END) AS v FROM orders WHERE o_custkey % 11 <> 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS custkey, CASE WHEN b.k IS NULL THEN 'only_recorded' WHEN a.k IS NULL THEN 'only_recomputed' WHEN abs(a.v - b.v) <= 1e-6 OR abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1e-12) <= 1e-9 THEN 'match' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.k = b.k""")
def v_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_custkey")
    recorded = o.where(key % 7 != 0).groupBy(key.alias("custkey")).agg(F.sum("o_totalprice").alias("v"))
    drift = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    recomputed = o.where(key % 11 != 0).groupBy(key.alias("custkey")).agg(F.sum(drift).alias("v"))
    both = stats.cross_check(recorded.withColumn("v", F.round("v", 2)), recomputed.withColumn("v", F.round("v", 2)), "custkey", "v", 1e-9)
    return both


_V = """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus IN ('F', 'P') AS out, o_orderkey % 13 <> 0 AS ok, o_orderpriority IN ('1-URGENT', '2-HIGH') AS blk, o_orderkey % 2 = 0 AS stale, o_totalprice > 100000 AS ready FROM orders),
s AS (SELECT o_custkey, o_orderkey, CASE WHEN out AND NOT ok THEN 'INVALID' WHEN out AND blk AND NOT stale THEN 'CONFLICT' WHEN out THEN 'COMPLETE' WHEN blk AND stale THEN 'STALE_BLOCKER' WHEN blk THEN 'BLOCKED' WHEN ready THEN 'READY' ELSE 'WAITING' END AS state FROM o)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    state = governance.stage_state(F.col("o_orderstatus").isin("F", "P"), k % 13 != 0, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), k % 2 == 0, F.col("o_totalprice") > 100000)
    return o.select("o_custkey", "o_orderkey", state.alias("state"))


@lens(f"{_V} SELECT * FROM s")
def v_stage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


@lens(f"{_V} SELECT o_custkey, CASE WHEN bool_or(state IN ('INVALID', 'CONFLICT')) THEN 'NOT_READY' WHEN bool_and(state = 'COMPLETE') THEN 'OPERATIONAL' ELSE 'LIMITED' END AS verdict, count(*) AS checks FROM s GROUP BY o_custkey")
def v_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.verdict(_states(spark, sf_dir), "o_custkey", "state")


@lens("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') OR event_type IS NULL GROUP BY 1")
def v_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.unexpected_values(table(spark, sf_dir, "events"), "event_type", ["view", "click"])
