"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, written

SEED = "mix-1"
#: A document of more than 1 / LARGE of its source's words has a whole number of expected copies.
LARGE = 50
#: After each document of more than 1 / COUNTED of its source's words, expected copies are made anew.
COUNTED = 1000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source: its size, documents, target and offset in [0, 1).

    Shares by weight are filled like water: with sources ordered by (cap / weight), the level is the largest
    (total - caps before) / (weights from here on), and a target is the lesser of the cap and weight * level."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    per = per.withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(every) - before) / later)
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * F.max("level").over(every)))
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(SEED), F.coalesce("source", F.lit(""))), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return per.select("source", "source_size", "n_docs", "target", offset.alias("offset"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id") -> DataFrame:
    """Every document with the copies that the mix takes of it: columns of docs under `row`, size, source_size, target, copies.

    From the largest document of a source on, expected copies are the words still wanted over the words still there.
    The prefix sum of expected copies plus the source's one random offset crosses as many integers as a document has
    copies. Words are counted off after each document of more than 1 / COUNTED of its source's words (there are fewer
    than COUNTED); all smaller ones have the same expected copies, so that a source of many documents misses its target
    by about one of them. Of the first, documents of more than 1 / LARGE (fewer than LARGE) have the nearest whole number
    and no part in the sum. The order is made by a range partition; ranks are places within partitions, offset by the
    counts of earlier ones, so that a source of any size is spread over tasks, and no window moves a document. Windows
    over sources hold one row per source.

    Defined results: null text has size 0; null source is a source of its own, last in order; repeated rows are
    separate documents; ties of size go by id and hash of the text; an empty table gives no rows; documents without
    words are expected as often as the words of their source on average; a source without words has target 0 and is
    not taken."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sized = rows.select("row", F.col(f"row.`{id_col}`").alias("id"), F.col("row.source").alias("source"), n_words(F.col("row.text")).alias("size"), F.xxhash64("row.text").alias("tie"))
    return _taken(sized, weights, most).drop("tie")


def _taken(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    order = [F.col("source").asc_nulls_last(), "size", "id", "tie"]
    placed = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    counts = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    per = _expected(placed, source_targets(placed, weights, most), most)
    per = written(counts.alias("c").join(per.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source"))).select("c.part", "c.shift", "p.*"))
    joined = placed.alias("d").join(per.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.part") == F.col("p.part")))
    # places from the largest document on, less those whose copies are there
    later = F.col("n_docs") - F.col("place") - F.col("shift") - F.size("counted")
    ratio = F.when(F.col("size") > 0, F.col("ratio")).otherwise(F.col("mean_ratio"))
    crossed = F.least(F.lit(most), F.floor(F.col("sum") + (later + 1) * ratio) - F.floor(F.col("sum") + later * ratio))
    copies = F.when(later < 0, F.get("counted", (later + F.size("counted")).cast("int"))).otherwise(crossed)
    return joined.select(*[F.col(f"d.{c}") for c in sized.columns], "source_size", "target", copies.cast("long").alias("copies"))


def _expected(sized: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """targets with counted (copies of the source's documents over 1 / COUNTED, the largest first), the prefix sum after
    them, ratio (expected copies of the others) and mean_ratio (of the source)."""
    large = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).where(F.col("d.size") * COUNTED > F.col("t.source_size"))
    sizes = large.groupBy(F.col("d.source").alias("of")).agg(F.sort_array(F.collect_list("d.size"), asc=False).alias("sizes"))
    start = F.struct(F.col("target").alias("want"), F.col("source_size").alias("rest"), F.col("offset").alias("sum"), F.array().cast("array<int>").alias("counted"))

    def expected(want: Column, rest: Column) -> Column:
        return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(want, rest), F.lit(0.0))))

    def step(at: Column, size: Column) -> Column:
        # on halves upwards; a document with nothing after it is the last chance to come near the target
        more, whole = expected(at["want"], at["rest"]), size * LARGE > F.col("source_size")
        end = F.when(whole, at["sum"]).otherwise(at["sum"] + more)
        # a sum that is rounded up may cross one integer more than most
        k = F.when(whole, F.floor(more + 0.5)).otherwise(F.least(F.lit(most), F.floor(at["sum"] + more) - F.floor(at["sum"]))).cast("int")
        return F.struct((at["want"] - k * size).alias("want"), (at["rest"] - size).alias("rest"), end.alias("sum"), F.concat(at["counted"], F.array(k)).alias("counted"))

    both = targets.join(sizes, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("end", F.aggregate(F.coalesce("sizes", F.array().cast("array<bigint>")), start, step))
    ratios = [expected(F.col("end.want"), F.col("end.rest")).alias("ratio"), expected(F.col("target"), F.col("source_size")).alias("mean_ratio")]
    return both.select("source", "source_size", "n_docs", "target", "end.sum", "end.counted", *ratios)


def mix_digest(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken: the same mix without carrying the texts."""
    sized = docs.select(F.col("doc_id").alias("id"), "source", n_words(F.col("text")).alias("size"), F.lit(0).alias("tie"))
    return _taken(sized, weights, most).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * max(level) OVER ()) AS target,
  CAST(CAST('0x' || substr(sha256('mix-1' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM f),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, count(*) OVER (PARTITION BY d.source) - row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) + 1 AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, 0::BIGINT AS k, target AS want, source_size AS rest, u AS p, 0::BIGINT AS e FROM t
  UNION ALL SELECT source, k, want - c * size, rest - size, p, c FROM (
    SELECT g.source, r.k, g.want, g.rest, r.size, CASE WHEN r.size * 50 > r.source_size THEN g.p ELSE g.p + least(3.0::DOUBLE, greatest(0.0::DOUBLE, g.want / g.rest)) END AS p,
      CAST(CASE WHEN r.size * 50 > r.source_size THEN floor(least(3.0::DOUBLE, greatest(0.0::DOUBLE, g.want / g.rest)) + 0.5)
        ELSE least(3, floor(g.p + least(3.0::DOUBLE, greatest(0.0::DOUBLE, g.want / g.rest))) - floor(g.p)) END AS BIGINT) AS c
    FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source AND r.k = g.k + 1 AND r.size * 1000 > r.source_size)),
y AS (SELECT source, max(k) AS n, arg_max(p, k) AS p, least(3.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(arg_max(want, k) / nullif(arg_max(rest, k), 0), 0.0::DOUBLE))) AS ratio FROM g GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target, CAST(r.size * coalesce(g.e, least(3, floor(y.p + (r.k - y.n) * y.ratio) - floor(y.p + (r.k - y.n - 1) * y.ratio))) AS BIGINT) AS taken
FROM r JOIN y ON r.source IS NOT DISTINCT FROM y.source LEFT JOIN g ON g.source IS NOT DISTINCT FROM r.source AND g.k = r.k AND g.k > 0
"""
