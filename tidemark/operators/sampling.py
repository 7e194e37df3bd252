"""Sample governance: quarantine, apportionment and seeded selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def partition_eligible(samples: DataFrame, quarantine: DataFrame, key: str) -> DataFrame:
    """samples with reason_code, NULL for eligible ones; an id quarantined twice is an error."""
    if not quarantine.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("an id is quarantined twice")
    return samples.join(quarantine.select(key, "reason_code"), key, "left")


def largest_remainder(counts: DataFrame, group: str, budget: int, minimum: int = 0) -> DataFrame:
    """group, n, allocated: floors of the exact shares, and one more for the largest remainders, ties by group.

    counts has one row per group (group, n); windows are over those rows. A budget above the total, or a minimum that
    the budget or a group can't give, is an error. Groups below the minimum are raised to it one by one at the cost of
    the largest; that repair runs on the collected group table and only where it is needed."""
    every = Window.partitionBy()
    q = counts.withColumn("exact", F.lit(float(budget)) * F.col("n") / F.sum("n").over(every))
    q = q.withColumn("base", F.floor("exact")).withColumn("left", F.lit(budget) - F.sum("base").over(every))
    by_rest = Window.orderBy(F.desc(F.col("exact") - F.col("base")), group)
    out = q.withColumn("allocated", (F.col("base") + (F.row_number().over(by_rest) <= F.col("left")).cast("int")).cast("bigint")).select(group, "n", "allocated")
    total, groups, fewest, least = out.agg(F.sum("n"), F.count("*"), F.min("n"), F.min("allocated")).first()
    if not groups or budget <= 0 or budget > total or minimum * groups > budget or fewest < minimum:
        raise ValueError("the budget or the minimum can't be met")
    if least >= minimum:
        return out
    rows = {r[group]: r.asDict() for r in out.collect()}
    for name in sorted(rows):
        while rows[name]["allocated"] < minimum:
            donor = min((r for r in rows.values() if r["allocated"] > minimum), key=lambda r: (-r["allocated"], r[group]))
            donor["allocated"] -= 1
            rows[name]["allocated"] += 1
    return counts.sparkSession.createDataFrame(list(rows.values()), out.schema)


def seeded_order(seed: str, key: Column) -> Column:
    """An order that looks random and that any engine can repeat."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def seeded_pick(samples: DataFrame, allocation: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """The allocated number of samples of each group, first by seeded order."""
    order = Window.partitionBy(group).orderBy(seeded_order(seed, F.col(key)), key)
    ranked = samples.withColumn("rank", F.row_number().over(order))
    return ranked.join(allocation.select(group, "allocated"), group).where("rank <= allocated").drop("allocated", "rank")
