"""Components, shortest paths and reachability on edge tables, by rounds of joins with each round written out;
paths along pointers by doubling them."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import tempfile
import uuid
from collections.abc import Sequence
from math import isnan

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []

#: First bound of shortest_paths() as a share of the edges that are no longer, and by how much bounds grow.
FIRST_BOUND, GROWTH = 0.2, 4.0


def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


atexit.register(_clean)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session may lack one; it gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def removed_at_exit(spark: SparkSession, path: str) -> None:
    _written.append((spark, path))


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def exploded(df: DataFrame) -> DataFrame:
    """df for joins where either side is made by explode(). Spark takes such a table to have as many rows as it had
    before, and would send a large one through the driver as a broadcast; so the join is one of sorted shuffles."""
    return df.hint("merge")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for all nodes of links (a, b).

    By contraction: each node points to the least node within two steps, pointers are followed to their ends by doubling,
    and the links between different ends are the next round's graph. A node that stays has neighbours that point to it
    alone, so nodes at least halve from round to round, and all rounds together read little more than the first."""
    between = lambda d: d.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, folds = written(between(links)), []
    while not folds or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("low")).select("b", F.least("b", "low").alias("low"))
        ends = written(both.join(near, "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("end")))
        while True:
            onward = ends.select(F.col("node").alias("end"), F.col("end").alias("after"))
            moved = written(ends.join(onward, "end").select("node", F.col("after").alias("end"), (F.col("after") < F.col("end")).alias("moved")))
            if moved.where("moved").isEmpty():
                break
            ends = moved.select("node", "end")
        folds.append(ends)
        named = edges.join(ends.select(F.col("node").alias("a"), F.col("end").alias("u")), "a").join(ends.select(F.col("node").alias("b"), F.col("end").alias("v")), "b")
        edges = written(between(named.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    labels = folds.pop().select("node", F.col("end").alias("component"))
    for fold in reversed(folds):
        labels = written(fold.join(labels.select(F.col("node").alias("end"), "component"), "end", "left").select("node", F.coalesce("component", "end").alias("component")))
    return labels


def scenario_components(nodes: DataFrame, open_edges: DataFrame) -> DataFrame:
    """node, component of all nodes (node), of which those without an open edge (u, v) are components of their own. An
    edge to a node that is not among them is an error of the caller and leaves that node out."""
    labels = components(open_edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    return nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_roads(labels: DataFrame, open_edges: DataFrame, top: int | None = None) -> DataFrame:
    """component, nodes, road_km of each component, lengths of its open edges (u, v, length in metres) to three places;
    with top, those of most road, then most nodes, then least name. No window: each task keeps its own top rows."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("nodes"))
    roads = open_edges.groupBy(F.col("u").alias("node")).agg(F.sum("length").alias("metres")).join(labels, "node").groupBy("component").agg(F.sum("metres").alias("metres"))
    out = sizes.join(roads, "component", "left").select("component", "nodes", F.round(F.coalesce("metres", F.lit(0.0)) / 1000, 3).alias("road_km"))
    return out if top is None else out.orderBy(F.desc("road_km"), F.desc("nodes"), "component").limit(top)


def component_ranks(labels: DataFrame) -> DataFrame:
    """component, size and rank, largest first, ties by least node. The window is over one row per component."""
    from pyspark.sql import Window

    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("size"), "component")) - 1)


def shortest_paths(edges: DataFrame, sources: DataFrame, scenario: Sequence[str] = (), group: Sequence[str] = (), merge: int = 8) -> DataFrame:
    """scenario, group, node, distance, hub, previous: least distances from any source over undirected edges (scenario,
    u, v, length), for all scenarios of edges and all groups of sources in one relaxation.

    sources: scenario, group, node, hub. Edges of length 0 or with u = v aren't routable; of parallel edges the shortest
    counts; ties go to the smaller hub and then the smaller previous node. Nodes are settled within a bound on the
    distance that is doubled from phase to phase: a phase reads only arcs no longer than its bound, and its rounds relax
    only from what improved and write only that; they are merged every `merge` rounds. What lies within the bound is final,
    so arcs to nodes that are settled for all groups are left out of later phases. The first bound, a low percentile of the
    lengths, decides how many phases there are and never a result."""
    labels, key, groups = [*scenario], [*scenario, *group, "node"], [*group]
    usable = written(edges.where((F.col("u") != F.col("v")) & (F.col("length") > 0)).select(*labels, "u", "v", F.col("length").cast("double").alias("length")))
    rest = usable.unionByName(usable.select(*labels, F.col("v").alias("u"), F.col("u").alias("v"), "length"))
    start = sources.groupBy(*key).agg(F.min("hub").alias("hub"))
    first = F.struct(F.lit(0.0).alias("distance"), F.col("hub"), F.lit(None).cast(edges.schema["u"].dataType).alias("previous"))
    known = written(start.select(*key, first.alias("at")))
    every = known.groupBy(*labels).agg(F.count_distinct(F.struct(*groups, F.lit(0))).alias("every"))
    bound = usable.agg(F.percentile_approx("length", FIRST_BOUND, 1000)).first()[0]
    while bound is not None:
        arcs = written(rest.where(F.col("length") <= bound).groupBy(*labels, F.col("u").alias("node"), "v").agg(F.min("length").alias("length")))
        front = known
        for n in itertools.count(1):
            step = F.struct((F.col("at.distance") + F.col("length")).alias("distance"), F.col("at.hub").alias("hub"), F.col("node").alias("previous"))
            reached = front.join(arcs, [*labels, "node"]).where(F.col("at.distance") + F.col("length") <= bound).select(*labels, *groups, F.col("v").alias("node"), step.alias("new"))
            reached = reached.groupBy(*key).agg(F.min("new").alias("new"))
            held = reached.join(known, key, "left").groupBy(*key).agg(F.first("new").alias("new"), F.min("at").alias("at"))
            front = written(held.where("at is null or new < at").select(*key, F.col("new").alias("at")))
            if front.isEmpty():
                break
            known = known.unionByName(front)
            if n % merge == 0:
                known = written(known.groupBy(*key).agg(F.min("at").alias("at")))
        known = written(known.groupBy(*key).agg(F.min("at").alias("at")))
        settled = known.groupBy(*labels, F.col("node").alias("v")).agg(F.count("*").alias("n"))
        settled = (settled.join(every, labels) if labels else settled.crossJoin(every)).where("n = every").select(*labels, "v")
        rest = written(rest.join(settled, [*labels, "v"], "left_anti"))
        ahead = rest.withColumnRenamed("u", "node").join(known, [*labels, "node"]).select(*labels, *groups, F.col("v").alias("node"), (F.col("at.distance") + F.col("length")).alias("distance"))
        nearest = ahead.join(known.select(*key), key, "left_anti").agg(F.min("distance")).first()[0]
        bound = nearest if nearest is None or isnan(nearest) else max(GROWTH * bound, nearest)  # for Spark, NaN is the largest
    return known.select(*key, "at.distance", "at.hub", "at.previous")


def doubled(steps: DataFrame) -> list[DataFrame]:
    """Tables (id, to) of where 1, 2, 4, ... steps lead, up to the longest path. steps: id, to, one row per id. A cycle,
    which has no longest path, is an error."""
    tables = [written(steps.select("id", "to"))]
    n = tables[0].count()
    while True:
        a, b = tables[-1].select("id", F.col("to").alias("mid")), tables[-1].select(F.col("id").alias("mid"), "to")
        further = written(a.join(b, "mid").select("id", "to"))
        if further.isEmpty():
            return tables
        if 1 << len(tables) > n:
            raise ValueError("the steps have a cycle")
        tables.append(further)


def walked(starts: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """start, step, id of all places on the paths from starts (start, id), by doubled(): one round for each power of
    two, from the largest on, and each place is found once, as each number is one sum of such powers."""
    out = written(starts.select("start", F.lit(0).alias("step"), "id"))
    for k in reversed(range(len(tables))):
        out = written(out.unionByName(out.join(tables[k], "id").select("start", (F.col("step") + (1 << k)).alias("step"), F.col("to").alias("id"))))
    return out


def path_totals(steps: DataFrame, values: DataFrame) -> DataFrame:
    """id, places, total, last of the path from each id of values (id, value): how many places it has, the sum of their
    values, and its last place. No path is written out: each round doubles the stretch that is summed up."""
    at = values.join(steps.select("id", "to"), "id", "left").select("id", "to", F.lit(1).cast("long").alias("places"), F.col("value").alias("total"), F.col("id").alias("last"))
    at, n, rounds = written(at), values.count(), 0
    while not at.where("to is not null").isEmpty():
        if 1 << rounds > 2 * n:
            raise ValueError("the steps have a cycle")
        ahead = at.select(F.col("id").alias("to"), F.col("to").alias("after"), F.col("places").alias("p"), F.col("total").alias("t"), F.col("last").alias("l"), F.lit(True).alias("met"))
        sums = ((F.col("places") + F.coalesce("p", F.lit(0))).alias("places"), (F.col("total") + F.coalesce("t", F.lit(0))).alias("total"))
        at, rounds = written(at.join(ahead, "to", "left").select("id", F.col("after").alias("to"), *sums, F.coalesce("l", "last").alias("last"))), rounds + 1
    return at.drop("to")


def routes(paths: DataFrame, starts: DataFrame, label: Sequence[str] = ()) -> DataFrame:
    """label, start, step, u, v: the pieces of the way from each start (label, node) back to its hub, in order.

    paths: shortest_paths(). A start that no hub reaches, or that is one, has no piece."""
    state = lambda node: F.struct(*label, F.col(node).alias("node"))
    steps = paths.where("previous is not null").select(state("node").alias("id"), state("previous").alias("to"))
    tables = doubled(steps)
    first = starts.select(state("node").alias("start"), state("node").alias("id"))
    places = walked(first, tables).alias("p").join(tables[0].alias("s"), F.col("p.id") == F.col("s.id"))
    return places.select(*[F.col(f"p.start.{c}").alias(c) for c in label], F.col("p.start.node").alias("start"), F.col("p.step").alias("step"), F.col("s.id.node").alias("u"), F.col("s.to.node").alias("v"))


def connectivity(node: Column, baseline: Column, optimistic: Column, pessimistic: Column, ratio: float = 1.5) -> Column:
    """Status of a place from its distances before (baseline) and under two closures; NULL distance: unreachable."""
    return (
        F.when(node.isNull() | baseline.isNull(), "INSUFFICIENT_DATA").when(optimistic.isNull(), "CUT_OFF").when(pessimistic.isNull(), "UNKNOWN")
        .when((baseline > 0) & (F.try_divide(optimistic, baseline) >= ratio), "DISRUPTED").otherwise("CONNECTED")
    )
