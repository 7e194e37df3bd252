"""Network lens: a line item is a road piece of way l_partkey. length = quantity, candidate metres = 10 * discount *
quantity, unobserved metres = 5 * tax * quantity, wholly outside the grid where l_partkey is a multiple of 17;
highway = p_type; customers and suppliers are nodes and their order lines edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.raster import quantised
from tidemark.operators import exposure, graph
from tidemark.plans.common import Lens, table

lens = Lens()
_STATUSES = ["EXPOSED", "UNKNOWN", "NOT_EXPOSED", "NOT_OBSERVED"]


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("way"), F.col("l_quantity").alias("length"),
        F.round(F.abs("l_discount") * 100).alias("d"), F.round(F.col("l_tax") * 100).alias("t"),
    )
    flooded, unknown = F.col("length") * F.col("d") / 10, F.col("length") * F.col("t") / 20
    return p.select("orderkey", "suppkey", "way", "length", flooded.alias("flooded"), unknown.alias("unknown"), F.when(F.col("way") % 17 == 0, F.col("length")).otherwise(0.0).alias("outside"))


def _status() -> F.Column:
    return exposure.line_status(F.col("length"), F.col("flooded"), F.col("unknown"), F.col("outside"))


_P = """WITH p AS (SELECT l_orderkey AS orderkey, l_suppkey AS suppkey, l_partkey AS way, l_quantity AS length, l_quantity * round(abs(l_discount) * 100) / 10 AS flooded,
l_quantity * round(l_tax * 100) / 20 AS unknown, CASE WHEN l_partkey % 17 = 0 THEN l_quantity ELSE 0 END AS outside FROM lineitem),
s AS (SELECT *, CASE WHEN outside >= length - 1e-6 THEN 'NOT_OBSERVED' WHEN flooded >= least(10, length) - 1e-6 THEN 'EXPOSED' WHEN unknown >= least(10, length) - 1e-6 THEN 'UNKNOWN' ELSE 'NOT_EXPOSED' END AS status FROM p)"""
_Q = lambda x, s="1e4": f"CAST(floor(({x}) * {s} + 0.5) AS BIGINT)"


@lens(f"{_P} SELECT orderkey, suppkey, way, {_Q('length')} AS length, status FROM s")
def n_line_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir).select("orderkey", "suppkey", "way", quantised(F.col("length")).alias("length"), _status().alias("status"))


@lens("""WITH b AS (SELECT p_partkey, p_size % 5 AS px, CASE WHEN p_partkey % 3 = 0 THEN p_size % 4 ELSE 0 END AS fl, p_size % 2 AS un FROM part)
SELECT p_partkey, CASE WHEN px = 0 THEN 'NOT_OBSERVED' WHEN fl >= 1 THEN 'EXPOSED' WHEN un >= 1 THEN 'UNKNOWN' ELSE 'NOT_EXPOSED' END AS status FROM b""")
def n_polygon_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", exposure.polygon_status(size % 5, F.when(key % 3 == 0, size % 4).otherwise(0), size % 2).alias("status"))


@lens(f"{_P} SELECT p_type AS highway, st.status, count(s.way) AS n, {_Q('coalesce(sum(s.length), 0)')} AS length FROM (SELECT p_type, status FROM (SELECT DISTINCT p_type FROM part JOIN s ON way = p_partkey), (VALUES ('EXPOSED'), ('UNKNOWN'), ('NOT_EXPOSED'), ('NOT_OBSERVED')) v(status)) st LEFT JOIN (SELECT s.*, p_type AS h FROM s JOIN part ON way = p_partkey) s ON s.h = st.p_type AND s.status = st.status GROUP BY ALL UNION ALL SELECT p_type, 'ALL', count(*), {_Q('sum(length)')} FROM s JOIN part ON way = p_partkey GROUP BY p_type")
def n_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces(spark, sf_dir).withColumn("status", _status()).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("way"), F.col("p_type").alias("highway")), "way")
    return exposure.by_status_and_total(rows, "highway", "status", "length", _STATUSES).select("highway", "status", "n", quantised(F.col("length")).alias("length"))


@lens(f"""{_P}, r AS (SELECT way, length, flooded AS candidate, unknown AS unobserved, CASE WHEN outside > 0 THEN 3 WHEN flooded >= 10 THEN 0 WHEN unknown >= 10 THEN 1 ELSE 2 END AS k FROM p)
SELECT way, {_Q('sum(length)')} AS length, {_Q('sum(candidate)')} AS candidate, {_Q('sum(unobserved)')} AS unobserved, CASE min(k) WHEN 0 THEN 'CANDIDATE_EXPOSED' WHEN 1 THEN 'NOT_OBSERVED' WHEN 2 THEN 'NOT_CANDIDATE' ELSE 'OUTSIDE_GRID' END AS status, count(*) AS parts FROM r GROUP BY way""")
def n_road_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("outside") > 0, "OUTSIDE_GRID").when(F.col("flooded") >= 10, "CANDIDATE_EXPOSED").when(F.col("unknown") >= 10, "NOT_OBSERVED").otherwise("NOT_CANDIDATE")
    rows = pieces(spark, sf_dir).select("way", "length", F.col("flooded").alias("candidate"), F.col("unknown").alias("unobserved"), k.alias("status"))
    return exposure.road_quantities(rows, "way").select("way", *[quantised(F.col(c)).alias(c) for c in ("length", "candidate", "unobserved")], "status", "parts")


_CLOSED = "length > 0 AND flooded >= least(5, length) - 1e-6"
_WORSE = "length > 0 AND (flooded >= least(5, length) - 1e-6 OR unknown >= least(5, length) - 1e-6)"


@lens(f"{_P} SELECT orderkey, suppkey, way, CASE WHEN {_CLOSED} THEN 'CLOSED_CANDIDATE' WHEN {_WORSE} THEN 'CLOSED_ONLY_IF_UNOBSERVED' ELSE 'OPEN' END AS label, {_Q('greatest(0, length - flooded - unknown - outside)')} AS not_candidate FROM p")
def n_closure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("length"), F.col("flooded"), F.col("unknown"))
    label = exposure.closure_label(exposure.removed(*a, 5.0, False), exposure.removed(*a, 5.0, True))
    return pieces(spark, sf_dir).select("orderkey", "suppkey", "way", label.alias("label"), quantised(exposure.not_candidate(*a, F.col("outside"))).alias("not_candidate"))


@lens(f"{_P} SELECT orderkey, way FROM p WHERE {_CLOSED}")
def n_removed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir).where(exposure.removed(F.col("length"), F.col("flooded"), F.col("unknown"), 5.0, False)).select("orderkey", "way")


@lens(f"""{_P}, t AS (SELECT unnest([10.0, 30.0, 100.0])::DOUBLE AS threshold), k AS (SELECT *, length > 0 AND flooded >= least(threshold, length) - 1e-6 AS c, length > 0 AND (flooded >= least(threshold, length) - 1e-6 OR unknown >= least(threshold, length) - 1e-6) AS w FROM p, t)
SELECT threshold, count(*) FILTER (c) AS closed, {_Q('coalesce(sum(length) FILTER (c), 0)')} AS closed_length, count(*) FILTER (w) AS pessimistic, {_Q('coalesce(sum(length) FILTER (w), 0)')} AS pessimistic_length FROM k GROUP BY threshold""")
def n_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exposure.sensitivity(pieces(spark, sf_dir), [10.0, 30.0, 100.0])
    return out.select("threshold", "closed", quantised(F.col("closed_length")).alias("closed_length"), "pessimistic", quantised(F.col("pessimistic_length")).alias("pessimistic_length"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u = customer, v = supplier + 2^40, with the piece's measures."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("u"))
    return pieces(spark, sf_dir).join(o, "orderkey").withColumn("v", F.col("suppkey") + F.lit(1 << 40))


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where(~exposure.removed(F.col("length"), F.col("flooded"), F.col("unknown"), 1.0, True))


@lens(f"""{_P.replace('WITH', 'WITH RECURSIVE', 1)}, e AS (SELECT o_custkey AS a, suppkey + 1099511627776 AS b FROM p JOIN orders ON orderkey = o_orderkey WHERE NOT (length > 0 AND (flooded >= least(1, length) - 1e-6 OR unknown >= least(1, length) - 1e-6))),
w AS (SELECT DISTINCT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS reach FROM w UNION SELECT w.b, r.reach FROM r JOIN w ON r.node = w.a)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM (SELECT node, min(reach) AS component FROM r GROUP BY node)""")
def n_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = graph.components(_open(spark, sf_dir).select(F.col("u").alias("a"), F.col("v").alias("b")))
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    return labels.join(sizes, "component").select("node", "component", "size")


@lens(f"""{_P.replace('WITH', 'WITH RECURSIVE', 1)}, g AS (SELECT o_custkey AS u, suppkey + 1099511627776 AS v, length FROM p JOIN orders ON orderkey = o_orderkey), o AS (SELECT * FROM g WHERE length <= 1), n AS (SELECT u AS node FROM g UNION SELECT v FROM g),
w AS (SELECT DISTINCT u AS a, v AS b FROM o UNION SELECT v, u FROM o), r AS (SELECT node, node AS reach FROM n UNION SELECT w.b, r.reach FROM r JOIN w ON r.node = w.a), c AS (SELECT node, min(reach) AS component FROM r GROUP BY node),
k AS (SELECT component, count(*) AS nodes FROM c GROUP BY 1), m AS (SELECT component, sum(length) AS metres FROM o JOIN c ON node = u GROUP BY 1)
SELECT component, nodes, CAST(round(coalesce(metres, 0)) AS BIGINT) AS road_m FROM k LEFT JOIN m USING (component)""")
def n_scenario_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes where only the shortest pieces are open: those left alone are components of one."""
    every = edges(spark, sf_dir)
    left = every.where("length <= 1")
    nodes = every.select(F.col("u").alias("node")).union(every.select("v"))
    out = graph.component_roads(graph.scenario_components(nodes, left), left)
    return out.select("component", "nodes", F.round(F.col("road_km") * 1000).cast("bigint").alias("road_m"))


@lens(f"""{_P}, h AS (SELECT coalesce(p_type, 'unrecorded') AS highway, length FROM p LEFT JOIN part ON way = p_partkey AND p_partkey % 4 <> 0 WHERE {_CLOSED})
SELECT highway, {_Q('sum(length) / 1000')} AS closed_km, count(*) AS pieces FROM h GROUP BY highway""")
def n_closed_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("way"), F.col("p_type").alias("highway"))
    closed = pieces(spark, sf_dir).where(exposure.removed(F.col("length"), F.col("flooded"), F.col("unknown"), 5.0, False))
    return closed.join(names, "way", "left").groupBy(F.coalesce("highway", F.lit("unrecorded")).alias("highway")).agg(quantised(F.sum("length") / 1000).alias("closed_km"), F.count("*").alias("pieces"))


def _hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select((F.col("s_suppkey") + F.lit(1 << 40)).alias("node"), F.col("s_suppkey").alias("hub"))


def _ways(scenarios: str) -> str:
    """SQL: least (distance, hub, previous) per scenario, group and node; hubs: h(grp, node, hub), open pieces: o(scenario, a, b, length)."""
    return f"""{_P.replace('WITH', 'WITH RECURSIVE', 1)}, e AS (SELECT o_custkey AS a, suppkey + 1099511627776 AS b, length, flooded, unknown FROM p JOIN orders ON orderkey = o_orderkey), o AS ({scenarios}),
w AS MATERIALIZED (SELECT scenario, a, b, min(length) AS length FROM (SELECT scenario, a, b, length FROM o UNION ALL SELECT scenario, b, a, length FROM o) WHERE length > 0 GROUP BY ALL),
h AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'tens' ELSE 'fives' END AS grp, s_suppkey + 1099511627776 AS node, s_suppkey AS hub FROM supplier WHERE s_suppkey % 5 = 0),
r(scenario, grp, node, best) USING KEY (scenario, grp, node) AS (SELECT s.scenario, grp, node, row(0.0::DOUBLE, hub, -1::BIGINT) FROM h, (SELECT DISTINCT scenario FROM o) s
  UNION SELECT * FROM (SELECT r.scenario, r.grp, w.b AS node, min(row(r.best[1] + w.length, r.best[2], r.node)) AS best FROM r JOIN w ON w.scenario = r.scenario AND w.a = r.node GROUP BY ALL) x
    WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.scenario = x.scenario AND k.grp = x.grp AND k.node = x.node AND k.best <= x.best))"""


_THREE = " UNION ALL ".join(f"SELECT '{n}' AS scenario, a, b, length FROM e{w}" for n, w in (("baseline", ""), ("optimistic", f" WHERE NOT ({_CLOSED})"), ("pessimistic", f" WHERE NOT ({_WORSE})")))


@lens(_ways("SELECT 'all' AS scenario, a, b, length FROM e") + " SELECT node, CAST(best[1] AS BIGINT) AS distance, best[2] AS hub, nullif(best[3], -1) AS previous FROM r WHERE grp = 'tens'")
def n_sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_paths(edges(spark, sf_dir).select("u", "v", "length"), _hubs(spark, sf_dir)).select("node", F.col("distance").cast("bigint").alias("distance"), "hub", "previous")


def scenario_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open pieces before closures, with candidate closures, and with unobserved pieces closed as well."""
    a = (F.col("length"), F.col("flooded"), F.col("unknown"))
    runs = {"baseline": F.lit(True), "optimistic": ~exposure.removed(*a, 5.0, False), "pessimistic": ~exposure.removed(*a, 5.0, True)}
    named = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in runs.items()]))
    return edges(spark, sf_dir).select(F.explode(named).alias("scenario"), "u", "v", "length")


def _access(spark: SparkSession, sf_dir: str, both: bool) -> DataFrame:
    """Distances of all nodes in the three scenarios from the hubs of one group or of two."""
    hubs = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select((F.col("s_suppkey") + F.lit(1 << 40)).alias("node"), F.col("s_suppkey").alias("hub"), F.when(F.col("s_suppkey") % 10 == 0, "tens").otherwise("fives").alias("grp"))
    hubs = hubs if both else hubs.where("grp = 'tens'")
    hubs = hubs.withColumn("scenario", F.explode(F.array(*map(F.lit, ("baseline", "optimistic", "pessimistic")))))
    return graph.shortest_paths(scenario_edges(spark, sf_dir), hubs, ["scenario"], ["grp"])


_SCENARIOS = ("baseline", "optimistic", "pessimistic")
_STATE = "CASE WHEN baseline IS NULL THEN 'INSUFFICIENT_DATA' WHEN optimistic IS NULL THEN 'CUT_OFF' WHEN pessimistic IS NULL THEN 'UNKNOWN' WHEN baseline > 0 AND optimistic / baseline >= 1.5 THEN 'DISRUPTED' ELSE 'CONNECTED' END"
_SPREAD = ", ".join(f"max(best[1]) FILTER (scenario = '{n}') AS {n}" for n in _SCENARIOS)


def _per_scenario(distances: DataFrame, keys: list[str]) -> DataFrame:
    return distances.groupBy(*keys).agg(*[F.max(F.when(F.col("scenario") == n, F.col("distance"))).alias(n) for n in _SCENARIOS])


@lens(_ways(_THREE) + f", d AS (SELECT node, {_SPREAD} FROM r WHERE grp = 'tens' GROUP BY node) SELECT c_custkey AS node, {_STATE} AS status, " + ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in _SCENARIOS) + " FROM customer LEFT JOIN d ON d.node = c_custkey")
def n_connectivity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer before closures, with candidate closures, and with unobserved pieces closed as well: one relaxation."""
    found = _per_scenario(_access(spark, sf_dir, False), ["node"])
    out = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")).join(found, "node", "left")
    return out.select("node", graph.connectivity(F.col("node"), *map(F.col, _SCENARIOS)).alias("status"), *[F.col(n).cast("bigint").alias(n) for n in _SCENARIOS])


@lens(_ways(_THREE) + f", d AS (SELECT grp, node, {_SPREAD} FROM r GROUP BY grp, node), g AS (SELECT DISTINCT grp FROM h), t AS (SELECT g.grp, c_custkey, {_STATE} AS status FROM customer CROSS JOIN g LEFT JOIN d ON d.grp = g.grp AND d.node = c_custkey) SELECT grp, status, count(*) AS customers FROM t GROUP BY ALL")
def n_group_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by status for each of two groups of hubs."""
    found = _per_scenario(_access(spark, sf_dir, True), ["grp", "node"])
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.explode(F.array(F.lit("tens"), F.lit("fives"))).alias("grp"))
    status = graph.connectivity(F.col("node"), *map(F.col, _SCENARIOS))
    return every.join(found, ["grp", "node"], "left").groupBy("grp", status.alias("status")).agg(F.count("*").alias("customers"))


@lens(_ways(_THREE) + """, q AS MATERIALIZED (SELECT scenario, node, best[3] AS previous FROM r WHERE grp = 'tens'), k AS (SELECT scenario, node AS start, 0 AS step, node, previous FROM q WHERE node < 1099511627776
  UNION ALL SELECT k.scenario, k.start, k.step + 1, q.node, q.previous FROM k JOIN q ON q.scenario = k.scenario AND q.node = k.previous)
SELECT scenario, start, step, node AS u, previous AS v FROM k WHERE previous >= 0""")
def n_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each customer's way to its hub in each scenario, in order."""
    paths = graph.written(_access(spark, sf_dir, False).drop("grp"))
    starts = paths.where(F.col("node") < F.lit(1 << 40)).select("scenario", "node")
    return graph.routes(paths, starts, ["scenario"])
