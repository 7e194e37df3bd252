"""Topology, box and text lenses. Nations are reaches: id = n_nationkey + 1, next_down = max(0, n_nationkey -
n_regionkey mod 2), upland = summed supplier balances. Parts are boxes at 10 * (key mod 40), 10 * (key div 40), p_size
wide and half as high. Texts are documents, pages and event names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions import text as T
from tidemark.functions.raster import quantised
from tidemark.operators import exposure, rivers
from tidemark.plans.common import Lens, table
from tidemark.sources import layers

lens = Lens()
_Q = lambda x, s="1e4": f"CAST(floor(({x}) * {s} + 0.5) AS BIGINT)"

_R = """WITH RECURSIVE u AS (SELECT s_nationkey AS k, sum(s_acctbal) AS upland FROM supplier GROUP BY 1),
n AS (SELECT CAST(n_nationkey AS BIGINT) + 1 AS id, CAST(greatest(0, n_nationkey - n_regionkey % 2) AS BIGINT) AS next_down, floor(coalesce(upland, 0) / 20000) AS upland, CAST(n_nationkey * 7 % 4 AS INTEGER) AS ord_stra FROM nation LEFT JOIN u ON k = n_nationkey),
d AS (SELECT id AS start, 0 AS step, id FROM n UNION ALL SELECT d.start, d.step + 1, n.next_down FROM d JOIN n ON d.id = n.id JOIN n m ON m.id = n.next_down WHERE n.next_down <> 0),
b AS (SELECT next_down AS id, min_by(id, (-upland, -ord_stra, id)) AS up FROM n WHERE next_down <> 0 GROUP BY 1),
m AS (SELECT id AS start, 0 AS step, id FROM n UNION ALL SELECT m.start, m.step + 1, b.up FROM m JOIN b ON m.id = b.id)"""


def reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    upland = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("upland"))
    n = table(spark, sf_dir, "nation").join(upland, "n_nationkey", "left")
    return n.select((F.col("n_nationkey") + 1).cast("bigint").alias("id"), F.greatest(F.lit(0), F.col("n_nationkey") - F.col("n_regionkey") % 2).cast("bigint").alias("next_down"), F.floor(F.coalesce("upland", F.lit(0.0)) / 20000).cast("double").alias("upland"), (F.col("n_nationkey") * 7 % 4).cast("int").alias("ord_stra"))


@lens(f"{_R} SELECT start, step, id FROM d")
def t_downstream_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rivers.downstream(reaches(spark, sf_dir))


@lens(f"{_R} SELECT start, count(*) AS reaches, CAST(sum(upland) AS BIGINT) AS total, arg_max(d.id, step) AS last FROM d JOIN n ON n.id = d.id GROUP BY start")
def t_downstream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rivers.downstream_totals(reaches(spark, sf_dir)).select("start", "reaches", F.col("total").cast("bigint").alias("total"), "last")


@lens(f"{_R} SELECT start, id AS last, step AS steps, 'no_downstream_connection' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY step DESC) AS rn FROM d) WHERE rn = 1")
def t_stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reaches(spark, sf_dir)
    return rivers.stop_reasons(rivers.downstream(r), r)


@lens(f"{_R} SELECT start, step, id FROM m")
def t_upstream_mainstem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rivers.main_stem(reaches(spark, sf_dir))


@lens(f"{_R} SELECT start, count(*) AS reaches, {_Q('sum(upland)', '100')} AS total, {_Q('min_by(upland, step)', '100')} AS first, {_Q('max_by(upland, step)', '100')} AS last FROM m JOIN n ON m.id = n.id GROUP BY start")
def t_path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reaches(spark, sf_dir)
    out = rivers.path_summary(rivers.main_stem(r), r)
    return out.select("start", "reaches", *[quantised(F.col(c), 100).alias(c) for c in ("total", "first", "last")])


@lens(f"{_R} SELECT next_down AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS children FROM n WHERE next_down <> 0 GROUP BY 1")
def t_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rivers.children(reaches(spark, sf_dir)).select("id", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


_B = "WITH b AS (SELECT p_partkey AS id, (p_partkey % 40) * 10.0::DOUBLE AS x0, (p_partkey // 40) * 10.0::DOUBLE AS y0, (p_partkey % 40) * 10.0::DOUBLE + p_size AS x1, (p_partkey // 40) * 10.0::DOUBLE + p_size / 2.0::DOUBLE AS y1, p_size FROM part)"
AOI = (105.0, 103.0, 123.0, 108.0)
TRIANGLE = [(20.0, 15.0), (310.0, 95.0), (140.0, 405.0)]


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    x, y = (k % 40) * 10.0, F.floor(k / 40) * 10.0
    return table(spark, sf_dir, "part").select(k.alias("id"), x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size / 2.0).alias("y1"), "p_size")


@lens(f"{_B}, f AS (SELECT id, least(1, greatest(0, least(x1, 123) - greatest(x0, 105)) * greatest(0, least(y1, 108) - greatest(y0, 103)) / 90) AS f FROM b) SELECT id, {_Q('f', '1e6')} AS fraction, CASE WHEN f >= 1 - 1e-9 THEN 'FULL' WHEN f > 0 THEN 'PARTIAL' ELSE 'NONE' END AS status FROM f")
def b_coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = geo.coverage(tuple(map(F.col, ("x0", "y0", "x1", "y1"))), AOI)
    return boxes(spark, sf_dir).select("id", quantised(f, 1e6).alias("fraction"), geo.coverage_status(f).alias("status"))


def _ring_sql(x: str, y: str) -> str:
    out = "false"
    for (ax, ay), (bx, by) in zip(TRIANGLE, [*TRIANGLE[1:], TRIANGLE[0]], strict=True):
        out = f"({out} <> (({ay} > {y}) <> ({by} > {y}) AND {x} < ({bx - ax}) * ({y} - {ay}) / ({by - ay}) + {ax}))"
    return out


@lens(f"{_B} SELECT id, {_ring_sql('x0', 'y0')} AS inside FROM b")
def b_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("id", geo.in_ring(F.col("x0"), F.col("y0"), TRIANGLE).alias("inside"))


@lens(f"{_B} SELECT id FROM b WHERE x1 >= 105 AND x0 <= 123 AND y1 >= 103 AND y0 <= 108")
def b_extent_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).where((F.col("x1") >= AOI[0]) & (F.col("x0") <= AOI[2]) & (F.col("y1") >= AOI[1]) & (F.col("y0") <= AOI[3])).select("id")


@lens(f"{_B} SELECT id, CAST(32600 + greatest(1, least(60, CAST(floor((x0 * 0.9 - 180 + 180) / 6) AS INTEGER) + 1)) + CASE WHEN y0 / 4 - 60 < 0 THEN 100 ELSE 0 END AS INTEGER) AS epsg, {_Q('floor(x0 / 30) * 30')} AS lo, {_Q('ceil(x1 / 30) * 30')} AS hi FROM b")
def b_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = geo.snapped(F.col("x0"), F.col("x1"), 30.0)
    return boxes(spark, sf_dir).select("id", geo.utm_epsg(F.col("x0") * 0.9 - 180, F.col("y0") / 4 - 60).cast("int").alias("epsg"), quantised(lo).alias("lo"), quantised(hi).alias("hi"))


_C = "c AS (SELECT vec_id AS row, unnest(range(64)) AS col, CASE WHEN unnest(embedding) > 0.1 THEN 2 WHEN unnest(embedding) > 0 THEN 1 ELSE 0 END AS class FROM embeddings)"


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v"))
    v = F.col("v").cast("float")
    return e.select("row", F.col("col").cast("bigint").alias("col"), F.when(v > F.lit(0.1).cast("float"), 2).when(v > 0, 1).otherwise(0).alias("class"))


@lens(f"{_B}, {_C}, t AS (SELECT id, unnest(range(CAST(floor(x0 / 10) AS BIGINT), CAST(floor(x1 / 10) AS BIGINT) + 1)) AS col, y0, y1 FROM b), u AS (SELECT id, col, unnest(range(CAST(floor(y0 / 10) AS BIGINT), CAST(floor(y1 / 10) AS BIGINT) + 1)) AS row FROM t) SELECT id, class, count(*) AS pixels FROM u JOIN c ON c.row = u.row AND c.col = u.col GROUP BY ALL")
def b_raster_rect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.measure_boxes(boxes(spark, sf_dir), classes(spark, sf_dir), "id", 10.0)


@lens(f"{_B}, {_C}, k AS (SELECT *, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) AS len FROM b), n AS (SELECT *, greatest(1, CAST(ceil(len / 5) AS BIGINT)) AS n FROM k WHERE len > 0), s AS (SELECT *, unnest(range(n)) AS i FROM n), p AS (SELECT id, len / n AS share, CAST(floor((x0 + (i + 0.5::DOUBLE) / n * (x1 - x0)) / 10) AS BIGINT) AS col, CAST(floor((y0 + (i + 0.5::DOUBLE) / n * (y1 - y0)) / 10) AS BIGINT) AS row FROM s) SELECT id, coalesce(class, -1) AS class, {_Q('sum(share)')} AS metres FROM p LEFT JOIN c ON c.row = p.row AND c.col = p.col GROUP BY ALL")
def b_line_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.measure_lines(boxes(spark, sf_dir), classes(spark, sf_dir), "id", 10.0, 5.0).select("id", "class", quantised(F.col("metres")).alias("metres"))


@lens(f"{_B}, {_C} SELECT id, coalesce(class, -1) AS class FROM b LEFT JOIN c ON c.row = CAST(floor(y0 / 10) AS BIGINT) AND c.col = CAST(floor(x0 / 10) AS BIGINT)")
def b_point_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.sample_points(boxes(spark, sf_dir).select("id", F.col("x0").alias("x"), F.col("y0").alias("y")), classes(spark, sf_dir), 10.0).select("id", "class")


_T = f"""{_B}, {_C}, t AS (SELECT id, x0 + 0.37 AS ax, y0 + 0.41 AS ay, x1 + 0.37 AS bx, y0 + 0.41 + p_size / 6.0 AS b1, x0 + 0.37 + p_size / 4.0 AS cx, y1 + 0.41 AS cy FROM b),
h AS (SELECT *, unnest(range(CAST(floor(ax / 5) AS BIGINT) - 1, CAST(floor(bx / 5) AS BIGINT) + 2)) AS col FROM t), k AS (SELECT *, unnest(range(CAST(floor(ay / 5) AS BIGINT) - 1, CAST(floor(cy / 5) AS BIGINT) + 2)) AS row FROM h)"""
_SIDES = (("ax", "ay", "bx", "b1"), ("bx", "b1", "cx", "cy"), ("cx", "cy", "ax", "ay"))
_CROSSED = [f"(({b} > (row + 0.5) * 5) <> ({d} > (row + 0.5) * 5) AND (col + 0.5) * 5 < ({c} - {a}) * ((row + 0.5) * 5 - {b}) / ({d} - {b}) + {a})" for a, b, c, d in _SIDES]
_CENTRE = "(({} <> {}) <> {})".format(*_CROSSED)
_TOUCH = " AND ".join(f"greatest(({c} - {a}) * (row * 5 - {b}), ({c} - {a}) * (row * 5 + 5 - {b})) + greatest(({b} - {d}) * (col * 5 - {a}), ({b} - {d}) * (col * 5 + 5 - {a})) >= 0" for a, b, c, d in _SIDES)


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and points: three corners within each box, off the grid lines."""
    x, y, size = F.col("x0") + 0.37, F.col("y0") + 0.41, F.col("p_size")
    corners = ((x, y), (F.col("x1") + 0.37, y + size / 6.0), (x + size / 4.0, F.col("y1") + 0.41))
    return boxes(spark, sf_dir).select("id", F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners]).alias("points"))


@lens(f"{_T} SELECT id, class, count(*) AS pixels FROM k JOIN c USING (row, col) WHERE {_CENTRE} GROUP BY ALL")
def b_polygon_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.measure_rings(triangles(spark, sf_dir), classes(spark, sf_dir), "id", 5.0, all_touched=False)


@lens(f"{_T} SELECT id, class, count(*) AS pixels FROM k JOIN c USING (row, col) WHERE bx >= col * 5 AND ax <= col * 5 + 5 AND cy >= row * 5 AND ay <= row * 5 + 5 AND {_TOUCH} GROUP BY ALL")
def b_polygon_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.measure_rings(triangles(spark, sf_dir), classes(spark, sf_dir), "id", 5.0)


@lens(f"""WITH v AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y FROM embeddings), m AS (SELECT p.id, min((sqrt(power(t.x - p.x, 2) + power(t.y - p.y, 2)), t.id)) AS b FROM v p JOIN v t ON p.id % 2 = 0 AND t.id % 2 = 1 AND sqrt(power(t.x - p.x, 2) + power(t.y - p.y, 2)) <= 20 GROUP BY p.id)
SELECT v.id, b[2] AS target_id, {_Q('b[1]', '1e3')} AS distance FROM v LEFT JOIN m ON v.id = m.id WHERE v.id % 2 = 0""")
def b_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 1000).alias("x"), (F.col("embedding")[1].cast("double") * 1000).alias("y"))
    return geo.nearest_within(v.where("id % 2 = 0"), v.where("id % 2 = 1"), 20.0).select("id", "target_id", quantised(F.col("distance"), 1e3).alias("distance"))


@lens()
def x_claim_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against brute force in the tests."""
    terms = {"worthless": "low value", "pathetic": "weak", "idiot": "person", "clown": "person"}
    found = T.screen_claims(F.coalesce("text", F.lit("")), terms, ("the idiot", "a clown"), ("not", "with", "und", "les", "por"), 12)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.position", "f.term", "f.instead")


@lens("WITH e AS (SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'S1' || 'A_' WHEN 1 THEN 'S2B_' WHEN 2 THEN 'S1E_' WHEN 3 THEN 'xS1A_' WHEN 4 THEN 'S2A' ELSE 'S2D_' END || event_id AS name FROM events) SELECT event_id, CASE WHEN regexp_matches(name, '^(S1[A-D]|S2[A-D])_') THEN substr(name, 1, 3) END AS unit FROM e")
def x_platform_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("S1A_", "S2B_", "S1E_", "xS1A_", "S2A", "S2D_"))), (F.col("user_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.platform_unit(F.concat(kind, F.col("event_id").cast("string"))).alias("unit"))


@lens("""WITH e AS (SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'vv&VH' WHEN 1 THEN ' VV ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'VH&vh& vv' END AS pol, CASE event_id % 4 WHEN 0 THEN ' s2msi2a' WHEN 1 THEN 'Level-1C' WHEN 2 THEN 'L2A' ELSE 'other' END AS lev FROM events)
SELECT event_id, CASE WHEN pol IS NULL OR trim(pol) = '' THEN 'unverifiable' WHEN list_has_all(list_transform(string_split(pol, '&'), lambda x: upper(trim(x))), ['VV', 'VH']) THEN 'match' ELSE 'mismatch' END AS verdict, CASE WHEN upper(trim(lev)) IN ('L2A', 'S2MSI2A', 'LEVEL-2A', 'LEVEL2A') THEN 'L2A' WHEN upper(trim(lev)) IN ('L1C', 'S2MSI1C', 'LEVEL-1C', 'LEVEL1C') THEN 'L1C' ELSE 'UNKNOWN' END AS level FROM e""")
def x_polarisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pol = F.element_at(F.array(*[F.lit(x) for x in ("vv&VH", " VV ", "", None, "VH&vh& vv")]), (F.col("user_id") % 5 + 1).cast("int"))
    level = F.element_at(F.array(*map(F.lit, (" s2msi2a", "Level-1C", "L2A", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", T.polarisation_verdict(pol, ["VV", "VH"]).alias("verdict"), T.processing_level(level).alias("level"))


@lens("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE WHEN regexp_matches(url, '[?&]page=([0-9]+)') THEN CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS INTEGER) END AS page FROM pages")
def x_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.nullif(F.regexp_extract("url", "[?&]page=([0-9]+)", 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), page.cast("int").alias("page"))


_H = """WITH h AS (SELECT event_id, coalesce(event_type, '') AS kind, user_id, 'way/' || event_id // 3 AS osm_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') || 'T00:00:00Z' ELSE '2024-02-01T00:00:00Z' END AS ends,
CASE event_id % 4 WHEN 1 THEN 'N"' || user_id WHEN 3 THEN '' END AS en, 'n' || user_id AS nm, coalesce(props, '') AS surface FROM events),
f AS (SELECT *, CAST(event_id % 5 AS VARCHAR) AS osm_version, CASE WHEN en <> '' THEN en ELSE nm END AS name, '{"highway": ' || to_json(kind) || ', "name": ' || to_json(nm) || coalesce(', "name:en": ' || to_json(en), '') || ', "surface": ' || to_json(surface) || '}' AS tags FROM h WHERE ends = '2024-02-01T00:00:00Z'),
a AS (SELECT 0 AS no, * FROM f WHERE user_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY kind, event_id) = 1), b AS (SELECT 1 AS no, * FROM f QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY kind, event_id) = 1),
roads AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY no) = 1),
hubs AS (SELECT 'a' AS hub_group, * FROM f WHERE kind = 'signup' QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY kind, event_id) = 1 UNION ALL SELECT 'b', * FROM f WHERE kind IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY kind, event_id) = 1)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of features: three in a row are one feature, half of them replaced before the snapshot."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    ends = F.when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T00:00:00Z'")).otherwise(F.lit("2024-02-01T00:00:00Z"))
    english = F.when(k % 4 == 1, F.concat(F.lit('N"'), F.col("user_id").cast("string"))).when(k % 4 == 3, "")
    tags = {"@osmId": F.concat(F.lit("way/"), F.floor(k / 3).cast("string")), "@validTo": ends, "@version": (k % 5).cast("string"), "highway": F.coalesce("event_type", F.lit("")), "name": F.concat(F.lit("n"), F.col("user_id").cast("string")), "name:en": english, "surface": F.coalesce("props", F.lit(""))}
    kept = F.map_filter(F.create_map(*[x for n, v in tags.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    return e.select(F.coalesce("event_type", F.lit("")).alias("path"), k.alias("at"), "user_id", kept.alias("properties"), F.lit("Point").alias("kind"), F.format_string("[%d, 0]", k).alias("coordinates"))


def _layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    h = history(spark, sf_dir)
    kinds = {"a": ["signup"], "b": ["signup", "error"]}
    return layers.pre_event_layers({"roads_aoi": h.where("user_id % 3 = 0"), "roads_buffer": h}, {g: h.where(F.col("path").isin(k)) for g, k in kinds.items()}, "2024-02-01T00:00:00Z")


@lens(f"{_H} SELECT osm_id, name, osm_version, kind AS highway, tags, '[' || event_id || ', 0]' AS coordinates FROM roads")
def l_united_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads of an area and of its surroundings, valid at the snapshot: the area's row of a road comes first."""
    return _layers(spark, sf_dir)["roads"].select("osm_id", "name", "osm_version", "highway", "tags", "coordinates")


@lens(f"{_H} SELECT 'roads' AS layer, count(*) AS features, 'Point' AS kinds FROM roads UNION ALL SELECT 'hubs', count(*), 'Point' FROM hubs")
def l_layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer_report(_layers(spark, sf_dir)).select("layer", "features", F.array_join("kinds", ",").alias("kinds"))
