"""Vector files: GeoJSON in and out, with digests of the bytes read."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.temporal import parse_instant

_FEATURES = "type string, crs struct<properties: struct<name: string>>, features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"


def read_geojson(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """path, sha256, crs (as the file names it, or NULL), at (place in the file), properties, kind, coordinates (JSON) of
    each feature; one row per file and feature.

    With sha256 given, a file of other bytes is an error. A file is read whole by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))
    if sha256 is not None:
        ok = F.col("sha256") == sha256
        files = files.withColumn("text", F.when(ok, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("digest of "), F.col("path"), F.lit(" is "), F.col("sha256")))))
    parsed = files.withColumn("j", F.from_json("text", _FEATURES))
    rows = parsed.select("path", "sha256", F.col("j.crs.properties.name").alias("crs"), F.posexplode("j.features").alias("at", "f"))
    return rows.select("path", "sha256", "crs", "at", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def ring(coordinates: Column) -> Column:
    """The outer ring of a polygon's coordinates as an array of (x, y)."""
    return F.transform(F.from_json(coordinates, "array<array<array<double>>>")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def line(coordinates: Column) -> Column:
    return F.transform(F.from_json(coordinates, "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def length(points: Column) -> Column:
    """Length of a line through an array of (x, y)."""
    steps = F.sequence(F.lit(1), F.size(points) - 1)
    step = lambda i: F.hypot(F.get(points, i)["x"] - F.get(points, i - 1)["x"], F.get(points, i)["y"] - F.get(points, i - 1)["y"])
    return F.when(F.size(points) > 1, F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + step(i))).otherwise(0.0)


def tags_json(properties: Column) -> Column:
    """All tags but those beginning with @, as JSON with sorted keys and a space after commas and colons."""
    text = lambda x: F.coalesce(F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    entries = F.array_sort(F.map_entries(F.map_filter(properties, lambda k, _: ~k.startswith("@"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(text(e["key"]), F.lit(": "), text(e["value"]))), ", "), F.lit("}"))


def snapshot_features(rows: DataFrame, snapshot: str, promoted: tuple[str, ...] = ("highway", "bridge", "building", "place", "amenity"), order: tuple[str, ...] = ("path", "at")) -> DataFrame:
    """History rows valid to the snapshot exactly, the first per osm_id by order: name (English first, unless empty),
    osm_version, promoted tags, and all tags as JSON. Rows without a geometry or an end of validity drop out."""
    p = F.col("properties")
    ends = parse_instant(p["@validTo"], True) == parse_instant(F.lit(snapshot), True)
    named = F.coalesce(F.when(p["name:en"] != "", p["name:en"]), p["name"])
    row = F.struct(named.alias("name"), p["@version"].alias("osm_version"), *[p[t].alias(t) for t in promoted], tags_json(p).alias("tags"), "kind", "coordinates")
    kept = rows.where(ends & F.col("coordinates").isNotNull()).groupBy(p["@osmId"].alias("osm_id")).agg(F.min_by(row, F.struct(*order)).alias("r"))
    return kept.select("osm_id", "r.*")


def united(layers: Sequence[DataFrame], key: str) -> DataFrame:
    """The rows of all layers, one per key: that of the first layer that has it. A column that a layer lacks is NULL
    there; NULL keys are one key. Within a layer keys are expected to be distinct, else any of its rows stays."""
    if not layers:
        raise ValueError("no layers")
    numbered = [d.withColumn("layer_no", F.lit(i)) for i, d in enumerate(layers)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    rest = [c for c in every.columns if c not in (key, "layer_no")]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), "layer_no").alias("r")).select(key, "r.*")


def write_geojson(rows: DataFrame, path: str, kind: str, coordinates: str) -> None:
    """One feature per line (newline-delimited GeoJSON), in as many files as there are partitions; an existing path is an error."""
    properties = F.struct(*[F.col(c) for c in rows.columns if c != coordinates])
    head = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(f',"geometry":{{"type":"{kind}","coordinates":'), F.col(coordinates), F.lit("}}"))
    rows.select(head.alias("value")).write.mode("errorifexists").text(path)
