"""Sources and sinks on files made by the tests."""

import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.sources import catalogue, raster, vector
from tidemark.streaming import windows


def tiff(path, rows, cols, values, deflate=False, nodata=b"-9999\0"):
    """A one-band float32 GeoTIFF of one strip."""
    body = struct.pack(f"<{rows * cols}f", *values)
    body = zlib.compress(body) if deflate else body
    keys = struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, 32645)
    extra, at = b"", 8 + 2 + 12 * 14 + 4
    blobs = {}
    for name, blob in (("scale", struct.pack("<3d", 10, 10, 0)), ("tie", struct.pack("<6d", 0, 0, 0, 300000, 3100000, 0)), ("keys", keys), ("nodata", nodata), ("strip", body)):
        blobs[name] = at + len(extra)
        extra += blob
    entries = [(256, 4, 1, cols), (257, 4, 1, rows), (258, 3, 1, 32), (259, 3, 1, 8 if deflate else 1), (273, 4, 1, blobs["strip"]), (277, 3, 1, 1), (278, 4, 1, rows), (279, 4, 1, len(body)), (284, 3, 1, 1), (339, 3, 1, 3), (33550, 12, 3, blobs["scale"]), (33922, 12, 6, blobs["tie"]), (34735, 3, 8, blobs["keys"]), (42113, 2, len(nodata), blobs["nodata"])]
    head = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    path.write_bytes(head + extra)


@pytest.mark.parametrize("deflate", [False, True])
def test_raster_round_trip(spark, tmp_path, deflate):
    values = [1.0, -9999.0, float("nan"), 4.0, 5.0, float("inf")]
    tiff(tmp_path / "a.tif", 2, 3, values, deflate)
    m = raster.read_metadata(spark, str(tmp_path / "a.tif")).first()
    assert (m["width"], m["height"], m["epsg"], m["a"], m["e"], m["c"], m["f"], m["nodata"]) == (3, 2, 32645, 10, -10, 300000, 3100000, -9999)
    got = {(r["row"], r["col"]): r["value"] for r in raster.read_pixels(spark, str(tmp_path / "a.tif")).collect()}
    assert got == {(0, 0): 1.0, (0, 1): None, (0, 2): None, (1, 0): 4.0, (1, 1): 5.0, (1, 2): None}
    assert raster.same_grid(*[raster.read_metadata(spark, str(tmp_path / "a.tif"))] * 2)


def test_not_a_raster(spark, tmp_path):
    (tmp_path / "b.tif").write_bytes(b"nothing here")
    with pytest.raises(Exception, match="not a TIFF"):
        raster.read_metadata(spark, str(tmp_path / "b.tif")).collect()


def test_geojson(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"@osmId": "way/1", "@validTo": "2024-01-09", "name": "Nom", "name:en": "Name", "highway": "track", "surface": "mud"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}}
    path = tmp_path / "roads.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature | {"properties": feature["properties"] | {"@validTo": "2023-01-01"}}]}))
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    rows = vector.read_geojson(spark, str(path), digest)
    assert rows.count() == 2
    r = vector.snapshot_features(rows, "2024-01-09").withColumn("len", vector.length(vector.line(F.col("coordinates")))).collect()
    assert [(x["osm_id"], x["name"], x["highway"], x["tags"], x["len"]) for x in r] == [("way/1", "Name", "track", '{"highway": "track", "name": "Nom", "name:en": "Name", "surface": "mud"}', 5.0)]
    with pytest.raises(Exception, match="digest"):
        vector.read_geojson(spark, str(path), "0" * 64).collect()
    vector.write_geojson(rows.select("kind", "coordinates"), str(tmp_path / "out"), "LineString", "coordinates")
    assert spark.read.json(str(tmp_path / "out")).select("geometry.coordinates").first()[0] == [[0, 0], [3, 4]]


def test_paged_catalogue(spark, tmp_path):
    item = lambda i, cloud: {"Id": f"p{i}", "Name": f"S2A_{i}", "ContentDate": {"Start": f"2024-01-0{i}"}, "Attributes": [{"Name": "cloudCover", "Value": cloud}]}
    (tmp_path / "1.json").write_text(json.dumps({"value": [item(1, 5), item(2, 7)]}))
    (tmp_path / "2.json").write_text(json.dumps({"value": [item(3, 9)]}))
    scenes, truncated = catalogue.read_catalogue(spark, str(tmp_path), 2)
    assert [r["product_id"] for r in scenes.collect()] == ["p1", "p2"] and truncated
    (tmp_path / "3.json").write_text(json.dumps({"value": [item(3, 9)]}))
    with pytest.raises(ValueError, match="two pages"):
        catalogue.read_catalogue(spark, str(tmp_path))
    assert "Intersects" in catalogue.search_filter("S", ["GRD"], "a", "b", "POINT(0 0)", 20)


def test_splits_and_roles(spark, tmp_path):
    for name, ids in (("train", "ab"), ("test", "cb")):
        (tmp_path / f"{name}.csv").write_text("sample_id\n" + "\n".join(ids))
    with pytest.raises(ValueError, match="two splits"):
        catalogue.read_splits(spark, {n: str(tmp_path / f"{n}.csv") for n in ("train", "test")})
    rows = spark.createDataFrame([("g", "F1"), ("g", "T1"), ("h", "F1")], "g string, r string")
    assert dict(map(tuple, catalogue.complete_roles(rows, "g", "r", ["T1", "F1"]).collect())) == {"g": True, "h": False}
    both = catalogue.reconcile(rows.select("g"), spark.createDataFrame([("h",), ("x",)], "g string"), "g")
    assert dict(map(tuple, both.collect())) == {"g": "only_listed", "h": "both", "x": "only_found"}


def test_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("b", "s"), ("a", "s")], "sample_id string, split string")
    path = str(tmp_path / "m")
    catalogue.write_manifest(rows, path)
    with pytest.raises(Exception, match="(?i)exist"):
        catalogue.write_manifest(rows, path)
    assert catalogue.read_manifest(spark, path, "sample_id string, split string", "sample_id", hashlib.sha256(b"a\nb").hexdigest()).count() == 2
    with pytest.raises(ValueError, match="digest"):
        catalogue.read_manifest(spark, path, "sample_id string, split string", "sample_id", "0")


def test_artifact_checks_come_first(spark, tmp_path):
    data = spark.createDataFrame([(1, 1), (1, 0)], "candidate int, valid int")
    inside = F.count_if((F.col("candidate") == 1) & (F.col("valid") != 1)) == 0
    with pytest.raises(ValueError, match="candidate_in_valid"):
        catalogue.write_artifact(data, str(tmp_path / "x"), {"candidate_in_valid": inside}, {"n": F.count("*")})
    assert not (tmp_path / "x").exists()
    assert catalogue.write_artifact(data.where("valid = 1"), str(tmp_path / "y"), {"candidate_in_valid": inside}, {"n": F.count("*")}).first()["n"] == 1


def test_stream_equals_table(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    as_ts = lambda d: d.withColumn("ts", F.col("ts").cast("timestamp"))
    got = windows.drained(windows.window_counts(as_ts(stream), ["event_type"], "1 hour", watermark="2 hours"))
    want = windows.window_counts(as_ts(events), ["event_type"], "1 hour")
    key = lambda d: sorted((r["start"], r["event_type"], r["n"]) for r in d.collect())
    assert key(got) == key(want)
