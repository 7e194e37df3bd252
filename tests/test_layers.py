"""Layers from histories and folders, class masks and their guards, samples for a model."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import temporal
from tidemark.functions import text as T
from tidemark.operators import change, exposure, tensors
from tidemark.sources import layers, raster, vector

GRID = raster.Grid(3, 2, 32645, 10.0, -10.0, 300000.0, 3100000.0, 255.0)


def feature(osm_id, ends="2024-01-09T00:00:00Z", kind="Point", coordinates=(1, 2), **tags):
    return {"type": "Feature", "properties": {"@osmId": osm_id, "@validTo": ends, **tags}, "geometry": {"type": kind, "coordinates": list(coordinates)}}


def put(path, features, crs=None):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features} | ({"crs": {"type": "name", "properties": {"name": crs}}} if crs else {})))


def folder(tmp_path, record=None, names=("roads", "buildings", "settlements")):
    for n in names:
        put(tmp_path / layers.FILES[n], [feature(f"{n}/1"), feature(f"{n}/2", kind="LineString", coordinates=[[0, 0], [1, 1]])], "EPSG:32645" if n == "roads" else None)
    if record is not None:
        (tmp_path / layers.RECORD).write_text(json.dumps(record))
    return str(tmp_path)


def test_the_first_of_an_id_by_place(spark, tmp_path):
    many = [feature("way/1", name=f"v{i}") for i in range(30)]
    late = [feature("way/2", ends="2024-01-10T00:00:00Z"), {"type": "Feature", "properties": {"@osmId": "way/3", "@validTo": "2024-01-09T00:00:00Z"}, "geometry": None}, feature("way/4", ends=None)]
    put(tmp_path / "h.geojson", late + many + [feature("way/5", ends="2024-01-09T01:00:00+01:00", **{"name": "é", "name:en": "", "quote": 'a"b'})])
    got = {r["osm_id"]: r for r in vector.snapshot_features(vector.read_geojson(spark, str(tmp_path / "h.geojson")).repartition(7), "2024-01-09T00:00:00Z").collect()}
    assert set(got) == {"way/1", "way/5"}
    assert got["way/1"]["name"] == "v0"
    assert (got["way/5"]["name"], got["way/5"]["tags"]) == ("é", json.dumps({"name": "é", "name:en": "", "quote": 'a"b'}, ensure_ascii=False, sort_keys=True))


def test_united_takes_the_first_layer(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a")], "k int, x string")
    b = spark.createDataFrame([(2, "b", 1.0), (3, "b", 2.0), (None, "b", 3.0)], "k int, x string, y double")
    assert {tuple(r) for r in vector.united([a, b], "k").collect()} == {(1, "a", None), (2, "a", None), (3, "b", 2.0), (None, "a", None)}
    assert vector.united([a.limit(0), b.limit(0)], "k").count() == 0
    with pytest.raises(ValueError, match="no layers"):
        vector.united([], "k")


def test_folder_of_layers(spark, tmp_path):
    at = folder(tmp_path, {"snapshot": "2024-01-09T00:00:00Z", "event_date": "2024-01-10"})
    got = layers.read_layers(spark, at, event_day="2024-01-10")
    assert set(got.layers) == {"roads", "buildings", "settlements"} and got.missing_optional == ["bridges", "hubs"]
    assert sum("is assumed" in n for n in got.notes) == 2 and sum("left out" in n for n in got.notes) == 2
    report = {r["layer"]: (r["features"], r["kinds"], r["crs"]) for r in got.report().collect()}
    assert report == {"roads": (2, ["LineString", "Point"], "EPSG:32645"), "buildings": (2, ["LineString", "Point"], "EPSG:4326"), "settlements": (2, ["LineString", "Point"], "EPSG:4326")}


def test_an_empty_layer_is_reported(spark, tmp_path):
    put(tmp_path / layers.FILES["roads"], [])
    got = layers.read_layers(spark, str(tmp_path), ["roads"], [], need_record=False)
    assert [tuple(r)[:3] for r in got.report().collect()] == [("roads", 0, [])]
    assert any("unrecorded" in n for n in got.notes)


@pytest.mark.parametrize(("record", "told"), [(None, "is not there"), ({}, "no snapshot"), ({"snapshot": "2024-01-10T00:00:00Z"}, "not before"), ({"snapshot": "2024-01-09", "event_date": "2024-01-11"}, "of event")])
def test_records_that_support_nothing(spark, tmp_path, record, told):
    with pytest.raises(ValueError, match=told):
        layers.read_layers(spark, folder(tmp_path, record), event_day="2024-01-10")


def test_missing_layers_are_a_result(spark, tmp_path):
    with pytest.raises(layers.MissingLayers) as missing:
        layers.read_layers(spark, folder(tmp_path, {"snapshot": "2024-01-09"}, ("roads", "buildings")))
    assert [tuple(r)[:4] for r in missing.value.report(spark).collect()] == [("blocked", "required layers are not there", "settlements", "osm_settlements.geojson")]
    with pytest.raises(layers.MissingLayers, match="no folder"):
        layers.read_layers(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="rivers"):
        layers.read_layers(spark, str(tmp_path), ["rivers"])


def scene(spark, path, values, tags=None, grid=GRID):
    rows = [(i // grid.width, i % grid.width, v) for i, v in enumerate(values)]
    raster.write_pixels(spark.createDataFrame(rows, "row int, col int, value int"), str(path), grid, ["value"], "u1", tags=tags)
    return str(path)


def plain_grid(**other):
    return raster.Grid(**{**vars(GRID), **other})


def test_class_masks(spark, tmp_path):
    at = scene(spark, tmp_path / "a.tif", [0, 1, 2, 255, 0, 1])
    assert sorted(r["value"] for r in raster.read_class_mask(spark, at).collect()) == [0, 0, 1, 1, 2, 255]
    with pytest.raises(Exception, match="value 7 is none of"):
        raster.read_class_mask(spark, scene(spark, tmp_path / "b.tif", [0, 7, 2, 255, 0, 1])).collect()
    with pytest.raises(Exception, match="degrees"):
        raster.read_class_mask(spark, scene(spark, tmp_path / "c.tif", [0] * 6, grid=plain_grid(epsg=4326))).collect()
    with pytest.raises(Exception, match="another nodata"):
        raster.read_class_mask(spark, scene(spark, tmp_path / "d.tif", [0] * 6, grid=plain_grid(nodata=9.0))).collect()


def test_candidate_masks(spark, tmp_path):
    tags = {"artifact_stage": raster.CANDIDATE_STAGE, "semantic_values": raster.CANDIDATE_VALUES, "odd <&\" name": "x<y"}
    at = scene(spark, tmp_path / "a.tif", [0, 1, 255, 255, 0, 1], tags)
    assert json.loads(raster.read_metadata(spark, at).first()["tags"]) == tags
    mask = scene(spark, tmp_path / "v.tif", [1, 1, 0, 0, 1, 1], grid=plain_grid(nodata=None))
    got = {(r["row"], r["col"]): (r["value"], r["valid"]) for r in raster.read_candidate_mask(spark, at, mask).collect()}
    assert got == {(0, 0): (0, True), (0, 1): (1, True), (0, 2): (255, False), (1, 0): (255, False), (1, 1): (0, True), (1, 2): (1, True)}
    assert raster.read_candidate_mask(spark, at).where("valid").count() == 4
    with pytest.raises(Exception, match="observed_but_invalid"):
        raster.read_candidate_mask(spark, at, scene(spark, tmp_path / "w.tif", [1, 0, 0, 0, 1, 1], grid=plain_grid(nodata=None))).collect()
    with pytest.raises(ValueError, match="different grids"):
        raster.read_candidate_mask(spark, at, scene(spark, tmp_path / "x.tif", [1, 1, 0, 0, 1, 1], grid=plain_grid(nodata=None, c=300010.0)))
    with pytest.raises(Exception, match="another artifact_stage"):
        raster.read_candidate_mask(spark, scene(spark, tmp_path / "y.tif", [0] * 6)).collect()
    with pytest.raises(Exception, match="another semantic_values"):
        raster.read_candidate_mask(spark, scene(spark, tmp_path / "z.tif", [0] * 6, tags | {"semantic_values": "0=dry"})).collect()


def test_masks_of_other_extents_disagree(spark):
    a = spark.createDataFrame([(0, 0, 255), (0, 1, 1)], "row int, col int, value int")
    b = spark.createDataFrame([(0, 0, 1), (9, 9, 0)], "row int, col int, valid int")
    assert {tuple(r) for r in change.disagreements(a, b).collect()} == {("unobserved_but_valid", 1), ("only_in_classes", 1), ("only_in_mask", 1)}


def test_channels_that_are_missing_or_double(spark):
    rows = [("s", 0, 0, r, p, float(i)) for i, (r, p) in enumerate([*tensors.CHANNELS, ("pre", "hh")])]
    schema = "sample string, row int, col int, role string, polarisation string, value double"
    made = lambda r: spark.createDataFrame(r, schema)
    assert tuple(tensors.channel_stack(made(rows)).first())[3:] == (0.0, 1.0, 2.0, 3.0)
    invalid = rows[1:] + [("s", 0, 0, "pre", "VV", None)]
    assert tuple(tensors.channel_stack(made(invalid)).first())[3:] == (None, 1.0, 2.0, 3.0)
    for wrong, told in ((rows[1:], "0 rows of pre/vv"), ([*rows, rows[1]], "2 rows of pre/vh")):
        with pytest.raises(Exception, match=told):
            tensors.channel_stack(made(wrong)).collect()
    assert tensors.channel_stack(made([])).count() == 0


def test_targets(spark):
    labels = spark.createDataFrame([(2, True), (7, False), (None, False), (1, None)], "label int, valid boolean")
    assert [r[0] for r in labels.select(tensors.target(F.col("label"), F.col("valid"))).collect()] == [2, 3, 3, 3]
    for wrong in ("7", "null"):
        with pytest.raises(Exception, match="valid pixel with label"):
            spark.range(1).select(tensors.target(F.expr(f"cast({wrong} as int)"), F.lit(True))).collect()


def test_turns_equal_numpy(spark):
    image = np.arange(15).reshape(3, 5)
    pixels = spark.createDataFrame([(int(r), int(c), int(image[r, c])) for r, c in np.ndindex(3, 5)], "row int, col int, v int")
    for across, down, turns in itertools.product((False, True), (False, True), range(4)):
        wanted = image[:, ::-1] if across else image
        wanted = np.rot90(wanted[::-1] if down else wanted, turns)
        row, col = tensors.turned(F.col("row"), F.col("col"), F.lit(3), F.lit(5), F.lit(across), F.lit(down), F.lit(turns))
        assert {(r, c): v for r, c, v in pixels.select(row, col, "v").collect()} == {ix: int(v) for ix, v in np.ndenumerate(wanted)}


def test_draws_are_of_a_sample_and_differ(spark):
    cells = spark.range(200).select(F.col("id").alias("sample"), F.explode(F.expr("sequence(0, 15)")).alias("i")).select("sample", F.expr("i div 4").alias("row"), F.expr("i % 4").alias("col"), "i")
    got = tensors.augmented(cells, "sample", F.lit(4), F.lit(4), "seed").groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("row", "col", "i"))).alias("a"))
    assert got.select("a").distinct().count() == 8  # the symmetries of a square
    assert "Exchange" not in tensors.augmented(cells, "sample", F.lit(4), F.lit(4), "seed")._jdf.queryExecution().executedPlan().toString()
    still = tensors.augmented(cells, "sample", F.lit(4), F.lit(4), "seed", False, False, False)
    assert still.exceptAll(cells).isEmpty()


def test_processing_levels(spark):
    levels = ["L2A", " level2a ", "S2MSI1C", "Level-1C", "L3", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(levels)], "i int, level string").orderBy("i")
    assert [r[0] for r in rows.select(T.processing_level(F.col("level"))).collect()] == ["L2A", "L2A", "L1C", "L1C", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_snapshots_are_before_the_event(spark):
    at = lambda latest, requested=None: spark.range(1).select(temporal.iso(temporal.resolved_snapshot(F.lit("2024-01-10").cast("date"), F.lit(latest).cast("timestamp"), requested and F.lit(requested).cast("timestamp")))).first()[0]
    assert at("2024-03-01") == "2024-01-09T00:00:00Z"
    assert at("2024-01-05") == "2024-01-05T00:00:00Z"
    assert at("2024-03-01", "2024-01-09 23:59:59") == "2024-01-09T23:59:59Z"
    with pytest.raises(Exception, match="not before the event day"):
        at("2024-03-01", "2024-01-10")
    with pytest.raises(Exception, match="later than the latest"):
        at("2024-01-05", "2024-01-06")


def test_pieces_outside_the_grid_stay_open(spark):
    rows = spark.createDataFrame([(True,), (False,), (None,)], "outside boolean")
    closed = exposure.removed(F.lit(20.0), F.lit(15.0), F.lit(0.0), 10.0, True, F.col("outside"))
    assert [r[0] for r in rows.select(closed).collect()] == [False, True, True]
