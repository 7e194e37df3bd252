"""Layers of infrastructure before an event: united from a feature history, or read from a folder of GeoJSON files."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.raster import located
from tidemark.sources.vector import read_geojson, snapshot_features, united

#: Fixed names of the files of a folder of layers, and of the record of where they come from.
FILES = {"roads": "osm_roads.geojson", "bridges": "osm_bridges.geojson", "buildings": "osm_buildings.geojson", "settlements": "osm_settlements.geojson", "hubs": "osm_hubs.geojson"}
RECORD = "osm_provenance.json"
#: The system of a GeoJSON file that names none.
DEFAULT_CRS = "EPSG:4326"


class MissingLayers(Exception):
    """Required layers that are not there: what is missing, and where it was sought."""

    def __init__(self, what: str, missing: Sequence[str], searched: str) -> None:
        super().__init__(f"{what}: {', '.join(missing)} in {searched}")
        self.what, self.missing, self.searched = what, list(missing), searched

    def report(self, spark: SparkSession, next_step: str | None = None) -> DataFrame:
        """status, reason, layer, expected, searched, next_step: a row per missing layer, to be written where results
        would stand, so that what could not be done never reads as a finding of nothing."""
        rows = [("blocked", self.what, name, FILES.get(name), self.searched, next_step) for name in self.missing]
        return spark.createDataFrame(rows, "status string, reason string, layer string, expected string, searched string, next_step string")


@dataclass
class Layers:
    """Layers by name, the record beside them, the instant they show, and what was noted in reading them."""

    layers: dict[str, DataFrame]
    record: dict = field(default_factory=dict)
    snapshot: dt.datetime | None = None
    missing_optional: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def report(self) -> DataFrame:
        """layer, features, kinds (sorted), crs of each layer, in one job; an empty layer has no features."""
        return layer_report(self.layers)


def layer_report(layers: Mapping[str, DataFrame]) -> DataFrame:
    """layer, features, kinds (sorted, distinct), crs: a row per layer, also per empty one. One job for all layers."""
    spark = next(iter(layers.values())).sparkSession
    names = spark.createDataFrame([(n,) for n in layers], "layer string")
    parts = [d.select(F.lit(n).alias("layer"), "kind", (F.col("crs") if "crs" in d.columns else F.lit(DEFAULT_CRS)).alias("crs")) for n, d in layers.items()]
    counts = reduce(DataFrame.unionByName, parts).groupBy("layer").agg(F.count("*").alias("features"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.min("crs").alias("crs"))
    return names.join(counts, "layer", "left").select("layer", F.coalesce("features", F.lit(0).cast("long")).alias("features"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), "crs")


def pre_event_layers(history: Mapping[str, DataFrame], hubs: Mapping[str, DataFrame], snapshot: str, order: tuple[str, ...] = ("path", "at")) -> dict[str, DataFrame]:
    """The layers valid at the snapshot: roads of the area and of its surroundings as one (`roads_aoi` before
    `roads_buffer`), the other layers of the history as they are, and `hubs` with their hub_group.

    Histories are rows as read_geojson gives them. A hub of two groups is a row of each."""
    at = {name: snapshot_features(rows, snapshot, order=order) for name, rows in history.items()}
    out = {name: rows for name, rows in at.items() if name not in ("roads_aoi", "roads_buffer")}
    roads = [at[n] for n in ("roads_aoi", "roads_buffer") if n in at]
    if roads:
        out["roads"] = united(roads, "osm_id")
    if hubs:
        out["hubs"] = reduce(DataFrame.unionByName, [snapshot_features(rows, snapshot, order=order).select(F.lit(group).alias("hub_group"), "*") for group, rows in hubs.items()])
    return out


def _instant(text: str) -> dt.datetime:
    moment = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return moment if moment.tzinfo else moment.replace(tzinfo=dt.UTC)


def read_layers(spark: SparkSession, folder: str, required: Sequence[str] = ("roads", "buildings", "settlements"), optional: Sequence[str] = ("bridges", "hubs"), event_day: str | None = None, need_record: bool = True, before_event: bool = True) -> Layers:
    """The layers of a folder that lie there already; nothing is fetched.

    A missing folder or required layer is MissingLayers. An error: a name that is no layer's; no record, or one without
    a snapshot (unless need_record is False); a record of another event day; a snapshot that is not before the event
    day (unless before_event is False). Optional layers that are not there, and files that name no system, are noted."""
    unknown = sorted((set(required) | set(optional)) - set(FILES))
    if unknown:
        raise ValueError(f"no layers: {unknown}")
    system, place = located(folder)
    if system.get_file_info(place).type != fs.FileType.Directory:
        raise MissingLayers("no folder of layers", required, folder)
    there = {f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File}
    missing = [n for n in required if FILES[n] not in there]
    if missing:
        raise MissingLayers("required layers are not there", missing, folder)

    out = Layers({})
    if RECORD in there:
        with system.open_input_stream(f"{place}/{RECORD}") as file:
            out.record = json.loads(file.read())
        if not isinstance(out.record, dict):
            raise ValueError(f"{RECORD} is no JSON object")
    elif need_record:
        raise ValueError(f"{RECORD} is not there: layers of unknown origin support no result")
    else:
        out.notes.append(f"{RECORD} is not there: snapshot and area are unrecorded")
    if out.record.get("snapshot"):
        out.snapshot = _instant(str(out.record["snapshot"]))
    elif need_record:
        raise ValueError(f"{RECORD} names no snapshot")
    recorded = out.record.get("event_date")
    if event_day is not None and recorded is not None and recorded != event_day:
        raise ValueError(f"layers of event {recorded}, not of {event_day}")
    if before_event and event_day is not None and out.snapshot is not None and out.snapshot >= _instant(f"{event_day}T00:00:00Z"):
        raise ValueError(f"snapshot {out.snapshot.isoformat()} is not before the event day {event_day}")

    for name in (*required, *optional):
        if FILES[name] in there:
            rows = read_geojson(spark, f"{folder}/{FILES[name]}")
            out.layers[name] = rows.withColumn("crs", F.coalesce("crs", F.lit(DEFAULT_CRS)))
            if _names_no_system(spark, f"{folder}/{FILES[name]}"):
                out.notes.append(f"{FILES[name]} names no system: {DEFAULT_CRS} is assumed")
        else:
            out.missing_optional.append(name)
            out.notes.append(f"optional layer {name} is not there and is left out")
    return out


def _names_no_system(spark: SparkSession, path: str) -> bool:
    head = spark.read.format("binaryFile").load(path).select(F.from_json(F.decode("content", "UTF-8"), "crs struct<properties: struct<name: string>>").alias("j"))
    return head.where("j.crs.properties.name is not null").isEmpty()
