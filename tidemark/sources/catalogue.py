"""Catalogue and manifest sources: a paged scene catalogue as a Python data source, split files, sidecars and manifests."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCENES = "product_id string, name string, acquired_at string, attributes map<string,string>"


class _Page(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]

    def partitions(self) -> list[_Page]:
        return [_Page(p) for p in sorted(glob.glob(os.path.join(self.folder, "*.json")))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        with open(partition.path) as f:
            for item in json.load(f)["value"]:
                seen: dict[str, str] = {}
                for a in item.get("Attributes", []):
                    value = str(a["Value"])
                    if seen.setdefault(a["Name"], value) != value:
                        raise ValueError(f"{item['Id']} has two values of {a['Name']}")
                yield item["Id"], item.get("Name"), item.get("ContentDate", {}).get("Start"), seen


class PagedCatalogue(DataSource):
    """Pages of a catalogue search saved as JSON files in a folder that all executors see; one partition per page.

    spark.dataSource.register(PagedCatalogue); spark.read.format("paged_catalogue").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "paged_catalogue"

    def schema(self) -> str:
        return SCENES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_catalogue(spark: SparkSession, folder: str, most: int | None = None) -> tuple[DataFrame, bool]:
    """Scenes of all pages and whether there are more than `most`; a product on two pages is an error."""
    spark.dataSource.register(PagedCatalogue)
    scenes = spark.read.format("paged_catalogue").load(folder)
    if not scenes.groupBy("product_id").count().where("count > 1").isEmpty():
        raise ValueError("a product is on two pages")
    if most is None:
        return scenes, False
    return scenes.orderBy("acquired_at", "product_id").limit(most), scenes.count() > most


def search_filter(collection: str, kinds: list[str], start: str, end: str, wkt: str, cloud_below: float | None = None) -> str:
    """The filter text that such a catalogue takes."""
    parts = [f"Collection/Name eq '{collection}'", "(" + " or ".join(f"contains(Name,'{k}')" for k in kinds) + ")", f"OData.CSC.Intersects(area=geography'SRID=4326;{wkt}')", f"ContentDate/Start ge {start}", f"ContentDate/Start lt {end}"]
    if cloud_below is not None:
        parts.append(f"Attributes/OData.CSC.DoubleAttribute/any(a:a/Name eq 'cloudCover' and a/Value le {cloud_below:g})")
    return " and ".join(parts)


def read_splits(spark: SparkSession, paths: dict[str, str], column: str = "sample_id") -> DataFrame:
    """sample_id, split of one CSV file per split; a sample in two splits is an error."""
    out = None
    for split, path in paths.items():
        part = spark.read.csv(path, header=True).select(column, F.lit(split).alias("split"))
        out = part if out is None else out.unionByName(part)
    if not out.groupBy(column).agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a sample is in two splits")
    return out


def reconcile(listed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, state of a catalogue against what is on disk: both, only_listed or only_found."""
    both = listed.select(key, F.lit(1).alias("l")).distinct().join(found.select(key, F.lit(1).alias("f")).distinct(), key, "full_outer")
    return both.select(key, F.when(F.col("l").isNull(), "only_found").when(F.col("f").isNull(), "only_listed").otherwise("both").alias("state"))


def complete_roles(rows: DataFrame, key: str, role: str, wanted: list[str]) -> DataFrame:
    """key, complete: whether each key has exactly the wanted roles, once each."""
    have = F.array_sort(F.collect_list(role))
    return rows.groupBy(key).agg((have == F.array(*map(F.lit, sorted(wanted)))).alias("complete"))


def write_manifest(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows as JSON lines; an existing manifest is an error unless asked for."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str, key: str, sha256: str | None = None) -> DataFrame:
    """A manifest with unique keys and, if given, the digest of its sorted keys. A manifest is as long as its budget."""
    rows = spark.read.schema(schema).json(path)
    n, distinct, digest = rows.agg(F.count(key), F.count_distinct(key), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "\n"), 256)).first()
    if n != distinct:
        raise ValueError("a manifest names a sample twice")
    if sha256 is not None and digest != sha256:
        raise ValueError(f"the digest of the manifest is {digest}")
    return rows


def write_artifact(data: DataFrame, path: str, checks: dict[str, F.Column], summary: dict[str, F.Column]) -> DataFrame:
    """Write data, after all checks hold (aggregate conditions), with a one-row summary beside it; returns the summary."""
    row = data.agg(*[c.alias(n) for n, c in checks.items()]).first()
    failed = [n for n in checks if not row[n]]
    if failed:
        raise ValueError(f"checks failed: {', '.join(failed)}")
    data.write.mode("errorifexists").parquet(f"{path}/data")
    out = data.agg(*[c.alias(n) for n, c in summary.items()])
    out.write.mode("errorifexists").json(f"{path}/summary")
    return data.sparkSession.read.schema(out.schema).json(f"{path}/summary")
