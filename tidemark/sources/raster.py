"""Raster files as a Python data source: pixel tables read block by block, and written by a commit that is all or nothing.

Files are reached through Arrow's file systems, so a path may be an object store's. No file is decoded whole: tasks own
byte ranges of files as in other formats, read the directory, and fetch only blocks that filters on row, col and band
leave over."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.operators import change
from tidemark.sources import tiff

META = "path string, width int, height int, bands int, bits int, format int, compression int, predictor int, planar int, tiled boolean, blocks int, masked boolean, a double, e double, c double, f double, epsg int, nodata double, names array<string>, tags string"
PIXELS = "path string, row bigint, col bigint, band int, value double"
#: Fixed values of the candidate stage's files: who made it, and what its values mean.
CANDIDATE_STAGE = "m6.3-rtc-change-candidates-0.2.0"
CANDIDATE_VALUES = "0=not_candidate,1=darkening_candidate,255=not_observed"
_PUSH = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class Grid:
    """Size, system and affine transform (x = c + a * col, y = f + e * row) of a north-up raster."""

    width: int
    height: int
    epsg: int
    a: float
    e: float
    c: float
    f: float
    nodata: float | None = None


def located(path: str) -> tuple[fs.FileSystem, str]:
    path = path.replace("file:///", "/") if path.startswith("file:///") else path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Part(InputPartition):
    """The blocks of a file that begin in [start, end)."""

    path: str
    start: int
    end: float


class _Reader(DataSourceReader):
    def __init__(self, options: dict, meta: bool) -> None:
        self.path, self.split, self.meta = options["path"], int(options.get("split", 32 << 20)), meta
        self.low = {"row": 0, "col": 0, "band": 1}
        self.high: dict[str, float] = {"row": math.inf, "col": math.inf, "band": math.inf}
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of row, col and band, and paths. Spark applies all filters again to what is read."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            if name in self.low and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In)):
                least = min(f.value) if isinstance(f, In) else f.value + isinstance(f, GreaterThan)
                self.low[name] = max(self.low[name], least)
            if name in self.high and isinstance(f, (EqualTo, LessThan, LessThanOrEqual, In)):
                most = max(f.value) if isinstance(f, In) else f.value - isinstance(f, LessThan)
                self.high[name] = min(self.high[name], most)
            if name == "path" and isinstance(f, (EqualTo, In)):
                own = set(f.value if isinstance(f, In) else [f.value])
                self.paths = own if self.paths is None else self.paths & own
            yield f

    def partitions(self) -> list[_Part]:
        at, place = located(self.path)
        info = at.get_file_info(place)
        files = [info] if info.type == fs.FileType.File else [x for x in at.get_file_info(fs.FileSelector(place, recursive=True)) if x.type == fs.FileType.File and x.extension.lower() in ("tif", "tiff")]
        head = self.path[: -len(place)] if self.path.endswith(place) else ""
        out = []
        for x in sorted(files, key=lambda x: x.path):
            if self.paths is None or head + x.path in self.paths:
                n = 1 if self.meta else max(1, -(-x.size // self.split))
                out += [_Part(head + x.path, k * self.split if k else 0, math.inf if k == n - 1 else (k + 1) * self.split) for k in range(n)]
        return out

    def _wanted(self, block: tiff.Block) -> bool:
        spans = {"row": (block.row, block.row + block.rows - 1), "col": (block.col, block.col + block.cols - 1), "band": (block.bands.start + 1, block.bands.stop)}
        return all(a <= self.high[k] and z >= self.low[k] for k, (a, z) in spans.items())

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        system, place = located(partition.path)
        with system.open_input_file(place) as file:
            fetch = lambda at, n: file.read_at(n, at)
            try:
                image, mask = tiff.images(fetch)
            except ValueError as wrong:
                raise ValueError(f"{partition.path} is {wrong}") from None
            about = tiff.geometry(image.tags, partition.path)
            if self.meta:
                get = image.get
                row = {"path": partition.path, "width": get(tiff.WIDTH), "height": get(tiff.HEIGHT), "bands": image.bands, "bits": get(tiff.BITS, 1), "format": get(tiff.FORMAT, 1), "compression": get(tiff.COMPRESSION, 1), "predictor": get(tiff.PREDICTOR, 1), "planar": get(tiff.PLANAR, 1), "tiled": image.tiled, "blocks": sum(1 for _ in image.blocks()), "masked": mask is not None, **about, "names": tiff.names(image.tags), "tags": json.dumps(tiff.labels(image.tags))}
                yield pa.RecordBatch.from_pylist([row], schema=_arrow(META))
                return
            for block in image.blocks():
                if partition.start <= block.at < partition.end and self._wanted(block):
                    try:
                        values = image.decode(block, fetch(block.at, block.size)).astype(np.float64)
                    except ValueError as wrong:
                        raise ValueError(f"{partition.path}: {wrong}") from None
                    seen = np.isfinite(values)
                    if about["nodata"] is not None:
                        seen &= values != about["nodata"]
                    if mask is not None:
                        seen &= self._masked(mask, fetch, block)[:, :, None]
                    yield from self._rows(partition.path, block, values, seen)

    @staticmethod
    def _masked(mask: tiff.Image, fetch: tiff.Fetch, block: tiff.Block) -> np.ndarray:
        """Where the file's own mask is not zero, over the pixels of a block."""
        out = np.zeros((block.rows, block.cols), dtype=bool)
        for m in mask.blocks():
            top, left, bottom, right = max(m.row, block.row), max(m.col, block.col), min(m.row + m.rows, block.row + block.rows), min(m.col + m.cols, block.col + block.cols)
            if top < bottom and left < right:
                there = mask.decode(m, fetch(m.at, m.size))[:, :, 0] != 0
                out[top - block.row : bottom - block.row, left - block.col : right - block.col] = there[top - m.row : bottom - m.row, left - m.col : right - m.col]
        return out

    def _rows(self, path: str, block: tiff.Block, values: np.ndarray, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, band in enumerate(block.bands, 1):
            if self.low["band"] <= band + 1 <= self.high["band"]:
                n = block.rows * block.cols
                row, col = np.divmod(np.arange(n), block.cols)
                value = pa.array(values[:, :, k - 1].ravel(), mask=~seen[:, :, k - 1].ravel())
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(row + block.row), pa.array(col + block.col), pa.array(np.full(n, band + 1, np.int32)), value], ["path", "row", "col", "band", "value"])


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


@dataclass
class _Written(WriterCommitMessage):
    """A task's file and its strips: number, place in it, size."""

    name: str
    strips: list[tuple[int, int, int]]


class _Writer(DataSourceArrowWriter):
    """Tasks write the strips of their rows into a folder of the job; the commit joins them behind a directory and moves
    the file into place. A failure leaves neither file nor folder."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.grid, self.bands, self.kind = options["path"], Grid(**json.loads(options["grid"])), json.loads(options["bands"]), options["kind"]
        self.tags = json.loads(options["tags"])
        self.high, self.predictor, self.overwrite, self.job = int(options["rows"]), int(options["predictor"]), overwrite, uuid.uuid4().hex
        system, place = located(self.path)
        if not overwrite and system.get_file_info(place).type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} is there already")

    @property
    def folder(self) -> str:
        return f"{located(self.path)[1]}.tmp-{self.job}"

    def _strip(self, no: int) -> tuple[np.ndarray, np.ndarray]:
        rows = min(self.high, self.grid.height - no * self.high)
        fill = np.nan if self.grid.nodata is None else self.grid.nodata
        return np.full((rows, self.grid.width, len(self.bands)), fill), np.zeros((rows, self.grid.width), dtype=bool)

    def _encoded(self, no: int, values: np.ndarray, seen: np.ndarray) -> bytes:
        empty = ~seen.all() or np.isnan(values).any()
        if empty and self.grid.nodata is None:
            raise ValueError(f"{self.path}: strip {no} has pixels without a value, and there is no nodata value")
        return tiff.encode_strip(values.astype(self.kind), self.predictor)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, _ = located(self.path)
        system.create_dir(self.folder, recursive=True)
        name, strips, at = uuid.uuid4().hex, [], 0
        no, values, seen = -1, None, None
        with system.open_output_stream(f"{self.folder}/{name}") as out:

            def flush() -> None:
                nonlocal at
                if no >= 0:
                    raw = self._encoded(no, values, seen)
                    out.write(raw)
                    strips.append((no, at, len(raw)))
                    at += len(raw)

            for batch in iterator:
                row, col = (np.asarray(batch.column(c)) for c in ("row", "col"))
                if len(row) and not (0 <= row.min() and row.max() < self.grid.height and 0 <= col.min() and col.max() < self.grid.width):
                    raise ValueError(f"{self.path}: a pixel lies outside the grid")
                own = np.column_stack([batch.column(b).cast(pa.float64()).to_numpy(zero_copy_only=False) for b in self.bands])
                of = row // self.high
                for k in np.unique(of).tolist():  # rows come in order, so a strip ends where the next one begins
                    if k != no:
                        flush()
                        no, (values, seen) = k, self._strip(k)
                    here = of == k
                    r, c = row[here] - k * self.high, col[here]
                    if seen[r, c].any() or len(np.unique(r * self.grid.width + c)) < len(r):
                        raise ValueError(f"{self.path}: a pixel has two values")
                    seen[r, c] = True
                    values[r, c] = np.where(np.isnan(own[here]), values[r, c], own[here])
            flush()
        return _Written(name, strips)

    def commit(self, messages: list[_Written | None]) -> None:
        system, place = located(self.path)
        try:
            found = {no: (m.name, at, n) for m in messages if m for no, at, n in m.strips}
            if len(found) < sum(len(m.strips) for m in messages if m):
                raise ValueError(f"{self.path}: a strip was written by two tasks")
            count = -(-self.grid.height // self.high)
            blank = {no: self._encoded(no, *self._strip(no)) for no in range(count) if no not in found}
            sizes = [found[no][2] if no in found else len(blank[no]) for no in range(count)]
            head, _ = tiff.header(self.grid.width, self.grid.height, self.kind, self.high, sizes, asdict(self.grid), self.bands, self.predictor, self.tags)
            files: dict[str, pa.NativeFile] = {}
            system.create_dir(self.folder, recursive=True)
            with system.open_output_stream(f"{self.folder}/whole") as out:
                out.write(head)
                for no in range(count):
                    if no in found:
                        name, at, n = found[no]
                        if name not in files:
                            files[name] = system.open_input_file(f"{self.folder}/{name}")
                        out.write(files[name].read_at(n, at))
                    else:
                        out.write(blank[no])
            for f in files.values():
                f.close()
            system.move(f"{self.folder}/whole", place)
        finally:
            self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = located(self.path)
        if system.get_file_info(self.folder).type != fs.FileType.NotFound:
            system.delete_dir(self.folder)


class TiledRaster(DataSource):
    """spark.read.format("tiled_raster").load(path): PIXELS of a file or of all files below a folder; with the option
    meta = true, one row of META for each file."""

    @classmethod
    def name(cls) -> str:
        return "tiled_raster"

    def _meta(self) -> bool:
        return self.options.get("meta", "false").lower() == "true"

    def schema(self) -> str:
        return META if self._meta() else PIXELS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, self._meta())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(TiledRaster)
    if spark.conf.get(_PUSH, "false") != "true":
        spark.conf.set(_PUSH, "true")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per file. A file without an affine transform or a coordinate system is an error."""
    _register(spark)
    return spark.read.format("tiled_raster").option("meta", "true").load(path)


def read_pixels(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    """path, row, col, band, value; NULL where a value is nodata, NaN or infinite, or the file's mask is zero.

    Strips and tiles, both byte orders, small and big files, interleaved and separate bands, plain, deflated and LZW
    blocks, differences of whole numbers and of floats are read; another compression or predictor is an error. Filters
    on row, col, band and path reach the source."""
    _register(spark)
    pixels = spark.read.format("tiled_raster").load(path)
    return pixels.where(F.col("band").isin(bands)) if bands else pixels


def read_window(spark: SparkSession, path: str, window: tuple[float, float, float, float], bands: list[int] | None = None) -> DataFrame:
    """The pixels of one file whose centres lie in a window (x0, y0, x1, y1) of its own system; none if it lies outside."""
    m = read_metadata(spark, path).first()
    cols = [math.ceil((x - m["c"]) / m["a"] - 0.5) for x in (window[0], window[2])]
    rows = [math.ceil((y - m["f"]) / m["e"] - 0.5) for y in (window[3], window[1])]
    pixels = read_pixels(spark, path, bands)
    return pixels.where((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))


def same_grid(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> bool:
    """Whether two one-row metadata tables have the same system, size and transform."""
    x, y = a.first(), b.first()
    return all(x[n] == y[n] for n in ("epsg", "width", "height")) and all(abs(x[n] - y[n]) <= tolerance for n in ("a", "e", "c", "f"))


def require_raster(meta: DataFrame, bands: int | None = None, epsg: int | None = None, names: list[str] | None = None, metric: bool = False, one_byte: bool = False, nodata: float | None = None, tags: dict[str, str] | None = None, needed: Sequence[str] = ()) -> DataFrame:
    """meta; a file with fewer bands, another system, other band names, more than a band of one byte (one_byte), another
    nodata value than the one given (none is right), another value of a tag (no such tag is right unless needed), or (metric) a system in degrees or pixels that
    aren't square is an error when its row is read."""
    wrong = F.lit(None).cast("string")
    checks = [("fewer bands", F.col("bands") >= bands) if bands else None, ("another system", F.col("epsg") == epsg) if epsg else None, ("other band names", F.col("names") == F.array(*map(F.lit, names))) if names else None]
    checks += [("a system in degrees", ~F.col("epsg").between(4000, 4999)), ("pixels that aren't square", F.abs(F.col("a") + F.col("e")) <= 1e-9 * F.col("a"))] if metric else []
    checks += [("not one band of one byte", (F.col("bands") == 1) & (F.col("bits") == 8) & (F.col("format") == 1))] if one_byte else []
    checks += [("another nodata value", F.coalesce(F.col("nodata") == nodata, F.lit(True)))] if nodata is not None else []
    for name, value in (tags or {}).items():
        found = F.from_json("tags", "map<string,string>")[name]
        checks.append((f"another {name}", found.isNotNull() & (found == value) if name in needed else F.coalesce(found == value, F.lit(True))))
    for what, holds in filter(None, checks):
        wrong = F.when(~F.coalesce(holds, F.lit(False)), what).otherwise(wrong)
    return meta.withColumn("path", F.when(wrong.isNull(), F.col("path")).otherwise(F.raise_error(F.concat("path", F.lit(" has "), wrong))))


def _checked(spark: SparkSession, path: str, fill: int, **guards: object) -> DataFrame:
    """path, row, col, value of a class raster that keeps its guards; nodata is the class `fill` again."""
    meta = require_raster(read_metadata(spark, path), one_byte=True, **guards)
    meta.select("path").collect()  # guards hold before any pixel is read; one row per file
    return read_pixels(spark, path).select("path", "row", "col", F.coalesce("value", F.lit(fill)).cast("int").alias("value"))


def read_class_mask(spark: SparkSession, path: str, allowed: Sequence[int] = change.CLASSES) -> DataFrame:
    """path, row, col, value of a raster of classes: one band of one byte, in metres, north-up, nodata the last class if
    it names one; a value outside the classes is an error when its row is read."""
    return change.require_classes(_checked(spark, path, allowed[-1], metric=True, nodata=float(allowed[-1])), allowed)


def read_candidate_mask(spark: SparkSession, path: str, valid_path: str | None = None, stage: str = CANDIDATE_STAGE, tolerance: float = 0.0) -> DataFrame:
    """row, col, value, valid of a raster of change candidates, made by the stage named in its tags, with the meaning of
    its values there, if it names one. Valid is what isn't unobserved; with the stage's own valid mask given, the grids
    must agree to the tolerance, and a pixel that is unobserved in one raster only is an error when its row is read."""
    rows = _checked(spark, path, change.NODATA, metric=True, nodata=float(change.NODATA), tags={"artifact_stage": stage, "semantic_values": CANDIDATE_VALUES}, needed=("artifact_stage",))
    rows = change.require_classes(rows, change.CANDIDATES).select("row", "col", "value")
    if valid_path is None:
        return rows.withColumn("valid", F.col("value") != change.NODATA)
    if not same_grid(read_metadata(spark, path), read_metadata(spark, valid_path), tolerance):
        raise ValueError(f"{path} and {valid_path} are on different grids")
    valid = change.require_classes(_checked(spark, valid_path, 0), (0, 1)).select("row", "col", F.col("value").alias("valid"))
    return change.agreeing(rows, valid)


def write_pixels(pixels: DataFrame, path: str, grid: Grid, bands: list[str], kind: str = "f4", rows_per_strip: int = 64, predictor: int = 1, overwrite: bool = False, tags: dict[str, str] | None = None) -> None:
    """Write row, col and a column per band as one deflated file. Strips are made by as many tasks as there are, in one
    shuffle by strip; no task holds more than a strip. NULL and missing pixels become nodata; without a nodata value
    they are an error, as are two values of a pixel, pixels outside the grid, and a file that is there unless overwrite."""
    if len(set(bands)) < len(bands) or not bands:
        raise ValueError("bands need names of their own")
    spark = pixels.sparkSession
    _register(spark)
    dealt = pixels.select(F.col("row").cast("bigint"), F.col("col").cast("bigint"), *[F.col(b).cast("double") for b in bands]).withColumn("strip", F.floor(F.col("row") / rows_per_strip))
    dealt = dealt.repartition("strip").sortWithinPartitions("strip").drop("strip")
    options = {"grid": json.dumps(asdict(grid)), "bands": json.dumps(bands), "kind": kind, "rows": rows_per_strip, "predictor": predictor, "tags": json.dumps(tags or {})}
    dealt.write.format("tiled_raster").mode("overwrite" if overwrite else "append").options(**options).save(path)


def write_artifact(pixels: DataFrame, folder: str, stem: str, grid: Grid, bands: list[str], provenance: dict, kind: str = "f4", rows_per_strip: int = 64) -> dict:
    """An artefact as a folder `stem`: data.tif, mask.tif (1: all bands have a value), quality.json, provenance.json.

    All is written beside it first and moved at once, so that the artefact is there whole or not at all; one that is
    there already is an error. Returns the quality record."""
    missing = [k for k in ("source_ids", "operations", "version") if not provenance.get(k)]
    if missing:
        raise ValueError(f"provenance lacks {missing}")
    system, place = located(folder)
    final, staged = f"{place}/{stem}", f"{place}/.{stem}-{uuid.uuid4().hex}"
    if system.get_file_info(final).type != fs.FileType.NotFound:
        raise ValueError(f"{final} is there already")
    system.create_dir(staged, recursive=True)
    try:
        valid = F.lit(True)
        for b in bands:
            valid = valid & F.col(b).isNotNull() & ~F.isnan(F.col(b).cast("double"))
        write_pixels(pixels, f"{staged}/data.tif", grid, bands, kind, rows_per_strip)
        write_pixels(pixels.select("row", "col", valid.cast("int").alias("valid")), f"{staged}/mask.tif", Grid(**asdict(grid) | {"nodata": 0.0}), ["valid"], "u1", rows_per_strip)
        seen, total = pixels.where(valid).count(), grid.width * grid.height
        quality = {"status": "success", "width": grid.width, "height": grid.height, "bands": bands, "epsg": grid.epsg, "valid_pixels": seen, "invalid_pixels": total - seen, "invalid_percent": 100.0 * (total - seen) / total if total else None}
        for name, record in (("quality", quality), ("provenance", provenance)):
            with system.open_output_stream(f"{staged}/{name}.json") as out:
                out.write((json.dumps(record, indent=2, sort_keys=True) + "\n").encode())
        system.move(staged, final)
    finally:
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)
    return quality
