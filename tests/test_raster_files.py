"""Raster files in every layout that is read, written by the test; the sink's round trip, and what failures leave."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import raster

GRID = raster.Grid(7, 5, 32645, 10.0, -10.0, 300000.0, 3100000.0, -9999.0)


def lzw(data):
    table, width, acc, held, out, w = {bytes([i]): i for i in range(256)}, 9, 0, 0, bytearray(), b""
    size = 258

    def put(code):
        nonlocal acc, held
        acc, held = acc << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)

    put(256)
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        put(table[w])
        table[w + bytes([b])] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(256)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        w = bytes([b])
    if w:
        put(table[w])
    put(257)
    if held:
        out.append(acc << (8 - held) & 255)
    return bytes(out)


def write(path, a, tile=None, strip=2, planar=1, order="<", big=False, how=1, predictor=1, nodata=None, mask=None, bad=()):
    """a: rows x cols x bands. bad: numbers of blocks that are filled with rubbish."""
    rows, cols, bands = a.shape
    kind = a.dtype.str[1:]

    def pack(block):
        if predictor == 2:
            u = block.view(f"u{block.dtype.itemsize}")
            block = np.concatenate((u[:, :1], u[:, 1:] - u[:, :-1]), axis=1)
        raw = block.astype(order + block.dtype.str[1:]).tobytes()
        if predictor == 3:
            n, size = block.shape[1] * block.shape[2], block.dtype.itemsize
            lines = []
            for line in block:
                planes = np.frombuffer(line.astype(">" + kind).tobytes(), np.uint8).reshape(n, size).T.reshape(-1, block.shape[2])
                lines.append(np.concatenate((planes[:1], planes[1:] - planes[:-1])).tobytes())
            raw = b"".join(lines)
        return {1: lambda x: x, 5: lzw, 8: zlib.compress}[how](raw)

    parts = [a] if planar == 1 else [a[:, :, b : b + 1] for b in range(bands)]
    blocks = []
    for p in parts:
        for r in range(0, rows, tile or strip):
            for c in range(0, cols, tile or cols):
                block = p[r : r + (tile or strip), c : c + (tile or cols)]
                if tile:
                    full = np.zeros((tile, tile, p.shape[2]), a.dtype)
                    full[: block.shape[0], : block.shape[1]] = block
                    block = full
                blocks.append(b"rubbish" if len(blocks) in bad else pack(block))
    word = "Q" if big else "I"
    codes = {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}
    about = f'<GDALMetadata><Item name="DESCRIPTION" sample="0" role="description">vv</Item></GDALMetadata>\0'.encode()
    common = {33550: ("d", [10, 10, 0]), 33922: ("d", [0, 0, 0, 300000, 3100000, 0]), 34735: ("H", [1, 1, 0, 1, 3072, 0, 1, 32645]), 42112: ("s", about)}
    form = {"u": 1, "i": 2, "f": 3}[kind[0]]
    at = 322 if tile else 273
    first = {256: ("I", [cols]), 257: ("I", [rows]), 258: ("H", [8 * int(kind[1])] * bands), 259: ("H", [how]), 277: ("H", [bands]), 284: ("H", [planar]), 317: ("H", [predictor]), 339: ("H", [form] * bands), **common}
    first |= {322: ("I", [tile]), 323: ("I", [tile]), 324: (word, blocks), 325: (word, [len(b) for b in blocks])} if tile else {273: (word, blocks), 278: ("I", [strip]), 279: (word, [len(b) for b in blocks])}
    assert at in first
    if nodata is not None:
        first[42113] = ("s", f"{nodata}\0".encode())
    images = [first]
    if mask is not None:
        body = np.packbits(mask, axis=1).tobytes()
        images.append({254: ("I", [4]), 256: ("I", [cols]), 257: ("I", [rows]), 258: ("H", [1]), 259: ("H", [1]), 273: (word, [body]), 277: ("H", [1]), 278: ("I", [rows]), 279: (word, [len(body)])})
    out = bytearray(({"<": b"II", ">": b"MM"}[order]) + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for tags in images:
        entries = []
        for tag, (code, values) in sorted(tags.items()):
            if values and isinstance(values, list) and isinstance(values[0], bytes):
                places = []
                for b in values:
                    places.append(len(out))
                    out += b
                values = places
            raw = values if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
            slot = 8 if big else 4
            if len(raw) > slot:
                value = struct.pack(order + word, len(out))
                out += raw
            else:
                value = raw.ljust(slot, b"\0")
            entries.append(struct.pack(order + "HH" + word, tag, codes[code], len(raw) if code == "s" else len(values)) + value)
        here = len(out)
        out[link : link + struct.calcsize(word)] = struct.pack(order + word, here)
        out += struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + word, 0)
    path.write_bytes(bytes(out))


def rows(df):
    return {(r["band"], r["row"], r["col"]): r["value"] for r in df.collect()}


def want(a, drop=lambda b, r, c, v: False):
    return {(b + 1, r, c): None if drop(b, r, c, a[r, c, b]) or not np.isfinite(a[r, c, b]) else float(a[r, c, b]) for b in range(a.shape[2]) for r in range(a.shape[0]) for c in range(a.shape[1])}


LAYOUTS = [
    dict(), dict(how=8, strip=5), dict(how=5, order=">"), dict(tile=16, how=8), dict(tile=16, how=5, predictor=2, kind="u2"), dict(predictor=2, kind="i4", how=8, order=">"), dict(planar=2, how=8, kind="u1"), dict(planar=2, tile=16, predictor=2, kind="u2"),
    dict(predictor=3, how=8), dict(predictor=3, how=5, tile=16, kind="f8"), dict(big=True, how=8), dict(big=True, order=">", tile=16), dict(kind="i2", how=1), dict(kind="f8", planar=2),
]


def test_every_layout(spark, tmp_path):
    rng = np.random.default_rng(1)
    for i, layout in enumerate(LAYOUTS):
        kind = layout.get("kind", "f4")
        a = (rng.integers(0, 120, (37, 21, 3)) if kind[0] != "f" else rng.normal(size=(37, 21, 3))).astype(kind)
        if kind[0] == "f":
            a[3, 4, 1], a[5, 6, 0] = np.nan, np.inf
        a[7, 8, 2] = 77
        path = tmp_path / f"{i}.tif"
        write(path, a, **{k: v for k, v in layout.items() if k != "kind"}, nodata=77)
        assert rows(raster.read_pixels(spark, str(path))) == want(a, lambda b, r, c, v: v == 77), layout
    meta = raster.read_metadata(spark, str(tmp_path)).collect()
    assert len(meta) == len(LAYOUTS) and {m["names"][0] for m in meta} == {"vv"} and sum(m["tiled"] for m in meta) == 5


def test_long_lzw_and_masks(spark, tmp_path):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 255, (90, 100, 1)).astype("u1")  # thousands of codes: all widths, and a table that is cleared
    mask = rng.integers(0, 2, (90, 100)).astype("u1")
    write(tmp_path / "m.tif", a, how=5, strip=90, mask=mask)
    assert rows(raster.read_pixels(spark, str(tmp_path / "m.tif"))) == want(a, lambda b, r, c, v: mask[r, c] == 0)
    write(tmp_path / "n.tif", a, how=8, tile=32, mask=mask)
    assert rows(raster.read_pixels(spark, str(tmp_path / "n.tif"))) == want(a, lambda b, r, c, v: mask[r, c] == 0)


def test_only_wanted_blocks_are_read(spark, tmp_path):
    a = np.arange(64 * 64 * 2, dtype="u2").reshape(64, 64, 2)
    write(tmp_path / "a.tif", a, tile=16, planar=2, how=8, bad=set(range(32)) - {16 + 4 + 2, 16 + 8 + 2})
    write(tmp_path / "b.tif", a, tile=16, how=8, bad=set(range(16)))
    p = raster.read_pixels(spark, str(tmp_path), [2])
    p = p.where((F.col("row") >= 20) & (F.col("row") <= 40) & (F.col("col") > 33) & (F.col("col") < 40) & F.col("path").isin([str(tmp_path / "a.tif")]))
    assert rows(p) == {k: v for k, v in want(a).items() if k[0] == 2 and 20 <= k[1] <= 40 and 33 < k[2] < 40}
    assert p.rdd.getNumPartitions() == 1
    window = raster.read_window(spark, str(tmp_path / "a.tif"), (300340, 3099700, 300400, 3099800), [2])
    assert rows(window) == {k: v for k, v in want(a).items() if k[0] == 2 and 20 <= k[1] < 30 and 34 <= k[2] < 40}
    with pytest.raises(Exception, match="incorrect header|rubbish|decompress"):
        raster.read_pixels(spark, str(tmp_path / "b.tif")).collect()


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    a = np.random.default_rng(3).normal(size=(200, 300, 1)).astype("f4")
    write(tmp_path / "a.tif", a, strip=4)
    raster._register(spark)
    p = spark.read.format("tiled_raster").option("split", 20_000).load(str(tmp_path / "a.tif"))
    assert p.rdd.getNumPartitions() > 10 and rows(p) == want(a)


def test_what_cannot_be_read(spark, tmp_path):
    a = np.zeros((4, 4, 1), "f4")
    write(tmp_path / "a.tif", a)
    raw = (tmp_path / "a.tif").read_bytes()
    at = raw.index(struct.pack("<HHII", 317, 3, 1, 1))
    (tmp_path / "p.tif").write_bytes(raw[:at] + struct.pack("<HHII", 317, 3, 1, 9) + raw[at + 12 :])
    at = raw.index(struct.pack("<HHII", 259, 3, 1, 1))
    (tmp_path / "c.tif").write_bytes(raw[:at] + struct.pack("<HHII", 259, 3, 1, 7) + raw[at + 12 :])
    for name, what in (("p", "predictor 9"), ("c", "compression 7")):
        with pytest.raises(Exception, match=what):
            raster.read_pixels(spark, str(tmp_path / f"{name}.tif")).collect()
    meta = raster.read_metadata(spark, str(tmp_path / "a.tif"))
    assert raster.require_raster(meta, 1, 32645, ["vv"], True).count() == 1
    for wrong in ({"bands": 2}, {"epsg": 4326}, {"names": ["vh"]}):
        with pytest.raises(Exception, match="has (fewer bands|another system|other band names)"):
            raster.require_raster(meta, **wrong).collect()


@pytest.mark.parametrize(("kind", "predictor"), [("f4", 1), ("f8", 1), ("i2", 2), ("u1", 2)])
def test_sink_round_trip(spark, tmp_path, kind, predictor):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 100, (50, 30, 2)).astype(float)
    grid = raster.Grid(30, 50, 32645, 10.0, -10.0, 300000.0, 3100000.0, 101.0)
    cells = [(r, c, float(a[r, c, 0]), None if (r + c) % 7 == 0 else float(a[r, c, 1])) for r in range(50) for c in range(30) if not 16 <= r < 24]
    df = spark.createDataFrame(cells, "row bigint, col bigint, vv double, vh double")
    path = str(tmp_path / "out.tif")
    raster.write_pixels(df, path, grid, ["vv", "vh"], kind, 8, predictor)
    got = rows(raster.read_pixels(spark, path))
    assert got == want(a, lambda b, r, c, v: 16 <= r < 24 or (b == 1 and (r + c) % 7 == 0))
    m = raster.read_metadata(spark, path).first()
    assert (m["names"], m["epsg"], m["a"], m["e"], m["c"], m["f"], m["nodata"], m["blocks"]) == (["vv", "vh"], 32645, 10, -10, 300000, 3100000, 101, 7)
    with pytest.raises(Exception, match="there already"):
        raster.write_pixels(df, path, grid, ["vv", "vh"], kind)
    raster.write_pixels(df.where("row < 5"), path, grid, ["vv", "vh"], kind, 8, predictor, overwrite=True)
    assert sum(v is not None for v in rows(raster.read_pixels(spark, path)).values()) < 300
    assert [p.name for p in tmp_path.iterdir()] == ["out.tif"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    grid = raster.Grid(4, 4, 32645, 10.0, -10.0, 0.0, 0.0, -1.0)
    cells = [(r, c, 1.0) for r in range(4) for c in range(4)]
    for bad, what in (([(9, 0, 1.0)], "outside"), ([(1, 1, 2.0)], "two values")):
        with pytest.raises(Exception, match=what):
            raster.write_pixels(spark.createDataFrame(cells + bad, "row int, col int, v double"), str(tmp_path / "x.tif"), grid, ["v"], rows_per_strip=1)
    with pytest.raises(Exception, match="no nodata"):
        raster.write_pixels(spark.createDataFrame(cells[1:], "row int, col int, v double"), str(tmp_path / "x.tif"), raster.Grid(4, 4, 32645, 10.0, -10.0, 0.0, 0.0), ["v"])
    broken = spark.createDataFrame(cells, "row int, col int, v double").withColumn("v", F.when(F.col("row") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        raster.write_artifact(broken, str(tmp_path), "scene", grid, ["v"], {"source_ids": ["a"], "operations": ["b"], "version": "1"})
    assert list(tmp_path.iterdir()) == []


def test_artifact(spark, tmp_path):
    grid = raster.Grid(2, 2, 32645, 10.0, -10.0, 0.0, 0.0, -1.0)
    df = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, 1.0, None), (1, 0, float("nan"), 1.0)], "row int, col int, a double, b double")
    about = {"source_ids": ["s1"], "operations": ["speckle"], "version": "1"}
    quality = raster.write_artifact(df, str(tmp_path), "scene", grid, ["a", "b"], about)
    assert (quality["valid_pixels"], quality["invalid_pixels"]) == (1, 3)
    assert sorted(p.name for p in (tmp_path / "scene").iterdir()) == ["data.tif", "mask.tif", "provenance.json", "quality.json"]
    assert json.loads((tmp_path / "scene" / "provenance.json").read_text()) == about
    assert {k: v for k, v in rows(raster.read_pixels(spark, str(tmp_path / "scene" / "mask.tif"))).items()} == {(1, 0, 0): 1.0, (1, 0, 1): None, (1, 1, 0): None, (1, 1, 1): None}
    with pytest.raises(ValueError, match="there already"):
        raster.write_artifact(df, str(tmp_path), "scene", grid, ["a", "b"], about)
    with pytest.raises(ValueError, match="lacks"):
        raster.write_artifact(df, str(tmp_path), "other", grid, ["a", "b"], {})
