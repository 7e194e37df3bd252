"""The TIFF container: directories and blocks by byte ranges, and the parts of a file to be written."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

Fetch = Callable[[int, int], bytes]

#: Tags of the format, struct codes of its field types, and pixel types by (sample format, bits).
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 254, 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS, FORMAT, SCALE, TIEPOINT, MATRIX, KEYS, ABOUT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42112, 42113
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
PIXEL = {(1, 1): "u1", (1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def directories(fetch: Fetch) -> tuple[str, list[dict[int, tuple]]]:
    """Byte order and the tags of all images of a classic or big file."""
    head = fetch(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    count, entry, word, size = ("H", 12, "I", 4) if magic == 42 else ("Q", 20, "Q", 8)
    at = struct.unpack(order + word, head[4:8] if magic == 42 else head[8:16])[0]
    out: list[dict[int, tuple]] = []
    while at:
        wide = struct.calcsize(order + count)
        n = struct.unpack(order + count, fetch(at, wide))[0]
        body, tags = fetch(at + wide, n * entry + size), {}
        for i in range(n):
            tag, kind, many = struct.unpack(order + "HH" + word, body[i * entry : i * entry + 4 + size])
            code = FIELD.get(kind)
            if code is None:
                continue
            value, total = body[i * entry + 4 + size : (i + 1) * entry], struct.calcsize(order + code) * many
            raw = value[:total] if total <= size else fetch(struct.unpack(order + word, value)[0], total)
            tags[tag] = struct.unpack(f"{order}{many}{code}", raw)
        out.append(tags)
        at = struct.unpack(order + word, body[n * entry :])[0]
    return order, out


def unpack_lzw(data: bytes) -> bytes:
    """LZW as the format has it: codes of 9 to 12 bits from the high end, 256 clears, 257 ends, widths grow one early."""
    bits, held, width, out, table, last = 0, 0, 9, [], [], b""
    for byte in data:
        bits, held = (bits << 8 | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
            width = max(9, min(12, (len(table) + 1).bit_length()))
        out.append(entry)
        last = entry
    return b"".join(out)


def unpredicted(raw: bytes, order: str, kind: str, rows: int, cols: int, samples: int, predictor: int) -> np.ndarray:
    """rows x cols x samples; undoes horizontal differences (2) and those of byte planes of floats (3)."""
    size = int(kind[1])
    raw = raw[: rows * cols * samples * size]
    if predictor == 2:
        whole = np.frombuffer(raw, dtype=f"{order}u{size}").reshape(rows, cols, samples).astype(f"u{size}")
        return np.cumsum(whole, axis=1, dtype=f"u{size}").view(kind)
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, dtype=np.uint8).reshape(rows, cols * size, samples), axis=1, dtype=np.uint8).reshape(rows, size, cols * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">{kind}").reshape(rows, cols, samples)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} isn't read")
    return np.frombuffer(raw, dtype=order + kind).reshape(rows, cols, samples)


@dataclass(frozen=True)
class Block:
    """A strip or tile: its pixels' places, its bands (from 0), and its bytes in the file."""

    row: int
    col: int
    rows: int
    cols: int
    bands: range
    at: int
    size: int


@dataclass(frozen=True)
class Image:
    order: str
    tags: dict[int, tuple]

    def get(self, tag: int, default: int | None = None) -> int:
        return self.tags[tag][0] if tag in self.tags or default is None else default

    @property
    def bands(self) -> int:
        return self.get(SAMPLES, 1)

    @property
    def kind(self) -> str:
        return PIXEL[self.get(FORMAT, 1), self.get(BITS, 1)]

    @property
    def tiled(self) -> bool:
        return TILES in self.tags

    def blocks(self) -> Iterator[Block]:
        width, height = self.get(WIDTH), self.get(HEIGHT)
        across, down = (self.get(TILE_WIDTH), self.get(TILE_HEIGHT)) if self.tiled else (width, min(height, self.get(ROWS, height)))
        offsets, counts = (self.tags[TILES], self.tags[TILE_COUNTS]) if self.tiled else (self.tags[STRIPS], self.tags[COUNTS])
        groups = [range(self.bands)] if self.get(PLANAR, 1) == 1 else [range(b, b + 1) for b in range(self.bands)]
        places = [(b, r, c) for b in groups for r in range(0, height, down) for c in range(0, width, across)]
        for (bands, row, col), at, size in zip(places, offsets, counts, strict=True):
            yield Block(row, col, min(down, height - row), min(across, width - col), bands, at, size)

    def decode(self, block: Block, raw: bytes) -> np.ndarray:
        """Values of a block, rows x cols x bands."""
        how = self.get(COMPRESSION, 1)
        if how not in (1, 5, 8, 32946):
            raise ValueError(f"compression {how} isn't read")
        raw = raw if how == 1 else unpack_lzw(raw) if how == 5 else zlib.decompress(raw)
        rows, cols = (self.get(TILE_HEIGHT), self.get(TILE_WIDTH)) if self.tiled else (block.rows, block.cols)
        if self.get(BITS, 1) == 1:
            line = -(-cols // 8)
            out = np.unpackbits(np.frombuffer(raw, np.uint8)[: rows * line].reshape(rows, line), axis=1)[:, :cols, None]
        else:
            out = unpredicted(raw, self.order, self.kind, rows, cols, len(block.bands), self.get(PREDICTOR, 1))
        return out[: block.rows, : block.cols]


def images(fetch: Fetch) -> tuple[Image, Image | None]:
    """The first image, and the mask of its pixels if the file has one."""
    order, all_tags = directories(fetch)
    mask = next((t for t in all_tags[1:] if t.get(SUBFILE, (0,))[0] & 4), None)
    return Image(order, all_tags[0]), None if mask is None else Image(order, mask)


def geometry(tags: dict[int, tuple], path: str) -> dict:
    """The affine transform of a north-up image, its EPSG code and nodata value."""
    scale, tie = tags.get(SCALE), tags.get(TIEPOINT)
    if scale is None or tie is None:
        raise ValueError(f"{path} has no affine transform" + " that is north-up" * (MATRIX in tags))
    keys = tags.get(KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (3072, 2048) and keys[i + 1] == 0), None)
    if epsg is None:
        raise ValueError(f"{path} has no coordinate system")
    nodata = b"".join(tags[NODATA]).rstrip(b"\0 ") if NODATA in tags else b""
    return {"a": scale[0], "e": -scale[1], "c": tie[3] - tie[0] * scale[0], "f": tie[4] + tie[1] * scale[1], "epsg": epsg, "nodata": float(nodata) if nodata else None}


def names(tags: dict[int, tuple]) -> list[str | None]:
    """What the file says its bands are."""
    import xml.etree.ElementTree as ET

    out: list[str | None] = [None] * tags.get(SAMPLES, (1,))[0]
    text = b"".join(tags.get(ABOUT, ())).rstrip(b"\0")
    for item in ET.fromstring(text) if text else []:
        if item.get("role") == "description" and item.get("sample", "").isdigit():
            out[int(item.get("sample"))] = item.text
    return out


def labels(tags: dict[int, tuple]) -> dict[str, str]:
    """What the file says of itself by name, bands and domains apart."""
    import xml.etree.ElementTree as ET

    text = b"".join(tags.get(ABOUT, ())).rstrip(b"\0")
    return {item.get("name", ""): item.text or "" for item in (ET.fromstring(text) if text else []) if item.get("sample") is None and item.get("domain") is None}


def encode_strip(values: np.ndarray, predictor: int) -> bytes:
    """A deflated strip, rows x cols x bands."""
    values = np.ascontiguousarray(values.astype("<" + values.dtype.str[1:]))
    if predictor == 2:
        whole = values.view(f"<u{values.dtype.itemsize}")
        values = np.concatenate((whole[:, :1], whole[:, 1:] - whole[:, :-1]), axis=1)
    return zlib.compress(values.tobytes(), 6)


def header(width: int, height: int, kind: str, high: int, sizes: list[int], grid: dict, bands: list[str], predictor: int, tags: dict[str, str] | None = None) -> tuple[bytes, int]:
    """All that stands before the strips of a file of such strips, each `high` rows; and the whole file's size."""
    from xml.sax.saxutils import escape, quoteattr

    form = {"u": 1, "i": 2, "f": 3}[kind[0]]
    about = "<GDALMetadata>" + "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(b)}</Item>' for i, b in enumerate(bands)) + "".join(f"<Item name={quoteattr(k)}>{escape(v)}</Item>" for k, v in (tags or {}).items()) + "</GDALMetadata>"
    model = (1, 3072) if grid["epsg"] != 4326 else (2, 2048)
    keys = (1, 1, 0, 3, 1024, 0, 1, model[0], 1025, 0, 1, 1, model[1], 0, 1, grid["epsg"])
    fields = {
        WIDTH: ("I", (width,)), HEIGHT: ("I", (height,)), BITS: ("H", (8 * int(kind[1]),) * len(bands)), COMPRESSION: ("H", (8,)), 262: ("H", (1,)), SAMPLES: ("H", (len(bands),)), ROWS: ("I", (high,)),
        PLANAR: ("H", (1,)), PREDICTOR: ("H", (predictor,)), FORMAT: ("H", (form,) * len(bands)), SCALE: ("d", (grid["a"], -grid["e"], 0.0)), TIEPOINT: ("d", (0.0, 0.0, 0.0, grid["c"], grid["f"], 0.0)),
        KEYS: ("H", keys), ABOUT: ("c", about.encode() + b"\0"),
    }
    if len(bands) > 1:
        fields[338] = ("H", (0,) * (len(bands) - 1))
    if grid.get("nodata") is not None:
        fields[NODATA] = ("c", ("nan" if math.isnan(grid["nodata"]) else f"{grid['nodata']:g}").encode() + b"\0")

    def build(big: bool) -> bytes:
        word, slot, entry = ("Q", 8, 20) if big else ("I", 4, 12)
        every = dict(sorted((fields | {STRIPS: (word, tuple(0 for _ in sizes)), COUNTS: (word, tuple(sizes))}).items()))
        start = (16 + 8 if big else 8 + 2) + entry * len(every) + slot
        extra_at, places = start, {}
        for tag, (code, values) in every.items():
            n = struct.calcsize("<" + code) * len(values)
            if n > slot:
                places[tag] = extra_at
                extra_at += n + n % 2
        offsets = (np.cumsum([0, *sizes[:-1]]) + extra_at).tolist() if sizes else []
        every[STRIPS] = (word, tuple(offsets))
        kinds = {v: k for k, v in FIELD.items()}
        body, extra = b"", b""
        for tag, (code, values) in every.items():
            raw = bytes(values) if code == "c" else struct.pack(f"<{len(values)}{code}", *values)
            value = struct.pack("<" + word, places[tag]) if tag in places else raw.ljust(slot, b"\0")
            body += struct.pack("<HH" + word, tag, kinds[code], len(raw) if code == "c" else len(values)) + value
            extra += (raw + b"\0" * (len(raw) % 2)) if tag in places else b""
        first = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(every)) if big else struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(every))
        return first + body + b"\0" * slot + extra

    small = build(False) if sum(sizes) < (1 << 32) - (1 << 24) else b""
    head = small if small and len(small) + sum(sizes) < 1 << 32 else build(True)
    return head, len(head) + sum(sizes)
