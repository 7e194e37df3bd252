"""Repeated passages of a corpus, found by content-chosen anchors and decided by an index of each anchor's contexts.

A window is `length` consecutive units (bytes or words) of one document. Its anchor is the leftmost of its `gram`-unit
runs with the least hash, so equal windows have equal anchors at equal places. Neighbouring windows with the same
anchor make a segment; each window lies in exactly one segment. Windows are then compared only with windows whose
anchor has the same content:

1. anchors of all documents (hashes and places, no text) are counted by text and place, and then by key; those of
   unique keys go;
2. a key with one segment content, found twice or more, is repeated as a whole;
3. for other keys one text of each distinct segment is fetched, and a function builds an index (suffix automaton,
   suffix array) over the key's segments and tells which spans of each are repeated;
4. a key with more than `group` distinct segments isn't built in one task: its windows are counted by hash in a
   shuffle with partial sums, which is exact at any size;
5. a segment's span goes back to all its places, and the spans of each text to its documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mapped, prefix_hash, scope, slices, span_hash, text_bytes, word_spans, written

#: One distinct segment of a key: its bytes, its copies, and the unit at which the anchor starts.
Segment = tuple[bytes, int, int]
#: The span [a, b) in units of each segment that its repeated windows cover; all of them contain the anchor, so it is one.
Index = Callable[[list[Segment], "Repeats"], list[tuple[int, int] | None]]


@dataclass(frozen=True)
class Repeats:
    """length: units of a window; gram: units of an anchor; words: whether units are words, else bytes."""

    length: int
    gram: int
    words: bool
    group: int = 4096

    def units(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Prefix hash over units, first unit of each row, and byte start and end of each unit."""
        if not self.words:
            at = np.arange(len(buf))
            return prefix_hash(buf), off, at, at + 1
        starts, ends, first = word_spans(buf, off)
        return prefix_hash(span_hash(prefix_hash(buf), starts, ends)), first, starts, ends

    def anchors(self, prefix: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, first unit in the row, units, anchor's key, anchor's offset and content hash of every segment."""
        n, width = len(prefix) - 1, self.length - self.gram + 1
        grams = np.arange(max(0, n - self.gram + 1), dtype=np.int64)
        empty = np.zeros(0, dtype=np.int64)
        if n < self.length:
            return empty, empty, empty, empty.astype(np.uint64), empty, empty.astype(np.uint64)
        keys = span_hash(prefix, grams, grams + self.gram)
        least = (keys & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
        have = 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        starts = np.arange(len(least))
        row = np.searchsorted(first, starts, side="right") - 1
        starts = starts[starts + self.length <= first[row + 1]]
        if not len(starts):
            return empty, empty, empty, empty.astype(np.uint64), empty, empty.astype(np.uint64)
        anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        begin, end = starts[new], starts[np.append(new[1:], len(starts)) - 1] + self.length
        row = np.searchsorted(first, begin, side="right") - 1
        return row, begin - first[row], end - begin, keys[anchor[new]], anchor[new] - begin, span_hash(prefix, begin, end)


def packed_texts(docs: DataFrame) -> DataFrame:
    """rid and the compressed text, so that shuffles of whole texts stay small."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                texts = part.column("text").cast(pa.large_binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array([None if x is None else squeeze(x) for x in texts.to_pylist()], pa.binary())], names=[*part.schema.names[:-1], "z"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return mapped(docs, pack, f"{schema}, z binary")


def unpacked(column: pa.Array) -> pa.Array:
    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([None if x is None else expand(x) for x in column.to_pylist()], pa.large_binary())


def by_bytes(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch with their texts, with about limit bytes of text each."""
    for part in slices(batch, "z", limit // 4):
        yield part, unpacked(part.column("z"))


def _found(docs: DataFrame, how: Repeats) -> DataFrame:
    """Every segment: rid, loc (first unit * 2^32 + units), key, offset of the anchor, content hash seg."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                prefix, first, _, _ = how.units(*text_bytes(part.column("text")))
                row, start, units, key, offset, seg = how.anchors(prefix, first)
                columns = (np.asarray(part.column("rid"))[row], (start << 32) | units, key.view(np.int64), seg.view(np.int64))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array(offset, pa.int32())], ["rid", "loc", "key", "seg", "offset"])

    return mapped(docs.select("rid", "text"), find, "rid long, loc long, key long, seg long, offset int")


def _segment_texts(wanted: DataFrame, packed_docs: DataFrame, how: Repeats) -> DataFrame:
    """wanted (key, seg, n, nd, offset, rid, loc) with the bytes of each segment, read from its document."""
    per = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "seg", "n", "nd", "offset", "loc")).alias("segs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in by_bytes(batch):
                buf, off = text_bytes(texts)
                _, first, starts, ends = how.units(buf, off)
                raw, out = buf.tobytes(), []
                for i, segs in enumerate(part.column("segs").to_pylist()):
                    for s in segs:
                        a = int(first[i]) + (s["loc"] >> 32)
                        z = a + (s["loc"] & 0xFFFFFFFF)
                        out.append((s["key"], s["seg"], s["n"], s["nd"], s["offset"], b" ".join(raw[starts[a] : ends[z - 1]].split()) if how.words else raw[a:z]))
                columns = list(zip(*out, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "seg", "n", "nd", "offset", "text"])

    texts = packed_docs.groupBy("rid").agg(F.first("z").alias("z"))
    return mapped(texts.join(per, "rid"), cut, "key long, seg long, n long, nd long, offset int, text binary")


def _indexed(segments: DataFrame, how: Repeats, index: Index) -> DataFrame:
    """Spans of the segments of keys small enough for one index: key, seg, a, b."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def flush() -> pa.RecordBatch:
            spans = index([(t, n, o) for _, n, o, t in held], how)
            rows = [(key, h[0], *s) for h, s in zip(held, spans, strict=True) if s is not None]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["key", "seg", "a", "b"])

        for batch in batches:
            done = []
            for k, *rest in zip(*(batch.column(c).to_pylist() for c in ("key", "seg", "n", "offset", "text")), strict=True):
                if k != key and held:
                    done.append(flush())
                    held = []
                key = k
                held.append(tuple(rest))
            yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else ()
        if held:
            yield flush()

    return mapped(segments.repartition("key").sortWithinPartitions("key", "seg"), decide, "key long, seg long, a long, b long")


def _counted(segments: DataFrame, how: Repeats) -> DataFrame:
    """The same for keys of any size: windows are counted by content hash over the cluster."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prefix, first, _, _ = how.units(*text_bytes(part.column("text")))
                at = np.arange(max(0, len(prefix) - how.length))
                row = np.searchsorted(first, at, side="right") - 1
                fits = at + how.length <= first[row + 1] if len(at) else np.zeros(0, bool)
                at, row = at[fits], row[fits]
                of = (np.asarray(part.column(c))[row] for c in ("key", "seg", "n"))
                columns = (span_hash(prefix, at, at + how.length).view(np.int64), *of, at - first[row])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["window", "key", "seg", "n", "at"])

    each = mapped(segments.select("key", "seg", "n", "text"), windows, "window long, key long, seg long, n long, at long")
    twice = written(each.groupBy("window").agg(F.sum("n").alias("copies")).where("copies > 1").select("window"))
    return each.join(twice, "window").groupBy("key", "seg").agg(F.min("at").alias("a"), (F.max("at") + how.length).alias("b"))


def repeated_spans(docs: DataFrame, how: Repeats, index: Index) -> DataFrame:
    """rid and spans (first * 2^32 + units, in units of the text) of all repeated windows, a written table; docs: rid, text.

    Rows of one text have one rid: their segments are added up before anything else, so that copies, however many,
    are one row from there on."""
    units, first = F.col("loc").bitwiseAND(0xFFFFFFFF), F.shiftright("loc", 32)
    with scope() as keep:
        places = written(_found(docs, how).groupBy("key", "seg", "rid", "loc", "offset").agg(F.count("*").alias("copies")))
        per_key = places.groupBy("key").agg(F.sum("copies").alias("copies"), F.min("seg").alias("lo"), F.max("seg").alias("hi")).where("copies > 1")
        per_key = written(per_key.select("key", (F.col("lo") == F.col("hi")).alias("alike")))
        shared = written(places.join(per_key, "key"))
        whole = shared.where("alike").select("rid", (first * 4294967296 + units).alias("span"))
        distinct = shared.where("not alike").groupBy("key", "seg").agg(F.sum("copies").alias("n"), F.min(F.struct("rid", "loc", "offset")).alias("at"))
        distinct = written(distinct.select("key", "seg", "n", "at.*"))
        sizes = written(distinct.groupBy("key").agg(F.count("*").alias("nd")))
        wanted = distinct.join(sizes, "key").select("key", "seg", "n", "nd", "rid", "loc", "offset")
        segments = written(_segment_texts(wanted, packed_texts(docs.select("rid", "text")), how))
        spans = written(_indexed(segments.where(F.col("nd") <= how.group), how, index).unionByName(_counted(segments.where(F.col("nd") > how.group), how)))
        partial = shared.where("not alike").join(spans, ["key", "seg"]).select("rid", ((first + F.col("a")) * 4294967296 + F.col("b") - F.col("a")).alias("span"))
        return keep(whole.unionByName(partial).groupBy("rid").agg(F.collect_list("span").alias("spans")))


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the packed spans cover."""
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate((spans >> 32) + (spans & 0xFFFFFFFF)) if len(spans) else spans
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1]))) if len(spans) else np.zeros(0, np.int64)
    return start[new], end[np.append(new[1:], len(spans)) - 1] if len(spans) else end


def remove_repeats(docs: DataFrame, keep: list[str], how: Repeats, index: Index, result: Callable[..., dict], schema: str) -> DataFrame:
    """keep's columns and what result() makes of each text and its removed runs (byte starts and ends of units). Texts
    are told apart by 64-bit hashes."""
    rows = docs.select(F.xxhash64("text").alias("rid"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), "text")
    spans = repeated_spans(rows, how, index)
    names = [x.split()[0] for x in schema.split(",")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in by_bytes(batch):
                buf, off = text_bytes(texts)
                _, first, starts, ends = how.units(buf, off)
                out = []
                for i, s in enumerate(part.column("spans").to_pylist()):
                    a, b = merged(np.asarray(s or [], dtype=np.int64))
                    lo, hi = int(first[i]), int(first[i + 1])
                    raw = buf[off[i] : off[i + 1]].tobytes() if texts[i].is_valid else None
                    out.append(result(raw, starts[lo:hi] - off[i], ends[lo:hi] - off[i], a, b))
                columns = [pa.array([o[n] for o in out], kinds[n]) for n in names]
                yield pa.RecordBatch.from_arrays([part.column("kept"), *columns], ["kept", *names])

    kinds = {"long": pa.int64(), "string": pa.string()}
    kinds = {n: kinds[x.split()[1]] for n, x in zip(names, schema.split(","), strict=True)}
    joined = packed_texts(rows.select("rid", "kept", "text")).join(spans, "rid", "left")
    return mapped(joined, apply, f"kept {rows.schema['kept'].dataType.simpleString()}, {schema}").select("kept.*", *names)
