"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, mapped, prefix_hash, slices, span_hash, text_bytes, word_spans

STATISTICS = ("log_words", "log_bytes", "word_length", "longest_word", "upper", "digit", "symbol", "bang", "comma_stop", "other_punctuation", "high_byte", "newline", "distinct_words", "repeated_triples", "repeated_lines", "capital_words", "upper_words", "symbol_words", "short_words", "line_words")

_KIND = np.zeros(256, dtype=np.uint8)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\"'()[]{}/\\=+-_@~^`", bytes(range(128, 256)), b"\n"), 1):
    _KIND[list(_set)] = _i


def _repeated(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per row: how many hashes equal an earlier one of the same row."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    return np.bincount(d[1:][same], minlength=n)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The STATISTICS of each whole text; an empty text has zeros."""
    n = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 9 + _KIND[buf], minlength=n * 9).reshape(n, 9)[:, 1:].astype(np.float64)
    starts, ends, first = word_spans(buf, off)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(np.float64)
    prefix = prefix_hash(buf)
    h = span_hash(prefix, starts, ends)
    triple = np.arange(max(0, len(h) - 2))
    triple = triple[doc[triple] == doc[triple + 2]] if len(triple) else triple
    grams = span_hash(prefix_hash(h), triple, triple + 3)
    newline = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate((off[:-1][size > 0], newline + 1)))
    line_start = line_start[line_start < len(buf)]
    line_end = np.minimum(np.append(line_start[1:], len(buf)), len(buf))
    holds = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[holds], line_end[holds]
    line_end = np.where((line_end > line_start) & (buf[line_end - 1] == 10), line_end - 1, line_end) if len(line_end) else line_end
    line_doc = row[line_start] if len(line_start) else np.zeros(0, np.int64)
    lines = np.bincount(line_doc, minlength=n)
    per = lambda x: np.bincount(doc, x.astype(np.float64), minlength=n) / np.maximum(words, 1)
    upper, symbol = np.concatenate(([0], np.cumsum(_KIND[buf] == 1))), np.concatenate(([0], np.cumsum(_KIND[buf] == 3)))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    s = np.maximum(size, 1)
    return np.column_stack([
        np.log1p(words), np.log1p(size), per(length), np.log1p(longest), *(kinds[:, i] / s for i in range(8)),
        1 - _repeated(h, doc, n) / np.maximum(words, 1), _repeated(grams, doc[triple], n) / np.maximum(words, 1),
        _repeated(span_hash(prefix, line_start, line_end), line_doc, n) / np.maximum(lines, 1),
        per(_KIND[buf[starts]] == 1), per((upper[ends] - upper[starts]) * 2 > length), per(symbol[ends] > symbol[starts]), per(length <= 2), words / np.maximum(lines, 1),
    ]).astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth, flattened: node i of a tree has children 2i+1 and 2i+2; edges: bin limits."""

    edges: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = np.column_stack([np.searchsorted(self.edges[:, j], x[:, j], side="right") for j in range(x.shape[1])]).astype(np.int16) if len(x) else np.zeros(x.shape, np.int16)
        total = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1]))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > limit[node])
            total += leaf[node - (leaf.shape[0] - 1)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, n_bins: int = 64, l2: float = 2.0) -> Trees:
    """Fit by second-order gradients of the logistic loss, over histograms of quantile bins."""
    edges = np.quantile(x, np.linspace(0, 1, n_bins + 1)[1:-1], axis=0) if len(x) else np.zeros((n_bins - 1, x.shape[1]))
    bins = np.column_stack([np.searchsorted(edges[:, j], x[:, j], side="right") for j in range(x.shape[1])])
    p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    total, width = np.full(len(y), base), x.shape[1]
    nodes = (1 << depth) - 1
    feature, limit, leaf = np.zeros((rounds, nodes), np.int64), np.full((rounds, nodes), n_bins, np.int64), np.zeros((rounds, 1 << depth))
    flat = bins + np.arange(width) * n_bins
    for t in range(rounds if len(y) else 0):
        q = 1 / (1 + np.exp(-total))
        g, h = y - q, q * (1 - q)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            n, first = 1 << level, (1 << level) - 1
            key = ((node - first)[:, None] * (width * n_bins) + flat).ravel()
            hist = [np.bincount(key, np.repeat(v, width), minlength=n * width * n_bins).reshape(n, width, n_bins).cumsum(2) for v in (g, h)]
            left_g, left_h = hist
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
            gain[(left_h < 1e-2) | (all_h - left_h < 1e-2)] = 0
            best = gain.reshape(n, -1).argmax(1)
            split = gain.reshape(n, -1).max(1) > 1e-9
            feature[t, first : first + n] = best // n_bins
            limit[t, first : first + n] = np.where(split, best % n_bins, n_bins)
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature[t, node]] > limit[t, node])
        at = node - nodes
        leaf[t] = rate * np.bincount(at, g, minlength=1 << depth) / (np.bincount(at, h, minlength=1 << depth) + l2)
        total += leaf[t][at]
    return Trees(edges, feature, limit, leaf, base)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns as the struct `kept`, and the array x of STATISTICS."""
    sent = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(*text_bytes(part.column("text")))
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), len(STATISTICS)).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("kept"), values], ["kept", "x"])

    return mapped(sent, measure, f"kept {sent.schema['kept'].dataType.simpleString()}, x array<float>")


def fit(docs: DataFrame, labels: DataFrame, is_train: Column, most: int = 20_000) -> Trees:
    """Learn `quality` from at most about `most` labelled rows: those whose id hash falls below most / rows.

    Only ids and labels of the sample, which that parameter bounds, are broadcast to the scan of documents; an id with
    several labels counts once, with the highest, and one with several texts with the one of least hash, so that what
    comes to the driver has the same bound."""
    usable = labels.where(is_train & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = usable.count()
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(place < most / max(n, 1)).select(F.col("doc_id").alias("label_id"), "quality").limit(2 * most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = sorted((r["kept"]["doc_id"], r["kept"]["quality"], r["x"]) for r in with_statistics(rows, ["doc_id", "quality"]).collect())
    x = np.array([r[2] for r in got], dtype=np.float32).reshape(len(got), len(STATISTICS))
    return boost(x, np.array([r[1] for r in got], dtype=np.float64))


def score(docs: DataFrame, model: Trees, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """keep's columns with score (0 to 1, higher: quality 1 is likelier) and predicted (1 from the threshold on).

    Defined results: a null or empty text has statistics of zero and is scored like any other; without any label
    the score is 0.5; an empty table gives no rows; repeated rows are scored alike."""
    sent = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), "text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = model.score(statistics(*text_bytes(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(p, pa.float64()), pa.array(p >= threshold).cast(pa.int32())], ["kept", "score", "predicted"])

    return mapped(sent, predict, f"kept {sent.schema['kept'].dataType.simpleString()}, score double, predicted int").select("kept.*", "score", "predicted")


def score_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labels of documents that are not held out."""
    model = fit(docs, labels, ~held_out("doc_id", 5, 0))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
