"""Phrase collocation mining on a weighted de Bruijn graph of words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, mapped, mix, prefix_hash, scope, slices, span_hash, text_bytes, word_spans, written

LONGEST = 5
UNKNOWN = "und"
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".,;:!?", 10, 11, 12, 13]] = True
_BETWEEN = _STOP.copy()
_BETWEEN[[9, 32]] = True
#: Cells of the pair table go over in chunks of so many.
_CHUNK = 1 << 16


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start, end and row of each word, and whether the next word stands in the same piece."""
    buf, off = text_bytes(part.column("text"))
    buf = lower_ascii(buf)
    starts, ends, first = word_spans(buf, off, _BETWEEN)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    linked = np.zeros(len(starts), dtype=bool)
    if len(starts) > 1:
        stops = np.cumsum(_STOP[buf])
        linked[:-1] = (row[1:] == row[:-1]) & (stops[starts[1:]] == stops[starts[:-1]])
    return buf, starts, ends, row, linked


def _cells(part: pa.RecordBatch, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, bits: int) -> np.ndarray:
    """A cell of the pair table for each word, the next one and the language."""
    salts = {lang: zlib.crc32(lang.encode()) + 1 for lang in set(part.column("lang").to_pylist())}
    salt = np.array([salts[x] for x in part.column("lang").to_pylist()], dtype=np.uint64)[row]
    h = span_hash(prefix_hash(buf), starts, ends)
    after = np.append(h[1:], np.uint64(0))
    return (mix(h * np.uint64(0x9E3779B97F4A7C15) + mix(after ^ (salt << np.uint64(17)))) >> np.uint64(64 - bits)).astype(np.uint32)


def frequent_pairs(texts: DataFrame, least: int, bits: int) -> np.ndarray:
    """A bit for each of 2^bits cells of hashed (lang, word, next word): whether its pairs occur `least` times together.

    A pair whose bit is 0 is rarer than that. Each task counts into one saturating byte a cell; chunks of these tables
    are added up over the cluster as they come. What reaches the driver is 2^bits bits, however many texts there are."""
    top, chunk = min(least, 255), min(_CHUNK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, waiting = np.zeros(1 << bits, dtype=np.uint8), []

        def add() -> None:
            cell, n = np.unique(np.concatenate(waiting), return_counts=True)
            table[cell] = np.minimum(table[cell] + n, top)
            waiting.clear()

        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                buf, starts, ends, row, linked = _words(part)
                waiting.append(_cells(part, buf, starts, ends, row, bits)[linked])
                if sum(map(len, waiting)) >= 1 << 21:
                    add()
        if waiting:
            add()
        parts = table.reshape(-1, chunk)
        for no in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([zlib.compress(parts[no].tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for no, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = sums.setdefault(no, np.zeros(chunk, dtype=np.uint16))
                np.minimum(own + np.frombuffer(zlib.decompress(packed), np.uint8), top, out=own)
        for no, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([np.packbits(own >= top).tobytes()], pa.binary())], ["chunk", "bits"])

    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in mapped(mapped(texts, count, "chunk int, counts binary").repartition("chunk"), merge, "chunk int, bits binary").collect():
        out[r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def edges(texts: DataFrame, least: int, bits: int = 24) -> DataFrame:
    """lang, m, phrase, n: the graph's edges, which are runs of LONGEST words, and the ends of pieces, which are shorter.

    Each word of each piece stands at the head of one run. Pieces are cut between words that frequent_pairs() shows to
    stand together fewer than `least` times, as no phrase that occurs so often holds such a pair; counts of phrases
    that do are not changed by that, as all their runs are whole."""
    known = frequent_pairs(texts, least, bits)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                buf, starts, ends, row, linked = _words(part)
                cell = _cells(part, buf, starts, ends, row, bits)
                linked &= ((known[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)
                size, more = np.ones(len(starts), dtype=np.int32), linked.copy()
                for k in range(1, LONGEST):
                    size += more
                    more[: len(more) - k] &= linked[k:]
                    more[len(more) - k :] = False
                # all words, each followed by one blank; a run is a slice of that
                length = ends - starts
                text = np.full(int(length.sum()) + len(length), 32, dtype=np.uint8)
                text[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = buf[~_BETWEEN[buf]]
                at = np.cumsum(length + 1) - (length + 1)
                last = np.arange(len(starts)) + size - 1
                span = at[last] + length[last] - at
                offsets = np.concatenate(([0], np.cumsum(span)))
                data = text[np.repeat(at - offsets[:-1], span) + np.arange(int(offsets[-1]))]
                run = pa.StringArray.from_buffers(len(span), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
                lang = part.column("lang").dictionary_encode()
                found = pa.table({"lang": lang.indices.take(pa.array(row)), "m": pa.array(size), "phrase": run}).group_by(["lang", "m", "phrase"], use_threads=False).aggregate([([], "count_all")])
                for b in found.combine_chunks().to_batches(max_chunksize=100_000):
                    yield pa.RecordBatch.from_arrays([lang.dictionary.take(b.column("lang")), b.column("m"), b.column("phrase"), b.column("count_all")], ["lang", "m", "phrase", "n"])

    runs = mapped(texts, measure, "lang string, m int, phrase string, n long")
    return runs.groupBy("lang", "m", "phrase").agg(F.sum("n").alias("n"))


def node_counts(graph: DataFrame) -> DataFrame:
    """lang, m, phrase, n of all runs of 1 to LONGEST words that stand in a cut piece.

    A run occurs as often as what flows out of its node along edges of one more word, and as it ends a piece."""
    keep = ["lang", "m", "phrase", "n"]
    level = every = graph.where(F.col("m") == LONGEST).select(*keep)
    for m in range(LONGEST - 1, 0, -1):
        flow = level.select("lang", F.lit(m).alias("m"), some_words(F.col("phrase"), F.lit(m)).alias("phrase"), "n")
        level = written(flow.unionByName(graph.where(F.col("m") == m).select(*keep)).groupBy("lang", "m", "phrase").agg(F.sum("n").alias("n")))
        every = every.unionByName(level)
    return every


def some_words(phrase: Column, n: Column) -> Column:
    """The first n words, or the last -n."""
    return F.call_function("substring_index", phrase, F.lit(" "), n)


def compacted(counts: DataFrame) -> DataFrame:
    """Phrases of two words or more that aren't inner parts of a unary path.

    A node whose whole flow goes on along one edge, or comes in along one, is one with that edge: the path's longer
    phrase occurs as often and stands for it. If a phrase of more words holds this one as often, so does one of one
    more word; so that neighbours in the graph decide, and paths need not be walked."""
    ends = F.array(some_words(F.col("phrase"), F.col("m") - 1), some_words(F.col("phrase"), 1 - F.col("m")))
    inner = counts.where("m > 2").select("lang", F.explode(ends).alias("phrase"), "n")
    return counts.where("m > 1").join(inner, ["lang", "phrase", "n"], "left_anti")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, bits: int = 24) -> DataFrame:
    """The `top` phrases of each language by how much oftener they occur than their parts suggest.

    A-Z are lower-cased, texts split into pieces and words. Phrases have 2 to LONGEST words and occur `least` times or
    more (a) within pieces; they are scored by their worst cut into parts of l and r occurrences, floor(1000 * a * n /
    (l * r)) with n words in the language, in decimals of 38 digits, ties to the shortest first part. A phrase that
    stands within a longer one as often is left out. Only runs of LONGEST words and ends of pieces are counted over
    texts; the graph gives all shorter counts.

    Defined results: null and empty texts have no words; a null language is `und`; repeated rows count each time; an
    empty table gives no rows; other columns are ignored. Returns lang, rank, phrase, a, l, r, n, score."""
    with scope() as keep:
        texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
        graph = written(edges(texts, least, bits))
        total = graph.groupBy("lang").agg(F.sum("n").alias("words"))
        frequent = written(node_counts(graph).where(F.col("n") >= least))
        cut = compacted(frequent).select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
        cut = cut.withColumn("first", some_words(F.col("phrase"), F.col("k"))).withColumn("rest", F.substr("phrase", F.length("first") + 2))
        part = lambda name, count: frequent.where(F.col("m") < LONGEST).select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
        parted = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
        wide = lambda c: f"cast({c} as decimal(19,0))"
        score = F.expr(f"({wide('a')} * {wide('words')} * 1000) div ({wide('l')} * {wide('r')})")
        worst = parted.groupBy("lang", "phrase", "a", F.col("words").alias("n")).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w"))
        best = Window.partitionBy("lang").orderBy(F.desc("w.score"), F.desc("a"), "phrase")
        ranked = worst.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        return keep(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "w.l", "w.r", "n", "w.score"))


ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(greatest(0, len(words) - m + 1)), lambda i: array_to_string(words[i + 1 : i + m], ' '))) AS phrase FROM w, range(1, 6) t(m)),
f AS (SELECT lang, CAST(m AS INTEGER) AS m, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND n >= 100),
d AS (SELECT s.lang, s.phrase FROM c s JOIN c q ON q.lang = s.lang AND q.m > s.m AND q.n >= s.n AND contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' ')),
k AS (SELECT c.*, k, array_to_string(string_split(phrase, ' ')[: k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS tail FROM c ANTI JOIN d USING (lang, phrase), range(1, 5) t(k) WHERE k < m),
s AS (SELECT k.lang, k.phrase, k.n AS a, k.k, x.n AS l, y.n AS r, t.n, CAST((1000 * CAST(k.n AS HUGEINT) * t.n) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.tail JOIN t ON t.lang = k.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS c FROM s),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE c = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000
"""
