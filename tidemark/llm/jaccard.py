"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

A node is a distinct set of word shingles, so copies cost nothing. Two sets whose similarity reaches the threshold
share a shingle among the first n - ceil(threshold * n) + 1 of each in any common order. The order here puts frequent
shingles last and is by hash else, so that passages which many documents share make no candidates.

1. One scan gives each document its set's hash, size and bitmap signature, and shingles that recur within some
   thousand texts with the least set that has them.
2. Frequent shingles are those with the highest summed counts; at most `most_frequent` go to the second scan, the
   count from which a shingle is frequent being raised until they fit. Any choice gives the same result.
3. A second scan takes the prefix shingles. Frequent ones know the key of their group (the least set found with them)
   and are never gathered. Others are dealt by low bits of their hashes, one packed row per such range and batch; there,
   sets with a common shingle and near enough sizes form a group, named by its least set. Near copies of one text
   have one group for most of their shingles, so there are far fewer rows than shingles. The first shingle that two
   linked sets have in common is among the first n - ceil(2 * threshold / (1 + threshold) * n) + 1 of the one that is
   not larger, so sets that have a shingle further back are in a group only behind such a set.
4. Groups are cut into tiles by size band; a set is also a visitor of the next band's tile, as linked sizes differ by
   4/3 at most. Each set is compared, exactly, with the centre of the tiles it shares most. That joins near copies
   of one text without pairing all of them. Large tiles have further rounds among the sets left over.
5. In tiles that still hold several components, sets of different components are compared by bitmaps: bits set in
   one and not in the other bound the overlap from above. Rows outside the component of the tile's centre go to every
   chunk of the tile, so a large tile is spread over tasks and its members of one component are never paired.
6. Sets that keep a partner are intersected exactly in their chunks; of the links a chunk finds, a forest goes on.
   Links give components.
7. As components are closed under links, all links between different sets are found by comparing each component's
   sets in pairs of blocks, exactly. That is done only where links or their numbers are asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, mapped, mix, prefix_hash, scope, slices, span_hash, text_bytes, word_spans, written
from tidemark.llm.repeats import by_bytes, packed_texts, unpacked

#: Rows of a tile's chunk and shingles of them, and rows from which a tile counts as large.
CHUNK, CHUNK_SHINGLES, LARGE = 1024, 1_000_000, 64
#: Sets of a component that are compared with as many others in one go, their shingles, and shingles at a time.
BLOCK, BLOCK_SHINGLES, SPAN = 256, 500_000, 4096
#: Prefix shingles that one range of hashes should hold, and shingles that a scan holds.
RANGE, HELD = 500_000, 1_000_000
#: Pairs whose ids are sent to all tasks at most (16 bytes each).
MOST_SENT = 500_000
#: Occurrences within HELD shingles from which a shingle is counted.
RECURS = 4

_TILE = ["key", "band", "chunk"]


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: n words, or the whole text's words if fewer (none: empty)."""
    starts, ends, first = word_spans(buf, off)
    words = span_hash(prefix_hash(lower_ascii(buf)), starts, ends)
    prefix, out = prefix_hash(words), []
    begin = np.arange(max(0, len(words) - n + 1))
    every = span_hash(prefix, begin, begin + n)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= n:
            s = np.sort(every[a : z - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(span_hash(prefix, np.array([a]), np.array([z])) if z > a else np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> int:
    return int(mix(prefix_hash(s)[-1:] + np.uint64(len(s)))[0].view(np.int64)) if len(s) else 0


def least_overlap(n: int, percent: int) -> int:
    """The smallest intersection that a set of n can have with any set it links with."""
    return -(-percent * n // 100)


def leading(n: np.ndarray, percent: int) -> np.ndarray:
    """Among how many first shingles of a set of n is the first one in common with a set it links with and is no larger
    than: of two sets, no smaller than n each, that link, at least 2 * threshold / (1 + threshold) * n are in both."""
    return n + (-2 * percent * n // (100 + percent)) + 1


def band(n: int, percent: int) -> int:
    """Bands such that linked sets are in the same or neighbouring ones: each spans a factor of 100 / percent."""
    at, limit = 0, 1.0
    while limit * 100 / percent <= n:
        limit *= 100 / percent
        at += 1
    return at


def width(of_band: int, percent: int) -> int:
    """Bits of the signatures in a band: a power of two of about twice the sets' size, 64 to 32768."""
    return 1 << min(15, max(6, int(np.ceil(of_band * np.log2(100 / percent))) + 1))


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, dtype=bool)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(maps: np.ndarray, bits: int) -> np.ndarray:
    """The same signatures with fewer bits."""
    while maps.shape[1] * 64 > bits:
        maps = maps[:, : maps.shape[1] // 2] | maps[:, maps.shape[1] // 2 :]
    return maps


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test by the intersection of two sorted arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 18):
            yield part, shingle_sets(*text_bytes(part.column("text")), n)


def _first_scan(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per document (id, rid, n, sig, map), and rows (token, copies, least) for shingles that recur."""
    names = ["id", "rid", "n", "sig", "map", "token", "copies", "least"]
    kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        of: list[int] = []

        def recurring() -> pa.RecordBatch:
            tokens, sig = np.concatenate(held), np.repeat(np.array(of, dtype=np.int64), [len(s) for s in held])
            order = np.argsort(tokens, kind="stable")
            tokens, sig = tokens[order], sig[order]
            first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            copies = np.diff(np.append(first, len(tokens)))
            often = copies >= RECURS
            none = [pa.nulls(int(often.sum()), k) for k in kinds[:5]]
            return pa.RecordBatch.from_arrays([*none, pa.array(tokens[first][often].view(np.int64)), pa.array(copies[often], pa.int64()), pa.array(np.minimum.reduceat(sig, first)[often])], names)

        for part, sets in _batches(batches, n):
            sigs = list(map(set_hash, sets))
            maps = [bitmap(s, width(band(len(s), percent), percent)).tobytes() if len(s) else None for s in sets]
            none = [pa.nulls(len(part), k) for k in kinds[5:]]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("rid"), pa.array(map(len, sets), kinds[2]), pa.array(sigs, kinds[3]), pa.array(maps, kinds[4]), *none], names)
            full = [(s, x) for s, x in zip(sigs, sets, strict=True) if len(x)]
            of += [s for s, _ in full]
            held += [x for _, x in full]
            if sum(map(len, held)) > HELD:
                yield recurring()
                held, of = [], []
        if held:
            yield recurring()

    return mapped(rows, scan, "id long, rid long, n long, sig long, map binary, token long, copies long, least long")


def _frequent(counts: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles counted least often enough, with the limit doubled until at most `most` stay, and
    the least set found with each."""
    totals = written(counts.groupBy("token").agg(F.sum("copies").alias("copies"), F.min("least").alias("key")).where(F.col("copies") >= least))
    sizes = {r["p"]: r["n"] for r in totals.groupBy(F.floor(F.log2("copies")).alias("p")).agg(F.count("*").alias("n")).collect()}
    limit = least
    if sum(sizes.values()) > most:
        limit = 1 << next(p for p in range(min(sizes), max(sizes) + 2) if sum(n for q, n in sizes.items() if q >= p) <= most)
    found = totals.where(F.col("copies") >= limit).select("token", "key").toArrow()
    tokens, keys = np.asarray(found["token"], dtype=np.int64).view(np.uint64), np.asarray(found["key"], dtype=np.int64)
    order = np.argsort(tokens)
    return tokens[order], keys[order]


def _counted(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one of each different pair (first[i], second[i]), and how often it is there."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    return order[new], np.diff(np.append(new, len(a)))


def _prefixes(rows: DataFrame, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], ranges: int) -> DataFrame:
    """Packed rows of the prefix shingles of every set, once per set and batch: range, ready, and arrays of sets (sig,
    n, how many of the values are theirs) and of values, which are keys of groups where ready, or else 31 bits of each
    shingle above those of the range, and as the lowest bit whether it is a leading() one: shingles that agree in them by
    chance only make groups larger. Sizes and counts are small numbers and are compressed."""
    low, bits = np.uint64(ranges - 1), np.uint64(ranges.bit_length() - 1)
    names, kinds = ["range", "ready", "sigs", "sizes", "counts", "values"], [pa.int64(), pa.bool_()] + [pa.binary()] * 4

    def packed(at: int, ready: bool, sig: np.ndarray, size: np.ndarray, counts: np.ndarray, values: np.ndarray) -> tuple:
        return at, ready, sig.tobytes(), *(zstandard.compress(x.astype(np.int32).tobytes(), 1) for x in (size, counts)), values.tobytes()

    def dealt(sigs: list[int], sets: list[np.ndarray], turn: int) -> list[tuple]:
        sig, size = np.array(sigs, dtype=np.int64), np.array([len(s) for s in sets], dtype=np.int64)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        place = np.searchsorted(frequent[0], tokens)
        often = frequent[0][np.minimum(place, len(frequent[0]) - 1)] == tokens if len(frequent[0]) else np.zeros(len(tokens), bool)
        begin, least = np.cumsum(size) - size, size + (-percent * size // 100) + 1
        rank = np.cumsum(~often)
        rank -= (rank - ~often)[begin][owner]
        rare = np.bincount(owner, weights=~often, minlength=len(sets)).astype(np.int64)
        late = np.cumsum(often)
        late -= (late - often)[begin][owner]
        keep, sure = ~often & (rank <= least[owner]), often & (late <= (least - rare)[owner])
        out = []
        if sure.any():
            key, who = frequent[1][place[sure]], owner[sure]
            one, counts = _counted(key, who)
            out.append(packed(turn, True, sig[who[one]], size[who[one]], counts, key[one]))
        tokens, owner, lead = tokens[keep], owner[keep], (rank <= leading(size, percent)[owner])[keep]
        # by low bits: the prefix holds a set's least hashes, so high bits would fill the first ranges only
        at = (tokens & low).astype(np.int64)
        order = np.argsort(at, kind="stable")
        tokens, owner, at, lead = tokens[order], owner[order], at[order], lead[order]
        values = ((tokens >> bits).astype(np.uint32) & ~np.uint32(1)) | lead.astype(np.uint32)
        cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))).tolist() if len(at) else []
        for i, z in zip(cuts, [*cuts[1:], len(at)], strict=True):
            who = owner[i:z]
            new = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            out.append(packed(int(at[i]), False, sig[who[new]], size[who[new]], np.diff(np.append(new, z - i)), values[i:z]))
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, sigs, sets, known, total = 0, [], [], set(), 0

        def done() -> pa.RecordBatch:
            columns = list(zip(*dealt(sigs, sets, turn % ranges), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for _, found in _batches(batches, n):
            for s in found:
                if len(s) and (sig := set_hash(s)) not in known:
                    known.add(sig)
                    sigs.append(sig)
                    sets.append(s)
                    total += len(s)
            if total > HELD:
                yield done()
                turn, sigs, sets, known, total = turn + 1, [], [], set(), 0
        if sets:
            yield done()

    return mapped(rows.select("text"), scan, "range long, ready boolean, sigs binary, sizes binary, counts binary, values binary")


def _groups(prefixes: DataFrame, ranges: int, percent: int) -> DataFrame:
    """key, sig, n and tokens (the shingles) of sets that have a prefix shingle in common with others of a near size, of
    which one that is not larger has it as a leading() one, or is such a one."""

    def common(t: np.ndarray, sig: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        t, lead = t >> np.uint32(1), (t & np.uint32(1)).astype(bool)
        # of equal sizes, sets with a leading shingle are first: all that stand before them are smaller
        order = np.lexsort((sig, ~lead, n, t))
        t, sig, n, lead = t[order], sig[order], n[order], lead[order]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (sig[1:] != sig[:-1])))
        t, sig, n, lead = t[new], sig[new], n[new], lead[new]
        # the last set with a leading shingle up to each place, if it has the same shingle and is near in size
        last = np.maximum.accumulate(np.where(lead, np.arange(len(t)), 0))
        met = lead[last] & (t[last] == t) & (percent * n <= 100 * n[last])
        t, sig, n = t[met], sig[met], n[met]
        near = np.concatenate(([False], (t[1:] == t[:-1]) & (percent * n[1:] <= 100 * n[:-1])))[: len(t)]
        stay = near | np.append(near[1:], False)[: len(t)]
        sig, n, begins = sig[stay], n[stay], np.flatnonzero(~near[stay])
        if not len(sig):
            return sig, sig, n, n
        key = np.repeat(np.minimum.reduceat(sig, begins), np.diff(np.append(begins, len(sig))))
        one, counts = _counted(key, sig)
        return key[one], sig[one], n[one], counts

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def batch_of(columns: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "sig", "n", "tokens"])

        def done() -> pa.RecordBatch:
            t, sig, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            return batch_of(common(t, sig, n))

        for batch in batches:
            for where, ready, *raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                raw[1:3] = map(zstandard.decompress, raw[1:3])
                sig, n, counts, values = (np.frombuffer(x, dtype=k) for x, k in zip(raw, (np.int64, np.int32, np.int32, np.int64 if ready else np.uint32), strict=True))
                n = n.astype(np.int64)
                if ready:
                    yield batch_of((values, sig, n, counts.astype(np.int64)))
                    continue
                if where != at and held:
                    yield done()
                    held = []
                at = where
                held.append((values, np.repeat(sig, counts), np.repeat(n, counts)))
        if held:
            yield done()

    found = mapped(prefixes.repartition(ranges, "range").sortWithinPartitions("range"), scan, "key long, sig long, n long, tokens long")
    return found.groupBy("key", "sig").agg(F.first("n").alias("n"), F.sum("tokens").alias("tokens"))


def _tiles(groups: DataFrame, percent: int) -> DataFrame:
    """key, band, sig, n, tokens, home: each set in its own band's tile and, as a visitor, in the next one's; tiles
    where no pair can be made are left out."""
    at = _banded(percent)("n")
    both = groups.withColumn("own", at).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1))).withColumn("home", F.col("band") == F.col("own")).drop("own")
    useful = written(both.groupBy("key", "band").agg(F.count("*").alias("m"), F.count_if("home").alias("homes")).where("homes > 0 and m > 1").select("key", "band"))
    return both.join(useful, ["key", "band"])


def _verified(pairs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of node hashes that link. Up to MOST_SENT pairs, texts that none of them names are left out
    before texts are shuffled, by sending the ids to the nodes' tasks; beyond that all texts are."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, left in by_bytes(batch, 1 << 18):
                right = unpacked(part.column("y"))
                sets = zip(shingle_sets(*text_bytes(left), n), shingle_sets(*text_bytes(right), n), strict=True)
                good = pa.array([linked(x, y, percent) for x, y in sets], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(good)

    nodes = _named_by(pairs, nodes)
    joined = pairs.join(nodes.select(F.col("sig").alias("b"), F.col("z").alias("y")), "b").join(nodes.select(F.col("sig").alias("a"), "z"), "a")
    return mapped(joined.select("a", "b", "y", "z"), check, "a long, b long")


def _named_by(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    if pairs.count() > MOST_SENT:
        return nodes
    return nodes.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()), "sig", "left_semi")


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node reached) for every node of the links (a, b): least labels spread to neighbours, and
    then to where labels point, until nothing changes; the number of rounds grows with the log of the longest path."""
    edges = written(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = written(labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")))
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = written(step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")))
        labels = step.select("node", "comp")
        if step.where("comp <> old").isEmpty():
            return labels


def _stars(tiles: DataFrame) -> DataFrame:
    """For each set one pair (a, b) with the least set of the tiles that it shares most, if of another component."""
    centre = tiles.groupBy("key", "band").agg(F.min(F.struct("sig", "comp")).alias("c"), F.count_if("home").alias("homes"), F.count("*").alias("m")).where("homes > 0 and m > 1")
    centre = written(centre.select("key", "band", F.col("c.sig").alias("a"), F.col("c.comp").alias("of")))
    stars = tiles.join(centre, ["key", "band"]).where("comp <> of").groupBy(F.col("sig").alias("b"), "a").agg(F.sum("tokens").alias("tokens"))
    return stars.groupBy("b").agg(F.max_by("a", F.struct("tokens", "a")).alias("a"))


def _most(n: np.ndarray, bits: np.ndarray, m: int, more: np.ndarray | int, common: np.ndarray) -> np.ndarray:
    """The bound on the overlap of sets of n and m shingles from the bits of each and those common to both."""
    return np.minimum(n - (bits - common), m - (more - common))


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps let them link."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = lambda x: int(np.bitwise_count(x).sum())
        for batch in batches:
            good = []
            for n, x, m, y in zip(*(batch.column(c).to_pylist() for c in ("na", "ma", "nb", "mb")), strict=True):
                bits = min(len(x), len(y)) * 8
                x, y = (folded(np.frombuffer(r, dtype=np.uint64)[None, :], bits)[0] for r in (x, y))
                good.append((100 + percent) * _most(n, count(x), m, count(y), count(x & y)) >= percent * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda c: nodes.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("map").alias(f"m{c}"))
    near = (percent * F.col("na") <= 100 * F.col("nb")) & (percent * F.col("nb") <= 100 * F.col("na"))
    return mapped(pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b", "na", "ma", "nb", "mb"), scan, "a long, b long")


def _open(tiles: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the tiles that hold several components, with comp, main (the component of the tile's least set) and,
    for the tile, its rows, its shingles and its rows outside main."""
    tiles = written(tiles.drop("comp", "main", "m", "shingles", "probes").join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig")))
    several = tiles.groupBy("key", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("comp", "sig").alias("main"), F.count("*").alias("m"), F.sum("n").alias("shingles"), F.count_if("home").alias("homes"))
    several = written(several.where("lo < hi and homes > 0").drop("lo", "hi", "homes"))
    return written(tiles.join(several, ["key", "band"]).withColumn("probe", F.col("comp") != F.col("main")))


def _chunked(rows: DataFrame) -> DataFrame:
    """Rows of _open() dealt to chunks: `own` in one chunk of the tile, and where `probe` also in all others, to be
    compared with the chunk's own. A chunk has about CHUNK own rows, and fewer if they have many shingles."""
    chunks = F.ceil(F.greatest(F.col("m") / CHUNK, F.col("shingles") / CHUNK_SHINGLES))
    rows = rows.withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("chunks")))
    at = F.when(F.col("probe"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("mine"))
    rows = rows.withColumn("chunk", F.explode(at)).withColumn("own", F.col("chunk") == F.col("mine"))
    return rows.select(*_TILE, "own", "sig", "n", "comp", "home", "probe")


def _by_chunk(batches: Iterator[pa.RecordBatch], load: Callable[[pa.RecordBatch], list]) -> Iterator[tuple[tuple, list[tuple] | None, list[tuple]]]:
    """(tile, own rows, rows) of chunks sorted with own rows first: own once per chunk, and then blocks of others.

    A row is (own, sig, n, comp, home, probe, what load() makes of it)."""
    key, own, rest = None, [], []
    for batch in batches:
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            tiles = zip(*(part.column(c).to_pylist() for c in _TILE), strict=True)
            rows = zip(*(part.column(c).to_pylist() for c in ("own", "sig", "n", "comp", "home", "probe")), load(part), strict=True)
            for tile, row in zip(tiles, rows, strict=True):
                if tile != key:
                    if key is not None:
                        yield key, own, rest
                    key, own, rest = tile, [], []
                (own if row[0] else rest).append(row)
            if len(rest) >= 256:
                yield key, own, rest
                rest = []
    if key is not None:
        yield key, own, rest


class _Chunk:
    """The own rows of a chunk, and which of them may link with a row of another component."""

    def __init__(self, rows: list[tuple], maps: list[np.ndarray], bits: int, percent: int) -> None:
        self.rows, self.bits, self.percent = rows, bits, percent
        self.maps = np.concatenate([folded(m[None, :], bits) for m in maps]) if rows else np.zeros((0, bits // 64), np.uint64)
        self.count = np.bitwise_count(self.maps).sum(1).astype(np.int64)
        self.n, self.comp = np.array([r[2] for r in rows], dtype=np.int64), np.array([r[3] for r in rows], dtype=np.int64)
        self.home, self.probe = np.array([r[4] for r in rows], dtype=bool), np.array([r[5] for r in rows], dtype=bool)

    def partners(self, row: tuple, map_: np.ndarray, after: int = -1) -> np.ndarray:
        """Places of own rows beyond `after` whose bitmaps let them link with the row, the highest bound first."""
        _, _, n, comp, home, probe, _ = row
        may = (self.comp != comp) & (self.percent * np.maximum(self.n, n) <= 100 * np.minimum(self.n, n))
        if not home:
            may &= self.home
        if not probe:
            may &= self.probe
        may[: after + 1] = False
        at = np.flatnonzero(may)
        if not len(at):
            return at
        one = folded(map_[None, :], self.bits)[0]
        common = np.bitwise_count(self.maps[at] & one).sum(1).astype(np.int64)
        most = _most(self.n[at], self.count[at], n, int(np.bitwise_count(one).sum()), common)
        fits = (100 + self.percent) * most >= self.percent * (self.n[at] + n)
        return at[fits][np.argsort(-most[fits], kind="stable")]


def _tile_bits(tile: tuple, percent: int) -> int:
    return width(max(0, tile[1] - 1), percent)


def _possible(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of _chunked() with bitmaps (map) that keep a partner in their chunk, without the map."""
    names = [*_TILE, "own", "sig", "n", "comp", "home", "probe"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def load(part: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(x, dtype=np.uint64) for x in part.column("map").to_pylist()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk, met, out = None, None, np.zeros(0, bool), []

        def close() -> None:
            if chunk is not None:
                out.extend((*key, *chunk.rows[i][:6]) for i in np.flatnonzero(met).tolist())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(names), kinds, strict=True)], names)

        for tile, own, rest in _by_chunk(batches, load):
            if tile != key:
                close()
                key, chunk = tile, _Chunk(own, [r[6] for r in own], _tile_bits(tile, percent), percent)
                met = np.zeros(len(own), dtype=bool)
                for i, row in enumerate(own):
                    found = chunk.partners(row, row[6], i)
                    met[found] = True
                    met[i] |= len(found) > 0
            for row in rest:
                found = chunk.partners(row, row[6])
                met[found] = True
                if len(found):
                    out.append((*key, *row[:6]))
            if len(out) > 10_000:
                yield batch_of(out)
                out.clear()
        close()
        yield batch_of(out)

    schema = "key long, band int, chunk long, own boolean, sig long, n long, comp long, home boolean, probe boolean"
    return mapped(rows.repartition(*_TILE).sortWithinPartitions(*_TILE, F.desc("own")), scan, schema)


def _forest(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) of rows with texts (z): those of each chunk that join its components, found by exact intersection."""

    def load(part: pa.RecordBatch) -> list[np.ndarray]:
        return [s for p, raw in by_bytes(part, 1 << 18) for s in shingle_sets(*text_bytes(raw), n)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk, parent, out = None, None, {}, []

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def test(row: tuple, map_: np.ndarray, after: int = -1) -> None:
            for i in chunk.partners(row, map_, after).tolist():
                other = chunk.rows[i]
                if root(other[3]) != root(row[3]) and linked(row[6], other[6], percent):
                    parent[root(other[3])] = root(row[3])
                    out.append((row[1], other[1]))

        def batch_of(pairs: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for tile, own, rest in _by_chunk(batches, load):
            bits = _tile_bits(tile, percent)
            if tile != key:
                maps = [bitmap(r[6], bits) for r in own]
                key, chunk, parent = tile, _Chunk(own, maps, bits, percent), {}
                for i, row in enumerate(own):
                    test(row, maps[i], i)
            for row in rest:
                test(row, bitmap(row[6], bits))
            if len(out) > 10_000:
                yield batch_of(out)
                out.clear()
        yield batch_of(out)

    return mapped(rows.repartition(*_TILE).sortWithinPartitions(*_TILE, F.desc("own")), scan, "a long, b long")


def _links(groups: DataFrame, nodes: DataFrame, n: int, percent: int, worth: float = 0.05) -> DataFrame:
    """The components (node, comp) of the sets that link with others.

    First each set is tested with one centre. Where large tiles still hold many sets of other components, as many as
    would fill more chunks than there are rows, these are tested with a centre of their own, in rounds, as long as
    more than a share `worth` of the tests link. At last the tiles that still hold several components are compared
    whole, so no link between what is then different components is missed, however the rounds went."""
    tiles = written(_tiles(groups, percent))
    links = written(_verified(written(_bounded(_stars(tiles.withColumn("comp", F.col("sig"))), nodes, percent)), nodes, n, percent))
    comps = components(links)
    while True:
        tiles = _open(tiles, comps)
        cost = tiles.agg(F.coalesce(F.sum(F.when(F.col("probe") & (F.col("m") > LARGE), F.col("m") / CHUNK)), F.lit(0.0)).alias("spread"), F.count("*").alias("rows")).first()
        if cost["spread"] <= cost["rows"]:
            break
        pairs = written(_bounded(_stars(tiles.where(F.col("probe") & (F.col("m") > LARGE))), nodes, percent))
        found = written(_verified(pairs, nodes, n, percent))
        tests, hits = pairs.count(), found.count()
        if hits:
            links = written(links.unionByName(found))
            comps = components(links)
        if hits <= worth * tests:
            tiles = _open(tiles, comps)
            break
    rows = written(_possible(_chunked(tiles).join(nodes.select("sig", "map"), "sig"), percent))
    texts = _named_by(rows.select(F.col("sig").alias("a"), F.col("sig").alias("b")).distinct(), nodes).select("sig", "z")
    last = written(_forest(rows.join(texts, "sig"), n, percent))
    return comps if last.isEmpty() else components(written(links.unionByName(last)))


def _banded(percent: int, most: int = 1 << 40) -> Callable[[str], F.Column]:
    """SQL form of band(): counts the limits that a size reaches."""
    limits, limit = [], 1.0
    while limit * 100 / percent <= most:
        limit *= 100 / percent
        limits.append(limit)
    return lambda n: F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x <= F.col(n)))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each set on the left with each on the right."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    every = [np.concatenate([*sets, np.zeros(0, np.uint64)]) for sets in (left, right)]
    common = np.intersect1d(*every)
    sides = []
    for sets, tokens in zip((left, right), every, strict=True):
        place = np.minimum(np.searchsorted(common, tokens), max(0, len(common) - 1))
        shared = common[place] == tokens if len(common) else np.zeros(len(tokens), bool)
        row, place = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[shared], place[shared]
        order = np.argsort(place, kind="stable")
        sides.append((len(sets), row[order], place[order]))
    for first in range(0, len(common), SPAN):
        parts = []
        for count, row, place in sides:
            i, z = np.searchsorted(place, (first, first + SPAN))
            part = np.zeros((count, min(SPAN, len(common) - first)), dtype=np.float32)
            part[row[i:z], place[i:z] - first] = 1
            parts.append(part)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _within(nodes: DataFrame, comps: DataFrame, n: int, percent: int, pairs: bool) -> DataFrame:
    """All links between the sets of each component: pairs (a, b), or rows (sig, n_links) to be summed."""

    def compare(held: list[tuple]) -> Iterator[tuple[int, int]]:
        # held: home, i, j, sig, z
        sides = [[r for r in held if r[0] == r[k]] for k in (1, 2)]
        same = held[0][1] == held[0][2]
        expand = zstandard.ZstdDecompressor().decompress
        sets = [shingle_sets(*text_bytes(pa.array([expand(r[4]) for r in side], pa.large_binary())), n) for side in (sides[:1] if same else sides)]
        left, right = sets[0], sets[-1]
        both = overlaps(left, right)
        found = (100 * both >= percent * (np.array(list(map(len, left)))[:, None] + np.array(list(map(len, right)))[None, :] - both)) & (both > 0)
        if same:
            np.fill_diagonal(found, False)
        if pairs:
            for x, y in zip(*np.nonzero(np.triu(found) if same else found), strict=True):
                yield tuple(sorted((sides[0][x][3], sides[1][y][3])))
        else:
            yield from ((r[3], k) for r, k in zip(sides[0], found.sum(1).tolist(), strict=True))
            if not same:
                yield from ((r[3], k) for r, k in zip(sides[1], found.sum(0).tolist(), strict=True))

    names = ("a", "b") if pairs else ("sig", "n_links")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, out = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names)

        for batch in batches:
            for comp, i, j, home, sig, z in zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j", "home", "sig", "z")), strict=True):
                if (comp, i, j) != key and held:
                    out += compare(held)
                    held = []
                    if len(out) > 50_000:
                        yield done()
                        out = []
                key = (comp, i, j)
                held.append((home, i, j, sig, z))
        if held:
            out += compare(held)
        yield done()

    sized = comps.withColumnRenamed("node", "sig").join(nodes.select("sig", "n"), "sig")
    blocks = written(sized.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks")))
    placed = comps.withColumnRenamed("node", "sig").join(blocks, "comp").withColumn("home", F.pmod(F.xxhash64("sig"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("comp", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), "home", "sig")
    texts = placed.join(_named_by(comps.select(F.col("node").alias("a"), F.col("node").alias("b")), nodes).select("sig", "z"), "sig")
    return mapped(texts.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j"), scan, f"{names[0]} long, {names[1]} long")


def _nodes(rows: DataFrame, each: DataFrame, groups: DataFrame) -> DataFrame:
    """sig, n, z (the packed text) and map of each set in a group, from the row with the least rid. Rows of one rid are
    copies of it and have one set, so they are told apart where the join by rid has them: texts are shuffled once."""
    distinct = each.where("n > 0").groupBy("sig", "n", "map").agg(F.min("rid").alias("rid"))
    wanted = distinct.join(groups.select("sig").distinct(), "sig", "left_semi")
    return packed_texts(rows.select("rid", "text")).join(wanted, "rid").dropDuplicates(["rid"]).select("sig", "n", "z", "map")


def _joined(docs: DataFrame, id_col: str, n: int, percent: int, least_frequent: int, most_frequent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """id, n, sig and comp of every document; the nodes; and the components (node, comp) of two or more nodes."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, "text").alias("rid"), "text")
    scanned = written(_first_scan(rows, n, percent))
    each = scanned.where("n is not null").select("id", "rid", "n", "sig", "map")
    frequent = _frequent(scanned.where("token is not null"), least_frequent, most_frequent)
    shingles = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (100 - percent) // 100
    ranges = 1 << max(3, (shingles // RANGE).bit_length())
    groups = written(_groups(_prefixes(rows, n, percent, frequent, ranges), ranges, percent))
    nodes = written(_nodes(rows, each, groups))
    comps = _links(groups, nodes, n, percent)
    labelled = each.join(comps.withColumnRenamed("node", "sig"), "sig", "left").select("id", "n", "sig", F.coalesce("comp", "sig").alias("comp"))
    return written(labelled), nodes, comps


def _named(labelled: DataFrame, id_col: str, *more: str) -> DataFrame:
    least = written(labelled.where("n > 0").groupBy("comp").agg(F.min("id").alias("least")))
    out = labelled.join(least, "comp", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"), *more)


def similar_sets(docs: DataFrame, id_col: str = "doc_id", n: int = 5, percent: int = 75, least_frequent: int = 50, most_frequent: int = 200_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the smallest id reachable by links, itself included.

    Two documents link if 100 * intersection >= percent * union of their sets. Defined results: texts that are null or
    have no words have empty sets and link with nothing; repeated rows have equal sets; a null id never names a
    component that has other ids; an empty table gives no rows; other columns are ignored."""
    with scope() as keep:
        return keep(_named(_joined(docs, id_col, n, percent, least_frequent, most_frequent)[0], id_col))


def counted_links(docs: DataFrame, id_col: str = "doc_id", n: int = 5, percent: int = 75, least_frequent: int = 50, most_frequent: int = 200_000) -> DataFrame:
    """similar_sets() with n_links, the number of different sets that link with the document's own."""
    with scope() as keep:
        labelled, nodes, comps = _joined(docs, id_col, n, percent, least_frequent, most_frequent)
        counts = written(_within(nodes, comps, n, percent, pairs=False).groupBy("sig").agg(F.sum("n_links").alias("n_links")))
        return keep(_named(labelled.join(counts, "sig", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))), id_col, "n_links"))


def class_links(docs: DataFrame, id_col: str = "doc_id", n: int = 5, percent: int = 75, least_frequent: int = 50, most_frequent: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, n_shingles, component_id, class_id) and every link (a, b) of two classes once, a < b.

    A class holds the documents of one set and is named by the set's hash; texts without words are in no class (null).
    Links are as many as there are: their number grows with the square of a group of near copies."""
    with scope() as keep:
        labelled, nodes, comps = _joined(docs, id_col, n, percent, least_frequent, most_frequent)
        members = labelled.withColumn("class_id", F.when(F.col("n") > 0, F.col("sig")))
        return keep(_named(members, id_col, "class_id")), keep(_within(nodes, comps, n, percent, pairs=True))
