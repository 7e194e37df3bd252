"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The transducer is the composition of a normaliser (white space to U+2581, a dummy prefix), the pieces with a byte
fallback for characters without one, and, for BPE models, an acceptor of neighbouring pieces. Composed with an input
it is an acyclic graph whose states are positions (in BPE models with the last piece, of which there is one each);
encoding is its shortest path in the tropical semiring (weights add along a path, the least total wins). Arcs of
unigram models weigh minus the piece's score.
In BPE models scores are merge ranks and do not add up; there, two pieces may follow one another only if merging
their joined text gives just these two, which holds along exactly one path (that of the merges), and each arc weighs 1.
No piece goes on after white space begins, so the graph falls into independent parts at each run of white space."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mapped, slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Piece types of the model format, and its model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass(frozen=True)
class Model:
    """What a model file holds; equal files give equal models."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    model_type: int
    dummy_prefix: bool
    squeeze: bool


def load(data: bytes) -> Model:
    """Read a model file. What would be encoded wrongly is refused: normalisation other than of white space (the model has
    a character map), white space as a suffix or unescaped, pieces with white space after their first character that
    aren't only white space, and unused pieces."""
    pieces, model_type, prefix, squeeze, suffix = [], UNIGRAM, True, True, False
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            model_type, suffix = spec.get(3, UNIGRAM), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            prefix, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
            if spec.get(2):
                raise ValueError("the model has a character map, which this normaliser does not compile")
            if not spec.get(5, 1):
                raise ValueError("the model leaves white space as it is")
    names, scores, kinds = zip(*pieces, strict=True)
    odd = next((n for n, k in zip(names, kinds, strict=True) if k in (NORMAL, USER) and SPACE in n[1:] and n.strip(SPACE)), None)
    if odd is not None or suffix or UNUSED in kinds:
        raise ValueError(f"the piece {odd!r} has white space inside" if odd is not None else "the model has white space as a suffix or unused pieces")
    return Model(names, scores, kinds, model_type, prefix, squeeze)


@dataclass
class Transducer:
    """The compiled machine, with bounded memories of parts already solved and of neighbours already judged."""

    model: Model
    remember: int = 200_000
    arcs: dict[str, int] = field(default_factory=dict)
    solved: dict[str, tuple[int, ...]] = field(default_factory=dict)
    older: dict[str, tuple[int, ...]] = field(default_factory=dict)
    allowed: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        m = self.model
        self.arcs = {p: i for i, p in enumerate(m.pieces) if m.kinds[i] in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(m.pieces) if m.kinds[i] == BYTE}
        self.unknown = next((i for i, k in enumerate(m.kinds) if k == UNKNOWN), 0)
        self.least, self.size = min(m.scores), len(m.pieces)
        self.prefixes = {p[:n]: -1 for p in self.arcs for n in range(1, len(p))} | self.arcs
        self.output = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]
        self.parts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def normalise(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (" " + text if self.model.dummy_prefix and text else text).replace(" ", SPACE)

    def merged(self, text: str) -> list[str]:
        """The merges of a short text: the best-scored neighbours first, the leftmost of equals."""
        parts, scores = list(text), self.model.scores
        while True:
            found = [(-scores[self.arcs[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.arcs]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two neighbours gives just these (left -1: the piece alone)."""
        pair = [*([self.model.pieces[left]] if left >= 0 else []), self.model.pieces[right]]
        known = self.merged("".join(pair)) == pair
        if len(self.allowed) >= 2 * self.remember:
            self.allowed.clear()
        self.allowed[left * self.size + right] = known
        return known

    def arcs_from(self, part: str, at: int) -> list[tuple[int, int]]:
        """Ends and pieces of the arcs that leave a position, the longest last; -1 is the byte fallback."""
        prefixes, out = self.prefixes, []
        for end in range(at + 1, len(part) + 1):
            piece = prefixes.get(part[at:end])
            if piece is None:
                break
            if piece >= 0:
                out.append((end, piece))
        return out if out and out[0][0] == at + 1 else [(at + 1, -1), *out]

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes.get(b, self.unknown) for b in char.encode()) if self.bytes else (self.unknown,)

    def shortest(self, part: str) -> tuple[int, ...]:
        """Shortest path of one part. In unigram models each position keeps the least weight that reaches it and the
        arc by which it does."""
        if self.model.model_type == BPE:
            return self.accepted(part)
        scores, n = self.model.scores, len(part)
        weight, back = [0.0] + [float("inf")] * n, [(0, -1)] * (n + 1)
        for at in range(n):
            for end, piece in self.arcs_from(part, at):
                cost = weight[at] + (10.0 - self.least if piece < 0 else -scores[piece])
                if cost < weight[end]:
                    weight[end], back[end] = cost, (at, piece)
        path, end = [], n
        while end:
            at, piece = back[end]
            path.append((piece,) if piece >= 0 else self.fallback(part[at]))
            end = at
        return tuple(x for ids in reversed(path) for x in ids)

    def accepted(self, part: str) -> tuple[int, ...]:
        """Shortest path of one part where the acceptor of neighbours leaves one path, so that the first one found is
        it: the longest arcs first. The pieces before a position are the merges of that text alone, so a position has
        one state, and one that led nowhere is not entered again."""
        allowed, size, n = self.allowed, self.size, len(part)
        at, left, arcs, trail, dead = 0, -1, self.arcs_from(part, 0), [], set()
        while at < n:
            while arcs:
                end, piece = arcs.pop()
                if end in dead:
                    continue
                ok = piece < 0 or allowed.get(left * size + piece)
                if self.follows(left, piece) if ok is None else ok:
                    trail.append((at, left, arcs, piece))
                    at, left = end, piece
                    if at < n:
                        arcs = self.arcs_from(part, at)
                    break
            else:
                dead.add(at)
                at, left, arcs, _ = trail.pop()
        return tuple(x for at, _, _, piece in trail for x in ((piece,) if piece >= 0 else self.fallback(part[at])))

    def forget(self) -> None:
        """Drop the parts that were solved; what is known of neighbouring pieces stays."""
        self.solved, self.older = {}, {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        solved = self.solved
        for part in self.parts.findall(self.normalise(text)):
            ids = solved.get(part)
            if ids is None:
                ids = self.older.get(part) or self.shortest(part)
                if len(part) <= 48:
                    if len(solved) >= self.remember:
                        self.older, self.solved = solved, {}
                        solved = self.solved
                    solved[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.output.__getitem__, ids))
        return (raw[1:] if self.model.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(data: bytes) -> Transducer:
    """One machine for each model and Python worker."""
    return Transducer(load(data))


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, keep: list[str], model_path: str = MODEL_PATH) -> DataFrame:
    """keep's columns with ids (the pieces of the whole text) and decoded (the text that these give again).

    Defined results: a null text gives null ids and null text, an empty one no ids; U+2581 in a text is decoded as a
    space; repeated rows are encoded alike; an empty table gives no rows."""
    return _mapped(docs, keep, model_path, "ids array<int>, decoded string", lambda text, ids, out: (ids, out))


def digest(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit numbers), decoded_sha256, round_trip."""

    def made(text: str | None, ids: list[int] | None, out: str | None) -> tuple:
        return len(ids or ()), hashlib.sha256(np.asarray(ids or [], dtype="<i4").tobytes()).hexdigest(), hashlib.sha256((out or "").encode()).hexdigest(), out == text

    return _mapped(docs, ["doc_id"], model_path, "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean", made)


def _mapped(docs: DataFrame, keep: list[str], model_path: str, schema: str, made) -> DataFrame:
    sent = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), "text")
    data = read_model(model_path)
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    names = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(data)
        machine.forget()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                out = []
                for text in part.column("text").to_pylist():
                    ids = None if text is None else machine.encode(text)
                    out.append(made(text, ids, None if ids is None else machine.decode(ids)))
                columns = [pa.array([o[i] for o in out], kinds[kind]) for i, (_, kind) in enumerate(names)]
                yield pa.RecordBatch.from_arrays([part.column("kept"), *columns], ["kept", *(n for n, _ in names)])
        machine.forget()  # workers are used again by other stages

    return mapped(sent, run, f"kept {sent.schema['kept'].dataType.simpleString()}, {schema}").select("kept.*", *(n for n, _ in names))
