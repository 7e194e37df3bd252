"""Language identification with blended-spectrum string kernels, Nystrom landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, lower_ascii, mapped, slices, text_bytes

#: The language of a text that is null or has no letter.
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    """languages: what can be predicted; landmarks: their normalised presence vectors as columns; weights: from
    kernel values with the landmarks to one score per language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    sharpness: float


def presence(buf: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """Rows of 0/1: which hashed 1-, 2- and 3-grams of lower-cased bytes the whole text has (the blended spectrum)."""
    out = np.zeros((len(off) - 1, width), dtype=np.uint8)
    b = lower_ascii(buf).astype(np.uint32)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    code = np.zeros(len(b), dtype=np.uint32)
    for n in (1, 2, 3):
        code = b if n == 1 else code[:-1] * np.uint32(257) + b[n - 1 :]
        first = row[: len(code)]
        whole = first == row[n - 1 : n - 1 + len(code)]
        hashed = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(width)))
        out[first[whole], hashed[whole]] = 1
    return out


def _unit(p: np.ndarray) -> np.ndarray:
    p = p.astype(np.float32)
    return p / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))


def fit(docs: DataFrame, is_train: Column, id_col: str = "doc_id", per_language: int = 1500, n_landmarks: int = 160, width: int = 4096, ridge: float = 1e-2, sharpness: float = 8.0) -> Model:
    """Learn from at most about per_language texts of each language among the rows where is_train holds.

    The sample is the rows whose id hash falls below per_language / rows of the language: a documented bound, as
    the driver gets one bit per hashed n-gram of each sampled text. Landmarks are drawn evenly from languages."""
    train = docs.where(is_train & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((width, 0), np.float32), np.zeros((0, 0), np.float32), sharpness)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    sample = train.where(place < share[F.col("lang")]).select("text", "lang")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18, 1024):
                bits = np.packbits(presence(*text_bytes(part.column("text")), width), axis=1)
                yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "bits": pa.array([x.tobytes() for x in bits], pa.binary())})

    got = sorted(mapped(sample, features, "lang string, bits binary").limit(2 * per_language * len(languages)).collect())
    x = _unit(np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in got), dtype=np.uint8).reshape(len(got), width // 8), axis=1))
    y = np.array([languages.index(r["lang"]) for r in got])
    each = max(1, n_landmarks // len(languages))
    marks = np.concatenate([np.flatnonzero(y == i)[np.linspace(0, (y == i).sum() - 1, min(each, (y == i).sum()), dtype=int)] for i in range(len(languages)) if (y == i).any()] or [np.zeros(0, int)])
    landmarks = x[marks].T.copy()
    value, vector = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    keep = value > 1e-6 * max(value.max(initial=0), 1e-12)
    nystrom = vector[:, keep] / np.sqrt(value[keep])
    z = (x @ landmarks).astype(np.float64) @ nystrom
    target = (y[:, None] == np.arange(len(languages))).astype(np.float64)
    scale = 1 / np.maximum(target.sum(0), 1)[y]
    solved = np.linalg.solve((z * scale[:, None]).T @ z + ridge * np.eye(z.shape[1]) / max(1, len(languages)), (z * scale[:, None]).T @ target)
    return Model(languages, landmarks, (nystrom @ solved).astype(np.float32), sharpness)


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The struct `kept` of keep's columns, lang_pred and score (0 to 1).

    Each whole text is a presence vector; batches of them are multiplied with the landmarks and the one-versus-rest
    weights, and scores are the softmax of those. Defined results: a text that is null or has no letter, and any
    text where nothing was learned, gets `und` and score 0; an empty table gives no rows; repeated rows are
    predicted alike; what the columns in keep are called makes no difference."""
    width, languages = model.landmarks.shape[0], [*model.languages, UNDETERMINED]
    inside = keep.index("text") if "text" in keep else None
    sent = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), *(["text"] if inside is None else []), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if inside is not None:  # the text goes over once
                kept = batch.column("kept")
                batch = pa.RecordBatch.from_arrays([kept, kept.field(inside), batch.column("lettered")], ["kept", "text", "lettered"])
            for part in slices(batch, "text", 1 << 18, 1024):
                raw = _unit(presence(*text_bytes(part.column("text")), width)) @ model.landmarks @ model.weights * model.sharpness
                known = np.asarray(part.column("lettered").to_numpy(zero_copy_only=False), dtype=bool) & bool(model.languages)
                best, score = np.full(len(part), len(model.languages)), np.zeros(len(part))
                if raw.shape[1]:
                    e = np.exp(raw - raw.max(1, keepdims=True))
                    best, score = np.where(known, raw.argmax(1), best), np.where(known, e.max(1) / e.sum(1), 0.0)
                yield pa.RecordBatch.from_pydict({"kept": part.column("kept"), "lang_pred": pa.array([languages[i] for i in best.tolist()], pa.string()), "score": pa.array(score, pa.float64())})

    kept = sent.schema["kept"].dataType.simpleString()
    return mapped(sent, predict, f"kept {kept}, lang_pred string, score double")


def identify_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from documents that are not held out."""
    out = held_out("doc_id", 3, 1)
    found = identify(docs, fit(docs, ~out), ["doc_id"])
    return found.select("kept.doc_id", held_out("kept.doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
