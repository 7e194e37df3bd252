"""Suffix-array deduplication: maximal repeats from the common-prefix interval tree of an enhanced suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.repeats import Repeats, Segment, remove_repeats

#: Bytes of an anchor, short against the 400 bytes of a window so that anchors are rare.
GRAM = 32


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The interval tree of common prefixes: (first, last, length) for lengths of at least `least`, children first.

    lcp[i] is the common prefix of suffixes i and i + 1 in sorted order; a stack holds the open intervals."""
    stack = [(0, -1)]
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][1] > value:
            first, length = stack.pop()
            if length >= max(least, 1):
                yield first, i, length
        if not stack or stack[-1][1] < value:
            stack.append((first, value))


def maximal_repeats(before: list[bytes], after: list[bytes], least: int) -> Iterator[tuple[list[int], int, int]]:
    """Groups of all suffixes that share `left` bytes before and `right` bytes after their start, left + right >=
    least, and no longer string on either side.

    `after` are the suffixes, `before` the reversed texts to their left. An interval of the array of suffixes is
    as long to the right as its members allow. Its members are sorted by what precedes them; a run of them with a
    common left context is a group if it comes from more than one child interval (else a child with a longer right
    side reports it); the preceding bytes differ within it, as the run is an interval of the left array itself."""
    order = sorted(range(len(after)), key=after.__getitem__)
    longest = max(map(len, before), default=0)
    lcp = [common_prefix(after[i], after[j]) for i, j in zip(order, order[1:], strict=False)]
    for first, last, right in intervals(lcp, least - longest):
        child, children = 0, {}
        for i in range(first, last + 1):
            child += i > first and lcp[i - 1] == right
            children[order[i]] = child
        members = sorted(children, key=before.__getitem__)
        left = [common_prefix(before[i], before[j]) for i, j in zip(members, members[1:], strict=False)]
        if least <= right:
            if len(set(children.values())) > 1:
                yield members, min(left), right
        for a, z, length in intervals(left, max(1, least - right)):
            if (least > right or length > min(left)) and len({children[i] for i in members[a : z + 1]}) > 1:
                yield members[a : z + 1], length, right


def repeated_bytes(segments: list[Segment], how: Repeats) -> list[tuple[int, int] | None]:
    """Repeated span of each segment of one anchor: suffixes start at the anchors, which all their repeats contain."""
    spans: list[tuple[int, int] | None] = [(0, len(text)) if copies > 1 else None for text, copies, _ in segments]
    before, after = [text[:at][::-1] for text, _, at in segments], [text[at:] for text, _, at in segments]
    for members, left, right in maximal_repeats(before, after, how.length):
        for i in members:
            at, known = segments[i][2], spans[i]
            spans[i] = (at - left, at + right) if known is None else (min(known[0], at - left), max(known[1], at + right))
    return spans


def _digest(raw: bytes | None, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
    raw = raw or b""
    keep, at = hashlib.sha256(), 0
    for first, last in zip(a.tolist(), b.tolist(), strict=True):
        keep.update(raw[at:first])
        at = last
    keep.update(raw[at:])
    return {"n_bytes": len(raw), "n_removed": int((b - a).sum()), "n_spans": len(a), "kept_sha256": keep.hexdigest()}


def _text(raw: bytes | None, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
    if raw is None:
        return {"text": None}
    cuts = [0, *(x for pair in zip(a.tolist(), b.tolist(), strict=True) for x in pair), len(raw)]
    return {"text": b"".join(raw[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2)).decode("utf-8", "replace")}


def without_repeats(docs: DataFrame, keep: list[str], length: int = 400) -> DataFrame:
    """keep's columns and the text without the bytes of any string of `length` bytes that also starts elsewhere.
    Bytes that no longer form a character are replaced by U+FFFD."""
    return remove_repeats(docs, keep, Repeats(length, min(GRAM, max(1, length // 2)), words=False), repeated_bytes, _text, "text string")


def digest(docs: DataFrame, length: int = 400, gram: int = GRAM, group: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each whole text.

    Defined results: a null text is empty; texts shorter than `length` lose nothing; of repeated rows all copies
    lose what they share; an empty table gives no rows; other columns are ignored."""
    return remove_repeats(docs, ["doc_id"], Repeats(length, gram, words=False, group=group), repeated_bytes, _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
