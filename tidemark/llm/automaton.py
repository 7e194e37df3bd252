"""Substring deduplication: matching statistics of documents against suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.repeats import Repeats, Segment, remove_repeats

#: Words of an anchor.
GRAM = 10


class SuffixAutomaton:
    """All substrings of several texts, with how often each occurs; a text counts as often as it has copies."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, unit: object) -> int:
        """The state of the longest string of p followed by unit, taken out of q if q has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(unit) == q:
            self.next[p][unit] = clone
            p = self.link[p]
        return clone

    def add(self, text: Iterable, copies: int = 1) -> None:
        last = 0
        for unit in text:
            known = self.next[last].get(unit)
            if known is not None:
                last = self._split(last, known, unit)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and unit not in self.next[p]:
                    self.next[p][unit] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, self.next[p][unit], unit)
                last = new
            self.count[last] += copies

    def finish(self) -> None:
        """Sum occurrences up the suffix links; add() must not follow."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def matching(self, text: Iterable, least_copies: int = 2) -> Iterable[int]:
        """At each unit, the length of the longest string ending there that occurs least_copies times or more."""
        state = matched = 0
        for unit in text:
            while state and self.count[self.next[state].get(unit, 0)] < least_copies:
                state = self.link[state]
                matched = self.length[state]
            to = self.next[state].get(unit, 0)
            if to and self.count[to] >= least_copies:
                state, matched = to, matched + 1
            yield matched


def repeated_words(segments: list[Segment], how: Repeats) -> list[tuple[int, int] | None]:
    """Repeated span of each segment of one anchor; these are a reference shard, and each is streamed through its automaton."""
    texts = [text.split(b" ") for text, _, _ in segments]
    automaton = SuffixAutomaton()
    for words, (_, copies, _) in zip(texts, segments, strict=True):
        automaton.add(words, copies)
    automaton.finish()
    spans: list[tuple[int, int] | None] = []
    for words in texts:
        long = [(end - n, end) for end, n in enumerate(automaton.matching(words), 1) if n >= how.length]
        spans.append((min(a for a, _ in long), long[-1][1]) if long else None)
    return spans


def _kept(raw: bytes, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    stay = np.ones(len(starts), dtype=bool)
    for first, last in zip(a.tolist(), b.tolist(), strict=True):
        stay[first:last] = False
    return b" ".join(raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True))


def _digest(raw: bytes | None, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
    return {"n_words": len(starts), "n_removed": int((b - a).sum()), "kept_sha256": hashlib.sha256(_kept(raw or b"", starts, ends, a, b)).hexdigest()}


def _text(raw: bytes | None, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
    if raw is None or not len(a):
        return {"text": None if raw is None else raw.decode("utf-8", "replace")}
    return {"text": _kept(raw, starts, ends, a, b).decode("utf-8", "replace")}


def without_repeats(docs: DataFrame, keep: list[str], length: int = 35) -> DataFrame:
    """keep's columns and the text; where words are removed, the others are joined by one space."""
    return remove_repeats(docs, keep, Repeats(length, min(GRAM, length), words=True), repeated_words, _text, "text string")


def digest(docs: DataFrame, length: int = 35, gram: int = GRAM, group: int = 4096) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each whole text.

    Defined results: a null text has no words; texts shorter than `length` words lose nothing; of repeated rows all
    copies lose what they share; an empty table gives no rows; other columns are ignored."""
    return remove_repeats(docs, ["doc_id"], Repeats(length, gram, words=True, group=group), repeated_words, _digest, "n_words long, n_removed long, kept_sha256 string")
