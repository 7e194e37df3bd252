"""Names, identifiers and claims in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Claims that must not be made, with what may be said instead.
FORBIDDEN = {
    "destroyed": "candidate-exposed",
    "structurally failed": "candidate-exposed",
    "confirmed flood": "SAR-change candidate",
    "confirmed damage": "candidate exposure",
    "observed flooding": "SAR-change candidate",
    "impassable": "closed under the stated closure scenario",
    "cut off": "SCENARIO_UNREACHABLE under the stated closure rule",
    "isolated": "potentially cut off",
    "inaccessible": "potentially inaccessible",
    "flood-free": "not observed",
    "unaffected": "not observed",
    "undamaged": "not observed",
}
#: Phrases that are allowed although they hold a forbidden term.
ALLOWED = (
    "potentially inaccessible",
    "potentially disrupted",
    "potentially cut off",
    "potentially unaffected",
    "may be cut off",
    "SCENARIO_UNREACHABLE",
    "UNREACHABLE_ONLY_IF_UNOBSERVED_CLOSED",
)
#: Words that deny a claim within the twelve words before it in its clause.
CUES = ("not", "never", "no", "nor", "non", "cannot", "isn't", "aren't", "wasn't", "without", "rather", "instead", "neither")
CUE_WORDS = 12


def platform_unit(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^(S1[A-D]|S2[A-D])_", 1), F.lit(""))


def processing_level(level: Column) -> Column:
    """L1C or L2A by their known synonyms, whatever the case and the blanks around; anything else, NULL and blank texts
    too, is UNKNOWN."""
    norm = F.upper(F.trim(level))
    return F.when(norm.isin("L2A", "S2MSI2A", "LEVEL-2A", "LEVEL2A"), "L2A").when(norm.isin("L1C", "S2MSI1C", "LEVEL-1C", "LEVEL1C"), "L1C").otherwise("UNKNOWN")


def polarisation_verdict(reported: Column, required: list[str]) -> Column:
    """match, mismatch, or unverifiable where nothing is reported; channels are separated by & and case is ignored."""
    have = F.array_distinct(F.transform(F.split(reported, "&"), lambda x: F.upper(F.trim(x))))
    missing = F.size(F.array_except(F.array(*map(F.lit, required)), have))
    return F.when(reported.isNull() | (F.trim(reported) == ""), "unverifiable").when(missing == 0, "match").otherwise("mismatch")


def coordinate(x: Column) -> Column:
    """Fixed-point text with seven places."""
    return F.format_string("%.7f", x)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the sorted ids, one per line: the same for any order."""
    return F.sha2(F.array_join(F.array_sort(ids), "\n"), 256)


#: A character of a word in any script.
_LETTER = r"[\p{L}\p{N}_]"


def screen_claims(text: Column, forbidden: dict[str, str] = FORBIDDEN, allowed: tuple[str, ...] = ALLOWED, cues: tuple[str, ...] = CUES, words: int = CUE_WORDS) -> Column:
    """Array of (position, term, instead) of claims in a text, by position and term.

    Allowed phrases are blanked first. A term counts at word boundaries, unless a cue is among the last `words` words
    before it in its clause (which begins after the last of . ; : ! ? or a newline). A hyphened word is one word."""
    masked = F.lower(text)
    for phrase in allowed:
        masked = F.replace(masked, F.lit(phrase.lower()), F.lit("\x00" * len(phrase)))

    def of(term: str) -> Column:
        parts = lambda t: F.split(t, rf"(?<!{_LETTER}){re.escape(term.lower())}(?!{_LETTER})", -1)

        def found(pieces: Column) -> Column:
            """A hit after each piece but the last; its place is the length of what comes before."""
            before = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda _, i: F.array_join(F.slice(pieces, 1, i + 1), term.lower()))
            clause = lambda b: F.element_at(F.split(b, r"[.;:!?\n]", -1), -1)
            spoken = lambda b: F.slice(F.reverse(F.filter(F.split(clause(b), rf"[^{_LETTER[1:-1]}'-]+", -1), lambda w: w != "")), 1, words)
            denied = lambda b: F.exists(spoken(b), lambda w: w.isin(*cues) | F.rtrim(w, F.lit("-")).isin(*cues))
            return F.transform(F.filter(before, lambda b: ~denied(b)), lambda b: F.struct(F.length(b).alias("position"), F.lit(term).alias("term"), F.lit(forbidden[term]).alias("instead")))

        return F.flatten(F.transform(F.array(parts(masked)), found))

    return F.array_sort(F.flatten(F.array(*map(of, forbidden))))
