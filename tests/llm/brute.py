"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def jaccard(docs):
    """{id: (n_shingles, component_id)} of (id, text)."""
    sets = []
    for _, text in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    holders = defaultdict(list)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        shared = Counter(o for x in s for o in holders[x])
        for o, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                parent[find(k)] = find(o)
        for x in s:
            holders[x].append(k)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return list((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs))


def removed(units, length):
    """Flags of the units of each document that a window covers which starts twice or more."""
    count = Counter(tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        flags = bytearray(len(u))
        for i in range(len(u) - length + 1):
            if count[tuple(u[i : i + length])] > 1:
                flags[i : i + length] = b"\1" * length
        out.append(flags)
    return out


def substring(docs, length):
    units = [[w.encode() for w in words(t)] for _, t in docs]
    flags = removed(units, length)
    return list((i, len(u), sum(f), hashlib.sha256(b" ".join(w for w, x in zip(u, f, strict=True) if not x)).hexdigest()) for (i, _), u, f in zip(docs, units, flags, strict=True))


def suffix(docs, length):
    units = [(t or "").encode() for _, t in docs]
    flags = removed(units, length)
    return list((i, len(u), sum(f), len(re.findall(rb"\x01+", bytes(f))), hashlib.sha256(bytes(b for b, x in zip(u, f, strict=True) if not x)).hexdigest()) for (i, _), u, f in zip(docs, units, flags, strict=True))


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)
