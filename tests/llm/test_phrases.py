"""Collocations against counting all phrases, SQL, and exact wide arithmetic."""

import random
import re
from collections import Counter

import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from tidemark.llm import phrases, registry


def brute(rows, least, top):
    f, n, out = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    frequent = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    for (lang, p), a in frequent.items():
        if any(x == lang and len(q) > len(p) and b >= a and inside(p, q) for (x, q), b in frequent.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    ranked, place = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


@pytest.mark.parametrize(("least", "bits"), [(3, 24), (3, 4), (10, 12), (1, 16)])
def test_collocations_equal_brute_force(spark, least, bits):
    rng = random.Random(6)
    vocabulary = ["a", "b", "C", "d", "É", "日本", "x y", "#", "e-f", *[f"r{i}" for i in range(40)]]
    weights = [20] * 9 + [1] * 40
    make = lambda n: "".join(rng.choices(vocabulary, weights)[0] + rng.choice((" ", " ", " ", "\t ", ". ", ",", "\r\n", "!")) for _ in range(n))
    passage = "one two three four five six seven eight"
    rows = [(rng.choice(("en", "en", "en", "fr", None, "")), make(rng.randrange(0, 60))) for _ in range(60)]
    rows += [("en", passage)] * 12 + [("en", f"{passage[:13]}. {passage}")] * 4 + [("fr", None), (None, None), ("en", ""), ("en", "a"), ("fr", "a b c d e"), ("en", make(3000))]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("m", "n", "phrase", "k", "first", "a", "rank")})
    for top in (2000, 7):
        assert sorted(map(tuple, phrases.collocations(docs, least, top, bits).collect())) == brute(rows, least, top)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_wide_products(spark):
    """Counts whose products pass 64 bits."""
    counts = spark.createDataFrame([(2**43 + 1, 2**44 + 5, 2**43 + 9, 2**43 + 11)], "a long, words long, l long, r long")
    wide = lambda c: f"cast({c} as decimal(19,0))"
    got = counts.select(F.expr(f"({wide('a')} * {wide('words')} * 1000) div ({wide('l')} * {wide('r')})").alias("s")).first()["s"]
    assert got == 1000 * (2**43 + 1) * (2**44 + 5) // ((2**43 + 9) * (2**43 + 11))


def test_query_equals_sql(spark, sf_dir):
    assert spark_rows(registry.queries()["op13_phrases"](spark, sf_dir)) == duck_rows(registry.oracle_sql()["op13_phrases"], sf_dir)
