"""License scans against all blocks and templates, SQL, and on odd texts."""

import random
import re

from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from tidemark.llm import licenses, registry


def brute(rows, templates, phrases, percent, width, stride):
    out = []
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        base = sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        starts = range(0, stride * max(1, -(-(len(words) - (width - stride)) // stride)), stride)
        share = [(label, len(set(t.split()) & set(words[s : s + width])) / len(set(t.split()))) for s in starts for label, t in templates]
        met = [(label, x) for label, x in share if round(1e9 * 100 * x) >= round(1e9 * percent)]
        own = {label for _, label in base}
        out.append((i, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | {label for label, _ in met})), 1.0 if base else max((x for _, x in met), default=0.0)))
    return sorted(out, key=repr)


def test_scan_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(25)] + ["license", "mit", "é"]
    templates = [("a", "w1 w2 w3 w4 w5"), ("b", "w1 w6"), ("a,c", "w7"), ("d", " ".join(f"w{i}" for i in range(8, 24))), ("e", "mit w1 w1 w2")]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice((" ", "-", "\n", ", ")) for _ in range(n))
    texts = [None, "", " .,", "MIT License", "the Mit-LICENSE mit license", "ÉW1 w6", "K w1", make(3000), *[make(rng.randrange(1, 60)) for _ in range(150)]]
    rows = list(enumerate(texts)) + [(3, "MIT License"), (None, "mit license"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("row", "words", "base", "id", "label", "block")})
    for percent, width, stride in ((80, 8, 4), (60, 7, 3), (100, 64, 32), (50, 2, 1)):
        got = licenses.scan(docs, templates, {"mit license": "mit", "w2 w3": "two"}, percent, width, stride)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, templates, {"mit license": "mit", "w2 w3": "two"}, percent, width, stride)
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, [], {}).where("labels <> '' or score > 0").count() == 0


def test_notices_are_found(spark):
    """Notices wrapped over lines and lightly edited, in the middle of long texts."""
    filler = " ".join(f"word{i}" for i in range(400))
    texts = [f"{filler}\n * {t.upper().replace(' ', ' \n * ', 3)} {filler}" for _, t in licenses.TEMPLATES] + [filler]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
    assert got[len(texts) - 1]["labels"] == ""


def test_query_equals_sql(spark, sf_dir):
    assert spark_rows(registry.queries()["op12_license_scan"](spark, sf_dir)) == duck_rows(registry.oracle_sql()["op12_license_scan"], sf_dir)
