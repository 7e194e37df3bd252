"""The operators against brute force, SQL, the public library or held-out labels, and on edge cases."""

import hashlib
import json
import random

import brute
import numpy as np
import pytest
import sentencepiece
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from tidemark.llm import automaton, jaccard, langid, mixing, pieces, quality, registry, rules, search, suffix_array, toolcalls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use inside."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, near = make(80), make(200).split()
    texts = [None, "", "  \n\t ", "a", "one two three", "12 34 ##", passage, passage, f"{make(30)} {passage} {make(30)}", f"{make(9)}\n{passage}", "x " * 5000, make(20000), "ab" * 3000, "🙂 é\x0b日本"]
    for i in range(30):
        variant = list(near)
        variant[i * 5] = f"edit{i}"
        texts.append(" ".join(variant))
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", ""][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[20], (None, passage, "en", "s1", 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("rid", "kept", "score", "row", "size", "rank", "lang_pred", "quality", "spans", "sig", "token", "n", "id")})


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_repr(x):
    return sorted(x, key=repr)


@pytest.mark.parametrize("knobs", [{}, {"least_frequent": 2}, {"least_frequent": 2, "most_frequent": 20}])
def test_jaccard(spark, sf_dir, odd, knobs):
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd.where("doc_id is not null")):
        assert rows(jaccard.similar_sets(df, **knobs)) == by_repr(brute.jaccard(pairs(df)))


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard_links(spark, odd, monkeypatch, block):
    """Every link between different sets, also within components, against all pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    df = odd.where("doc_id is not null")
    sets = {}
    for i, t in pairs(df):
        w = brute.words(t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    different = list(set(sets.values()) - {frozenset()})
    links = {frozenset((x, y)) for x in different for y in different if x != y and 100 * len(x & y) >= 75 * len(x | y)}
    count = {x: sum(x in link for link in links) for x in different}
    assert max(count.values()) > 20
    if block == 4:
        got = rows(jaccard.counted_links(df))
        assert got == by_repr([(i, n, c, count.get(sets[i], 0)) for i, n, c in brute.jaccard(pairs(df))])
    members, found = jaccard.class_links(df)
    classes = {r["class_id"]: sets[r["doc_id"]] for r in members.collect() if r["class_id"] is not None}
    found = [frozenset((classes[r["a"]], classes[r["b"]])) for r in found.collect()]
    assert len(found) == len(set(found)) and set(found) == links


def test_jaccard_parts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 62, rng.integers(1, 60), dtype=np.uint64))))
        x, y = jaccard.bitmap(a, 256), jaccard.bitmap(b, 256)
        assert (jaccard.folded(jaccard.bitmap(a, 1024)[None, :], 256)[0] == x).all()
        bound = min(len(a) - int(np.bitwise_count(x & ~y).sum()), len(b) - int(np.bitwise_count(y & ~x).sum()))
        assert bound >= len(np.intersect1d(a, b))
        if jaccard.linked(a, b, 75):
            assert abs(jaccard.band(len(a), 75) - jaccard.band(len(b), 75)) <= 1


@pytest.mark.parametrize("group", [4096, 1])
def test_substring_dedup(spark, sf_dir, odd, group):
    for df, length in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), 35), (odd, 35), (odd, 3)):
        got = automaton.digest(df, length, gram=min(10, length), group=group)
        assert rows(got) == by_repr(brute.substring(pairs(df), length))


@pytest.mark.parametrize("group", [4096, 1])
def test_suffix_array_dedup(spark, sf_dir, odd, group):
    for df, length in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), 400), (odd, 400), (odd, 40)):
        got = suffix_array.digest(df, length, gram=min(32, length // 2), group=group)
        assert rows(got) == by_repr(brute.suffix(pairs(df), length))


def test_long_segments(spark):
    """Segments of over 65,535 units keep their start and length."""
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, heads = make(70_000), [make(1000 + 100 * i) for i in range(2)]
    texts = ["".join((h, x, passage, y, h[::-1])) for h, x, y in zip(heads, "xy", "yx", strict=True)]
    got = suffix_array.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 40_000, gram=32)
    want = [(i, len(t), 70_000, 1, hashlib.sha256(t.replace(passage, "").encode()).hexdigest()) for i, t in enumerate(texts)]
    assert rows(got) == by_repr(want)


def test_automaton_counts_substrings():
    rng = random.Random(2)
    for _ in range(50):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(4)]
        a = automaton.SuffixAutomaton()
        for t in texts:
            a.add(t)
        a.finish()
        for t in texts:
            for end, n in enumerate(a.matching(t), 1):
                often = [k for k in range(end + 1) if sum(x[i:].startswith(t[end - k : end]) for x in texts for i in range(len(x))) > 1 or k == 0]
                assert n == max(often)


def test_maximal_repeats():
    texts = [b"xxabcdeyy", b"zzabcdeww", b"qqabcdeyy"]
    found = {(tuple(sorted(m)), left, right) for m, left, right in suffix_array.maximal_repeats([t[:4][::-1] for t in texts], [t[4:] for t in texts], 4)}
    assert found == {((0, 1, 2), 2, 3), ((0, 2), 2, 5)}


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_edges(spark, odd):
    got = rows(langid.identify_digest(odd))
    assert len(got) == odd.count()
    assert {r[2] for r in got if r[0] in (0, 1, 2, 5)} == {"und"} and {r[2] for r in got if r[0] == 6} <= {"en", "fr"}
    assert langid.identify_digest(odd.limit(0)).count() == 0


def test_quality(spark):
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    got = quality.score_digest(spark.read.parquet(f"{at}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_quality_counts_an_id_once(spark):
    """Many documents and labels of one id are one learned row."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other words here")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (3, 1)], "doc_id bigint, quality int")
    seen = []
    inner = quality.boost
    try:
        quality.boost = lambda x, y: (seen.append((len(x), sorted(y))), inner(x, y))[1]
        quality.fit(docs, labels, F.lit(True))
    finally:
        quality.boost = inner
    assert seen == [(2, [0.0, 1.0])]


def test_quality_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], none.schema)
    assert {r["score"] for r in quality.score_digest(odd, none).collect()} == {0.5}
    assert quality.score_digest(odd, some).count() == odd.count()
    assert quality.score_digest(odd.limit(0), some).count() == 0


def test_trees_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    p = quality.boost(x, y).score(x)
    assert ((p > 0.5) == y).mean() > 0.95


def test_rules(spark, sf_dir, odd):
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        got = rules.apply_rules(df)
        assert by_repr([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got.collect()]) == by_repr([(i, *brute.base(t)) for i, t in pairs(df)])
        assert got.where("kept and base_failed").count() == 0
    assert rules.apply_rules(odd.limit(0)).count() == 0


def test_rules_reject_outliers(spark):
    rng = random.Random(1)
    clean = [(i, " ".join("word" + "s" * rng.randrange(4) + str(rng.randrange(10**6)) for _ in range(100)), "en", "s") for i in range(60)]
    dirty = [(100 + i, t.replace(" ", " ###$$ "), "en", "s") for i, (_, t, _, _) in enumerate(clean[:6])]
    got = {r["doc_id"]: r["kept"] for r in rules.apply_rules(spark.createDataFrame(clean + dirty, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(6))


def test_mixing(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_digest(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max(F.col("taken") / F.col("size")).alias("most"), F.sum("size").alias("size")).collect()
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 0.1 * r["target"] and r["most"] <= 3 and r["target"] <= 3 * r["size"]
    assert sum(r["target"] for r in got) == pytest.approx(sum(r["size"] for r in got))
    assert mixing.mix_digest(odd).count() == odd.count() and mixing.mix_digest(odd.limit(0)).count() == 0
    assert rows(mixing.mix_digest(odd)) == rows(mixing.mix_digest(odd.repartition(7)))


def test_mixing_samples(spark):
    """Most documents of sf0.01 are sampled and not rounded, and each source comes within a fiftieth of its target."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_digest(docs).join(docs.select("doc_id", "source"), "doc_id").cache()
    assert got.where(F.col("size") * mixing.LARGE > F.col("source_size")).count() < 0.4 * got.count()
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.02 * r["target"]
    got.unpersist()


def test_mixing_counts_words_off(spark):
    """A source misses its target by a document of 1 / COUNTED of its words at most, though hardly any document is rounded."""
    rng = random.Random(5)
    docs = [(i, "w " * int(rng.paretovariate(1.1) * 3), f"s{i % 3}") for i in range(3000)]
    got = mixing.mix_digest(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()
    over = [r for r in got if r["size"] * mixing.COUNTED > r["source_size"]]
    assert 200 < len(over) < 1000 and sum(r["size"] * mixing.LARGE > r["source_size"] for r in over) < 0.1 * len(over)
    for target, size in {(r["target"], r["source_size"]) for r in got}:
        assert abs(sum(r["taken"] for r in got if r["target"] == target) - target) * mixing.COUNTED <= size
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    for r in mixing.mix_digest(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.005 * r["target"]


def test_mixing_without_words(spark):
    """Documents without words go by their source's mean, whether or not others are left below 1 / COUNTED."""
    docs = [(i, "w " * (i % 7 + 20) if i < 60 else None, "ab"[i % 2]) for i in range(1060)]
    docs += [(2000, "w", "a")]
    got = mixing.mix_sources(spark.createDataFrame(docs, "doc_id bigint, text string, source string"))
    for r in got.where("size = 0").groupBy("row.source").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"), F.first(F.col("target") / F.col("source_size")).alias("mean")).collect():
        assert r["n"] == 500 and abs(r["copies"] - r["n"] * r["mean"]) <= 1


def test_pieces_equal_the_library(spark, sf_dir, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    extra = spark.createDataFrame([(900 + i, t) for i, t in enumerate(["  lead", "trail ", "\n\n", "<s> </s> <0x41>", "▁ x", "aaaa aaaaa", "日本語テキスト🙂", "ﬁ ½ Å", "\x00 z"])], "doc_id bigint, text string")
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd, extra):
        for r, text in ((r, r["text"]) for r in pieces.encode(df.withColumn("t", F.col("text")), ["doc_id", "t"]).withColumnRenamed("t", "text").collect()):
            assert r["ids"] == (None if text is None else sp.encode(text))
            assert r["decoded"] == (None if text is None else text.replace("▁", " "))


def test_unigram_shortest_path():
    names = ("<unk>", "▁a", "b", "▁ab", "▁", "a")
    model = pieces.Model(names, (0.0, -1.0, -1.5, -2.0, -3.0, -3.0), (pieces.UNKNOWN,) + (pieces.NORMAL,) * 5, pieces.UNIGRAM, True, True)
    t = pieces.Transducer(model)
    assert [names[i] for i in t.encode("ab b")] == ["▁ab", "▁", "b"] and names[t.encode("z")[-1]] == "<unk>"


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 1, "reply", {"text": '"x"', "words": "1"}, None), (1, "b", 3, "reply", {"text": "7"}, ["a", "gone"]), (1, "c", 5, "draft", {"text": '"é\\n"', "words": "1", "lines": "2"}, ["b", "a"]),
        (1, "d", 7, "nope", None, ["e"]), (1, "e", 9, "reply", {"text": '"x"', "words": "1"}, ["d"]), (2, "a", 4, "reply", {"words": "2", "text": '"y"'}, []), (None, "a", 1, "nope", {}, []), (1, "a", 1, "reply", {"text": '"x"', "words": "1"}, None),
    ], "conv_id long, call_id string, turn long, tool string, arguments map<string,string>, after array<string>")
    results = spark.createDataFrame([(1, "a", 2, "ok"), (1, "b", 4, None), (2, "a", 3, "early"), (2, "z", 9, "lost"), (1, "c", 8, "late"), (1, "c", 6, "first")], "conv_id long, call_id string, turn long, content string")
    got = {(r["conv_id"], r["call_id"]): r for r in toolcalls.link(calls, results, toolcalls.turn_schemas(spark)).collect()}
    assert {k: (v["status"], v["level"]) for k, v in got.items()} == {
        (1, "a"): ("linked", 0), (1, "b"): ("invalid", 1), (1, "c"): ("linked", 2), (1, "d"): ("cyclic", None), (1, "e"): ("cyclic", None), (2, "a"): ("early", 0), (2, "z"): ("orphan", None), (None, "a"): ("unknown tool", 0),
    }
    assert got[1, "b"]["errors"] == ["kind of text", "missing words"] and got[1, "c"]["n_results"] == 2
    assert got[2, "a"]["json"] == '{"arguments":{"text":"y"'.replace('"y"', '"y"') + ',"words":2},"id":"a","name":"reply","result":"early"}'
    none = toolcalls.link(calls.limit(0), results.limit(0), toolcalls.turn_schemas(spark))
    assert none.count() == 0


def test_values_are_written_again(spark):
    """Arguments become canonical JSON: escapes, numbers and nested keys; what isn't JSON is a string and invalid."""
    given = {'"a\\u00e9\\/"': '"aé/"', "-0": "0", ' {"b": [1, {"d":2, "c":null}], "a":true} ': '{"a":true,"b":[1,{"c":null,"d":2}]}', '"a"b"': None, "tru": None, "12": "12", "null": "null"}
    rows_ = [(1, f"c{i}", i, "t", {"x": v}, None) for i, v in enumerate(given)]
    calls = spark.createDataFrame(rows_, "conv_id long, call_id string, turn long, tool string, arguments map<string,string>, after array<string>")
    schemas = spark.createDataFrame([("t", "x", "string", True)], "tool string, name string, kind string, required boolean")
    got = {r["call_id"]: r for r in toolcalls.link(calls, spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), schemas).collect()}
    for i, (v, want) in enumerate(given.items()):
        told = json.loads(got[f"c{i}"]["json"])
        assert told["arguments"]["x"] == (v if want is None else json.loads(want))
        if want is not None:
            assert f'"arguments":{{"x":{want}}}' in got[f"c{i}"]["json"]
        assert (got[f"c{i}"]["status"] == "unanswered") == (want is not None and want.startswith('"'))


def test_values_keep_what_they_hold(spark):
    """Numbers of any size, surrogates without a partner, escapes and key order come out as they went in."""
    digits = "12345678901234567890123456789012345678901234567891"
    given = {
        '"\\ud800"': '"\\ud800"', '"\\ud83d\\ude00"': '"😀"', "1e400": "1e400", digits: digits, "1": "1", "1.0": "1", "1e0": "1", "100": "100", "1e2": "100", "-0.0": "0", "0.50": "0.5", "5e-1": "0.5", "-1.25e-30": "-125e-32", " 5 \n": "5", "123e-2": "1.23",
        f'[1e400, {{"b":{digits}, "a":-1.50, "\\ud800":[]}}]': None, '"\\u0001n5"': '"\\u0001n5"', '["\\u0001n5","\\\\u0001n5","\\\\\\u0001"]': '["\\u0001n5","\\\\u0001n5","\\\\\\u0001"]', '{"a":1,"a":2}': 0, "01": 0, "1.": 0, "1a": 0, "[1 2]": 0, '{"\\uff61":1,"\\ud83d\\ude00":2}': '{"😀":2,"｡":1}', '"' + "a\\n" * 20000 + '"': '"' + "a\\n" * 20000 + '"',
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    got = {r["i"]: r["x"] for r in df.select("i", toolcalls.value_of(F.col("v")).alias("x")).collect()}
    for i, (v, want) in enumerate(given.items()):
        if want is None:
            assert got[i].startswith(f'[1e400,{{"') and f'"b":{digits}' in got[i] and '"a":-1.5,' in got[i] and '"\\ud800":[]' in got[i]
        else:
            assert got[i] == (json.dumps(v) if want == 0 else want), v[:50]
    kinds = spark.createDataFrame([({"x": v}, k) for v, k in (("1.0", "integer"), (" 5 ", "integer"), ("5\n", "number"), (digits, "integer"), ("1e30", "integer"), ("0.5", "number"), ('"a"', "string"), ("[]", "array"), (" {} ", "object"), ("1.5", "integer"), ("a", "string"), ("5", "string"), ("5x", "number"))], "a map<string,string>, k string")
    params = F.array(F.struct(F.lit("x").alias("name"), F.col("k").alias("kind"), F.lit(True).alias("required")))
    found = kinds.select(toolcalls.errors(F.col("a"), F.transform_values("a", lambda _, v: toolcalls.value_of(v)), params).alias("e")).collect()
    assert [bool(r["e"]) for r in found] == [False] * 9 + [True] * 4


def test_operators_run_side_by_side(spark, sf_dir):
    """Tables of one operator outlive the end of another that runs in a thread of its own."""
    from concurrent.futures import ThreadPoolExecutor

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(lambda _: automaton.digest(docs).count(), range(3))) == [docs.count()] * 3


def test_tool_calls_edges(spark):
    odd = spark.createDataFrame([(None, 1, "assistant", None), (1, None, "assistant", "x"), (1, 2, None, "y"), (1, 3, "user", None), (1, 3, "user", None), (2, 0, "user", "")], "conv_id bigint, turn bigint, role string, text string")
    assert toolcalls.digest(odd.withColumn("level", F.lit(1))).count() == 3
    assert toolcalls.digest(odd.limit(0)).count() == 0


def test_tool_calls_keep_every_row(spark):
    """Calls and results of one id, and rows without ids, have rows and JSON of their own."""
    calls = spark.createDataFrame([
        (1, "a", 1, "reply", {"text": '"first"', "words": "1"}, None), (1, "a", 1, "reply", {"text": '"other"', "words": "1"}, None), (1, "a", 3, "reply", {"text": '"later"', "words": "1"}, ["b"]), (1, "b", 2, "reply", {"text": '"b"', "words": "1"}, ["a"]),
        (1, None, 5, "reply", {"text": '"no id"', "words": "1"}, ["b"]), (1, None, 5, "reply", {"text": '"no id 2"', "words": "1"}, None), (None, "a", 1, "reply", {"text": '"x"', "words": "1"}, ["a"]), (None, "a", 1, "reply", {"text": '"y"', "words": "1"}, None),
    ], "conv_id long, call_id string, turn long, tool string, arguments map<string,string>, after array<string>")
    results = spark.createDataFrame([(1, "a", 2, "one"), (1, "a", 2, "two"), (1, "a", 2, "two"), (None, "a", 2, "p"), (None, "a", 2, "p"), (1, "z", 1, "s"), (1, "z", 1, "t"), (1, None, 1, "q")], "conv_id long, call_id string, turn long, content string")
    linked = toolcalls.link(calls, results, toolcalls.turn_schemas(spark)).withColumns({"said": F.get_json_object("json", "$.arguments.text"), "result": F.get_json_object("json", "$.result")})
    assert rows(linked.select("conv_id", "call_id", "said", "result", "status", "level", "n_results")) == by_repr([
        (1, "a", "first", "one", "linked", 0, 3), (1, "a", "other", None, "duplicate call", 0, 0), (1, "a", "later", None, "duplicate call", 2, 0), (1, "b", "b", None, "unanswered", 1, 0), (1, "a", None, "two", "duplicate result", None, 2),
        (1, None, "no id", None, "unlinkable", 2, 0), (1, None, "no id 2", None, "unlinkable", 0, 0), (None, "a", "x", None, "unlinkable", 0, 0), (None, "a", "y", None, "unlinkable", 0, 0),
        (None, "a", None, "p", "unlinkable", None, 1), (None, "a", None, "p", "unlinkable", None, 1), (1, None, None, "q", "unlinkable", None, 1), (1, "z", None, "s", "orphan", None, 2), (1, "z", None, "t", "duplicate result", None, 1),
    ])
    null_turns = spark.createDataFrame([(1, None, "assistant", "x"), (1, None, "assistant", "y"), (2, 1, "assistant", "x"), (2, 1, "assistant", "y"), (None, 1, "assistant", "x"), (None, 1, "assistant", "y")], "conv_id bigint, turn bigint, role string, text string")
    assert toolcalls.digest(null_turns).select("json_sha256").distinct().count() == 4 and toolcalls.digest(null_turns).count() == 6


def test_search(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    data += [(300 + i, data[5][1]) for i in range(60)] + [(None, data[1][1]), (400, None), (420, [float("nan")] * 8), (440, [1.0, None]), (460, []), (480, [0.5, 0.25])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    got = rows(search.exact_topk(df, F.col("vec_id") % 20 == 0, k=7, block=64))
    vec = {i: np.pad(np.floor(np.array(v) * 64).astype(int), (0, 8 - len(v))) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in vec:
        if q % 20 == 0:
            best = sorted((-int(vec[q] @ v), i) for i, v in vec.items() if i != q)[:7]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == by_repr(want)
    assert search.exact_topk(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_repeated_queries(spark):
    """A query row that is repeated is searched once; each different vector of one id has a search of its own."""
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1, 120)]
    other = [float(x) for x in rng.normal(size=8)]
    repeated = data + [data[19], data[19], (20, [*data[19][1], 0.0]), (40, other), (41, data[40][1]), (41, data[40][1])]
    df = spark.createDataFrame(repeated, "vec_id bigint, embedding array<double>")
    vec = [(i, np.pad(np.floor(np.array(v) * 64).astype(int), (0, 9 - len(v)))) for i, v in repeated]
    want = []
    for q in (20, 40):
        for no, v in enumerate(sorted({tuple(v.tolist()) for i, v in vec if i == q}), 1):
            best = sorted((-int(np.array(v) @ c), i) for i, c in vec if i != q)[:20]
            want += [(q, no, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    got = rows(search.exact_topk(df, F.col("vec_id").isin(20, 40), block=32, query_no=True))
    assert got == by_repr(want) and [sum(r[:2] == x for r in got) for x in ((20, 1), (40, 1), (40, 2))] == [20, 20, 20]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    assert spark_rows(registry.queries()[name](spark, sf_dir)) == duck_rows(registry.oracle_sql()[name], sf_dir)


def test_names():
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 14))
