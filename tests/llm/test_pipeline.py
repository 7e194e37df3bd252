"""The pipeline stage by stage against brute force."""

import brute
import corpus_pipeline as cp
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import mixing, pieces


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(cp.STAGES)
    assert 4 <= len(stages) <= 5

    known = stages["language_id"](spark, docs, sf_dir)
    assert known.columns == docs.columns and known.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()

    kept = stages["ngram_jaccard_join"](spark, docs, sf_dir)
    want = sorted({c for _, _, c in brute.jaccard([(r["doc_id"], r["text"]) for r in docs.collect()])})
    assert sorted(r["doc_id"] for r in kept.collect()) == want and kept.columns == docs.columns

    cut = stages["substring_dedup"](spark, kept, sf_dir)
    plain = [(r["doc_id"], r["text"]) for r in kept.collect()]
    units = [brute.words(t) for _, t in plain]
    flags = brute.removed(units, 35)
    want = {i: (t if not any(f) else " ".join(w for w, x in zip(u, f, strict=True) if not x)) for (i, t), u, f in zip(plain, units, flags, strict=True)}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want
    assert cut.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    mixed = stages["mixing"](spark, cut, sf_dir)
    copies = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix_digest(cut).where("size > 0").collect()}
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert {k: v for k, v in copies.items() if v} == {k: v for k, v in got.items() if k in copies} and mixed.columns == docs.columns

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    encoded = stages["sentencepiece"](spark, cut, sf_dir).collect()
    assert {r["doc_id"]: r["ids"] for r in encoded} == {i: sp.encode(t) for i, t in want.items()}


def test_repeated_rows_and_clashes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    docs = docs.unionByName(docs.limit(5)).withColumns({c: F.lit(0) for c in ("lang_pred", "score", "kept", "copies", "row", "component_id")})
    docs = docs.unionByName(spark.createDataFrame([(999, None, None, None, None)] * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint"), allowMissingColumns=True)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        if name == "ngram_jaccard_join":
            assert out.count() == out.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_near_duplicates_keep_unlinked_rows(spark, sf_dir):
    """Null and repeated ids: rows stay unless their texts link; a null-id copy doesn't displace its document."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (7, text(2)), (8, text(3)), (8, text(4)), (9, text(5)), (9, text(5)), (10, None), (10, None), (None, text(0))]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r["doc_id"], r["text"]) for r in cp.drop_near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted([(None, text(0)), (None, text(1)), (7, text(2)), (8, text(3)), (8, text(4)), (9, text(5)), (10, None)], key=repr)
