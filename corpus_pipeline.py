"""The corpus pipeline: language ID, near duplicates, repeated passages, mixing, encoding; each stage is written and read again.

STAGES names the functions in order. Each takes (spark, docs, sf_dir), with docs as the last one left them, and all but
the last return the columns of documents. Copies that the mix takes are repeated rows of the same document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import automaton, jaccard, langid, mixing, pieces
from tidemark.llm.common import held_out, scope, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language go on, with lang as predicted; null texts and texts without letters go.

    Repeated rows are judged alike; rows of an empty table, or without a language to learn, all go."""
    model = langid.fit(docs, ~held_out("doc_id", 3, 1))
    found = langid.identify(docs, model, docs.columns).where(F.col("lang_pred") != langid.UNDETERMINED)
    return found.select(*[F.col("lang_pred" if c == "lang" else f"kept.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows stays: the least by doc_id (null last), hash of the text and row key.

    A row is told apart by a hash of all its columns, not by doc_id: unlinked rows stay, whether or not their ids are
    null or repeated, and rows equal in every column are one document. Texts without words link with nothing; of
    these, rows with the same id and text are one document. An empty table gives no rows."""
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("key")
    with scope() as keep:
        sets = jaccard.similar_sets(docs.select(key, F.col("text")), "key").distinct()
        rows = docs.select(key, F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).distinct()
        wordless = (F.col("n_shingles") == 0) & F.col("id").isNotNull()
        group = [F.when(~wordless, F.col("component_id")).alias("component"), F.when(wordless, F.col("id")).alias("of"), F.when(wordless, F.col("hash")).alias("blank")]
        rows = written(sets).join(rows, "key").select(*group, F.struct(F.col("id").isNull(), "id", "hash", "key").alias("order"))
        first = keep(rows.groupBy("component", "of", "blank").agg(F.min("order").alias("order")).select("order.key"))
    names = [F.col(f"doc.`{c}`") for c in docs.columns]
    packed = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    # equal rows lie side by side after the join by key, so the documents are shuffled once
    return packed.join(first.select("key"), "key", "left_semi").dropDuplicates(["key"]).select(*names)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words or more that start anywhere else are removed; n_chars follows the text.

    Every row stays, with null texts as they are; repeated rows lose the same words."""
    rest = automaton.without_repeats(docs, [c for c in docs.columns if c != "text"])
    return rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: repeated rows count one by one, a null source is one more source, and
    rows without words are expected as often as the words of their source on average."""
    mixed = mixing.mix_sources(docs).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each copy; a null text has null ids and -1 tokens."""
    return pieces.encode(docs, ["doc_id", "lang", "source"]).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL has no form of the first and last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
