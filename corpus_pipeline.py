"""Cleaning of ``documents`` in stages; each takes what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import given, ident, table
from locusframe.llm.language import learn
from locusframe.llm.near import near_duplicates
from locusframe.llm.packing import pack
from locusframe.llm.repeats import repeats
from locusframe.llm.tries import exact_duplicates
from locusframe.plans.session import scratch


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table has one of them."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _joined(docs: DataFrame, found: DataFrame, how: str) -> tuple[DataFrame, str, str]:
    """``docs`` beside what ``found`` has for an id and text under ``what``; the key's name comes too."""
    key, what = _free(docs, "row_key", "what")
    mine = F.struct(ident("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"))
    found = found.select(F.struct("id", "version").alias(key), F.struct(*[c for c in found.columns if c not in ("id", "version")]).alias(what))
    return docs.withColumn(key, mine).join(found.dropDuplicates([key]), key, how), what, key


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows that ``kept`` names, each once."""
    rows, _, key = _joined(docs, kept.select("id", "version", F.lit(True).alias("kept")), "inner")
    return rows.dropDuplicates([key]).select(*[f"`{c}`" for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those that fit no language of the table."""
    return learn(docs).accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, keep the one with the most characters, then the smallest id."""
    return _only(docs, exact_duplicates(docs).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 0.8), keep the smallest id."""
    return _only(docs, near_duplicates(docs, percent=80).filter("first"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out repeated windows of twenty words; texts without one stay as they are.

    A text of which no word is left is dropped.
    """
    found = repeats(docs, window=20, digest=False).filter("n_removed > 0").select("id", "version", "kept_text")
    rows, what, _ = _joined(docs, found, "left")
    cut = F.col(f"`{what}`.kept_text")
    new = {"text": F.coalesce(cut, "text"), "n_chars": F.when(cut.isNotNull(), F.length(cut).cast("bigint")).otherwise(F.col("n_chars"))}
    return rows.filter(cut.isNull() | (cut != "")).select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the tokens of what is left in sequences of 2048."""
    found = pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    return found.select(given("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", packing),
]

#: Language models and a tokenizer are not SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
