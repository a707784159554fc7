"""Corpus pipeline: five stages of the llm operators over `documents`.

Cases, beside those of the operators: texts that are null or without a letter
leave in the first stage; a document cut to nothing stays, as an empty text;
rows with null or equal ids are rows of their own; more columns than those of
`documents` come along up to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, language_id, minhash, packing, suffix_dedup
from factloom.llm.graph import saved
from factloom.llm.queries import fold, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: a score of 0.4, which no text in a learned script on the held-out fold of sf0.1 misses."""
    return language_id.keep_languages(docs, language_id.fit(docs, fold() != 0), least=0.4)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles)."""
    return minhash.keep_first(docs, percent=80)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur twice, cut at whole characters."""
    out = suffix_dedup.suffix_dedup(docs, carry=True, whole_chars=True, shard_bytes=1 << 20)
    text = F.when(F.col("rest.text_null"), F.lit(None)).otherwise(F.col("kept").cast("string"))
    out = out.select(*(F.col(f"rest.c.{c}").alias(c) if c not in ("doc_id", "text", "n_chars") else {"doc_id": F.col("id").alias("doc_id"), "text": text.alias("text"), "n_chars": F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars")}[c] for c in docs.columns))
    return out


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", suffixes), ("benchmark decontamination", benchmark), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
