"""A corpus pipeline out of five operators; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, jaccard, langid, linededup, mixing
from millrace.llm.frames import durable, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages of docs and drops what is in none of them.

    Texts without a letter, null ones among them, go; equal texts stay or go
    together; where no row has a language, all go.  An empty table stays empty.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    return langid.known_language(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of texts whose five-word shingles are alike to 0.8 or more.

    Rows without a doc_id or without words stay; rows that repeat a doc_id stay
    or go together.  An empty table stays empty.
    """
    return jaccard.keep_one_each(docs, words=5, num=4, den=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and runs of sentences that an earlier document has are cut; documents that this empties go.

    Null and empty texts stay as they are; of equal texts the least doc_id
    keeps its own, rows without one come last.  An empty table stays empty.
    """
    done = linededup.drop_repeats(docs)
    done = done.where((F.size("removed_spans") == 0) | (F.trim("text", F.lit(" \t\r\n")) != "")).withColumn("n_chars", F.when(F.size("removed_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target weights.

    A null source is a source; a text without words stays where its source
    keeps whole copies.  Reruns agree, ties and repeated rows included.  An
    empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoded text: doc_id, source, ids, decoded, n_tokens.

    A null text counts as empty; repeated rows each get their tokens.  An empty
    table gives an empty result.
    """
    done = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), ("doc_id", "source"))
    return done.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("tokens", tokens)]

#: No SQL can express the trained and random stages; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
