"""Corpus preparation: each stage reads what the one before it kept.

Language ID lets documents go whose language is unknown; exact dedup and near-dedup keep one document of each
group; personal data is blanked in the texts; what is left is packed into training sequences. Every stage is
given the documents as a table and returns one; between stages they are written to the shared folder.

Defined results, alike in every stage: nulls in columns other than doc_id and text never matter and come back as they
were, as do extra columns, whatever their names; an empty table gives an empty one with the same columns. What a
stage does with null, empty and very long texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import exact_dedup, langid, minhash, packing, pii
from lodestar.llm.common import materialize, read_table
from lodestar.session import ship

#: The least share of n-grams that the language's filter must hold. Clean documents lie far above.
LEAST_SCORE = 0.2


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus's own labels teach.

    Null texts and texts without a letter have no language and go; a tie between languages keeps the document; texts
    are read whole; repeated rows are judged each; without any label every document goes."""
    ship(spark)
    return langid.keep_known(docs, "text", langid.learn(docs, "doc_id", "text", "lang"), LEAST_SCORE)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    Null and empty texts are equal; a null id is the smallest; of rows equal in id and text one stays; very long texts
    are compared whole."""
    return exact_dedup.drop_copies(docs, "doc_id", "text")


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles the one with the smallest id.

    Texts without words are linked with nothing and stay; a null id is the largest; of several rows with the smallest
    id the one whose text hashes lowest stays, of rows equal in id and text one; very long texts count whole."""
    ship(spark)
    return minhash.keep_one(docs, "doc_id", "text")


def stage_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text.

    A null text stays null with its n_chars, an empty one empty; of overlapping spans the one that begins first, and of
    those the longest, names the blank; repeated rows and very long texts are redacted each, whole."""
    ship(spark)
    return pii.redact(docs, "text", "n_chars")


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids, within packing.PRODUCTION.

    A null or empty text is its end id alone; a null id stays null; repeated rows are packed each; a very long text is
    cut over as many sequences as it fills; ties between items go to the one that came first."""
    ship(spark)
    return packing.digest(packing.pack(docs, "doc_id", "text", packing.PRODUCTION, prompt=packing.PROMPT))


STAGES = [("language", stage_language), ("exact", stage_exact), ("near", stage_near), ("private", stage_private), ("packing", stage_pack)]

#: Language, similarity and tokenizer stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
