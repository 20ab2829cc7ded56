"""A corpus pipeline of five stages over ``documents``; part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents, further ones included,
whatever their names. Texts of any length are read whole, an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers

from tidemark.llm import common, decontamination, exact_dedup, near_dedup, quality, sentencepiece_codec
from tidemark.llm.queries import learned


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier rejects go; it learns from labels outside the held-out fold.

    A null text is scored as an empty one; rows that repeat a text stay or go together; a null doc_id is never learned from.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learned("doc_id", 5, 0))
    return quality.score(docs, model, at_least=quality.THRESHOLD)


def exact_stage(spark, docs, sf_dir):
    """Of equal texts the one with the largest doc_id stays; null texts are empty ones, and of rows that repeat a doc_id too the least by their columns stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark, docs, sf_dir):
    """Of each group of near duplicates (five words, similarity 0.8) the one with the smallest doc_id stays; texts without words are in no group and stay."""
    return near_dedup.drop_near_copies(docs, percent=80)


def clean_stage(spark, docs, sf_dir):
    """Documents that hold enough of a benchmark item go; null and empty texts are clean, rows that repeat a text go together."""
    return decontamination.search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean_only=True)


def encode_stage(spark, docs, sf_dir):
    """The texts that are left, encoded and decoded: a digest of the piece ids and of the text that comes back; a null text counts as empty."""
    return sentencepiece_codec.digests(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", clean_stage),
    ("sentencepiece", encode_stage),
]

#: A learned model and an encoder: not to be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over documents, each written as Parquet and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.staged(docs, name)
    return docs
