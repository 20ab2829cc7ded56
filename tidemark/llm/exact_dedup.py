"""Exact deduplication with a heavy-hitter split.

Digests that many rows share are found by Misra-Gries summaries, one per task,
which merge into one of HITTERS counters. Their exact sizes and winners are
then counted and broadcast, so rows of hot digests are decided where they lie.
All other digests go through an ordinary shuffle.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import one_of_each, staged

#: Counters of a Misra-Gries summary, or 4 for each shuffle partition if that is more: every digest with more than rows / (counters + 1) rows is found.
HITTERS = 1000


def _digests(batches):
    for batch in batches:
        found = [hashlib.sha256((t or "").encode().lower()).digest() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(found, pa.binary())], ["doc_id", "text_key", "digest"])


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, digest): the digest is SHA-256 of the text in UTF-8 with A-Z lower-cased, null as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_digests, "doc_id long, text_key long, digest binary")


def _shrink(counts: dict, k: int) -> None:
    """Misra-Gries: keep at most k counters, lowering all by the (k + 1)-th largest."""
    if len(counts) > k:
        cut = sorted(counts.values(), reverse=True)[k]
        for key in [key for key, n in counts.items() if n <= cut]:
            del counts[key]
        for key in counts:
            counts[key] -= cut


def summarise(k: int, key: str):
    """A function for mapInArrow that turns a task's rows (key[, n]) into one summary."""

    def run(batches):
        counts: dict = {}
        for batch in batches:
            keys = batch.column(key).to_pylist()
            sizes = batch.column("n").to_pylist() if "n" in batch.schema.names else [1] * len(keys)
            for x, n in zip(keys, sizes, strict=True):
                counts[x] = counts.get(x, 0) + n
                if len(counts) >= 8 * k:  # shrinking seldom costs little and loses no more
                    _shrink(counts, k)
        _shrink(counts, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], [key, "n"])

    return run


def heavy_hitters(rows: DataFrame, key: str = "digest", k: int = HITTERS) -> DataFrame:
    """At most k keys (binary), among them each that more than rows / (k + 1) rows have.

    Summaries of tasks merge in two rounds, so no task reads more summaries than
    the square root of the number of tasks.
    """
    schema = f"{key} binary, n long"
    out = staged(rows.select(key).mapInArrow(summarise(k, key), schema), "summaries")
    some = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    out = out.repartition(some).mapInArrow(summarise(k, key), schema)
    return out if some == 1 else out.repartition(1).mapInArrow(summarise(k, key), schema)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hitters: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256,
    text_key (xxhash64 of the text as it is).

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty. Of equal texts the row with the largest doc_id stays; a null doc_id
    counts as smaller than all others, and is kept only in a group of null
    doc_ids. Rows that repeat both doc_id and text share one decision, and each
    of them counts in group_size. Other columns of docs, whatever their names,
    are not read. An empty table gives an empty result; a text of any length is
    hashed whole.
    """
    hitters = hitters or max(HITTERS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = staged(text_digests(docs, id_col, text_col), "digests")
    # at most `hitters` digests of 32 bytes: that bounds both broadcasts
    suspects = F.broadcast(staged(heavy_hitters(rows, "digest", hitters).select("digest"), "suspects"))
    totals = [F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    winners = staged(rows.join(suspects, "digest").groupBy("digest").agg(*totals), "winners")
    marked = rows.join(F.broadcast(winners), "digest", "left")
    heavy = marked.filter(F.col("group_size").isNotNull())
    rest = marked.filter(F.col("group_size").isNull()).select("doc_id", "text_key", "digest")
    light = rest.join(rest.groupBy("digest").agg(*totals), "digest")
    both = heavy.unionByName(light)
    return both.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_key",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts; all columns stay.

    That is the row with the largest doc_id; where several rows have it, or all
    doc_ids of a group are null, the least of these rows by their columns.
    """
    groups = exact_groups(docs, id_col, text_col).select("doc_id", "text_key", "kept", F.unhex("text_sha256").alias("group_key"))
    return one_of_each(docs, staged(groups, "decisions"), id_col, text_col)
