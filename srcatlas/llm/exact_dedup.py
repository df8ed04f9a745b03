"""Exact dedup by content sort, with DataFrame functions only.

Normalised text is range-partitioned by sampled splitters
(``repartitionByRange``), each partition is sorted externally, and the window
over the sorted rows compares each text in full with its neighbour. The window
reuses the range partitioning, so whole texts are shuffled once.

A text that very many rows share must not meet in one partition. Texts with more
than ``HEAVY_ROWS`` rows (by a hash, counted with map-side partial sums) get a salt
after the text's hash in the sort key, one for each so many rows. Where more than
``HEAVY_KEYS`` texts could have that many, the bound is the ``HEAVY_KEYS``-th part of
all rows: the list is broadcast and so never longer, and no text is left out of it
whose rows would weigh in a partition. Rows of a heavy text are compared in full
within each salt; its salts are then joined by the SHA-256 of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import lower_ascii, private, stored, table

HEAVY_KEYS = 100_000
HEAVY_ROWS = 200
HEAD = 24


def copy_groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. ``keep`` says whether the smallest or the largest id of equal texts
    stays. A null id loses to any other; where all ids of a text are null,
    keep_id is null. Ids may be of any type that has an order. Rows that repeat id and text are copies of one another and
    exactly one of them is kept. An empty table gives no rows. Other columns
    are not read.
    """
    best = F.max if keep == "largest" else F.min
    rows = private(docs, "doc_id", "text").select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("norm"))
    heavy = _heavy_texts(docs)
    salted = rows.withColumn("h", F.xxhash64("norm")).join(F.broadcast(heavy), "h", "left").select(
        "doc_id", "norm", "h", F.when(F.col("heavy"), F.pmod(F.monotonically_increasing_id(), "salts")).otherwise(0).alias("salt"), "heavy")
    # Splitters are sampled on the driver, so they are the first bytes of a text and a hash, not whole texts.
    # Equal texts become adjacent; the window compares neighbours in full.
    order = ["head", "h", "salt"]
    ranged = salted.withColumn("head", F.substring("norm", 1, HEAD)).repartitionByRange(*order)
    by_text = Window.partitionBy(*order, "norm")
    first = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    sorted_rows = ranged.select(
        "doc_id", "salt", "heavy", "norm", F.row_number().over(by_text.orderBy(first)).alias("nth"),
        best("doc_id").over(by_text).alias("best"), F.count(F.lit(1)).over(by_text).alias("n"))
    found = stored(sorted_rows.select("doc_id", "salt", "heavy", "nth", "best", "n", F.sha2("norm", 256).alias("text_sha256")), "dedup")

    light = found.where("heavy IS NULL").select(
        "doc_id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), (F.col("nth") == 1).alias("kept"), "text_sha256")
    # one row for each salt of a heavy text
    parts = found.where("heavy AND nth = 1").select("text_sha256", "salt", "best", "n")
    if keep == "largest":  # a null sorts first
        keep_salt = -F.max(F.struct("best", (-F.col("salt")).alias("salt")))["salt"]
    else:
        keep_salt = F.min(F.struct(F.col("best").isNull().alias("without"), "best", "salt"))["salt"]
    whole = parts.groupBy("text_sha256").agg(
        best("best").alias("keep_id"), F.sum("n").alias("group_size"),
        keep_salt.alias("keep_salt"))
    hot = found.where("heavy").join(F.broadcast(whole), "text_sha256").select(
        "doc_id", "keep_id", "group_size", ((F.col("nth") == 1) & (F.col("salt") == F.col("keep_salt"))).alias("kept"), "text_sha256")
    return light.unionByName(hot)


def _heavy_texts(docs: DataFrame) -> DataFrame:
    """Hashes of the most frequent texts and their salts; equal normalised texts have equal hashes. At most HEAVY_KEYS rows."""
    keys = private(docs, "text").select(F.xxhash64(lower_ascii(F.coalesce("text", F.lit("")))).alias("h"))
    counts = stored(keys.groupBy("h").count().where(F.col("count") > HEAVY_ROWS), "frequent")
    bound = max(HEAVY_ROWS, (counts.agg(F.sum("count")).first()[0] or 0) // HEAVY_KEYS)
    return counts.where(F.col("count") > bound).select("h", F.ceil(F.col("count") / bound).alias("salts"), F.lit(True).alias("heavy"))


def exact_dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The ids that stay, one row per distinct text (see ``copy_groups``)."""
    return copy_groups(docs, keep).where("kept").select("doc_id", "text_sha256", "group_size")


def op7_exact_dedup(spark, sf_dir):
    return copy_groups(table(spark, sf_dir, "documents"))


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_NORM} AS norm FROM documents) WINDOW w AS (PARTITION BY norm)
"""
