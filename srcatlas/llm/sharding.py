"""Sharding by global byte-size prefix sums, with DataFrame functions only.

Rows are put in the order of their text's hash, so that equal texts are
adjacent. Prefix sums of the sizes come from per-partition totals
(``common.prefix_sums``), and the total is cut at equal targets: shards are
contiguous and balanced in bytes. A group of equal texts goes whole to the
shard of its middle byte, unless it is larger than the share ``whole`` of a
shard, which the caller states: then its rows are cut like any others, since it
could not be kept whole without breaking the balance. No shard is off its target
by more than that share and a row at either end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import by_class, packed, prefix_sums, private, stored, table

SHARDS = 16


def assign_shards(docs: DataFrame, shards: int, whole: float) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, size, shard, slot.

    Size is the UTF-8 length of the text plus 1 (null: 1, as for an empty
    text). Slots of a shard count from 0 without gaps. Rows that repeat id and
    text get a slot each. Null ids take part. With fewer rows than shards some
    shards stay empty; no rows give no rows. The order depends on texts and
    ids only, so reruns agree.
    """
    text = F.coalesce("text", F.lit(""))
    rows = private(docs, "doc_id", "text").select(
        "doc_id", F.md5(text).alias("text_hash"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.lit(1).cast("long").alias("row"))
    ordered = stored(prefix_sums(rows, ["text_hash", "doc_id"], ["size", "row"], name="shards"), "ordered")
    groups = stored(ordered.groupBy("text_hash").agg(
        F.min("size_before").alias("start"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("members")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 1
    placed = by_class(ordered, groups, "text_hash", heavy=200, most=100_000)
    in_one = F.col("bytes") <= F.lit(whole * total / shards)
    # twice the place, so that the middle of a group is a whole number
    place = F.when(in_one, 2 * F.col("start") + F.col("bytes")).otherwise(2 * F.col("size_before") + F.col("size"))
    placed = placed.withColumn("place", place)
    shard = F.expr(f"CAST(place * {shards} DIV {2 * total} AS INT)")
    sharded = stored(placed.select("doc_id", "text_hash", "text_crc32", "size", "row_before", shard.alias("shard")), "sharded")
    firsts = sharded.groupBy(F.col("shard").alias("_shard")).agg(F.min("row_before").alias("first"))
    return sharded.join(F.broadcast(firsts), F.col("shard") == F.col("_shard")).select(
        "doc_id", "text_hash", "text_crc32", "size", "shard", (F.col("row_before") - F.col("first")).alias("slot"))


def sharded_documents(docs: DataFrame, shards: int, whole: float) -> DataFrame:
    """``docs`` with the columns shard and slot (see ``assign_shards``); columns of those names are replaced.

    Rows that repeat id and text are interchangeable: each gets one of their slots.
    """
    from pyspark.sql import Window

    places = assign_shards(docs, shards, whole)
    key = ["doc_id", "text_hash"]
    places = places.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "shard", "slot",
                           F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot")).alias("_nth"))
    rows = packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.md5(F.coalesce("row.text", F.lit(""))).alias("text_hash"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    both = rows.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & (F.col("nth") == F.col("_nth")))
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    return both.select(*[F.col(f"row.`{c}`") for c in kept], "shard", "slot")


def op10_sharding(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"), SHARDS, whole=0.1).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
