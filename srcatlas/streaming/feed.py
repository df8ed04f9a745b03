"""Index maintenance from a stream of file changes.

The feed has path, mtime_secs, mtime_nanos, op ('upsert' or 'delete') and
content. Each micro-batch keeps the newest change per path and replaces those
files; only the buckets that hold them are read and written. A replayed batch
writes the same rows again, an empty one writes nothing.

Changes may come in any order, within a batch and across batches: a deletion
leaves its time in the index, and an older change of that path has no effect. Of
changes with one time the deletion counts. ``keep_secs`` says how much older than
the newest change of a batch a change may be; times of deletions before that are
forgotten when their bucket is next written. Without it none is forgotten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from srcatlas.functions.langs import detect_lang
from srcatlas.functions.paths import clamp_mtime
from srcatlas.operators.declarations import extract_symbols
from srcatlas.plans.index import Index, drop_files, upsert_files
from srcatlas.schema import DELETED
from srcatlas.sources.store import BUCKETS, update_index


def newest_changes(batch: DataFrame) -> DataFrame:
    """The latest change of each path; partial aggregation does most of the
    work before the exchange, so a path with very many changes is harmless."""
    order = F.struct("mtime_secs", "mtime_nanos", F.col("op") == "delete")
    newest = batch.groupBy("path").agg(
        F.max_by(F.struct("mtime_secs", "mtime_nanos", "op", "content"), order).alias("c"))
    return newest.select("path", detect_lang(F.col("path")).alias("lang"), "c.*")


def apply_changes(index: Index, batch: DataFrame, cap: int | None = None, keep_secs: int | None = None) -> Index:
    """One micro-batch applied to an index; older changes than the indexed
    state of a file, or its deletion, are left out. Times are clamped first, as the index holds them."""
    for name, time in zip(("mtime_secs", "mtime_nanos"), clamp_mtime(F.col("mtime_secs"), F.col("mtime_nanos"))):
        batch = batch.withColumn(f"_{name}", time.cast(batch.schema[name].dataType))
    batch = batch.drop("mtime_secs", "mtime_nanos").withColumnsRenamed({"_mtime_secs": "mtime_secs", "_mtime_nanos": "mtime_nanos"})
    time = F.struct("mtime_secs", "mtime_nanos", F.col("op") == "delete")
    deleted = index.deleted if index.deleted is not None else index.files.sparkSession.createDataFrame([], DELETED)
    last = index.files.selectExpr("path", "struct(mtime_secs, mtime_nanos, false) AS last").unionByName(
        deleted.selectExpr("path", "struct(mtime_secs, mtime_nanos, true) AS last"))
    changes = newest_changes(batch).join(last, "path", "left").where(F.col("last").isNull() | (time >= F.col("last"))).drop("last")
    upserts, deletes = changes.where(F.col("op") == "upsert"), changes.where(F.col("op") == "delete")
    updated = drop_files(upsert_files(index, upserts, extract_symbols(upserts, cap=cap, ordered=False)), deletes)
    left = deleted.join(changes.select("path"), "path", "left_anti").unionByName(deletes.select(*DELETED.fieldNames()))
    if keep_secs is not None:
        newest = batch.agg(F.max("mtime_secs")).first()[0]
        left = left.where(F.col("mtime_secs") >= newest - keep_secs) if newest is not None else left
    return Index(updated.files, updated.symbols, left)


def apply_change_feed(feed: DataFrame, directory: str, checkpoint: str, buckets: int = BUCKETS,
                      cap: int | None = None, keep_secs: int | None = None, **trigger):
    """Starts a query that keeps the index in ``directory`` up to date."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            update_index(spark, directory, batch.select("path"), lambda index: apply_changes(index, batch, cap, keep_secs), buckets)
        finally:
            batch.unpersist()

    return (feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
