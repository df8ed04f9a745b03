"""The symbol index: two relations, kept in step with a corpus.

A refresh is one comparison of listings (path and time) followed by joins; only
the content of stale files is read and cut into tokens. Every function returns
new relations and leaves its inputs alone.

A corpus has many paths and symbols, and where they are computed Spark takes
them for as small as what they are computed from and would broadcast all of
them through the driver. So joins by path ask for a merge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from srcatlas.functions.paths import clamp_mtime
from srcatlas.operators.declarations import extract_symbols
from srcatlas.operators.scope import in_scope, with_prefix
from srcatlas.schema import DELETED, FILES_INDEX, SYMBOLS

FILE_COLUMNS = FILES_INDEX.fieldNames()
SYMBOL_COLUMNS = SYMBOLS.fieldNames()


@dataclass(frozen=True)
class Index:
    """``files``: path, lang, mtime; ``symbols``: name, kind, file, line, pos.

    ``deleted`` (path, mtime) has the time of each deletion that a feed has
    brought; an index that takes in listings only has none.
    """

    files: DataFrame
    symbols: DataFrame
    deleted: DataFrame | None = None


def empty_index(spark: SparkSession) -> Index:
    return Index(*(spark.createDataFrame([], schema) for schema in (FILES_INDEX, SYMBOLS, DELETED)))


def listed(files: DataFrame) -> DataFrame:
    """Path, language and clamped time of every file in a known language."""
    secs, nanos = clamp_mtime(F.col("mtime_secs"), F.col("mtime_nanos"))
    return files.where(F.col("lang").isNotNull()).select(
        "path", "lang", secs.alias("mtime_secs"), nanos.alias("mtime_nanos"))


def cached_mtimes(index: Index, prefix: str) -> DataFrame:
    """Indexed times of the files whose path starts with ``prefix``."""
    return with_prefix(index.files, prefix).select("path", "mtime_secs", "mtime_nanos")


def scan_changes(files: DataFrame, index: Index, scope: str | None = None, lang: str | None = None) -> DataFrame:
    """path, lang, mtime and status of every file found or indexed in scope.

    A file is ``changed`` when its time differs from the indexed one, be it
    older or newer. Times are those found, or the indexed ones when deleted.
    """
    found = in_scope(listed(files), scope, lang)
    known = in_scope(index.files, scope, lang).select(
        F.col("path").alias("known_path"), F.col("lang").alias("known_lang"),
        F.col("mtime_secs").alias("known_secs"), F.col("mtime_nanos").alias("known_nanos"))
    both = found.join(known.hint("merge"), F.col("path") == F.col("known_path"), "full_outer")
    status = (F.when(F.col("known_path").isNull(), "new")
              .when(F.col("path").isNull(), "deleted")
              .when((F.col("mtime_secs") == F.col("known_secs")) & (F.col("mtime_nanos") == F.col("known_nanos")),
                    "unchanged")
              .otherwise("changed"))
    return both.select(
        F.coalesce("path", "known_path").alias("path"), F.coalesce("lang", "known_lang").alias("lang"),
        F.coalesce("mtime_secs", "known_secs").alias("mtime_secs"),
        F.coalesce("mtime_nanos", "known_nanos").alias("mtime_nanos"), status.alias("status"))


def upsert_files(index: Index, files: DataFrame, symbols: DataFrame) -> Index:
    """Replaces the given files and all their symbols."""
    rows = listed(files)
    paths = rows.select("path").hint("merge")
    return Index(
        index.files.join(paths, "path", "left_anti").select(*FILE_COLUMNS).unionByName(rows),
        index.symbols.join(paths.withColumnRenamed("path", "file").hint("merge"), "file", "left_anti").select(*SYMBOL_COLUMNS)
        .unionByName(symbols.select(*SYMBOL_COLUMNS)))


def drop_files(index: Index, paths: DataFrame) -> Index:
    """Removes files (``path``) and, with them, their symbols."""
    kept = index.files.join(paths.select("path").hint("merge"), "path", "left_anti").select(*FILE_COLUMNS)
    symbols = index.symbols.join(kept.select(F.col("path").alias("file")).hint("merge"), "file", "left_semi")
    return Index(kept, symbols.select(*SYMBOL_COLUMNS))


def prune_deleted(index: Index, existing: DataFrame, scope: str | None = None, lang: str | None = None) -> Index:
    """Drops the files in scope that are not in ``existing``, with their symbols."""
    return drop_files(index, in_scope(index.files, scope, lang).join(existing.select("path").hint("merge"), "path", "left_anti"))


def refresh_index(index: Index, files: DataFrame, scope: str | None = None, lang: str | None = None,
                  cap: int | None = None, contents=None) -> Index:
    """Brings the index up to date with ``files``, inside a scope if given.

    ``contents`` maps listed stale files to files with content; by default the
    rows of ``files`` already carry it.
    """
    state = scan_changes(files, index, scope, lang)
    stale = state.where(F.col("status").isin("new", "changed"))
    fetched = contents(stale) if contents else files.join(stale.select("path").hint("merge"), "path", "left_semi")
    fresh = extract_symbols(fetched, cap=cap, ordered=False)
    # Files and symbols that need no work: unchanged, or outside the scope.
    settled = state.where(F.col("status") != "unchanged").select("path")
    outside = index.files.join(state.select("path").hint("merge"), "path", "left_anti")
    return Index(
        state.where(F.col("status") != "deleted").select(*FILE_COLUMNS).unionByName(outside.select(*FILE_COLUMNS)),
        index.symbols.join(settled.withColumnRenamed("path", "file").hint("merge"), "file", "left_anti").select(*SYMBOL_COLUMNS)
        .unionByName(fresh.select(*SYMBOL_COLUMNS)))


def rebuild_index(files: DataFrame, cap: int | None = None) -> Index:
    """An index built from nothing: no comparison, one pass over the files."""
    return Index(listed(files), extract_symbols(files, cap=cap, ordered=False).select(*SYMBOL_COLUMNS))


def _symbols_of(files: DataFrame, index: Index, ordered: bool) -> DataFrame:
    joined = index.symbols.join(files.select(F.col("path").alias("file")).hint("merge"), "file")
    rows = joined.select("name", "kind", "file", "line", "pos")
    return rows.orderBy("file", "line", "pos") if ordered else rows


def symbols_for_prefix(index: Index, prefix: str, ordered: bool = True) -> DataFrame:
    """Symbols of the indexed files whose path starts with ``prefix``."""
    return _symbols_of(with_prefix(index.files, prefix), index, ordered)


def list_symbols(index: Index, files: DataFrame | None = None, path: str | None = None, lang: str | None = None,
                 ordered: bool = True, cap: int | None = None) -> DataFrame:
    """Symbols under a path, after a refresh when ``files`` are given.

    ``lang`` may be any name of a language in any case; an unknown one restricts nothing.

    The language restricts the refresh and the answer; the rest of the index
    is left as it is.
    """
    if files is not None:
        index = refresh_index(index, files, path, lang, cap)
    return _symbols_of(in_scope(index.files, path, lang), index, ordered)
