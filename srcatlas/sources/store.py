"""The index as Parquet, kept by bucket.

All relations are partitioned by a hash bucket of the path. They hold the path in
ASCII lower case too (``folded``) and are sorted by it inside a bucket, so that
questions about path prefixes skip row groups and pages. A write puts the
buckets that it changes into a directory of its own (``home``) and then
publishes a version: one small file, created only if no other has its number,
that says which home each bucket has. A reader takes the last whole version and
reads no other, so it never sees half of a write. A job that dies leaves an
unused directory, or a version that is not whole and that all others skip; of
two jobs that change the same version the second one fails. Files that no
version names any more are removed by ``forget_versions``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from srcatlas.functions.paths import ascii_lower, folded_prefix
from srcatlas.operators.declarations import extract_symbols
from srcatlas.plans.index import FILE_COLUMNS, SYMBOL_COLUMNS, Index, drop_files, empty_index, scan_changes
from srcatlas.schema import DELETED, FILES_INDEX, SYMBOLS
from srcatlas.sources.tree import IGNORE_FILES, list_corpus, read_contents

BUCKETS = 64
RELATIONS = {"files": FILES_INDEX, "symbols": SYMBOLS, "deleted": DELETED}


def bucket(path: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


class VersionConflict(Exception):
    """Another job has published since this one read the index; nothing was changed."""


def _folder(spark: SparkSession, path: str):
    """A path with its file system, as Spark sees it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, directory: str) -> list[int]:
    """Numbers of all versions, whole or not, in rising order."""
    files, folder = _folder(spark, f"{directory}/versions")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _version_file(directory: str, version: int) -> str:
    return f"{directory}/versions/{version:012d}.json"


def _homes(spark: SparkSession, directory: str, version: int) -> list[Row]:
    """The rows of a version, one for each bucket; none where it is not whole."""
    rows = spark.read.schema("bucket INT, home STRING, buckets INT").json(_version_file(directory, version)).collect()
    return rows if rows and len(rows) == rows[0].buckets and all(r.home for r in rows) else []


def published(spark: SparkSession, directory: str, version: int | None = None) -> tuple[int, list[Row]]:
    """The last (or a given) whole version and its rows (bucket, home, buckets); 0 and no rows where no index is.

    A given version that does not exist, or is not whole, is an error.
    """
    known = versions(spark, directory)
    if version is not None and version not in known:
        raise ValueError(f"no version {version} in {directory}/versions")
    for number in reversed(known) if version is None else [version]:
        rows = _homes(spark, directory, number)
        if rows:
            return number, rows
    if version is not None:
        raise ValueError(f"version {version} in {directory}/versions is not whole")
    return 0, []


def current_version(spark: SparkSession, directory: str) -> int:
    """Number of the last whole version, 0 when there is none."""
    return published(spark, directory)[0]


def _next(spark: SparkSession, directory: str) -> int:
    return max(versions(spark, directory), default=0) + 1


def forget_versions(spark: SparkSession, directory: str, keep: int = 1) -> None:
    """Removes all but the last ``keep`` whole versions, and the files that no version left names.

    For a time when no job reads an older version or writes a new one.
    """
    kept: dict[int, list[Row]] = {}
    for number in reversed(versions(spark, directory)):
        rows = _homes(spark, directory, number) if len(kept) < keep else []
        if rows:
            kept[number] = rows
        else:
            files, path = _folder(spark, _version_file(directory, number))
            files.delete(path, False)
    used = {f"home={r.home}" for rows in kept.values() for r in rows}
    for name in RELATIONS:
        files, folder = _folder(spark, f"{directory}/{name}")
        for found in files.listStatus(folder) if files.exists(folder) else []:
            if found.getPath().getName() not in used:
                files.delete(found.getPath(), True)


def _write(rows: DataFrame, key: str, order: list[str], target: str, buckets: int, tasks: int) -> None:
    (rows.withColumn("folded", ascii_lower(F.col(key))).withColumn("bucket", bucket(F.col(key), buckets))
     .repartition(tasks, "bucket").sortWithinPartitions("bucket", *order)
     .write.partitionBy("bucket").parquet(target))


def _publish(index: Index, directory: str, version: int, buckets: int, touched: list[int], homes: dict[int, str]) -> None:
    """Writes the touched buckets, then the version that names a home for them and all others."""
    home = f"v{version}-{uuid.uuid4().hex}"
    _write(index.files, "path", ["folded", "path"], f"{directory}/files/home={home}", buckets, len(touched))
    _write(index.symbols, "file", ["folded", "file", "pos"], f"{directory}/symbols/home={home}", buckets, len(touched))
    if index.deleted is not None:
        _write(index.deleted, "path", ["folded", "path"], f"{directory}/deleted/home={home}", buckets, len(touched))
    rows = [{"bucket": b, "home": h, "buckets": buckets} for b, h in sorted((homes | dict.fromkeys(touched, home)).items())]
    files, path = _folder(index.files.sparkSession, _version_file(directory, version))
    try:
        out = files.create(path, False)
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        raise VersionConflict(f"version {version} of {directory} was published by another job") from e
    out.write(bytearray("".join(json.dumps(r) + "\n" for r in rows).encode()))
    out.close()


def write_index(index: Index, directory: str, buckets: int = BUCKETS) -> int:
    """Writes all of an index as a new version and returns its number."""
    version = _next(index.files.sparkSession, directory)
    _publish(index, directory, version, buckets, list(range(buckets)), {})
    return version


def read_index(spark: SparkSession, directory: str, version: int | None = None, only: list[int] | None = None,
               prefix: str | None = None) -> Index:
    """The current (or a given) version, some of its buckets, or what it has of paths that start with ``prefix``.

    An empty index when there is none. ``prefix`` is taken as ``path_prefix``
    takes it, and restricts files and symbols alike at their scans.
    """
    homes: dict[str, list[int]] = {}
    for row in published(spark, directory, version)[1] if version != 0 else []:
        if only is None or row.bucket in only:
            homes.setdefault(row.home, []).append(row.bucket)
    if not homes:
        return empty_index(spark)

    def load(name):
        files, folder = _folder(spark, f"{directory}/{name}")
        there = {s.getPath().getName() for s in files.listStatus(folder)} if files.exists(folder) else set()
        known = {h: b for h, b in homes.items() if f"home={h}" in there}
        if not known:  # no feed has written here
            return spark.createDataFrame([], RELATIONS[name])
        extra = [T.StructField("folded", T.StringType()), T.StructField("home", T.StringType()), T.StructField("bucket", T.IntegerType())]
        rows = spark.read.schema(T.StructType([*RELATIONS[name].fields, *extra])).option("basePath", f"{directory}/{name}").parquet(
            *[f"{directory}/{name}/home={h}" for h in known])
        rows = rows.where(reduce(lambda a, b: a | b, [(F.col("home") == h) & F.col("bucket").isin(b) for h, b in known.items()]))
        if prefix is not None:
            rows = rows.where(folded_prefix(F.col("folded"), prefix))
        return rows.select(*RELATIONS[name].fieldNames())

    return Index(*map(load, RELATIONS))


def stored_symbols(spark: SparkSession, directory: str, prefix: str, ordered: bool = True) -> DataFrame:
    """Symbols of the stored files whose path starts with ``prefix``.

    Each symbol of a version has its file in that version, so the symbols are
    all that is read; rows are exchanged only to be put in order.
    """
    rows = read_index(spark, directory, prefix=prefix).symbols
    return rows.orderBy("file", "line", "pos") if ordered else rows


def update_index(spark: SparkSession, directory: str, paths: DataFrame, change: Callable[[Index], Index],
                 buckets: int = BUCKETS) -> int:
    """Reads and writes only the buckets that hold ``paths`` (column ``path``); returns the version.

    ``change`` maps the index of these buckets to what they become; all paths
    that it adds must be among ``paths``. Without paths nothing is written. An
    index that exists keeps its number of buckets.
    """
    following = _next(spark, directory)  # before the read: what is published from now on takes this number first
    version, rows = published(spark, directory)
    buckets = rows[0].buckets if rows else buckets
    touched = sorted(r[0] for r in paths.select(bucket(F.col("path"), buckets)).distinct().collect())  # at most ``buckets``
    if not touched:
        return version
    part = read_index(spark, directory, version, touched)
    homes = {r.bucket: r.home for r in rows}
    if not rows:  # a first version has a home for each bucket
        touched = list(range(buckets))
    changed = change(part)
    if changed.deleted is None:
        changed = replace(changed, deleted=part.deleted)
    _publish(changed, directory, following, buckets, touched, homes)
    return following


def refresh_stored(spark: SparkSession, directory: str, files: DataFrame, contents=None, scope: str | None = None,
                   lang: str | None = None, cap: int | None = None, buckets: int = BUCKETS) -> int:
    """Brings the stored index up to date with ``files``, as ``refresh_index`` does; returns the version.

    The listing is walked once: what differs is written below ``scans`` and read
    from there by all that follows. Only buckets with a difference are rewritten.
    """
    found = scan_changes(files, read_index(spark, directory), scope, lang).where("status <> 'unchanged'")
    where = f"{directory}/scans/{uuid.uuid4().hex}"
    found.write.parquet(where)
    state = spark.read.schema(found.schema).parquet(where)
    stale = state.where("status IN ('new', 'changed')")
    fetched = contents(stale) if contents else files.join(stale.select("path").hint("merge"), "path", "left_semi")
    fresh = extract_symbols(fetched, cap=cap, ordered=False)

    def change(part: Index) -> Index:
        kept = drop_files(part, state)
        return Index(kept.files.unionByName(stale.select(*FILE_COLUMNS)), kept.symbols.unionByName(fresh.select(*SYMBOL_COLUMNS)))

    return update_index(spark, directory, state, change, buckets)


def refresh_tree(spark: SparkSession, directory: str, root: str, ignore: Sequence[str] = IGNORE_FILES, **options) -> int:
    """Brings the stored index up to date with a directory tree, without what its ignore files name; returns the version.

    A file that has come to be ignored counts as deleted. ``options`` are those of ``refresh_stored``.
    """
    listed = list_corpus(spark, root, ignore=ignore)
    return refresh_stored(spark, directory, listed, contents=lambda stale: read_contents(stale, root), **options)
