"""Directory trees as a Spark source.

Spark's own file sources skip names that start with ``_`` or ``.`` and keep
times in milliseconds. This one lists everything a plain walk finds, with
nanosecond times, and reads in parallel: each task walks its own directories.
The tree must be on a file system that all executors see.

What a project ignores can be left out by the walk itself: each directory's
ignore files are read when it is opened, their rules go down with the walk, and
a directory that is hidden or ignored is never opened. A prefix of the path, as
an argument or a filter that Spark pushes down, starts the walk below it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, StringStartsWith

from srcatlas.functions.langs import detect_lang, has_extension_of
from srcatlas.operators.tokens import partition_count

BATCH_FILES = 1000
READ_FILES = 64
READ_BYTES = 64 << 20
IGNORE_FILES = (".gitignore", ".ignore")


@dataclass(frozen=True)
class IgnoreRule:
    """One line of an ignore file of ``directory`` ('' for the root)."""

    directory: str
    regex: re.Pattern
    negated: bool
    dir_only: bool

    def hits(self, path: str, is_dir: bool) -> bool:
        below = path[len(self.directory) + 1:] if self.directory else path
        return (is_dir or not self.dir_only) and self.regex.search(below) is not None


def ignore_rule(directory: str, line: str) -> IgnoreRule | None:
    """The rule that a line states, with the meaning of ``scope.parse_ignore_lines``; None for blanks and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    body = line.removeprefix("!").removesuffix("/")
    anchored, body, regex = "/" in body, body.removeprefix("/"), ""
    for piece in re.findall(r"^\*\*/|/\*\*/|/\*\*$|\*+|\?|\[!?[^\]]*\]|.", body):
        if piece.startswith("[") and len(piece) > 1:
            regex += re.sub(r"^\[!", "[^", piece)
        else:
            regex += {"**/": "(?:.*/)?", "/**/": "/(?:.*/)?", "/**": "/.*", "?": "[^/]"}.get(piece, "[^/]*" if piece[0] == "*" else re.escape(piece))
    return IgnoreRule(directory, re.compile(("^" if anchored else "^(?:.*/)?") + regex + "$"), line.startswith("!"), line.endswith("/"))


@dataclass
class Directories(InputPartition):
    """Directories to read, each with the rules from above, with or without what is below it."""

    tops: list[tuple[str, tuple[IgnoreRule, ...], bool]]


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.start = len(self.root.rstrip(os.sep)) + 1
        self.shards = int(options.get("shards", "256"))
        self.ignore = [name for name in options.get("ignore", "").split("/") if name]
        self.below = options.get("below", "")

    def _name(self, path: str) -> str:
        """A path below the root, as the walk makes them, without the root."""
        return path[self.start:].replace(os.sep, "/")

    def _skipped(self, entry: os.DirEntry, rules: tuple[IgnoreRule, ...]) -> bool:
        if not self.ignore:
            return False
        if entry.name.startswith("."):
            return True
        path, is_dir = self._name(entry.path), entry.is_dir(follow_symlinks=False)
        return next((not r.negated for r in reversed(rules) if r.hits(path, is_dir)), False)

    def open(self, top: str, rules: tuple[IgnoreRule, ...]) -> tuple[list[os.DirEntry], tuple[IgnoreRule, ...]]:
        """Entries of a directory that count, by name, and the rules for what is below it; none where it cannot be read."""
        try:
            with os.scandir(top) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError:
            return [], rules
        for entry in entries:
            if entry.name in self.ignore and entry.is_file(follow_symlinks=False):
                lines = (read_file(entry.path) or b"").decode("utf-8", "replace").split("\n")
                rules += tuple(r for line in lines if (r := ignore_rule(self._name(top), line)))
        return [e for e in entries if not self._skipped(e, rules)], rules

    def _start(self) -> tuple[str, tuple[IgnoreRule, ...]] | None:
        """The directory at which the walk starts, with the rules of those above; None where one of them is ignored."""
        top, rules = self.root, ()
        for name in self.below.split("/") if self.below else []:
            entries, rules = self.open(top, rules)
            if not any(e.name == name and e.is_dir(follow_symlinks=False) for e in entries):
                return None
            top = os.path.join(top, name)
        return top, rules

    def partitions(self):
        """Opens directories, level by level, until there are enough to share."""
        start = self._start()
        tops, frontier = [], [start] if start else []
        while frontier and len(frontier) < self.shards:
            level, frontier = frontier, []
            for top, rules in level:
                tops.append((top, rules, False))
                entries, inner = self.open(top, rules)
                frontier += [(e.path, inner) for e in entries if e.is_dir(follow_symlinks=False)]
        tops += [(top, rules, True) for top, rules in frontier]
        count = max(1, min(self.shards, len(tops)))
        return [Directories(tops[i::count]) for i in range(count)]

    def walk(self, top: str, rules: tuple[IgnoreRule, ...], below: bool) -> Iterator[os.DirEntry]:
        pending = [(top, rules)]
        while pending:
            entries, inner = self.open(*pending.pop())
            for entry in entries:
                if entry.is_file(follow_symlinks=False):
                    yield entry
                elif below and entry.is_dir(follow_symlinks=False):
                    pending.append((entry.path, inner))

    def read(self, partition):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("length", pa.int64()),
                            ("mtime_secs", pa.int64()), ("mtime_nanos", pa.int64())])
        rows = []
        for entry in (e for top in partition.tops for e in self.walk(*top)):
            rows.append(self._row(entry))
            if len(rows) >= BATCH_FILES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _row(self, entry: os.DirEntry) -> dict:
        path = self._name(entry.path)
        try:
            stat = entry.stat(follow_symlinks=False)
            secs, nanos, length = stat.st_mtime_ns // 10**9, stat.st_mtime_ns % 10**9, stat.st_size
        except OSError:
            secs, nanos, length = 0, 0, None
        return {"path": path, "length": length, "mtime_secs": secs, "mtime_nanos": nanos}


class PrunedTreeReader(TreeReader):
    """Also takes filters; Spark refuses such a reader where it is told to push none."""

    def pushFilters(self, filters):
        """Takes note of a prefix of the path; Spark still applies every filter."""
        for pushed in filters:
            if isinstance(pushed, StringStartsWith) and pushed.attribute == ("path",):
                folder = pushed.value.rpartition("/")[0]
                if folder.startswith(self.below):
                    self.below = folder
            yield pushed


class SourceTree(DataSource):
    """Lists a tree; the content is read afterwards, by ``read_contents``."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "path STRING, length BIGINT, mtime_secs BIGINT, mtime_nanos BIGINT"

    def reader(self, schema):
        return PrunedTreeReader(self.options) if self.options.get("pushdown") == "true" else TreeReader(self.options)


def read_file(path: str) -> bytes | None:
    """Bytes of a file, or None when it cannot be read."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def file_size(path: str) -> int:
    try:
        return os.stat(path).st_size
    except OSError:
        return 0


def list_corpus(spark: SparkSession, root: str, shards: int = 256, ignore: Sequence[str] = (), below: str = "") -> DataFrame:
    """Every regular file below ``root``: path, lang, length, mtime. No listed
    file is opened.

    ``ignore`` names ignore files, such as ``.gitignore``: hidden entries and what
    those files ignore are left out, and such directories never opened. ``below``
    lists one directory of the tree alone; rules of the directories above it
    count, paths stay relative to ``root``.
    """
    spark.dataSource.register(SourceTree)
    found = (spark.read.format("source_tree").option("shards", str(shards)).option("ignore", "/".join(ignore))
             .option("below", below.strip("/")).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load(root))
    return found.select("path", detect_lang(F.col("path")).alias("lang"), "length", "mtime_secs", "mtime_nanos")


def ignore_lines(spark: SparkSession, root: str, names: Sequence[str] = IGNORE_FILES) -> DataFrame:
    """(dir, rank, line) of all ignore files of a tree, for ``parse_ignore_lines``."""
    listed = list_corpus(spark, root)
    named = listed.where(F.substring_index("path", "/", -1).isin(list(names)))
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")
    return read_contents(named, root).where("content IS NOT NULL").select(
        folder.alias("dir"), F.posexplode(F.split(F.col("content").cast("string"), "\n"))).selectExpr("dir", "CAST(pos AS BIGINT) AS rank", "col AS line")


def read_contents(listed: DataFrame, root: str) -> DataFrame:
    """Listed files with their ``content``; null where a file cannot be read.

    Without a column ``length`` the sizes are asked for first.

    The listing is spread evenly first, so that a directory with very many
    files does not keep one task busy.
    """
    top = os.path.abspath(root)
    schema = T.StructType([*listed.schema.fields, T.StructField("content", T.BinaryType())])

    def fill(batches):
        for batch in batches:
            # a new part where the files so far fill one, in number or in bytes
            size = batch["length"].fillna(0) if "length" in batch else batch["path"].map(lambda p: file_size(os.path.join(top, p)))
            ahead = size.cumsum() - size
            for _, part in batch.groupby([ahead // READ_BYTES, np.arange(len(batch)) // READ_FILES]):
                part = part.copy()
                part["content"] = [read_file(os.path.join(top, p)) for p in part["path"]]
                yield part

    return listed.repartition(partition_count(listed.sparkSession), "path").mapInPandas(fill, schema)


def scan_corpus(spark: SparkSession, root: str, shards: int = 256) -> DataFrame:
    """All files below ``root`` in a known language or not, with content."""
    return read_contents(list_corpus(spark, root, shards), root)


def of_language(files: DataFrame, lang: str) -> DataFrame:
    """The files a query in ``lang`` reads, by extension alone."""
    return files.where(has_extension_of(F.col("path"), lang))


def scan_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A corpus stored as a table of (path, content [, mtime_secs, mtime_nanos])."""
    stored = spark.read.format(fmt).load(path)
    for column in ("mtime_secs", "mtime_nanos"):
        if column not in stored.columns:
            stored = stored.withColumn(column, F.lit(0).cast("bigint"))
    if "lang" not in stored.columns:
        stored = stored.withColumn("lang", detect_lang(F.col("path")))
    return stored


def to_json_rows(rows: DataFrame) -> DataFrame:
    """One JSON object per row, fields in column order; write it as text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
