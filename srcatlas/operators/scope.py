"""Which files count: ignore rules, hidden paths and project roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from srcatlas.functions.langs import find_lang
from srcatlas.functions.paths import ancestors, depth, parent_dir, path_prefix, path_scope

BROADCAST_ROWS = 100_000


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows.

    The check reads no more than ``rows + 1`` rows. A larger side stays a
    shuffled join, whose hot keys (the directories near the root) adaptive
    execution splits.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hidden(path: Column) -> Column:
    """True when a component of the path starts with a dot."""
    return path.rlike(r"(^|/)\.[^/]")


def ignore_regex(pattern: Column) -> Column:
    """Ignore pattern (``*``, ``**``, ``?``, ``[...]``, ``/``) as a regex over
    the path relative to the directory of the rule."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"^!", ""), r"/$", "")
    anchored = F.contains(body, F.lit("/"))
    body = F.regexp_replace(body, r"^/", "")
    # Letters that cannot occur in a path stand in for the wildcards while the
    # other regex characters are escaped.
    for wild, mark in ((r"^\*\*/", "\u0001"), (r"/\*\*/", "\u0002"), (r"/\*\*$", "\u0003"), (r"\*+", "\u0004"), (r"\?", "\u0005")):
        body = F.regexp_replace(body, wild, mark)
    body = F.regexp_replace(body, r"([.+^$(){}|\\])", r"\\$1")
    body = F.regexp_replace(body, r"\[!", "[^")
    for mark, regex in (("\u0001", "(?:.*/)?"), ("\u0002", "/(?:.*/)?"), ("\u0003", "/.*"), ("\u0004", "[^/]*"), ("\u0005", "[^/]")):
        body = F.replace(body, F.lit(mark), F.lit(regex))
    return F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), body, F.lit("$"))


def parse_ignore_lines(lines: DataFrame) -> DataFrame:
    """(dir, rank, line) of ignore files as a relation of rules."""
    text = F.regexp_replace("line", r"(?<!\\)\s+$", "")
    kept = lines.withColumn("line", text).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return kept.select(
        "dir", F.col("rank").cast("bigint").alias("rank"), ignore_regex(F.col("line")).alias("regex"),
        F.col("line").startswith("!").alias("negated"), F.col("line").endswith("/").alias("dir_only"))


def _entries(paths: DataFrame) -> DataFrame:
    """(path, entry, is_dir): every directory above a path, and the path."""
    above = F.filter(ancestors(parent_dir(F.col("path"))), lambda d: d != "")
    pairs = F.transform(above, lambda d: F.struct(d.alias("entry"), F.lit(True).alias("is_dir")))
    own = F.array(F.struct(F.col("path").alias("entry"), F.lit(False).alias("is_dir")))
    return paths.select("path", F.inline(F.concat(pairs, own)))


def filter_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that are neither hidden nor ignored.

    For one entry the last rule of the deepest directory wins; an ignored
    directory hides everything below it, whatever later rules say.
    """
    visible = files.where(~hidden(F.col("path")))
    entries = _entries(visible.select("path"))
    distinct = entries.groupBy("entry").agg(F.max("is_dir").alias("is_dir"))
    candidates = distinct.select("entry", "is_dir", F.explode(ancestors(parent_dir(F.col("entry")))).alias("dir"))
    relative = F.when(F.col("dir") == "", F.col("entry")).otherwise(
        F.substring("entry", F.length("dir") + 2, F.length("entry")))
    hits = candidates.join(bounded_broadcast(rules), "dir").where(
        F.rlike(relative, F.col("regex")) & (F.col("is_dir") | ~F.col("dir_only")))
    ignored = (hits.groupBy("entry")
               .agg(F.max_by("negated", F.struct(depth(F.col("dir")), F.col("rank"))).alias("kept"))
               .where(~F.col("kept")).select("entry"))
    dropped = entries.join(ignored, "entry", "left_semi").select("path").distinct()
    return visible.join(dropped, "path", "left_anti")


def root_markers(paths: DataFrame, marker: str = ".git") -> DataFrame:
    """(dir): directories that hold ``marker``, a file or a directory, as far as listed paths show it."""
    inside = F.regexp_extract("path", rf"^(?:(.*)/)?\Q{marker}\E(?:/.*)?$", 1)
    held = F.rlike(F.col("path"), F.lit(rf"(^|/)\Q{marker}\E(/|$)"))
    return paths.where(held).select(inside.alias("dir")).distinct()


def project_root(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, root): the nearest directory with a marker, else the start.

    ``paths`` has ``path`` and may have ``is_dir``; a file starts at its
    parent. ``markers`` lists the marked directories as ``dir``. Each distinct
    start is resolved once, however many files share it.
    """
    start = parent_dir(F.col("path"))
    if "is_dir" in paths.columns:
        start = F.when(F.col("is_dir"), F.col("path")).otherwise(start)
    based = paths.select("path", start.alias("base"))
    above = based.select("base").distinct().select("base", F.explode(ancestors(F.col("base"))).alias("dir"))
    nearest = (above.join(bounded_broadcast(markers.select("dir").distinct()), "dir")
               .groupBy("base").agg(F.max_by("dir", depth(F.col("dir"))).alias("found")))
    return based.join(nearest, "base", "left").select("path", F.coalesce("found", "base").alias("root"))


def with_prefix(df: DataFrame, prefix: str, column: str = "path") -> DataFrame:
    return df.where(path_prefix(F.col(column), prefix))


def in_scope(df: DataFrame, scope: str | None, lang: str | None = None, column: str = "path") -> DataFrame:
    """Rows under a path, and in a language when one is given by any of its names; an unknown name restricts nothing."""
    if scope is not None:
        df = df.where(path_scope(F.col(column), scope))
    known = lang and find_lang(lang)
    return df.where(F.col("lang") == known) if known else df
