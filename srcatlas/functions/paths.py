"""Path predicates and text decoding as column functions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, functions as F

_NO_ESCAPE = "\u0001"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def path_prefix(path: Column, prefix: Column | str) -> Column:
    """``path LIKE prefix || '%'`` with the wildcards of ``prefix`` left active.

    Letters compare without case, but only ASCII letters, so neither ILIKE nor
    ``lower`` may be used. The result is not pushed to the scan; use
    ``path_scope`` when the prefix is a plain path.
    """
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    pattern = F.concat(ascii_lower(prefix), F.lit("%"))
    return F.like(ascii_lower(path), pattern, F.lit(_NO_ESCAPE))


def folded_prefix(folded: Column, prefix: str) -> Column:
    """``path_prefix`` over a path that is already in ASCII lower case.

    What stands ahead of the first wildcard is a plain prefix, which the scan of
    a Parquet file is given to skip by; the rest is a filter on what it returns.
    """
    prefix = prefix.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    head = re.split("[%_]", prefix, maxsplit=1)[0]
    matches = F.like(folded, F.lit(prefix + "%"), F.lit(_NO_ESCAPE))
    if head == prefix:
        return folded.startswith(head)
    return folded.startswith(head) & matches if head else matches


def path_scope(path: Column, scope: str) -> Column:
    """True for ``scope`` itself and for everything below it (pushed down)."""
    scope = scope.rstrip("/")
    if scope in ("", "."):
        return F.lit(True)
    return (path == scope) | path.startswith(scope + "/")


def parent_dir(path: Column) -> Column:
    """Directory part of a path; '' for a top-level name."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """All ancestors of a directory, itself included, the root '' first."""
    parts = F.split(directory, "/")
    deep = F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(
        F.array_distinct(F.concat(F.array(F.lit("")), deep)))


def depth(directory: Column) -> Column:
    return F.when(directory == "", F.lit(0)).otherwise(F.size(F.split(directory, "/")))


def source_text(content: Column) -> Column:
    """Bytes as text. Bad bytes never raise; the lexers see U+FFFD for them."""
    return content.cast("string")


def decode_capture(text: Column, content_is_valid: Column) -> Column:
    """Captured text, or '' when it covers bytes that are not valid UTF-8."""
    broken = ~content_is_valid & F.contains(text, F.lit("�"))
    return F.when(broken, F.lit("")).otherwise(text)


def decode_text(content: Column) -> Column:
    """Whole content as text, or '' when it is not valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")),
                  content.cast("string")).otherwise(F.lit(""))


def clamp_mtime(secs: Column, nanos: Column) -> tuple[Column, Column]:
    """(0, 0) for missing times and for times before the epoch."""
    bad = secs.isNull() | nanos.isNull() | (secs < 0)
    zero = F.lit(0).cast("bigint")
    return F.when(bad, zero).otherwise(secs), F.when(bad, zero).otherwise(nanos)
