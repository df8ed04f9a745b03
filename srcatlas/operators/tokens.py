"""Source files as a relation of tokens.

The text of a file is cut by a JVM regular expression and exploded; lines and
bracket depths are running sums over the file. The only exchange moves the
*content*, hashed by path, before it is exploded: tokens are never shuffled,
and every later window over a file reuses that partitioning. A table that is
already clustered by path skips even this exchange (``clustered=True``).

Expressions are SQL text where they are long: one parse on the driver instead
of hundreds of calls that build a column tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from srcatlas.functions.lexers import TOKEN_CLASS, cut, steps
from srcatlas.functions.paths import decode_capture, source_text

# Paths of a corpus begin alike, so sorts by path compare whole texts. A hash of the path
# ahead of it decides almost every comparison; the path itself keeps files apart.
FILE = "fid, file"
BY_FILE = f"(PARTITION BY {FILE} ORDER BY pos)"
RUNNING = f"(PARTITION BY {FILE} ORDER BY pos ROWS UNBOUNDED PRECEDING)"


def partition_count(spark: SparkSession) -> int:
    """Number of partitions for exploding content.

    Stated explicitly, because adaptive execution would merge partitions by the
    size of the content, while the work is done on tokens, ten times as large.
    At scale ``srcatlas.configure(spark, source_bytes)`` sets the number that
    is read here.
    """
    default = spark.conf.get("spark.sql.shuffle.partitions")
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", default) or default)


def _newlines(col: str) -> str:
    return rf"(octet_length({col}) - octet_length(replace({col}, '\n', '')))"


# Brackets that nest. Bash uses single ")" in case patterns, so only braces do.
# The text of a string behind code in it starts with the bracket that closes the code.
OPENS = "(text = '{' OR (text IN ('(', '[') AND lang <> 'bash'))"
CLOSES = "(startswith(text, '}') OR ((startswith(text, ')') OR text = ']') AND lang <> 'bash'))"


def _depth(opens: str, closes: str) -> str:
    """Depth outside a bracket, or around any other token."""
    return f"(sum({_step(opens, closes)}) OVER {RUNNING} - CASE WHEN {opens} THEN 1 ELSE 0 END)"


def _step(opens: str, closes: str) -> str:
    return f"CASE WHEN {opens} THEN 1 WHEN {closes} THEN -1 ELSE 0 END"


DEPTHS = {
    "paren": ("text IN ('(', '[')", "(startswith(text, ')') OR text = ']')"),
    "brace": ("text = '{'", "startswith(text, '}')"),
    "level": (OPENS, CLOSES),
}
# Files of these languages with arms that replace each other; others need no second look.
_WITH_ARMS = r"lang IN ('c', 'cpp') AND src RLIKE '(?m)^\\s*#\\s*el(se|if)'"
_TURN = r"^\\s*+#\\s*(ifdef|ifndef|if|elif|else|endif)"


def _arms(cut: DataFrame) -> DataFrame:
    """(.., at_pos, part, fix_paren, fix_brace, fix_level): the tokens of a file in parts that start at its conditional
    directives, with what makes the running sums over the file depths that restart in each arm and go on, behind it,
    from its first arm. A file without arms is one part.

    Only one arm is ever compiled, so a bracket that each of them opens is
    opened once. ``arms`` counts the arms around a part that are not the first
    of theirs. Within one value of it, depth is a running sum since such an arm
    began, plus the depths at which the conditionals around began; the latter
    are added where an arm that is not the first begins and taken off at its
    end. Windows are by file and one small number, over one row for each
    directive: tokens are not rows yet.
    """
    by_if = f"(PARTITION BY {FILE}, ifs ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    so_far = f"(PARTITION BY {FILE} ORDER BY seg ROWS UNBOUNDED PRECEDING)"
    # By range: were a file there twice, its tokens would stand behind the directives of both.
    by_arm = f"(PARTITION BY {FILE}, arms ORDER BY seg RANGE UNBOUNDED PRECEDING)"
    ahead = f"(PARTITION BY {FILE}, arms ORDER BY seg RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    earlier = f"(PARTITION BY {FILE} ORDER BY seg RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    fixed = f"(PARTITION BY {FILE} ORDER BY seg RANGE UNBOUNDED PRECEDING)"
    rows = cut.selectExpr("*", f"""CASE WHEN forked THEN concat(array(0),
        filter(transform(raws, (raw, i) -> CASE WHEN raw RLIKE '{_TURN}' THEN i END), i -> i IS NOT NULL)) ELSE array(0) END AS starts""")
    rows = rows.selectExpr("* EXCEPT (raws, starts)", """inline(CASE WHEN forked THEN transform(starts, (i, seg) -> named_struct('seg', seg, 'at_pos', i,
        'part', slice(raws, i + 1, coalesce(get(starts, seg + 1), size(raws)) - i))) ELSE array(named_struct('seg', 0, 'at_pos', 0, 'part', raws)) END)""")
    rows = rows.selectExpr("*", f"CASE WHEN seg > 0 THEN regexp_extract(part[0], '{_TURN}', 1) END AS word", r"""CASE WHEN forked THEN filter(
        transform(part, raw -> trim(LEADING ' \t\n\r\u000b\u000c' FROM raw)), text -> left(text, 1) IN ('(', '[', '{', ')', ']', '}')) END AS brackets""")
    rows = rows.selectExpr("* EXCEPT (word, brackets)", """CASE WHEN word IN ('if', 'ifdef', 'ifndef') THEN 'if' WHEN word IN ('else', 'elif') THEN 'else'
        WHEN word = 'endif' THEN 'endif' END AS turn""", *[
        f"coalesce(aggregate(brackets, 0L, (n, text) -> n + {_step(*pair)}), 0L) AS net_{d}" for d, pair in DEPTHS.items()])
    rows = rows.selectExpr("*", f"""sum(CASE turn WHEN 'if' THEN 1 WHEN 'endif' THEN -1 ELSE 0 END) OVER {so_far}
        + CASE WHEN turn = 'endif' THEN 1 ELSE 0 END AS ifs""")
    rows = rows.selectExpr("*", f"last(turn, true) OVER {by_if} AS before")
    rows = rows.selectExpr("*", f"""sum(CASE WHEN turn = 'else' AND before = 'if' THEN 1 WHEN turn = 'endif' AND before = 'else' THEN -1
        ELSE 0 END) OVER {fixed} AS arms""")
    # Sums are those at the directive, which is no bracket: without the part that it starts.
    rows = rows.selectExpr("*", *[f"coalesce(sum(net_{d}) OVER {ahead}, 0) AS sum_{d}" for d in DEPTHS])
    rows = rows.selectExpr("*", *[f"sum_{d} - coalesce(last(CASE WHEN turn = 'else' THEN sum_{d} END, true) OVER {by_arm}, 0) AS own_{d}" for d in DEPTHS])
    rows = rows.selectExpr("*", *[f"last(CASE WHEN turn = 'if' THEN own_{d} END, true) OVER {by_if} AS base_{d}" for d in DEPTHS])
    return rows.selectExpr(*cut.drop("raws", "forked").columns, "at_pos", "part", *[
        f"""own_{d} - coalesce(sum(net_{d}) OVER {earlier}, 0) + sum(CASE WHEN turn = 'else' AND before = 'if' THEN base_{d}
            WHEN turn = 'endif' AND before = 'else' THEN -base_{d} ELSE 0 END) OVER {fixed} AS fix_{d}""" for d in DEPTHS])


def cut_files(files: DataFrame, langs: list[str] | None = None, clustered: bool = False) -> DataFrame:
    """(file, fid, lang, valid, pos, raw, fix_paren, fix_brace, fix_level): raw tokens, clustered by file, those of a file side by side."""
    content = F.col("src") if "src" in files.columns else source_text(F.col("content"))
    chosen = files.where(F.col("lang").isin(langs) if langs else F.col("lang").isNotNull())
    # The name of the only language is no column, and what other languages need falls away from the plan.
    lang = F.lit(langs[0]).alias("lang") if langs and len(langs) == 1 else F.col("lang")
    chosen = chosen.select(F.col("path").alias("file"), lang, content.alias("src"))
    # Everything about the whole text is computed here, so that the rows of the
    # exploded tokens do not carry it along.
    chosen = chosen.withColumn("valid", F.is_valid_utf8("src"))
    if not clustered:
        chosen = chosen.repartition(partition_count(files.sparkSession), "file")
    chosen = chosen.withColumn("fid", F.xxhash64("file"))
    if langs and not {"c", "cpp"} & set(langs):
        kept = ["file", "fid", "lang", "valid"]
        rows = chosen.select(*kept, steps(F.col("lang"), F.col("src"), langs).alias("texts"))
        rows = rows.select(*kept, (F.size("texts") > 1).alias("long"), F.posexplode("texts").alias("step", "src"))
        # Tokens then come out all but sorted, which their sorts make use of. Behind a window, texts come one by one too:
        # Spark holds all the rows that one row is exploded into, so that two explodes in a row would hold a whole file.
        rows = rows.sortWithinPartitions("fid", "file", "step")
        raws = cut(F.col("lang"), F.col("src"), langs)
        # The last of each array is the empty token at the end of a text, which no step but the last has in the file.
        rows = rows.withColumn("many", F.when(F.col("long"), F.size(raws) - 1).otherwise(0))
        before = Window.partitionBy("fid", "file").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.select(*kept, "long", "src", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("first"))
        rows = rows.select(*kept, "long", "first", raws.alias("raws"))
        raws = F.when(F.col("long"), F.slice("raws", F.lit(1), F.size("raws") - 1)).otherwise(F.col("raws"))
        rows = rows.select(*kept, "first", F.posexplode(raws).alias("nth", "raw"))
        return rows.select(*kept, (F.col("first") + F.col("nth")).alias("pos"), "raw", *[F.lit(0).cast("bigint").alias(f"fix_{d}") for d in DEPTHS])
    chosen = chosen.sortWithinPartitions("fid", "file")
    raws = cut(F.col("lang"), F.col("src"), langs)
    parts = _arms(chosen.select("file", "fid", lang, "valid", raws.alias("raws"), F.expr(_WITH_ARMS).alias("forked")))
    fixes = [f"fix_{d}" for d in DEPTHS]
    tokens = parts.select("file", "fid", lang, "valid", "at_pos", *fixes, F.posexplode("part").alias("nth", "raw"))
    return tokens.select("file", "fid", "lang", "valid", (F.col("at_pos") + F.col("nth")).alias("pos"), "raw", *fixes)


def positioned(files: DataFrame, langs: list[str] | None = None, clustered: bool = False) -> DataFrame:
    """Tokens with lines, offsets and depths, comments included.

    Both ends of a bracket pair have the depth outside it. ``level`` counts
    every kind of bracket that nests; ``at`` and ``until`` are character offsets;
    ``indent`` counts the blanks between the line start and a first token.
    """
    return _positions(cut_files(files, langs, clustered))


def _positions(raw: DataFrame) -> DataFrame:
    raw = raw.selectExpr(
        "file", "fid", "lang", "valid", "CAST(pos AS BIGINT) AS pos", "raw", *[f"fix_{d}" for d in DEPTHS],
        r"trim(LEADING ' \t\n\r\u000b\u000c' FROM raw) AS text")
    line_end = f"(sum({_newlines('raw')}) OVER {RUNNING} + 1)"
    until = f"sum(length(raw)) OVER {RUNNING}"
    return raw.selectExpr(
        "file", "fid", "lang", "valid", "pos", "text", f"{TOKEN_CLASS} AS cls",
        f"{line_end} - {_newlines('text')} AS line", f"{line_end} AS line_end",
        *[f"{_depth(*pair)} + fix_{d} AS {d}" for d, pair in DEPTHS.items()],
        f"{until} - length(text) AS at", f"{until} AS until",
        r"length(substring_index(left(raw, length(raw) - length(text)), '\n', -1)) AS indent",
    ).where("text <> ''")


def captured(text: str = "text") -> Column:
    return decode_capture(F.col(text), F.col("valid"))


def tokenize(files: DataFrame, lang: str | None = None, clustered: bool = False) -> DataFrame:
    """The token relation: file, lang, pos, cls, text, line, paren, brace."""
    out = positioned(files, [lang] if lang else None, clustered)
    return out.select("file", "lang", "pos", "cls", captured().alias("text"), "line", "paren", "brace")


def with_neighbours(tokens: DataFrame, before: int, after: int) -> DataFrame:
    """Adds p1..pN, n1..nN (texts around a token), with class, line and
    position of the nearest ones, and ``starts_line``.

    Comments are dropped first: they never separate two tokens. The window has
    the partitioning and order of the running sums, so nothing is sorted again.
    """
    cols = [f"lag(text, {k}) OVER {BY_FILE} AS p{k}" for k in range(1, before + 1)]
    cols += [f"lead(text, {k}) OVER {BY_FILE} AS n{k}" for k in range(1, after + 1)]
    cols += [f"lag(line_end, {k}) OVER {BY_FILE} AS p{k}_line_end" for k in range(2, before + 1)]
    cols += [f"lag({c}, 1) OVER {BY_FILE} AS p1_{c}" for c in ("cls", "line", "pos", "at")]
    cols += [f"lag(cls, 2) OVER {BY_FILE} AS p2_cls"] if before > 1 else []
    cols += [f"lag(line, 2) OVER {BY_FILE} AS p2_line"] if before > 1 else []
    cols += [f"lead({c}, 1) OVER {BY_FILE} AS n1_{c}" for c in ("cls", "line", "pos")]
    starts = f"coalesce(line > lag(line_end, 1) OVER {BY_FILE}, true) AS starts_line"
    return tokens.where("cls <> 'comment'").selectExpr("*", *cols, starts)
