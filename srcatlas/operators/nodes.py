"""Syntax nodes from tokens, for languages whose blocks are brackets.

The nodes of a file are its tokens, its bracket pairs, its declarations and its
calls, below one root. What a token lies in is read off the level windows that
find declarations: the bracket around it is the last one opened a level up, and
the declaration around it the next one to end at its own level, if that started
at or before it. So a parent is a running value as well; nothing is joined, and
tokens stay where their file is. Ids are positions: (pos + 1) * 4, one more for
the call of a name, two more for the declaration of a name; the root is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from srcatlas.functions.langs import resolve_lang
from srcatlas.functions.paths import decode_capture, source_text
from srcatlas.operators.declarations import following, resolve, with_ends, words_in
from srcatlas.operators.tokens import CLOSES, OPENS, RUNNING, partition_count, positioned

WITHOUT_BLOCKS = ("python", "bash")
# Words before a parenthesis that call nothing, and words before a name that is declared, not called.
NOT_CALLED = ("if for while switch catch match return func function fn else sizeof in typeof await case guard with"
              " super import where let move as pub new throw delete void yield do")
GO_GROUPS = "type var const import"
DECLARED_AFTER = "fn def func function class new struct enum protocol macro_rules interface trait impl"


def _node(node_id: str, parent: str, field: str, kind: str, text: str, start_line: str, end_line: str, at: str, until: str) -> str:
    return (f"named_struct('node_id', {node_id}, 'parent_id', {parent}, 'field', CAST({field} AS STRING), 'type', {kind}, 'text', CAST({text} AS STRING),"
            f" 'start_line', {start_line}, 'end_line', {end_line}, 'pos', {at}, 'until', {until})")


def nodes_from_source(files: DataFrame, lang: str, texts: bool = True, clustered: bool = False) -> DataFrame:
    """A node table for ``match_nodes``: file, node_id, parent_id, field, type, text, start_line, end_line, pos, until.

    Types are the classes of tokens (``ident``, ``string``, ``punct``, ...), ``parens``,
    ``square`` and ``braces`` for bracket pairs, the kinds of declarations, ``call``,
    and ``file`` for the root, whose text is null. Fields: ``name``, ``parameters``,
    ``receiver`` and ``body`` of a declaration, ``function`` and ``arguments`` of a
    call. ``pos`` and ``until`` are character offsets. Comments are no nodes; what a
    macro declares is not a declaration here.

    ``texts`` adds the source text of pairs, declarations and calls, which meets
    the nodes by file; without it theirs is null.
    """
    lang = resolve_lang(lang)
    if lang in WITHOUT_BLOCKS:
        raise ValueError(f"the blocks of {lang!r} are not brackets")
    chosen = files.where(F.col("lang") == lang)
    after_name = f"text = '(' AND p1_cls IN ('ident', 'qualified') AND NOT {words_in('p1', NOT_CALLED)} AND NOT {words_in('p2', DECLARED_AFTER)}"
    before_call = f"cls IN ('ident', 'qualified') AND n1 = '(' AND NOT {words_in('text', NOT_CALLED)} AND NOT {words_in('p1', DECLARED_AFTER)}"
    if lang == "go":
        after_name, before_call = f"{after_name} AND NOT {words_in('p1', GO_GROUPS)}", f"{before_call} AND NOT {words_in('text', GO_GROUPS)}"
    # What only the nodes at the end are made of goes through all windows as one value.
    carry = [f"struct(cls, line_end, at, {before_call} AS before_call, CASE WHEN text = '(' THEN struct(p1, p1_pos, p1_line, p1_at, {after_name} AS after_name) END AS before) AS token",
             f"CASE WHEN {CLOSES} THEN struct(line, at + 1 AS until) END AS closing"]
    rows = with_ends(resolve(positioned(chosen, [lang], clustered), [lang], heads=True, keep="true", carry=carry).selectExpr(
        "* EXCEPT (encl)", "encl.pos AS encl_pos", "encl.until AS encl_until"))
    if lang == "rust":
        rows = rows.selectExpr("*", f"sum(macro) OVER {RUNNING} AS inside").selectExpr(
            "* EXCEPT (sym, ended)", "CASE WHEN inside = 0 THEN sym END AS sym", "CASE WHEN inside = 0 THEN ended END AS ended")
    rows = rows.selectExpr("*", "CASE WHEN NOT edge AND sym IS NOT NULL THEN struct(sym.pos, sym.head.at) END AS starting",
                           "CASE WHEN NOT edge AND ended IS NOT NULL THEN struct(ended.pos, ended.kind, ended.head.at, line, until) END AS ending")
    rows = rows.selectExpr("*", f"{following('ending')} AS ends", f"{following('starting')} AS starts", f"{following('closing')} AS closed")
    rows = rows.where(f"NOT edge AND (sym IS NOT NULL OR NOT {CLOSES})").selectExpr("* EXCEPT (token)", "token.*").selectExpr(
        "* EXCEPT (before)", "before.*", "CASE WHEN ends.at <= at THEN ends.pos WHEN starts.at <= at THEN starts.pos END AS item",
        "coalesce((encl_pos + 1) * 4, 0) AS up")
    rows = rows.selectExpr("*", "coalesce((item + 1) * 4 + 2, up) AS around", "coalesce(after_name AND p1_pos <> coalesce(item, -1), false) AS arguments",
                           "coalesce(before_call AND pos <> coalesce(item, -1), false) AS called")
    text = decode_capture(F.col("text"), F.col("valid"))
    rows = rows.withColumn("token", text)
    own = _node(
        "(pos + 1) * 4", "CASE WHEN called THEN (pos + 1) * 4 + 1 WHEN arguments THEN (p1_pos + 1) * 4 + 1 ELSE around END",
        """CASE WHEN called THEN 'function' WHEN arguments THEN 'arguments' WHEN pos = item THEN 'name'
            WHEN text = '(' AND p1_pos = item THEN 'parameters' WHEN text = '(' AND lang = 'go' AND item IS NOT NULL AND p1 = 'func' THEN 'receiver'
            WHEN text = '(' AND item IS NOT NULL AND p1 = '>' AND ends.kind IN ('fn', 'method') THEN 'parameters'
            WHEN text = '{' AND ends.pos = item AND closed.until = ends.until THEN 'body' END""",
        f"CASE WHEN NOT {OPENS} THEN cls WHEN text = '(' THEN 'parens' WHEN text = '[' THEN 'square' ELSE 'braces' END",
        f"CASE WHEN NOT {OPENS} THEN token END", "line", f"CASE WHEN {OPENS} THEN coalesce(closed.line, line) ELSE line_end END",
        "at", f"CASE WHEN {OPENS} THEN coalesce(closed.until, until) ELSE until END")
    call = _node("(p1_pos + 1) * 4 + 1", "around", "null", "'call'", "null", "p1_line", "coalesce(closed.line, line)", "p1_at", "coalesce(closed.until, until)")
    inside_only = "coalesce(sym.head.at >= coalesce(encl_until, 0), false)"
    declared = _node(
        "(sym.pos + 1) * 4 + 2", "up", "null", "sym.kind", "null", f"CASE WHEN {inside_only} THEN sym.head.line ELSE sym.line END",
        "CASE WHEN ends.pos = sym.pos THEN ends.line ELSE sym.line END", f"CASE WHEN {inside_only} THEN sym.head.at ELSE encl_until END",
        "CASE WHEN ends.pos = sym.pos THEN ends.until ELSE until END")
    nodes = rows.selectExpr("file", "valid", f"inline(array(CASE WHEN NOT {CLOSES} THEN {own} END, CASE WHEN arguments THEN {call} END, CASE WHEN sym IS NOT NULL THEN {declared} END))")
    nodes = nodes.where("node_id IS NOT NULL")
    columns = ["file", "node_id", "parent_id", "field", "type", "text", "start_line", "end_line", "pos", "until"]
    if texts:
        content = F.col("src") if "src" in chosen.columns else source_text(F.col("content"))
        sources = chosen.select(F.col("path").alias("file"), content.alias("src"))
        if not clustered:
            sources = sources.repartition(partition_count(files.sparkSession), "file")
        cut = F.substring("src", (F.col("pos") + 1).cast("int"), (F.col("until") - F.col("pos")).cast("int"))
        # All nodes meet their file, also those whose text is there: two branches would each cut the files and run all windows.
        # Were a file there twice, those would meet the first alone.
        sources = sources.withColumn("copy", F.row_number().over(Window.partitionBy("file").orderBy("file")))
        nodes = nodes.join(sources.hint("merge"), "file", "left").where("CASE WHEN text IS NULL THEN src IS NOT NULL ELSE coalesce(copy, 1) = 1 END")
        nodes = nodes.withColumn("text", F.coalesce("text", decode_capture(cut, F.col("valid"))))
    root = chosen.selectExpr("path AS file", "0L AS node_id", "CAST(null AS BIGINT) AS parent_id", "CAST(null AS STRING) AS field", "'file' AS type",
                             "CAST(null AS STRING) AS text", "1L AS start_line", "CAST(null AS BIGINT) AS end_line", "-1L AS pos", "CAST(null AS BIGINT) AS until")
    return nodes.select(*columns).unionByName(root)
