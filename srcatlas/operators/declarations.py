"""Declarations (symbols) found in the token relation.

Most declarations are visible in a few neighbouring tokens. The rest needs the
brackets around it: is there a body, what stands before the matching
parenthesis, which block encloses the name. For those the tokens that matter
(brackets, terminators, candidate names) are regrouped by nesting level. Within
one level a pair of brackets is adjacent but for the tokens between them, so
"my opening bracket", "the block I am in" and "the declaration still waiting
for its body" are all running ``last`` values: linear windows, no frame that
looks ahead, no self-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from srcatlas.functions.langs import resolve_lang
from srcatlas.operators.tokens import BY_FILE, CLOSES, FILE, OPENS, RUNNING, captured, partition_count, positioned, with_neighbours

CAP_PER_FILE = 500

LEVEL = f"PARTITION BY {FILE}, lv ORDER BY pos"
SO_FAR = f"({LEVEL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE_IT = f"(PARTITION BY {FILE} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
BEFORE = f"({LEVEL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def following(column: str) -> str:
    """The value of a column here or, where it is null, in the next row of the level that has one. Rows stay in the order that ``SO_FAR`` asks for."""
    return f"coalesce({column}, lead({column}, 1) IGNORE NULLS OVER ({LEVEL}))"


def words_in(column: str, words: str) -> str:
    """``column IN (...)`` for a blank-separated word list; null counts as ''."""
    return f"coalesce({column}, '') IN ({', '.join(repr(w) for w in words.split())})"


NESTED_LANGS = "rust javascript typescript c cpp go swift bash"
JS_CONTROL = "if for while switch catch with function new await return typeof"
JS_STATEMENT_STARTS = "; { } ) export default else do declare"
JS_CONTINUES = (
    "= ( , ? : && || ?? ! + - * / % | & ^ ~ < > == === != !== <= >= => [ . ?. ... return new typeof extends "
    "in of instanceof yield await case void delete abstract async")
TS_MEMBER_STARTS = "; { } * public private protected static async get set readonly override"
SWIFT_MEMBERS = "func var let subscript init override final static"
BASH_COMMAND_STARTS = "; { } ( ) then do else && || ;;"
C_NOT_BEFORE_NAME = "; { } * & && , = ( . -> : :: return else new"
CPP_AFTER_PARAMETERS = "{ const volatile noexcept override final throw try requires -> : & && __attribute__"


@dataclass(frozen=True)
class Rule:
    """``kind`` for a name token where ``when`` holds.

    With ``need``, the declaration counts only if that token comes next at the
    same nesting level, before ``;`` or a brace.
    """

    kind: str
    when: str
    need: str | None = None


def _starts_statement(k: int) -> str:
    """Does the k-th token before the name start a JavaScript statement?"""
    q = f"p{k + 1}"
    return (f"({q} IS NULL OR {words_in(q, JS_STATEMENT_STARTS)}"
            f" OR (p{k}_line > {q}_line_end AND NOT {words_in(q, JS_CONTINUES)}))")


_JS_FUNCTION = f"p1 = 'function' AND ({_starts_statement(1)} OR (p2 = 'async' AND {_starts_statement(2)}))"
_JS_CLASS = f"p1 = 'class' AND {_starts_statement(1)} AND text NOT IN ('extends', 'implements')"
_CPP_PLAIN = "coalesce(p2, '') NOT IN ('enum', 'friend', '<', ',') AND coalesce(n1, '') <> '<'"

# Declarations anchored at their name, per language.
NAME_RULES = {
    "rust": [
        Rule("fn", "p1 = 'fn'", need="{"),
        Rule("struct", "p1 = 'struct'"),
        Rule("enum", "p1 = 'enum'"),
        Rule("trait", "p1 = 'trait'"),
        Rule("mod", "p1 = 'mod'"),
        Rule("type", "p1 = 'type'", need="="),
        Rule("const", "p1 = 'const' AND n1 = ':' AND coalesce(p2, '') NOT IN ('<', ',', '*')"),
        Rule("static", "n1 = ':' AND (p1 = 'static' OR (p1 = 'mut' AND p2 = 'static'))"),
        Rule("macro", "p1 = '!' AND p2 = 'macro_rules'"),
    ],
    "python": [
        Rule("fn", "p1 = 'def'"),
        Rule("class", "p1 = 'class'"),
    ],
    "javascript": [
        Rule("fn", _JS_FUNCTION),
        Rule("class", _JS_CLASS),
    ],
    "typescript": [
        Rule("fn", _JS_FUNCTION, need="{"),
        Rule("class", _JS_CLASS),
        Rule("interface", "p1 = 'interface' AND n1 IN ('{', 'extends', '<')"),
        Rule("type", "p1 = 'type' AND n1 IN ('=', '<') AND coalesce(p2, '') <> 'import'"),
        Rule("enum", "p1 = 'enum' AND n1 = '{'"),
    ],
    "go": [
        Rule("fn", "p1 = 'func' AND n1 IN ('(', '[')"),
        Rule("type", "p1 = 'type' AND coalesce(n1, '') <> '='"),
    ],
    "c": [
        Rule("struct", "p1 = 'struct'"),
        Rule("enum", "p1 = 'enum'"),
    ],
    "cpp": [
        Rule("class", f"p1 = 'class' AND {_CPP_PLAIN}"),
        Rule("struct", f"p1 = 'struct' AND {_CPP_PLAIN}"),
        Rule("enum", "(p1 = 'enum' AND text NOT IN ('class', 'struct')) OR (p1 IN ('class', 'struct') AND p2 = 'enum')"),
        Rule("namespace", "p1 = 'namespace' AND n1 = '{'"),
    ],
    "swift": [
        Rule("struct", "p1 = 'struct'"),
        Rule("class", f"p1 = 'class' AND NOT {words_in('text', SWIFT_MEMBERS)}"),
        Rule("class", "p1 = 'actor' AND n1 IN ('{', ':', '<')"),
        Rule("enum", "p1 = 'enum'"),
        Rule("type", "p1 = 'extension'"),
        Rule("fn", "p1 = 'func'", need="{"),
        Rule("interface", "p1 = 'protocol' AND n1 IN ('{', ':', '<')"),
        Rule("type", "p1 = 'typealias'"),
    ],
    "bash": [
        Rule("fn", "n1 = '(' AND n2 = ')' AND coalesce(p1, '') <> 'function'"),
        Rule("fn", f"p1 = 'function' AND (p2 IS NULL OR {words_in('p2', BASH_COMMAND_STARTS)} OR p1_line > p2_line_end)"),
    ],
}


def _name_rule(langs: list[str] | None, extra: dict[str, list[Rule]]) -> str:
    """struct(kind, need) of the first rule that holds for a name token."""
    whens = []
    for lang in langs or NAME_RULES:
        for r in extra.get(lang, []) + NAME_RULES[lang]:
            need = f"'{r.need}'" if r.need else "CAST(null AS STRING)"
            whens.append(f"WHEN lang = '{lang}' AND ({r.when}) THEN named_struct('kind', '{r.kind}', 'need', {need})")
    return f"CASE WHEN cls = 'ident' THEN CASE {' '.join(whens)} END END"


# Entries of a Go ``type ( ... )`` group, still to be checked for the group.
_IN_GROUP = ("(lang = 'go' AND cls = 'ident' AND paren > 0 AND coalesce(n1, '') <> '='"
             " AND (starts_line OR p1 IN ('(', ';')))")
# A TypeScript member whose type parameters come before its parameter list.
_GENERIC = ("(lang = 'typescript' AND cls = 'ident' AND n1 = '<'"
            f" AND (starts_line OR {words_in('p1', TS_MEMBER_STARTS)}))")
_STRUCTURAL = (f"({words_in('lang', NESTED_LANGS)} AND ({OPENS} OR {CLOSES} OR text = ';'"
               f" OR (lang = 'rust' AND text = '=') OR (lang = 'swift' AND {words_in('text', SWIFT_MEMBERS)})))")


# A Rust item starts at its first modifier, on whatever line its keyword is; attributes are no part of it.
_RUST_ITEM = "pub fn struct enum trait mod type const static unsafe async extern macro_rules impl union"
_RUST_MID_ITEM = (f"(lang = 'rust' AND (({words_in('p1', 'pub unsafe async const extern')} AND {words_in('text', _RUST_ITEM)})"
                  " OR coalesce(p1, '') IN ('fn', 'struct', 'enum', 'trait', 'mod', 'static')"
                  f" OR (p1 = ')' AND {words_in('p2', 'crate super self')} AND p3 = '(' AND {words_in('text', _RUST_ITEM)})))")
# Where an item starts: at its line, in C and C++ after the previous statement.
_ITEM_START = f"""CASE
    WHEN lang IN ('c', 'cpp') AND (p1 IS NULL OR p1 IN (';', '{{', '}}') OR p1_cls = 'directive'
         OR (starts_line AND p1 IN (':', '>'))) THEN named_struct('line', line, 'at', at)
    WHEN lang NOT IN ('c', 'cpp') AND ((starts_line AND NOT coalesce({_RUST_MID_ITEM}, false)) OR p1 IN (';', '{{', '}}', 'export', 'default')
         OR (lang = 'rust' AND p1 = ']' AND {words_in('text', _RUST_ITEM)}))
      THEN named_struct('line', line, 'at', at)
    END"""


def _owner(cls: str, name: str, line: str, pos: str, head: str, p1: str, p2: str, starts: str) -> str:
    return (f"named_struct('cls', {cls}, 'name', {name}, 'line', {line}, 'pos', {pos}, 'head', {head},"
            f" 'p1', {p1}, 'p2', {p2}, 'starts', {starts})")


def _waiting(kind: str, need: str, name: str, line: str, pos: str, head: str) -> str:
    return (f"named_struct('kind', {kind}, 'need', {need}, 'name', {name}, 'line', {line}, 'pos', {pos},"
            f" 'head', {head})")


# The bracket that opens the body of a Rust macro call or definition.
MACRO_OPENS = ("(lang = 'rust' AND ((coalesce(p1, '') = '!' AND coalesce(p2_cls, '') IN ('ident', 'qualified')"
                f" AND NOT {words_in('p2', 'return if while match in else break')})"
                " OR (coalesce(p2, '') = '!' AND coalesce(p3, '') = 'macro_rules')))")
_STOPS = "(edge OR text IN (';', '{', '}'))"
_NO_HEAD = "CAST(null AS STRUCT<line: BIGINT, at: BIGINT>)"
_NO_OWNER = _owner(*["CAST(null AS STRING)"] * 2, *["CAST(null AS BIGINT)"] * 2, _NO_HEAD,
                   *["CAST(null AS STRING)"] * 2, "CAST(null AS BOOLEAN)")
_NOTHING_WAITS = _waiting(*["CAST(null AS STRING)"] * 3, *["CAST(null AS BIGINT)"] * 2, _NO_HEAD)

# The name before my pair of parentheses, as ``own``.
_JS_METHOD = (
    "(NOT edge AND text = ')' AND lang IN ('javascript', 'typescript') AND own.cls = 'ident'"
    f" AND NOT {words_in('own.name', JS_CONTROL)} AND NOT {words_in('own.p1', 'function new . ?.')}"
    " AND NOT (coalesce(own.p1, '') = '*' AND coalesce(own.p2, '') = 'function')"
    f" AND (n1 = '{{' OR (lang = 'typescript' AND n1 = ':' AND (own.starts OR {words_in('own.p1', TS_MEMBER_STARTS)}))))")
_AT_FILE_LEVEL = ("(encl IS NULL OR (encl.text = '{' AND (encl.p1 = 'namespace'"
                  " OR coalesce(encl.p2, '') IN ('namespace', 'extern'))))")
_TYPED_NAME = f"(own.cls = 'ident' AND own.p1 IS NOT NULL AND NOT {words_in('own.p1', C_NOT_BEFORE_NAME)})"
_C_FUNCTION = (
    f"(NOT edge AND text = ')' AND {_AT_FILE_LEVEL} AND ("
    f"(lang = 'c' AND {_TYPED_NAME} AND n1 IN ('{{', '__attribute__')) OR "
    f"(lang = 'cpp' AND {words_in('n1', CPP_AFTER_PARAMETERS)} AND ({_TYPED_NAME}"
    f" OR (own.cls = 'qualified' AND NOT {words_in('own.p1', ': , * & && = . ->')})))))")

_WAITS = f"""CASE
    WHEN NOT edge AND rule.need IS NOT NULL THEN {_waiting('rule.kind', 'rule.need', 'text', 'line', 'pos', 'head')}
    WHEN {_JS_METHOD} THEN {_waiting("'method'", "'{'", 'own.name', 'own.line', 'own.pos', 'own.head')}
    WHEN {_C_FUNCTION} THEN {_waiting("'fn'", "'{'", 'own.name', 'own.line', 'own.pos', 'own.head')}
    WHEN {_STOPS} OR rule IS NOT NULL OR (lang = 'swift' AND {words_in('text', SWIFT_MEMBERS)}) THEN {_NOTHING_WAITS}
    END"""


def _found(name: str, kind: str, line: str, pos: str, head: str) -> str:
    return f"named_struct('name', {name}, 'kind', {kind}, 'line', {line}, 'pos', {pos}, 'head', {head})"


_SYMBOL = f"""CASE
    WHEN edge THEN null
    WHEN rule IS NOT NULL AND rule.need IS NULL THEN {_found('text', 'rule.kind', 'line', 'pos', 'head')}
    WHEN in_group AND encl.text = '(' AND encl.p1 = 'type' THEN {_found('text', "'type'", 'line', 'pos', 'head')}
    WHEN lang = 'go' AND text = ')' AND own.name = 'func' AND n1_cls = 'ident' AND n2 IN ('(', '[')
      THEN {_found('n1', "'method'", 'n1_line', 'n1_pos', 'own.head')}
    WHEN text = pend.need AND NOT (text = '=' AND coalesce(equals_before, -1) > pend.pos)
      THEN {_found('pend.name', 'pend.kind', 'pend.line', 'pend.pos', 'pend.head')}
    END"""


def _leveled(tokens: DataFrame, langs: list[str] | None, extra: dict[str, list[Rule]], heads: bool, keep: str | None, carry: list[str]) -> DataFrame:
    """Tokens a declaration can use (and those that ``keep`` asks for), one row per token and
    level: an opening bracket also starts the level inside it (``edge``).

    The windows by level pass on every column of a row, so what they need of its neighbours is
    put into values here that only brackets and names have; ``carry`` are further columns.
    """
    opened = _owner("p1_cls", "p1", "p1_line", "p1_pos", "head", "p2", "p3", "coalesce(p1_line > p2_line_end, true)")
    named = _owner("cls", "text", "line", "pos", "head", "p1", "p2", "starts_line")
    marked = with_neighbours(tokens, before=3, after=2).selectExpr(
        "*", f"{_name_rule(langs, extra)} AS rule", f"{_IN_GROUP} AS in_group", f"{_GENERIC} AS generic", f"{_STRUCTURAL} AS structural",
        f"coalesce({keep or 'false'}, false) AS kept", f"CASE WHEN {OPENS} THEN {MACRO_OPENS} END AS macro_open",
        f"{_ITEM_START if heads else _NO_HEAD} AS item_start", *carry)
    marked = marked.selectExpr(
        "*", f"last(item_start, true) OVER {RUNNING} AS head" if heads else f"{_NO_HEAD} AS head",
        f"coalesce(last(CASE WHEN text = 'enum' THEN true WHEN text IN (';', '{{', '}}') THEN false END, true) OVER {BEFORE_IT}, false) AS of_enum"
        if keep else "false AS of_enum")
    own = [column.rsplit(" AS ", 1)[-1] for column in carry]
    marked = marked.where("kept OR structural OR rule IS NOT NULL OR in_group OR generic").selectExpr(
        "file", "fid", "lang", "valid", "pos", "text", "line", "until", "n1", "n1_cls", "n1_line", "n1_pos", "n2", "level", "rule", "in_group", "macro_open", *own,
        "CASE WHEN rule IS NOT NULL OR in_group THEN head END AS head",
        f"CASE WHEN text = '(' THEN {opened} END AS opened", f"CASE WHEN generic THEN {named} END AS generic",
        f"CASE WHEN {OPENS} THEN struct(text, p1, p2, pos, until, of_enum) END AS around")
    return marked.selectExpr("* EXCEPT (level)", f"""inline(CASE
        WHEN {OPENS} THEN array(struct(level AS lv, false AS edge), struct(level + 1 AS lv, true AS edge))
        ELSE array(struct(level AS lv, false AS edge)) END)""")


def resolve(tokens: DataFrame, langs: list[str] | None = None, extra: dict[str, list[Rule]] | None = None, heads: bool = False,
            keep: str | None = None, carry: list[str] = (), levels: list[str] = ()) -> DataFrame:
    """Per token and level: ``own`` (the name before my bracket pair), ``encl``
    (the bracket around me), ``pend`` (the declaration waiting for its body)
    and ``sym`` where a declaration is complete. ``heads`` also finds where the
    whole item starts.

    ``keep`` is a condition for further tokens that are wanted, true for all but
    comments; ``carry`` are columns that go along, from a token and its neighbours;
    ``levels`` are windows over a level of what is carried."""
    around = _leveled(tokens, langs, extra or {}, heads, keep, list(carry)).selectExpr(
        "*", f"last(CASE WHEN NOT edge THEN macro_open END, true) OVER {SO_FAR} AS macro_pair",
        f"last(CASE WHEN NOT edge THEN opened END, true) OVER {SO_FAR} AS direct",
        f"last(CASE WHEN generic IS NOT NULL THEN generic WHEN {_STOPS} THEN {_NO_OWNER} END, true) OVER {SO_FAR} AS typed",
        f"last(CASE WHEN edge THEN around END, true) OVER {SO_FAR} AS encl", *levels)
    owned = around.selectExpr("*", "CASE WHEN direct.name = '>' THEN typed ELSE direct END AS own")
    return owned.selectExpr("*", f"{_WAITS} AS waits").selectExpr(
        "*", f"last(waits, true) OVER {BEFORE} AS pend",
        f"last(CASE WHEN NOT edge AND text = '=' THEN pos END, true) OVER {BEFORE} AS equals_before",
    ).selectExpr("* EXCEPT (opened, generic, around, waits, direct, typed)", f"{_SYMBOL} AS sym", f"""CASE WHEN edge OR NOT coalesce(macro_pair, false) THEN 0
        WHEN {OPENS} THEN 1 WHEN {CLOSES} THEN -1 ELSE 0 END AS macro""")


def _outside_macros(rows: DataFrame) -> DataFrame:
    """Rows that lie in no macro body: what is written there is tokens, not items."""
    return rows.selectExpr("*", f"sum(macro) OVER {RUNNING} AS inside").where("inside = 0")


def declarations(tokens: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """All declarations in a relation made by ``positioned``."""
    found = resolve(tokens, langs)
    if langs is None or "rust" in langs:
        found = _outside_macros(found.select("file", "fid", "lang", "valid", "pos", "sym", "macro").where("sym IS NOT NULL OR macro <> 0"))
    found = found.where("sym IS NOT NULL")
    return found.select(captured("sym.name").alias("name"), "sym.kind", "file", "lang", "sym.line", "sym.pos")


def cap_per_file(symbols: DataFrame, cap: int | None = None) -> DataFrame:
    """The first ``cap`` declarations of each file, in source order.

    Kept apart from the other windows so that Spark can limit each group while
    it ranks. No exchange: the rows are still clustered by file.
    """
    if cap is None:
        return symbols
    rank = F.row_number().over(Window.partitionBy("file").orderBy("pos"))
    return symbols.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")


def extract_symbols(files: DataFrame, lang: str | None = None, cap: int | None = None,
                    ordered: bool = True, clustered: bool = False) -> DataFrame:
    """Symbols of a corpus as (name, kind, file, line, pos)."""
    langs = [resolve_lang(lang)] if lang else None
    out = cap_per_file(declarations(positioned(files, langs, clustered), langs), cap)
    out = out.select("name", "kind", "file", "line", "pos")
    if not ordered:
        return out
    # A range sort samples its input first. This exchange, of declarations
    # only, keeps the sample from computing the tokens a second time. By two
    # keys, because an exchange by file alone is already there and is dropped.
    return out.repartition(partition_count(files.sparkSession), "file", "line").orderBy("file", "line", "pos")


_DEFINITION = "STRUCT<name: STRING, kind: STRING, line: BIGINT, pos: BIGINT, head: STRUCT<line: BIGINT, at: BIGINT>>"


def with_ends(rows: DataFrame) -> DataFrame:
    """Adds ``ended`` to what ``resolve`` gives: the declaration that a token ends,
    by closing its body or, without one, as its terminator."""
    # A declaration complete at its name still waits for its body here.
    rows = rows.selectExpr("*", f"""(last(CASE
        WHEN sym IS NOT NULL AND text <> '{{' THEN struct(sym AS def)
        WHEN {_STOPS} THEN named_struct('def', CAST(null AS {_DEFINITION})) END, true) OVER {BEFORE}).def AS header""")
    rows = rows.selectExpr("*", f"""(last(CASE
        WHEN text = '{{' AND NOT edge THEN named_struct('def', coalesce(sym, header))
        END, true) OVER {BEFORE}).def AS body_of""")
    return rows.selectExpr("*", "CASE WHEN edge THEN null WHEN text = '}' THEN body_of WHEN text = ';' THEN header END AS ended")


def _block_spans(tokens: DataFrame, langs: list[str], extra: dict[str, list[Rule]] | None) -> DataFrame:
    """Ends of declarations in the languages with brackets: the brace that
    closes the body, or the semicolon when there is none."""
    rows = with_ends(resolve(tokens, langs, extra, heads=True))
    rows = rows.selectExpr(
        "file", "fid", "lang", "valid", "pos", "macro", "sym", "line", "until", "ended")
    if "rust" in langs:
        rows = _outside_macros(rows.where("sym IS NOT NULL OR ended IS NOT NULL OR macro <> 0"))
    both = rows.where("sym IS NOT NULL OR ended IS NOT NULL").selectExpr("file", "lang", "valid", """inline(array(
        named_struct('def', sym, 'end_line', CAST(null AS BIGINT), 'end_at', CAST(null AS BIGINT)),
        named_struct('def', ended, 'end_line', line, 'end_at', until)))""").where("def IS NOT NULL")
    return both.groupBy("file", "lang", "valid", "def").agg(
        F.min("end_line").alias("end_line"), F.min("end_at").alias("end_at"))


def _indent_spans(tokens: DataFrame) -> DataFrame:
    """Ends of Python declarations: the last token before the next line that
    is indented no deeper than the declaration.

    Every line start is repeated for each declaration indent at or right of
    it (a file has few distinct ones), so the end is the next row of a window.
    """
    whole = f"(PARTITION BY {FILE} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    rows = with_neighbours(tokens, before=2, after=1).selectExpr(
        "*", "paren = 0 AND brace = 0 AND starts_line AS begins",
        f"lag(line_end, 1) OVER {BY_FILE} AS before_line", f"lag(until, 1) OVER {BY_FILE} AS before_at",
        f"last(line_end) OVER {whole} AS last_line", f"last(until) OVER {whole} AS last_at")
    rows = rows.selectExpr("*", f"""last(CASE WHEN begins THEN named_struct('line', line, 'at', at, 'indent', indent)
        END, true) OVER {RUNNING} AS first""")
    rows = rows.selectExpr("*", """CASE WHEN cls = 'ident' AND p1 IN ('def', 'class') THEN named_struct(
        'name', text, 'kind', CASE p1 WHEN 'def' THEN 'fn' ELSE 'class' END, 'line', line, 'pos', pos,
        'head', named_struct('line', first.line, 'at', first.at)) END AS def""")
    rows = rows.selectExpr("*", f"collect_set(CASE WHEN def IS NOT NULL THEN first.indent END) OVER {whole} AS indents")
    rows = rows.where("def IS NOT NULL OR begins").selectExpr("*", """explode(
        CASE WHEN def IS NOT NULL AND NOT begins THEN array(first.indent)
        ELSE filter(indents, c -> c >= indent) END) AS lv""")
    return rows.selectExpr(
        "file", "lang", "valid", "def",
        f"coalesce(lead(before_line, 1) OVER ({LEVEL}), last_line) AS end_line",
        f"coalesce(lead(before_at, 1) OVER ({LEVEL}), last_at) AS end_at",
    ).where("def IS NOT NULL")


def definition_spans(files: DataFrame, lang: str | None = None, extra: dict[str, list[Rule]] | None = None) -> DataFrame:
    """Declarations with the extent of the whole item: name, kind, file, lang,
    line, pos, start_line, end_line, start_at, end_at (character offsets)."""
    langs = [lang] if lang else list(NAME_RULES)
    blocks = [x for x in langs if x != "python"]
    parts = [_block_spans(positioned(files, blocks), blocks, extra)] if blocks else []
    if "python" in langs:
        parts.append(_indent_spans(positioned(files, ["python"])))
    spans = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return spans.select(
        captured("def.name").alias("name"), "def.kind", "file", "lang", "def.line", "def.pos",
        F.coalesce("def.head.line", "def.line").alias("start_line"),
        F.coalesce("end_line", "def.line").alias("end_line"),
        F.col("def.head.at").alias("start_at"), "end_at")
