"""Structural questions over source files, answered on the token relation.

Every question names its literals, so files that do not contain them are
dropped by a string test before any text is shuffled or cut. Results are rows
of (capture, text, file, start_line, end_line), in file and source order when
a limit asks for an order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from srcatlas.functions.langs import resolve_lang
from srcatlas.functions.paths import decode_capture, path_scope, source_text
from srcatlas.operators.declarations import BEFORE, BEFORE_IT, MACRO_OPENS, SO_FAR, TS_MEMBER_STARTS, Rule, definition_spans, following, resolve, words_in
from srcatlas.operators.tokens import BY_FILE, CLOSES, FILE, OPENS, captured, positioned, with_neighbours

MAX_CAPTURES = 500

FUNCTION_KINDS = ["fn", "method"]
TYPE_KINDS = ["struct", "enum", "class", "interface", "trait", "type"]

_MATCH = ["capture", "text", "file", "start_line", "end_line"]


def searched(files: DataFrame, lang: str, path: str | None = None, words: Sequence[str] = ()) -> DataFrame:
    """The files a question reads; raises for an unknown language."""
    out = files.where(F.col("lang") == resolve_lang(lang))
    if path is not None:
        out = out.where(path_scope(F.col("path"), path))
    text = F.col("src") if "src" in files.columns else source_text(F.col("content"))
    for word in words:
        out = out.where(F.contains(text, F.lit(word)))
    return out


def limited(matches: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` captures in (file, position) order, or all."""
    if limit is not None:
        matches = matches.orderBy("file", "pos", "capture_ix").limit(limit)
    return matches.select(*_MATCH)


def _item_texts(files: DataFrame, items: DataFrame) -> DataFrame:
    """Adds ``text``, the source between ``start_at`` and ``end_at``.

    The matching rows meet the content of the files already filtered by name, by
    a merge: neither side is small in a question about every name, and Spark
    takes computed content for as small as what it is computed from.
    """
    text = F.col("src") if "src" in files.columns else source_text(F.col("content"))
    sources = files.select(F.col("path").alias("file"), text.alias("src"))
    cut = F.substring("src", (F.col("start_at") + 1).cast("int"), (F.col("end_at") - F.col("start_at")).cast("int"))
    return items.join(sources.hint("merge"), "file").withColumn("text", F.coalesce(decode_capture(cut, F.is_valid_utf8("src")), "name"))


def _with_item(files: DataFrame, items: DataFrame, name_capture: str, item_capture: str) -> DataFrame:
    """Two captures per item: its name and the whole of it."""
    return _item_texts(files, items).select("file", "pos", F.inline(F.array(
        F.struct(F.lit(0).alias("capture_ix"), F.lit(name_capture).alias("capture"), F.col("name").alias("text"),
                 F.col("line").alias("start_line"), F.col("line").alias("end_line")),
        F.struct(F.lit(1).alias("capture_ix"), F.lit(item_capture).alias("capture"), F.col("text"),
                 F.col("start_line"), F.col("end_line")))))


def _find_definition(files, name, lang, path, kinds, item_capture, limit):
    chosen = searched(files, lang, path, [name])
    spans = definition_spans(chosen, resolve_lang(lang)).where((F.col("name") == name) & F.col("kind").isin(kinds))
    return limited(_with_item(chosen, spans, "@name", item_capture), limit)


def find_function(files: DataFrame, name: str, lang: str, path: str | None = None,
                  limit: int | None = None) -> DataFrame:
    """Where is the function or method ``name`` defined?"""
    return _find_definition(files, name, lang, path, FUNCTION_KINDS, "@fn", limit)


def find_type(files: DataFrame, name: str, lang: str, path: str | None = None,
              limit: int | None = None) -> DataFrame:
    """Where is the struct, enum, class, trait, interface or type ``name`` defined?"""
    return _find_definition(files, name, lang, path, TYPE_KINDS, "@type", limit)


def find_impls(files: DataFrame, trait: str | None, lang: str = "rust", path: str | None = None,
               limit: int | None = None) -> DataFrame:
    """What implements ``trait`` (a plain name; every trait when None)? Rust only."""
    if resolve_lang(lang) != "rust":
        raise ValueError(f"implementations of traits are known for rust only, not {lang!r}")
    chosen = searched(files, lang, path, ["impl"] + ([trait] if trait else []))
    rule = {"rust": [Rule("impl", "p1 IN ('impl', '>', '!') AND n1 = 'for'")]}
    spans = definition_spans(chosen, resolve_lang(lang), extra=rule).where(F.col("kind") == "impl")
    if trait is not None:
        spans = spans.where(F.col("name") == trait)
    return limited(_with_item(chosen, spans, "@trait", "@impl"), limit)


_DECLARES = "fn def func function class new struct enum protocol macro_rules"
_MEMBER = ". ?. ->"
_C_KEYWORDS = "return else do case throw goto co_return co_await co_yield and or not"
# Words before a parenthesis that are no names, by language.
_WORDS = {
    "rust": "Fn FnMut FnOnce if match while for in return fn let move where pub as",
    "python": "if elif while for in not and or return yield lambda assert is del raise await else except import with case",
    "go": "if for switch func return else case select go defer range type var const import chan map interface struct",
}
_OTHER_WORDS = "if for while switch catch function return func else sizeof in typeof await case guard with super import"
# Swift names before braces that open no closure.
_SWIFT_BLOCKS = "else do get set willSet didSet defer repeat init deinit catch try return in throws rethrows async"
_ENDS_VALUE = ("(coalesce(p1, '') IN (')', ']', '}', '?', '!') OR coalesce(p1_cls, '') IN ('ident', 'qualified', 'string', 'number', 'regex'))")
# Where a chain of names, members, calls and indices starts.
_STARTS_CHAIN = (f"(NOT {CLOSES} AND NOT {words_in('p1', '. ?. -> ::')}"
                 f" AND NOT ((text IN ('.', '?.', '->', '::', '?', '!', '(', '[') OR (lang = 'swift' AND text = '{{')) AND {_ENDS_VALUE}))")

# What an opening bracket holds that is no code: attributes, macro arguments, patterns.
_HIDES = {
    "rust": """hiding OR (text = '(' AND (coalesce(site.p1, '') = 'let' OR stop = 'let'
            OR (stop IN ('{', '}', ',', '|') AND next_stop IN ('=>', 'if'))))""",
    "python": "text = '(' AND in_case = 'case'",
    "swift": "hiding",
}
_HIDING = {
    "rust": f"(text = '[' AND (p1 = '#' OR (p1 = '!' AND p2 = '#'))) OR {MACRO_OPENS}",
    "swift": "text = '(' AND coalesce(p2, '') IN ('@', '#')",
}
_PARTS = "'=>', '=', ',', ';', '{', '}', 'if', 'let', '|', 'while', 'for', 'in', 'return', 'match', 'else', 'case'"
# What tokens say to others of their level, by language: a value where they say something, and how it is looked up there.
_STOP = f"CASE WHEN text IN ({_PARTS}) THEN text END"
_SWIFT_MEMBER = f"CASE WHEN {words_in('text', 'case let var func static init')} THEN text END"
_MEMBERS = "CASE WHEN text = ':' AND p1 IN (')', 'noexcept') THEN 'members' WHEN text IN (';', '{', '}') THEN 'none' END"
_IN_CASE = "CASE WHEN text = 'case' AND starts_line THEN 'case' WHEN text IN (':', 'if') OR starts_line THEN 'none' END"
_TYPED = """CASE WHEN cls = 'ident' AND n1 = '<' THEN named_struct('name', text, 'pos', pos, 'line', line, 'at', at, 'before', p1)
    WHEN text IN ('(', ')', ';', '{', '}', '=', '&&', '||', '?') THEN named_struct('name', CAST(null AS STRING), 'pos', 0L, 'line', 0L, 'at', 0L, 'before', '') END"""
_NO_TYPE = "named_struct('name', CAST(null AS STRING), 'pos', 0L, 'line', 0L, 'at', 0L, 'before', '')"
_SAYS = {
    "rust": {"part": (_STOP, f"last(CASE WHEN edge THEN text WHEN part IS NOT NULL THEN part END, true) OVER {BEFORE} AS stop")},
    "cpp": {"listed": (_MEMBERS, f"last(CASE WHEN edge THEN 'none' ELSE listed END, true) OVER {BEFORE} AS in_list")},
    "python": {"cased": (_IN_CASE, f"last(CASE WHEN edge THEN 'none' ELSE cased END, true) OVER {BEFORE} AS in_case")},
    "swift": {"word": (_SWIFT_MEMBER, f"last(CASE WHEN edge THEN 'none' ELSE word END, true) OVER {BEFORE} AS member")},
    "typescript": {"typing": (_TYPED, f"last(CASE WHEN edge THEN {_NO_TYPE} ELSE typing END, true) OVER {BEFORE} AS typed_name")},
}
# The next such token, or the start of the next bracket of the level inside.
_NEXT = {
    "rust": ("ahead", "CASE WHEN edge THEN 'edge' WHEN part <> '|' THEN part END", "next_stop"),
    "cpp": ("ahead", "CASE WHEN edge THEN 'edge' WHEN text IN (';', '{', '}') THEN text END", "next_end"),
}


def _call_rows(files: DataFrame, lang: str, methods: bool) -> DataFrame:
    """Brackets, and other tokens that decide about calls, with what decides: the declaration that
    starts next, the other end of a bracket, and whether what it holds is code (``hides``).
    ``site`` is what stands at an opening bracket and before it."""
    carry = [f"CASE WHEN {OPENS} THEN struct(p1, p1_cls, p1_pos, p1_line, p1_at, p2, p2_cls, p2_line_end, line_end, brace, at) END AS site",
             f"CASE WHEN {CLOSES} THEN struct(line, line_end, until, n1) END AS closing"]
    levels, keep = [f"{following('closing')} AS closed"], [OPENS, CLOSES]
    for name, (value, window) in _SAYS.get(lang, {}).items():
        carry.append(f"{value} AS {name}")
        keep.append(f"{value} IS NOT NULL")
        levels.append(window)
    if lang in _NEXT:
        levels.append(f"{following(_NEXT[lang][1])} AS {_NEXT[lang][2]}")
    if lang in _HIDING:
        carry.append(f"coalesce({_HIDING[lang]}, false) AS hiding")
    if methods:
        carry.append(f"CASE WHEN {_STARTS_CHAIN} THEN struct(at, line) END AS link")
        keep.append(_STARTS_CHAIN)
        levels.append(f"last(CASE WHEN NOT edge THEN link END, true) OVER {SO_FAR} AS chain")
    rows = resolve(positioned(files, [lang]), [lang], keep=" OR ".join(f"({k})" for k in keep), carry=carry, levels=levels)
    rows = rows.selectExpr("*", "CASE WHEN NOT edge THEN sym END AS starting").selectExpr("*", f"{following('starting')} AS declared")
    return rows.where("NOT edge AND site IS NOT NULL").selectExpr("* EXCEPT (own)", "site.*", f"coalesce({_HIDES.get(lang, 'false')}, false) AS hides")


def calls(files: DataFrame, lang: str, name: str | None = None, methods: bool = False) -> DataFrame:
    """Call sites: file, valid, pos, name, line, start_line, end_line, start_at, end_at, value_line, value_at.

    A call is a name before a pair of parentheses, or in Swift before a closure
    alone, that declares nothing, is no pattern, attribute, enum variant,
    interface method or member initialiser, and stands in no macro's arguments.
    ``methods`` asks for calls on a receiver instead; ``value_at`` is where the
    chain of names, calls and indices before the call starts.
    """
    if lang == "bash":
        return _bash_commands(files, name)
    rows = _call_rows(files, lang, methods)
    direct = "named_struct('name', p1, 'cls', p1_cls, 'pos', p1_pos, 'line', p1_line, 'at', p1_at, 'before', p2, 'starts', coalesce(p1_line > p2_line_end, true))"
    opens = "text = '(' AND p1_cls = 'ident'"
    if lang == "swift":
        alone = (f"text = '{{' AND p1_cls = 'ident' AND p1_line = line AND NOT {words_in('p1', _SWIFT_BLOCKS)}"
                 f" AND (p2 IS NULL OR p1_line > p2_line_end OR {words_in('p2', '{ } ; = return . ?. (')})")
        opens = f"(({opens}) OR ({alone} AND coalesce(declared.pos, -1) <> p1_pos))"
    if lang == "typescript":  # type arguments stand between the name and its parentheses
        rows = rows.withColumn("generic_name", F.expr("CASE WHEN text = '(' AND p1 = '>' THEN typed_name END"))
        opens = f"(({opens}) OR (text = '(' AND generic_name.name IS NOT NULL))"
        direct = (f"CASE WHEN p1 = '>' THEN named_struct('name', generic_name.name, 'cls', 'ident', 'pos', generic_name.pos, 'line', generic_name.line,"
                  f" 'at', generic_name.at, 'before', generic_name.before, 'starts', false) ELSE {direct} END")
    rows = rows.selectExpr("*", f"{direct} AS own", "text AS opener")
    tests = [opens, "coalesce(declared.pos, -1) <> own.pos"]
    if name is None:
        tests.append(f"NOT {words_in('own.name', _WORDS.get(lang, _OTHER_WORDS))}")
    if methods:
        tests.append(words_in("own.before", _MEMBER))
    else:
        tests.append(f"NOT {words_in('own.before', _MEMBER + ' :: ' + _DECLARES)}")
        if lang in ("javascript", "typescript", "c", "cpp"):
            tests.append("coalesce(closed.n1, '') <> '{'")
        if lang == "typescript":
            tests.append(f"NOT (coalesce(closed.n1, '') = ':' AND (own.starts OR {words_in('own.before', TS_MEMBER_STARTS)}))")
        if lang in ("c", "cpp"):
            tests.append(f"coalesce(p2_cls, '') <> 'ident' OR {words_in('own.before', _C_KEYWORDS)}")
            tests.append("NOT (brace = 0 AND coalesce(own.before, '') IN ('*', '&', '&&'))")
        if lang == "cpp":  # names in the list between a constructor and its body
            tests.append("NOT (coalesce(in_list, '') = 'members' AND coalesce(next_end, '') = '{')")
        if lang == "go":
            tests.append("coalesce(own.before, '') <> ')' AND NOT (coalesce(encl.text, '') = '{' AND coalesce(encl.p1, '') = 'interface')")
        if lang == "rust":  # variants of an enum
            tests.append("NOT coalesce(encl.text = '{' AND encl.of_enum, false)")
        if lang == "swift":
            tests.append("coalesce(own.before, '') NOT IN ('@', '#') AND NOT (own.name IN ('init', 'subscript') AND opener = '(')"
                         " AND NOT coalesce(encl.text = '{' AND encl.of_enum AND member = 'case', false)")
        if lang in ("javascript", "typescript"):
            tests.append("NOT (own.name = 'async' AND coalesce(closed.n1, '') = '=>')")
    wanted = F.expr(" AND ".join(f"({test})" for test in tests))
    if name is not None:
        wanted = wanted & (F.col("own.name") == name)
    found = ["file", "valid", "own.pos AS pos", "own.name AS name", "own.line AS line", "own.line AS start_line",
             "coalesce(closed.line_end, line_end) AS end_line", "own.at AS start_at", "coalesce(closed.until, until) AS end_at",
             *(["coalesce(chain.line, own.line) AS value_line", "coalesce(chain.at, own.at) AS value_at"] if methods else
               ["own.line AS value_line", "own.at AS value_at"])]
    if lang not in _HIDES:
        return rows.where(wanted).selectExpr(*found)
    # A call is hidden where a bracket that holds no code, its own too, was opened so far and closes behind it.
    rows = rows.withColumn("wanted", F.coalesce(wanted, F.lit(False))).where("wanted OR hides").selectExpr(
        "fid", "wanted", "at", f"CASE WHEN hides THEN coalesce(closed.until, {1 << 62}) END AS hides_until", *found)
    rows = rows.selectExpr("*", f"max(hides_until) OVER (PARTITION BY {FILE} ORDER BY at ROWS UNBOUNDED PRECEDING) AS hidden_until")
    return rows.where("wanted AND coalesce(hidden_until <= at, true)").drop("fid", "wanted", "at", "hides_until", "hidden_until")


_BASH_RESERVED = ("('if', 'then', 'elif', 'else', 'fi', 'for', 'in', 'do', 'done', 'while', 'until', 'case', 'esac', 'select',"
                  " 'function', 'time', 'coproc')")


def _bash_commands(files: DataFrame, name: str | None) -> DataFrame:
    """Names where a command starts: after a separator, in an arm of ``case``, behind one assignment."""
    starts = "; { ( ) then do else && || | ! & if while until ;;"
    rows = with_neighbours(positioned(files, ["bash"]), before=4, after=2).selectExpr("*", f"""last(CASE
        WHEN text = ';;' OR (text = 'in' AND p2 = 'case') THEN 'pattern' WHEN text IN (')', 'esac') THEN 'none' END, true) OVER {BEFORE_IT} AS arm""")
    rows = rows.where(
        f"coalesce(arm, '') <> 'pattern' AND cls = 'ident' AND text NOT IN {_BASH_RESERVED} AND NOT (coalesce(n1, '') = '(' AND coalesce(n2, '') = ')')"
        f" AND coalesce(n1, '') NOT IN ('=', ')')"
        f" AND (starts_line OR {words_in('p1', starts)}"
        f" OR (p2 = '=' AND p1_line = line AND (p4 IS NULL OR p2_line > p4_line_end OR {words_in('p4', starts)})))")
    if name is not None:
        rows = rows.where(F.col("text") == name)
    return rows.selectExpr("file", "valid", "pos", "text AS name", "line", "line AS start_line", "line_end AS end_line", "at AS start_at",
                           "until AS end_at", "line AS value_line", "at AS value_at")


def find_calls(files: DataFrame, name: str | None, lang: str, path: str | None = None,
               limit: int | None = None) -> DataFrame:
    """Where is ``name`` called as a plain function? Captures @fn and @call."""
    chosen = searched(files, lang, path, [name] if name else [])
    return limited(_with_item(chosen, calls(chosen, resolve_lang(lang), name), "@fn", "@call"), limit)


def find_method_calls(files: DataFrame, name: str | None, lang: str, path: str | None = None,
                      limit: int | None = None) -> DataFrame:
    """Where is ``name`` called on a receiver? Captures @method and @call, the latter from the start of the receiver."""
    chosen = searched(files, lang, path, [name] if name else [])
    found = calls(chosen, resolve_lang(lang), name, methods=True)
    found = found.withColumn("start_at", F.col("value_at")).withColumn("start_line", F.col("value_line"))
    return limited(_with_item(chosen, found, "@method", "@call"), limit)


@dataclass(frozen=True)
class Tok:
    """A test for one token; all given conditions must hold."""

    text: str | None = None
    cls: str | None = None
    regex: str | None = None
    any_of: Sequence[str] | None = None
    none_of: Sequence[str] | None = None
    capture: str | None = None

    def holds(self, k: int):
        text, cls = F.col(f"t{k}"), F.col(f"c{k}")
        test = text.isNotNull()
        if self.text is not None:
            test = test & (text == self.text)
        if self.cls is not None:
            test = test & (cls == self.cls)
        if self.regex is not None:
            test = test & text.rlike(self.regex)
        if self.any_of is not None:
            test = test & text.isin(list(self.any_of))
        if self.none_of is not None:
            test = test & ~text.isin(list(self.none_of))
        return test


def _token_rows(files: DataFrame, lang: str, pattern: Sequence[Tok], comments: bool) -> DataFrame:
    rows = positioned(files, [lang])
    if not comments:
        rows = rows.where("cls <> 'comment'")
    cols = ["file", "valid", "pos"]
    for k in range(len(pattern)):
        for short, col in (("t", "text"), ("c", "cls"), ("l", "line"), ("e", "line_end")):
            cols.append(f"lead({col}, {k}) OVER {BY_FILE} AS {short}{k}")
    rows = rows.selectExpr(*cols)
    for k, tok in enumerate(pattern):
        rows = rows.where(tok.holds(k))
    captures = [
        F.struct(F.lit(ix).alias("capture_ix"), F.lit(f"@{tok.capture}").alias("capture"),
                 captured(f"t{k}").alias("text"),
                 F.col(f"l{k}").alias("start_line"), F.col(f"e{k}").alias("end_line"))
        for ix, (k, tok) in enumerate((k, t) for k, t in enumerate(pattern) if t.capture)]
    return rows.select("file", "pos", F.inline(F.array(*captures)))


def match_tokens(files: DataFrame, lang: str, *patterns: Sequence[Tok], path: str | None = None,
                 limit: int | None = None, comments: bool = False) -> DataFrame:
    """Captures of one or more flat token patterns.

    ``patterns`` are lists of ``Tok`` for consecutive tokens, comments skipped.
    Literal texts of a single pattern first select the files that hold them.
    """
    words = sorted({t.text for t in patterns[0] if t.text}) if len(patterns) == 1 else []
    chosen = searched(files, lang, path, words)
    out = None
    for pattern in patterns:
        rows = _token_rows(chosen, resolve_lang(lang), pattern, comments)
        out = rows if out is None else out.unionByName(rows)
    return limited(out, limit)
