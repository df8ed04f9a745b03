"""One regular expression per language that cuts source text into tokens.

Each match is optional white space followed by one token; a comment or a
string is always a single token, so nothing inside it can look like code.
Everything is possessive: Java then loops instead of recursing, and very long
literals cannot overflow the stack.

A string with code in it is cut once more: its text, the brackets of each hole
and the tokens of the code between them become tokens of their own, and so do
strings inside that code. The text behind a hole starts with the bracket that
closes it; only files that hold such strings pay for the second cut.

Where a regular expression cannot follow the language: block comments nest up
to ``NESTING`` levels, strings with code up to ``HOLES``, and a regex literal
is told from a division by the text before it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NESTING = 32
HOLES = 4

_LINE_COMMENT = r"//[^\n]*+"
_C_LINE_COMMENT = r"//(?:[^\n\\]|\\.)*+"
_HASH_COMMENT = r"#[^\n]*+"
_BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+\*/"
_DOUBLE = r'"(?:[^"\\\n]++|\\.)*+"'
_DOUBLE_LINES = r'"(?:[^"\\]++|\\.)*+"'
_SINGLE = r"'(?:[^'\\\n]++|\\.)*+'"
_IDENT = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{N}\p{M}_]*+"
_JS_IDENT = r"[\p{L}\p{Nl}_$][\p{L}\p{Nl}\p{N}\p{M}_$]*+"
_NUMBER = r"[0-9][0-9A-Za-z_]*+(?:\.[0-9][0-9A-Za-z_]*+)?"
_CONTINUED_LINE = r"\\\r?\n"


def _nested_comment() -> str:
    body = _BLOCK_COMMENT
    for _ in range(NESTING - 1):
        body = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*)|" + body + r")*+\*/"
    return body


def _alternatives(*parts: str) -> str:
    return r"(?s)\s*+(?:" + "|".join(parts) + r"|.|\z)"


def _python_code() -> str:
    """Code in braces, whose brackets nest up to ``HOLES`` deep."""
    code = f"(?:[^{{}}\"']++|{_DOUBLE}|{_SINGLE})"
    for _ in range(HOLES):
        code = r"(?:[^{}\"']++|" + _DOUBLE + "|" + _SINGLE + r"|\{" + code + r"*+\})"
    return code


_PYTHON_TEXT = r"\\N\{[^}\n]*+\}|\\[^{]|\\(?=\{)|\{\{"


def _python() -> str:
    hole = _PYTHON_TEXT + r"|\{" + _python_code() + r"*+\}"
    holed = (r"(?i:[ft]r?|r[ft])(?:" + "|".join(
        quote * 3 + "(?:[^" + quote + r"\\{]++|" + hole + "|" + quote + "(?!" + quote * 2 + "))*+" + quote * 3
        + "|" + quote + "(?!" + quote * 2 + ")(?:[^" + quote + r"\\\n{]++|" + hole + ")*+" + quote for quote in "\"'") + ")")
    prefix = r"(?i:[rbuft]|[rbft][rbft])?"
    triple = (r'(?:"""(?:[^"\\]++|\\.|"(?!""))*+"""' + r"|'''(?:[^'\\]++|\\.|'(?!''))*+''')")
    return _alternatives(
        _HASH_COMMENT, _CONTINUED_LINE, holed, prefix + triple,
        prefix + f"(?:{_DOUBLE}|{_SINGLE})", _IDENT, _NUMBER, "->", ":=", r"\*\*")


def _rust() -> str:
    return _alternatives(
        _LINE_COMMENT, _nested_comment(),
        r'[bc]?r(?<hash>#*+)".*?"\k<hash>', f"[bc]?{_DOUBLE_LINES}",
        r"b?'(?:[^'\\\n]|\\[^\n][^'\n]*+)'", f"'{_IDENT}",
        f"(?:r#)?{_IDENT}", _NUMBER, "::", "->", "=>", "==", "<=", ">=", "!=")


def _javascript_code() -> str:
    """Code in braces: braces and templates in it nest up to ``HOLES`` deep."""
    plain = r"[^`{}'\"]++|'(?:[^'\\\n]|\\.)*+'|" + r'"(?:[^"\\\n]|\\.)*+"'
    code = f"(?:{plain})"
    for _ in range(HOLES):
        code = "(?:" + plain + r"|\{" + code + r"*+\}|" + _template(code) + ")"
    return code


_TEMPLATE_TEXT = r"[^`\\$]++|\\.|\$(?!\{)"


def _template(code: str) -> str:
    return "`(?:" + _TEMPLATE_TEXT + r"|\$\{" + code + r"*+\})*+`"


def _javascript() -> str:
    plain_template = r"`(?:[^`\\]++|\\.)*+`"
    template = _template(_javascript_code())
    before_regex = (r"(?<=(?:^|[(,=:\[!&|?{};+\-*%~^<>\n])[ \t]{0,64}"
                    r"|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else)[ \t]{1,8})")
    regex = (before_regex + r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[A-Za-z]*+")
    return _alternatives(
        _LINE_COMMENT, _BLOCK_COMMENT, r"#![^\n]*+", regex, _DOUBLE, _SINGLE,
        template, plain_template, "#" + _JS_IDENT, _JS_IDENT, _NUMBER,
        "=>", r"\.\.\.", r"\?\.", "===?", "!==?", "<=", ">=", "&&", r"\|\|", r"\?\?")


def _go() -> str:
    return _alternatives(
        _LINE_COMMENT, _BLOCK_COMMENT, r"`[^`]*+`", _DOUBLE, _SINGLE,
        _IDENT, _NUMBER, ":=", "==", "<-", r"\.\.\.")


def _c_common(qualified: bool) -> str:
    directive = r"#(?:[^\n\\/]|\\.|/(?![*/])|" + _BLOCK_COMMENT + "|" + _C_LINE_COMMENT + r")*+"
    raw = r'(?:u8|[uUL])?R"(?<mark>[^()\\\s]{0,16})\(.*?\)\k<mark>"'
    encoded = f"(?:u8|[uUL])?(?:{_DOUBLE}|{_SINGLE})"
    number = r"[0-9](?:'?[0-9A-Za-z_.])*+"
    operator = r"operator\s*+(?:\(\)|\[\]|[^\s\w();{},]++)"
    step = r"(?:<[\w\s,:*&]*+>)?::"
    name = f"{_IDENT}(?:{step}(?:{operator}|~?{_IDENT}))++"
    parts = [_C_LINE_COMMENT, _BLOCK_COMMENT, _CONTINUED_LINE, directive]
    if qualified:
        parts += [raw, encoded, number, name, operator, _IDENT, "::", "->", "&&", "==", "<=", ">=", "!="]
    else:
        parts += [encoded, number, _IDENT, "->", "==", "<=", ">=", "!="]
    return _alternatives(*parts)


def _swift_code() -> str:
    code = r"(?:[^()\"]++|" + _DOUBLE + ")"
    for _ in range(HOLES):
        code = r"(?:[^()\"]++|" + _swift_text(code) + r"|\(" + code + r"*+\))"
    return code


def _swift_text(code: str) -> str:
    return r'"(?:[^"\\\n]++|\\\(' + code + r"*+\)|\\(?!\().)*+" + '"'


def _swift() -> str:
    return _alternatives(
        _LINE_COMMENT, _nested_comment(),
        r'(?<hash>#*+)""".*?"""\k<hash>', r'(?<fence>#++)".*?"\k<fence>',
        _swift_text(_swift_code()), _DOUBLE,
        f"`{_IDENT}`", _IDENT, _NUMBER, "->", "==", "&&")


# Arithmetic, which is no command.
_BASH_SUM = r"\$\(\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)\)"
_BASH_TEXT = r"[^\\$]++|\\.|" + _BASH_SUM + r"|\$(?!\()"


def _bash_code() -> str:
    plain = r"[^()\"'\\]++|\\.|'[^']*+'"
    code = f"(?:{plain}|{_DOUBLE_LINES})"
    for _ in range(HOLES):
        code = f"(?:{plain}|" + _bash_string(code) + r"|\(" + code + r"*+\))"
    return code


def _bash_string(code: str) -> str:
    return '"(?:[^"' + _BASH_TEXT[2:] + r"|\$\(" + code + r"*+\))*+" + '"'


def _bash() -> str:
    heredoc = (r"<<-?(?!<)[ \t]*+['\"\\]?(?<tag>[A-Za-z_]\w*+)['\"]?[^\n]*+\n"
               r"(?:.*?\n)??[ \t]*+\k<tag>(?=[ \t]*+(?:\r?\n|\z))")
    return _alternatives(
        r"(?<![^\s;&|()])#[^\n]*+", r"\\.", heredoc, _bash_string(_bash_code()), _DOUBLE_LINES, r"\$?'[^']*+'",
        r"\$(?:\{[^}]*+\}|\w++|[#?$!@*-])", r"[\p{L}0-9_\-.:/@+%^,~]++", "&&", r"\|\|", ";;")


LEXERS = {
    "bash": _bash(),
    "c": _c_common(qualified=False),
    "cpp": _c_common(qualified=True),
    "go": _go(),
    "javascript": _javascript(),
    "python": _python(),
    "rust": _rust(),
    "swift": _swift(),
    "typescript": _javascript(),
}


def _pieces(text: str, sign: str, opener: str, code: str, closer: str) -> str:
    """Cuts a string into its text, up to each hole and with the sign before it, and holes without their closing bracket."""
    before = f"(?:{text})*+{sign}(?=\\{opener})|" if sign else ""
    return f"(?s)\\{opener}{code}*+(?=\\{closer})|{before}(?:{text})++|."


_TEMPLATE_PIECES = _pieces(r"[^\\$]++|\\.|\$(?!\{)", r"\$", "{", _javascript_code(), "}")

# What a file with such strings contains, what such a string looks like, the bracket of a hole, and the cut
INTERPOLATED = {
    "bash": (r"\$\(", r'^\s*+".*\$\(', "(", _pieces(_BASH_TEXT, r"\$", "(", _bash_code(), ")")),
    "javascript": (r"\$\{", r"^\s*+`.*\$\{", "{", _TEMPLATE_PIECES),
    "python": (r"(?i)[ft]r?[\"']", r"^\s*+(?i:[ft]r?|r[ft])[\"'].*\{", "{",
               _pieces(r"[^\\{]++|" + _PYTHON_TEXT, "", "{", r"(?!\{)" + _python_code(), "}")),
    "swift": (r"\\\(", r'^\s*+".*\\\(', "(", _pieces(r"[^\\]++|\\(?!\().", r"\\", "(", _swift_code(), ")")),
    "typescript": (r"\$\{", r"^\s*+`.*\$\{", "{", _TEMPLATE_PIECES),
}


def _tokens(lang: str, src: Column) -> Column:
    return F.regexp_extract_all(src, F.lit(LEXERS[lang]), F.lit(0))


def _open_strings(lang: str, tokens: Column, levels: int = HOLES) -> Column:
    """Tokens in which a string with holes is replaced by its pieces; together they are the same text."""
    if not levels:
        return tokens
    _, shape, opener, pieces = INTERPOLATED[lang]

    def piece(text: Column) -> Column:
        code = _open_strings(lang, _tokens(lang, F.substr(text, F.lit(2))), levels - 1)
        return F.when(text.startswith(opener), F.concat(F.array(F.lit(opener)), code)).otherwise(F.array(text))

    def opened(token: Column) -> Column:
        return F.flatten(F.transform(F.regexp_extract_all(token, F.lit(pieces), F.lit(0)), piece))

    return F.flatten(F.transform(tokens, lambda t: F.when(t.rlike("(?s)" + shape), opened(t)).otherwise(F.array(t))))


# Texts above this size are cut in steps: the tokens of a whole file would be one array in memory.
LONG = 1 << 20
STEP = 10_000
# Lexers that look at nothing before a token; a text that starts at one is then cut as it would be within the file.
WITHOUT_LOOKBEHIND = ("go", "python", "rust", "swift")


def steps(lang: Column, src: Column, langs: list[str] | None = None) -> Column:
    """Array of texts of ``STEP`` tokens that make up a long text; a shorter one stays whole."""
    out = F.array(src)
    for name in langs or LEXERS:
        if name in WITHOUT_LOOKBEHIND:
            many = F.regexp_extract_all(src, F.lit(f"(?:{LEXERS[name]}){{1,{STEP}}}+"), F.lit(0))
            out = F.when((lang == name) & (F.octet_length(src) > LONG), many).otherwise(out)
    return out


def cut(lang: Column, src: Column, langs: list[str] | None = None) -> Column:
    """Array of raw tokens (each with the white space before it)."""
    chain = None
    for name in langs or LEXERS:
        piece = _tokens(name, src)
        if name in INTERPOLATED:
            piece = F.when(src.rlike(INTERPOLATED[name][0]), _open_strings(name, piece)).otherwise(piece)
        chain = F.when(lang == name, piece) if chain is None else chain.when(lang == name, piece)
    return chain


# Lexical class of one token, by its first character and its quotes.
# SQL text over the columns ``lang`` and ``text``.
TOKEN_CLASS = r"""
CASE
  WHEN ascii(text) = 35 AND lang IN ('python', 'bash') THEN 'comment'
  WHEN ascii(text) = 47 AND lang NOT IN ('python', 'bash')
       AND (startswith(text, '//') OR startswith(text, '/*')) THEN 'comment'
  WHEN ascii(text) = 92 AND contains(text, '\n') THEN 'comment'
  WHEN ascii(text) = 35 AND lang IN ('javascript', 'typescript') AND startswith(text, '#!')
       AND length(text) > 2 THEN 'comment'
  WHEN ascii(text) = 35 AND lang IN ('c', 'cpp') THEN 'directive'
  WHEN ascii(text) IN (41, 125) AND length(text) > 1 THEN 'string'
  WHEN ascii(text) BETWEEN 48 AND 57 THEN 'number'
  WHEN ascii(text) = 39 AND lang = 'rust' AND NOT endswith(text, "'") THEN 'lifetime'
  WHEN length(text) > 1 AND (contains(text, '"') OR contains(text, "'")
       OR (contains(text, '`') AND lang <> 'swift')) THEN 'string'
  WHEN ascii(text) = 47 AND length(text) > 1 AND lang IN ('javascript', 'typescript') THEN 'regex'
  WHEN ascii(text) = 60 AND length(text) > 3 THEN 'string'
  WHEN ascii(text) = 35 AND length(text) > 1 THEN 'private'
  WHEN lang = 'cpp' AND startswith(text, 'operator') AND rlike(text, '^operator[^A-Za-z0-9_]') THEN 'operator'
  WHEN ascii(text) BETWEEN 65 AND 90 OR ascii(text) BETWEEN 97 AND 122 OR ascii(text) = 95 OR ascii(text) > 127
       OR (ascii(text) = 36 AND lang IN ('javascript', 'typescript'))
       OR (ascii(text) = 96 AND lang = 'swift')
    THEN CASE WHEN lang = 'cpp' AND contains(text, '::') THEN 'qualified' ELSE 'ident' END
  ELSE 'punct'
END"""
