"""What the corpora contain, as DuckDB SQL over the test tables."""

from __future__ import annotations

from corpora.templates import LANG_ORDER, PLANTED, TEMPLATES, TOKENS
from srcatlas.functions.langs import EXTENSIONS

N = "replace(p_name, ' ', '_')"
DIR = "'proj/' || lower(replace(p_brand, '#', '')) || '/' || lower(p_type)"


def fill(template: str) -> str:
    return f"replace(replace('{template}', '{{k}}', p_partkey::VARCHAR), '{{n}}', {N})"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _ext(lang: str, nth: str) -> str:
    values = EXTENSIONS[lang]
    return f"{_list(values)}[(({nth}) % {len(values)}) + 1]"


def part_files(lang: str | None = None) -> str:
    """SELECT path, lang, k, n, mtime_secs, mtime_nanos of the part corpus."""
    if lang:
        ext, name = _ext(lang, "p_partkey"), f"'{lang}'"
    else:
        count = len(LANG_ORDER)
        whens = " ".join(f"WHEN {i} THEN {_ext(x, f'p_partkey // {count}')}" for i, x in enumerate(LANG_ORDER))
        ext = f"CASE p_partkey % {count} {whens} END"
        name = f"{_list(LANG_ORDER)}[(p_partkey % {count}) + 1]"
    return (f"SELECT {DIR} || '/' || {N} || '_' || p_partkey || '.' || {ext} AS path, {name} AS lang, "
            f"p_partkey AS k, {N} AS n, p_partkey, p_name, "
            f"(1700000000 + p_partkey)::BIGINT AS mtime_secs, "
            f"((p_partkey * 7919) % 1000000000)::BIGINT AS mtime_nanos FROM part")


def planted(lang: str | None = None, langs: list[str] | None = None) -> str:
    """SELECT name, kind, file, line, end_line, lang, k of every declaration."""
    rows = []
    for name in ([lang] if lang else langs or LANG_ORDER):
        for kind, text, line, end in PLANTED[name]:
            rows.append(f"('{name}', '{kind}', '{text}', {line}, {end})")
    return (f"SELECT replace(replace(t.name, '{{k}}', f.k::VARCHAR), '{{n}}', f.n) AS name, t.kind AS kind, "
            f"f.path AS file, t.line::BIGINT AS line, t.end_line::BIGINT AS end_line, f.lang AS lang, f.k AS k "
            f"FROM ({part_files(lang)}) f JOIN (VALUES {', '.join(rows)}) "
            f"AS t(lang, kind, name, line, end_line) ON f.lang = t.lang")


def rendered(lang: str, rows: list[tuple], columns: str) -> str:
    """SELECT file and the given columns: each row once for each file of a part corpus in ``lang``."""
    names = columns.split()
    values = ", ".join("(" + ", ".join("null" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in rows)

    def filled(i: int, name: str) -> str:
        kinds = {type(row[i]) for row in rows} - {type(None)}
        if kinds == {int}:
            return f"t.{name}::BIGINT AS {name}"
        return f"replace(replace(t.{name}::VARCHAR, '{{k}}', f.k::VARCHAR), '{{n}}', f.n) AS {name}"

    return (f"SELECT f.path AS file, {', '.join(filled(i, n) for i, n in enumerate(names))} FROM ({part_files(lang)}) f, "
            f"(VALUES {values}) AS t({', '.join(names)})")


def tokens(lang: str) -> str:
    """SELECT file, lang, pos, cls, text, line, paren, brace of every token of a template."""
    rows, paren, brace = [], 0, 0
    for line, found in enumerate(TOKENS[lang], 1):
        for cls, text in (x.split(" ", 1) for x in found):
            paren, brace = paren - (text == ")"), brace - (text == "}")
            rows.append((lang, len(rows), cls, text, line, paren, brace))
            paren, brace = paren + (text == "("), brace + (text == "{")
    return rendered(lang, rows, "lang pos cls text line paren brace")


def order_lines() -> str:
    """Numbered order lines: l_orderkey, l_partkey, l_linenumber, i."""
    return ("SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey "
            "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem")


def written_files() -> str:
    """Path, language and size of the files written for a tree scan: each part
    file, and a copy of it under a name that Spark's own listing would skip."""
    sizes = ", ".join("('{}', '{}')".format(lang, ("\n".join(lines) + "\n").replace("'", "''"))
                      for lang, lines in TEMPLATES.items())
    size = "strlen(replace(replace(t.body, '{k}', f.k::VARCHAR), '{n}', f.n))::BIGINT"
    join = f"FROM ({part_files()}) f JOIN (VALUES {sizes}) AS t(lang, body) ON f.lang = t.lang"
    first = f"SELECT f.path AS path, f.lang AS lang, {size} AS length {join}"
    copy = (f"SELECT array_to_string(list_slice(string_split(f.path, '/'), 1, 3), '/') || '/_k' || f.k || "
            f"'/__init__.py' AS path, 'python' AS lang, {size} AS length {join}")
    return f"{first} UNION ALL {copy}"
