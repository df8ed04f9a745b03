"""Languages, file extensions, aliases and symbol kinds as column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File extensions of each language (case-sensitive).
EXTENSIONS = {
    "bash": ["sh", "bash", "zsh"],
    "c": ["c", "h"],
    "cpp": ["cc", "cpp", "cxx", "hh", "hpp", "hxx"],
    "go": ["go"],
    "javascript": ["js", "mjs", "cjs"],
    "python": ["py", "pyw"],
    "rust": ["rs"],
    "swift": ["swift"],
    "typescript": ["ts", "tsx", "mts", "cts"],
}

# Names a user may give for a language (any case).
ALIASES = {
    "bash": ["bash", "sh"],
    "c": ["c"],
    "cpp": ["cpp", "c++", "cxx"],
    "go": ["go", "golang"],
    "javascript": ["js", "javascript"],
    "python": ["py", "python"],
    "rust": ["rs", "rust"],
    "swift": ["swift"],
    "typescript": ["ts", "tsx", "typescript"],
}

# Symbol kinds; any other label is "unknown".
KINDS = [
    "fn", "struct", "enum", "trait", "mod", "type", "const", "static",
    "macro", "class", "method", "interface", "namespace",
]

LANGS = list(EXTENSIONS)


class UnknownLanguage(ValueError):
    """Raised before planning when a query names a language we do not have."""


def _lookup(table: dict[str, list[str]], key: Column) -> Column:
    pairs = [F.lit(x) for lang, names in table.items() for n in names for x in (n, lang)]
    return F.try_element_at(F.create_map(*pairs), key)


def extension(path: Column) -> Column:
    """The part after the last dot of the file name; '' when there is none.

    A leading dot alone (``.bashrc``) does not start an extension.
    """
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(F.substring(name, 2, 1 << 30), ".") > 0,
                  F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def detect_lang(path: Column) -> Column:
    """Language of a path by its extension, or null."""
    return _lookup(EXTENSIONS, extension(path))


def normalize_lang(name: Column) -> Column:
    """Language for a user-given name, or null."""
    return _lookup(ALIASES, F.lower(name))


def find_lang(name: str) -> str | None:
    """Driver-side form of ``normalize_lang``."""
    return next((lang for lang, names in ALIASES.items() if name.lower() in names), None)


def resolve_lang(name: str) -> str:
    """Language for a query argument; an unknown name is an error."""
    if lang := find_lang(name):
        return lang
    raise UnknownLanguage(f"unknown language {name!r}; supported: {', '.join(LANGS)}")


def extensions_of(lang: str) -> list[str]:
    return EXTENSIONS[resolve_lang(lang)]


def has_extension_of(path: Column, lang: str) -> Column:
    """True for the paths a query in ``lang`` reads."""
    return extension(path).isin(extensions_of(lang))


def symbol_kind(label: Column) -> Column:
    """Kind named by a capture label such as ``@fn.name``."""
    head = F.substring_index(F.ltrim(label, F.lit("@")), ".", 1)
    return F.when(head.isin(KINDS), head).otherwise(F.lit("unknown"))
