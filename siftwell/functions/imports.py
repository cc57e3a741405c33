"""Modules that source text imports, by language: regular expressions over the text without its comments and long strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import let

_SCRIPT = r"""(?:\bfrom|\bimport|\brequire\()\s*['"]([^'"\n]+)['"]"""
_INCLUDE = r"""(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]"""
IMPORTS = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "tsx": _SCRIPT,
    "java": r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;",
    "csharp": r"(?m)^[ \t]*using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;",
    "go": r"""(?m)^[ \t]*import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)\"""",
    "c": _INCLUDE,
    "cpp": _INCLUDE,
}
_GO_BLOCK = r"(?s)\bimport\s*\((.*?)\)"


_PYTHON = r"(?m)^[ \t]*(?:from[ \t]+\.*[\w.]*[ \t]+import\b|import[ \t]+[^\n#;]+)"
_RUST = r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([^;]+);"
_INNERMOST = r"(?s)^(.*?)((?:\w+::)*)\{([^{}]*)\}(.*)$"
DEPTH = 5  #: braces in braces that are taken apart


def without_comments(language: Column, content: Column) -> Column:
    """The text with empty strings for Python's long ones, and without comments that take whole lines or blocks."""
    python = F.regexp_replace(F.regexp_replace(content, "(?s)(\"\"\"|''').*?\\1", '""'), r"(?m)^[ \t]*#.*$", "")
    other = F.regexp_replace(F.regexp_replace(content, r"(?s)/\*.*?\*/", ""), r"(?m)^[ \t]*//.*$", "")
    return F.when(language == "python", python).otherwise(other)


def _python(content: Column) -> Column:
    def modules(statement: Column) -> Column:
        one = F.array(F.regexp_extract(statement, r"from[ \t]+(\.*[\w.]*)", 1))
        listed = F.split(F.regexp_replace(F.trim(statement), r"^import[ \t]+", ""), ",")
        names = F.transform(listed, lambda x: F.regexp_extract(x, r"^\s*([\w.]+)", 1))
        return F.when(F.trim(statement).startswith("from"), one).otherwise(names)

    return F.flatten(F.transform(F.regexp_extract_all(content, F.lit(_PYTHON), F.lit(0)), modules))


def _spread(path: Column) -> Column:
    """``a::{b, c}`` as ``a::b, a::c``: the innermost braces of a path."""
    part = [F.regexp_extract(path, _INNERMOST, k) for k in range(5)]
    items = F.filter(F.transform(F.split(part[3], ","), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.array_join(F.transform(items, lambda x: F.concat(part[2], x)), ", ")
    return F.when(path.rlike(_INNERMOST), F.concat(part[1], listed, part[4])).otherwise(path)


def _rust(content: Column) -> Column:
    def modules(path: Column) -> Column:
        path = F.regexp_replace(path, r"\s+", " ")
        for _ in range(DEPTH):
            path = let(path, _spread)
        plain = F.transform(F.split(path, ","), lambda x: F.regexp_replace(F.regexp_extract(F.trim(x), r"^([\w:*]+)", 1), "::self$", ""))
        return F.filter(plain, lambda x: x != "")

    return F.flatten(F.transform(F.regexp_extract_all(content, F.lit(_RUST), 1), modules))


def imported_modules(language: Column, content: Column) -> Column:
    """Distinct modules in order of appearance; empty for a language without a rule."""
    content = without_comments(language, content)
    found = F.when(language == "python", _python(content)).when(language == "rust", _rust(content)).otherwise(F.array().cast("array<string>"))
    for name, pattern in IMPORTS.items():
        own = F.regexp_extract_all(content, F.lit(pattern), 1)
        if name == "go":
            blocks = F.array_join(F.regexp_extract_all(content, F.lit(_GO_BLOCK), 1), "\n")
            own = F.concat(own, F.regexp_extract_all(blocks, F.lit('"([^"\n]+)"'), 1))
        found = F.when(language == name, own).otherwise(found)
    return F.array_distinct(F.filter(found, lambda m: m != ""))
