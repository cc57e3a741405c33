"""Text expressions of the search, packing and context operators: built-in Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
WORD = "[A-Za-z0-9_]+"
ELLIPSIS = "…"

#: Suffixes of source files and the grammar each belongs to.
LANGUAGE_OF_SUFFIX = {
    ".py": "python",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".cs": "csharp",
    ".c": "c",
    ".h": "c",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
}

#: Words of a task description that are not searched for.
STOP_WORDS = (
    "the a an of to in on for and or is are how do we does can with into that this "
    "add explain implement handle handling use using work works make from what where"
).split()

#: Marks of secrets, diffs and logs in free text.
SECRET_PATTERN = r"(?i)(password|secret|api[_-]?key|token|bearer|private[_-]?key)\s*[:=]"
DIFF_MARKS = ("diff --git", "\n+++ ", "\n--- ", "\n@@ ")
LOG_MARKS = ("traceback (most recent", "stdout", "stderr")


def language_of(path: Column) -> Column:
    """Grammar name by the lower-cased suffix of a path; null for others."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF_SUFFIX.items() for x in pair])
    return names[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: an expression that is named several times is else computed each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased words of one fixed ASCII class."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"))


def token_estimate(text: Column) -> Column:
    return F.floor((F.coalesce(F.length(text), F.lit(0)) + (CHARS_PER_TOKEN - 1)) / CHARS_PER_TOKEN).cast("long")


def fit_text(text: Column, max_tokens: int) -> Column:
    """The text, or as much as fits the budget with an ellipsis."""
    limit = max_tokens * CHARS_PER_TOKEN
    if limit <= 1:
        return F.lit("") if max_tokens <= 0 else F.when(token_estimate(text) <= max_tokens, text).otherwise("")
    cut = F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit(ELLIPSIS))
    return F.when(token_estimate(text) <= max_tokens, text).otherwise(cut)


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit(ELLIPSIS)))


def headline(text: Column, limit: int = 120) -> Column:
    """The first line of a text, cut to ``limit`` characters."""
    return truncate(F.split_part(F.trim(text), F.lit("\n"), F.lit(1)), limit)


def contains(text: Column, needle: str) -> Column:
    """Case-insensitive substring test; wildcards in the needle are ordinary characters."""
    return F.coalesce(F.lower(text).contains(needle.lower()), F.lit(False))


def glob_to_like(pattern: str) -> str:
    """A LIKE pattern (escape character backslash) for a path glob, whose ``*`` crosses slashes."""
    out = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return out.replace("**/", "%").replace("*", "%").replace("?", "_")


def is_glob(query: str) -> bool:
    return query.startswith("*.") or ("/" in query and any(c in query for c in "*?"))


def matches_any(path: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | path.like(glob_to_like(p))
    return found


def snippet(content: Column, query: str, limit: int = 240, before: int = 40) -> Column:
    """A window around the first case-insensitive hit of the query, with ellipses where text is left out."""
    needle = query.strip()
    if not needle or any(c in needle for c in "*?"):
        return truncate(F.trim(content), limit)
    hit = F.greatest(F.locate(needle.lower(), F.lower(content)) - 1, F.lit(0))
    start = F.greatest(hit - before, F.lit(0))
    end = F.least(F.length(content), start + limit)
    body = F.btrim(F.substring(content, start + 1, end - start), F.lit("\n"))
    return F.concat(
        F.when(start > 0, F.lit(ELLIPSIS)).otherwise(""),
        body,
        F.when(end < F.length(content), F.lit(ELLIPSIS)).otherwise(""),
    )


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the lower-cased ASCII words, each padded by two blanks before and one after."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)")))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def literal_trigrams(text: str) -> list[str]:
    """The same set for a query string on the driver."""
    out: dict[str, None] = {}
    word = ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            padded = f"  {word} "
            out |= dict.fromkeys(padded[i : i + 3] for i in range(len(word) + 1))
            word = ""
    return list(out)


def similarity(text: Column, query: str) -> Column:
    """Jaccard similarity of the trigram sets of a column and a query; 0 where the column is null or has none."""
    grams = literal_trigrams(query)
    if not grams:
        return F.lit(0.0)
    wanted = F.array(*[F.lit(g) for g in grams])
    sizes = let(trigrams(F.coalesce(text, F.lit(""))), lambda own: F.struct(F.size(own).alias("n"), F.size(F.array_intersect(own, wanted)).alias("c")))
    return let(sizes, lambda x: x.c / (x.n + len(grams) - x.c))


def path_mentions(text: Column) -> Column:
    """Distinct lower-cased path-like mentions: names with a suffix, or names with a slash."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_./-]+\.[A-Za-z0-9]+|[A-Za-z0-9_-]+/[A-Za-z0-9_./-]+)"))
    return F.array_distinct(F.transform(found, lambda p: F.lower(F.ltrim(p, F.lit("./")))))


def looks_like_secret(text: Column) -> Column:
    return text.rlike(SECRET_PATTERN)


def looks_like_diff(text: Column) -> Column:
    found = F.lit(False)
    for m in DIFF_MARKS:
        found = found | text.contains(m)
    return found


def looks_like_log(text: Column) -> Column:
    found = F.lit(False)
    for m in LOG_MARKS:
        found = found | F.lower(text).contains(m)
    return found


def words3(text: Column) -> Column:
    """Distinct lower-cased words of three characters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]{3,})")), F.lower))


def ancestors(path: Column) -> Column:
    """Every prefix of a slash-separated path, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def tier(path: Column, cutoff: int) -> Column:
    """The path itself, or its directory at ``cutoff`` segments when it is deeper."""
    return F.array_join(F.slice(F.split(path, "/"), 1, cutoff), "/")
