"""Ingest: line windows, chunk clean-up, gaps, definitions, imports, incremental differences, Markdown blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import let

MAX_BYTES = 1_000_000
SIGNATURE_CHARS = 200

#: Paths that are never indexed.
DEFAULT_IGNORE = (
    ".git/",
    ".hg/",
    ".svn/",
    "node_modules/",
    "vendor/",
    "venv/",
    ".venv/",
    "dist/",
    "build/",
    "target/",
    "__pycache__/",
    "*.pyc",
    ".mypy_cache/",
    ".ruff_cache/",
    ".pytest_cache/",
    ".env",
    ".env.*",
    "*.pem",
    "*.key",
    "*.p12",
    "*.pfx",
    "id_rsa",
    "id_rsa.*",
    "secrets/",
    ".ssh/",
    "*.min.js",
    "*.min.css",
    "package-lock.json",
    "pnpm-lock.yaml",
    "uv.lock",
    "Cargo.lock",
    "poetry.lock",
    "*.woff",
    "*.woff2",
    "*.png",
    "*.jpg",
    "*.jpeg",
    "*.gif",
    "*.webp",
    "*.pdf",
    "*.zip",
    "*.gz",
    "*.tgz",
    "*.so",
    "*.dylib",
    "*.dll",
    "*.exe",
    "*.bin",
)


def ignore_regex(patterns: tuple[str, ...] | list[str]) -> str:
    """One regular expression for all patterns: ``name/`` is a directory anywhere, ``*`` stays inside a segment."""
    parts = []
    for p in patterns:
        body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c == "/" else "\\" + c for c in p.strip("/"))
        root = "^" if p.startswith("/") else "(^|/)"
        parts.append(f"{root}{body}" + ("/" if p.endswith("/") else "(/|$)"))
    return "|".join(parts) or "$^"


def skip_reason(path: Column, size: Column, ignore: str, max_bytes: int = MAX_BYTES, content: Column | None = None) -> Column:
    """Why a file isn't indexed, or null: ``ignored``, ``too_large`` or ``binary`` (a NUL early on, or no valid UTF-8)."""
    reason = F.when(path.rlike(ignore), "ignored").when(size > max_bytes, "too_large")
    return reason if content is None else F.coalesce(reason, binary_reason(content))


def binary_reason(content: Column) -> Column:
    """``binary`` for a content with a NUL early on, or no valid UTF-8; else null."""
    early = F.instr(F.substring(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"), 1, 8192), "\0") > 0
    return F.when(early | ~F.is_valid_utf8(content), "binary")


def line_windows(files: DataFrame, window: int, content: str = "content", step: int | None = None) -> DataFrame:
    """Rows of ``files`` cut into windows of ``window`` lines (1-based start_line and end_line), every ``step`` lines.

    Done with array functions inside each row, so nothing is shuffled.
    """
    step = step or window

    def cut(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1 - (window - step), F.lit(0)), F.lit(step))
        return F.transform(
            starts,
            lambda s: F.struct(
                (s + 1).cast("long").alias("start_line"),
                F.least(s + window, F.size(lines)).cast("long").alias("end_line"),
                F.array_join(F.slice(lines, s + 1, F.lit(window)), "\n").alias(content),
            ),
        )

    others = [c for c in files.columns if c != content]
    # the lines are split once for all windows of a file
    return files.select(*others, F.inline(let(F.split(content, "\n"), cut)))


def whole_file_chunks(files: DataFrame, window: int) -> DataFrame:
    """Chunks (path, start_line, end_line, kind, symbol, content) of files in which no definition was found.

    Each is one ``module`` chunk named like the file; one of more than two windows of lines is cut into windows as well.
    """

    def cut(lines: Column) -> Column:
        n = F.size(lines)
        name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(.)\.[^.]*$", "$1")
        piece = lambda start, end, kind, symbol: F.struct(
            start.cast("long").alias("start_line"), end.cast("long").alias("end_line"), F.lit(kind).alias("kind"), symbol.cast("string").alias("symbol"),
            F.array_join(F.slice(lines, start, end - start + 1), "\n").alias("content"),
        )
        windows = F.transform(F.sequence(F.lit(1), n, F.lit(window)), lambda s: piece(s, F.least(s + (window - 1), n), "text", F.lit(None)))
        whole = F.array(piece(F.lit(1), n, "module", name))
        return F.when(n > 2 * window, F.concat(whole, windows)).otherwise(whole)

    return files.select("path", F.inline(let(F.split("content", "\n"), cut)))


def drop_nested_chunks(chunks: DataFrame, by: str) -> DataFrame:
    """Chunks without those that repeat the span of a kept one, or lie inside a kept one of the same symbol and kind.

    Whether a chunk stays depends on the chunks kept before it (start, widest first, kind), so each file's chunks
    are folded in that order. A file's chunks are bounded by its lines.
    """
    fields = ["start_line", "end_line", "kind", "symbol"]
    key = F.struct("start_line", (-F.col("end_line")).alias("widest"), "kind", "end_line", "symbol")
    grouped = chunks.groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("all"))
    kept_type = "array<struct<start_line:bigint,end_line:bigint,kind:string,symbol:string>>"

    def step(kept: Column, c: Column) -> Column:
        same_span = lambda k: (k.start_line == c.start_line) & (k.end_line == c.end_line)
        inside = lambda k: (
            (k.start_line <= c.start_line) & (k.end_line >= c.end_line) & k.symbol.eqNullSafe(c.symbol) & (k.kind == c.kind)
        )
        repeated = F.exists(kept, lambda k: same_span(k) | inside(k))
        own = F.struct(*[c[f].alias(f) for f in fields])
        return F.when(repeated, kept).otherwise(F.concat(kept, F.array(own)))

    folded = F.aggregate("all", F.array().cast(kept_type), step)
    return grouped.select(by, F.inline(folded))


def uncovered_ranges(spans: DataFrame, totals: DataFrame, by: str) -> DataFrame:
    """(by, gap_start, gap_end): lines of 1..total that no span covers. ``totals``: (by, total)."""
    order = Window.partitionBy(by).orderBy("start_line", "end_line")
    before = F.coalesce(F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = spans.withColumn("covered", before).where(F.col("start_line") > F.col("covered") + 1)
    inner = inner.select(by, (F.col("covered") + 1).alias("gap_start"), (F.col("start_line") - 1).alias("gap_end"))
    reach = spans.groupBy(by).agg(F.max("end_line").alias("reach"))
    tail = totals.join(reach, by, "left").withColumn("reach", F.coalesce("reach", F.lit(0))).where("reach < total")
    return inner.unionByName(tail.select(by, (F.col("reach") + 1).alias("gap_start"), F.col("total").alias("gap_end")))


def definitions(chunks: DataFrame) -> DataFrame:
    """(path, name, line, symbol_id, signature) of chunks with a symbol and a defining kind."""
    named = chunks.where(F.col("symbol").isNotNull() & (F.col("symbol") != "") & F.col("kind").isin("function", "class", "module"))
    return named.select(
        "path",
        F.col("symbol").alias("name"),
        F.col("start_line").alias("line"),
        F.concat(F.lit("local "), "path", F.lit("#"), "symbol", F.lit(":"), "start_line").alias("symbol_id"),
        F.substring(F.split_part("content", F.lit("\n"), F.lit(1)), 1, SIGNATURE_CHARS).alias("signature"),
    )


def resolve_imports(imports: DataFrame, known: DataFrame) -> DataFrame:
    """``imports`` (src, module) with ``dst``: the known path a module stands for, or ''.

    Relative modules try suffixes in a fixed order beside the importing file; dotted ones try ``.py`` and
    ``/__init__.py`` as a whole path, then as the end of one (the least such path). Each candidate is an equality join.
    What a module stands for is looked up once for all files that name it alike: only its distinct bases are tried.
    """
    relative = F.col("module").startswith(".")
    folder = F.array_join(F.slice(F.split("src", "/"), F.lit(1), F.greatest(F.size(F.split("src", "/")) - 1, F.lit(0))), "/")
    beside = F.ltrim(F.concat_ws("/", folder, F.regexp_replace("module", r"^(\./)+", "")), F.lit("./"))
    dotted = F.replace("module", F.lit("."), F.lit("/"))
    ends = ["", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.js"]
    own = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat("_base", F.lit(e)).alias("name"), F.lit(False).alias("tail")) for i, e in enumerate(ends)])
    pairs = [(e, tail) for e in (".py", "/__init__.py") for tail in (False, True)]
    other = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat("_base", F.lit(e)).alias("name"), F.lit(t).alias("tail")) for i, (e, t) in enumerate(pairs)])
    asked = imports.withColumns({"_relative": F.coalesce(relative, F.lit(False)), "_base": F.when(relative, beside).otherwise(dotted)})
    bases = asked.select("_relative", "_base").distinct()
    tries = bases.select("_relative", "_base", F.inline(F.when(F.col("_relative"), own).otherwise(other)))
    whole = known.select(F.col("path").alias("name"), F.col("path").alias("found"), F.lit(False).alias("tail"))
    parts = F.split("path", "/")
    endings = known.select(
        F.explode(let(parts, lambda p: F.transform(F.sequence(F.lit(2), F.greatest(F.size(p), F.lit(2))), lambda i: F.array_join(F.slice(p, i, F.size(p)), "/")))).alias("name"),
        F.col("path").alias("found"),
        F.lit(True).alias("tail"),
    )
    names = whole.unionByName(endings.where("name <> ''")).groupBy("name", "tail").agg(F.min("found").alias("found"))
    best = tries.join(names, ["name", "tail"]).groupBy("_relative", "_base").agg(F.min(F.struct("rank", "found")).alias("best"))
    return asked.join(best, ["_relative", "_base"], "left").select("src", "module", F.coalesce("best.found", F.lit("")).alias("dst"))


def changed_paths(now: DataFrame, before: DataFrame, reported: DataFrame) -> DataFrame:
    """Paths to index anew: reported as changed, new, or with another content hash. (path, content_hash) twice, and (path)."""
    was = before.select("path", F.col("content_hash").alias("was"))
    differs = now.join(was, "path", "left").where(~F.col("was").eqNullSafe(F.col("content_hash"))).select("path")
    return differs.unionByName(reported.join(now.select("path"), "path", "left_semi")).distinct()


def markdown_blocks(files: DataFrame, by: str, content: str) -> DataFrame:
    """(by, block, req_key, title, status, prose, heading_line): blocks under ``###`` headings, with their managed line.

    A block's number is the running count of headings in its file; lines before the first heading are left out.
    """
    lines = files.select(by, F.posexplode(F.split(content, "\n")).alias("pos", "line"))
    heading = F.col("line").rlike(r"^###\s+")
    order = Window.partitionBy(by).orderBy("pos")
    lines = lines.withColumns({"heading": heading, "block": F.sum(heading.cast("long")).over(order)}).where("block > 0")
    managed = F.col("line").rlike(r"^\s*<!--\s*req\s.*-->\s*$") & ~F.col("heading")
    line = F.struct("pos", "line", "heading", managed.alias("managed"))
    blocks = lines.groupBy(by, "block").agg(F.array_sort(F.collect_list(line)).alias("l"))
    head = F.regexp_replace(F.element_at("l", 1).line, r"^###\s+", "")
    body = F.slice("l", F.lit(2), F.size("l"))
    written = F.filter(body, lambda x: F.trim(x.line) != "")
    token = F.when(F.element_at(written, 1).managed, F.element_at(written, 1))
    fields = F.str_to_map(F.regexp_extract(token.line, r"<!--\s*req\s+(.*?)\s*-->", 1), F.lit(" "), F.lit("="))
    prose = F.filter(body, lambda x: token.pos.isNull() | (x.pos != token.pos))
    key = F.regexp_extract(head, r"^([A-Z]+-\d+)\s+—\s+", 1)
    return blocks.select(
        by,
        "block",
        F.nullif(key, F.lit("")).alias("req_key"),
        F.trim(F.regexp_replace(head, r"^[A-Z]+-\d+\s+—\s+", "")).alias("title"),
        F.coalesce(fields["status"], F.lit("not-started")).alias("status"),
        F.btrim(F.array_join(F.transform(prose, lambda x: x.line), "\n"), F.lit(" \n")).alias("prose"),
        (F.element_at("l", 1).pos + 1).cast("long").alias("heading_line"),
    )
