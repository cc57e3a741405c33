"""Queries of the ingest operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import ingest as I
from siftwell.operators import writeback as W
from siftwell.operators.scan import scanned
from siftwell.plans.catalog import Catalog
from siftwell.sources import tables as S

CATALOG = Catalog()
query = CATALOG.query

IGNORED = ["src1/", "*_99.txt"]
TOO_LARGE = 6000

#: Four spans in each document, from its id: nested, equal and apart ones, for the clean-up and gap queries.
SPANS_SQL = """spans AS (SELECT doc_id, CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line, kind, symbol FROM (
    SELECT doc_id, 2 + doc_id % 3 AS s, 9 + doc_id % 5 AS e, 'class' AS kind, 'A' AS symbol FROM documents
    UNION ALL SELECT doc_id, 3 + doc_id % 3, 6 + doc_id % 4, CASE WHEN doc_id % 2 = 0 THEN 'class' ELSE 'function' END, 'A' FROM documents
    UNION ALL SELECT doc_id, 3 + doc_id % 3, 6 + doc_id % 4, 'function', 'b' FROM documents
    UNION ALL SELECT doc_id, 12 + doc_id % 7, 15 + doc_id % 7, 'function', NULL FROM documents
    UNION ALL SELECT doc_id, 4 + doc_id % 5, 5 + doc_id % 6, 'class', 'A' FROM documents))"""


def spans(spark, sf_dir):
    i = F.col("doc_id")
    row = lambda s, e, kind, symbol: F.struct(s.alias("start_line"), e.alias("end_line"), kind.alias("kind"), symbol.alias("symbol"))
    own = F.lit("A")
    return S.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.inline(
            F.array(
                row(2 + i % 3, 9 + i % 5, F.lit("class"), own),
                row(3 + i % 3, 6 + i % 4, F.when(i % 2 == 0, "class").otherwise("function"), own),
                row(3 + i % 3, 6 + i % 4, F.lit("function"), F.lit("b")),
                row(12 + i % 7, 15 + i % 7, F.lit("function"), F.lit(None).cast("string")),
                row(4 + i % 5, 5 + i % 6, F.lit("class"), own),
            )
        ),
    )


@query("src_files", f"WITH {S.FILES_SQL} SELECT path, language, content_hash, size FROM files")
def src_files(spark, sf_dir):
    return S.files(spark, sf_dir).select("path", "language", "content_hash", "size")


@query(
    "ingest_skip_reason",
    f"""WITH {S.FILES_SQL}, judged AS (SELECT path, size, CASE WHEN regexp_matches(path, '(^|/)src1/|(^|/)[^/]*_99\\.txt(/|$)') THEN 'ignored'
      WHEN size > {TOO_LARGE} THEN 'too_large' WHEN contains(left(content, 8192), chr(0)) THEN 'binary' END AS reason FROM files)
      SELECT path, size, coalesce(reason, 'indexed') AS reason FROM judged""",
)
def ingest_skip_reason(spark, sf_dir):
    f = S.files(spark, sf_dir)
    reason = I.skip_reason(F.col("path"), F.col("size"), I.ignore_regex(IGNORED), TOO_LARGE, F.col("content").cast("binary"))
    return f.select("path", "size", F.coalesce(reason, F.lit("indexed")).alias("reason"))


@query(
    "index_status",
    f"""WITH {S.chunks_sql()}, per AS (SELECT path, count(*) AS n, count(CASE WHEN symbol <> '' THEN 1 END) AS s FROM chunks GROUP BY path)
      SELECT count(*) AS files, count(CASE WHEN size > {TOO_LARGE} THEN 1 END) AS skipped, CAST(coalesce(sum(CASE WHEN size <= {TOO_LARGE} THEN n END), 0) AS BIGINT) AS chunks,
        CAST(coalesce(sum(CASE WHEN size <= {TOO_LARGE} THEN s END), 0) AS BIGINT) AS symbols FROM files JOIN per USING (path)""",
)
def index_status(spark, sf_dir):
    # chunk numbers come from each row's own lines, so all counters are sums of one pass
    f = S.files(spark, sf_dir)
    def counted(lines):
        starts = F.sequence(F.lit(1), F.size(lines), F.lit(S.WINDOW))
        named = F.filter(starts, lambda k: F.exists(F.slice(lines, k, F.lit(S.WINDOW)), lambda line: line.rlike(T.WORD)))
        return F.struct(F.size(starts).alias("n"), F.size(named).alias("named"))

    f = f.select("size", T.let(F.split("content", "\n"), counted).alias("x"))
    n, named = F.col("x.n"), F.col("x.named")
    kept = F.col("size") <= TOO_LARGE
    return f.agg(
        F.count("*").alias("files"),
        F.count_if(~kept).alias("skipped"),
        F.coalesce(F.sum(F.when(kept, n)), F.lit(0)).cast("long").alias("chunks"),
        F.coalesce(F.sum(F.when(kept, named)), F.lit(0)).cast("long").alias("symbols"),
    )


@query(
    "fallback_chunks",
    f"""WITH {S.chunks_sql(20)}, n AS (SELECT path, content, len(string_split(content, chr(10))) AS n FROM files)
      SELECT path, CAST(1 AS BIGINT) AS start_line, CAST(n AS BIGINT) AS end_line, 'module' AS kind, regexp_replace(split_part(path, '/', 3), '\\.txt$', '') AS symbol, sha256(content) AS hash FROM n
      UNION ALL SELECT c.path, start_line, end_line, 'text', NULL, chunk_hash FROM chunks c JOIN n USING (path) WHERE n > 40""",
)
def fallback_chunks(spark, sf_dir):
    rows = I.whole_file_chunks(S.files(spark, sf_dir).select("path", "content"), 20)
    return rows.select("path", "start_line", "end_line", "kind", "symbol", F.sha2("content", 256).alias("hash"))


@query("index_skipped", f"WITH {S.FILES_SQL} SELECT path, size FROM files WHERE size > {TOO_LARGE} ORDER BY path LIMIT 200")
def index_skipped(spark, sf_dir):
    return S.files(spark, sf_dir).where(F.col("size") > TOO_LARGE).select("path", "size").orderBy("path").limit(200)


@query(
    "source_view_cap",
    f"WITH {S.FILES_SQL} SELECT path, sha256(left(content, 4096)) AS shown_hash, CAST(least(length(content), 4096) AS BIGINT) AS shown, length(content) > 4096 AS truncated FROM files",
)
def source_view_cap(spark, sf_dir):
    shown = F.substring("content", 1, 4096)
    return S.files(spark, sf_dir).select(
        "path", F.sha2(shown, 256).alias("shown_hash"), F.length(shown).cast("long").alias("shown"), (F.length("content") > 4096).alias("truncated")
    )


_SUFFIXES = ["py", "TSX", "js", "md", "rs", "hpp", "C", "txt", "go", "mjs"]


@query(
    "lang_from_suffix",
    """WITH p AS (SELECT page_id, 'a/b' || page_id || '.' || list_extract(['py','TSX','js','md','rs','hpp','C','txt','go','mjs'], CAST(page_id % 10 + 1 AS INT)) AS path FROM pages)
      SELECT page_id, path, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.tsx' THEN 'tsx' WHEN '.js' THEN 'javascript' WHEN '.mjs' THEN 'javascript'
        WHEN '.rs' THEN 'rust' WHEN '.hpp' THEN 'cpp' WHEN '.c' THEN 'c' WHEN '.go' THEN 'go' END AS language FROM p""",
)
def lang_from_suffix(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("page_id") % 10 + 1).cast("int"))
    p = S.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("a/b"), "page_id", F.lit("."), suffix).alias("path"))
    return p.withColumn("language", T.language_of(F.col("path")))


@query(
    "content_hash_dedup",
    f"WITH {S.FILES_SQL} SELECT content_hash, count(*) AS copies, min(path) AS first_path, any_value(size) AS size FROM files GROUP BY content_hash",
)
def content_hash_dedup(spark, sf_dir):
    return S.files(spark, sf_dir).groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"), F.first("size").alias("size"))


@query("chunk_windows", f"WITH {S.chunks_sql()} SELECT path, start_line, end_line, chunk_hash FROM chunks")
def chunk_windows(spark, sf_dir):
    return S.chunks(spark, sf_dir).select("path", "start_line", "end_line", "chunk_hash")


@query(
    "chunk_dedupe",
    f"""WITH RECURSIVE {SPANS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line, -end_line, kind, symbol) AS k FROM spans),
      fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(s BIGINT, e BIGINT, kind VARCHAR, symbol VARCHAR)[]) AS kept FROM documents
        UNION ALL SELECT p.doc_id, p.k, CASE WHEN len(list_filter(f.kept, lambda x: (x.s = p.start_line AND x.e = p.end_line)
            OR (x.s <= p.start_line AND x.e >= p.end_line AND x.kind = p.kind AND x.symbol IS NOT DISTINCT FROM p.symbol))) > 0 THEN f.kept
          ELSE list_append(f.kept, struct_pack(s := p.start_line, e := p.end_line, kind := p.kind, symbol := p.symbol)) END
        FROM fold f JOIN placed p ON p.doc_id = f.doc_id AND p.k = f.k + 1),
      ends AS (SELECT doc_id, unnest(kept) AS x FROM fold WHERE k = 5)
      SELECT doc_id, x.s AS start_line, x.e AS end_line, x.kind AS kind, x.symbol AS symbol FROM ends""",
)
def chunk_dedupe(spark, sf_dir):
    return I.drop_nested_chunks(spans(spark, sf_dir), "doc_id")


@query(
    "gap_intervals",
    f"""WITH {SPANS_SQL}, totals AS (SELECT doc_id, CAST(20 + doc_id % 4 AS BIGINT) AS total FROM documents),
      seen AS (SELECT *, coalesce(max(end_line) OVER (PARTITION BY doc_id ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM spans)
      SELECT doc_id, covered + 1 AS gap_start, start_line - 1 AS gap_end FROM seen WHERE start_line > covered + 1
      UNION ALL SELECT doc_id, max(end_line) + 1, any_value(total) FROM spans JOIN totals USING (doc_id) GROUP BY doc_id HAVING max(end_line) < any_value(total)""",
)
def gap_intervals(spark, sf_dir):
    totals = S.table(spark, sf_dir, "documents").select("doc_id", (20 + F.col("doc_id") % 4).alias("total"))
    return I.uncovered_ranges(spans(spark, sf_dir), totals, "doc_id")


@query(
    "symbol_defs",
    f"""WITH {S.chunks_sql(20)} SELECT path, symbol AS name, start_line AS line, 'local ' || path || '#' || symbol || ':' || start_line AS symbol_id,
      left(split_part(content, chr(10), 1), 200) AS signature FROM chunks WHERE symbol <> ''""",
)
def symbol_defs(spark, sf_dir):
    kind = F.when(F.col("start_line") == 1, "module").otherwise("function")
    return I.definitions(S.chunks(spark, sf_dir, 20).withColumn("kind", kind))


@query(
    "import_edges",
    """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1)) AS module FROM pages""",
)
def import_edges(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]+)"'), 1)
    # distinct inside the row first: no shuffle is needed, as page ids are unique rows
    return S.table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(found)).alias("module")).distinct()


_KNOWN_SQL = """known AS (SELECT 'lib/pkg' || p_partkey % 40 || '/m' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '/__init__.py' END AS path FROM part),
  imports AS (SELECT DISTINCT 'lib/pkg' || l_partkey % 40 || '/main' || l_suppkey || '.py' AS src, CASE l_linenumber % 3 WHEN 0 THEN './m' || l_partkey WHEN 1 THEN 'pkg' || l_partkey % 40 || '.m' || l_partkey
    ELSE 'lib.pkg' || l_partkey % 40 || '.m' || l_partkey END AS module FROM lineitem)"""


@query(
    "import_resolve",
    f"""WITH {_KNOWN_SQL}, tries AS (
        SELECT src, module, r AS rank, regexp_replace(src, '/[^/]*$', '') || '/' || substr(module, 3) || e AS name, false AS tail FROM imports,
          (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.py'), (6, '/index.ts'), (7, '/index.js')) v(r, e) WHERE starts_with(module, '.')
        UNION ALL SELECT src, module, r, replace(module, '.', '/') || e, t FROM imports, (VALUES (0, '.py', false), (1, '.py', true), (2, '/__init__.py', false), (3, '/__init__.py', true)) v(r, e, t) WHERE NOT starts_with(module, '.')),
      names AS (SELECT path AS name, false AS tail, path FROM known UNION ALL SELECT substr(path, 5), true, path FROM known UNION ALL SELECT regexp_replace(path, '^lib/[^/]*/', ''), true, path FROM known
        UNION ALL SELECT '__init__.py', true, path FROM known WHERE path LIKE '%/__init__.py'),
      best AS (SELECT src, module, rank, min(path) AS path FROM tries JOIN names USING (name, tail) GROUP BY ALL),
      first AS (SELECT src, module, arg_min(path, rank) AS dst FROM best GROUP BY ALL)
      SELECT src, module, coalesce(dst, '') AS dst FROM imports LEFT JOIN first USING (src, module)""",
)
def import_resolve(spark, sf_dir):
    k = F.col("p_partkey")
    known = S.table(spark, sf_dir, "part").select(
        F.concat(F.lit("lib/pkg"), k % 40, F.lit("/m"), k, F.when(k % 3 == 0, ".py").when(k % 3 == 1, ".ts").otherwise("/__init__.py")).alias("path")
    )
    p, n = F.col("l_partkey"), F.col("l_linenumber") % 3
    dotted = F.concat(F.lit("pkg"), p % 40, F.lit(".m"), p)
    imports = (
        S.table(spark, sf_dir, "lineitem")
        .select(
            F.concat(F.lit("lib/pkg"), p % 40, F.lit("/main"), "l_suppkey", F.lit(".py")).alias("src"),
            F.when(n == 0, F.concat(F.lit("./m"), p)).when(n == 1, dotted).otherwise(F.concat(F.lit("lib."), dotted)).alias("module"),
        )
        .distinct()
    )
    return I.resolve_imports(imports, known)


_MD_SQL = """md AS (SELECT conv_id, 'preamble' || chr(10) || string_agg('### ' || CASE WHEN turn % 3 = 2 THEN '' ELSE 'R-00' || turn || ' — ' END || 'Need ' || role || chr(10)
  || CASE WHEN turn % 2 = 0 THEN '<!-- req status=in-progress files=a.py -->' || chr(10) ELSE '' END || chr(10) || text, chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY conv_id)"""


@query(
    "md_blocks",
    f"""WITH {_MD_SQL}, l AS (SELECT conv_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM md),
      b AS (SELECT *, sum(CASE WHEN line LIKE '### %' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS block FROM l),
      g AS (SELECT conv_id, CAST(block AS BIGINT) AS block, min(pos) AS place, any_value(CASE WHEN line LIKE '### %' THEN substr(line, 5) END) AS head,
        any_value(CASE WHEN line LIKE '<!-- req %' THEN regexp_extract(line, 'status=(\\S+)', 1) END) AS status,
        trim(string_agg(CASE WHEN line NOT LIKE '### %' AND line NOT LIKE '<!-- req %' THEN line END, chr(10) ORDER BY pos), ' ' || chr(10)) AS prose
        FROM b WHERE block > 0 GROUP BY conv_id, block)
      SELECT conv_id, block, nullif(regexp_extract(head, '^([A-Z]+-\\d+) — ', 1), '') AS req_key, regexp_replace(head, '^[A-Z]+-\\d+ — ', '') AS title,
        coalesce(status, 'not-started') AS status, prose, CAST(place + 1 AS BIGINT) AS heading_line FROM g""",
)
def md_blocks(spark, sf_dir):
    t = F.col("turn")
    part = F.concat(
        F.lit("### "),
        F.when(t % 3 == 2, "").otherwise(F.concat(F.lit("R-00"), t, F.lit(" — "))),
        F.lit("Need "),
        "role",
        F.lit("\n"),
        F.when(t % 2 == 0, "<!-- req status=in-progress files=a.py -->\n").otherwise(""),
        F.lit("\n"),
        "text",
    )
    rows = S.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", part.alias("p")))).alias("p"))
    files = rows.select("conv_id", F.concat(F.lit("preamble\n"), F.array_join("p.p", "\n")).alias("body"))
    return I.markdown_blocks(files, "conv_id", "body")


_VERSIONS_SQL = f"""{S.FILES_SQL}, stored AS (SELECT path, CASE WHEN doc_id % 9 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM files WHERE doc_id % 10 <> 3
  UNION ALL SELECT 'gone/doc_' || doc_id || '.txt', 'x' FROM documents WHERE doc_id % 50 = 7)"""


def _stored(f):
    old = F.when(F.col("doc_id") % 9 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash")
    kept = f.where("doc_id % 10 <> 3").select("path", old)
    return kept.unionByName(f.where("doc_id % 50 = 7").select(F.concat(F.lit("gone/doc_"), "doc_id", F.lit(".txt")).alias("path"), F.lit("x").alias("content_hash")))


@query(
    "dirty_paths",
    f"""WITH {_VERSIONS_SQL} SELECT path FROM files LEFT JOIN stored s USING (path) WHERE s.content_hash IS DISTINCT FROM files.content_hash
      UNION SELECT path FROM files WHERE doc_id % 25 = 4""",
)
def dirty_paths(spark, sf_dir):
    f = S.files(spark, sf_dir)
    return I.changed_paths(f.select("path", "content_hash"), _stored(f), f.where("doc_id % 25 = 4").select("path"))


@query("deleted_paths", f"WITH {_VERSIONS_SQL} SELECT path FROM stored EXCEPT SELECT path FROM files WHERE size <= {TOO_LARGE}")
def deleted_paths(spark, sf_dir):
    f = S.files(spark, sf_dir)
    return _stored(f).select("path").distinct().join(f.where(F.col("size") <= TOO_LARGE), "path", "left_anti")


@query(
    "stale_flag",
    f"WITH {_VERSIONS_SQL} SELECT s.path, coalesce(f.content_hash <> s.content_hash, true) AS stale FROM stored s LEFT JOIN files f USING (path)",
)
def stale_flag(spark, sf_dir):
    f = S.files(spark, sf_dir)
    now = f.select("path", F.col("content_hash").alias("now"))
    return _stored(f).join(now, "path", "left").select("path", F.coalesce(F.col("now") != F.col("content_hash"), F.lit(True)).alias("stale"))


@query("distinct_chunks", f"WITH {S.chunks_sql(20)} SELECT count(*) AS chunks, count(DISTINCT chunk_hash) AS distinct_hashes FROM chunks")
def distinct_chunks(spark, sf_dir):
    per = S.chunks(spark, sf_dir, 20).groupBy("chunk_hash").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("distinct_hashes"))


@query(
    "embed_pending",
    f"WITH {S.chunks_sql()} SELECT DISTINCT chunk_hash, content FROM chunks WHERE chunk_hash NOT IN (SELECT chunk_hash FROM chunks JOIN embeddings ON vec_id = doc_id WHERE start_line = 1 AND doc_id % 3 = 0)",
)
def embed_pending(spark, sf_dir):
    c = S.chunks(spark, sf_dir)
    done = c.where("start_line = 1 AND doc_id % 3 = 0").join(S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return c.select("chunk_hash", "content").dropDuplicates(["chunk_hash"]).join(done.select("chunk_hash"), "chunk_hash", "left_anti")


@query(
    "text_hygiene",
    """SELECT doc_id, regexp_matches(text, '(?i)(password|secret|api[_-]?key|token|bearer|private[_-]?key)\\s*[:=]') AS secret,
      contains(text, 'diff --git') OR contains(text, chr(10) || '+++ ') OR contains(text, chr(10) || '--- ') OR contains(text, chr(10) || '@@ ') AS diff,
      contains(lower(text), 'traceback (most recent') OR contains(lower(text), 'stdout') OR contains(lower(text), 'stderr') AS log FROM documents""",
)
def text_hygiene(spark, sf_dir):
    t = F.col("text")
    return S.table(spark, sf_dir, "documents").select("doc_id", T.looks_like_secret(t).alias("secret"), T.looks_like_diff(t).alias("diff"), T.looks_like_log(t).alias("log"))


#: Ignore files of a tree of lang/source/doc_n.txt: (folder, text).
_IGNORE_FILES = [("", "*_77.txt\n"), ("en", "src1/\ndoc_*9.txt\n!doc_19.txt\n"), ("en/src2", "doc_?.txt\n!doc_4.txt\n"), ("fr", "/src0\n"), ("de", "# but\n!*_77.txt\n"), ("en/src1", "!*\n")]


@query(
    "tree_ignore",
    f"""WITH {S.FILES_SQL}, p AS (SELECT path, size, split_part(path, '/', 1) AS lang, split_part(path, '/', 2) AS source, split_part(path, '/', 3) AS base FROM files),
      d AS (SELECT *, (lang = 'en' AND source = 'src1') OR (lang = 'fr' AND source = 'src0') AS pruned,
        CASE WHEN lang = 'en' AND source = 'src2' AND base = 'doc_4.txt' THEN false WHEN lang = 'en' AND source = 'src2' AND regexp_matches(base, '^doc_[^/]\\.txt$') THEN true
          WHEN lang = 'en' AND base = 'doc_19.txt' THEN false WHEN lang = 'en' AND regexp_matches(base, '^doc_[^/]*9\\.txt$') THEN true WHEN lang = 'de' AND regexp_matches(base, '_77\\.txt$') THEN false
          WHEN regexp_matches(base, '_77\\.txt$') THEN true ELSE false END AS own FROM p)
      SELECT path, CASE WHEN pruned OR own THEN 'ignored' WHEN size > {TOO_LARGE} THEN 'too_large' END AS skip_reason FROM d""",
)
def tree_ignore(spark, sf_dir):
    paths = S.files(spark, sf_dir).select("path", "size")
    return scanned(paths, spark.createDataFrame(_IGNORE_FILES, "folder string, text string"), [], TOO_LARGE).select("path", "skip_reason")


_REQ_SQL = """req AS (SELECT 'n' || c_nationkey AS file, 'R-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS req_key, c_name AS title, c_custkey AS k,
    CASE c_custkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'blocked' ELSE 'not-started' END AS status FROM customer)"""


@query(
    "requirements_written",
    f"""WITH {_REQ_SQL}, own AS (SELECT file, string_agg('### ' || req_key || ' — ' || title || CASE WHEN k % 4 = 1 THEN CASE WHEN status <> 'not-started' THEN chr(10) || '<!-- req status=' || status || ' -->' ELSE '' END
        ELSE chr(10) || '<!-- req status=' || status || ' files=a.py -->' END || chr(10) || 'Prose  of ' || k || ' ', chr(10) || chr(10) ORDER BY req_key) AS body FROM req WHERE k % 5 <> 0 GROUP BY file),
      more AS (SELECT file, string_agg(chr(10) || chr(10) || '### ' || req_key || ' — ' || title || chr(10) || '<!-- req status=' || status || ' -->' || chr(10) || chr(10) || 'Written by ' || k, '' ORDER BY req_key) AS body FROM req WHERE k % 5 = 0 AND k % 10 <> 0 GROUP BY file)
      SELECT f.file, '# Requirements' || chr(10) || chr(10) || coalesce(own.body, '') || coalesce(more.body, '') || chr(10) AS content FROM (SELECT DISTINCT file FROM req) f LEFT JOIN own USING (file) LEFT JOIN more USING (file)""",
)
def requirements_written(spark, sf_dir):
    """A requirements file for each nation, brought in line with the store; some requirements are not in it yet, some of these are archived."""
    k = F.col("c_custkey")
    store = S.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("n"), "c_nationkey").alias("file"), F.concat(F.lit("R-"), F.lpad(k.cast("string"), 6, "0")).alias("req_key"), F.col("c_name").alias("title"), k.alias("k"),
        F.when(k % 3 == 0, "done").when(k % 3 == 1, "blocked").otherwise("not-started").alias("status"), F.concat(F.lit("Written by "), k).alias("prose"), (k % 10 == 0).alias("archived"),
    )
    token = F.when(F.col("k") % 4 == 1, "").otherwise(F.concat(F.lit("\n<!-- req status="), F.when(F.col("k") % 2 == 0, "done").otherwise("in-progress"), F.lit(" files=a.py -->")))
    block = F.concat(W.heading_line(F.col("req_key"), F.col("title")), token, F.lit("\nProse  of "), "k", F.lit(" "))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") % 5 != 0, F.struct("req_key", block.alias("block"))))), lambda x: x["block"]), "\n\n")
    files = store.groupBy("file").agg(F.concat(F.lit("# Requirements\n\n"), body, F.lit("\n")).alias("content"))
    return W.written(files, store.drop("k")).select("file", "content")


@query(
    "requirement_duplicates",
    "SELECT 'o' || o_custkey % 50 AS file, 'R-' || lpad(CAST(o_orderkey % 997 AS VARCHAR), 3, '0') AS req_key, count(*) AS times FROM orders GROUP BY ALL HAVING count(*) > 1",
)
def requirement_duplicates(spark, sf_dir):
    """Keys that a requirements file has more than once."""
    key = F.concat(F.lit("R-"), F.lpad((F.col("o_orderkey") % 997).cast("string"), 3, "0"))
    rows = S.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_custkey") % 50).alias("file"), W.heading_line(key, F.col("o_orderpriority")).alias("line"))
    files = rows.groupBy("file").agg(F.array_join(F.collect_list("line"), "\n").alias("content"))
    return W.duplicate_keys(W.blocks(W.file_lines(files)))
