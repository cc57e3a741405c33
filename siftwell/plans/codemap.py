"""Queries of the map, the guide and their overlays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.similarity import close_names
from siftwell.operators import codemap as M
from siftwell.operators import guide as Q
from siftwell.plans.catalog import Catalog
from siftwell.sources import tables as S

CATALOG = Catalog()
query = CATALOG.query
_G = f"WITH {S.GRAPH_SQL}"


def _tier(path: str, n: int) -> str:
    return f"array_to_string(list_slice(string_split({path}, '/'), 1, {n}), '/')"


@query(
    "codemap_nodes",
    f"{_G} SELECT {_tier('path', 2)} AS node, bool_or(path <> {_tier('path', 2)}) AS is_dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS size, CAST(sum(loc) AS BIGINT) AS loc FROM gfiles GROUP BY 1",
)
def codemap_nodes(spark, sf_dir):
    return M.nodes(S.graph_files(spark, sf_dir), depth=2)


@query(
    "codemap_lang",
    f"{_G}, n AS (SELECT {_tier('path', 1)} AS node, language, count(*) AS n, min(path) AS p FROM gfiles GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, p) AS k FROM n) SELECT node, language FROM r WHERE k = 1",
)
def codemap_lang(spark, sf_dir):
    return M.node_language(S.graph_files(spark, sf_dir))


_EDGES2 = f"""e2 AS (SELECT {_tier('src', 2)} AS source, {_tier('dst', 2)} AS target, kind, count(*) AS weight FROM gedges WHERE dst <> '' AND {_tier('src', 2)} <> {_tier('dst', 2)} GROUP BY 1, 2, 3)"""


@query("codemap_edges", f"{_G}, {_EDGES2} SELECT * FROM e2")
def codemap_edges(spark, sf_dir):
    return M.node_edges(S.graph_edges(spark, sf_dir), depth=2)


@query(
    "codemap_fan",
    f"{_G}, {_EDGES2}, p AS (SELECT DISTINCT source, target FROM e2), a AS (SELECT source AS node, 0 AS i, 1 AS o FROM p UNION ALL SELECT target, 1, 0 FROM p) SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM a GROUP BY node",
)
def codemap_fan(spark, sf_dir):
    return M.fan(M.node_edges(S.graph_edges(spark, sf_dir), depth=2))


@query(
    "codemap_scoped",
    f"""{_G}, p AS (SELECT CASE WHEN starts_with(src, 'r1/') THEN {_tier('src', 3)} ELSE {_tier('src', 2)} END AS source, CASE WHEN starts_with(dst, 'r1/') THEN {_tier('dst', 3)} ELSE {_tier('dst', 2)} END AS target, kind
      FROM gedges WHERE dst <> '' AND (starts_with(src, 'r1/') OR starts_with(dst, 'r1/'))) SELECT source, target, kind, count(*) AS weight FROM p WHERE source <> target GROUP BY ALL""",
)
def codemap_scoped(spark, sf_dir):
    return M.node_edges(S.graph_edges(spark, sf_dir), scope="r1", depth=2)


@query(
    "codemap_external",
    f"""{_G}, p AS (SELECT {_tier('src', 1)} AS source, CASE WHEN dst = '' THEN 'ext:' || module ELSE {_tier('dst', 1)} END AS target, kind FROM gedges) SELECT source, target, kind, count(*) AS weight FROM p WHERE source <> target GROUP BY ALL""",
)
def codemap_external(spark, sf_dir):
    return M.node_edges(S.graph_edges(spark, sf_dir), depth=1, external=True)


@query(
    "file_deps",
    f"""{_G} SELECT 'dependency' AS direction, dst AS path FROM gedges WHERE src = 'r0/n0/c' || (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 0) AND dst <> ''
      UNION SELECT 'dependent', src FROM gedges WHERE dst = (SELECT min(dst) FROM gedges WHERE dst <> '')""",
)
def file_deps(spark, sf_dir):
    e = S.graph_edges(spark, sf_dir).where("dst <> ''")
    first = S.table(spark, sf_dir, "customer").where("c_nationkey = 0").agg(F.concat(F.lit("r0/n0/c"), F.min("c_custkey")).alias("src"))
    least = e.agg(F.min("dst").alias("dst"))
    out = e.join(F.broadcast(first), "src").select(F.lit("dependency").alias("direction"), F.col("dst").alias("path"))  # one row
    into = e.join(F.broadcast(least), "dst").select(F.lit("dependent").alias("direction"), F.col("src").alias("path"))
    return out.unionByName(into).distinct()


_LINKS_SQL = """links AS (SELECT conv_id * 1000 + turn AS entry_id, role AS section, CASE turn % 3 WHEN 0 THEN 'r' || conv_id % 5 WHEN 1 THEN 'r' || conv_id % 5 || '/n' || conv_id % 25 ELSE 'r' || conv_id % 5 || '/n' || conv_id % 25 || '/c' || conv_id END AS path FROM conversations)"""


def _links(spark, sf_dir):
    i, t = F.col("conv_id"), F.col("turn")
    region = F.concat(F.lit("r"), i % 5)
    nation = F.concat(region, F.lit("/n"), i % 25)
    return S.table(spark, sf_dir, "conversations").select(
        (i * 1000 + t).alias("entry_id"), F.col("role").alias("section"), F.when(t % 3 == 0, region).when(t % 3 == 1, nation).otherwise(F.concat(nation, F.lit("/c"), i)).alias("path")
    )


@query(
    "overlay_counts",
    f"""{_G}, {_LINKS_SQL}, n AS (SELECT DISTINCT {_tier('path', 2)} AS node FROM gfiles), t AS (SELECT DISTINCT node, section, entry_id FROM n JOIN links ON path = node OR starts_with(path, node || '/') OR starts_with(node, path || '/'))
      SELECT node, section, count(*) AS entries FROM t GROUP BY ALL""",
)
def overlay_counts(spark, sf_dir):
    n = S.graph_files(spark, sf_dir).select(T.tier(F.col("path"), 2).alias("node")).distinct()
    return M.overlay(n, _links(spark, sf_dir))


_CANDIDATES = ["fr/src0/doc_0.txt", "src1", "doc_25.txt", "./DE/", "nothing.here"]


@query(
    "path_overlap",
    f"""WITH {S.FILES_SQL}, c AS (SELECT lower(ltrim(unnest([{', '.join(repr(c) for c in _CANDIDATES)}]), './')) AS candidate)
      SELECT DISTINCT doc_id AS id, candidate FROM files JOIN c ON contains(lower(path), candidate) OR contains(candidate, lower(path))""",
)
def path_overlap(spark, sf_dir):
    c = spark.createDataFrame([(x,) for x in _CANDIDATES], "path string")
    return M.path_overlaps(S.files(spark, sf_dir).select(F.col("doc_id").alias("id"), "path"), c)


@query(
    "file_stats",
    f"""WITH {S.chunks_sql(20)}, e AS (SELECT path, max(end_line) AS loc FROM chunks GROUP BY path), s AS (SELECT path, count(*) AS symbols FROM chunks WHERE symbol <> '' GROUP BY path)
      SELECT path, size, coalesce(loc, 0) AS loc, coalesce(symbols, 0) AS symbols FROM files LEFT JOIN e USING (path) LEFT JOIN s USING (path)""",
)
def file_stats(spark, sf_dir):
    c = S.chunks(spark, sf_dir, 20)
    # both aggregates in one pass over the chunks, so there is one shuffle and one join instead of two
    symbols = F.count_if(F.col("symbol") != "")
    per = c.groupBy("path").agg(F.max("end_line").alias("loc"), symbols.alias("symbols"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long")).alias(x)
    return S.files(spark, sf_dir).select("path", "size").join(per, "path", "left").select("path", "size", zero("loc"), zero("symbols"))


_NOTES_SQL = f"""{S.FILES_SQL}, notes AS (SELECT path, 'note ' || doc_id AS note, CASE WHEN doc_id % 8 = 1 THEN 'old' ELSE content_hash END AS noted_hash FROM files WHERE doc_id % 4 = 1)"""


def _notes(f):
    return f.where("doc_id % 4 = 1").select(
        "path", F.concat(F.lit("note "), "doc_id").alias("note"), F.when(F.col("doc_id") % 8 == 1, "old").otherwise(F.col("content_hash")).alias("noted_hash")
    )


@query("guide_files", f"WITH {S.chunks_sql(20)} SELECT files.path, count(chunks.path) AS chunks, max(end_line) AS last_line FROM files LEFT JOIN chunks ON files.path = chunks.path GROUP BY files.path")
def guide_files(spark, sf_dir):
    c = S.chunks(spark, sf_dir, 20).groupBy("path").agg(F.count("*").alias("chunks"), F.max("end_line").alias("last_line"))
    return S.files(spark, sf_dir).select("path").join(c, "path", "left").select("path", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"), "last_line")


@query(
    "guide_edges",
    f"{_G} SELECT src, dst, kind FROM gedges JOIN gfiles a ON a.path = src JOIN gfiles b ON b.path = dst WHERE a.loc > 10 AND b.loc > 10",
)
def guide_edges(spark, sf_dir):
    active = S.graph_files(spark, sf_dir).where("loc > 10").select("path")
    e = S.graph_edges(spark, sf_dir).select("src", "dst", "kind")
    return e.join(active.withColumnRenamed("path", "src"), "src", "left_semi").join(active.withColumnRenamed("path", "dst"), "dst", "left_semi")


@query(
    "guide_coverage",
    f"WITH {_NOTES_SQL} SELECT count(*) AS total, count(note) AS documented, count(CASE WHEN noted_hash <> content_hash THEN 1 END) AS stale FROM files LEFT JOIN notes USING (path)",
)
def guide_coverage(spark, sf_dir):
    f = S.files(spark, sf_dir)
    j = f.select("path", "content_hash").join(_notes(f), "path", "left")
    return j.agg(F.count("*").alias("total"), F.count("note").alias("documented"), F.count_if(F.col("noted_hash") != F.col("content_hash")).alias("stale"))


@query(
    "codebase_guide",
    f"""{_G}, o AS (SELECT src AS path, count(DISTINCT dst) AS imports FROM gedges WHERE dst <> '' GROUP BY 1), i AS (SELECT dst AS path, count(DISTINCT src) AS importers FROM gedges WHERE dst <> '' GROUP BY 1)
      SELECT path, language, CASE WHEN loc % 4 = 1 THEN 'note ' || loc END AS note, coalesce(imports, 0) AS imports, coalesce(importers, 0) AS importers FROM gfiles LEFT JOIN o USING (path) LEFT JOIN i USING (path)""",
)
def codebase_guide(spark, sf_dir):
    e = S.graph_edges(spark, sf_dir).where("dst <> ''").select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("imports"))
    into = e.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("importers"))
    f = S.graph_files(spark, sf_dir).select("path", "language", F.when(F.col("loc") % 4 == 1, F.concat(F.lit("note "), "loc")).alias("note"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long")).alias(x)
    return f.join(out, "path", "left").join(into, "path", "left").select("path", "language", "note", zero("imports"), zero("importers"))


@query(
    "guide_markdown",
    f"WITH {_NOTES_SQL} SELECT language || '/' || split_part(path, '/', 2) AS area, path, '- `' || path || '` — ' || coalesce(note || CASE WHEN noted_hash <> content_hash THEN ' (stale)' ELSE '' END, 'undocumented') AS line FROM files LEFT JOIN notes USING (path)",
)
def guide_markdown(spark, sf_dir):
    f = S.files(spark, sf_dir)
    note = F.concat("note", F.when(F.col("noted_hash") != F.col("content_hash"), " (stale)").otherwise(""))
    line = F.concat(F.lit("- `"), "path", F.lit("` — "), F.coalesce(note, F.lit("undocumented")))
    return f.select("path", "content_hash").join(_notes(f), "path", "left").select(T.tier(F.col("path"), 2).alias("area"), "path", line.alias("line"))


_GUIDE_FILES_SQL = f"""{_G}, e AS (SELECT DISTINCT src, dst FROM gedges WHERE dst <> ''), o AS (SELECT src AS path, string_agg(dst, ', ' ORDER BY dst) AS imports FROM e GROUP BY 1),
  i AS (SELECT dst AS path, string_agg(src, ', ' ORDER BY src) AS imported_by FROM e GROUP BY 1),
  g AS (SELECT path, CASE WHEN loc % 4 = 1 THEN 'Note ' || loc || chr(10) END AS summary, loc % 8 = 1 AS stale, imports, imported_by FROM gfiles LEFT JOIN o USING (path) LEFT JOIN i USING (path))"""


@query(
    "guide_document",
    f"""{_GUIDE_FILES_SQL} SELECT split_part(path, '/', 1) AS area, path, '### ' || path || chr(10) || chr(10) || coalesce(rtrim(summary, chr(10)), '_Undocumented._')
        || CASE WHEN stale THEN chr(10) || chr(10) || '{Q.STALE}' ELSE '' END || coalesce(chr(10) || chr(10) || 'Imports: ' || imports, '') || coalesce(chr(10) || chr(10) || 'Imported by: ' || imported_by, '') || chr(10) AS block FROM g
      UNION ALL SELECT DISTINCT split_part(path, '/', 1), '', '## ' || split_part(path, '/', 1) || chr(10) FROM g
      UNION ALL SELECT '', '', '{Q.TITLE}' || chr(10) || chr(10) || '{Q.DO_NOT_EDIT}' || chr(10) || chr(10) || 'Coverage: documented ' || count(summary) || ' / total ' || count(*) || ' · stale ' || count(*) FILTER (stale) || chr(10) FROM g""",
)
def guide_document(spark, sf_dir):
    """The parts of the whole guide, in the order of (area, path) that the written file has."""
    e = S.graph_edges(spark, sf_dir).where("dst <> ''").select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_list("dst")).alias("imports"))
    into = e.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_list("src")).alias("imported_by"))
    loc = F.col("loc")
    f = S.graph_files(spark, sf_dir).select("path", F.when(loc % 4 == 1, F.concat(F.lit("Note "), loc, F.lit("\n"))).alias("summary"), (loc % 8 == 1).alias("stale"))
    return Q.guide_parts(f.join(out, "path", "left").join(into, "path", "left"))


@query(
    "hot_spots",
    f"WITH {_LINKS_SQL} SELECT path, count(DISTINCT section || ':' || entry_id % 10) AS reasons FROM links WHERE section IN ('user', 'system') GROUP BY path ORDER BY reasons DESC, path LIMIT 25",
)
def hot_spots(spark, sf_dir):
    reason = F.concat("section", F.lit(":"), F.col("entry_id") % 10)
    rows = _links(spark, sf_dir).where(F.col("section").isin("user", "system")).select("path", reason.alias("reason")).distinct()
    return rows.groupBy("path").agg(F.count("*").alias("reasons")).orderBy(F.desc("reasons"), "path").limit(25)


@query(
    "areas_topn",
    f"""{_G}, n AS (SELECT {_tier('path', 2)} AS node, {_tier('path', 1)} AS area, count(*) AS files FROM gfiles GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY files DESC, node) AS k, count(*) OVER (PARTITION BY area) AS c FROM n)
      SELECT area, node, files, CAST(greatest(0, c - 3) AS BIGINT) AS more FROM k WHERE k <= 3""",
)
def areas_topn(spark, sf_dir):
    n = M.nodes(S.graph_files(spark, sf_dir), depth=2).select(T.tier(F.col("node"), 1).alias("area"), "node", "files")
    place = F.row_number().over(Window.partitionBy("area").orderBy(F.desc("files"), "node"))
    more = F.greatest(F.lit(0).cast("long"), F.count("*").over(Window.partitionBy("area")) - 3)
    return n.withColumns({"k": place, "more": more}).where("k <= 3").drop("k")


@query(
    "area_connections",
    f"{_G}, e AS (SELECT DISTINCT {_tier('src', 1)} AS s, {_tier('dst', 1)} AS t FROM gedges WHERE dst <> '') SELECT s || ' → ' || string_agg(t, ', ' ORDER BY t) AS sentence FROM e WHERE s <> t GROUP BY s",
)
def area_connections(spark, sf_dir):
    e = M.node_edges(S.graph_edges(spark, sf_dir), depth=1)
    # targets are top-level areas: as few as the map's first tier has nodes
    per = e.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("target")), ", ").alias("targets"))
    return per.select(F.concat("source", F.lit(" → "), "targets").alias("sentence"))


NEAR = "fr/src1/doc_13.tx"


@query(
    "near_paths",
    f"""WITH RECURSIVE {S.FILES_SQL}, names AS (SELECT DISTINCT path FROM files),
      a AS (SELECT path, i, substr(path, i + 1, 1) AS c FROM (SELECT path, unnest(range(length(path))) AS i FROM names)), b AS (SELECT j, substr('{NEAR}', j + 1, 1) AS c FROM (SELECT unnest(range({len(NEAR)})) AS j)),
      same AS (SELECT path, i, j, i - row_number() OVER (PARTITION BY path, i - j ORDER BY i) AS run FROM a JOIN b USING (c)),
      cells AS MATERIALIZED (SELECT path, i, j, max(i) OVER (PARTITION BY path, i - j, run) - i + 1 AS length FROM same),
      parts AS (
        SELECT path, CAST(0 AS BIGINT) AS alo, CAST(length(path) AS BIGINT) AS ahi, CAST(0 AS BIGINT) AS blo, CAST({len(NEAR)} AS BIGINT) AS bhi, CAST(0 AS BIGINT) AS size FROM names
        UNION ALL
        SELECT path, CASE side WHEN 0 THEN alo ELSE x.i + x.k END, CASE side WHEN 0 THEN x.i ELSE ahi END, CASE side WHEN 0 THEN blo ELSE x.j + x.k END, CASE side WHEN 0 THEN x.j ELSE bhi END,
          CASE side WHEN 0 THEN x.k ELSE 0 END
        FROM (SELECT p.path, alo, ahi, blo, bhi, max(struct_pack(k := least(length, ahi - i, bhi - j), ni := -i, nj := -j)) AS m FROM parts p
          JOIN cells c ON c.path = p.path AND i >= alo AND i < ahi AND j >= blo AND j < bhi GROUP BY p.path, alo, ahi, blo, bhi) g,
          LATERAL (SELECT struct_pack(k := CAST(m.k AS BIGINT), i := CAST(-m.ni AS BIGINT), j := CAST(-m.nj AS BIGINT)) AS x), (SELECT unnest([0, 1]) AS side) sides),
      r AS (SELECT path, 2.0::DOUBLE * sum(size) / (length(path) + {len(NEAR)}) AS ratio FROM parts GROUP BY path)
      SELECT path, round(ratio, 6) AS ratio FROM r WHERE ratio >= 0.4 ORDER BY r.ratio DESC, path DESC LIMIT 5""",
)
def near_paths(spark, sf_dir):
    names = S.files(spark, sf_dir).select("path").distinct()
    return close_names(names, "path", NEAR).select("path", F.round("ratio", 6).alias("ratio"))


@query(
    "feature_req",
    "SELECT doc_id AS feature_id, doc_id * 7 % 1500 AS requirement_id, r.quality AS requirement_quality FROM documents LEFT JOIN (SELECT doc_id AS rid, quality FROM labels) r ON rid = doc_id * 7 % 1500",
)
def feature_req(spark, sf_dir):
    f = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("feature_id"), (F.col("doc_id") * 7 % 1500).alias("requirement_id"))
    r = S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("requirement_id"), F.col("quality").alias("requirement_quality"))
    return f.join(r, "requirement_id", "left").select("feature_id", "requirement_id", "requirement_quality")
