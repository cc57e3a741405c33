"""Queries of curated entries, briefings and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import context as X
from siftwell.operators.contracts import ranked_requirements
from siftwell.plans.catalog import Catalog
from siftwell.sources import tables as S

CATALOG = Catalog()
query = CATALOG.query

TASK = "fix the der and que handling of in nicht"
FOCUS = "ver ungen tion"
_E = f"WITH {S.ENTRIES_SQL}"
_VISIBLE = "visible AS (SELECT * FROM entries WHERE status NOT IN ('deleted', 'archived', 'resolved') AND (age_days < 45 OR section = 'system'))"


def _visible(spark, sf_dir):
    return X.visible(S.entries(spark, sf_dir), expiry_days=45, keep_section="system")


@query("visible_entries", f"{_E}, {_VISIBLE} SELECT entry_id, section, status, age_days FROM visible")
def visible_entries(spark, sf_dir):
    return _visible(spark, sf_dir).select("entry_id", "section", "status", "age_days")


@query(
    "status_line",
    f"{_E}, {_VISIBLE} SELECT coalesce((SELECT headline FROM visible WHERE section = 'system' ORDER BY entry_id LIMIT 1), 'no focus') || ' · ' || count(CASE WHEN section = 'user' THEN 1 END) || ' open blocker(s) · ' || count(CASE WHEN section = 'assistant' THEN 1 END) || ' open bug(s)' AS line FROM visible",
)
def status_line(spark, sf_dir):
    focus = F.min_by(F.when(F.col("section") == "system", F.col("headline")), F.when(F.col("section") == "system", F.col("entry_id")))
    n = lambda s: F.count_if(F.col("section") == s)
    line = F.concat(F.coalesce(focus, F.lit("no focus")), F.lit(" · "), n("user"), F.lit(" open blocker(s) · "), n("assistant"), F.lit(" open bug(s)"))
    return _visible(spark, sf_dir).agg(line.alias("line"))


@query("req_histogram", f"{_E} SELECT section, count(*) AS total, count(CASE WHEN requirement_status = 'done' THEN 1 END) AS done, count(CASE WHEN requirement_status = 'in-progress' THEN 1 END) AS in_progress, count(CASE WHEN requirement_status = 'blocked' THEN 1 END) AS blocked, count(CASE WHEN requirement_status = 'not-started' THEN 1 END) AS not_started FROM entries GROUP BY section")
def req_histogram(spark, sf_dir):
    n = lambda s: F.count_if(F.col("requirement_status") == s).alias(s.replace("-", "_"))
    return S.entries(spark, sf_dir).groupBy("section").agg(F.count("*").alias("total"), n("done"), n("in-progress"), n("blocked"), n("not-started"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_W3 = "list_distinct(regexp_extract_all(lower(headline), '[a-z0-9_]{3,}'))"
_SCORE = f"""CASE WHEN headline <> '' AND contains('{TASK.lower()}', lower(headline)) THEN 40 WHEN list_has_any({_W3}, {_list(X._words(TASK))}) THEN 25 ELSE 0 END
  + CASE WHEN list_has_any({_W3}, {_list(X._words(FOCUS))}) THEN 15 ELSE 0 END"""


@query("relevance_score", f"{_E} SELECT entry_id, {_SCORE} AS score FROM entries")
def relevance_score(spark, sf_dir):
    return S.entries(spark, sf_dir).select("entry_id", X.relevance(F.col("headline"), None, TASK, FOCUS).alias("score"))


@query("token_overlap", f"{_E} SELECT entry_id, CAST(len(list_intersect({_W3}, {_list(X._words(TASK))})) AS BIGINT) AS shared FROM entries")
def token_overlap(spark, sf_dir):
    task = F.array(*[F.lit(w) for w in X._words(TASK)])
    return S.entries(spark, sf_dir).select("entry_id", F.size(F.array_intersect(T.words3(F.col("headline")), task)).cast("long").alias("shared"))


_TOP = f"{_E}, s AS (SELECT *, {_SCORE} AS score FROM entries), r AS (SELECT * FROM s WHERE score > 0), k AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, priority DESC, age_days, entry_id) AS place, count(*) OVER (PARTITION BY section) AS n FROM r)"


def _relevant(spark, sf_dir):
    rows = S.entries(spark, sf_dir).withColumn("score", X.relevance(F.col("headline"), None, TASK, FOCUS)).where("score > 0")
    return X.top_per_section(rows, 2, [F.desc("score"), F.desc("priority"), "age_days", "entry_id"])


@query("topk_entries", f"{_TOP} SELECT section, place, entry_id, score FROM k WHERE place <= 2")
def topk_entries(spark, sf_dir):
    return _relevant(spark, sf_dir).select("section", "place", "entry_id", "score")


_KEYED = "CASE WHEN contains('{0}', lower('R-' || entry_id % 50)) THEN 50 ELSE 0 END"
REQ_TASK = TASK + " for r-17 and R-23"


@query(
    "requirement_top",
    f"""{_E}, q AS (SELECT entry_id, 'R-' || entry_id % 50 AS req_key, headline AS title, requirement_status AS status, {_SCORE} + {_KEYED.format(REQ_TASK.lower())} AS score FROM entries),
      r AS (SELECT *, CASE status WHEN 'blocked' THEN 20 WHEN 'in-progress' THEN 15 WHEN 'not-started' THEN 5 ELSE 0 END AS boost FROM q WHERE status <> 'done' AND score > 0)
      SELECT entry_id, score, row_number() OVER (ORDER BY score DESC, boost DESC, req_key, title, entry_id) AS place, CAST(greatest((SELECT count(*) FROM r) - 3, 0) AS BIGINT) AS omitted FROM r ORDER BY place LIMIT 3""",
)
def requirement_top(spark, sf_dir):
    key = F.concat(F.lit("R-"), F.col("entry_id") % 50)
    score = X.relevance(F.col("headline"), None, TASK, FOCUS) + X.key_points(key, REQ_TASK)
    rows = S.entries(spark, sf_dir).select("entry_id", key.alias("req_key"), F.col("headline").alias("title"), F.col("requirement_status").alias("status"), score.alias("score"))
    return ranked_requirements(rows)


@query("topk_omitted", f"{_TOP} SELECT DISTINCT section, CAST(greatest(n - 2, 0) AS BIGINT) AS omitted FROM k")
def topk_omitted(spark, sf_dir):
    return _relevant(spark, sf_dir).select("section", "omitted").distinct()


@query(
    "briefing_lines",
    f"""{_E}, {_VISIBLE}, k AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section = 'assistant' AND NOT contains(lower(headline), 'an') THEN 1 ELSE 0 END,
        CASE WHEN section = 'system' THEN age_days ELSE 0 END, priority DESC, age_days, entry_id) AS place FROM visible),
      l AS (SELECT section, place, '- [' || entry_id || '] ' || headline AS line FROM k WHERE place <= 20), u AS (SELECT *, CAST(sum((length(line) + 3) // 4) OVER (PARTITION BY section ORDER BY place) AS BIGINT) AS used FROM l)
      SELECT section, place, line, used FROM u WHERE used <= 300""",
)
def briefing_lines(spark, sf_dir):
    return X.briefing(_visible(spark, sf_dir), 300, 20, T.contains(F.col("headline"), "an"), ("assistant",), ("system",))


@query(
    "export_markdown",
    f"""{_E} SELECT section, entry_id, '### ' || headline || chr(10) || chr(10) || '- id: ' || entry_id || chr(10) || '- status: ' || status || CASE WHEN detail <> headline THEN chr(10) || chr(10) || detail ELSE '' END AS block
      FROM entries WHERE status NOT IN ('deleted', 'archived')""",
)
def export_markdown(spark, sf_dir):
    rows = X.visible(S.entries(spark, sf_dir), include_resolved=True)
    body = F.when(F.col("detail") != F.col("headline"), F.concat(F.lit("\n\n"), "detail")).otherwise("")
    block = F.concat(F.lit("### "), "headline", F.lit("\n\n- id: "), "entry_id", F.lit("\n- status: "), "status", body)
    return rows.select("section", "entry_id", block.alias("block"))


@query(
    "export_sections_json",
    f"""{_E} SELECT entry_id, CAST(to_json({{'section': section, 'headline': headline, 'status': status, 'priority': priority}}) AS VARCHAR) AS line FROM entries WHERE status NOT IN ('deleted', 'archived')""",
)
def export_sections_json(spark, sf_dir):
    rows = X.visible(S.entries(spark, sf_dir), include_resolved=True)
    return rows.select("entry_id", F.to_json(F.struct("section", "headline", "status", "priority")).alias("line"))


_LINKED = "['./src/M' || conv_id % 40 || '.py', 'lib/u' || entry_id % 1000 || '/a.ts']"
_PATH_TASK = "Fix src/m7.py and lib/u3/a.ts for the import"
_RANKED, _FOCUSED, _RELATED = ("src/m7.py", "m12"), ("./lib/u1/a.ts", "deep/lib/u2/a.ts"), (3, 11)


def _touch(paths: tuple[str, ...]) -> str:
    clean = [p.lower().lstrip("./") for p in paths]
    return f"len(list_filter(clean, lambda a: {' OR '.join(f"contains(a, '{p}') OR contains('{p}', a)" for p in clean)})) > 0"


@query(
    "entry_match",
    f"""{_E}, l AS (SELECT *, {_LINKED} AS linked, list_transform({_LINKED}, lambda x: ltrim(lower(x), './')) AS clean, conv_id % 25 AS related FROM entries)
      SELECT entry_id, {_SCORE} + CASE WHEN {_touch(_RANKED)} THEN 100 ELSE 0 END + CASE WHEN {_touch(_FOCUSED)} THEN 70 ELSE 0 END
        + CASE WHEN len(list_filter(linked, lambda x: contains('{_PATH_TASK.lower()}', lower(x)))) > 0 THEN 80 ELSE 0 END + CASE WHEN related IN {_RELATED} THEN 120 ELSE 0 END AS score FROM l""",
)
def entry_match(spark, sf_dir):
    """Match scores with linked files and related requirements."""
    conv = F.col("conv_id")
    linked = F.array(F.concat(F.lit("./src/M"), conv % 40, F.lit(".py")), F.concat(F.lit("lib/u"), F.col("entry_id") % 1000, F.lit("/a.ts")))
    score = X.relevance(F.col("headline"), None, TASK, FOCUS) + X.linked_points(linked, _PATH_TASK, _RANKED, _FOCUSED) + X.related_points(conv % 25, _RELATED)
    return S.entries(spark, sf_dir).select("entry_id", score.alias("score"))


@query(
    "requirement_lines",
    f"""{_E} SELECT 0 AS place, count(*) FILTER (requirement_status = 'done') || '/' || count(*) || ' done · ' || count(*) FILTER (requirement_status = 'in-progress') || ' in progress · '
        || count(*) FILTER (requirement_status = 'blocked') || ' blocked · ' || count(*) FILTER (requirement_status = 'not-started') || ' not started' AS line FROM entries HAVING count(*) > 0
      UNION ALL SELECT row_number() OVER (ORDER BY requirement_status <> 'blocked', priority DESC, entry_id), '- [' || entry_id || '] [' || requirement_status || '] ' || headline FROM entries WHERE requirement_status IN ('blocked', 'in-progress')""",
)
def requirement_lines(spark, sf_dir):
    e = S.entries(spark, sf_dir)
    return X.requirement_lines(e.select("entry_id", "headline", F.col("requirement_status").alias("status"), "priority"))
