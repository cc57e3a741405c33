"""Queries of the state operators: entry logs, focus, project scope, plan changes, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import paths as P
from siftwell.operators import state as O
from siftwell.operators.validation import ENTRY, faults
from siftwell.plans.catalog import Catalog
from siftwell.sources import tables as S

CATALOG = Catalog()
query = CATALOG.query

_JUDGED = f"""{S.ENTRY_LOG_SQL},
  opened AS (SELECT project, entry_id, min(seq) AS opened FROM entry_log WHERE op = 'create' AND trim(headline) <> '' GROUP BY ALL),
  ended AS (SELECT project, entry_id, min(seq) AS ended FROM entry_log JOIN opened USING (project, entry_id) WHERE op = 'delete' AND seq > opened GROUP BY ALL),
  judged AS (SELECT l.*, CASE WHEN op = 'create' AND coalesce(trim(headline), '') = '' THEN 'empty-headline' WHEN opened IS NULL OR seq < opened THEN 'missing'
    WHEN seq > ended THEN 'deleted' WHEN op = 'create' AND seq > opened THEN 'exists' ELSE 'applied' END AS outcome
    FROM entry_log l LEFT JOIN opened USING (project, entry_id) LEFT JOIN ended USING (project, entry_id))"""


@query("entry_commands", f"WITH {_JUDGED} SELECT seq, project, entry_id, op, outcome FROM judged")
def entry_commands(spark, sf_dir):
    return O.judged(S.entry_log(spark, sf_dir)).select("seq", "project", "entry_id", "op", "outcome")


@query(
    "current_entries",
    f"""WITH {_JUDGED}, a AS (SELECT *, CASE op WHEN 'create' THEN 'open' WHEN 'resolve' THEN 'resolved' WHEN 'archive' THEN 'archived' WHEN 'delete' THEN 'deleted' END AS s FROM judged WHERE outcome = 'applied')
      SELECT project, entry_id, arg_max(s, seq) FILTER (s IS NOT NULL) AS status, arg_max(headline, seq) FILTER (headline IS NOT NULL) AS headline,
        coalesce(arg_max(priority, seq) FILTER (priority IS NOT NULL), 0) AS priority, arg_max(author, seq) AS author, count(*) AS revisions FROM a GROUP BY ALL""",
)
def current_entries(spark, sf_dir):
    return O.current_entries(S.entry_log(spark, sf_dir))


_FOCUS = "SELECT 'p' || conv_id % 7 AS project, conv_id * 1000 + turn AS seq, text FROM conversations WHERE role = 'user'"


@query("set_focus", f"WITH f AS ({_FOCUS}), n AS (SELECT project, max(seq) AS newest FROM f GROUP BY 1) SELECT project, seq, CASE WHEN seq = newest THEN 'open' ELSE 'resolved' END AS status FROM f JOIN n USING (project)")
def set_focus(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations").where("role = 'user'")
    sets = c.select(F.concat(F.lit("p"), F.col("conv_id") % 7).alias("project"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text")
    return O.with_focus(sets).select("project", "seq", "status")


_SCOPE = "SELECT c_custkey, c_nationkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = '{0}' OR CAST(n_nationkey AS VARCHAR) = '{0}')"


def _scope(spark, sf_dir, project):
    projects = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    return O.scoped(S.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name"), projects, project, "c_nationkey")


@query("project_scope", f"{_SCOPE.format('7')} UNION ALL {_SCOPE.format('nowhere')}")
def project_scope(spark, sf_dir):
    return _scope(spark, sf_dir, " 7 ").unionByName(_scope(spark, sf_dir, "nowhere"))


@query("project_resolve", "SELECT n_nationkey AS project_id, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)")
def project_resolve(spark, sf_dir):
    name = S.table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return _scope(spark, sf_dir, name or "").select(F.col("c_nationkey").alias("project_id"), "c_name")


@query(
    "project_reads",
    """WITH p AS (SELECT n_nationkey AS id FROM nation WHERE n_name = (SELECT max(n_name) FROM nation))
      SELECT 'customer' AS name, count(*) AS n FROM customer JOIN p ON c_nationkey = id UNION ALL SELECT 'supplier', count(*) FROM supplier JOIN p ON s_nationkey = id
      UNION ALL SELECT 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN p ON c_nationkey = id""",
)
def project_reads(spark, sf_dir):
    """Every read of one project's tables: its customers, suppliers and orders."""
    nation, customer = S.table(spark, sf_dir, "nation"), S.table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "project_id")
    scope = O.ProjectScope(nation.select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name")), nation.agg(F.max("n_name")).first()[0])
    own = scope.tables({"customer": customer, "supplier": S.table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "project_id")})
    own["orders"] = S.table(spark, sf_dir, "orders").join(own["customer"].select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in own.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "project_purge",
    "SELECT 'customer' AS name, count(*) AS left_over FROM customer WHERE c_nationkey % 5 <> 2 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey % 5 <> 2",
)
def project_purge(spark, sf_dir):
    gone = S.table(spark, sf_dir, "nation").where("n_nationkey % 5 = 2").select(F.col("n_nationkey").alias("project_id"))
    tables = {t: S.table(spark, sf_dir, t).withColumnRenamed(f"{t[0]}_nationkey", "project_id") for t in ("customer", "supplier")}
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("left_over")) for name, rows in O.purged(tables, gone).items()]
    return counts[0].unionByName(counts[1])


#: Proposed dependencies: the line after next, each line itself, the line before, and lines that don't exist.
_PROPOSED_SQL = """proposed AS (SELECT DISTINCT l_orderkey AS plan_id, CAST(l_linenumber AS BIGINT) AS task_no,
  unnest([CAST(l_linenumber + 2 AS BIGINT), CAST(l_linenumber AS BIGINT), CAST(l_linenumber - 1 AS BIGINT), CAST(l_linenumber - 2 AS BIGINT)]) AS needs FROM lineitem WHERE l_linenumber % 2 = 1)"""


def _proposed(spark, sf_dir):
    n = F.col("l_linenumber").cast("long")
    rows = S.table(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("plan_id"), n.alias("task_no"))
    return rows.select("plan_id", "task_no", F.explode(F.array(F.col("task_no") + 2, F.col("task_no"), F.col("task_no") - 1, F.col("task_no") - 2)).alias("needs"))


@query(
    "add_dependency_check",
    f"""WITH RECURSIVE {S.TASKS_SQL}, {_PROPOSED_SQL}, reach AS (SELECT plan_id, task_no AS start, needs AS at FROM deps UNION SELECT r.plan_id, r.start, d.needs FROM reach r JOIN deps d ON d.plan_id = r.plan_id AND d.task_no = r.at)
      SELECT p.plan_id, p.task_no, p.needs, CASE WHEN p.task_no = p.needs THEN 'self' WHEN t.task_no IS NULL THEN 'unknown-task' WHEN n.task_no IS NULL THEN 'unknown-needs' WHEN d.needs IS NOT NULL THEN 'exists' WHEN r.at IS NOT NULL THEN 'cycle' ELSE 'ok' END AS verdict
      FROM proposed p LEFT JOIN tasks t ON t.plan_id = p.plan_id AND t.task_no = p.task_no LEFT JOIN tasks n ON n.plan_id = p.plan_id AND n.task_no = p.needs
      LEFT JOIN deps d ON d.plan_id = p.plan_id AND d.task_no = p.task_no AND d.needs = p.needs LEFT JOIN reach r ON r.plan_id = p.plan_id AND r.start = p.needs AND r.at = p.task_no""",
)
def add_dependency_check(spark, sf_dir):
    tasks = S.tasks(spark, sf_dir)
    return O.judge_dependencies(_proposed(spark, sf_dir), tasks, S.dependencies(tasks))


@query(
    "complete_and_unlock",
    f"""WITH {S.TASKS_SQL}, ending AS (SELECT plan_id, task_no FROM tasks WHERE status = 'claimed' AND plan_id % 2 = 0),
      after AS (SELECT t.*, CASE WHEN e.plan_id IS NOT NULL THEN 'completed' ELSE status END AS now FROM tasks t LEFT JOIN ending e USING (plan_id, task_no)),
      unmet AS (SELECT DISTINCT d.plan_id, d.task_no FROM deps d JOIN after a ON a.plan_id = d.plan_id AND a.task_no = d.needs WHERE a.now <> 'completed'),
      behind AS (SELECT DISTINCT d.plan_id, d.task_no FROM deps d JOIN ending e ON e.plan_id = d.plan_id AND e.task_no = d.needs)
      SELECT plan_id, task_no, 'claimed' AS old_status, 'completed' AS new_status FROM ending
      UNION ALL SELECT a.plan_id, a.task_no, 'pending', 'ready' FROM after a JOIN behind USING (plan_id, task_no) ANTI JOIN unmet USING (plan_id, task_no) WHERE a.now = 'pending'""",
)
def complete_and_unlock(spark, sf_dir):
    tasks = S.tasks(spark, sf_dir)
    return O.complete(tasks, S.dependencies(tasks), tasks.where("plan_id % 2 = 0"))


@query(
    "archive_plan",
    f"WITH {S.TASKS_SQL} SELECT t.plan_id, task_no, status AS old_status, CASE WHEN status = 'completed' THEN status ELSE 'cancelled' END AS new_status, CAST(NULL AS TIMESTAMP) AS lease_expires_at FROM tasks t JOIN plans p ON p.plan_id = t.plan_id WHERE title LIKE '1%'",
)
def archive_plan(spark, sf_dir):
    return O.archive(S.tasks(spark, sf_dir), S.plans(spark, sf_dir).where("title LIKE '1%'"))


@query(
    "create_plan",
    """WITH p AS (SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END AS title FROM orders),
      t AS (SELECT l_orderkey AS plan_id, CAST(l_linenumber AS BIGINT) AS task_no FROM lineitem WHERE l_orderkey % 7 <> 3
        UNION ALL SELECT l_orderkey, CAST(l_linenumber AS BIGINT) FROM lineitem WHERE l_orderkey % 13 = 5 AND l_linenumber = 1),
      d AS (SELECT l_orderkey AS plan_id, CAST(l_linenumber AS BIGINT) AS task_no, CAST(CASE WHEN l_orderkey % 17 = 4 THEN l_linenumber % 2 + 1 ELSE l_linenumber - 1 END AS BIGINT) AS needs FROM lineitem WHERE l_linenumber > 1 OR l_orderkey % 17 = 4),
      n AS (SELECT plan_id, task_no, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT plan_id, count(*) AS tasks, max(n) AS most FROM n GROUP BY 1),
      u AS (SELECT DISTINCT plan_id FROM (SELECT plan_id, task_no FROM d UNION SELECT plan_id, needs FROM d) e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.plan_id = e.plan_id AND n.task_no = e.task_no)),
      k AS (SELECT plan_id FROM n WHERE plan_id % 17 = 4 GROUP BY 1 HAVING count(*) FILTER (task_no = 1) > 0)
      SELECT p.plan_id, CASE WHEN trim(title) = '' THEN 'no-title' WHEN s.tasks IS NULL THEN 'no-tasks' WHEN s.most > 1 THEN 'duplicate-task' WHEN u.plan_id IS NOT NULL THEN 'unknown-task'
        WHEN k.plan_id IS NOT NULL THEN 'cycle' ELSE 'ok' END AS verdict FROM p LEFT JOIN s USING (plan_id) LEFT JOIN u USING (plan_id) LEFT JOIN k USING (plan_id)""",
)
def create_plan(spark, sf_dir):
    i, n = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    lines = S.table(spark, sf_dir, "lineitem")
    plans = S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("plan_id"), F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.col("o_orderpriority")).alias("title")
    )
    rows = lines.select(i.alias("plan_id"), n.alias("task_no"))
    tasks = rows.where("plan_id % 7 <> 3").unionByName(rows.where("plan_id % 13 = 5 AND task_no = 1"))
    needs = F.when(i % 17 == 4, n % 2 + 1).otherwise(n - 1)
    deps = lines.where((n > 1) | (i % 17 == 4)).select(i.alias("plan_id"), n.alias("task_no"), needs.alias("needs"))
    return O.judge_plans(plans, tasks, deps)


@query(
    "entry_rejects",
    """SELECT conv_id, turn, concat_ws(',', CASE WHEN coalesce(role NOT IN ('user', 'assistant'), false) THEN 'section' END, CASE WHEN turn > 3 THEN 'priority' END, CASE WHEN length(text) > 400 THEN 'detail-length' END,
        CASE WHEN trim(text) = '' THEN 'empty' END) AS reasons FROM conversations WHERE coalesce(role NOT IN ('user', 'assistant'), false) OR turn > 3 OR length(text) > 400 OR trim(text) = ''""",
)
def entry_rejects(spark, sf_dir):
    rules = {
        "section": ~F.col("role").isin("user", "assistant"),
        "priority": F.col("turn") > 3,
        "detail-length": F.length("text") > 400,
        "empty": F.trim("text") == "",
    }
    return O.rejects(S.table(spark, sf_dir, "conversations"), rules).select("conv_id", "turn", "reasons")


@query("arg_clamps", "SELECT event_id, greatest(1, least(100, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 - 20, 20))) AS page FROM events")
def arg_clamps(spark, sf_dir):
    asked = F.get_json_object("props", "$.k").cast("long") * 3 - 20
    return S.table(spark, sf_dir, "events").select("event_id", O.clamped(asked, 1, 100, 20).cast("long").alias("page"))


_RAW = "CASE doc_id % 8 WHEN 0 THEN '/etc/' || doc_id WHEN 1 THEN '~/x' || doc_id WHEN 2 THEN 'a/../../b' || doc_id WHEN 3 THEN './a//b/./c' || doc_id WHEN 4 THEN ' a/b/../c' || doc_id || '/ ' WHEN 5 THEN '' WHEN 6 THEN 'a/..' ELSE '..a/b..c' || doc_id END"


@query(
    "path_guard",
    f"""SELECT doc_id, {_RAW} AS raw, CASE doc_id % 8 WHEN 3 THEN 'a/b/c' || doc_id WHEN 4 THEN 'a/c' || doc_id WHEN 6 THEN '' WHEN 7 THEN '..a/b..c' || doc_id END AS path,
      CASE doc_id % 8 WHEN 0 THEN 'not-relative' WHEN 1 THEN 'not-relative' WHEN 2 THEN 'outside' WHEN 5 THEN 'not-relative' END AS reason FROM documents""",
)
def path_guard(spark, sf_dir):
    raw = F.expr(_RAW)
    return S.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), P.normal_path(raw).alias("path"), P.path_fault(raw).alias("reason"))


@query(
    "entry_faults",
    f"""WITH {S.ENTRIES_SQL} SELECT entry_id, concat_ws('|', '$.section: choice', CASE WHEN length(trim(headline)) = 0 THEN '$.headline: empty' WHEN length(trim(headline)) > 120 THEN '$.headline: too_long' END,
      CASE WHEN length(trim(detail)) > 8000 THEN '$.detail: too_long' END, CASE WHEN priority > 100 THEN '$.priority: range' END, CASE WHEN conv_id % 3 = 0 THEN '$.extra: unknown' END) AS faults FROM entries""",
)
def entry_faults(spark, sf_dir):
    """The entries as JSON documents, and every fault by its path; a chat role is no section."""
    e = S.entries(spark, sf_dir)
    extra = F.when(F.col("conv_id") % 3 == 0, F.lit("more"))
    document = F.to_json(F.struct("section", "headline", "detail", "status", "requirement_status", "priority", extra.alias("extra")))
    return e.select("entry_id", F.array_join(faults(document, ENTRY), "|").alias("faults"))
