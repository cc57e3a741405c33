"""Queries of plans and tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.operators import planning as P
from siftwell.operators.validation import DRAFT, faults
from siftwell.plans.catalog import Catalog
from siftwell.sources import tables as S

CATALOG = Catalog()
query = CATALOG.query
_W = f"WITH {S.TASKS_SQL}"
_WAITING = "waiting AS (SELECT DISTINCT d.plan_id, d.task_no FROM deps d JOIN tasks t ON t.plan_id = d.plan_id AND t.task_no = d.needs WHERE t.status <> 'completed')"
_FREE = "(status = 'ready' OR (status = 'claimed' AND lease_expires_at <= (SELECT now FROM clock)))"


def _now():
    return F.lit(S.NOW).cast("timestamp_ntz")


@query(
    "ready_tasks",
    f"{_W}, {_WAITING} SELECT plan_id, task_no, status, priority FROM tasks JOIN plans USING (plan_id) WHERE plan_status = 'active' AND {_FREE} AND NOT EXISTS (SELECT 1 FROM waiting w WHERE w.plan_id = tasks.plan_id AND w.task_no = tasks.task_no)",
)
def ready_tasks(spark, sf_dir):
    t = S.tasks(spark, sf_dir)
    return P.ready(t, S.dependencies(t), S.plans(spark, sf_dir), _now()).select("plan_id", "task_no", "status", "priority")


@query(
    "downstream_unlock",
    f"""{_W}, c AS (SELECT plan_id, min(task_no) AS task_no FROM tasks GROUP BY plan_id), after AS (SELECT t.plan_id, t.task_no, CASE WHEN c.task_no IS NOT NULL THEN 'completed' ELSE status END AS status FROM tasks t LEFT JOIN c ON c.plan_id = t.plan_id AND c.task_no = t.task_no)
      SELECT a.plan_id, a.task_no FROM after a WHERE status = 'pending' AND EXISTS (SELECT 1 FROM deps d JOIN c ON c.plan_id = d.plan_id AND c.task_no = d.needs WHERE d.plan_id = a.plan_id AND d.task_no = a.task_no)
        AND NOT EXISTS (SELECT 1 FROM deps d JOIN after b ON b.plan_id = d.plan_id AND b.task_no = d.needs WHERE d.plan_id = a.plan_id AND d.task_no = a.task_no AND b.status <> 'completed')""",
)
def downstream_unlock(spark, sf_dir):
    t = S.tasks(spark, sf_dir)
    first = t.groupBy("plan_id").agg(F.min("task_no").alias("task_no"))
    return P.unlocked_by(t, S.dependencies(t), first).select("plan_id", "task_no")


@query("dag_roots", f"{_W} SELECT plan_id, task_no FROM tasks WHERE (plan_id, task_no) NOT IN (SELECT plan_id, task_no FROM deps)")
def dag_roots(spark, sf_dir):
    t = S.tasks(spark, sf_dir)
    return P.roots(t, S.dependencies(t)).select("plan_id", "task_no")


@query("dag_layers", f"{_W} SELECT plan_id, task_no, k - 1 AS layer FROM ranked")
def dag_layers(spark, sf_dir):
    t = S.tasks(spark, sf_dir)
    return P.layers(t, S.dependencies(t))


@query(
    "dag_cycle_check",
    f"""WITH RECURSIVE {S.TASKS_SQL}, cyclic AS (SELECT * FROM deps UNION SELECT plan_id, min(task_no), max(task_no) FROM tasks WHERE plan_id % 10 = 0 GROUP BY plan_id HAVING count(*) > 1),
      reach AS (SELECT plan_id, task_no, needs FROM cyclic UNION SELECT r.plan_id, r.task_no, c.needs FROM reach r JOIN cyclic c ON c.plan_id = r.plan_id AND c.task_no = r.needs),
      bad AS (SELECT DISTINCT plan_id FROM reach WHERE task_no = needs) SELECT plan_id, plan_id IN (SELECT plan_id FROM bad) AS cyclic FROM (SELECT DISTINCT plan_id FROM tasks)""",
)
def dag_cycle_check(spark, sf_dir):
    t = S.tasks(spark, sf_dir)
    back = t.where("plan_id % 10 = 0").groupBy("plan_id").agg(F.min("task_no").alias("task_no"), F.max("task_no").alias("needs"), F.count("*").alias("n"))
    deps = S.dependencies(t).unionByName(back.where("n > 1").drop("n"))
    return P.layers(t, deps).groupBy("plan_id").agg(F.bool_or(F.col("layer").isNull()).alias("cyclic"))


@query(
    "plan_view",
    f"{_W}, d AS (SELECT plan_id, task_no, array_to_string(list(needs ORDER BY needs), ',') AS needs FROM deps GROUP BY ALL) SELECT plan_id, title, task_no, status, priority, coalesce(needs, '') AS needs FROM tasks JOIN plans USING (plan_id) LEFT JOIN d USING (plan_id, task_no)",
)
def plan_view(spark, sf_dir):
    t = S.tasks(spark, sf_dir)
    d = S.dependencies(t).groupBy("plan_id", "task_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("needs")), lambda x: x.cast("string")), ",").alias("needs"))
    rows = t.join(S.plans(spark, sf_dir), "plan_id").join(d, ["plan_id", "task_no"], "left")
    return rows.select("plan_id", "title", "task_no", "status", "priority", F.coalesce("needs", F.lit("")).alias("needs"))


@query("plan_completable", f"{_W} SELECT plan_id, count(*) AS tasks, bool_and(status IN ('completed', 'cancelled')) AS completable FROM tasks GROUP BY plan_id")
def plan_completable(spark, sf_dir):
    return S.tasks(spark, sf_dir).groupBy("plan_id").agg(F.count("*").alias("tasks"), F.bool_and(F.col("status").isin("completed", "cancelled")).alias("completable"))


@query("dep_status", f"{_W} SELECT d.plan_id, d.task_no, d.needs, t.status AS needs_status FROM deps d JOIN tasks t ON t.plan_id = d.plan_id AND t.task_no = d.needs")
def dep_status(spark, sf_dir):
    t = S.tasks(spark, sf_dir)
    return S.dependencies(t).join(t.select("plan_id", F.col("task_no").alias("needs"), F.col("status").alias("needs_status")), ["plan_id", "needs"]).select("plan_id", "task_no", "needs", "needs_status")


@query("lease_state", f"{_W} SELECT plan_id, task_no, CASE WHEN status <> 'claimed' THEN 'none' WHEN lease_expires_at <= (SELECT now FROM clock) THEN 'expired' ELSE 'active' END AS lease FROM tasks")
def lease_state(spark, sf_dir):
    return S.tasks(spark, sf_dir).select("plan_id", "task_no", P.lease_state(F.col("status"), F.col("lease_expires_at"), _now()).alias("lease"))


@query(
    "task_history",
    "WITH h AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_status FROM events) SELECT user_id, event_id, old_status, event_type AS new_status FROM h WHERE old_status IS DISTINCT FROM event_type",
)
def task_history(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return P.transitions(e, "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "old_status", F.col("event_type").alias("new_status"))


@query("plan_order", f"{_W}, k AS (SELECT plan_id, task_no, priority, row_number() OVER (PARTITION BY plan_id ORDER BY priority DESC, task_no) AS place FROM tasks) SELECT * FROM k")
def plan_order(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("priority"), "task_no"))
    return S.tasks(spark, sf_dir).select("plan_id", "task_no", "priority", place.cast("long").alias("place"))


_OK = '{"local_task_id": "t1", "title": "One", "objective": "Do", "linked_files": ["./src/a.py"]}, {"local_task_id": "t2", "title": "Two", "objective": "Do"}'
#: What is wrong with a draft, by the part's number modulo 12, and the fault that tells it.
_DRAFTS = [
    (_OK, "", None),
    (_OK, ', "x": 1', "$.x: unknown"),
    (_OK.replace('"Do"}', '" "}'), "", "$.tasks[1].objective: empty"),
    ("", "", "$.tasks: too_few"),
    (_OK.replace("t2", "t1"), "", "$.tasks: repeated"),
    (_OK, ', "dependencies": [{"task_local_id": "t2", "depends_on_local_id": "t2"}]', "$.dependencies: self"),
    (_OK, ', "dependencies": [{"task_local_id": "t2", "depends_on_local_id": "t9"}]', "$.dependencies: dangling"),
    (_OK.replace("t2", "t" * 40), "", "$.tasks[1].local_task_id: too_long"),
    (_OK.replace('"./src/a.py"', '3, "/etc/x"'), "", "$.tasks[0].linked_files[0]: type|$.tasks[0].linked_files[1]: path"),
    (_OK, ', "notes": [1], "dependencies": {}', "$.dependencies: type|$.notes: type"),
    (_OK.replace('"title": "Two", ', ""), "", "$.tasks[1].title: missing"),
    (_OK, "]", "$: json"),
]


@query(
    "draft_faults",
    "SELECT p_partkey, CASE WHEN length(p_name) > 160 THEN '$.title: too_long' ELSE CASE p_partkey % 12 "
    + " ".join(f"WHEN {k} THEN '{fault}'" for k, (_, _, fault) in enumerate(_DRAFTS) if fault)
    + " END END AS faults FROM part WHERE p_partkey % 12 <> 0 OR length(p_name) > 160",
)
def draft_faults(spark, sf_dir):
    """Plan drafts in JSON, one for each part, and every fault of them."""
    i = F.col("p_partkey") % 12
    tasks, more = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (own, rest, _) in enumerate(_DRAFTS):
        tasks, more = F.when(i == k, own).otherwise(tasks), F.when(i == k, rest).otherwise(more)
    head = F.to_json(F.struct(F.col("p_name").alias("title"), F.lit("Goal").alias("goal")))
    document = F.concat(F.rtrim(head, F.lit("}")), F.lit(', "tasks": ['), tasks, F.lit("]"), more, F.lit("}"))
    parts = S.table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition("p_partkey")  # few bytes, long work: one file's rows go to all cores
    rows = parts.select("p_partkey", faults(document, DRAFT).alias("f")).where(F.size("f") > 0)
    return rows.select("p_partkey", F.array_join("f", "|").alias("faults"))
