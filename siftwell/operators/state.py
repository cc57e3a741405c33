"""Entry, project and plan state as sets: commands in append-only logs, applied by grouping and joins.

A log row is a command with a place ``seq`` in the order of its project. Whether it takes effect, and what state is left,
follows from minima and maxima per entry, so no log of one entry is replayed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.plan_graphs import DEPENDENCY, KEY, MOST, PROPOSED, TASK, by_plan, fault_rows, graph_rows, split, verdict_rows
from siftwell.operators.planning import layers_by_joins, waiting
from siftwell.sources.scratch import WrittenTables

ENTRY = ["project", "entry_id"]
#: What each command leaves as the status of an entry.
STATUS_OF = {"create": "open", "resolve": "resolved", "archive": "archived", "delete": "deleted"}


def judged(log: DataFrame) -> DataFrame:
    """``log`` (project, entry_id, seq, op, headline, priority, author) with the ``outcome`` of each command.

    The first create with a headline opens an entry; before it the entry is ``missing``, a second one finds it ``exists``;
    after a delete nothing applies (``deleted``). Else the outcome is ``applied``.
    """
    creates = log.where((F.col("op") == "create") & (F.trim("headline") != ""))
    opened = creates.groupBy(*ENTRY).agg(F.min("seq").alias("opened"))
    ends = log.where("op = 'delete'").join(opened, ENTRY).where("seq > opened").groupBy(*ENTRY).agg(F.min("seq").alias("ended"))
    rows = log.join(opened, ENTRY, "left").join(ends, ENTRY, "left")
    outcome = (
        F.when((F.col("op") == "create") & ~F.coalesce(F.trim("headline") != "", F.lit(False)), "empty-headline")
        .when(F.col("opened").isNull() | (F.col("seq") < F.col("opened")), "missing")
        .when(F.col("seq") > F.col("ended"), "deleted")
        .when((F.col("op") == "create") & (F.col("seq") > F.col("opened")), "exists")
        .otherwise("applied")
    )
    return rows.withColumn("outcome", outcome).drop("opened", "ended")


def current_entries(log: DataFrame) -> DataFrame:
    """(project, entry_id, status, headline, priority, author, revisions) after all commands that apply.

    A field that a command doesn't set (null) stays as it was; each command that applies is a revision.
    """
    status = F.lit(None).cast("string")
    for op, left in STATUS_OF.items():
        status = F.when(F.col("op") == op, left).otherwise(status)
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    return judged(log).where("outcome = 'applied'").groupBy(*ENTRY).agg(
        last(status).alias("status"),
        last(F.col("headline")).alias("headline"),
        F.coalesce(last(F.col("priority")), F.lit(0).cast("long")).alias("priority"),
        last(F.col("author")).alias("author"),
        F.count("*").alias("revisions"),
    )


def with_focus(sets: DataFrame) -> DataFrame:
    """``sets`` (project, seq, text) with ``status``: each new focus resolves the one before it, so only the last is open."""
    newest = sets.groupBy("project").agg(F.max("seq").alias("newest"))
    status = F.when(F.col("seq") == F.col("newest"), "open").otherwise("resolved")
    return sets.join(newest, "project").withColumn("status", status).drop("newest")


class UnknownProject(LookupError):
    """No project of that name or id; the message lists those there are."""


class ProjectScope:
    """One project, looked up once, and the reads that are confined to it.

    ``projects``: (project_id, name). An unknown name raises ``UnknownProject`` with the first ``SHOWN`` names. Every read gets the
    project's id as a plain value, so a scan of tables partitioned by it opens that project's partition only.
    """

    SHOWN = 100

    def __init__(self, projects: DataFrame, project: str | None):
        key = (project or "").strip()
        found = projects.where((F.col("name") == key) | (F.col("project_id").cast("string") == key)).select("project_id", "name").limit(2).collect() if key else []
        if not found:
            names = [r["name"] for r in projects.select("name").orderBy("name").limit(self.SHOWN + 1).collect()]
            more = ", ..." if len(names) > self.SHOWN else ""
            raise UnknownProject(f"no project {key!r}; there are: {', '.join(map(str, names[: self.SHOWN]))}{more}")
        # a name comes before another project's id
        row = next((r for r in found if r["name"] == key), found[0])
        self.project_id, self.name = row["project_id"], row["name"]

    def rows(self, table: DataFrame, by: str = "project_id") -> DataFrame:
        return table.where(F.col(by) == F.lit(self.project_id))

    def tables(self, tables: dict[str, DataFrame], by: str = "project_id") -> dict[str, DataFrame]:
        return {name: self.rows(t, by) for name, t in tables.items()}


def scoped(rows: DataFrame, projects: DataFrame, project: str, by: str = "project_id") -> DataFrame:
    """The rows of one project, named by name or id (as text); none if there is no such project.

    ``projects``: (project_id, name). The ids are looked up first, so that the rows' scan is pruned by plain values.
    """
    key = project.strip()
    found = projects.where((F.col("name") == key) | (F.col("project_id").cast("string") == key)).select("project_id")
    ids = [r[0] for r in found.limit(2).collect()]  # an id and another project's name at most
    return rows.where(F.col(by).isin(ids)) if ids else rows.limit(0)


def purged(tables: dict[str, DataFrame], gone: DataFrame, by: str = "project_id") -> dict[str, DataFrame]:
    """The tables without the rows of the projects ``gone`` (project_id): children need no order here, as all go at once."""
    keys = gone.select(F.col("project_id").alias(by)).distinct()
    return {name: rows.join(keys, by, "left_anti") for name, rows in tables.items()}


def judge_dependencies(proposed: DataFrame, tasks: DataFrame, deps: DataFrame, most: int = MOST) -> DataFrame:
    """``proposed`` (plan_id, task_no, needs) with what adding each alone would do: self, unknown-task, unknown-needs, exists, cycle or ok.

    A new edge closes a cycle when its task is already needed, at any distance, by what it needs. A plan of ``most`` rows or fewer
    is judged in one task, beside others; bigger ones, and proposals with a null, by joins.
    """
    rows, small, big = split(graph_rows(tasks, deps, proposed), most)
    kinds = dict(rows.dtypes)
    of = lambda rows, kind: rows.where(F.col("kind") == kind).drop("kind")
    null = F.col("task_no").isNull() | F.col("needs").isNull()
    out = by_plan(small.where((F.col("kind") != PROPOSED) | ~null), verdict_rows, f"plan_id {kinds['plan_id']}, task_no {kinds['task_no']}, needs {kinds['needs']}, verdict string")
    odd = of(rows, PROPOSED).where(null | F.col("plan_id").isNull())
    if not odd.isEmpty():
        out = out.unionByName(judge_by_joins(odd, of(rows, TASK), of(rows, DEPENDENCY)))
    if big is not None:
        out = out.unionByName(judge_by_joins(of(big, PROPOSED).where(~null), of(big, TASK), of(big, DEPENDENCY)))
    return out


def judge_by_joins(proposed: DataFrame, tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """``judge_dependencies`` of plans of any size.

    The frontier of all proposals is moved along the dependencies at once; a node is followed once for each start, and what is new is
    appended to what was reached.
    """
    known = tasks.select(*KEY).distinct()
    rows = proposed.select(*KEY, "needs").distinct()
    rows = rows.join(known.withColumn("t", F.lit(True)), KEY, "left")
    rows = rows.join(known.select("plan_id", F.col("task_no").alias("needs"), F.lit(True).alias("n")), ["plan_id", "needs"], "left")
    rows = rows.join(deps.select(*KEY, "needs").distinct().withColumn("d", F.lit(True)), [*KEY, "needs"], "left")
    written = WrittenTables(proposed.sparkSession, "reach")
    edges = written.save(deps.select("plan_id", F.col("task_no").alias("at"), F.col("needs").alias("to")).distinct())
    frontier = written.save(rows.where("t AND n AND d IS NULL AND task_no <> needs").select("plan_id", F.col("needs").alias("start"), F.col("needs").alias("at")).distinct())
    reached = written.append(frontier, "reached")
    while not frontier.isEmpty():
        step = frontier.join(edges, ["plan_id", "at"]).select("plan_id", "start", F.col("to").alias("at")).distinct()
        frontier = written.save(step.join(reached, ["plan_id", "start", "at"], "left_anti"))
        reached = written.append(frontier, "reached")
    loops = reached.select("plan_id", F.col("start").alias("needs"), F.col("at").alias("task_no"), F.lit(True).alias("loop"))
    rows = rows.join(loops, [*KEY, "needs"], "left")
    verdict = (
        F.when(F.col("task_no") == F.col("needs"), "self")
        .when(F.col("t").isNull(), "unknown-task")
        .when(F.col("n").isNull(), "unknown-needs")
        .when(F.col("d").isNotNull(), "exists")
        .when(F.col("loop").isNotNull(), "cycle")
        .otherwise("ok")
    )
    return rows.select(*KEY, "needs", verdict.alias("verdict"))


def complete(tasks: DataFrame, deps: DataFrame, done: DataFrame) -> DataFrame:
    """(plan_id, task_no, old_status, new_status) of all tasks that change when the tasks ``done`` are completed: those, and the pending ones they unlock.

    Only a claimed task can be completed; others in ``done`` are left alone.
    """
    ending = tasks.where("status = 'claimed'").join(done.select(*KEY).distinct(), KEY, "left_semi").select(*KEY)
    after = tasks.join(ending.withColumn("ends", F.lit(True)), KEY, "left")
    after = after.withColumn("new_status", F.when(F.col("ends"), "completed").otherwise(F.col("status")))
    behind = deps.join(ending.select("plan_id", F.col("task_no").alias("needs")), ["plan_id", "needs"], "left_semi").select(*KEY).distinct()
    still = waiting(deps, after.select(*KEY, F.col("new_status").alias("status")))
    free = after.where("new_status = 'pending'").join(behind, KEY, "left_semi").join(still, KEY, "left_anti")
    changed = after.where("ends").select(*KEY, F.col("status").alias("old_status"), "new_status")
    return changed.unionByName(free.select(*KEY, F.col("status").alias("old_status"), F.lit("ready").alias("new_status")))


def archive(tasks: DataFrame, plans: DataFrame) -> DataFrame:
    """``tasks`` of the plans ``plans`` (plan_id) after they are archived: no lease is left, and all that isn't completed is cancelled."""
    mine = tasks.join(plans.select("plan_id").distinct(), "plan_id", "left_semi")
    status = F.when(F.col("status") == "completed", F.col("status")).otherwise("cancelled")
    none = F.lit(None).cast(dict(tasks.dtypes)["lease_expires_at"])
    return mine.select(*KEY, F.col("status").alias("old_status"), status.alias("new_status"), none.alias("lease_expires_at"))


def judge_plans(plans: DataFrame, tasks: DataFrame, deps: DataFrame, most: int = MOST) -> DataFrame:
    """(plan_id, verdict) of proposed plans, all or nothing: the first of no-title, no-tasks, duplicate-task, unknown-task, cycle; else ok.

    ``plans``: (plan_id, title); ``tasks``: (plan_id, task_no); ``deps``: (plan_id, task_no, needs).
    """
    rows, small, big = split(graph_rows(tasks, deps), most)
    faults = by_plan(small, fault_rows, f"plan_id {dict(rows.dtypes)['plan_id']}, tasks long, most long, unknown boolean, cyclic boolean")
    if big is not None:
        faults = faults.unionByName(faults_by_joins(big.where(F.col("kind") == TASK), big.where(F.col("kind") == DEPENDENCY)))
    rows = plans.join(faults, "plan_id", "left")
    verdict = (
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "no-title")
        .when(F.col("tasks").isNull(), "no-tasks")
        .when(F.col("most") > 1, "duplicate-task")
        .when(F.col("unknown"), "unknown-task")
        .when(F.col("cyclic"), "cycle")
        .otherwise("ok")
    )
    return rows.select("plan_id", verdict.alias("verdict"))


def faults_by_joins(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(plan_id, tasks, most, unknown, cyclic) as ``plan_graphs.fault_rows`` has them, of plans of any size."""
    counted = tasks.groupBy(*KEY).agg(F.count("*").alias("n"))
    sizes = counted.groupBy("plan_id").agg(F.count("*").alias("tasks"), F.max("n").alias("most"))
    ends = deps.select("plan_id", F.explode(F.array("task_no", "needs")).alias("task_no")).distinct()
    unknown = ends.join(counted, KEY, "left_anti").groupBy("plan_id").agg(F.lit(True).alias("unknown"))
    known = deps.join(counted.select(*KEY), KEY, "left_semi")
    known = known.join(counted.select("plan_id", F.col("task_no").alias("needs")), ["plan_id", "needs"], "left_semi")
    cyclic = layers_by_joins(counted, known).where("layer IS NULL").groupBy("plan_id").agg(F.lit(True).alias("cyclic"))
    return sizes.join(unknown, "plan_id", "full").join(cyclic, "plan_id", "full")


def rejects(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``reasons``: the names of the rules that a row breaks, in the order given; rows that break none are left out.

    A rule is an expression that is true for a row it refuses.
    """
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return rows.withColumn("reasons", F.array_join(broken, ",")).where("reasons <> ''")


def clamped(value: Column, least: int, most: int, default: int) -> Column:
    """An argument within its bounds; the default for a null."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(value, F.lit(default))))
