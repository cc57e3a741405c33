"""Task graphs: readiness, unlocking, cycles, layers, leases, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.plan_graphs import DEPENDENCY, KEY, MOST, TASK, by_plan, graph_rows, layer_rows, split
from siftwell.sources.scratch import WrittenTables

LEASED = ("claimed", "in_progress", "in_review")
CLOSED = ("completed", "cancelled", "blocked")
KEPT_STEPS = 16  #: layers between two writes of the result so far


def lease_state(status: Column, expires: Column, now: Column) -> Column:
    """none, active or expired; a lease that ends exactly now has expired."""
    held = status.isin(*LEASED) & expires.isNotNull()
    return F.when(~held, "none").when(expires <= now, "expired").otherwise("active")


def waiting(deps: DataFrame, tasks: DataFrame) -> DataFrame:
    """Distinct (plan_id, task_no) with a prerequisite that isn't completed."""
    open_ = tasks.where("status <> 'completed'").select("plan_id", F.col("task_no").alias("needs"))
    return deps.join(open_, ["plan_id", "needs"], "left_semi").select(*KEY).distinct()


def ready(tasks: DataFrame, deps: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """Tasks of active plans whose prerequisites are completed, and that are ready or whose lease has expired."""
    free = (F.col("status") == "ready") | (lease_state(F.col("status"), F.col("lease_expires_at"), now) == "expired")
    active = plans.where("plan_status = 'active'").select("plan_id")
    return tasks.where(free).join(active, "plan_id", "left_semi").join(waiting(deps, tasks), KEY, "left_anti")


def unlocked_by(tasks: DataFrame, deps: DataFrame, completed: DataFrame) -> DataFrame:
    """Pending tasks that become ready when the tasks ``completed`` (plan_id, task_no) are completed."""
    done = completed.select(*KEY, F.lit(True).alias("now_done"))
    after = tasks.join(done, KEY, "left").withColumn("status", F.when(F.col("now_done"), "completed").otherwise(F.col("status"))).drop("now_done")
    touched = deps.join(completed.select("plan_id", F.col("task_no").alias("needs")), ["plan_id", "needs"], "left_semi").select(*KEY).distinct()
    return after.where("status = 'pending'").join(touched, KEY, "left_semi").join(waiting(deps, after), KEY, "left_anti")


def roots(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Tasks without prerequisites."""
    return tasks.join(deps.select(*KEY).distinct(), KEY, "left_anti")


def layers(tasks: DataFrame, deps: DataFrame, most: int = MOST) -> DataFrame:
    """(plan_id, task_no, layer): the length of the longest chain of prerequisites; tasks on or behind a cycle have none (null).

    A plan of ``most`` rows or fewer is peeled in one task, beside others; bigger ones are peeled by joins.
    """
    rows, small, big = split(graph_rows(tasks, deps), most)
    kinds = dict(rows.dtypes)
    out = by_plan(small, layer_rows, f"plan_id {kinds['plan_id']}, task_no {kinds['task_no']}, layer long")
    out = out.unionByName(rows.where(F.col("plan_id").isNull() & (F.col("kind") == TASK)).select(*KEY).distinct().withColumn("layer", F.lit(None).cast("long")))
    if big is None:
        return out
    return out.unionByName(layers_by_joins(big.where(F.col("kind") == TASK), big.where(F.col("kind") == DEPENDENCY)))


def layers_by_joins(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """``layers`` of plans of any size.

    Kahn's peeling: each step takes the tasks whose prerequisites have all been taken, and drops the edges they
    satisfy. The tables of a step are written, so lineage stays short; the steps are as many as the longest chain.
    """
    written = WrittenTables(tasks.sparkSession, "layers")
    left = written.save(deps.select(*KEY, "needs").distinct())
    current = written.save(roots(tasks.select(*KEY).distinct(), left))
    out = current.withColumn("layer", F.lit(0).cast("long"))
    depth = 0
    while not current.isEmpty():
        depth += 1
        met = current.select("plan_id", F.col("task_no").alias("needs"))
        touched = left.join(met, ["plan_id", "needs"], "left_semi").select(*KEY).distinct()
        left = written.save(left.join(met, ["plan_id", "needs"], "left_anti"))
        current = written.save(touched.join(left.select(*KEY).distinct(), KEY, "left_anti"))
        out = out.unionByName(current.withColumn("layer", F.lit(depth).cast("long")))
        if depth % KEPT_STEPS == 0:
            out = written.save(out)
    return tasks.select(*KEY).distinct().join(out, KEY, "left")


def transitions(events: DataFrame, entity: str, order: list[str], status: str) -> DataFrame:
    """Each event with the status before it, where it changed."""
    w = Window.partitionBy(entity).orderBy(*order)
    return events.withColumn("old_status", F.lag(status).over(w)).where(~F.col("old_status").eqNullSafe(F.col(status)))
