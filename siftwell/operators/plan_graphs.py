"""Task graphs of many plans at once: whole plans side by side in numpy, in pieces of bounded size.

Plans of more than ``MOST`` rows are left to the joins of ``planning`` and ``state``, which follow them step by step on all cores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.sources.scratch import WrittenTables

KEY = ["plan_id", "task_no"]
MOST = 256  #: rows of a plan that is decided in one task
PIECE = 1 << 14  #: rows decided at once, and at most a plan's rows more
TASK, DEPENDENCY, PROPOSED = 0, 1, 2


def graph_rows(tasks: DataFrame, deps: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """(plan_id, task_no, needs, kind), in the types of ``tasks``."""
    plan, task = (tasks.schema[c].dataType for c in KEY)
    kinds = [(tasks.select(*KEY, F.lit(None).alias("needs")), TASK), (deps, DEPENDENCY), *([(proposed, PROPOSED)] if proposed is not None else [])]
    cast = [F.col("plan_id").cast(plan).alias("plan_id"), *(F.col(c).cast(task).alias(c) for c in ("task_no", "needs"))]
    parts = [rows.select(*cast, F.lit(kind).cast("tinyint").alias("kind")) for rows, kind in kinds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def split(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``rows`` written, those of plans of ``most`` rows or fewer, and those of bigger ones (None if there are none); a null plan is in neither."""
    written = WrittenTables(rows.sparkSession, "graphs")
    rows = written.save(rows)
    big = written.save(rows.where("plan_id IS NOT NULL").groupBy("plan_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("plan_id"))
    known = rows.where("plan_id IS NOT NULL")
    if big.isEmpty():
        return rows, known, None
    return rows, known.join(big, "plan_id", "left_anti"), known.join(big, "plan_id", "left_semi")


def by_plan(rows: DataFrame, run: Callable[[Graphs], pa.RecordBatch], schema: str, size: int = PIECE) -> DataFrame:
    """``run`` on pieces of about ``size`` rows that hold their plans whole."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                held.append(batch.slice(start, size))
                if sum(b.num_rows for b in held) >= size:
                    graphs = Graphs(held)
                    cut = int(np.searchsorted(graphs.plan, graphs.plan[-1]))  # the last plan may go on
                    if cut:
                        yield run(Graphs([graphs.rows.slice(0, cut)]))
                    held = [graphs.rows.slice(cut)]
        if held:
            yield run(Graphs(held))

    return rows.repartition("plan_id").sortWithinPartitions("plan_id").mapInArrow(pieces, schema)


def _codes(column: pa.Array) -> tuple[np.ndarray, int]:
    """Numbers of a column's values from 0, in order of first sight; nulls have the number after the last."""
    found = column.dictionary_encode()
    n = len(found.dictionary)
    return found.indices.fill_null(n).to_numpy(zero_copy_only=False).astype(np.int64), n


class Graphs:
    """Rows (plan_id, task_no, needs, kind) of some plans, in order of the plan, as numbered nodes and edges."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.plan, plans = _codes(self.rows.column(0))
        self.plans = plans
        self.kind = self.rows.column(3).to_numpy(zero_copy_only=False)

    def number(self) -> None:
        """Nodes are (plan, task number); ``at`` is a row's task, ``to`` what it needs."""
        n = self.rows.num_rows
        values, null = _codes(pa.concat_arrays([self.rows.column(1), self.rows.column(2)]))
        nodes, places = np.unique(np.tile(self.plan, 2) * (null + 1) + values, return_inverse=True)
        self.nodes, self.of_plan, self.nulls = len(nodes), nodes // (null + 1), nodes % (null + 1) == null
        self.at, self.to = places[:n], places[n:]
        self.is_task, self.is_edge = self.kind == TASK, self.kind == DEPENDENCY
        self.known = np.zeros(self.nodes, bool)
        self.known[self.at[self.is_task]] = True

    def layers(self, edges: np.ndarray) -> np.ndarray:
        """The layer of each node by the rows ``edges``, -1 for none. A null is no task and meets nothing."""
        task, needs = self.at[edges], self.to[edges]
        waiting = np.bincount(task, minlength=self.nodes)
        layer = np.full(self.nodes, -1)
        current = np.flatnonzero(self.known & ~self.nulls & (waiting == 0))
        depth = 0
        while len(current):
            layer[current] = depth
            met = layer[needs] == depth
            touched = task[met]
            waiting -= np.bincount(touched, minlength=self.nodes)
            task, needs = task[~met], needs[~met]
            touched = np.unique(touched)
            current = touched[(waiting[touched] == 0) & ~self.nulls[touched]]
            depth += 1
        return layer

    def reached(self, starts: np.ndarray) -> np.ndarray:
        """start * nodes + node of all nodes that ``starts`` need at any distance, themselves included; ascending."""
        edges = np.flatnonzero(self.is_edge)
        edges = edges[np.argsort(self.at[edges], kind="stable")]
        to, first = self.to[edges], np.searchsorted(self.at[edges], np.arange(self.nodes + 1))
        frontier = found = np.unique(starts) * (self.nodes + 1)
        while len(frontier):
            start, at = np.divmod(frontier, self.nodes)
            sizes = first[at + 1] - first[at]
            place = np.arange(sizes.sum()) + np.repeat(first[at] - np.cumsum(sizes) + sizes, sizes)
            frontier = np.setdiff1d(np.repeat(start, sizes) * self.nodes + to[place], found)
            found = np.union1d(found, frontier)
        return found


def _firsts(values: np.ndarray) -> np.ndarray:
    return np.sort(np.unique(values, return_index=True)[1])


def layer_rows(graphs: Graphs) -> pa.RecordBatch:
    """(plan_id, task_no, layer) of the tasks."""
    graphs.number()
    layer = graphs.layers(graphs.is_edge)
    tasks = np.flatnonzero(graphs.is_task)
    tasks = tasks[_firsts(graphs.at[tasks])]
    own = layer[graphs.at[tasks]]
    rows = graphs.rows.take(pa.array(tasks))
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(own, pa.int64(), mask=own < 0)], names=[*KEY, "layer"])


def verdict_rows(graphs: Graphs) -> pa.RecordBatch:
    """(plan_id, task_no, needs, verdict) of the proposed dependencies, none of which has a null."""
    graphs.number()
    n = graphs.nodes
    rows = np.flatnonzero(graphs.kind == PROPOSED)
    rows = rows[_firsts(graphs.at[rows] * n + graphs.to[rows])]
    task, needs = graphs.at[rows], graphs.to[rows]
    held = np.isin(task * n + needs, graphs.at[graphs.is_edge] * n + graphs.to[graphs.is_edge])
    cases = [(task == needs, "self"), (~graphs.known[task], "unknown-task"), (~graphs.known[needs], "unknown-needs"), (held, "exists")]
    open_ = ~np.logical_or.reduce([c for c, _ in cases])
    cases.append((open_ & np.isin(needs * n + task, graphs.reached(needs[open_])), "cycle"))
    verdict = np.select([c for c, _ in cases], [v for _, v in cases], "ok")
    out = graphs.rows.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(verdict.tolist(), pa.string())], names=[*KEY, "needs", "verdict"])


def fault_rows(graphs: Graphs) -> pa.RecordBatch:
    """(plan_id, tasks, most, unknown, cyclic): distinct tasks, rows of the most frequent one, whether an end of a dependency is no task, and whether a cycle holds a task up."""
    graphs.number()
    edges = np.flatnonzero(graphs.is_edge)
    known = graphs.known & ~graphs.nulls
    whole = known[graphs.at[edges]] & known[graphs.to[edges]]
    counts = np.bincount(graphs.at[graphs.is_task], minlength=graphs.nodes)
    most = np.zeros(graphs.plans, np.int64)
    np.maximum.at(most, graphs.of_plan, counts)
    flags = lambda places: np.bincount(places, minlength=graphs.plans) > 0
    unknown, stuck = flags(graphs.plan[edges[~whole]]), flags(graphs.of_plan[graphs.known & (graphs.layers(edges[whole]) < 0)])
    plan = graphs.rows.column(0).take(pa.array(_firsts(graphs.plan)))
    tasks = np.bincount(graphs.of_plan[graphs.known], minlength=graphs.plans)
    columns = [plan, pa.array(tasks, pa.int64(), mask=tasks == 0), pa.array(most, pa.int64(), mask=tasks == 0), pa.array(unknown), pa.array(stuck)]
    return pa.RecordBatch.from_arrays(columns, names=["plan_id", "tasks", "most", "unknown", "cyclic"])
