"""Task leases as keyed streaming state with timers.

Commands (task, seq, at, op, token, actor, status, lease) stream in; each task's state is its status, the holder's token hash, who claimed
it and when the lease ends. A timer ends a lease in event time, so a task becomes claimable without anybody asking. The
result is an event log: one row for each accepted command, each rejected one with the reason, and each lease that ran out.

Row locks have no counterpart on a cluster: a task's commands are applied in the order of (at, seq), those of one micro-batch are sorted,
and a command older than the last one applied is rejected as ``late``. A lease that ends at or before a command's time has
ended for it, whether or not its timer has fired yet; the log is the same either way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

COMMANDS = "task string, seq long, at timestamp, op string, token string, actor string, status string, lease long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"



def _struct(**kinds) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


_S, _L = StringType(), LongType()
EVENTS = _struct(task=_S, seq=_L, at=_L, event=_S, old_status=_S, new_status=_S, actor=_S, reason=_S, until=_L)
STATE = _struct(status=_S, holder=_S, claimed_by=_S, until=_L, ended=BooleanType(), last_at=_L, last_seq=_L)

#: Task statuses, and the bounds of a lease in seconds.
STATUSES = ("pending", "ready", "claimed", "in_progress", "blocked", "in_review", "completed", "cancelled")
HELD, CLOSED = ("claimed", "in_progress", "in_review"), ("completed", "cancelled")
LEASE, LEAST_LEASE, MOST_LEASE = 1800, 30, 86_400
#: The statuses from which a status may be set.
FROM = {"in_progress": ("claimed",), "in_review": ("in_progress",), "blocked": ("claimed", "in_progress"), "ready": ("blocked",)}


class Task(NamedTuple):
    status: str = "ready"
    holder: str | None = None
    claimed_by: str | None = None
    until: int | None = None  #: microseconds
    ended: bool = False  #: the end of the lease is in the log
    last_at: int = -(1 << 62)
    last_seq: int = -(1 << 62)


def _hash(token: str | None) -> str | None:
    return hashlib.sha256(token.encode()).hexdigest() if token else None


def decide(task: Task, at: int, op: str, token: str | None, actor: str | None, status: str | None, lease: int | None) -> tuple[Task, str, str | None]:
    """(the task after a command, the event, why it was rejected)."""
    no = lambda why: (task, "rejected", why)
    lease = LEASE if lease is None else lease
    live = task.holder is not None and task.until > at
    over = task.until is not None and task.until <= at
    free = {"holder": None, "claimed_by": None, "until": None, "ended": False}
    if op == "create":
        return (task._replace(status=status or "pending"), "created", None) if task.last_seq == Task().last_seq else no("exists")
    if op == "unlock":
        return (task._replace(status="ready"), "status_changed", None) if task.status == "pending" else no("not_pending")
    if op == "claim":
        if not LEAST_LEASE <= lease <= MOST_LEASE:
            return no("lease_bounds")
        if not (actor or "").strip() or not token:
            return no("no_claimant")
        if task.status in HELD and not live:
            return task._replace(status="claimed", holder=_hash(token), claimed_by=actor.strip(), until=at + lease * 1_000_000, ended=False), "reclaimed", None
        if task.status == "ready":
            return task._replace(status="claimed", holder=_hash(token), claimed_by=actor.strip(), until=at + lease * 1_000_000, ended=False), "claimed", None
        return no("conflict" if task.status in HELD else f"status_{task.status}")
    if op in ("heartbeat", "release"):
        if task.holder is None or not live:
            return no("expired" if over else "no_lease")
        if _hash(token) != task.holder:
            return no("token")
        if op == "heartbeat":
            return (task._replace(until=at + lease * 1_000_000), "heartbeat", None) if LEAST_LEASE <= lease <= MOST_LEASE else no("lease_bounds")
        return (task._replace(status="ready", **free), "released", None) if task.status in HELD[:2] else no(f"status_{task.status}")
    if op not in ("set_status", "complete"):
        return no("op")
    wanted = "completed" if op == "complete" else status
    if wanted not in STATUSES:
        return no("status")
    if wanted == "completed" and task.status not in HELD:
        return no(f"status_{task.status}")
    if live and _hash(token) != task.holder:
        return no("token" if token else "token_needed")
    if over and not live and token:
        return no("expired")
    if wanted == "completed":
        if over and task.status != "in_review":
            return no("expired")
        return task._replace(status="completed", **free | {"claimed_by": actor}), "completed", None
    if wanted == task.status:
        return task, "status_changed", None
    if wanted == "cancelled":
        return (task._replace(status="cancelled", **free), "cancelled", None) if task.status not in CLOSED else no(f"status_{task.status}")
    if task.status not in FROM.get(wanted, ()):
        return no(f"status_{task.status}")
    return task._replace(status=wanted, **(free if wanted == "blocked" else {})), "status_changed", None


class Leases(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", STATE)

    def _load(self) -> Task:
        held = self.state.get()
        return Task(*held) if held is not None else Task()

    def _ended(self, name: str, task: Task) -> Row:
        return Row(task=name, seq=None, at=task.until, event="expired", old_status=task.status, new_status=task.status, actor=task.claimed_by, reason=None, until=task.until)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (name,) = key
        task = before = self._load()
        # one micro-batch's commands of one task
        for r in sorted(rows, key=lambda r: (r.micros, r.seq)):
            at = r.micros
            if task.holder is not None and not task.ended and task.until <= at:
                yield self._ended(name, task)
                task = task._replace(ended=True)
            if (at, r.seq) <= (task.last_at, task.last_seq):
                new, event, why = task, "rejected", "late"
            else:
                new, event, why = decide(task, at, r.op, r.token, r.actor, r.status, r.lease)
                new = new._replace(last_at=at, last_seq=r.seq)
            actor = r.actor if r.actor is not None else task.claimed_by
            yield Row(task=name, seq=r.seq, at=at, event=event, old_status=task.status, new_status=new.status, actor=actor, reason=why, until=new.until)
            task = new
        self._keep(before, task)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        task = self._load()
        if task.holder is not None and not task.ended and task.until <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            yield self._ended(key[0], task)
            self.state.update(tuple(task._replace(ended=True)))

    def _keep(self, before: Task, task: Task) -> None:
        old, new = (_millis(t.until) if t.holder is not None and not t.ended else None for t in (before, task))
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        self.state.update(tuple(task))

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The timer's time: not before the lease's end."""
    return -(-micros // 1000)


def lease_events(commands: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """The event log of a command stream; commands may come up to ``delay`` out of order between micro-batches."""
    rows = commands.withWatermark("at", delay).withColumn("micros", F.unix_micros("at")).groupBy("task")
    events = rows.transformWithState(Leases(), EVENTS, "Append", "EventTime")
    return events.withColumns({"at": F.timestamp_micros("at"), "until": F.timestamp_micros("until")})


def run_leases(spark: SparkSession, inbox: str, out: str, checkpoint: str, delay: str = "10 seconds", once: bool = False):
    """Starts the stream from JSON lines in ``inbox`` to Parquet in ``out``; the session's state store becomes RocksDB, which timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    commands = spark.readStream.schema(COMMANDS).json(inbox)
    writer = lease_events(commands, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_tasks(events: DataFrame) -> DataFrame:
    """(task, status, until) by the last event of each task that was not rejected."""
    last = F.max_by(F.struct("new_status", "until"), F.struct("at", F.coalesce("seq", F.lit(-(1 << 62))), F.col("event") != "expired"))
    return events.where("event <> 'rejected'").groupBy("task").agg(last.alias("x")).select("task", F.col("x.new_status").alias("status"), F.col("x.until").alias("until"))
