"""One stream for each project, each failing and restarting on its own.

A listener hears of queries that end; ``tend`` starts the failed ones again when their pause is over. The pause doubles with each
failure in a row, up to ``longest``, and is forgotten after a stream has made progress. A project that fails more than ``attempts`` times in
a row is given up and says so in ``states``; the others never notice.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


@dataclass
class Entry:
    begin: Callable[[], StreamingQuery]
    query: StreamingQuery | None = None
    failures: int = 0
    due: float | None = None  #: when it is started again
    error: str | None = None
    stopping: bool = False


class _Listener(StreamingQueryListener):
    def __init__(self, registry: ProjectStreams):
        self.registry = registry

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows > 0:
            self.registry.progressed(str(event.progress.id))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.registry.ended(str(event.id), event.exception)


class ProjectStreams:
    def __init__(self, spark: SparkSession, pause: float = 1.0, longest: float = 300.0, attempts: int = 10, clock: Callable[[], float] = time.monotonic):
        self.spark, self.pause, self.longest, self.attempts, self.clock = spark, pause, longest, attempts, clock
        self._entries: dict[str, Entry] = {}
        self._by_id: dict[str, str] = {}
        self._lock = threading.RLock()
        self._listener = _Listener(self)
        spark.streams.addListener(self._listener)

    def start(self, project: str, begin: Callable[[], StreamingQuery]) -> None:
        """Starts a project's stream; ``begin`` is called again after each failure and must resume from its checkpoint."""
        with self._lock:
            old = self._entries.get(project)
            if old and old.query and old.query.isActive:
                raise ValueError(f"{project} is running")
            self._entries[project] = Entry(begin)
            self._launch(project)

    def _launch(self, project: str) -> None:
        entry = self._entries[project]
        entry.due = None
        try:
            entry.query = entry.begin()
        except Exception as error:  # a stream that can't be started counts as one that failed
            self._failed(entry, str(error))
            return
        self._by_id[str(entry.query.id)] = project

    def _failed(self, entry: Entry, error: str) -> None:
        entry.failures += 1
        entry.error = error
        entry.query = None
        entry.due = None if entry.failures > self.attempts else self.clock() + min(self.longest, self.pause * 2 ** (entry.failures - 1))

    def progressed(self, query_id: str) -> None:
        with self._lock:
            if entry := self._entries.get(self._by_id.get(query_id, "")):
                entry.failures, entry.error = 0, None

    def ended(self, query_id: str, error: str | None) -> None:
        with self._lock:
            entry = self._entries.get(self._by_id.get(query_id, ""))
            if entry and entry.query is not None and str(entry.query.id) == query_id and error and not entry.stopping:
                self._failed(entry, error)

    def tend(self) -> list[str]:
        """Starts what is due; returns the projects."""
        with self._lock:
            due = [p for p, e in self._entries.items() if e.due is not None and e.due <= self.clock() and not e.stopping]
            for project in due:
                self._launch(project)
            return due

    def states(self) -> dict[str, str]:
        """running, waiting (for its next start), given_up or stopped, by project."""
        with self._lock:
            return {p: "stopped" if e.stopping else "waiting" if e.due is not None else "running" if e.query is not None and e.query.isActive else "given_up" if e.failures else "stopped" for p, e in self._entries.items()}

    def stop(self, project: str) -> None:
        with self._lock:
            entry = self._entries[project]
            entry.stopping, entry.due = True, None
        if entry.query is not None:
            entry.query.stop()

    def stop_all(self) -> None:
        for project in list(self._entries):
            self.stop(project)
        self.spark.streams.removeListener(self._listener)
