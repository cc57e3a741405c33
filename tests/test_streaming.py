"""Leases as streaming state against a plain replay, over a restart; project streams that fail and restart on their own; the watch stream."""

from __future__ import annotations

import datetime
import json
import random
import time

from siftwell.operators.reindex import full_index
from siftwell.sources.snapshot import SnapshotStore
from siftwell.streaming.leases import current_tasks, run_leases
from siftwell.streaming.registry import ProjectStreams
from siftwell.streaming.watch import compact, current_chunks, snapshot_batch, watch, watch_index

DAY = datetime.datetime(2024, 5, 1)


def plain_replay(commands):
    """The event log by a plain loop: (task, seq, event, old, new, reason)."""
    log, tasks = [], {}
    for c in sorted(commands, key=lambda c: (c["task"], c["at"], c["seq"])):
        t = tasks.setdefault(c["task"], {"status": "ready", "token": None, "until": None, "ended": False, "seen": False})
        at, token, lease, old = c["at"], c["token"], c["lease"] or 1800, t["status"]
        live = t["token"] is not None and t["until"] > at
        over = t["until"] is not None and t["until"] <= at
        if t["token"] is not None and over and not t["ended"]:
            log.append((c["task"], None, "expired", old, old, None))
            t["ended"] = True
        why, event = None, None
        held = old in ("claimed", "in_progress", "in_review")

        def free(t=t):
            t.update(token=None, until=None, ended=False)

        if c["op"] == "create":
            if t["seen"]:
                why = "exists"
            else:
                event, t["status"] = "created", c["status"] or "pending"
        elif c["op"] == "unlock":
            if old == "pending":
                event, t["status"] = "status_changed", "ready"
            else:
                why = "not_pending"
        elif c["op"] == "claim":
            if not 30 <= lease <= 86400:
                why = "lease_bounds"
            elif held and live:
                why = "conflict"
            elif held or old == "ready":
                event = "reclaimed" if held else "claimed"
                t.update(status="claimed", token=token, until=at + datetime.timedelta(seconds=lease), ended=False)
            else:
                why = f"status_{old}"
        elif c["op"] in ("heartbeat", "release"):
            if not live:
                why = "expired" if over else "no_lease"
            elif token != t["token"]:
                why = "token"
            elif c["op"] == "heartbeat":
                event, t["until"] = "heartbeat", at + datetime.timedelta(seconds=lease)
            elif old == "in_review":
                why = f"status_{old}"
            else:
                event, t["status"] = "released", "ready"
                free()
        else:
            wanted = "completed" if c["op"] == "complete" else c["status"]
            allowed = {"in_progress": ["claimed"], "in_review": ["in_progress"], "blocked": ["claimed", "in_progress"], "ready": ["blocked"]}
            if wanted == "completed" and not held:
                why = f"status_{old}"
            elif live and token != t["token"]:
                why = "token" if token else "token_needed"
            elif over and token:
                why = "expired"
            elif wanted == "completed":
                if over and old != "in_review":
                    why = "expired"
                else:
                    event, t["status"] = "completed", "completed"
                    free()
            elif wanted == old:
                event = "status_changed"
            elif wanted == "cancelled":
                if old in ("completed", "cancelled"):
                    why = f"status_{old}"
                else:
                    event, t["status"] = "cancelled", "cancelled"
                    free()
            elif old in allowed.get(wanted, []):
                event, t["status"] = "status_changed", wanted
                if wanted == "blocked":
                    free()
            else:
                why = f"status_{old}"
        t["seen"] = True
        log.append((c["task"], c["seq"], event or "rejected", old, t["status"], why))
    return log, {k: t["status"] for k, t in tasks.items()}


def write(path, commands):
    path.write_text("".join(json.dumps(c | {"at": c["at"].strftime("%Y-%m-%dT%H:%M:%S.000Z")}) + "\n" for c in commands))


def test_leases_equal_a_plain_replay_over_a_restart(spark, tmp_path):
    draw = random.Random(8)
    ops = ["claim"] * 4 + ["heartbeat", "release", "complete", "set_status", "set_status", "create", "unlock"]
    commands = []
    for seq in range(400):
        commands.append({
            "task": f"t{draw.randrange(12)}", "seq": seq, "at": DAY + datetime.timedelta(seconds=seq * 40), "op": draw.choice(ops), "token": draw.choice(["a", "b", "a", None]),
            "actor": "ann", "status": draw.choice(["in_progress", "in_review", "blocked", "ready", "cancelled", "completed"]), "lease": draw.choice([None, 30, 60, 200, 1800, 5]),
        })
    commands = [c for c in commands if c["op"] != "claim" or c["token"]]
    for c in commands:
        if c["op"] == "create":
            c["status"] = draw.choice(["pending", "ready"])
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    inbox.mkdir()
    for part in range(3):
        own = commands[part * 140 : (part + 1) * 140]
        draw.shuffle(own)
        write(inbox / f"{part}.json", own)
        # each run starts from the checkpoint of the last
        run_leases(spark, str(inbox), out, check, once=True).awaitTermination()
    last = {"task": "zz", "seq": 1000, "at": DAY + datetime.timedelta(days=2), "op": "claim", "token": "z", "actor": "z", "status": None, "lease": None}
    write(inbox / "last.json", [last])
    run_leases(spark, str(inbox), out, check, once=True).awaitTermination()
    events = spark.read.parquet(out)
    got = [(r.task, r.seq, r.event, r.old_status, r.new_status, r.reason) for r in events.collect()]
    want, status = plain_replay(commands)
    key = lambda x: tuple(map(str, x))
    # leases without a later command of their task are ended by the timer alone
    extra = sorted(x for x in got if x[2] == "expired")
    assert sorted((x for x in got if x[2] != "expired" and x[0] != "zz"), key=key) == sorted((x for x in want if x[2] != "expired"), key=key)
    asked = sorted(x for x in want if x[2] == "expired")
    assert all(extra.count(x) >= asked.count(x) for x in asked) and len(extra) > len(asked)
    live = [r for r in events.collect() if r.event in ("claimed", "reclaimed", "heartbeat")]
    assert len(extra) <= len(live)
    assert {r.task: r.status for r in current_tasks(events).collect() if r.task != "zz"} == {k: v for k, v in status.items() if any(x[0] == k and x[2] != "rejected" for x in got)}


def wait_for(condition, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.2)
    assert condition()


def test_project_streams_fail_and_restart_alone(spark, tmp_path):
    now = [0.0]
    streams = ProjectStreams(spark, pause=10.0, attempts=3, clock=lambda: now[0])
    seen, broken = {"good": 0, "bad": 0}, [True]

    def begin(name):
        def batch(df, k):
            n = df.count()
            if name == "bad" and broken[0]:
                raise RuntimeError("broken project")
            seen[name] += n

        (tmp_path / name).mkdir(exist_ok=True)
        rows = spark.readStream.schema("v long").json(str(tmp_path / name))
        return lambda: rows.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(processingTime="200 milliseconds").start()

    for name in ("good", "bad"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text('{"v": 1}\n')
        streams.start(name, begin(name))
    wait_for(lambda: seen["good"] == 1 and streams.states()["bad"] == "waiting")
    assert streams.tend() == [] and streams.states()["good"] == "running"
    now[0] = 11.0
    assert streams.tend() == ["bad"]
    wait_for(lambda: streams.states()["bad"] == "waiting")
    now[0] = 25.0
    assert streams.tend() == []  # the second pause is twice as long
    (tmp_path / "good" / "2.json").write_text('{"v": 1}\n{"v": 2}\n')
    wait_for(lambda: seen["good"] == 3)
    broken[0], now[0] = False, 40.0
    assert streams.tend() == ["bad"]
    wait_for(lambda: seen["bad"] == 1 and streams.states() == {"good": "running", "bad": "running"})

    def cannot():
        raise OSError("no such folder")

    streams.start("none", cannot)
    for _ in range(4):
        now[0] += 1000
        streams.tend()
    assert streams.states()["none"] == "given_up" and streams.states()["good"] == "running"
    streams.stop_all()
    assert set(streams.states().values()) == {"stopped"} and not spark.streams.active


def test_watch_keeps_tombstones_and_breaks_ties(spark, tmp_path):
    inbox, out, check = tmp_path / "inbox", str(tmp_path / "out"), str(tmp_path / "ck")
    inbox.mkdir()

    def drop(name, *rows):
        (inbox / name).write_text("".join(json.dumps(dict(zip(("path", "content", "version"), r, strict=True))) + "\n" for r in rows))
        watch(spark, str(inbox), out, check, 2, once=True).awaitTermination()

    drop("1.json", ("a", "one\ntwo\nthree", 1), ("b", "x", 1))
    drop("2.json", ("a", "again", 1), ("b", None, 2))
    assert [(r.path, r.content) for r in current_chunks(spark, out).collect()] == [("a", "again")]
    to = str(tmp_path / "compact")
    compact(spark, out, to)
    inbox2 = tmp_path / "inbox2"
    inbox2.mkdir()
    (inbox2 / "3.json").write_text('{"path": "b", "content": "late", "version": 1}\n')
    watch(spark, str(inbox2), to, str(tmp_path / "ck2"), 2, once=True).awaitTermination()
    assert [(r.path, r.content) for r in current_chunks(spark, to).collect()] == [("a", "again")]


def test_watched_snapshot_index_equals_a_full_one(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    stores = [SnapshotStore(spark, f"file://{tmp_path}/{n}", 4) for n in ("watched", "full")]

    def drop(name, *rows):
        (inbox / name).write_text("".join(json.dumps(dict(zip(("path", "content", "version"), r, strict=True))) + "\n" for r in rows))
        watch_index(spark, str(inbox), stores[0], str(tmp_path / "ck"), 2, once=True).awaitTermination()

    drop("1.json", ("a.py", "import os\nx = 1\ny = 2", 1), ("b.py", "import sys", 1), ("c.py", "z", 1), ("a.py", "older", 0))
    drop("2.json", ("b.py", None, 3), ("c.py", "import re, json\n", 2))
    drop("3.json", ("b.py", "late", 2), ("c.py", "older", 1), ("d.py", "new", 1))
    full_index(stores[1], spark.createDataFrame([("a.py", "import os\nx = 1\ny = 2"), ("c.py", "import re, json\n"), ("d.py", "new")], "path string, content string"), 2)
    for table, names in {"chunks": ["path", "start_line", "content"], "imports": ["src", "module"], "symbols": ["path", "name", "line"]}.items():
        one, two = (sorted(map(tuple, s.read(table).select(*names).collect())) for s in stores)
        assert one == two and one
    assert {r.path: r.version for r in stores[0].read("versions").collect()} == {"a.py": 1, "b.py": 3, "c.py": 2, "d.py": 1}
    before = stores[0].manifest()["version"]
    snapshot_batch(stores[0], 2)(spark.createDataFrame([("b.py", "late", 2)], "path string, content string, version long"), 9)
    assert stores[0].manifest()["version"] == before
