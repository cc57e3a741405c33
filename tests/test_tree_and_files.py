"""The two-phase tree scan, requirement files written back, and documents put in place."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import guide, writeback
from siftwell.operators.scan import scanned
from siftwell.sources import tree
from siftwell.sources.sinks import append_log, write_document, write_files


def make(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body if isinstance(body, bytes) else body.encode())


def test_nested_ignore_files_decide_before_any_read(spark, tmp_path):
    make(tmp_path, {
        ".gitignore": "*.log\n/only_root.txt\n", "a.log": "x", "only_root.txt": "x", "src/.gitignore": "!keep.log\ngen/\n*.tmp\n", "src/keep.log": "x", "src/b.log": "x", "src/only_root.txt": "x",
        "src/gen/c.py": "x", "src/gen/.gitignore": "!c.py\n", "src/deep/d.tmp": "x", "src/deep/.gitignore": "!d.tmp\n/e.py\n", "src/deep/e.py": "x", "src/deep/more/e.py": "x",
        "other/f.tmp": "x", "node_modules/g.js": "x", "odd [name] {x}.py": "import os\n", "bin.dat": b"a\0b", "bad.txt": b"\xff\xfe", "big.txt": "x" * 5000,
    })
    got = {r.path: (r.skip_reason, r.content) for r in tree.read_tree(spark, str(tmp_path), max_bytes=4000).collect()}
    ignored = {p for p, (why, _) in got.items() if why == "ignored"}
    assert ignored == {"a.log", "only_root.txt", "src/b.log", "src/gen/c.py", "src/deep/e.py", "node_modules/g.js"}
    assert got["big.txt"][0] == "too_large" and got["bin.dat"][0] == "binary" and got["bad.txt"][0] == "binary"
    assert {p for p, (why, _) in got.items() if why is None} == {"src/keep.log", "src/only_root.txt", "src/deep/d.tmp", "src/deep/more/e.py", "other/f.tmp", "odd [name] {x}.py"}
    assert got["odd [name] {x}.py"][1] == "import os\n"
    some = {r.path for r in tree.read_tree(spark, str(tmp_path), max_bytes=4000, allow=["src/**"]).where("skip_reason IS NULL").collect()}
    assert some == {"src/keep.log", "src/only_root.txt", "src/deep/d.tmp", "src/deep/more/e.py"}


def test_large_files_are_never_read(spark, tmp_path):
    make(tmp_path, {"a.py": "x = 1\n"})
    with open(tmp_path / "huge.py", "wb") as f:  # a sparse file over what one value can hold
        f.truncate(3 << 30)
    os.makedirs(tmp_path / "node_modules")
    with open(tmp_path / "node_modules" / "huge.js", "wb") as f:
        f.truncate(3 << 30)
    got = {r.path: r.skip_reason for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.py": None, "huge.py": "too_large", "node_modules/huge.js": "ignored"}


def test_files_that_go_between_the_phases_are_unreadable(spark, tmp_path, monkeypatch):
    make(tmp_path, {"a.py": "x = 1\n", "b.py": "y = 1\n"})
    read = tree.contents

    def later(spark, files):
        (tmp_path / "b.py").unlink(missing_ok=True)
        return read(spark, files)

    monkeypatch.setattr(tree, "contents", later)
    assert {r.path: r.skip_reason for r in tree.read_tree(spark, str(tmp_path)).collect()} == {"a.py": None, "b.py": "unreadable"}


def test_paths_outside_the_root(spark):
    paths = spark.createDataFrame([("a/../b.py", 1), ("../c.py", 1), ("/etc/passwd", 1), ("./x//d.py", 1), ("~/e", 1)], "path string, size long")
    none = spark.createDataFrame([], "folder string, text string")
    got = {(r.path, r.skip_reason) for r in scanned(paths, none, ["d.py"], 10).collect()}
    assert got == {("b.py", None), ("../c.py", "outside_root"), ("/etc/passwd", "outside_root"), ("x/d.py", "ignored"), ("~/e", "outside_root")}


STORE = "file string, req_key string, title string, status string, prose string, archived boolean"


def parsed(spark, rows, store=None):
    found = writeback.blocks(writeback.file_lines(rows))
    return {(r.file, r.req_key): (r.title, r.status) for r in found.collect()}


def test_written_requirement_files_say_what_the_store_says(spark, tmp_path):
    draw = random.Random(4)
    files, store = [], []
    for k in range(12):
        lines = ["# Requirements", "", "intro  "]
        for n in range(draw.randint(0, 5)):
            key = f"R-{n + 1:03d}"
            keyed = draw.random() < 0.8
            lines.append(f"### {key} — Title {n}" if keyed else f"### Title {n}")
            if draw.random() < 0.7:
                lines += [""] * draw.randint(0, 1) + [f"<!-- req {draw.choice(['status=' + draw.choice(['done', 'blocked']), 'files=a.py', 'status=done files=a,b blocker=x'])} -->"]
            lines += ["  prose \t", "", "<!-- req status=no -->" if draw.random() < 0.3 else "more"]
            if keyed:
                store.append((f"f{k}", key, f"Title {n}", draw.choice(["done", "in-progress", "not-started"]), "", False))
        store += [(f"f{k}", "R-050", "New", "blocked", "\nbody\nlines\n", False), (f"f{k}", "R-051", "Old", "done", "", True)] * (k % 2)
        files.append((f"f{k}", "\n".join(lines) + "\n" * (k % 3)))
    f, s = spark.createDataFrame(files, "file string, content string"), spark.createDataFrame(store, STORE)
    once = writeback.written(f, s)
    new = {r.file: r.content for r in once.collect()}
    got = parsed(spark, once)
    for file, key, title, status, _, archived in store:
        assert ((file, key) in got) == (not archived) and (archived or got[file, key] == (title, status))
    assert all(key for _, key in got)
    # every other line stays byte for byte, in order
    for file, old in files:
        kept = [x for x in old.rstrip("\n").split("\n") if not x.startswith(("###", "<!--"))]
        it = iter(new[file].split("\n"))
        assert all(any(x == y for y in it) for x in kept)
    again = writeback.written(once.select("file", "content"), s)
    assert {r.file: r.content for r in again.collect()} == new
    assert again.where("changed").count() == 0
    write_files(once.where("changed").select("file", "content"), f"file://{tmp_path}")
    assert {p.name: p.read_text() for p in tmp_path.iterdir() if p.name[0] != "."} == {r.file: r.content for r in once.where("changed").collect()}


def test_document_is_assembled_in_order_and_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/guide.md"
    rows = spark.range(20_000).select("id", F.concat(F.lit("line é "), "id").alias("line")).repartition(7)
    for n in (20_000, 5):
        write_document(rows.where(F.col("id") < n), "line", ["id"], path)
        assert (tmp_path / "guide.md").read_text() == "".join(f"line é {i}\n" for i in range(n))
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"guide.md"}


def test_requirement_files_with_a_key_twice_are_refused(spark, tmp_path):
    make(tmp_path, {"a.md": "### R-001 — One\n\n### R-002 — Two\n", "b.md": "### R-001 — One\n### R-001 — Again\n"})
    assert [tuple(r) for r in tree.read_requirements(spark, str(tmp_path / "a.md")).collect()] == [("a.md", "### R-001 — One\n\n### R-002 — Two\n")]
    with pytest.raises(writeback.DuplicateKeys, match="R-001 in b.md"):
        tree.read_requirements(spark, [str(tmp_path / "a.md"), str(tmp_path / "b.md")])


def test_audit_log_keeps_estimates_instead_of_responses(spark, tmp_path):
    for k in (1, 2):
        append_log(spark.createDataFrame([(k, "search", "x" * 9)], "seq int, operation string, response string"), str(tmp_path / "log"), "response")
    got = sorted(tuple(r) for r in spark.read.schema("seq int, operation string, response_tokens long").json(str(tmp_path / "log")).collect())
    assert got == [(1, "search", 3), (2, "search", 3)] and "xxx" not in "".join(p.read_text() for p in (tmp_path / "log").glob("part-*"))


def test_guide_equals_a_plain_rendering(spark, tmp_path):
    draw = random.Random(3)
    names = sorted({f"{draw.choice(['src/', 'lib/', 'src-x/', ''])}m{draw.randrange(400)}.py" for _ in range(150)})
    files = [(n, draw.choice([None, "", "One line.  \n", "Two\n\nparagraphs"]), draw.choice([True, False, None]), names[: draw.randrange(3)], names[5 : 5 + draw.randrange(3)]) for n in names]
    lines = ["# Codebase Guide", "", guide.DO_NOT_EDIT, "", f"Coverage: documented {sum(bool(f[1]) for f in files)} / total {len(files)} · stale {sum(f[2] is True for f in files)}", ""]
    areas = {}
    for f in files:
        areas.setdefault(f[0].split("/")[0] if "/" in f[0] else ".", []).append(f)
    for area in sorted(areas):
        lines += [f"## {area}", ""]
        for path, summary, stale, imports, imported_by in sorted(areas[area]):
            lines += [f"### {path}", "", summary.rstrip() if summary else "_Undocumented._", ""]
            lines += [guide.STALE, ""] if stale else []
            lines += ["Imports: " + ", ".join(imports), ""] if imports else []
            lines += ["Imported by: " + ", ".join(imported_by), ""] if imported_by else []
    table = spark.createDataFrame(files, "path string, summary string, stale boolean, imports array<string>, imported_by array<string>").repartition(5)
    guide.write_guide(table, f"file://{tmp_path}/GUIDE.md")
    assert (tmp_path / "GUIDE.md").read_text() == "\n".join(lines).rstrip() + "\n"
    guide.write_guide(table.limit(0), f"file://{tmp_path}/GUIDE.md")
    assert (tmp_path / "GUIDE.md").read_text().endswith("Coverage: documented 0 / total 0 · stale 0\n")
