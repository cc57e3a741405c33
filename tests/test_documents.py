"""Contract documents against a plain loop, validation of JSON by path, matching blocks, import lists."""

from __future__ import annotations

import difflib
import json
import random

from pyspark.sql import functions as F

from siftwell.functions.imports import imported_modules
from siftwell.functions.similarity import close_names
from siftwell.operators.contract_document import contract_documents
from siftwell.operators.validation import CRITERION, DRAFT, ENTRY, INVARIANT, faults

CALL = "more; call get_requirement_contract / get_requirement_evidence"


def tokens(text):
    return (len(text) + 3) // 4


def plain_document(lines, close, unconfigured, budget):
    """Takes lines one by one while the whole document fits."""

    def built(kept, omitted, close=close):
        out = ["CONTRACT"]
        for kind, label in (("violation", "Violations"), ("must", "Must"), ("must_not", "Must not")):
            own = [x for k, x in kept if k == kind]
            out += [f"{label}: " + "; ".join(own)] if own else []
        out += [f"+{omitted} {CALL}"] if omitted else []
        return "\n".join(out) + "\n\n" + close

    kept = []
    for k, (kind, line) in enumerate(lines):
        if tokens(built([*kept, (kind, line)], len(lines) - k - 1)) <= budget:
            kept.append((kind, line))
            continue
        if not kept:
            for b in range(budget, 0, -1):
                cut = line if tokens(line) <= b else "" if b * 4 <= 1 else line[: b * 4 - 1].rstrip(" ") + "…"
                if cut and tokens(built([(kind, cut)], len(lines) - 1)) <= budget:
                    kept.append((kind, cut))
                    break
        break
    if kept:
        return built(kept, len(lines) - len(kept)), len(lines) - len(kept), len(lines) > len(kept)
    text = built([], max(1, len(lines)))
    return text if tokens(text) <= budget else built([], max(1, len(lines)), unconfigured), len(lines), True


def test_contract_documents_equal_a_plain_loop(spark):
    draw = random.Random(6)
    lines, closing, plain = [], [], {}
    for r in range(150):
        own = [(draw.choice(["violation", "must", "must_not"]), "".join(draw.choice("ab  ") for _ in range(draw.choice([3, 10, 40, 300]))).strip() or "x") for _ in range(draw.randint(0, 14))]
        close = "CLOSE " + "z" * draw.choice([2, 30, 200])
        lines += [(r, k, kind, line) for k, (kind, line) in enumerate(own)]
        closing.append((r, close))
        plain[r] = (own, close)
    rows = spark.createDataFrame(lines, "requirement_id int, place int, kind string, line string")
    ends = spark.createDataFrame(closing, "requirement_id int, close string")
    for budget in (20, 33, 60, 120):
        got = {r.requirement_id: (r.document, r.omitted, r.truncated) for r in contract_documents(rows, ends, "none", budget).collect()}
        assert got == {r: plain_document(own, close, "none", budget) for r, (own, close) in plain.items()}


def test_validation_lists_every_fault_by_path(spark):
    task = {"local_task_id": "a", "title": "T", "objective": "O"}
    draft = {"title": "T", "goal": "G", "tasks": [task]}
    cases = [
        (DRAFT, draft, []),
        (DRAFT, draft | {"notes": None, "dependencies": None}, []),
        (DRAFT, {}, ["$.title: missing", "$.goal: missing", "$.tasks: missing"]),
        (DRAFT, [1], ["$: type"]),
        (DRAFT, draft | {"b": 1, "a": 2, "title": " " * 5, "goal": "g" * 8001}, ["$.title: empty", "$.goal: too_long", "$.a: unknown", "$.b: unknown"]),
        (DRAFT, draft | {"tasks": [task, task | {"x": 1}, 3]}, ["$.tasks: repeated", "$.tasks[1].x: unknown", "$.tasks[2]: type"]),
        (DRAFT, draft | {"tasks": [task | {"linked_files": ["ok/a.py", "../b", "", "a//b"]}]}, [f"$.tasks[0].linked_files[{k}]: {w}" for k, w in ((1, "path"), (2, "empty"), (3, "path"))]),
        (DRAFT, draft | {"tasks": [task | {"local_task_id": f"t{k}"} for k in range(31)]}, ["$.tasks: too_many"]),
        (DRAFT, draft | {"dependencies": [{"task_local_id": "a", "depends_on_local_id": "b"}, {"task_local_id": "a"}]}, ["$.dependencies[1].depends_on_local_id: missing", "$.dependencies: dangling"]),
        (ENTRY, {"section": "bugs", "headline": "h", "status": "open", "priority": 3}, []),
        (ENTRY, {"section": "x", "headline": 5, "status": "gone", "priority": 101, "requirement_status": True}, ["$.section: choice", "$.headline: type", "$.status: choice", "$.requirement_status: type", "$.priority: range"]),
        (ENTRY, {"section": "bugs", "headline": "h", "status": "open", "priority": 1.5}, ["$.priority: type"]),
        (INVARIANT, {"statement": "s", "kind": "behavior", "risk": "critical"}, ["$.risk: choice"]),
        (CRITERION, {"statement": "s", "evidence_kind": "test", "required": "yes"}, ["$.required: type"]),
    ]
    for rule in {id(r): r for r, _, _ in cases}.values():
        own = [(json.dumps(doc), want) for r, doc, want in cases if r is rule] + [("{", ["$: json"])]
        rows = spark.createDataFrame([(k, d) for k, (d, _) in enumerate(own)], "k int, d string")
        got = {r.k: r.f for r in rows.select("k", faults(F.col("d"), rule).alias("f")).collect()}
        for k, (doc, want) in enumerate(own):
            assert sorted(got[k]) == sorted(want), doc


def test_close_names_equal_the_standard_matcher(spark):
    draw = random.Random(9)
    names = sorted({"/".join("".join(draw.choice("abcd_") for _ in range(draw.randint(1, 6))) for _ in range(draw.randint(1, 3))) + draw.choice([".py", ".ts", ""]) for _ in range(300)})
    rows = spark.createDataFrame([(n,) for n in [*names, None, ""]], "path string")
    for word in ("ab/cd_a.py", "dddd", names[7], "zz", "a_b/a_b/a_b.ts"):
        got = [r.path for r in close_names(rows, "path", word).collect()]
        assert got == difflib.get_close_matches(word, names, n=5, cutoff=0.4)


def test_import_lists(spark):
    cases = {
        ("python", "import os, sys as s, a.b\nfrom .x import (y,\n z)\nfrom here we go\n'''\nimport no\n'''\n# import no\n  import late # import no\n"): ["os", "sys", "a.b", ".x", "late"],
        ("rust", "use a::{b, c::{d, e as f}, g::*};\npub(crate) use h;\n// use no;\n/* use no::x; */ use i::{self, j};\n"): ["a::b", "a::c::d", "a::c::e", "a::g::*", "h", "i", "i::j"],
        ("go", 'import (\n  "fmt"\n  // "no"\n  x "net/http"\n)\nimport "os"\n'): ["os", "fmt", "net/http"],
        ("java", "/* import no.No; */\nimport static a.B.*;\nimport c.D;\n"): ["a.B.*", "c.D"],
        ("prose", "import os"): [],
    }
    rows = spark.createDataFrame([(k, lang, text) for k, (lang, text) in enumerate(cases)], "k int, lang string, text string")
    got = {r.k: r.m for r in rows.select("k", imported_modules(F.col("lang"), F.col("text")).alias("m")).collect()}
    for k, want in enumerate(cases.values()):
        assert got[k] == want
