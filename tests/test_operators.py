"""Small hand-made cases: defined results for nulls, ties, empty tables, and invariants."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from siftwell.functions import paths
from siftwell.functions import text as T
from siftwell.functions.commands import generic_command
from siftwell.functions.embedding import embed_texts, hash_embedding
from siftwell.functions.grams import gram_pairs, gram_set
from siftwell.operators import codemap, contracts, ingest, plan_graphs, planning, savings, search, state, validation
from siftwell.plans.search import nearest_chunks
from siftwell.sources import sinks
from siftwell.sources.tree import ignore_lines, read_tree
from siftwell.streaming.watch import compact, current_chunks, watch


def test_trigram_similarity_has_its_published_value(spark):
    row = spark.createDataFrame([("word",), (None,), ("",)], "t string").select(F.round(T.similarity(F.col("t"), "two words"), 4)).collect()
    assert [r[0] for r in row] == [0.3636, 0.0, 0.0]


def test_fit_text_and_estimate(spark):
    d = spark.createDataFrame([("abcdefgh",), ("abcdefghi",), ("",), (None,)], "t string")
    got = d.select(T.fit_text(F.col("t"), 2), T.token_estimate(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("abcdefgh", 2), ("abcdefg…", 3), ("", 0), (None, 0)]


def test_ignore_and_tree(spark, tmp_path):
    for name, body in {"src/app.py": b"def a(): pass\n", "node_modules/x.js": b"1", "secret.env": b"k", "bin/data": b"a\0b", "big.txt": b"x" * 500, "bad.txt": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r["path"]: (r["skip_reason"], r["language"]) for r in read_tree(spark, str(tmp_path), ignore_lines("# no\nsecret.env\n"), 100).collect()}
    assert got == {
        "src/app.py": (None, "python"), "node_modules/x.js": ("ignored", None), "secret.env": ("ignored", None),
        "bin/data": ("binary", None), "big.txt": ("too_large", None), "bad.txt": ("binary", None),
    }


def test_windows_cover_every_line_once(spark):
    d = spark.createDataFrame([("p", "\n".join(map(str, range(1000))))], "path string, content string")
    got = ingest.line_windows(d, 80).orderBy("start_line").collect()
    assert len(got) == 13 and got[0].start_line == 1 and got[-1].end_line == 1000
    assert "\n".join(r.content for r in got) == "\n".join(map(str, range(1000)))


def test_nested_in_a_dropped_chunk_survives(spark):
    rows = [("f", 1, 10, "class", "A"), ("f", 2, 9, "class", "A"), ("f", 2, 9, "function", "b"), ("f", 3, 4, "function", "c")]
    d = spark.createDataFrame(rows, "path string, start_line long, end_line long, kind string, symbol string")
    got = {(r.start_line, r.kind) for r in ingest.drop_nested_chunks(d, "path").collect()}
    assert got == {(1, "class"), (2, "function"), (3, "function")}


def test_packing_stops_at_the_first_overflow(spark):
    d = spark.createDataFrame([(1, "a", 1, 2, "x" * 400), (2, "b", 1, 2, "x" * 4000), (3, "c", 1, 2, "x")], "rank long, path string, start_line long, end_line long, content string")
    assert [r["rank"] for r in search.pack(d, 300).collect()] == [1]
    trimmed = search.pack(d, 50).collect()
    assert [(r["rank"], r["trimmed"]) for r in trimmed] == [(1, True)] and trimmed[0]["used"] <= 50


def test_fusion_and_overlaps(spark):
    k = spark.createDataFrame([("a", 1, 9, 1, "exact"), ("b", 1, 9, 2, "fts")], "path string, start_line long, end_line long, rank long, mode string")
    s = k.where("path = 'b'").withColumn("rank", F.lit(1))
    assert [(r.path, r.label) for r in search.fuse(k, s, 10).collect()] == [("b", "hybrid"), ("a", "exact")]
    hits = spark.createDataFrame([(1, "a", 1, 10), (2, "a", 10, 20), (3, "a", 11, 30), (4, "b", 1, 2)], "rank long, path string, start_line long, end_line long")
    assert sorted(r["rank"] for r in search.without_overlaps(hits).collect()) == [1, 3, 4]


def test_fuzzy_join_equals_pairwise_similarity(spark):
    c = spark.createDataFrame([("a", 1, "the quick fox"), ("b", 1, "quick foxes"), ("c", 1, "")], "path string, start_line long, content string")
    q = spark.createDataFrame([(1, "quick fox")], "query_id long, query string")
    joined = {r.path: r.similarity for r in search.fuzzy_join(c, q, 0.0).collect()}
    direct = {r.path: r.s for r in c.select("path", F.round(T.similarity(F.col("content"), "quick fox"), 6).alias("s")).collect() if r.s > 0}
    assert joined == direct


def test_imports_resolve_by_fixed_order(spark):
    known = spark.createDataFrame([("src/a.ts",), ("src/a.js",), ("lib/pkg/mod.py",), ("other/pkg/mod.py",)], "path string")
    imports = spark.createDataFrame([("src/main.ts", "./a"), ("x.py", "pkg.mod"), ("x.py", "react")], "src string, module string")
    got = {r.module: r.dst for r in ingest.resolve_imports(imports, known).collect()}
    assert got == {"./a": "src/a.ts", "pkg.mod": "lib/pkg/mod.py", "react": ""}


def test_map_counts_edges_and_drops_self_edges(spark):
    e = spark.createDataFrame([("s/b/x", "s/p/y", "", "i"), ("s/b/z", "s/p/y", "", "i"), ("s/b/x", "s/b/z", "", "i"), ("m", "", "react", "i")], "src string, dst string, module string, kind string")
    assert [tuple(r) for r in codemap.node_edges(e, "s", 1).collect()] == [("s/b", "s/p", "i", 2)]
    assert ("m", "ext:react", "i", 1) in [tuple(r) for r in codemap.node_edges(e, external=True).collect()]


def test_layers_leave_cycles_out(spark):
    t = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0), (2, 1)], "plan_id long, task_no long")
    d = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 2, 0), (1, 3, 4), (1, 4, 3), (2, 1, 0)], "plan_id long, task_no long, needs long")
    got = {(r.plan_id, r.task_no): r.layer for r in planning.layers(t, d).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): None, (1, 4): None, (2, 0): 0, (2, 1): 1}


def test_saved_tokens_are_never_negative(spark):
    log = spark.createDataFrame([("r", 100, 1000), ("s", 50, 50), ("s", 80, 20)], "operation string, actual long, baseline long")
    got = {r.operation: (r.calls, r.saved_total) for r in savings.summary(log, overall=True).collect()}
    assert got == {"r": (1, 900), "s": (2, 0), "overall": (3, 900)}


def test_numbering_is_consecutive_and_free_keys(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = contracts.numbered(d, "v").collect()
    assert sorted((r.v, r.place) for r in got) == [(i, i + 1) for i in range(1000)]
    used = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 3)], "g string, n long")
    assert {r.g: r.free for r in contracts.first_free(used, "g", "n").collect()} == {"a": 3, "b": 1}


def test_generic_commands(spark):
    gates = [
        "uv run pytest -q", "sh -c 'just check'", 'bash -c "uv run pytest"', "PYTEST --cov", "py.test", "cargo build", "cargo clippy --all", "npm run test",
        "yarn test", "pnpm lint", "npm run build --silent", "dash -c \"bash -c 'cargo test'\"", "just check --verbose",
    ]
    others = [
        "pytest tests/test_a.py", "pytest -k foo", "echo 'x", None, "", "make test", "ruff check", "mypy", "go test", "bash -lc 'pytest'", "cargo run", "npm run deploy",
        "cargo test mine", "uv run", "just", "just check x", "zsh -c pytest", "npm run", "npm",
    ]
    d = spark.createDataFrame([(c,) for c in [*gates, *others]], "c string")
    got = d.select("c", generic_command(F.col("c")).alias("g")).collect()
    assert [r.c for r in got if r.g] == gates


def plain_embedding(text, n):
    words = re.findall("[a-z0-9_]+", text.lower())
    names = words + ["_".join(p) for p in zip(words, words[1:])] + [f"^{w}$"[k : k + 3] for w in words for k in range(len(w))]
    out = [0.0] * n
    for x in names:
        h = hashlib.blake2b(x.encode(), digest_size=8).digest()
        out[int.from_bytes(h[:4], "big") % n] += 1 if h[4] % 2 else -1
    size = sum(x * x for x in out) ** 0.5
    return [x / size for x in out] if size else out


def test_hash_embedding_equals_a_plain_one(spark):
    texts = ["a b", "", None, "The quick_fox the quick_fox 12!", "x"]
    got = hash_embedding(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 32, "v").collect()
    for t, r in zip(texts, got, strict=True):
        assert r.v == pytest.approx(plain_embedding(t or "", 32))
    assert len(hash_embedding(spark.createDataFrame([("a",)], "t string"), "t", 3, "v").first().v) == 16


@pytest.mark.parametrize("most", [1, 5, 1 << 18])
def test_embedding_by_blocks_of_words(most):
    texts = ["a b c_d a b", None, "one", "", "x" * 3000 + " a b", "a b c_d a b a"]
    got = embed_texts(texts, 32, most)
    for t, v in zip(texts, got, strict=True):
        assert list(v) == pytest.approx(plain_embedding(t or "", 32))


def test_one_long_word_does_not_widen_all_features():
    texts = ["w" * 100_000, *(f"word{k} of many" for k in range(2000))]
    tracemalloc.start()
    embed_texts(texts, 64)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64_000_000


def test_ignore_rules_in_order_with_negation_and_folders(spark):
    rules = paths.rules_of("*.log\n# note\n!keep.log\nbuild/\n/top.txt\ndocs/**/x.md\na/**\nf?[0-9].c\n") + paths.rules_of("*.tmp\n/only.txt\n", "sub/dir")
    names = {
        "a.log": True, "d/b.log": True, "d/keep.log": False, "build/x": True, "d/build/x": True, "build": False, "top.txt": True, "d/top.txt": False,
        "docs/x.md": True, "docs/p/q/x.md": True, "e/docs/x.md": False, "a/b/c": True, "fa1.c": True, "fab.c": False, "z.tmp": False, "sub/dir/z.tmp": True,
        "sub/dir/e/z.tmp": True, "sub/dir/only.txt": True, "sub/dir/e/only.txt": False, "plain.py": False,
    }
    d = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path: r.x for r in d.select("path", paths.ignored(F.col("path"), rules).alias("x")).collect()}
    assert got == names
    allow = paths.rules_of("*.py\n")
    got = {r.path for r in d.where(~paths.ignored(F.col("path"), rules, allow)).collect()}
    assert got == {"plain.py"}


def test_time_of_windows_grows_with_the_lines(spark):
    def seconds(n):
        d = spark.createDataFrame([("p", "\n".join(f"line {i}" for i in range(n)))], "path string, content string")
        began = time.time()
        assert ingest.line_windows(d, 80).agg(F.max("end_line")).first()[0] == n
        return time.time() - began

    seconds(1000)
    assert seconds(160_000) < 3 * seconds(80_000) + 1


def test_fuzzy_join_with_a_high_threshold_loses_nothing(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    c = spark.createDataFrame([(f"p{i}", 1, line()) for i in range(60)], "path string, start_line long, content string")
    q = spark.createDataFrame([(i, line()) for i in range(25)] + [(99, "zzz qqq"), (98, "")], "query_id long, query string")
    both = c.crossJoin(q).select("query_id", "path", T.trigrams(F.col("content")).alias("a"), T.trigrams(F.col("query")).alias("b"))
    both = both.select("query_id", "path", (F.size(F.array_intersect("a", "b")) / F.greatest(F.size(F.array_union("a", "b")), F.lit(1))).alias("s"))
    for t in (0.2, 0.4, 0.5):
        want = {(r.query_id, r.path, round(r.s, 6)) for r in both.where(F.round("s", 6) > t).collect()}
        assert want and {(r.query_id, r.path, r.similarity) for r in search.fuzzy_join(c, q, t).collect()} == want


def test_identifier_queries_put_symbol_hits_first(spark):
    c = spark.createDataFrame(
        [("z", 1, 2, "parse_it", "x"), ("a", 1, 2, "other", "calls parse here"), ("b", 1, 2, "none", "nothing")], "path string, start_line long, end_line long, symbol string, content string"
    )
    hits = search.scored(c, "parse").withColumn("score", F.when(F.col("symbol_hit"), 0.1).otherwise(F.col("score")))
    assert [r.path for r in search.top_hits(hits, 5, "parse").collect()] == ["z", "a"]
    assert [r.path for r in search.top_hits(hits, 5, "parse it").collect()] == ["a", "z"]


def test_entry_log_state(spark):
    log = [
        ("p", 1, 1, "update", "early", None, "a"), ("p", 1, 2, "create", " ", 1, "a"), ("p", 1, 3, "create", "one", None, "a"), ("p", 1, 4, "create", "again", 1, "a"),
        ("p", 1, 5, "update", None, 7, "b"), ("p", 1, 6, "resolve", None, None, "b"), ("p", 1, 7, "delete", None, None, "c"), ("p", 1, 8, "update", "late", None, "d"),
        ("q", 1, 2, "create", "other", 2, "a"), ("q", 2, 3, "delete", None, None, "a"),
    ]
    d = spark.createDataFrame(log, "project string, entry_id long, seq long, op string, headline string, priority long, author string")
    got = {(r.project, r.seq): r.outcome for r in state.judged(d).collect()}
    want = ["missing", "empty-headline", "applied", "exists", "applied", "applied", "applied", "deleted"]
    assert got == {("p", k + 1): w for k, w in enumerate(want)} | {("q", 2): "applied", ("q", 3): "missing"}
    got = {(r.project, r.entry_id): tuple(r)[2:] for r in state.current_entries(d).collect()}
    assert got == {("p", 1): ("deleted", "one", 7, "c", 4), ("q", 1): ("open", "other", 2, "a", 1)}
    assert state.current_entries(d.limit(0)).count() == 0


def test_dependencies_are_judged_one_by_one(spark):
    tasks = spark.createDataFrame([(1, k) for k in range(1, 6)], "plan_id long, task_no long")
    deps = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 4, 3)], "plan_id long, task_no long, needs long")
    proposed = spark.createDataFrame([(1, 1, 4), (1, 1, 1), (1, 5, 4), (1, 9, 1), (1, 1, 9), (1, 2, 1), (1, 2, 5)], "plan_id long, task_no long, needs long")
    got = {(r.task_no, r.needs): r.verdict for r in state.judge_dependencies(proposed, tasks, deps).collect()}
    assert got == {(1, 4): "cycle", (1, 1): "self", (5, 4): "ok", (9, 1): "unknown-task", (1, 9): "unknown-needs", (2, 1): "exists", (2, 5): "ok"}


def test_scope_is_a_partition_filter(spark, tmp_path):
    spark.range(20).select((F.col("id") % 4).alias("project_id"), "id").write.partitionBy("project_id").parquet(str(tmp_path / "t"))
    projects = spark.createDataFrame([(2, "two"), (3, "three")], "project_id long, name string")
    rows = state.scoped(spark.read.parquet(str(tmp_path / "t")), projects, "two")
    assert {r.id % 4 for r in rows.collect()} == {2}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "project_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert state.scoped(rows, projects, "nobody").count() == 0


def test_watch_indexes_the_newest_version(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    spark.createDataFrame([("a", "1\n2\n3", 1), ("b", "x", 1)], "path string, content string, version long").coalesce(1).write.mode("append").json(str(inbox))
    watch(spark, str(inbox), out, str(tmp_path / "ck"), 2, once=True).awaitTermination()
    spark.createDataFrame([("a", "new", 2)], "path string, content string, version long").coalesce(1).write.mode("append").json(str(inbox))
    watch(spark, str(inbox), out, str(tmp_path / "ck"), 2, once=True).awaitTermination()
    assert sorted((r.path, r.content) for r in current_chunks(spark, out).collect()) == [("a", "new"), ("b", "x")]
    spark.createDataFrame([("b", None, 2)], "path string, content string, version long").coalesce(1).write.mode("append").json(str(inbox))
    watch(spark, str(inbox), out, str(tmp_path / "ck"), 2, once=True).awaitTermination()
    assert [(r.path, r.content) for r in current_chunks(spark, out).collect()] == [("a", "new")]
    compact(spark, out, str(tmp_path / "next"))
    assert [(r.path, r.content) for r in current_chunks(spark, str(tmp_path / "next")).collect()] == [("a", "new")]


def test_upsert_and_insert_absent(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    changes = spark.createDataFrame([(2, "c", False), (1, None, True), (3, "d", False)], "k long, v string, gone boolean")
    assert sorted(tuple(r) for r in sinks.upserted(t, changes, ["k"], "gone").collect()) == [(2, "c"), (3, "d")]
    t.write.parquet(str(tmp_path / "t"))
    assert sinks.insert_absent(spark, str(tmp_path / "t"), spark.createDataFrame([(2, "x"), (5, "y"), (5, "z")], "k long, v string"), ["k"]) == 1


def test_project_scope_reads_one_partition_and_lists_names(spark, tmp_path):
    spark.createDataFrame([(k % 5, k) for k in range(50)], "project_id int, v int").write.partitionBy("project_id").parquet(str(tmp_path / "t"))
    projects = spark.createDataFrame([(k, f"p{k}") for k in range(5)] + [(7, "3")], "project_id int, name string")
    table = spark.read.parquet(str(tmp_path / "t"))
    own = state.ProjectScope(projects, " p2 ").tables({"a": table, "b": table.where("v > 10")})
    assert own["a"].count() == 10 and {r.project_id for r in own["b"].collect()} == {2}
    assert len(own["a"].inputFiles()) > 0 and "PartitionFilters: [isnotnull(project_id" in own["a"]._jdf.queryExecution().toString()
    assert state.ProjectScope(projects, "3").project_id == 7 and state.ProjectScope(projects, "4").name == "p4"
    for nobody in ("p9", "", None):
        with pytest.raises(state.UnknownProject, match="3, p0, p1, p2, p3, p4"):
            state.ProjectScope(projects, nobody)


def test_a_document_is_parsed_once_for_all_its_rules(spark):
    found = validation.faults(F.col("d"), validation.DRAFT)
    assert str(found).count("parse_json") == 1
    rows = spark.createDataFrame([('{"title": "t", "goal": "g", "tasks": [{"local_task_id": "a", "title": "x", "objective": ""}]}',), ("[",)], "d string").select(found.alias("f"))
    assert [r.f for r in rows.collect()] == [["$.tasks[0].objective: empty"], ["$: json"]]


def test_only_the_nearest_texts_are_cut(spark, tmp_path):
    docs = [(k, f"t{k}\n" * 100 if k != 1 else None, "en", "s", 1) for k in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, [1.0, k / 10]) for k in range(8)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = nearest_chunks(spark, str(tmp_path), 5).collect()
    assert [(r.vec_id, r.start_line) for r in got] == [(0, 1), (0, 81), (2, 1), (2, 81), (3, 1)]


def test_a_module_that_many_files_import_is_tried_once(spark):
    rows = [(f"a/f{k}.py", m) for k in range(30) for m in ("pkg.m", "./n", "none.at.all")] + [("b/f.py", "./n")]
    found = ingest.resolve_imports(spark.createDataFrame(rows, "src string, module string"), spark.createDataFrame([("lib/pkg/m.py",), ("a/n.ts",)], "path string"))
    want = {"pkg.m": "lib/pkg/m.py", "./n": "a/n.ts", "none.at.all": ""}
    assert {(r.src, r.module): r.dst for r in found.collect()} == {(s, m): want[m] if s != "b/f.py" else "" for s, m in rows}
    assert "Deduplicate [_relative" in found._jdf.queryExecution().analyzed().toString()


def test_trigrams_of_a_long_text_are_found_in_blocks():
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefg_9é", k=rng.randrange(1, 9))) for _ in range(300_000)) + "x" * 400_000
    tracemalloc.start()
    owner, grams = gram_pairs([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert grams.tolist() == gram_set(text).tolist() and not owner.any() and most < 40_000_000
    texts = [None, "ab c", "", "the fox", "x", "Éa-b9_"]
    for size in (1, 2, 3, 5, 100):
        assert list(zip(*map(list, gram_pairs(texts, size)), strict=True)) == [(k, g) for k, t in enumerate(texts) for g in gram_set(t)]


def some_graphs(spark):
    """Tasks, dependencies and proposals of 60 plans of up to 9 tasks, with cycles, repeated rows, unknown tasks and nulls."""
    rng = random.Random(5)
    number = lambda n: rng.choice([None, *range(n)] if rng.random() < 0.1 else range(n))
    tasks, deps, proposed = [], [], []
    for plan in [*range(60), None]:
        n = rng.randrange(1, 10)
        tasks += [(plan, number(n)) for _ in range(n + rng.randrange(2))]
        deps += [(plan, b, a) if rng.random() < 0.9 else (plan, a, b) for a, b in (sorted((rng.randrange(n + 1), rng.randrange(n + 1))) for _ in range(rng.randrange(2 * n)))]
        deps += [(plan, number(n), None)] * (rng.random() < 0.1)
        proposed += [(plan, number(n + 1), number(n + 1)) for _ in range(rng.randrange(2 * n))]
    of = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{x} long" for x in names))
    return of(tasks, "plan_id", "task_no"), of(deps, "plan_id", "task_no", "needs"), of(proposed, "plan_id", "task_no", "needs")


def plain_rows(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def test_layers_plan_by_plan_equal_those_by_joins(spark, monkeypatch):
    tasks, deps, _ = some_graphs(spark)
    want = plain_rows(planning.layers_by_joins(tasks, deps))
    assert "None" in "".join(want) and len(want) > 150
    assert [plain_rows(planning.layers(tasks, deps, most)) for most in (12, 1000)] == [want] * 2
    # small plans are not peeled step by step
    monkeypatch.setattr(planning, "layers_by_joins", None)
    assert plain_rows(planning.layers(tasks, deps, 1000)) == want


def test_dependencies_judged_plan_by_plan_equal_those_by_joins(spark, monkeypatch):
    tasks, deps, proposed = some_graphs(spark)
    want = plain_rows(state.judge_by_joins(proposed, tasks, deps))
    assert {v for v in ("self", "unknown-task", "unknown-needs", "exists", "cycle", "ok") if any(repr(v) in r for r in want)} == {"self", "unknown-task", "unknown-needs", "exists", "cycle", "ok"}
    assert [plain_rows(state.judge_dependencies(proposed, tasks, deps, most)) for most in (20, 1000)] == [want] * 2
    monkeypatch.setattr(state, "judge_by_joins", None)
    whole = proposed.dropna()
    assert plain_rows(state.judge_dependencies(whole, tasks, deps)) == [r for r in want if "None" not in r]


def test_plans_judged_side_by_side_equal_those_by_joins(spark, monkeypatch):
    tasks, deps, _ = some_graphs(spark)
    plans = spark.range(62).select(F.col("id").alias("plan_id"), F.when(F.col("id") != 3, "t").alias("title"))
    want = plain_rows(state.judge_plans(plans, tasks, deps, 0))
    assert all(any(v in r for r in want) for v in ("no-title", "no-tasks", "duplicate-task", "unknown-task", "cycle", "'ok'"))
    assert plain_rows(state.judge_plans(plans, tasks, deps, 12)) == want
    monkeypatch.setattr(state, "faults_by_joins", None)
    assert plain_rows(state.judge_plans(plans, tasks, deps)) == want


def test_pieces_hold_their_plans_whole(spark):
    rows = spark.range(3000).select((F.col("id") % 40).alias("plan_id"), F.expr("id div 40").alias("task_no"), F.lit(None).cast("long").alias("needs"), F.lit(0).cast("tinyint").alias("kind"))
    out = plan_graphs.by_plan(rows, plan_graphs.fault_rows, "plan_id long, tasks long, most long, unknown boolean, cyclic boolean", 100)
    assert sorted(tuple(r)[:3] for r in out.collect()) == [(k, 75, 1) for k in range(40)]
