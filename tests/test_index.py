"""The snapshot store, the incremental index and search on postings, against rebuilds and scans."""

from __future__ import annotations

import os
import shutil
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwell.functions.grams import gram_pairs, gram_set, slices, text_slices
from siftwell.operators import indexed_search as X
from siftwell.operators import reindex as R
from siftwell.operators import search as K
from siftwell.operators.ingest import line_windows
from siftwell.sources.snapshot import Conflict, SnapshotStore

SF = "/root/testdata/sf0.001"


def files(spark, n=60):
    rows = [(f"src/d{k % 5}/f_{k}.py", f"import os, sys\ndef handler_{k}():\n    return value_{k % 7}\n" + "the quick brown fox\n" * (k % 30)) for k in range(n)]
    return spark.createDataFrame(rows, "path string, content string")


def content(store):
    names = {"chunks": ["path", "start_line", "end_line", "symbol", "chunk_hash"], "symbols": ["path", "name", "line"], "imports": ["src", "module"]}
    out = {t: sorted(map(tuple, store.read(t).select(*c).collect())) for t, c in names.items()}
    named = store.read("chunks").select("cid", "path", "start_line")
    posted = store.read("postings").select("field", "gram", F.inline("chunks")).join(named, "cid").drop("cid")
    return out | {"postings": sorted(map(tuple, posted.select("field", "gram", "path", "start_line", "times").collect()))}


def test_incremental_equals_full(spark, tmp_path):
    store, again = (SnapshotStore(spark, f"file://{tmp_path}/{n}", 16) for n in ("a", "b"))
    f = files(spark)
    R.full_index(store, f, 8)
    before = store.manifest()
    changed = f.where("path IN ('src/d1/f_1.py', 'src/d2/f_7.py')").select("path", F.concat("content", F.lit("new_word = 1\n")).alias("content"))
    changed = changed.unionByName(spark.createDataFrame([("src/new.go", 'import "fmt"\n')], "path string, content string"))
    deleted = spark.createDataFrame([("src/d0/f_5.py",), ("src/none.py",)], "path string")
    touched = {int(r[0]) for r in changed.select("path").unionByName(deleted).select(R.bucket_of(F.col("path"), 16)).collect()}
    # buckets that hold none of these paths can't be read: their files are away meanwhile
    away = [f"{tmp_path}/a/data/{before['version']}/{t}/bucket={b}" for t in before["tables"] for b in range(16) if b not in touched]
    for path in filter(os.path.exists, away):
        os.rename(path, f"{path}.away")
    R.incremental_index(store, changed, deleted, 8)
    for path in away:
        if os.path.exists(f"{path}.away"):
            os.rename(f"{path}.away", path)
    after = f.join(changed.select("path"), "path", "left_anti").unionByName(changed).where("path <> 'src/d0/f_5.py'")
    R.full_index(again, after, 8)
    assert content(store) == content(again)
    held = store.manifest()["tables"]["chunks"]["buckets"]
    assert {v for b, v in held.items() if int(b) not in touched} == {before["version"]}
    assert R.incremental_index(store, changed.limit(0), deleted.limit(0), 8) == store.manifest()["version"]


def test_postings_of_one_bucket_come_in_bounded_pieces(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", 1)
    R.full_index(store, files(spark), 8)
    rows = store.read("chunks").select("bucket", "cid", "content", "symbol", "path").orderBy("cid")
    table = rows.toArrow().combine_chunks()
    entries = lambda found: sorted((f, g, c["cid"], c["times"]) for b in found for f, g, cs in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)], strict=True) for c in cs)
    whole, pieces = list(R.posting_batches(iter(table.to_batches()))), list(R.posting_batches(iter(table.to_batches(max_chunksize=10)), 500))
    assert len(whole) == 4 and max(len(b.column(3).flatten()) for b in pieces) < 2000 < max(len(b.column(3).flatten()) for b in whole)
    assert entries(pieces) == entries(whole)
    assert entries(R.postings(store.read("chunks"), 500).toArrow().to_batches()) == entries(store.read("postings").select("bucket", "field", "gram", "chunks").toArrow().to_batches())


def test_postings_hold_no_more_of_a_bigger_batch(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(6000))  # about 23 kB

    def batch(n):
        columns = {"bucket": pa.array([3] * n, pa.int32()), "cid": pa.array([(3 << R.SHIFT) + k + 1 for k in range(n)]), "content": pa.array([text] * n)}
        return pa.RecordBatch.from_pydict(columns | {"symbol": pa.array(["w0"] * n), "path": pa.array([f"d/{k}" for k in range(n)])})

    def traced(n):
        b = batch(n)
        tracemalloc.start()
        entries = sum(len(x.column(3).flatten()) for x in R.posting_batches(iter([b]), 5000))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return entries / n, peak

    small, big = traced(100), traced(1000)
    assert small[0] > 100 and big[1] < 1.5 * small[1] < 40e6
    # what is given out at a time is bounded too, and a long text's words are counted as a short one's
    rows = lambda found: sorted((f, g, c["cid"], c["times"]) for b in found for f, g, cs in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)], strict=True) for c in cs)
    whole = list(R.posting_batches(iter([batch(40)])))
    monkeypatch.setattr(R, "GIVEN", 100)
    monkeypatch.setattr(R, "LONG", 10)
    pieces = list(R.posting_batches(iter([batch(40)])))
    assert rows(pieces) == rows(whole) and max(len(b.column(3).flatten()) for b in pieces) <= 140 < max(len(b.column(3).flatten()) for b in whole)


@pytest.mark.parametrize("n", [1, 40, 1 << 18])
def test_trigrams_of_many_texts_at_once(n):
    texts = ["the fox", None, "", "a", "ab\tc1", "über É x", "İK", "--", "x" * 50, "z"]
    got = [(k + own.start, g) for own in slices(texts, n) for k, g in zip(*map(list, gram_pairs(texts[own])), strict=True)]
    assert got == [(k, g) for k, t in enumerate(texts) for g in gram_set(t)]


@pytest.mark.parametrize("n", [1, 40, 1 << 18])
def test_text_slices_are_those_of_lists(n):
    texts = ["the fox", None, "", "a", "ab\tc1", "über É x", "İK", "--", "x" * 50, "z"]
    column = pa.array(["before", *texts])[1:]
    got = [(k + own.start, g) for own, some in text_slices(column, n) for k, g in zip(*map(list, gram_pairs(some)), strict=True)]
    assert got == [(k, g) for k, t in enumerate(texts) for g in gram_set(t)] and not list(text_slices(column[:0]))


def test_a_write_that_dies_leaves_the_old_state(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", 4)
    R.full_index(store, files(spark, 10), 8)
    old, version = content(store), store.manifest()["version"]
    fails = F.udf(lambda p: 1 // 0, "string")
    broken = files(spark, 20).withColumn("content", F.when(F.col("path").contains("f_19"), fails("path")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="ZeroDivision|division"):
        R.full_index(store, broken, 8)
    assert content(store) == old and store.manifest()["version"] == version
    # written, but never put in force
    prepared = store.prepare({"chunks": store.read("chunks").limit(0)})
    assert content(store) == old
    R.incremental_index(store, files(spark, 1), files(spark, 1).select("path").limit(0), 8)
    with pytest.raises(Conflict):
        store.publish(prepared)
    assert content(store) == old and prepared["version"] in store.vacuum() and content(store) == old
    empty = files(spark, 10).select("path")
    R.incremental_index(store, files(spark, 0), empty, 8)
    assert store.read("chunks").count() == 0 and X.scored(store, "fox").count() == 0
    assert store.intact() and not SnapshotStore(spark, f"file://{tmp_path}/none").intact()
    R.full_index(store, files(spark, 10), 8)
    shutil.rmtree(f"{tmp_path}/s/data/{store.manifest()['version']}/postings")
    assert not store.intact()
    R.full_index(store, files(spark, 10), 8)
    assert store.intact() and content(store) == old


@pytest.mark.parametrize("fuzzy", [True, False])
def test_search_on_postings_equals_a_scan(spark, tmp_path, fuzzy):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    f = docs.select(F.concat("lang", F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    f = f.unionByName(files(spark, 12)).unionByName(spark.createDataFrame([("x/empty.txt", ""), ("x/İ.txt", "İSTANBUL foo_bar über")], "path string, content string"))
    store = SnapshotStore(spark, f"file://{tmp_path}/s", 8)
    R.full_index(store, f, 8)
    chunks = line_windows(f, 8).withColumn("symbol", F.regexp_extract("content", "([A-Za-z0-9_]+)", 1))
    for query in ("handler_3", "quick brown", "fox\nthe", "th", "he", "e", "über", "*.py", "src/*_1*", "value_2\n", "ent in", "foo_bar", "i̇stan", "d1/f", "", "zzz", "return the handler"):
        got = {tuple(r) for r in X.scored(store, query, fuzzy).select("path", "start_line", "end_line", "score", "mode", "symbol_hit").collect()}
        want = {tuple(r) for r in K.scored(chunks, query, fuzzy).select("path", "start_line", "end_line", "score", "mode", "symbol_hit").collect()}
        assert got == want, query
    shutil.rmtree(f"{tmp_path}/s")


def test_missing_tables_and_columns_are_healed(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", 4)
    R.full_index(store, files(spark, 12), 8)
    schemas = {"chunks": StructType.fromDDL("path string, weight double, owner string"), "notes": StructType.fromDDL("path string, summary string")}
    assert store.ensure(schemas, {"chunks": {"weight": 1.5}}) and not store.ensure(schemas)
    got = store.read("chunks").select("weight", "owner").distinct().collect()
    assert [tuple(r) for r in got] == [(1.5, None)] and store.read("notes").count() == 0
    assert store.read("notes").columns == ["path", "summary", "bucket"]
    # written buckets get the new columns, the others keep reading the default
    b = int(store.read("chunks").agg(F.min("bucket")).first()[0])
    rows = store.read("chunks", [b]).withColumn("weight", F.lit(7.0))
    store.commit({"chunks": rows}, [b])
    assert {r.weight for r in store.read("chunks", [b]).collect()} == {7.0} and {r.weight for r in store.read("chunks").where(F.col("bucket") != b).collect()} == {1.5}
