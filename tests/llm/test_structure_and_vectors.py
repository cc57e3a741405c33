"""Conversation repair, vector codes and near-duplicate vectors against brute force and DuckDB, and their defined odd cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from siftwell.llm import conversation_repair, pstable_dedup, yinyang_codes
from siftwell.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_yinyang_codes", "op13_pstable_dedup"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    same = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).itertuples(index=False, name=None)))
    assert same(got) == same(want)


# conversation repair


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(rows, marks):
    """Every edit script of few inserts: (cost, audit, repaired turns). Exponential."""
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(m in ("b", "d") and e != "D" for m, e in zip(marks, edits, strict=True)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            if sum(inserts) > 3:
                continue
            audit = "I" * inserts[0] + "".join(e + "I" * n for e, n in zip(edits, inserts[1:], strict=True))
            kept = iter([(e, r, m) for e, r, m in zip(edits, rows, marks, strict=True) if e != "D"])
            said, cost = [], 0
            for e in audit.replace("D", ""):
                if e == "I":
                    said.append((None, ""))
                    cost += 3
                else:
                    _, (_, role, text), mark = next(kept)
                    said.append((role if e == "K" else None, text))
                    cost += 3 * (e == "R") + 3 * (mark == "t")
            first = bool(said and said[0][0] and said[0][0][:1] == "s")
            turns = [(role or ("user", "assistant")[(k - first) % 2], text) for k, (role, text) in enumerate(said)]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)):
                yield cost + 4 * edits.count("D"), audit, turns


def repair_by_force(rows):
    rows = damaged(rows)
    marks = faults(rows)
    cost, audit, turns = min(all_repairs(rows, marks), key=lambda x: x[:2])
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, sha


@pytest.mark.parametrize("block", [2, 512])
def test_op11_equals_all_edit_scripts(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    draw = random.Random(block)
    roles = ["user", "assistant", "system", "tool", None, "user", "assistant", ""]
    texts = ["One.", "Two!", "three", "four. ", " \t", None, "Five?\n", "é."]
    rows = [(c, draw.choice([0, 1, 2, 3, 4, 7, None]), draw.choice(roles[: 3 + c % 6]), draw.choice(texts[: 2 + c % 7])) for c in range(70) for _ in range(draw.randint(1, 4))]
    rows += [(None, 1, "user", "Here."), (None, None, "assistant", "There."), (900, None, None, None)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, gone string")
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repaired_digests(table).collect()}
    of = collections.defaultdict(list)
    for r in rows:
        of[r[0]].append(r)
    assert set(got) == set(of)
    for conv, own in of.items():
        # an empty role has no initial to keep; the plain search would take it for nothing at all
        own_ = [(c, t, "?" if role == "" and zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20 != 4 else role, x) for c, t, role, x in own]
        if len(damaged(own)) <= 5 and all(r[2] != "" for r in own):
            assert got[conv] == repair_by_force(own_), own
    assert any(len(damaged(own)) > block for own in of.values()) or block > 2


def test_op11_long_conversation_and_empty_table(spark):
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." if t % 11 else f"turn {t}") for t in range(3000)] + [(6, 0, "user", "x" * 2_000_000 + ".")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in conversation_repair.repaired_digests(table).collect()}
    kept = damaged(rows[:-1])
    assert len(got) == 2 and sum(x in "KRD" for x in got[5].audit) == len(kept) and got[5].truncated == faults(kept).count("t")
    plan, turns = conversation_repair.repair(conversation_repair.damage(table), conversation_repair.Scratch(spark, "test"))
    said = [r for r in turns.collect() if r.conv_id == 5]
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in said)) and [r.place for r in said] == list(range(len(said)))
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in said).encode()).hexdigest() == got[5].repaired_sha256
    assert conversation_repair.repaired_digests(table.limit(0)).count() == 0


# vector codes


def codes_by_force(rows):
    kept = [(i, [math.floor(1024 * x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = np.array([r[1] for r in kept], np.int64).reshape(len(kept), 4, -1)
    books = [parts[:256, p].copy() for p in range(4)]

    def assigned():
        d = [((parts[:, p][:, None] - books[p][None]) ** 2).sum(2) for p in range(4)]
        return [x.argmin(1) for x in d], [x.min(1) for x in d]

    for _ in range(4):
        of, _ = assigned()
        for p in range(4):
            for e in range(len(books[p])):
                own = parts[of[p] == e, p]
                if len(own):
                    books[p][e] = own.sum(0) // len(own)
    of, error = assigned()
    total = collections.Counter()
    for k, r in enumerate(kept):
        total[r[2]] += sum(int(e[k]) for e in error)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(repr((r[0], "".join(f"{of[p][k]:02x}" for p in range(4)), sum(int(e[k]) for e in error), total[r[2]], sha)) for k, r in enumerate(kept))


def test_op12_equals_plain_rounds(spark):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((40, 12))
    rows = [(int(i), (base[i % 40] + draw.standard_normal(12) * 0.2).round(2).tolist(), i % 4 or None) for i in range(900)]
    rows += [(i, rows[0][1], 9) for i in range(5)] + [(None, rows[7][1], 9), (77, None, 1), (78, [float("nan")] * 12, 1), (79, [None] * 12, 1)]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, vec string, entry int")
    got = sorted(repr(tuple(r)) for r in yinyang_codes.vector_codes(table).collect())
    assert got == codes_by_force(rows)


def test_op12_ties_and_wide_components(spark):
    draw = random.Random(4)
    rows = [(i, [draw.choice([0.0, 0.25, 0.5]) for _ in range(4)], 1) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(repr(tuple(r)) for r in yinyang_codes.vector_codes(table).collect()) == codes_by_force(rows)
    rows = [(i, [draw.choice([1e5, -3e4, 7.5, 123456.789]) for _ in range(8)], None) for i in range(500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(repr(tuple(r)) for r in yinyang_codes.vector_codes(table).collect()) == codes_by_force(rows)


def test_op12_odd_lengths_and_empty_table(spark):
    rows = [(1, [0.5, 1.0, 2.0], 1), (2, [], 1), (3, [1e30] * 5, None), (4, None, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in yinyang_codes.vector_codes(table).collect()}
    assert set(got) == {1, 2, 3} and all(r.error == 0 for r in got.values())
    assert yinyang_codes.vector_codes(table.where("vec_id = 4")).count() == 0


def test_op12_scans_less_than_all():
    draw = np.random.default_rng(5)
    x = (draw.standard_normal((4000, 16)) * 300).astype(np.int64)
    books = x[:256].copy()
    group = yinyang_codes.grouped(books)
    part = yinyang_codes.Part(books, group)
    state = part.first(x)
    for _ in range(3):
        before, books = books, np.stack([x[state[0] == e].sum(0) // max(1, (state[0] == e).sum()) if (state[0] == e).any() else books[e] for e in range(256)])
        part = yinyang_codes.Part(books, group, before)
        state = part.again(x, *state)
        assert (state[0] == ((x[:, None] - books[None]) ** 2).sum(2).argmin(1)).all()
    assert part.scanned < x.shape[0] * 256


# near-duplicate vectors


def vectors_by_force(rows):
    ok = [bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    unit = [np.array(v) / np.abs(v).max() if good else None for good, (_, v) in zip(ok, rows, strict=True)]
    n = [0] * len(rows)
    for a, b in itertools.combinations([k for k, good in enumerate(ok) if good], 2):
        u, v = unit[a], unit[b]
        if len(u) == len(v) and u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.9:
            n[a], n[b] = n[a] + 1, n[b] + 1
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    of = [min((i for i in least[find(k)] if i is not None), default=None) for k in range(len(rows))]
    return sorted(repr((i, n[k], of[k], i == of[k])) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("block", "company"), [(1024, 512), (37, 512), (64, 5)])
def test_op13_equals_all_pairs(spark, monkeypatch, block, company):
    monkeypatch.setattr(pstable_dedup, "BLOCK", block)
    monkeypatch.setattr(pstable_dedup, "COMPANY", company)
    draw = np.random.default_rng(1)
    base = draw.standard_normal((30, 16))
    rows = [(int(i), (base[i % 30] + draw.standard_normal(16) * draw.choice([0.02, 0.2, 0.35])).tolist()) for i in range(700)]
    rows += [(9000 + i, rows[3][1]) for i in range(40)] + [(4, rows[9][1]), (None, rows[5][1]), (None, [5.0, -1.0, 3.0]), (7000, None), (7001, [0.0] * 16), (7002, [])]
    rows += [(7003, [1.0, None]), (7004, [math.nan]), (7005, [1e300, 1e300]), (7006, [1e-300, 1e-300]), (7007, [2.0, 2.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, node string, kept int")
    assert sorted(repr(tuple(r)) for r in pstable_dedup.near_vectors(table).collect()) == vectors_by_force(rows)
    assert pstable_dedup.near_vectors(table.limit(0)).count() == 0


def test_op13_finds_pairs_at_the_threshold():
    """Of pairs whose cosine is just 0.9, as many share no bucket as the plan says, within sampling."""
    draw = np.random.default_rng(2)
    for n in (500, 50_000, 10**6):
        k, width, tables = pstable_dedup.plan(n)
        distance = math.sqrt(0.2)
        trials = 400
        gap = np.abs(draw.standard_normal((trials, tables, k)) * distance) / width
        missed = (~(draw.uniform(0, 1, gap.shape) >= gap).all(2)).all(1).mean()
        assert missed < 0.02 and pstable_dedup.same_cell(width, distance) ** k > 0
        assert (1 - pstable_dedup.same_cell(width, distance) ** k) ** tables <= 1.01e-5
