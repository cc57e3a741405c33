"""Queries of requirement contracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.operators import contracts as C
from siftwell.operators.context import top_per_section
from siftwell.operators.contract_document import contract_documents
from siftwell.plans.catalog import Catalog
from siftwell.sources import tables as S

CATALOG = Catalog()
query = CATALOG.query

_E = f"""WITH {S.CONTRACTS_SQL}, life AS (SELECT *, CASE WHEN revision <> 2 THEN 'stale' WHEN seq <> max(CASE WHEN revision = 2 THEN seq END) OVER (PARTITION BY criterion_id, kind) THEN 'superseded' ELSE recorded END AS lifecycle FROM evidence)"""
_JUDGED = f"""{_E}, own AS (SELECT l.*, c.evidence_kind FROM life l JOIN criteria c USING (criterion_id)),
  impl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY criterion_id ORDER BY seq DESC) AS k FROM own WHERE revision = 2 AND kind = evidence_kind) WHERE k = 1),
  rev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY criterion_id ORDER BY seq DESC) AS k FROM own WHERE revision = 2 AND kind = 'review') WHERE k = 1),
  ever AS (SELECT DISTINCT criterion_id FROM own WHERE kind = evidence_kind AND result = 'passed'),
  judged AS (SELECT c.*, CASE WHEN i.seq IS NULL THEN CASE WHEN e.criterion_id IS NOT NULL THEN 'stale' ELSE 'missing' END WHEN i.result <> 'passed' THEN 'failed' WHEN i.lifecycle <> 'verified' THEN 'stale'
      WHEN NOT c.independent_review AND NOT c.high_risk THEN 'verified' WHEN r.seq IS NULL THEN 'review-missing' WHEN r.result <> 'passed' THEN 'review-failed' WHEN r.lifecycle <> 'verified' THEN 'review-stale'
      WHEN lower(trim(r.author)) = lower(trim(i.author)) THEN 'review-self' WHEN r.review_ref NOT IN ('criterion:' || c.criterion_id, 'invariant:' || c.invariant_id) THEN 'review-scope' ELSE 'verified' END AS verdict
    FROM criteria c LEFT JOIN impl i ON i.criterion_id = c.criterion_id LEFT JOIN rev r ON r.criterion_id = c.criterion_id LEFT JOIN ever e ON e.criterion_id = c.criterion_id)"""
_GATE = f"""{_JUDGED}, per AS (SELECT requirement_id, count(CASE WHEN required THEN 1 END) AS ac_total, count(CASE WHEN required AND verdict = 'verified' THEN 1 END) AS ac_verified,
    count(CASE WHEN required AND verdict IN ('missing', 'failed', 'review-missing', 'review-failed', 'review-self', 'review-scope') THEN 1 END) AS missing,
    count(CASE WHEN required AND verdict IN ('stale', 'review-stale') THEN 1 END) AS stale, count(CASE WHEN required AND verdict LIKE 'review-%' THEN 1 END) AS reviews FROM judged GROUP BY 1),
  block AS (SELECT requirement_id, count(*) AS blocking FROM violations WHERE status = 'open' AND severity = 'blocking' GROUP BY 1),
  gate AS (SELECT requirement_id, true AS configured, ac_total = ac_verified AND coalesce(blocking, 0) = 0 AS passed, ac_total, ac_verified, missing, stale, coalesce(blocking, 0) AS blocking,
    CASE WHEN stale > 0 THEN 'stale' ELSE 'ok' END AS validation, CASE WHEN coalesce(blocking, 0) > 0 OR reviews > 0 THEN 'failed' ELSE 'passed' END AS review FROM per LEFT JOIN block USING (requirement_id))"""


def _all(spark, sf_dir):
    return S.criteria(spark, sf_dir), S.evidence(spark, sf_dir), S.violations(spark, sf_dir)


@query("evidence_lifecycle", f"{_E} SELECT criterion_id, seq, kind, result, lifecycle FROM life")
def evidence_lifecycle(spark, sf_dir):
    return C.lifecycle(S.evidence(spark, sf_dir)).select("criterion_id", "seq", "kind", "result", "lifecycle")


@query("exception_kind", f"{_JUDGED} SELECT criterion_id, requirement_id, verdict FROM judged WHERE required AND verdict <> 'verified'")
def exception_kind(spark, sf_dir):
    c, e, _ = _all(spark, sf_dir)
    return C.judged(c, e).where("required AND verdict <> 'verified'").select("criterion_id", "requirement_id", "verdict")


@query("close_gate", f"{_GATE} SELECT * FROM gate")
def close_gate(spark, sf_dir):
    return C.close_gate(*_all(spark, sf_dir))


@query(
    "gate_summary",
    f"{_GATE} SELECT count(*) AS requirements, count(CASE WHEN passed THEN 1 END) AS passed, CAST(sum(ac_total) AS BIGINT) AS ac_total, CAST(sum(ac_verified) AS BIGINT) AS ac_verified, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(stale) AS BIGINT) AS stale, CAST(sum(blocking) AS BIGINT) AS blocking FROM gate",
)
def gate_summary(spark, sf_dir):
    names = ("ac_total", "ac_verified", "missing", "stale", "blocking")
    return C.close_gate(*_all(spark, sf_dir)).agg(F.count("*").alias("requirements"), F.count_if("passed").alias("passed"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


@query("compliance_verdict", f"{_GATE} SELECT requirement_id, CASE WHEN NOT configured THEN 'not-configured' WHEN passed THEN 'verified' ELSE 'failed' END AS verdict FROM gate")
def compliance_verdict(spark, sf_dir):
    g = C.close_gate(*_all(spark, sf_dir))
    return g.select("requirement_id", F.when(~F.col("configured"), "not-configured").when(F.col("passed"), "verified").otherwise("failed").alias("verdict"))


_VERIFIED = "verified AS (SELECT * FROM life WHERE lifecycle = 'verified')"
_KEY = r"lower(regexp_replace(regexp_replace(replace(trim(test_ref), '\', '/'), '^(\./)+', ''), '/+', '/', 'g'))"
_REUSE = f"reuse AS (SELECT requirement_id, {_KEY} AS test_ref, count(DISTINCT criterion_id) AS criteria FROM verified WHERE test_ref IS NOT NULL AND test_ref <> '' GROUP BY 1, 2 HAVING count(DISTINCT criterion_id) > 3)"
_CLASH = "clash AS (SELECT requirement_id, criterion_id, lower(trim(author)) AS author FROM verified GROUP BY ALL HAVING bool_or(kind = 'review') AND bool_or(kind <> 'review'))"


@query(
    "warning_codes",
    f"""{_E}, {_VERIFIED}, {_REUSE}, {_CLASH}, per AS (SELECT requirement_id, bool_or(coalesce(source_commit, '') = '' OR NOT commit_verified) AS m, bool_or(recorded = 'provisional' AND fingerprint IS NULL) AS d,
        bool_or((test_ref IS NOT NULL AND coalesce(ref_verified = false, false)) OR (kind IN ('test', 'file') AND coalesce(test_ref, '') = '')) AS t FROM life WHERE lifecycle <> 'superseded' GROUP BY 1),
      gates AS (SELECT DISTINCT v.requirement_id FROM verified v JOIN criteria c USING (criterion_id) WHERE kind = 'command' AND command_ref IN ('uv run pytest -q', 'bash -c "npm run test"') AND lower(statement) LIKE '%access%')
      SELECT requirement_id, concat_ws(',', CASE WHEN d THEN 'dirty-no-fingerprint' END, CASE WHEN requirement_id IN (SELECT requirement_id FROM reuse) THEN 'excessive-test-reuse' END, CASE WHEN m THEN 'missing-commit-ref' END,
        CASE WHEN t THEN 'missing-file-test-ref' END, CASE WHEN requirement_id IN (SELECT requirement_id FROM clash) THEN 'reviewer-author-collision' END,
        CASE WHEN requirement_id IN (SELECT requirement_id FROM gates) THEN 'security-generic-command' END) AS codes FROM per""",
)
def warning_codes(spark, sf_dir):
    return C.warnings(S.criteria(spark, sf_dir), S.evidence(spark, sf_dir))


_INVARIANTS = f"""{_JUDGED}, open AS (SELECT DISTINCT invariant_id FROM violations WHERE status = 'open' AND severity = 'blocking'),
  inv AS (SELECT requirement_id, invariant_id, 'I-' || lpad(CAST(invariant_id % 97 AS VARCHAR), 3, '0') || '-' || invariant_id AS key, CASE WHEN invariant_id % 4 = 0 THEN 'forbidden-path' ELSE 'rule' END AS kind,
    CASE invariant_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'unknown' END AS risk, invariant_id % 3 AS sort_order,
    invariant_id IN (SELECT invariant_id FROM open) AS blocking, bool_or(verdict IN ('missing', 'failed')) AS missing, bool_or(verdict = 'stale') AS stale FROM judged GROUP BY 1, 2),
  placed AS (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY NOT blocking, kind <> 'forbidden-path', CASE risk WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END,
    NOT missing, NOT stale, sort_order, key) AS place FROM inv)"""


def _invariants(spark, sf_dir):
    c, e, v = _all(spark, sf_dir)
    i = F.col("invariant_id")
    blocked = v.where("status = 'open' AND severity = 'blocking'").select("invariant_id").distinct().withColumn("blocking", F.lit(True))
    verdict = F.col("verdict")
    per = C.judged(c, e).groupBy("requirement_id", "invariant_id").agg(F.bool_or(verdict.isin("missing", "failed")).alias("missing"), F.bool_or(verdict == "stale").alias("stale"))
    return per.join(blocked, "invariant_id", "left").select(
        "*",
        F.concat(F.lit("I-"), F.lpad((i % 97).cast("string"), 3, "0"), F.lit("-"), i).alias("key"),
        F.when(i % 4 == 0, "forbidden-path").otherwise("rule").alias("kind"),
        F.when(i % 5 == 0, "low").when(i % 5 == 1, "critical").when(i % 5 == 2, "high").when(i % 5 == 3, "medium").otherwise("unknown").alias("risk"),
        (i % 3).alias("sort_order"),
    )


@query("statement_order", f"{_INVARIANTS} SELECT requirement_id, invariant_id, place FROM placed")
def statement_order(spark, sf_dir):
    return C.statement_order(_invariants(spark, sf_dir))


@query(
    "contract_fit",
    f"""{_INVARIANTS}, l AS (SELECT requirement_id, place, key || ' [' || risk || '] ' || kind AS line FROM placed), u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY requirement_id ORDER BY place) AS used FROM l),
      s AS (SELECT *, bool_or(used > 64) OVER (PARTITION BY requirement_id ORDER BY place) AS stopped FROM u) SELECT requirement_id, place, CASE WHEN used > 64 THEN rtrim(left(line, 62)) || '…' ELSE line END AS line FROM s WHERE NOT stopped OR place = 1""",
)
def contract_fit(spark, sf_dir):
    inv = _invariants(spark, sf_dir)
    line = F.concat("key", F.lit(" ["), "risk", F.lit("] "), "kind")
    lines = C.statement_order(inv).join(inv.select("requirement_id", "invariant_id", line.alias("line")), ["requirement_id", "invariant_id"]).drop("invariant_id")
    return C.fit_lines(lines, 20, F.lit(16))


_ROOM = 60


def _documents_sql() -> str:
    start = _INVARIANTS.index(", open AS (SELECT DISTINCT invariant_id")
    call = "more; call get_requirement_contract / get_requirement_evidence"
    return f"""{_GATE}{_INVARIANTS[start:]},
      lines AS (SELECT requirement_id, place, CASE WHEN blocking THEN 'violation' WHEN kind = 'forbidden-path' THEN 'must_not' ELSE 'must' END AS kind, key || ': ' || repeat(risk || ' ', CAST(1 + invariant_id % 9 AS BIGINT)) AS line FROM placed),
      closing AS (SELECT requirement_id, 'CLOSE ' || ac_verified || '/' || ac_total AS close FROM gate),
      sums AS (SELECT l.*, close, row_number() OVER w AS k, count(*) OVER (PARTITION BY requirement_id) AS n,
        {", ".join(f"sum(CASE WHEN kind = '{k}' THEN length(line) + 2 ELSE 0 END) OVER w AS {k}_chars" for k in ("violation", "must", "must_not"))} FROM lines l JOIN closing USING (requirement_id)
        WINDOW w AS (PARTITION BY requirement_id ORDER BY place)),
      sized AS (SELECT *, 8 + {" + ".join(f"CASE WHEN {k}_chars > 0 THEN {n + 1} + {k}_chars ELSE 0 END" for k, n in (("violation", 10), ("must", 4), ("must_not", 8)))}
        + CASE WHEN n > k THEN 1 + length('+' || (n - k) || ' {call}') ELSE 0 END + 2 + length(close) AS size FROM sums),
      cut AS (SELECT *, bool_or(size > {_ROOM * 4}) OVER (PARTITION BY requirement_id ORDER BY place) AS stopped, {_ROOM * 4} - (size - length(line)) AS room FROM sized),
      fitted AS (SELECT requirement_id, max(b) AS b FROM (SELECT requirement_id, room, line, unnest(range(1, {_ROOM + 1})) AS b FROM cut WHERE k = 1 AND stopped)
        WHERE length(CASE WHEN (length(line) + 3) // 4 <= b THEN line ELSE rtrim(left(line, b * 4 - 1)) || '…' END) <= room GROUP BY requirement_id),
      kept AS (SELECT c.*, CASE WHEN NOT stopped THEN line WHEN k = 1 AND b IS NOT NULL THEN CASE WHEN (length(line) + 3) // 4 <= b THEN line ELSE rtrim(left(line, b * 4 - 1)) || '…' END END AS said FROM cut c LEFT JOIN fitted USING (requirement_id)),
      texts AS (SELECT requirement_id, max(n) AS n, count(said) AS held, {", ".join(f"string_agg(CASE WHEN kind = '{k}' THEN said END, '; ' ORDER BY k) AS {k}" for k in ("violation", "must", "must_not"))} FROM kept GROUP BY requirement_id)
      SELECT c.requirement_id, CASE WHEN coalesce(held, 0) > 0 THEN 'CONTRACT' || coalesce(chr(10) || 'Violations: ' || violation, '') || coalesce(chr(10) || 'Must: ' || must, '') || coalesce(chr(10) || 'Must not: ' || must_not, '')
          || CASE WHEN n > held THEN chr(10) || '+' || (n - held) || ' {call}' ELSE '' END || chr(10) || chr(10) || close
        ELSE 'CONTRACT' || chr(10) || '+' || greatest(coalesce(n, 0), 1) || ' {call}' || chr(10) || chr(10) || CASE WHEN (length('CONTRACT' || chr(10) || '+' || greatest(coalesce(n, 0), 1) || ' {call}' || chr(10) || chr(10) || close) + 3) // 4 <= {_ROOM} THEN close ELSE 'CLOSE none' END END AS document,
        CAST(coalesce(n, 0) - coalesce(held, 0) AS BIGINT) AS omitted, coalesce(held, 0) = 0 OR n > held AS truncated FROM closing c LEFT JOIN texts USING (requirement_id)"""


@query("contract_document", _documents_sql())
def contract_document(spark, sf_dir):
    inv = _invariants(spark, sf_dir)
    kind = F.when(F.coalesce("blocking", F.lit(False)), "violation").when(F.col("kind") == "forbidden-path", "must_not").otherwise("must")
    line = F.concat("key", F.lit(": "), F.repeat(F.concat("risk", F.lit(" ")), (1 + F.col("invariant_id") % 9).cast("int")))
    lines = C.statement_order(inv).join(inv.select("requirement_id", "invariant_id", kind.alias("kind"), line.alias("line")), ["requirement_id", "invariant_id"])
    closing = C.close_gate(*_all(spark, sf_dir)).select("requirement_id", F.concat(F.lit("CLOSE "), "ac_verified", F.lit("/"), "ac_total").alias("close"))
    return contract_documents(lines.select("requirement_id", "place", "kind", "line"), closing, "CLOSE none", _ROOM)


@query(
    "excessive_reuse",
    f"{_E}, {_VERIFIED} SELECT 0 AS requirement_id, {_KEY} AS test_ref, count(DISTINCT criterion_id) AS criteria FROM verified WHERE test_ref IS NOT NULL AND test_ref <> '' GROUP BY 2 HAVING count(DISTINCT criterion_id) > 3",
)
def excessive_reuse(spark, sf_dir):
    verified = C.lifecycle(S.evidence(spark, sf_dir)).where("lifecycle = 'verified'")
    return C.excessive_reuse(verified.withColumn("requirement_id", F.lit(0)))


@query("review_collision", f"{_E}, {_VERIFIED}, {_CLASH} SELECT * FROM clash")
def review_collision(spark, sf_dir):
    return C.collisions(C.lifecycle(S.evidence(spark, sf_dir)).where("lifecycle = 'verified'"))


@query(
    "exception_refs",
    f"WITH {S.CONTRACTS_SQL} SELECT requirement_id, array_to_string(list_slice(list_sort(list(DISTINCT test_ref)), 1, 2), ',') AS refs FROM evidence WHERE test_ref IS NOT NULL GROUP BY 1",
)
def exception_refs(spark, sf_dir):
    refs = S.evidence(spark, sf_dir).where("test_ref IS NOT NULL").select("requirement_id", "test_ref").distinct()
    place = F.row_number().over(Window.partitionBy("requirement_id").orderBy("test_ref"))
    top = refs.withColumn("k", place).where("k <= 2")  # so that no row gathers more than two
    return top.groupBy("requirement_id").agg(F.array_join(F.array_sort(F.collect_list("test_ref")), ",").alias("refs"))


@query(
    "evidence_top",
    f"WITH {S.CONTRACTS_SQL}, k AS (SELECT requirement_id, seq, row_number() OVER (PARTITION BY requirement_id ORDER BY seq DESC) AS place, count(*) OVER (PARTITION BY requirement_id) AS n FROM evidence) SELECT requirement_id, seq, place, CAST(greatest(n - 8, 0) AS BIGINT) AS omitted FROM k WHERE place <= 8",
)
def evidence_top(spark, sf_dir):
    top = top_per_section(S.evidence(spark, sf_dir), 8, [F.desc("seq")], by="requirement_id", salt=4, id_="seq")
    return top.select("requirement_id", "seq", "place", "omitted")


@query("latest_revision", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_revision(spark, sf_dir):
    return S.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("event_id").alias("event_id"))


@query(
    "violations_order",
    f"WITH {S.CONTRACTS_SQL}, v AS (SELECT *, CASE WHEN status = 'open' AND severity = 'blocking' THEN 0 WHEN status = 'open' THEN 1 ELSE 2 END AS p FROM violations) SELECT requirement_id, violation_id, row_number() OVER (PARTITION BY requirement_id ORDER BY p, status, severity, violation_id) AS place FROM v",
)
def violations_order(spark, sf_dir):
    open_ = F.col("status") == "open"
    p = F.when(open_ & (F.col("severity") == "blocking"), 0).when(open_, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("requirement_id").orderBy("p", "status", "severity", "violation_id"))
    return S.violations(spark, sf_dir).withColumn("p", p).select("requirement_id", "violation_id", place.cast("long").alias("place"))


@query("next_sort_order", "SELECT c_nationkey AS requirement_id, coalesce(max(CASE WHEN c_acctbal > 5000 THEN c_custkey END), -1) + 1 AS next FROM customer GROUP BY 1")
def next_sort_order(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("requirement_id"))
    return c.agg((F.coalesce(F.max(F.when(F.col("c_acctbal") > 5000, F.col("c_custkey"))), F.lit(-1)) + 1).alias("next"))


@query(
    "next_free_key",
    "WITH u AS (SELECT DISTINCT p_size AS g, p_partkey % 23 AS n FROM part WHERE p_partkey % 23 > 0), k AS (SELECT g, n, row_number() OVER (PARTITION BY g ORDER BY n) AS place FROM u) SELECT g, 'AC-' || lpad(CAST(count(CASE WHEN n = place THEN 1 END) + 1 AS VARCHAR), 3, '0') AS next_key FROM k GROUP BY g",
)
def next_free_key(spark, sf_dir):
    used = S.table(spark, sf_dir, "part").select(F.col("p_size").alias("g"), (F.col("p_partkey") % 23).alias("n")).where("n > 0")
    return C.first_free(used, "g", "n").select("g", F.concat(F.lit("AC-"), F.lpad(F.col("free").cast("string"), 3, "0")).alias("next_key"))


_STATUS = "list_extract(['not-started', 'in-progress', 'blocked', 'done'], CAST({} % 4 + 1 AS INT))"
_MERGE_SQL = f"""file AS (SELECT 'R-' || doc_id AS req_key, 'T' || doc_id % 3 AS title, {_STATUS.format('(doc_id // 7)')} AS status FROM documents WHERE doc_id % 10 <> 1),
  store AS (SELECT 'R-' || doc_id AS req_key, 'T' || doc_id % 6 % 4 AS title, {_STATUS.format('(doc_id // 11)')} AS status, doc_id % 13 = 0 AS archived FROM documents WHERE doc_id % 10 <> 2),
  snap AS (SELECT 'R-' || doc_id AS req_key, {_STATUS.format('(doc_id // 7 + doc_id % 2)')} AS status FROM documents WHERE doc_id % 5 <> 3),
  acted AS (SELECT coalesce(f.req_key, s.req_key) AS req_key, f.status AS fs, s.status AS ss, CASE WHEN f.req_key IS NOT NULL AND s.req_key IS NULL THEN 'create' WHEN f.req_key IS NOT NULL AND archived THEN 'leave-archived'
      WHEN f.req_key IS NOT NULL AND f.status = s.status THEN CASE WHEN f.title <> s.title THEN 'update-text' ELSE 'keep' END
      WHEN f.req_key IS NOT NULL AND n.status IS NOT NULL AND f.status <> n.status AND s.status = n.status THEN 'file-wins' WHEN f.req_key IS NOT NULL AND n.status IS NOT NULL AND f.status <> n.status THEN 'conflict-store-wins'
      WHEN f.req_key IS NOT NULL THEN 'store-wins' WHEN archived THEN 'ignore' WHEN n.req_key IS NOT NULL THEN 'archive' ELSE 'append' END AS action
    FROM file f FULL JOIN store s ON f.req_key = s.req_key LEFT JOIN snap n ON n.req_key = coalesce(f.req_key, s.req_key))"""


def _merge(spark, sf_dir):
    i = F.col("doc_id")
    d = S.table(spark, sf_dir, "documents").select("doc_id")
    status = lambda n: F.element_at(F.array(*[F.lit(x) for x in ("not-started", "in-progress", "blocked", "done")]), (n % 4 + 1).cast("int")).alias("status")
    key = F.concat(F.lit("R-"), i).alias("req_key")
    seven = F.floor(i / 7)
    file = d.where("doc_id % 10 <> 1").select(key, F.concat(F.lit("T"), i % 3).alias("title"), status(seven))
    store = d.where("doc_id % 10 <> 2").select(key, F.concat(F.lit("T"), i % 6 % 4).alias("title"), status(F.floor(i / 11)), (i % 13 == 0).alias("archived"))
    snapshot = d.where("doc_id % 5 <> 3").select(key, F.lit("").alias("title"), status(seven + i % 2))
    return C.three_way(file, store, snapshot)


@query("three_way_merge", f"WITH {_MERGE_SQL} SELECT req_key, action, CASE WHEN action IN ('create', 'file-wins') THEN fs ELSE ss END AS status FROM acted")
def three_way_merge(spark, sf_dir):
    return _merge(spark, sf_dir)


@query("merge_new_keys", f"WITH {_MERGE_SQL} SELECT req_key, 'R-' || (100000 + row_number() OVER (ORDER BY req_key)) AS fresh_key FROM acted WHERE action = 'create'")
def merge_new_keys(spark, sf_dir):
    made = C.numbered(_merge(spark, sf_dir).where("action = 'create'").select("req_key"), "req_key")
    return made.select("req_key", F.concat(F.lit("R-"), (F.col("place") + 100000).cast("string")).alias("fresh_key"))


@query("dangling_refs", "SELECT DISTINCT o_custkey * 3 % 2000 AS ref FROM orders EXCEPT SELECT c_custkey FROM customer")
def dangling_refs(spark, sf_dir):
    refs = S.table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3 % 2000).alias("ref")).distinct()
    return refs.join(S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref")), "ref", "left_anti")
