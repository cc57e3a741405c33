"""Queries of contract state over a command log: lifetimes with inherited deletions, and the gate as of a place of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators import contracts as C
from siftwell.operators import intervals as V
from siftwell.plans.catalog import Catalog
from siftwell.plans.contracts import _GATE
from siftwell.sources import tables as S
from siftwell.sources.scratch import WrittenTables

CATALOG = Catalog()
query = CATALOG.query

FIELDS = ["evidence_kind", "required", "independent_review"]
_END = V.NEVER


def _level(name: str, entity: str, parent: str, of: str, parents: str | None) -> str:
    seen = f"NOT EXISTS (SELECT 1 FROM {parents}_seen v WHERE v.e = l.p AND v.since <= l.seq AND (v.until IS NULL OR l.seq < v.until))" if parents else "false"
    shown = f"""SELECT o.e, o.p, greatest(o.since, v.since) AS since, nullif(least(coalesce(o.until, {_END}), coalesce(v.until, {_END})), {_END}) AS until FROM {name}_own o JOIN {parents}_seen v ON v.e = o.p
      WHERE o.since < coalesce(v.until, {_END}) AND v.since < coalesce(o.until, {_END})""" if parents else f"SELECT * FROM {name}_own"  # fmt: skip
    return f"""{name}_log AS (SELECT l.*, {seen} AS hidden FROM (SELECT *, {entity} AS e, {parent} AS p FROM log WHERE n IN ({of})) l),
      {name}_first AS (SELECT *, min(CASE WHEN op = 'create' THEN seq END) OVER (PARTITION BY e, hidden) AS created FROM {name}_log),
      {name}_left AS (SELECT *, CASE WHEN created IS NULL OR seq < created THEN NULL WHEN op IN ('create', 'restore') THEN 1 WHEN op = 'delete' THEN 0 END AS lft FROM {name}_first),
      {name}_was AS (SELECT *, last_value(lft IGNORE NULLS) OVER (PARTITION BY e, hidden ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM {name}_left),
      {name}_judged AS (SELECT *, CASE WHEN hidden THEN 'hidden' WHEN op = 'create' THEN CASE WHEN coalesce(was, 0) = 1 THEN 'exists' ELSE 'applied' END
        WHEN op = 'restore' THEN CASE WHEN coalesce(was, 0) = 1 THEN 'exists' WHEN was IS NULL THEN 'missing' ELSE 'applied' END WHEN coalesce(was, 0) = 1 THEN 'applied' ELSE 'missing' END AS outcome FROM {name}_was),
      {name}_own AS (SELECT e, p, seq AS since, until FROM (SELECT *, lead(seq) OVER (PARTITION BY e ORDER BY seq) AS until FROM {name}_judged WHERE outcome = 'applied' AND op <> 'update') WHERE op <> 'delete'),
      {name}_seen AS ({shown})"""


_LEVELS = f"""{S.CONTRACT_LOG_SQL}, {_level("r", "requirement_id", "0", "0", None)}, {_level("i", "invariant_id", "requirement_id", "1, 2", "r")},
  {_level("c", "criterion_id", "invariant_id", "3, 4, 5", "i")},
  lives AS (SELECT *, sum(CASE WHEN op = 'create' THEN 1 ELSE 0 END) OVER w AS life, row_number() OVER w AS revision, lead(seq) OVER w AS until FROM c_judged WHERE outcome = 'applied' WINDOW w AS (PARTITION BY e ORDER BY seq)),
  versions AS (SELECT e, revision, seq AS since, until, last_value(evidence_kind IGNORE NULLS) OVER w AS evidence_kind, last_value(required IGNORE NULLS) OVER w AS required,
    last_value(independent_review IGNORE NULLS) OVER w AS independent_review FROM lives WINDOW w AS (PARTITION BY e, life ORDER BY seq)),
  judged_records AS (SELECT r.*, v.revision, CASE WHEN NOT EXISTS (SELECT 1 FROM c_seen s WHERE s.e = r.criterion_id AND s.since <= r.seq AND (s.until IS NULL OR r.seq < s.until)) THEN 'hidden'
      WHEN r.kind <> 'review' AND r.kind IS DISTINCT FROM v.evidence_kind THEN 'kind' ELSE 'applied' END AS outcome, v.until AS v_until
    FROM records r LEFT JOIN versions v ON v.e = r.criterion_id AND v.since <= r.seq AND (v.until IS NULL OR r.seq < v.until)),
  bound AS (SELECT *, CASE WHEN outcome = 'applied' THEN v_until END AS stale_at, CASE WHEN outcome = 'applied' THEN lead(seq) OVER (PARTITION BY criterion_id, kind, revision, outcome ORDER BY seq) END AS superseded_at FROM judged_records),
  spans AS (SELECT f.*, f.seq AS since, (SELECT min(r.seq) FROM resolves r WHERE r.violation_id = f.violation_id AND r.seq > f.seq) AS until,
    CASE WHEN EXISTS (SELECT 1 FROM i_seen s WHERE s.e = f.invariant_id AND s.since <= f.seq AND (s.until IS NULL OR f.seq < s.until)) THEN 'applied' ELSE 'hidden' END AS outcome FROM found f)"""

#: What the gate reads, as of each requirement's place.
_AT = f"""{_LEVELS},
  criteria AS (SELECT s.e AS criterion_id, s.e // 4 AS requirement_id, s.p AS invariant_id, v.evidence_kind, v.required, v.independent_review, s.p % 3 = 0 AS high_risk FROM c_seen s JOIN places t ON t.requirement_id = s.e // 4
    JOIN versions v ON v.e = s.e AND v.since <= t.spot AND (v.until IS NULL OR t.spot < v.until) WHERE s.since <= t.spot AND (s.until IS NULL OR t.spot < s.until)),
  evidence AS (SELECT b.criterion_id, b.kind, b.seq, CASE WHEN b.stale_at <= t.spot THEN 1 ELSE 2 END AS revision, b.recorded, b.result, b.author, b.review_ref FROM bound b JOIN places t USING (requirement_id) WHERE b.outcome = 'applied' AND b.seq <= t.spot),
  violations AS (SELECT requirement_id, severity, CASE WHEN until <= spot THEN 'resolved' ELSE 'open' END AS status FROM spans JOIN places USING (requirement_id) WHERE outcome = 'applied' AND since <= spot)"""
_GATE_AT = _GATE.replace(S.CONTRACTS_SQL, _AT)
_GATE_AT = _GATE_AT[: _GATE_AT.rindex("gate AS (")]


class History:
    """The relations of one contract log, each written once as several others read it."""

    def __init__(self, spark, sf_dir):
        written = WrittenTables(spark, "history")
        self.log = written.save(S.contract_log(spark, sf_dir))
        level = lambda entity, parent, of: self.log.where(F.col("n").isin(*of)).select(entity.alias("entity_id"), parent.alias("parent_id"), "seq", "op", *FIELDS)
        self.requirements = V.lifetimes(V.judged(level(F.col("requirement_id"), F.lit(0), [0])))
        self.invariant_commands = written.save(V.judged(level(F.col("invariant_id"), F.col("requirement_id"), [1, 2]), self.requirements))
        self.invariants = written.save(V.inherited(V.lifetimes(self.invariant_commands), self.requirements))
        self.criterion_commands = written.save(V.judged(level(F.col("criterion_id"), F.col("invariant_id"), [3, 4, 5]), self.invariants))
        self.criteria = written.save(V.inherited(V.lifetimes(self.criterion_commands), self.invariants))
        self.versions = written.save(V.revisions(self.criterion_commands, FIELDS))
        self.records, self.found, self.resolves = S.contract_records(self.log)

    def places(self) -> DataFrame:
        """(requirement_id, at): a place of the log for each requirement."""
        last = self.log.agg(F.max("seq")).first()[0] or 0
        of = self.log.select("requirement_id").distinct()
        return of.withColumn("at", F.floor(F.lit(last) * (1 + F.col("requirement_id") % 3) / 3).cast("long"))


@query(
    "contract_lifetimes",
    f"WITH {_LEVELS} SELECT 'requirement' AS kind, e AS entity_id, since, until FROM r_seen UNION ALL SELECT 'invariant', e, since, until FROM i_seen UNION ALL SELECT 'criterion', e, since, until FROM c_seen",
)
def contract_lifetimes(spark, sf_dir):
    h = History(spark, sf_dir)
    named = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "entity_id", "since", "until")
    return named(h.requirements, "requirement").unionByName(named(h.invariants, "invariant")).unionByName(named(h.criteria, "criterion"))


@query(
    "contract_commands",
    f"WITH {_LEVELS} SELECT 'invariant' AS kind, op, outcome, count(*) AS commands FROM i_judged GROUP BY ALL UNION ALL SELECT 'criterion', op, outcome, count(*) FROM c_judged GROUP BY ALL",
)
def contract_commands(spark, sf_dir):
    h = History(spark, sf_dir)
    rows = h.invariant_commands.withColumn("kind", F.lit("invariant")).unionByName(h.criterion_commands.withColumn("kind", F.lit("criterion")))
    return rows.groupBy("kind", "op", "outcome").agg(F.count("*").alias("commands"))


@query("criterion_revisions", f"WITH {_LEVELS} SELECT e AS criterion_id, revision, since, until, evidence_kind, required, independent_review FROM versions")
def criterion_revisions(spark, sf_dir):
    return History(spark, sf_dir).versions.withColumnRenamed("entity_id", "criterion_id")


@query(
    "criteria_as_of",
    f"WITH {_AT} SELECT criterion_id, requirement_id, evidence_kind, required FROM criteria",
)
def criteria_as_of(spark, sf_dir):
    h = History(spark, sf_dir)
    return _criteria_at(h, h.places()).select("criterion_id", "requirement_id", "evidence_kind", "required")


def _criteria_at(h: History, places: DataFrame) -> DataFrame:
    rows = h.criteria.withColumn("requirement_id", F.floor(F.col("entity_id") / 4).cast("long")).join(places, "requirement_id")
    rows = V.as_of(rows, F.col("at")).select(F.col("entity_id").alias("criterion_id"), F.col("parent_id").alias("invariant_id"), "requirement_id", "at")
    versions = rows.select("criterion_id", "at").join(h.versions.withColumnRenamed("entity_id", "criterion_id"), "criterion_id")
    versions = V.as_of(versions, F.col("at")).select("criterion_id", *FIELDS)
    return rows.drop("at").join(versions, "criterion_id").withColumn("high_risk", F.col("invariant_id") % 3 == 0)


@query(
    "evidence_records",
    f"WITH {_LEVELS} SELECT seq, criterion_id, kind, outcome, CASE WHEN outcome <> 'applied' THEN NULL WHEN stale_at IS NOT NULL THEN 'stale' WHEN superseded_at IS NOT NULL THEN 'superseded' ELSE recorded END AS lifecycle FROM bound",
)
def evidence_records(spark, sf_dir):
    """Every record and what has become of it by the end of the log."""
    h = History(spark, sf_dir)
    rows = V.bound(h.records, h.criteria, h.versions)
    lifecycle = F.when(F.col("stale_at").isNotNull(), "stale").when(F.col("superseded_at").isNotNull(), "superseded").otherwise(F.col("recorded"))
    return rows.select("seq", "criterion_id", "kind", "outcome", F.when(F.col("outcome") == "applied", lifecycle).alias("lifecycle"))


@query("violation_intervals", f"WITH {_LEVELS} SELECT violation_id, invariant_id, severity, outcome, since, until FROM spans")
def violation_intervals(spark, sf_dir):
    h = History(spark, sf_dir)
    return V.violation_intervals(h.found, h.resolves, h.invariants).select("violation_id", "invariant_id", "severity", "outcome", "since", "until")


@query(
    "gate_as_of",
    f"""{_GATE_AT} gate AS (SELECT requirement_id, ac_total, ac_verified, missing, stale, blocking FROM per FULL JOIN block USING (requirement_id))
      SELECT requirement_id, coalesce(ac_verified, 0) = coalesce(ac_total, 0) AND coalesce(blocking, 0) = 0 AS passed, coalesce(ac_total, 0) AS ac_total, coalesce(ac_verified, 0) AS ac_verified,
        coalesce(missing, 0) AS missing, coalesce(stale, 0) AS stale, coalesce(blocking, 0) AS blocking FROM gate""",
)
def gate_as_of(spark, sf_dir):
    """The close gate of each requirement as it stood at that requirement's place of the log."""
    h = History(spark, sf_dir)
    places = h.places()
    evidence = V.bound(h.records, h.criteria, h.versions).join(places, "requirement_id")
    evidence = V.lifecycle_at(evidence, F.col("at"))
    evidence = evidence.withColumn("revision", F.when(F.col("lifecycle") == "stale", C.CURRENT_REVISION - 1).otherwise(C.CURRENT_REVISION))
    evidence = evidence.select("criterion_id", "kind", "seq", "revision", "recorded", "result", "author", "review_ref")
    violations = V.violation_intervals(h.found, h.resolves, h.invariants).where("outcome = 'applied'").join(places, "requirement_id").where("since <= at")
    violations = violations.select("requirement_id", "severity", F.when(F.col("until") <= F.col("at"), "resolved").otherwise("open").alias("status"))
    gate = C.close_gate(_criteria_at(h, places), evidence, violations)
    return gate.select("requirement_id", "passed", "ac_total", "ac_verified", "missing", "stale", "blocking")
