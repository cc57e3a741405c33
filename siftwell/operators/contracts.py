"""Requirement contracts: evidence lifecycle, the close gate, exceptions, warnings, file merge, key allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.commands import generic_command
from siftwell.sources.scratch import WrittenTables

CURRENT_REVISION = 2
REUSE_THRESHOLD = 3
WARNING_CODES = (
    "dirty-no-fingerprint", "excessive-test-reuse", "missing-commit-ref", "missing-file-test-ref", "reviewer-author-collision", "security-generic-command",
)
SECURITY_TERMS = ("security", "auth", "secret", "permission", "access", "injection")
#: How much a requirement's status adds to its place, and the order of risks.
STATUS_BOOST = {"blocked": 20, "in-progress": 15, "not-started": 5, "done": -20}
RISK_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def lifecycle(evidence: DataFrame, current_revision: int = CURRENT_REVISION) -> DataFrame:
    """``evidence`` with ``lifecycle``: stale (older revision), superseded (not the latest of its slot), else as recorded."""
    stale = F.col("revision") != current_revision
    slot = Window.partitionBy("criterion_id", "kind")
    latest = F.max(F.when(~stale, F.col("seq"))).over(slot)
    return evidence.withColumn("lifecycle", F.when(stale, "stale").when(F.col("seq") != latest, "superseded").otherwise(F.col("recorded")))


def judged(criteria: DataFrame, evidence: DataFrame) -> DataFrame:
    """``criteria`` with ``verdict``: verified, missing, stale, failed, or what is wrong with the independent review.

    One grouping of the evidence by criterion finds the latest implementation and review evidence of the current
    revision and whether any older implementation evidence passed.
    """
    e = lifecycle(evidence)
    own = e.join(criteria.select("criterion_id", "evidence_kind"), "criterion_id")
    now = F.col("revision") == CURRENT_REVISION
    impl, review = F.col("kind") == F.col("evidence_kind"), F.col("kind") == "review"
    fields = F.struct("result", "lifecycle", F.lower(F.trim("author")).alias("author"), "review_ref")
    per = own.groupBy("criterion_id").agg(
        F.max_by(F.when(now & impl, fields), F.when(now & impl, F.col("seq"))).alias("impl"),
        F.max_by(F.when(now & review, fields), F.when(now & review, F.col("seq"))).alias("review"),
        F.coalesce(F.bool_or(impl & (F.col("result") == "passed")), F.lit(False)).alias("ever_passed"),
    )
    scope = F.array(F.concat(F.lit("criterion:"), "criterion_id"), F.concat(F.lit("invariant:"), "invariant_id"))
    i, r = F.col("impl"), F.col("review")
    verdict = (
        F.when(i.isNull(), F.when(F.col("ever_passed"), "stale").otherwise("missing"))
        .when(i.result != "passed", "failed")
        .when(i.lifecycle != "verified", "stale")
        .when(~F.col("independent_review") & ~F.col("high_risk"), "verified")
        .when(r.isNull(), "review-missing")
        .when(r.result != "passed", "review-failed")
        .when(r.lifecycle != "verified", "review-stale")
        .when(r.author == i.author, "review-self")
        .when(~F.array_contains(scope, r.review_ref), "review-scope")
        .otherwise("verified")
    )
    return criteria.join(per, "criterion_id", "left").withColumn("verdict", verdict).drop("impl", "review", "ever_passed")


def close_gate(criteria: DataFrame, evidence: DataFrame, violations: DataFrame) -> DataFrame:
    """(requirement_id, configured, passed, ac_total, ac_verified, missing, stale, blocking, validation, review)."""
    v = F.col("verdict")
    required = F.col("required")
    lacking = v.isin("missing", "failed", "review-missing", "review-failed", "review-self", "review-scope")
    per = judged(criteria, evidence).groupBy("requirement_id").agg(
        F.count("*").alias("criteria"),
        F.count_if(required).alias("ac_total"),
        F.count_if(required & (v == "verified")).alias("ac_verified"),
        F.count_if(required & lacking).alias("missing"),
        F.count_if(required & v.isin("stale", "review-stale")).alias("stale"),
        F.count_if(required & v.startswith("review-")).alias("reviews"),
    )
    blocking = violations.where("status = 'open' AND severity = 'blocking'").groupBy("requirement_id").agg(F.count("*").alias("blocking"))
    zero = F.lit(0).cast("long")
    rows = per.join(blocking, "requirement_id", "full")
    n = lambda c: F.coalesce(F.col(c), zero)
    return rows.select(
        "requirement_id",
        ((n("criteria") > 0) | (n("blocking") > 0)).alias("configured"),
        ((n("ac_verified") == n("ac_total")) & (n("blocking") == 0)).alias("passed"),
        n("ac_total").alias("ac_total"),
        n("ac_verified").alias("ac_verified"),
        n("missing").alias("missing"),
        n("stale").alias("stale"),
        n("blocking").alias("blocking"),
        F.when(n("stale") > 0, "stale").otherwise("ok").alias("validation"),
        F.when((n("blocking") > 0) | (n("reviews") > 0), "failed").otherwise("passed").alias("review"),
    )


def warnings(criteria: DataFrame, evidence: DataFrame) -> DataFrame:
    """(requirement_id, codes): sorted warning codes of the evidence that isn't superseded."""
    current = lifecycle(evidence).where("lifecycle <> 'superseded'")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    bare = F.col("kind").isin("test", "file") & (F.coalesce(F.col("test_ref"), F.lit("")) == "")
    per = current.groupBy("requirement_id").agg(
        F.bool_or((F.coalesce("source_commit", F.lit("")) == "") | no(F.col("commit_verified"))).alias("missing-commit-ref"),
        F.bool_or((F.col("test_ref").isNotNull() & (F.col("ref_verified") == F.lit(False))) | bare).alias("missing-file-test-ref"),
        F.bool_or((F.col("recorded") == "provisional") & F.col("fingerprint").isNull()).alias("dirty-no-fingerprint"),
    )
    verified = current.where("lifecycle = 'verified'")
    touches = F.lower("statement").rlike("|".join(SECURITY_TERMS))
    secured = criteria.where(touches).select("criterion_id")
    gates = verified.where((F.col("kind") == "command") & generic_command(F.col("command_ref"))).join(secured, "criterion_id", "left_semi")
    flags = {"excessive-test-reuse": excessive_reuse(verified), "reviewer-author-collision": collisions(verified), "security-generic-command": gates}
    rows = per
    for code, found in flags.items():
        rows = rows.join(found.select("requirement_id").distinct().withColumn(code, F.lit(True)), "requirement_id", "left")
    codes = F.array_compact(F.array(*[F.when(F.col(f"`{c}`"), F.lit(c)) for c in WARNING_CODES]))
    return rows.select("requirement_id", F.array_join(F.array_sort(codes), ",").alias("codes"))


def test_key(ref: Column) -> Column:
    """A test reference as it is counted: slashes one way and single, no leading ``./``, case folded."""
    slashed = F.regexp_replace(F.regexp_replace(F.trim(ref), r"\\", "/"), r"^(\./)+", "")
    return F.lower(F.regexp_replace(F.regexp_replace(slashed, "/+", "/"), "^/|/$", ""))


def excessive_reuse(verified: DataFrame) -> DataFrame:
    """(requirement_id, test_ref, criteria): tests that stand for more than REUSE_THRESHOLD criteria."""
    refs = verified.where("test_ref IS NOT NULL AND test_ref <> ''")
    pairs = refs.select("requirement_id", test_key(F.col("test_ref")).alias("test_ref"), "criterion_id").distinct()
    return pairs.groupBy("requirement_id", "test_ref").agg(F.count("*").alias("criteria")).where(F.col("criteria") > REUSE_THRESHOLD)


def statement_order(invariants: DataFrame) -> DataFrame:
    """(requirement_id, invariant_id, place): blocking first, then forbidden paths, risk, missing evidence, stale evidence, sort order and key.

    ``invariants``: (requirement_id, invariant_id, key, kind, risk, sort_order, blocking, missing, stale).
    """
    risk = F.lit(9)
    for name, rank in RISK_ORDER.items():
        risk = F.when(F.col("risk") == name, rank).otherwise(risk)
    last = lambda c: (~F.coalesce(F.col(c), F.lit(False))).cast("int")
    order = [last("blocking"), (F.col("kind") != "forbidden-path").cast("int"), risk, last("missing"), last("stale"), "sort_order", "key"]
    place = F.row_number().over(Window.partitionBy("requirement_id").orderBy(*order))
    return invariants.select("requirement_id", "invariant_id", place.cast("long").alias("place"))


def ranked_requirements(requirements: DataFrame, keep: int = 3) -> DataFrame:
    """(entry_id, score, place, omitted) of the ``keep`` requirements that match a task best, of those that match at all.

    ``requirements``: (entry_id, req_key, title, status, score). Finished ones are left out; ties go by the status, then key, title and id.
    The first ones of each part are found first, so only those of all parts meet in one task.
    """
    boost = F.lit(0)
    for status, n in STATUS_BOOST.items():
        boost = F.when(F.col("status") == status, n).otherwise(boost)
    rows = requirements.where("status <> 'done' AND score > 0").withColumn("boost", boost)
    order = [F.desc("score"), F.desc("boost"), "req_key", "title", "entry_id"]
    total = rows.groupBy(F.lit("all").alias("of")).agg(F.count("*").alias("n"))
    best = rows.orderBy(*order).limit(keep).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    best = best.withColumn("of", F.lit("all")).join(total, "of")  # at most ``keep`` rows with one
    return best.select("entry_id", "score", "place", F.greatest(F.col("n") - keep, F.lit(0).cast("long")).alias("omitted"))


def fit_lines(lines: DataFrame, budget: int, fixed: Column, by: str = "requirement_id") -> DataFrame:
    """(by, place, line): the statements of each contract that fit ``budget`` tokens beside ``fixed`` characters, in order up to the first that doesn't.

    A first statement that doesn't fit is cut to what is left, if that is anything. ``lines``: (by, place, line).
    """
    room = F.lit(budget * T.CHARS_PER_TOKEN) - fixed
    order = Window.partitionBy(by).orderBy("place")
    used = F.sum(F.length("line") + 1).over(order)
    rows = lines.withColumn("over", used > room).withColumn("stopped", F.max(F.col("over").cast("int")).over(order) == 1)
    first = F.col("place") == 1
    cut = F.concat(F.rtrim(F.substring(F.col("line"), F.lit(1), F.greatest(room - 2, F.lit(0)).cast("int"))), F.lit(T.ELLIPSIS))
    rows = rows.where(~F.col("stopped") | (first & (room > 2)))
    return rows.select(by, "place", F.when(F.col("over"), cut).otherwise(F.col("line")).alias("line"))


def collisions(verified: DataFrame) -> DataFrame:
    """(requirement_id, criterion_id, author): authors who review what they made."""
    name = F.lower(F.trim("author")).alias("author")
    roles = verified.select("requirement_id", "criterion_id", name, (F.col("kind") == "review").alias("reviews"))
    both = roles.groupBy("requirement_id", "criterion_id", "author").agg(F.bool_or("reviews").alias("a"), F.bool_or(~F.col("reviews")).alias("b"))
    return both.where("a AND b").select("requirement_id", "criterion_id", "author")


def three_way(file: DataFrame, store: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(req_key, action, status): what a sync does with each key of the file, the store and the last snapshot.

    file and snapshot: (req_key, title, status); store also (archived). Where both status values changed since the
    snapshot, the store wins.
    """
    f = file.select("req_key", F.col("title").alias("ft"), F.col("status").alias("fs"), F.lit(True).alias("f"))
    s = store.select("req_key", F.col("title").alias("st"), F.col("status").alias("ss"), "archived", F.lit(True).alias("s"))
    n = snapshot.select("req_key", F.col("status").alias("ns"), F.lit(True).alias("n"))
    rows = f.join(s, "req_key", "full").join(n, "req_key", "left")
    in_file, in_store = F.col("f").isNotNull(), F.col("s").isNotNull()
    file_changed = F.col("ns").isNotNull() & (F.col("fs") != F.col("ns"))
    store_changed = F.col("ns").isNull() | (F.col("ss") != F.col("ns"))
    action = (
        F.when(in_file & ~in_store, "create")
        .when(in_file & F.col("archived"), "leave-archived")
        .when(in_file & (F.col("fs") == F.col("ss")), F.when(F.col("ft") != F.col("st"), "update-text").otherwise("keep"))
        .when(in_file & file_changed & ~store_changed, "file-wins")
        .when(in_file & file_changed, "conflict-store-wins")
        .when(in_file, "store-wins")
        .when(F.col("archived"), "ignore")
        .when(F.col("n").isNotNull(), "archive")
        .otherwise("append")
    )
    rows = rows.withColumn("action", action)
    status = F.when(F.col("action").isin("create", "file-wins"), F.col("fs")).otherwise(F.col("ss"))
    return rows.select("req_key", "action", status.alias("status"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place``, 1 and up in the given total order, without one task that sees all rows.

    Rows are dealt by range and written; each part counts its own, and the few part totals are summed up.
    """
    written = WrittenTables(rows.sparkSession, "numbered")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written.save(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("own", own).join(totals, "part").withColumn("place", F.col("before") + F.col("own")).drop("part", "own", "before")


def first_free(used: DataFrame, group: str, number: str) -> DataFrame:
    """(group, free): the least number from 1 that a group doesn't use.

    It is one more than the last number of the run that begins with 1: with distinct numbers, those equal to their place.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(number))
    rows = used.select(group, number).where(F.col(number) >= 1).distinct().withColumn("place", place)
    run = F.count_if(F.col(number) == F.col("place"))
    groups = used.select(group).distinct()
    found = rows.groupBy(group).agg((run + 1).alias("free"))
    return groups.join(found, group, "left").select(group, F.coalesce("free", F.lit(1).cast("long")).alias("free"))
