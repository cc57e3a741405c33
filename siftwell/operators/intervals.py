"""State as validity intervals of a command log: what was in force at any place of it, without a replay.

A command opens or closes an interval of its entity, ``[since, until)`` in places of the log; ``until`` is null while it is open. What a
child may do, and when it can be seen, follows from interval joins with its parent: a parent's deletion hides all below it, and its
restoration shows them again as they were. State as of a place is the intervals that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEVER = (1 << 62)


def holds(at: Column, since: Column, until: Column) -> Column:
    """Whether a place lies in an interval."""
    return (since <= at) & (until.isNull() | (at < until))


def judged(log: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """``log`` (entity_id, parent_id, seq, op, ...) with the ``outcome`` of each command.

    ``create`` opens an entity, anew after a deletion (``exists`` while it is open); ``restore`` opens a deleted one; ``delete`` and ``update``
    need an open one (``missing``). With ``parents`` (entity_id, since, until), commands at places where the parent can't be seen are
    ``hidden`` and change nothing. What a command finds is the last opening or closing one before it, as each leaves a known state.
    """
    rows = log
    if parents is not None:
        p = parents.select(F.col("entity_id").alias("parent_id"), "since", "until")
        seen = log.join(p, "parent_id").where(holds(F.col("seq"), F.col("since"), F.col("until"))).select("seq", F.lit(True).alias("seen"))
        rows = log.join(seen, "seq", "left").withColumn("hidden", F.col("seen").isNull()).drop("seen")
    else:
        rows = log.withColumn("hidden", F.lit(False))
    own = Window.partitionBy("entity_id", "hidden").orderBy("seq")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    created = F.min(F.when(F.col("op") == "create", F.col("seq"))).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = F.when(F.col("created").isNull() | (F.col("seq") < F.col("created")), None).when(F.col("op").isin("create", "restore"), True).when(F.col("op") == "delete", False)
    rows = rows.withColumn("created", created).withColumn("left", left)
    rows = rows.withColumn("was", F.last("left", ignorenulls=True).over(before))
    open_ = F.coalesce("was", F.lit(False))
    outcome = (
        F.when(F.col("hidden"), "hidden")
        .when(F.col("op") == "create", F.when(open_, "exists").otherwise("applied"))
        .when(F.col("op") == "restore", F.when(open_, "exists").when(F.col("was").isNull(), "missing").otherwise("applied"))
        .otherwise(F.when(open_, "applied").otherwise("missing"))
    )
    return rows.withColumn("outcome", outcome).drop("created", "left", "was", "hidden")


def lifetimes(commands: DataFrame) -> DataFrame:
    """(entity_id, parent_id, since, until) from judged commands: an applied create or restore opens, an applied delete closes."""
    turns = commands.where("outcome = 'applied' AND op <> 'update'")
    next_ = F.lead("seq").over(Window.partitionBy("entity_id").orderBy("seq"))
    return turns.withColumn("until", next_).where("op <> 'delete'").select("entity_id", "parent_id", F.col("seq").alias("since"), "until")


def inherited(own: DataFrame, parents: DataFrame) -> DataFrame:
    """(entity_id, parent_id, since, until): the stretches of ``own`` lifetimes in which the parent can be seen too."""
    p = parents.select(F.col("entity_id").alias("parent_id"), F.col("since").alias("p_since"), F.col("until").alias("p_until"))
    both = own.join(p, "parent_id")
    ends = lambda c: F.coalesce(F.col(c), F.lit(NEVER))
    both = both.where((F.col("since") < ends("p_until")) & (F.col("p_since") < ends("until")))
    until = F.nullif(F.least(ends("until"), ends("p_until")), F.lit(NEVER))
    return both.select("entity_id", "parent_id", F.greatest("since", "p_since").alias("since"), until.alias("until"))


def revisions(commands: DataFrame, fields: list[str]) -> DataFrame:
    """(entity_id, revision, since, until, fields...) of judged commands: every applied one is a revision; a field it leaves null stays as it was.

    A create after a deletion begins with nothing of the former life.
    """
    own = Window.partitionBy("entity_id").orderBy("seq")
    rows = commands.where("outcome = 'applied'")
    rows = rows.withColumn("life", F.sum(F.when(F.col("op") == "create", 1).otherwise(0)).over(own)).withColumn("revision", F.row_number().over(own).cast("long"))
    life = Window.partitionBy("entity_id", "life").orderBy("seq")
    held = [F.last(f, ignorenulls=True).over(life).alias(f) for f in fields]
    return rows.select("entity_id", "revision", F.col("seq").alias("since"), F.lead("seq").over(own).alias("until"), *held)


def as_of(intervals: DataFrame, at: Column) -> DataFrame:
    """The intervals that hold the place ``at``, one column or literal for each row."""
    return intervals.where(holds(at, F.col("since"), F.col("until")))


def bound(records: DataFrame, criteria: DataFrame, versions: DataFrame) -> DataFrame:
    """Evidence ``records`` (criterion_id, seq, kind, ...) with ``outcome``, and of accepted ones the ``revision`` they are bound to and when they are superseded and stale.

    ``criteria``: visible lifetimes; ``versions``: revisions with ``evidence_kind``. A record at a place where its criterion can't be seen is
    ``hidden``; one that is neither of the criterion's kind nor a review is of the wrong ``kind``. It is superseded by the next record of
    the same criterion, kind and revision, and stale from the criterion's next revision on.
    """
    seen = criteria.select(F.col("entity_id").alias("criterion_id"), F.col("since").alias("c_since"), F.col("until").alias("c_until"))
    seen = records.select("criterion_id", "seq").join(seen, "criterion_id").where(holds(F.col("seq"), F.col("c_since"), F.col("c_until"))).select("seq", F.lit(True).alias("seen"))
    v = versions.select(F.col("entity_id").alias("criterion_id"), "revision", F.col("evidence_kind").alias("wanted"), F.col("since").alias("v_since"), F.col("until").alias("stale_at"))
    v = records.select("criterion_id", "seq").join(v, "criterion_id").where(holds(F.col("seq"), F.col("v_since"), F.col("stale_at"))).select("seq", "revision", "wanted", "stale_at")
    rows = records.join(seen, "seq", "left").join(v, "seq", "left")
    outcome = F.when(F.col("seen").isNull(), "hidden").when((F.col("kind") != "review") & ~F.col("kind").eqNullSafe(F.col("wanted")), "kind").otherwise("applied")
    rows = rows.withColumn("outcome", outcome).drop("seen", "wanted")
    slot = Window.partitionBy("criterion_id", "kind", "revision", "outcome").orderBy("seq")
    applied = F.col("outcome") == "applied"
    return rows.withColumn("superseded_at", F.when(applied, F.lead("seq").over(slot))).withColumn("stale_at", F.when(applied, F.col("stale_at")))


def lifecycle_at(evidence: DataFrame, at: Column) -> DataFrame:
    """The accepted records up to ``at`` with their ``lifecycle`` there: stale, superseded, or as recorded."""
    rows = evidence.where((F.col("outcome") == "applied") & (F.col("seq") <= at))
    past = lambda c: F.col(c).isNotNull() & (F.col(c) <= at)
    return rows.withColumn("lifecycle", F.when(past("stale_at"), "stale").when(past("superseded_at"), "superseded").otherwise(F.col("recorded")))


def violation_intervals(added: DataFrame, resolved: DataFrame, invariants: DataFrame) -> DataFrame:
    """``added`` violations (violation_id, invariant_id, seq, ...) with ``since``, ``until`` (the first resolve after it) and ``outcome``.

    One added at a place where its invariant can't be seen is ``hidden``. ``resolved``: (violation_id, seq); repeated resolves change nothing.
    """
    seen = invariants.select(F.col("entity_id").alias("invariant_id"), "since", "until")
    seen = added.select("invariant_id", "seq").join(seen, "invariant_id").where(holds(F.col("seq"), F.col("since"), F.col("until"))).select("seq", F.lit(True).alias("seen"))
    ends = added.select("violation_id", "seq").join(resolved.select("violation_id", F.col("seq").alias("r")), "violation_id").where("r > seq")
    ends = ends.groupBy("violation_id").agg(F.min("r").alias("until"))
    rows = added.join(seen, "seq", "left").join(ends, "violation_id", "left").withColumn("since", F.col("seq"))
    return rows.withColumn("outcome", F.when(F.col("seen").isNull(), "hidden").otherwise("applied")).drop("seen")
