"""Conversation structure repair by the cheapest edits, found in a Spark SQL higher-order fold.

A repaired conversation has the role initials ``(s?(ua)+)?``. Windows over a conversation's turns give each turn its first
fault; the turns' codes are collected in order, in blocks of at most ``BLOCK``; ``aggregate()`` carries four structs
(cost, audit), one for each state of the pattern (nothing yet, after s, after u, after a), and ``least`` picks the cheaper
one, of equal costs the ASCII-least audit. A block after the first is folded from each of the four states, so the blocks of a
long conversation join in a second fold over their 4 x 4 tables. The audit has one letter for each edit in order:
K(eep) 0, R(erole) 3, D(elete) 4, I(nsert) 3; a truncated turn that isn't deleted adds 3; blank and duplicate turns must be deleted.

Two audits that lead to one state at one cost never extend each other (an insert more costs 3 more), so the least
audit of every state is all that a later turn needs.

``apply_edits`` gives the repaired turns themselves: sorted rows stream through, so no conversation is held as a whole;
only its audit is. A conversation's SHA-256 is sequential, so one conversation's turns pass through one task; its memory doesn't grow with them.

Defined results for odd input: null roles and texts are one space (so a null text is blank, and a null role has no valid
initial); null turns come first and don't count for gaps; turns of equal number are ordered by role, then text; rows with a null
conv_id are one conversation with a null id; a turn with an empty role can't be kept as it is; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch

BLOCK = 512  #: turns that are collected at a time
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
STATES = "nsua"  #: nothing yet, after system, after user, after assistant
_NEVER = 1 << 50  #: the cost of a state that can't be reached
_BLANK = r"[^\x20\x09-\x0D]"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows after the damage that crc32 of ``conv_id:turn`` modulo 20 deals.

    0 drops a row (it stays as a marker with ``gone``, so that its conversation isn't forgotten), 1 empties its text, 2 takes the ``[.!?]``
    out of it, 3 repeats it, 4 sets its role to user.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    text = F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", space))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    gone = F.col("kind") == 0
    keep = lambda c: F.when(~gone, F.col(c)).alias(c)
    return rows.select("conv_id", *[keep(c) for c in ("turn", "role", "text")], gone.alias("gone"))


def flagged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, gone) with their place, first fault, initial, the initial before, and whether the turn number is new.

    All windows need rows together by conversation, so one exchange serves them and the folds that follow.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    own = Window.partitionBy("conv_id", "gone").orderBy(*order)
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("place")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(~F.col("text").rlike(_BLANK), "b").when(F.col("again") > 1, "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    )
    before = F.lag(F.struct("turn", F.substring("role", 1, 1).alias("initial"))).over(own)
    rows = turns.withColumn("place", F.row_number().over(own)).withColumn("before", before).withColumn("again", F.row_number().over(same))
    rows = rows.withColumn("initial", F.substring("role", 1, 1)).withColumn("fault", fault)
    new = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before.turn"))
    legal = F.concat("before.initial", "initial").isin("su", "ua", "au")
    return rows.select(
        "conv_id", "turn", "role", "text", "gone", "place", "initial", "fault", new.alias("new_turn"), (F.col("before").isNotNull() & ~legal).alias("illegal")
    )


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _paid(state: Column, cost: int | Column, letter: str | Column) -> Column:
    more = cost if isinstance(cost, Column) else F.lit(cost)
    return _state(state["cost"] + more, F.concat(state["audit"], F.lit(letter) if isinstance(letter, str) else letter))


def _four(n: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(n.alias("n"), s.alias("s"), u.alias("u"), a.alias("a"))


def _inserted(n: Column, s: Column, u: Column, a: Column) -> Column:
    """The states after the inserts that pay: one leads to u, one or two to a."""
    after_u = F.least(u, *[_paid(x, INSERT, "I") for x in (n, s, a)])
    return _four(n, s, after_u, F.least(a, _paid(after_u, INSERT, "I")))


def _step(four: Column, turn: Column) -> Column:
    """The states after one turn (initial, fault), and the inserts that may follow it."""
    n, s, u, a = (four[c] for c in STATES)
    free = ~turn["fault"].isin("b", "d")
    more = F.when(turn["fault"] == "t", TRUNCATED).otherwise(0)

    def taken(before: Column, initial: str) -> Column:
        keep = turn["initial"] == initial
        return F.when(free, _paid(before, more + F.when(keep, 0).otherwise(REROLE), F.when(keep, "K").otherwise("R")))

    system = F.when(free & (turn["initial"] == "s"), _paid(n, more, "K"))
    gone = {c: _paid(x, DELETE, "D") for c, x in zip(STATES, (n, s, u, a), strict=True)}
    return _inserted(
        gone["n"], F.least(gone["s"], system), F.least(gone["u"], taken(F.least(n, s, a), "u")), F.least(gone["a"], taken(u, "a"))
    )


def _start(state: str) -> list[Column]:
    return [_state(F.lit(0 if c == state else _NEVER), F.lit("")) for c in STATES]


def _joined(four: Column, table: Column) -> Column:
    """The states after a block, from those before it and the block's table (from each state to each state)."""

    def to(c: str) -> Column:
        ways = [(four[b], table[b][c]) for b in STATES]
        return F.least(*[_state(F.least(x["cost"] + y["cost"], F.lit(_NEVER)), F.concat(x["audit"], y["audit"])) for x, y in ways])

    return _four(*[to(c) for c in STATES])


def repair_plan(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``flagged`` turns."""
    here = ~F.col("gone")
    count = lambda c: F.sum(F.when(here & c, 1).otherwise(0)).cast("long")
    code = F.when(here, F.struct("place", "initial", "fault"))
    fault = F.col("fault")
    blocks = turns.groupBy("conv_id", F.floor((F.col("place") - 1) / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(code)).alias("codes"),
        F.min(F.when(here, F.col("turn"))).alias("low"), F.max(F.when(here, F.col("turn"))).alias("high"), count(F.col("new_turn")).alias("turns"),
        count(fault == "b").alias("blank"), count(fault == "d").alias("duplicate"), count(fault == "t").alias("truncated"), count(F.col("illegal")).alias("illegal"),
    )
    # a conversation begins before its first block, in one state; only later blocks are entered in all four
    first, never = F.col("block") == 0, _four(*_start(""))
    table = F.struct(*[F.when(first, F.aggregate("codes", _inserted(*_start("n")), _step) if c == "n" else never).otherwise(F.aggregate("codes", _four(*_start(c)), _step)).alias(c) for c in STATES])
    blocks = blocks.withColumn("table", table)
    sums = ("turns", "blank", "duplicate", "truncated", "illegal")
    whole = blocks.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("block", "table"))), lambda x: x["table"]).alias("tables"),
        F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in sums],
    )
    end = F.aggregate("tables", _four(*_start("n")), _joined, lambda four: F.least(four["n"], four["a"]))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    whole = whole.withColumn("end", end)
    return whole.select("conv_id", gaps.alias("gaps"), *sums[1:], F.col("end.cost").alias("cost"), F.col("end.audit").alias("audit"))


def _by_conversation(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns in order, together in one partition."""
    head = plan.select("conv_id", F.lit(0).alias("place"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = turns.where(~F.col("gone")).select("conv_id", "place", F.lit(None).cast("string").alias("audit"), "role", "text")
    return head.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, edit, place, role, text) of the repaired turns, from (conv_id, place, audit, role, text) rows in order."""
    conv, audit, at, said = None, "", 0, 0
    first = 0  #: 1 after a kept system turn

    def inserted() -> Iterator[tuple]:
        nonlocal at, said
        while at < len(audit) and audit[at] == "I":
            yield conv, "I", said, ("user", "assistant")[(said - first) % 2], ""
            at, said = at + 1, said + 1

    for conv_, place, audit_, role, text in rows:
        if place == 0:
            conv, audit, at, said, first = conv_, audit_, 0, 0, 0
        else:
            edit = audit[at]
            at += 1
            if edit != "D":
                first = 1 if said == 0 and edit == "K" and role[:1] == "s" else first
                yield conv, edit, said, role if edit == "K" else ("user", "assistant")[(said - first) % 2], text
                said += 1
        yield from inserted()


_REPAIRED = "edit string, place long, role string, text string"


def apply_edits(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, edit, place, role, text): the repaired turns, of each conversation together and in order."""
    rows = _by_conversation(turns, plan)

    def packed(held: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        kinds = (ids, pa.string(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "edit", "place", "role", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source(ids: list[pa.DataType]) -> Iterator[tuple]:
            for batch in batches:
                ids.append(batch.column(0).type)
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        ids: list[pa.DataType] = []
        held, size = [], 0
        for row in edited(source(ids)):
            held.append(row)
            size += len(row[4])
            if len(held) == 4096 or size > 1 << 22:
                yield packed(held, ids[0])
                held, size = [], 0
        if held:
            yield packed(held, ids[0])

    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_REPAIRED}")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations with repaired turns: of their ``role:text``, joined by newlines."""
    schema = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running = None, None
        for batch in batches:
            done = []
            for c, place, role, text in zip(*[batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("conv_id", "place", "role", "text")], strict=True):
                if place == 0:
                    if running is not None:
                        done.append((conv, running.hexdigest()))
                    conv, running = c, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            yield answer(done, batch)
        if running is not None:
            yield answer([(conv, running.hexdigest())], batch)

    def answer(done: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        ids = pa.array([c for c, _ in done], like.schema.field("conv_id").type)
        return pa.RecordBatch.from_arrays([ids, pa.array([d for _, d in done], pa.string())], names=["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(run, f"conv_id {schema}, repaired_sha256 string")


def repair(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(plan, repaired turns) of the rows (conv_id, turn, role, text, gone) of all conversations."""
    turns = scratch.save(flagged(turns), "turns")
    plan = scratch.save(repair_plan(turns), "plan")
    return plan, apply_edits(turns, plan)


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """Damages ``conversations``, repairs them, and gives one row for each: the plan and the digest of the repaired turns."""
    plan, repaired = repair(damage(conversations), Scratch(conversations.sparkSession, "repair"))
    found = digests(repaired).withColumnRenamed("conv_id", "of")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    rows = plan.join(found, plan["conv_id"].eqNullSafe(found["of"]), "left")
    return rows.drop("of").withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing))
