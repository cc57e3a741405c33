"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

Logs often hold a conversation several times, each time a few turns longer. A rolling hash stands for every
turn prefix: the exclusive or of 128-bit hashes of (position, role, text). A conversation whose whole hash is
a strict prefix hash of another is dropped by an anti-join; of equal conversations the least conv_id stays.
What remains is rendered.

A conversation may be of any length: positions and rolling hashes are computed in blocks of ``BLOCK`` turns
joined by block totals, and a rendered row holds ``BLOCK`` turns at most. So a conversation of up to ``BLOCK`` turns
is one row (segment 0), a longer one is several.

Defined results for odd input: turns come in order of (turn, role, text), null turns last; exactly repeated
rows count once; a null role is ``unknown`` and a null text empty; rows with a null conv_id belong to no conversation
and are left out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _running(rows: DataFrame, value: Column, name: str, block: Column, within: Column, before: Column) -> DataFrame:
    """Adds ``before`` (over the blocks that precede) to rows, as column ``name`` of a block-wise running value."""
    totals = rows.groupBy("conv_id", block.alias("block")).agg(value.alias("total"))
    order = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "block", before.over(order).alias(name))
    return rows.withColumn("block", block).withColumn("within", within).join(totals, ["conv_id", "block"])


def positions(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the distinct turns with their 0-based place in the conversation."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = turns.dropDuplicates(["conv_id", "turn", "role", "text"])
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(1 << 62)).cast("long")
    place = F.row_number().over(
        Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    )
    rows = _running(turns, F.count("*"), "offset", block, place, F.sum("total"))
    return rows.select("conv_id", (F.coalesce("offset", F.lit(0)) + F.col("within") - 1).alias("pos"), "role", "text")


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b): the hash pair of each turn prefix, ending with the turn at ``pos``."""
    own = turns.select(
        "conv_id",
        "pos",
        F.xxhash64("pos", "role", "text").alias("a"),
        F.xxhash64("text", "role", "pos", F.lit("second")).alias("b"),
    )
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    both = lambda f: F.struct(f("a").alias("a"), f("b").alias("b"))
    totals = own.groupBy("conv_id", block.alias("block")).agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"))
    order = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "block", F.bit_xor("ta").over(order).alias("ca"), F.bit_xor("tb").over(order).alias("cb"))
    rows = own.withColumn("block", block).withColumn("x", both(lambda c: F.bit_xor(c).over(inside)))
    return rows.join(carried, ["conv_id", "block"]).select(
        "conv_id",
        "pos",
        F.col("x.a").bitwiseXOR(F.coalesce("ca", F.lit(0).cast("long"))).alias("a"),
        F.col("x.b").bitwiseXOR(F.coalesce("cb", F.lit(0).cast("long"))).alias("b"),
    )


def maximal_conversations(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no strict prefix of another, one of each set of equals."""
    rolling = scratch.save(rolling_hashes(turns), "rolling")
    # bit_xor telescopes: the whole hash is that of the last position, which max_by finds with partial sums
    whole = rolling.groupBy("conv_id").agg(F.max(F.struct("pos", "a", "b")).alias("x"))
    whole = whole.select("conv_id", (F.col("x.pos") + 1).alias("n_turns"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    ends = whole.select("conv_id", (F.col("n_turns") - 1).alias("last"))
    longest = whole.groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    strict = (
        rolling.join(ends, "conv_id").where("pos < last").select((F.col("pos") + 1).alias("n_turns"), "a", "b").distinct()
    )
    return longest.join(strict, ["n_turns", "a", "b"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, n_copies, rendered): the maximal conversations in chat markup."""
    scratch = Scratch(conversations.sparkSession, "chat")
    turns = scratch.save(positions(conversations), "turns")
    kept = maximal_conversations(turns, scratch)
    piece = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(f"{CLOSE}\n"))
    rows = turns.join(kept, "conv_id").select(
        "conv_id", F.floor(F.col("pos") / BLOCK).cast("long").alias("segment"), "n_turns", "n_copies", F.struct("pos", piece.alias("piece")).alias("p")
    )
    parts = rows.groupBy("conv_id", "segment").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list("p")).alias("p")
    )
    return parts.select("conv_id", "segment", "n_turns", "n_copies", F.array_join("p.piece", "").alias("rendered"))
