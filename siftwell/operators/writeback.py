"""Requirement files written back: line edits from the store, applied by one ordered merge.

Only heading ids and the managed ``<!-- req ... -->`` lines are edited, requirements that the file lacks are appended; every other line
stays byte for byte. What a written file says equals the store, and writing it again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEADING = r"^###\s+"
_MANAGED = r"^\s*<!--\s*req\s.*-->\s*$"
_KEYED = r"^###\s+([A-Z]+-\d+)\s+—\s+"


class DuplicateKeys(ValueError):
    """A requirement key that stands twice in one file."""


def duplicate_keys(found: DataFrame) -> DataFrame:
    """(file, req_key, times) of the keys that several blocks of a file have."""
    return found.where("req_key IS NOT NULL").groupBy("file", "req_key").agg(F.count("*").alias("times")).where("times > 1")


def heading_line(key: Column, title: Column) -> Column:
    return F.concat(F.lit("### "), key, F.lit(" — "), title)


def file_lines(files: DataFrame) -> DataFrame:
    """(file, pos, line, block, managed): the lines of ``files`` (file, content); a block is the running count of headings, 0 before the first."""
    rows = files.select("file", F.posexplode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("pos", "line"))
    order = Window.partitionBy("file").orderBy("pos")
    heading = F.col("line").rlike(_HEADING)
    rows = rows.withColumn("heading", heading).withColumn("block", F.sum(F.col("heading").cast("long")).over(order))
    # the managed line is the first line with anything in it after the heading
    written = ~F.col("heading") & (F.trim("line") != "")
    first = F.min(F.when(written, F.col("pos"))).over(Window.partitionBy("file", "block"))
    managed = (F.col("block") > 0) & F.col("pos").eqNullSafe(first) & F.col("line").rlike(_MANAGED)
    return rows.withColumn("managed", managed)


def blocks(lines: DataFrame) -> DataFrame:
    """(file, block, pos, req_key, title, token_pos, token, status) of each heading."""
    of = lines.where("block > 0").groupBy("file", "block").agg(
        F.min(F.when(F.col("heading"), F.struct("pos", "line"))).alias("h"), F.min(F.when(F.col("managed"), F.struct("pos", "line"))).alias("t")
    )
    line = F.col("h.line")
    key = F.regexp_extract(line, _KEYED, 1)
    status = F.regexp_extract("t.line", r"\bstatus=(\S+)", 1)
    return of.select(
        "file", "block", F.col("h.pos").alias("pos"), F.nullif(key, F.lit("")).alias("req_key"), F.trim(F.regexp_replace(line, r"^###\s+(?:[A-Z]+-\d+\s+—\s+)?", "")).alias("title"),
        F.col("t.pos").alias("token_pos"), F.col("t.line").alias("token"), F.coalesce(F.nullif(status, F.lit("")), F.lit("not-started")).alias("status"),
    )


def assigned(found: DataFrame, store: DataFrame, prefix: str = "R") -> DataFrame:
    """``found`` blocks with a key for each that has none: the numbers after the file's and the store's last, in order of place."""
    number = F.regexp_extract("req_key", rf"^{prefix}-(\d+)$", 1).try_cast("long")
    last = found.select("file", number.alias("n")).unionByName(store.select("file", number.alias("n"))).groupBy("file").agg(F.coalesce(F.max("n"), F.lit(0)).alias("last"))
    place = F.row_number().over(Window.partitionBy("file", F.col("req_key").isNull()).orderBy("pos"))
    rows = found.withColumn("place", place).join(last, "file")
    new = F.concat(F.lit(f"{prefix}-"), F.lpad((F.col("last") + F.col("place")).cast("string"), 3, "0"))
    keyless = F.col("req_key").isNull()
    return rows.withColumn("new", keyless).withColumn("req_key", F.when(keyless, new).otherwise(F.col("req_key"))).drop("place", "last")


def edits(found: DataFrame, store: DataFrame) -> DataFrame:
    """(file, pos, text, insert): the line edits that make the blocks say what the store (file, req_key, status) says; an insert goes before its line."""
    heads = found.where("new").select("file", "pos", heading_line(F.col("req_key"), F.col("title")).alias("text"), F.lit(False).alias("insert"))
    differ = found.join(store.select("file", "req_key", F.col("status").alias("wanted")), ["file", "req_key"]).where(F.col("wanted") != F.col("status"))
    token = F.when(F.col("token").rlike(r"\bstatus=\S+"), F.regexp_replace("token", F.lit(r"\bstatus=\S+"), F.concat(F.lit("status="), "wanted")))
    token = token.otherwise(F.regexp_replace("token", F.lit(r"<!--\s*req\s"), F.concat(F.lit("<!-- req status="), "wanted", F.lit(" "))))
    plain = F.concat(F.lit("<!-- req status="), "wanted", F.lit(" -->"))
    lines = differ.select(
        "file", F.coalesce("token_pos", F.col("pos") + 1).alias("pos"), F.coalesce(token, plain).alias("text"), F.col("token_pos").isNull().alias("insert")
    )
    return heads.unionByName(lines)


def new_blocks(found: DataFrame, store: DataFrame) -> DataFrame:
    """(file, req_key, lines): blocks for requirements that the file lacks; archived ones are left out."""
    missing = store.where("NOT archived").join(found.select("file", "req_key"), ["file", "req_key"], "left_anti")
    head = F.array(F.lit(""), heading_line(F.col("req_key"), F.col("title")), F.concat(F.lit("<!-- req status="), "status", F.lit(" -->")))
    prose = F.btrim(F.coalesce("prose", F.lit("")), F.lit("\n"))
    lines = F.when(prose == "", head).otherwise(F.concat(head, F.array(F.lit("")), F.split(prose, "\n")))
    return missing.select("file", "req_key", lines.alias("lines"))


def merged(lines: DataFrame, changes: DataFrame, appended: DataFrame) -> DataFrame:
    """(file, place, line): the lines after the edits; ``place`` orders them."""
    place = lambda pos, rank, key: F.struct(pos.cast("long").alias("pos"), F.lit(rank).alias("rank"), key.cast("string").alias("key"), F.lit(0).alias("k"))
    none = F.lit("")
    replaced = changes.where("NOT insert").select("file", "pos", "text")
    own = lines.join(replaced, ["file", "pos"], "left").select("file", place(F.col("pos"), 1, none).alias("place"), F.coalesce("text", "line").alias("line"))
    put = changes.where("insert").select("file", place(F.col("pos"), 0, none).alias("place"), F.col("text").alias("line"))
    at = F.struct(F.lit(1 << 40).cast("long").alias("pos"), F.lit(1).alias("rank"), F.col("req_key").alias("key"), F.col("k").alias("k"))
    more = appended.select("file", "req_key", F.posexplode("lines").alias("k", "line")).select("file", at.alias("place"), "line")
    return own.unionByName(put).unionByName(more)


def written(files: DataFrame, store: DataFrame, prefix: str = "R") -> DataFrame:
    """(file, content, changed): ``files`` (file, content) after the store (file, req_key, title, status, prose, archived) is written into them.

    A changed file ends with one newline; an unchanged one stays as it is.
    """
    lines = file_lines(files)
    found = assigned(blocks(lines), store, prefix)
    changes, appended = edits(found, store), new_blocks(found, store)
    rows = merged(lines, changes, appended)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    new = rows.groupBy("file").agg(F.concat(F.rtrim(text, F.lit("\n")), F.lit("\n")).alias("new"))
    touched = changes.select("file").unionByName(appended.select("file")).distinct().withColumn("changed", F.lit(True))
    out = files.join(new, "file", "left").join(touched, "file", "left")
    changed = F.coalesce("changed", F.lit(False))
    return out.select("file", F.when(changed, F.col("new")).otherwise(F.col("content")).alias("content"), changed.alias("changed"))
