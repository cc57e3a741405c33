"""Curated entries: visibility, relevance to a task, the briefing's lines and its budget."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators.contracts import numbered

HIDDEN = ("deleted", "archived")


def visible(entries: DataFrame, expiry_days: int | None = None, include_resolved: bool = False, keep_section: str = "overview") -> DataFrame:
    """Entries that are shown: not hidden, not resolved unless asked for, and then not expired by age (inclusive)."""
    rows = entries.where(~F.col("status").isin(*HIDDEN))
    if include_resolved:
        return rows
    rows = rows.where("status <> 'resolved'")
    if expiry_days:
        rows = rows.where((F.col("age_days") < expiry_days) | (F.col("section") == keep_section))
    return rows


def relevance(headline: Column, linked: Column | None, task: str, focus: str = "", ranked_paths: tuple[str, ...] = (), focus_paths: tuple[str, ...] = ()) -> Column:
    """Match score of an entry for a task: shared paths, its title in the task, shared words with task and focus."""
    hit = lambda ws: F.arrays_overlap(T.words3(headline), F.array(*[F.lit(w) for w in ws])) if ws else F.lit(False)
    points = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    title = F.lower(headline)
    in_task = (title != "") & F.contains(F.lit(task.lower()), title)
    score = F.when(in_task, 40).when(hit(_words(task)), 25).otherwise(0) + points(hit(_words(focus)), 15)
    if linked is not None:
        clean = F.ltrim(F.lower(linked), F.lit("./"))
        touch = lambda paths: F.exists(F.array(*[F.lit(p.lower().lstrip("./")) for p in paths]), lambda c: F.contains(clean, c) | F.contains(c, clean)) if paths else F.lit(False)
        score = score + points(touch(ranked_paths), 100) + points(touch(focus_paths), 70) + points(F.contains(F.lit(task.lower()), F.lower(linked)), 80)
    return score


#: What each sign of a match adds to an entry's score.
RANKED_PATH, FOCUS_PATH, PATH_IN_TASK, RELATED = 100, 70, 80, 120


def linked_points(linked: Column, task: str, ranked_paths: tuple[str, ...] = (), focus_paths: tuple[str, ...] = ()) -> Column:
    """What an entry's linked files (an array) add: one that touches a ranked path, one that touches a focus path, one that the task names.

    Two paths touch when one has the other in it, as text, without leading dots and slashes.
    """
    clean = F.transform(linked, lambda x: F.ltrim(F.lower(x), F.lit("./")))
    points = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)

    def touches(paths: tuple[str, ...]) -> Column:
        wanted = F.array(*[F.lit(p.lower().lstrip("./")) for p in paths])
        return F.exists(clean, lambda a: F.exists(wanted, lambda b: F.contains(a, b) | F.contains(b, a))) if paths else F.lit(False)

    named = F.exists(linked, lambda x: F.contains(F.lit(task.lower()), F.lower(x)))
    return points(touches(ranked_paths), RANKED_PATH) + points(touches(focus_paths), FOCUS_PATH) + points(named, PATH_IN_TASK)


def related_points(related: Column, requirements: tuple) -> Column:
    """What an entry adds that is tied to one of the task's own requirements."""
    return F.when(F.coalesce(related.isin(*requirements), F.lit(False)), RELATED).otherwise(0) if requirements else F.lit(0)


def requirement_lines(requirements: DataFrame) -> DataFrame:
    """(place, line): a summary of all requirements (entry_id, headline, status, priority), then the blocked ones and those in progress, each by priority.

    A null status is not-started. Places are given by ranges, so no task holds all lines.
    """
    rows = requirements.withColumn("status", F.coalesce("status", F.lit("not-started")))
    n = lambda s: F.count_if(F.col("status") == s).cast("string")
    parts = [n("done"), F.lit("/"), F.count("*").cast("string"), F.lit(" done · "), n("in-progress"), F.lit(" in progress · "), n("blocked"), F.lit(" blocked · "), n("not-started"), F.lit(" not started")]
    summary = rows.agg(F.count("*").alias("n"), F.concat(*parts).alias("line")).where("n > 0").select(F.lit(0).cast("long").alias("place"), "line")
    open_ = rows.where("status IN ('blocked', 'in-progress')").withColumn("later", F.when(F.col("status") == "blocked", 0).otherwise(1)).withColumn("least", -F.col("priority"))
    placed = numbered(open_, "later", "least", "entry_id")
    line = F.concat(F.lit("- ["), "entry_id", F.lit("] ["), "status", F.lit("] "), "headline")
    return summary.unionByName(placed.select(F.col("place").cast("long").alias("place"), line.alias("line")))


def key_points(key: Column, task: str) -> Column:
    """What a requirement adds whose key the task names."""
    return F.when((key != "") & F.contains(F.lit(task.lower()), F.lower(key)), 50).otherwise(0)


def _words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[A-Za-z0-9_]{3,}", text.lower())))


def top_per_section(entries: DataFrame, keep: int, order: list, by: str = "section", salt: int = 64, id_: str = "entry_id") -> DataFrame:
    """The first ``keep`` entries of each section, ``place`` from 1, and how many are ``omitted``.

    A section may hold most rows, so each salt of it gives its own first entries before the section's are chosen,
    and its size is a count with partial sums.
    """
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    salted = entries.withColumn("salt", F.pmod(F.xxhash64(id_), F.lit(salt)))
    few = salted.withColumn("place", first(by, "salt")).where(F.col("place") <= keep).drop("salt")
    best = few.withColumn("place", first(by).cast("long")).where(F.col("place") <= keep)
    sizes = entries.groupBy(by).agg(F.count("*").alias("n"))
    return best.join(sizes, by).withColumn("omitted", F.greatest(F.col("n") - keep, F.lit(0).cast("long"))).drop("n")


def briefing(
    entries: DataFrame, budget: int, per_section: int, related: Column | None = None, related_first: tuple[str, ...] = (), recent_first: tuple[str, ...] = ()
) -> DataFrame:
    """(section, place, line, used): lines of the first entries of each section while the section's running tokens fit.

    Entries come by priority, then age. In the sections ``related_first`` those that are ``related`` to the focus come before
    the others, in the sections ``recent_first`` the youngest come first.
    """
    section = F.col("section")
    order = [F.desc("priority"), "age_days", "entry_id"]
    if recent_first:
        order.insert(0, F.when(section.isin(*recent_first), F.col("age_days")).otherwise(0))
    if related is not None and related_first:
        order.insert(0, F.when(section.isin(*related_first) & ~F.coalesce(related, F.lit(False)), 1).otherwise(0))
    rows = top_per_section(entries, per_section, order)
    line = F.concat(F.lit("- ["), "entry_id", F.lit("] "), "headline")
    used = F.sum(T.token_estimate(F.col("line"))).over(Window.partitionBy("section").orderBy("place"))
    return rows.withColumn("line", line).withColumn("used", used).where(F.col("used") <= budget).select("section", "place", "line", "used")
