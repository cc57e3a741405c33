"""Strict validation of JSON documents: a tree of rules compiled to expressions over variant values, listing every fault with its path.

A fault is ``path: code``. Codes are type, missing, unknown (a field the rules don't name), empty, too_long, too_few, too_many, range,
choice, path (not from the repository's root), json (no JSON at all) and those of a rule's own checks. A rule's expressions contain those of the rules below it, so one projection judges a whole document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import let

_NONE = "array<string>"


def _fault(path: Column, code: str) -> Column:
    return F.array(F.concat(path, F.lit(f": {code}")))


def _none() -> Column:
    return F.array().cast(_NONE)


def _kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL..., DOUBLE, BOOLEAN, VOID, ARRAY or OBJECT."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _field(rule: Rule, path: Column, none: Column) -> Callable[[Column], Column]:
    """The faults of a field's value; ``none`` for an absent one."""
    return lambda one: F.when(one.isNull() | (_kind(one) == "VOID"), none).otherwise(rule.faults(one, path))


class Rule:
    def faults(self, value: Column, path: Column) -> Column:
        raise NotImplementedError


@dataclass
class Text(Rule):
    """A string of 1 to ``most`` characters, or one of ``choices``."""

    most: int | None = None
    choices: tuple[str, ...] = ()
    empty: bool = False
    relative: bool = False  #: a path from the repository's root

    def faults(self, value: Column, path: Column) -> Column:
        return let(F.trim(F.try_variant_get(value, "$", "string")), lambda text: self._judged(_kind(value), text, path))

    def _judged(self, kind: Column, text: Column, path: Column) -> Column:
        out = F.when(kind != "STRING", _fault(path, "type"))
        if not self.empty:
            out = out.when(text == "", _fault(path, "empty"))
        if self.most is not None:
            out = out.when(F.length(text) > self.most, _fault(path, "too_long"))
        if self.relative:
            plain = F.regexp_replace(F.regexp_replace(text, r"\\", "/"), r"^(\./)+", "")
            out = out.when(plain.rlike(r"^$|^/|//|/$|(^|/)\.\.(/|$)"), _fault(path, "path"))
        if self.choices:
            out = out.when(~text.isin(*self.choices), _fault(path, "choice"))
        return out.otherwise(_none())


@dataclass
class Whole(Rule):
    """A whole number from ``least`` to ``most``."""

    least: int
    most: int

    def faults(self, value: Column, path: Column) -> Column:
        number = F.try_variant_get(value, "$", "long")
        bad = (_kind(value) != "BIGINT") & ~_kind(value).isin("TINYINT", "SMALLINT", "INT")
        return F.when(bad, _fault(path, "type")).when(~number.between(self.least, self.most), _fault(path, "range")).otherwise(_none())


@dataclass
class Flag(Rule):
    def faults(self, value: Column, path: Column) -> Column:
        return F.when(_kind(value) != "BOOLEAN", _fault(path, "type")).otherwise(_none())


@dataclass
class Many(Rule):
    """A list of ``least`` to ``most`` items."""

    item: Rule
    least: int = 0
    most: int | None = None
    #: (name, fault code) of a further check over the items: an expression that is true where it fails
    also: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def faults(self, value: Column, path: Column) -> Column:
        below = let(F.try_variant_get(value, "$", "array<variant>"), lambda items: self._judged(items, path))
        return F.when(_kind(value) != "ARRAY", _fault(path, "type")).otherwise(below)

    def _judged(self, items: Column, path: Column) -> Column:
        size = F.size(items)
        own = [F.when(size < self.least, _fault(path, "too_few")).otherwise(_none())]
        if self.most is not None:
            own.append(F.when(size > self.most, _fault(path, "too_many")).otherwise(_none()))
        own += [F.when(F.coalesce(check(items), F.lit(False)), _fault(path, code)).otherwise(_none()) for code, check in self.also.items()]
        each = lambda x, i: let(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), lambda at: self.item.faults(x, at))
        return F.concat(*own, F.flatten(F.transform(items, each)))


@dataclass
class Fields(Rule):
    """An object with these fields and no others; those in ``optional`` may be absent or null."""

    rules: dict[str, Rule]
    optional: tuple[str, ...] = ()
    #: fault path below this object and code -> a check of the whole object that is true where it fails
    also: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def faults(self, value: Column, path: Column) -> Column:
        held = F.try_variant_get(value, "$", "map<string,variant>")
        parts = []
        for name, rule in self.rules.items():
            at = F.concat(path, F.lit(f".{name}"))
            none = _none() if name in self.optional else _fault(at, "missing")
            parts.append(let(F.try_variant_get(value, f"$.{name}", "variant"), _field(rule, at, none)))
        others = F.filter(F.map_keys(held), lambda k: ~k.isin(*self.rules))
        parts.append(F.transform(F.array_sort(others), lambda k: F.concat(path, F.lit("."), k, F.lit(": unknown"))))
        parts += [F.when(F.coalesce(check(value), F.lit(False)), F.array(F.concat(path, F.lit(code)))).otherwise(_none()) for code, check in self.also.items()]
        return F.when(_kind(value) != "OBJECT", _fault(path, "type")).otherwise(F.concat(*parts))


def faults(document: Column, rule: Rule) -> Column:
    """All faults of a JSON text, in the order of the rules; empty for a valid one."""
    # each value is bound once: an expression that is named several times would be parsed and cut out again each time
    return let(F.try_parse_json(document), lambda value: F.when(value.isNull(), _fault(F.lit("$"), "json")).otherwise(rule.faults(value, F.lit("$"))))


def _repeated(name: str) -> Callable[[Column], Column]:
    def check(items: Column) -> Column:
        names = F.transform(items, lambda x: F.try_variant_get(x, f"$.{name}", "string"))
        return F.size(names) > F.size(F.array_distinct(names))

    return check


def _texts(value: Column, path: str, name: str) -> Column:
    """One text field of each object in a list."""
    return F.transform(F.try_variant_get(value, path, "array<variant>"), lambda x: F.try_variant_get(x, f"$.{name}", "string"))


def _dangling(value: Column) -> Column:
    tasks = _texts(value, "$.tasks", "local_task_id")
    ends = F.concat(_texts(value, "$.dependencies", "task_local_id"), _texts(value, "$.dependencies", "depends_on_local_id"))
    return F.size(F.array_except(ends, tasks)) > 0


def _self(items: Column) -> Column:
    return F.exists(items, lambda x: F.try_variant_get(x, "$.task_local_id", "string") == F.try_variant_get(x, "$.depends_on_local_id", "string"))


#: The limits of a plan draft.
TITLE, LONG_TEXT, NOTES, TASK_ID = 160, 8000, 4000, 32
_TASK = Fields(
    {
        "local_task_id": Text(TASK_ID),
        "title": Text(TITLE),
        "objective": Text(LONG_TEXT),
        "acceptance_criteria": Many(Text(400), 0, 20),
        "linked_files": Many(Text(400, relative=True), 0, 20),
        "requirement_ids": Many(Text(80), 0, 20),
    },
    ("acceptance_criteria", "linked_files", "requirement_ids"),
)
_DEPENDENCY = Fields({"task_local_id": Text(TASK_ID), "depends_on_local_id": Text(TASK_ID)})
DRAFT = Fields(
    {
        "title": Text(TITLE),
        "goal": Text(LONG_TEXT),
        "tasks": Many(_TASK, 1, 30, {"repeated": _repeated("local_task_id")}),
        "dependencies": Many(_DEPENDENCY, 0, None, {"self": _self}),
        "notes": Text(NOTES, empty=True),
    },
    ("dependencies", "notes"),
    {".dependencies: dangling": _dangling},
)

#: What the fields of entries, invariants and criteria may say.
SECTIONS = ("overview", "focus", "blockers", "bugs", "conventions", "decisions", "requirements", "glossary", "features")
ENTRY = Fields(
    {
        "section": Text(choices=SECTIONS),
        "headline": Text(120),
        "detail": Text(8000, empty=True),
        "status": Text(choices=("open", "resolved", "deleted", "archived")),
        "requirement_status": Text(choices=("not-started", "in-progress", "blocked", "done")),
        "priority": Whole(0, 100),
    },
    ("detail", "requirement_status"),
)
INVARIANT = Fields(
    {
        "key": Text(64),
        "statement": Text(2000),
        "kind": Text(choices=("behavior", "architecture", "data-boundary", "forbidden-path", "integration", "manual")),
        "risk": Text(choices=("low", "medium", "high")),
        "sort_order": Whole(0, 1 << 31),
        "author": Text(120),
    },
    ("key", "sort_order", "author"),
)
CRITERION = Fields(
    {
        "key": Text(64),
        "statement": Text(2000),
        "evidence_kind": Text(choices=("test", "command", "review", "manual", "file")),
        "required": Flag(),
        "independent_review": Text(choices=("not-required", "required")),
        "sort_order": Whole(0, 1 << 31),
        "author": Text(120),
    },
    ("key", "required", "independent_review", "sort_order", "author"),
)
