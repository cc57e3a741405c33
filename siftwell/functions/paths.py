"""Path guards and ignore rules as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import let


def _resolved(path: Column) -> Column:
    """The parts of a relative path after ``.`` and ``..`` are taken away; null when it leaves its root."""
    parts = F.filter(F.split(F.trim(path), "/"), lambda p: ~p.isin("", "."))
    none = F.lit(None).cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        up = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(none)
        return F.when(kept.isNull(), none).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def path_fault(path: Column) -> Column:
    """Why a path is refused: ``not-relative`` (empty, absolute or a home), ``outside`` (climbs over its root); else null."""
    plain = F.trim(F.coalesce(path, F.lit("")))
    return F.when((plain == "") | plain.startswith("/") | plain.startswith("~"), "not-relative").when(_resolved(plain).isNull(), "outside")


def normal_path(path: Column) -> Column:
    """The path from the root, without ``.``, ``..`` and doubled slashes; null for a refused one."""
    return F.when(path_fault(path).isNull(), let(_resolved(path), lambda parts: F.array_join(parts, "/")))


def rule_regex(rule: str) -> str:
    """A regular expression for one ignore rule: a slash inside ties it to its folder, ``**`` crosses folders, ``*`` doesn't."""
    body = rule.rstrip("/")
    tied = "/" in body
    body = body.lstrip("/")
    out, at = "", 0
    while at < len(body):
        if body.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif body.startswith("/**", at) and at + 3 == len(body):
            out, at = out + "/.*", at + 3
        elif body[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif body[at] == "?":
            out, at = out + "[^/]", at + 1
        elif body[at] == "[" and "]" in body[at + 2 :]:
            end = body.index("]", at + 2)
            inner = body[at + 1 : end].replace("\\", "\\\\")
            out, at = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        elif body[at] == "\\" and at + 1 < len(body):
            out, at = out + "\\" + body[at + 1], at + 2
        else:
            out, at = out + (body[at] if body[at].isalnum() or body[at] in "/_" else "\\" + body[at]), at + 1
    return ("^" if tied else "(?:^|/)") + out + ("/" if rule.endswith("/") else "(?:/|$)")


def rules_of(text: str, folder: str = "") -> list[tuple[str, bool]]:
    """(expression, ignores) of each line of an ignore file that lies in ``folder``; ``!`` takes back what an earlier line ignored."""
    out = []
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        ignores = not rule.startswith("!")
        rule = rule if ignores else rule[1:]
        regex = rule_regex(rule)
        if folder:
            inside = "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in folder.strip("/"))
            regex = f"^{inside}/" + regex[1:] if regex.startswith("^") else f"^{inside}/(?:.*/)?" + regex.removeprefix("(?:^|/)")
        out.append((regex, ignores))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]], allow: list[tuple[str, bool]] | None = None) -> Column:
    """Whether a path is left out: the last rule that matches decides; with an allow-list, paths outside it are left out too."""

    def decided(of: list[tuple[str, bool]]) -> Column:
        return F.coalesce(*[F.when(path.rlike(regex), F.lit(takes)) for regex, takes in reversed(of)], F.lit(False))

    return decided(rules) | ~decided(allow) if allow else decided(rules)
