"""Whether a command line is a project-wide gate (a test, lint or build run) rather than evidence of its own: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import let

#: One word of a POSIX command line: plain characters, escapes, and quoted parts.
_WORD = r"""((?:[^\s"'\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*')+)"""
_BALANCED = r"""^(?:[^"'\\]|\\.|"(?:[^"\\]|\\.)*+"|'[^']*+')*+$"""
_QUOTES = r""""((?:[^"\\]|\\.)*)"|'([^']*)'|\\(.)"""

#: Shells that run a command string, and the commands and scripts that check a whole project.
SHELLS = ("sh", "bash", "dash")
TESTERS = ("pytest", "py.test")
CARGO = ("test", "build", "clippy")
PACKAGERS, SCRIPTS = ("npm", "pnpm", "yarn"), ("test", "build", "lint")
UNWRAPS = 3


def command_words(command: Column) -> Column:
    """The words of a command line without their quotes; null when a quote is left open."""
    words = F.transform(F.regexp_extract_all(command, F.lit(_WORD), 1), lambda w: F.regexp_replace(w, _QUOTES, "$1$2$3"))
    return F.when(command.rlike(_BALANCED), words)


def _unwrapped(words: Column) -> Column:
    """The words behind one shell or runner, or the same words."""
    word = lambda k: F.get(words, F.lit(k))
    long = F.size(words) >= 3
    shell = long & F.lower(word(0)).isin(*SHELLS) & (word(1) == "-c")
    runner = long & (word(0) == "uv") & (word(1) == "run")
    return F.when(shell, command_words(word(2))).when(runner, F.slice(words, F.lit(3), F.greatest(F.size(words), F.lit(0)))).otherwise(words)


def _is_gate(words: Column) -> Column:
    word = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    flags_from = lambda k: F.forall(F.slice(words, F.lit(k + 1), F.greatest(F.size(words), F.lit(1))), lambda w: w.startswith("-"))
    script = lambda k: word(k).isin(*SCRIPTS) & flags_from(k + 1)
    return (
        F.when((word(0) == "just") & (word(1) == "check"), flags_from(2))
        .when(word(0).isin(*TESTERS), flags_from(1))
        .when((word(0) == "cargo") & word(1).isin(*CARGO), flags_from(2))
        .when(word(0).isin(*PACKAGERS), F.when(word(1) == "run", script(2)).otherwise(script(1)))
        .otherwise(F.lit(False))
    )


def generic_command(command: Column) -> Column:
    """True if the command, freed of up to ``UNWRAPS`` shells and runners, is a gate with flags only; a null is none."""
    words = command_words(command)
    for _ in range(UNWRAPS):
        words = let(words, _unwrapped)
    lowered = F.transform(words, F.lower)
    return F.coalesce(let(lowered, _is_gate), F.lit(False))
