"""Row filters on entries (FLT-2 to FLT-7)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import glob_match
from ..functions.paths import mode_bits, under, unsafe
from ..functions.rulesets import decided

#: So many rules stay regular expressions in the JVM; more are one automaton.
FEW_RULES = 32


def rules_of(filters: Iterable[str] = (), includes: Iterable[str] = (), excludes: Iterable[str] = ()) -> list[tuple[bool, str]]:
    """(include, pattern) in order of precedence: filter rules, then includes, then excludes."""
    rules = []
    for rule in filters:
        sign, _, pattern = rule.strip().partition(" ")
        if sign not in "+-" or not sign or not pattern.strip():
            raise ValueError(f"a filter rule is '+ pattern' or '- pattern', not {rule!r}")
        rules.append((sign == "+", pattern.strip()))
    return rules + [(True, p) for p in includes] + [(False, p) for p in excludes]


class TooManyRulesError(ValueError):
    """A table of rules is longer than allowed."""


def read_rules(table: DataFrame, max_rules: int = 100_000) -> list[tuple[bool, str]]:
    """Rules from a table with their place `n` and their text `rule`; they go to each worker, so their number is bounded."""
    found = table.select("n", "rule").orderBy("n", "rule").limit(max_rules + 1).collect()
    if len(found) > max_rules:
        raise TooManyRulesError(f"more than {max_rules} rules")
    return rules_of(r.rule for r in found)


def _stays(decision: Column, kind: str) -> Column:
    return (F.col(kind) == "dir") | F.coalesce(decision["include"], F.lit(True))


def judged(entries: DataFrame, rules: list[tuple[bool, str]], path: str = "path", kind: str = "kind") -> DataFrame:
    """The entries with the number (from 0) of the first rule that matches, and whether they stay, found in one pass."""
    found = entries.withColumn("decision", decided(path, rules))
    return found.withColumns({"rule": F.col("decision.rule"), "stays": _stays(F.col("decision"), kind)}).drop("decision")


def included(rules: list[tuple[bool, str]], path: str = "path", kind: str = "kind") -> Column:
    """First match wins; unmatched entries and directories stay."""
    if len(rules) > FEW_RULES:
        return _stays(decided(path, rules), kind)
    decision = F.lit(True)
    for include, pattern in reversed(rules):
        decision = F.when(glob_match(path, pattern), F.lit(include)).otherwise(decision)
    return (F.col(kind) == "dir") | decision


def apply_rules(entries: DataFrame, rules: list[tuple[bool, str]]) -> DataFrame:
    return entries.where(included(rules)) if rules else entries


def allowlist(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Entries whose path is listed, and all directories; overrides the rules."""
    listed = paths.select(F.col("path").alias("listed")).distinct()
    joined = entries.join(listed, F.col("path") == F.col("listed"), "left")
    return joined.where(F.col("listed").isNotNull() | (F.col("kind") == "dir")).select(*entries.columns)


def drop_reserved(entries: DataFrame, prefix: str = ".twinlake") -> DataFrame:
    return entries.where(~under("path", prefix))


def split_unsafe(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(safe entries, rejected ones with an error); symlinks are judged by their target too."""
    bad_path = F.coalesce(unsafe("path"), F.lit(True))
    bad_target = (F.col("kind") == "symlink") & F.coalesce(unsafe("target"), F.lit(True))
    error = F.when(bad_path, "unsafe path").when(bad_target, "unsafe symlink target")
    judged = entries.withColumn("error", error)
    return judged.where("error IS NULL").drop("error"), judged.where("error IS NOT NULL")


def live_differs(r: str = "r", d: str = "d") -> Column:
    """Whether a destination entry is no longer as recorded (aliases r and d); the mode is compared by its bits."""
    c = lambda side, name: F.col(f"{side}.{name}")
    same = c(r, "kind").eqNullSafe(c(d, "kind")) & c(r, "dev").eqNullSafe(c(d, "dev")) & c(r, "ino").eqNullSafe(c(d, "ino"))
    same &= (c(r, "kind") != "file") | c(r, "len").eqNullSafe(c(d, "len"))
    same &= c(r, "mtime_s").eqNullSafe(c(d, "mtime_s")) & c(r, "mtime_ns").eqNullSafe(c(d, "mtime_ns"))
    same &= mode_bits(c(r, "mode")).eqNullSafe(mode_bits(c(d, "mode")))
    same &= (c(r, "kind") != "symlink") | c(r, "target").eqNullSafe(c(d, "target"))
    return ~same | c(d, "path").isNull()


def drifted(index: DataFrame, live: DataFrame) -> DataFrame:
    """Index records whose destination is missing or has changed since."""
    return index.alias("r").join(live.alias("d"), F.col("r.path") == F.col("d.path"), "left").where(live_differs()).select("r.*")
