import re

import pytest

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinlake.functions.globs import anchored
from twinlake.functions.rulesets import RuleAutomaton, first_rule
from twinlake import queries as core
from twinlake.operators.filters import TooManyRulesError, included, judged, read_rules, rules_of


def hit(pattern, path):
    return re.search(anchored(pattern), path) is not None


@pytest.mark.parametrize(
    ("pattern", "path", "expected"),
    [
        ("*.txt", "a.txt", True), ("*.txt", "d/e/a.txt", True), ("*.txt", "a.txt.bak", False), ("target", "target", True), ("target", "x/target/y", True), ("target", "targets", False),
        ("src/*.rs", "src/a/b.rs", True), ("src/**/*.rs", "src/b.rs", True), ("src/**/*.rs", "x/src/b.rs", False), ("a/**", "a/b/c", True), ("a/**", "a", False), ("**/x", "x", True),
        ("?.c", "a.c", True), ("[a-c].c", "b.c", True), ("[!a-c].c", "b.c", False), ("{foo,bar}.c", "d/bar.c", True), ("{foo,bar}.c", "baz.c", False), (r"\*.c", "*.c", True), (r"\*.c", "a.c", False),
    ],
)
def test_glob(pattern, path, expected):
    assert hit(pattern, path) is expected


def test_rules_keep_their_precedence():
    assert rules_of(["- *.o", "+ keep"], ["a"], ["b"]) == [(False, "*.o"), (True, "keep"), (True, "a"), (False, "b")]
    for bad in ("*.o", "~ x", "+", ""):
        with pytest.raises(ValueError):
            rules_of([bad])


def test_a_line_end_belongs_to_the_name():
    assert not hit("*.txt", "a.txt\n") and hit("*.txt*", "a.txt\n") and hit("a**", "a\nb")
    assert RuleAutomaton(("*.txt", "*.txt?")).first("a.txt\n") == 1


part = st.sampled_from(["a", "b", "/", "/", "*", "?", "**/", "/**", "[ab]", "[!a]", "{a,b/}", "{,a*}", "{a,{b,a}}", r"\\*", "é", "."])
globs = st.lists(st.lists(part, min_size=1, max_size=5).map("".join), max_size=8)


@settings(max_examples=300, deadline=None)
@given(globs, st.lists(st.text("ab/*é.\n", max_size=8), max_size=8), st.sampled_from([1, 5, 2_000_000]))
@example(["**/a", "a/**", "**"], ["a", "a/b", "b/a", "", "b/a/b"], 1)
def test_the_automaton_finds_the_first_expression_that_matches(patterns, paths, limit):
    rules = RuleAutomaton(tuple(patterns), limit)
    for path in paths:
        assert rules.first(path) == next((k for k, p in enumerate(patterns) if hit(p, path)), None)


def test_what_is_no_pattern_is_said_at_once():
    for bad in ("[a", "{a", "[b-a]"):
        with pytest.raises(ValueError):
            RuleAutomaton((bad,))


def test_states_are_bounded():
    rules = RuleAutomaton(tuple(f"*{k}*{k + 1}" for k in range(200)), limit=5_000)
    for k in range(300):
        rules.first(f"{k}x{k + 1}x{k + 2}" * 3)
        assert rules.held <= 2 * 5_000 + len(rules.loops)


def test_thousands_of_rules_decide_as_expressions_do(spark):
    rules = [(k % 3 > 0, f"{k}/*.o" if k % 2 else f"**/x{k}/**") for k in range(5000)]
    rows = [(f"p/{k}/a.o" if k % 2 else f"p/x{k}/a.o", "file") for k in range(0, 5000, 7)] + [(None, "file"), ("", "file"), ("p/0/a.o", "dir"), ("p/x3/q", "file")]
    entries = spark.createDataFrame(rows, "path string, kind string")
    found = entries.select("path", first_rule("path", [p for _, p in rules]).alias("rule"), included(rules).alias("stays")).collect()
    for (path, kind), row in zip(rows, found):
        rule = int(path.split("/")[1].lstrip("x")) if path and path != "p/x3/q" and path != "p/0/a.o" else None
        assert (row.path, row.rule, row.stays) == (path, rule, kind == "dir" or rule is None or rules[rule][0])


def test_rules_from_a_table_keep_its_order(spark):
    table = spark.range(5).select((-F.col("id")).alias("n"), F.concat(F.lit("- "), F.col("id").cast("string")).alias("rule"))
    assert read_rules(table) == [(False, str(k)) for k in (4, 3, 2, 1, 0)]
    with pytest.raises(TooManyRulesError):
        read_rules(table, 4)
    assert read_rules(table.limit(0)) == []


def test_one_process_of_a_task_judges_a_path(spark):
    plan = core.QUERIES["flt2_many_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    rules = [(k % 2 == 0, f"p{k}") for k in range(40)]
    entries = spark.createDataFrame([("p3", "file"), ("p4", "file"), ("p5", "dir"), ("x", "file"), (None, "file")], "path string, kind string")
    found = {(r.path, r.rule, r.stays) for r in judged(entries, rules).collect()}
    assert found == {("p3", 3, False), ("p4", 4, True), ("p5", 5, True), ("x", None, True), (None, None, True)}
