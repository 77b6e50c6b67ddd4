"""Settings at start, own rules, reports, the run log and registered functions."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomdigest.config import Config, load_config, problems, resolve_config
from loomdigest.functions import registered
from loomdigest.functions.plain import tokens
from loomdigest.operators import dispatch
from loomdigest.plans import engine, report
from loomdigest.sources import messages


@pytest.mark.parametrize("value", ["inf", "-inf", "nan", "0", "-5", "", "x", None, True, [3]])
def test_settings_that_are_no_limit_fall_through(value):
    assert resolve_config({"LOOMDIGEST_PATCH_MAX_TOKENS": value}, {"patch_max_tokens": 700}).patch_max_tokens == 700
    assert resolve_config({}, {"patch_max_tokens": value}).patch_max_tokens == Config().patch_max_tokens


def test_settings_at_start_are_checked():
    assert problems({"patch_max_tokens": 700, "preserve_patterns": ["a"], "enabled": False}) == []
    for bad in ({"patch_max_tokens": 99}, {"patch_max_tokens": 3001}, {"message_max_tokens": 400}, {"summary_max_lines": 201}, {"patch_max_tokens": 700.5}, {"enabled": "yes"}, {"odd": 1}, {"aggressiveness": "wild"}, {"preserve_patterns": "a"}, [1], None):
        assert problems(bad)
    with pytest.raises(ValueError, match="from 100 to 3000"):
        load_config({}, {"patch_max_tokens": 5})
    assert load_config({"LOOMDIGEST_PATCH_MAX_TOKENS": "650.4"}, {"enabled": False}) == Config(enabled=False, patch_max_tokens=650)
    assert resolve_config({}, "text") == Config()


def shout():
    return lambda task: "SHORT" if "secret word" in task.content else None


def test_own_rules_by_priority(spark):
    text = "a secret word and more\n" * 40 + "\n".join(f"line {i} of some output {i * 7}" for i in range(400))
    for priority, kind, want in ((1, "tool_output", "own/shout"), (6, "tool_output", "repetition-elimination/lines"), (1, "patch", "repetition-elimination/lines")):
        e = engine.Engine(profile="rules").add_rule(dispatch.Rule("own/shout", priority, (kind,), shout(), "says it short"))
        row = e.apply(spark.createDataFrame([(1, "tool_output", "x\n" * 3000 if want != "own/shout" else text)], "msg_id long, category string, content string")).first()
        assert row.result.rule == want
    assert e.rules().count(("patch", "own/shout")) == 1 and e.rules()[0][0] == "tool_output"
    order = [n for c, n in engine.Engine(profile="rules").add_rule(dispatch.Rule("own/shout", 8, ("tool_output",), shout())).rules() if c == "tool_output"]
    assert order.index("error-extraction") < order.index("own/shout") < order.index("tool-output-truncation/json")


def test_an_empty_summary_is_a_failure_and_passed_over():
    text = "\n".join(f"plain words {'abcdefghij'[i % 10]}{i}x of output" for i in range(900))
    failed = []
    found = dispatch.compact(text, "tool_output", Config(), "rules", lambda c, i, n: "  ", (), failed)
    assert found.rule == "tool-output-truncation/head-tail" and failed == ["tool-output-truncation/llm: the summarizer gave no text"]


def test_run_log_status_and_reset(spark, tmp_path):
    runs, facts_path = str(tmp_path / "runs"), str(tmp_path / "facts")
    assert messages.loads(messages.read_runs(spark, runs)) == 0
    messages.record_run(spark, runs)
    messages.record_run(spark, runs)
    e = engine.Engine().add_rule(dispatch.Rule("own/shout", 3, ("patch",), shout(), "says it short"))
    rows = [(n, "tool_output", "the very same line of a log\n" * 500, datetime(2024, 1, n)) for n in (1, 2)] + [(3, "text", "x", datetime(2024, 1, 3))]
    results = e.apply(spark.createDataFrame(rows, "msg_id long, category string, content string, ts timestamp"))
    messages.facts(results).write.parquet(facts_path)
    now = datetime(2024, 1, 2, 1)
    text = report.status(e, results, messages.read_facts(spark, facts_path), messages.read_runs(spark, runs), now)
    for part in ("- Compacted messages: 2", "- Starts: 2", "- repetition-elimination/lines: 2", "- Last: 1h ago", "- Messages: 3", "- [3] own/shout: says it short", "- Preserve patterns: none"):
        assert part in text
    messages.record_run(spark, runs, "reset")
    text = report.status(e, results, messages.read_facts(spark, facts_path), messages.read_runs(spark, runs), now)
    assert "- Starts: 2" in text and "- none yet" in text and "- Last: never" in text
    with pytest.raises(ValueError):
        messages.record_run(spark, runs, "odd")


def test_cases_and_their_summary(spark):
    made = "distilled boolean, content string, tokens_before long, tokens_after long, rule string"
    rows = [
        (1, "a/b", None, (True, "the text", 1000, 300, "a/c")),
        (2, "b", "the te\\nmore", (True, "the text", 1000, 905, "a")),
        (3, "a", "absent", (True, "the text", 200, 180, "a")),
        (4, "a", None, (False, "x", 149, 149, None)),
        (5, "a", None, (False, "x", 150, 150, None)),
    ]
    cases = report.judged(spark.createDataFrame(rows, f"id long, expected_rule string, expected_text string, result struct<{made.replace(' ', ':').replace(',:', ',')}>"))
    got = {r.id: (r.saved, r.percent, r.rule_match, r.text_found, r.passes) for r in cases.collect()}
    assert got == {1: (700, 70, True, True, True), 2: (95, 10, False, True, True), 3: (20, 10, True, False, True), 4: (0, 0, False, False, True), 5: (0, 0, False, False, False)}
    assert tuple(report.summary(cases).first()) == (5, 4, 1, 2499, 815, 33, 18)


def test_registered_functions(spark):
    assert set(registered.register(spark)) == {"estimate_tokens", "truncate_to_tokens", "text_lines"}
    spark.createDataFrame([("a b\nc",), (None,), ("漢字 and words",)], "t string").createOrReplaceTempView("texts")
    assert [r[0] for r in spark.sql("select estimate_tokens(t) from texts").collect()] == [tokens("a b\nc"), None, tokens("漢字 and words")]
    assert [tuple(r) for r in spark.sql("select l.* from texts, lateral text_lines(t) l where t like 'a%'").collect()] == [(1, "a b"), (2, "c")]
    assert spark.sql("select truncate_to_tokens(repeat('word ', 4000), 100) x").select(F.length("x") < 2000).first()[0]


def test_json_messages_are_parsed_whatever_their_keys(spark):
    text = json.dumps([{"content": i, "part": "x" * 40, "_before": i} for i in range(400)])
    df = spark.createDataFrame([(1, "tool_output", text)], "msg_id long, category string, content string")
    assert engine.Engine().apply(df).first().result.failed is None
