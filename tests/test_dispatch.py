import json

import pytest

from loomdigest.config import Config, configure, patterns
from loomdigest.functions.plain import tokens
from loomdigest.operators import budget, payload_json, payload_text, recall, repeats
from loomdigest.operators.analysis import analyze
from loomdigest.operators.dispatch import compact


def log(n, line="plain words without meaning number"):
    return "\n".join(f"{line} {'abcdefghij'[i % 10]}{i}x" for i in range(n))


RESULTS = json.dumps({"query": "q", "answer": "yes", "results": [{"title": f"t{i}", "url": f"http://x/{i}", "content": "c" * 900} for i in range(60)]})
BIB = "\n".join(f"@article{{k{i},\n  author = {{A{i}}},\n  title = {{T {i}}},\n  year = {{{1990 + i}}},\n  abstract = {{{'w ' * 300}}},\n}}" for i in range(12))
CSV = "\n".join(["id,name,price"] + [f"{i},n{i % 3},{i * 1.5}" for i in range(900)])
RECORDS = "\n\n".join(f"Model {i}\nschema: s\nkind: k{i}\nsize: {i}" for i in range(300))
DIFF = "\n".join(["diff --git a/f b/f", "--- a/f", "+++ b/f"] + [x for h in range(60) for x in [f"@@ -{h} @@", *[f" same {h} {i}" for i in range(20)], f"-old line {h}", f"+new line {h}"]])
CODE = "\n".join([f"import m{i}" for i in range(20)] + [f"def f{i}(a):\n    return a + {i} * 3 - some_long_name" for i in range(120)])
CASES = {
    "smart/search-results": ("tool_output", RESULTS),
    "domain-aware/bibtex": ("tool_output", BIB),
    "domain-aware/csv": ("tool_output", CSV),
    "repetition-elimination/records": ("tool_output", RECORDS),
    "repetition-elimination/lines": ("tool_output", "\n".join(["the very same line of a log"] * 400)),
    "error-extraction": ("tool_output", log(400) + "\nsomething panic here\n" + log(400)),
    "tool-output-truncation/json": ("tool_output", json.dumps([{"a": i, "b": "x" * 30} for i in range(400)])),
    "tool-output-truncation/listing": ("tool_output", "\n".join(f"src/d{i % 7}/file{i}.py" for i in range(400))),
    "tool-output-truncation/head-tail": ("tool_output", log(400)),
    "patch-distill": ("patch", DIFF),
    "file-content-distill/config": ("file_content", json.dumps({f"k{i}": {"a": i, "b": "y" * 50} for i in range(100)})),
    "file-content-distill/code-structure": ("file_content", CODE),
    "file-content-distill/truncate": ("file_content", log(400)),
}


@pytest.mark.parametrize("rule", CASES)
def test_sync_profile_picks_the_rule(rule):
    kind, content = CASES[rule]
    found = compact(content, kind, Config())
    assert found.rule == rule and found.tokens == tokens(found.content) < tokens(content)


def test_rules_profile():
    pick = lambda content, kind, **kw: getattr(compact(content, kind, Config(), "rules", **kw), "rule", None)
    document = "\n".join(f"## Part {i}\n" + "words of a paragraph that runs on\n" * 3 + f"{'tail ' * 60}{i}" for i in range(20))
    block = "\n".join(f"alpha {i}\nbeta longer line\ngamma longest line of all" for i in range(3))
    assert pick(document, "file_content") == "domain-aware/markdown"
    assert pick(log(400), "tool_output", summarize=lambda c, i, n: "short") == "tool-output-truncation/llm"
    assert pick("\n".join(f"job {i} took {i * 37 % 91}.5 seconds on host {i:04d}" for i in range(10, 500)), "tool_output") == "repetition-elimination/templates"
    assert repeats.blocks_once(block) is None and pick("short", "text") is None
    assert pick(log(400), "tool_output", preserve=(__import__("re").compile("plain"),)) is None


def test_a_failing_rule_is_passed_over():
    def fails(*_):
        raise RuntimeError("no model")

    failed = []
    found = compact(log(600), "tool_output", Config(), "rules", fails, failed=failed)
    assert found.rule == "tool-output-truncation/head-tail" and failed == ["tool-output-truncation/llm: no model"]


def test_budget_cuts():
    assert budget.truncate("a" * 400, 10) == "a" * 36 + "…"
    assert budget.truncate("aaaa\nbbbb\ncccc", 2) == "aaaa\nbbbb\n\n[… truncated, 1 more lines]"
    cut = budget.head_tail("x" * 4000 + "\na\nb\n" + "y" * 4000, 100, partial=True)
    assert cut.startswith("x" * 50) and cut.endswith("y" * 30) and "2 lines omitted" in cut


def test_error_classes():
    by = budget.WIDE
    lines = ["all fine", "panic: x", "deprecated call", "Tests: 5 passed", "warning: error inside", "terror"]
    assert [budget.severity(x, by) for x in lines] == [None, "error", "warning", "summary", "error", None]
    text = "\n".join(["start"] * 30 + ["panic: x", "    at f.py", "panic: x"] + [f"end {i}" for i in range(40)])
    told = budget.around_errors(text.replace("end 3\n", "deprecated\n"), 40, by)
    assert "2 error(s), 1 warning(s), 0 summary line(s)" in told and "panic: x\n    at f.py\ndeprecated" in told


def test_json_details():
    assert payload_json.parse('{"b":1,"2":0,"1":0,"b":3}') == {"1": 0, "2": 0, "b": 3} and list(payload_json.parse('{"b":1,"2":0,"1":0}')) == ["1", "2", "b"]
    with pytest.raises(ValueError):
        payload_json.parse("[1,NaN]")
    assert payload_json.render(payload_json.parse('[1.0,"é",1e3]')) == '[1,"é",1000]'
    assert payload_json.compact({"a": {"b": {"c": 1}}, "l": [1, 2, 3]}) == {"a": {"b": "{1 keys}"}, "l": [1, 2, "… (1 more)"]}
    assert analyze('{"a":[1],"b":2,"c":3}').subtype == "api_response" and analyze("").subtype == "generic"
    assert analyze("npm install x\nadded 5 packages").subtype == "install_log"
    assert analyze("usage: x\noptions: y").subtype == "usage_help"
    assert analyze("see http://a http://b http://c").subtype == "data_output"


def test_cells():
    assert [payload_text.number(x) for x in ("", "0x10", "1d", "NaN", "-.5", "Infinity")] == [0, 16, None, None, -0.5, float("inf")]


def test_diff():
    text = "\n".join(["@@", "+a", *map(str, range(7)), "-b", "e"])
    assert payload_text.diff_compressed(text, 1).split("\n") == ["@@", "+a", "0", "  [… 2 unchanged lines …]", "3", "  [… 2 unchanged lines …]", "6", "-b", "e"]
    assert payload_text.diff_stats("--- a\n+++ b\n@@\n+x\n-y\n-z") == (1, 1, 2, 1)


def test_recall():
    text = "# One\n" + "\n".join(f"- decided on point number {i} of the list" for i in range(200)) + "\n# Two\n" + "body of the text " * 900
    found = recall.envelope(text, "user", Config(), "s1")
    assert "## Keypoint Summary\n# One\n- decided" in found and "Session ID: `s1`" in found and "L1-L201: **One** — One" in found
    assert tokens(found) < tokens(text) and recall.envelope("short", "user") is None
    assert recall.samples("\n".join(["aaaaaa 1", "aaaaaa 2", "bbbbbbb", "cccccccc"])) == ["aaaaaa 1", "bbbbbbb", "cccccccc"]
    pods = ["NAME READY STATUS", "a 1/1 Running", "b 1/1 Running", "c 0/1 Error"]
    assert recall.KNOWN["pods"](pods).split("\n")[1] == "Statuses: Running(2), Error(1)"


def test_configuration():
    assert configure(Config(), tool_output_max_tokens=9).tool_output_max_tokens == 100
    with pytest.raises(ValueError):
        configure(Config(), aggressiveness="odd")
    assert patterns("a+, [, b") == ("a+", "b")
