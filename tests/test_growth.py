"""Steps that must not grow faster than their input: what is worked out once, and what stays in a row."""

import math
import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from loomdigest.functions.plain import WIDE, tokens, trim, units
from loomdigest.functions.text import estimate_tokens
from loomdigest.functions.text import trim as trim_column
from loomdigest.operators import analysis, payload_text, profiles, repeats
from loomdigest.plans import engine


def test_kinds_of_texts_as_for_one_message(spark):
    r = random.Random(3)
    parts = ["npm install", "pip  add", "downloading the package", "already satisfied", "successfully\tinstalled", "collecting x from", "added 3 packages", "NPM WARN", "usage: x", "  --flag", "options:", "Commands :", "--help show this help",
             "error", "terror", "stack trace", "failed", "assertion x failed", "expected 1 but got 2", "out of memory", "core dump", "exit code", "exited with 1", "crashloopbackoff", "ImagePullBackOff", "OOMKilled", "type error", "http://a.b/c", "plain words", " ", "\n", "\n", "  "]
    texts = [r.choice(("", "　 ")) + "".join(r.choice(parts) + r.choice((" ", "\n", "x")) for _ in range(r.randint(1, 9))) for _ in range(400)]
    # what ends at the limit of 2,000 characters, with and without text behind blanks
    texts += ["x" * 1980 + "\nexit code" + " " * n + after for n in (0, 11, 12, 400) for after in ("", "y", "🎉", " ﻿")] + ["", " \n", "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, content string").select("i", profiles.kind_of_text(F.col("content")).alias("kind"), trim_column(F.col("content")).alias("trimmed"))
    rows = df.orderBy("i").collect()
    assert [row.kind for row in rows] == [analysis.analyze(t).subtype for t in texts]
    assert [row.trimmed for row in rows] == list(map(trim, texts))


def test_the_start_of_a_text_is_worked_out_once(spark):
    df = spark.createDataFrame([("x",)], "content string").select(profiles.kind_of_text(F.col("content")).alias("kind"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_blocks_are_counted_within_the_row(spark):
    r = random.Random(4)
    parts = ["the same line of a block", "another line of a block", "short", "", " ", "  indented line of some length", "🎉" * 6, "漢字の行です 漢字の行です"]
    texts = ["\n".join(r.choice(parts[: r.randint(1, 8)]) for _ in range(r.randint(15, 60))) for _ in range(150)] + [None, "", "\n".join(f"line number {i} of a text" for i in range(50))]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id long, content string")
    for size in (2, 3):
        want = {}
        for i, t in enumerate(texts):
            lines = (t or "").split("\n")
            blocks = [trim("\n".join(lines[k : k + size])) for k in range(len(lines) - size + 1)] if len(lines) >= 20 else []
            times = Counter(b for b in blocks if units(b) >= 20)
            if times and max(times.values()) >= 3:
                top = max(times, key=times.__getitem__)  # the first seen of those met as often
                want[i] = (top, times[top], blocks.index(top))
        found = profiles.common_blocks(df, size)
        assert {x.msg_id: tuple(x)[1:] for x in found.collect()} == want and len(want) > 50
        assert "block" not in "".join(line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line or "HashAggregate(keys=[msg_id#" in line and "block#" in line.split("functions")[0])


def test_cells_of_tables_stay_in_the_row(spark):
    r = random.Random(6)
    cells = ["1", "-2.5", ".5", "1e3", "7", "7", "x", '"q"', " 3 ", "", " ", "a b"]
    texts = []
    for n in range(40):
        d, width = r.choice("\t,|;"), r.randint(3, 12)
        numeric = r.random() < 0.5
        rows = [[r.choice(cells[:6] if numeric else cells) for _ in range(width)] for _ in range(r.randint(3, 30))]
        rows = [row if i < 4 or r.random() < 0.8 else row[: r.randint(1, width)] for i, row in enumerate(rows)]
        texts.append("\n".join(d.join(x) for x in [[f'"name{i}"' for i in range(width)], *rows]))
    found = profiles.csv_profile(spark.createDataFrame(list(enumerate(texts)), "msg_id long, content string"))
    want = {}
    for n, t in enumerate(texts):
        d, lines = payload_text.delimiter(t, True), [x for x in t.split("\n") if trim(x)]
        if d is None or len(lines) < 5:
            continue
        clean = lambda c: re.sub(r'^"|"\Z', "", trim(c))
        names = lines[0].split(d)
        for i, name in enumerate(names[:10]):
            values = [v for x in lines[1:] if i < len(x.split(d)) and (v := clean(x.split(d)[i])) != ""]
            numbers = [x for x in map(payload_text.number, values) if x is not None]
            if values:
                shown = (min(numbers), max(numbers), round(sum(numbers) / len(numbers), 9)) if len(numbers) > len(values) * 0.8 else (None,) * 3
                want[n, i] = (clean(name), len(values), len(numbers), *shown, len(set(values)))
    rows = {(x.msg_id, x.col): (x.name, x.filled, x.numeric, x.low, x.high, None if x["mean"] is None else round(x["mean"], 9), x.distinct) for x in found.collect()}
    assert rows == want and len(want) > 100
    # rows that repeat an id count as one table
    twice = spark.createDataFrame([(1, texts[0]), (1, texts[0])], "msg_id long, content string")
    assert {x.col: (x.filled, x.distinct) for x in profiles.csv_profile(twice).collect()} == {i: (2 * w[1], w[6]) for (n, i), w in want.items() if n == 0}
    assert "posexplode" not in found._jdf.queryExecution().executedPlan().toString()


def test_each_distinct_cell_is_read_once(monkeypatch):
    read = []
    real = payload_text.number
    monkeypatch.setattr(payload_text, "number", lambda x: read.append(x) or real(x))
    content = "a,b,c\n" + "\n".join(f"{i},{i % 3},x" for i in range(50))
    assert payload_text.table_summary(content, ",", False).split("\n")[2:5] == ["  a: numeric [0, 49]", "  b: numeric [0, 2]", "  c: 1 unique values"]
    assert len(read) == 50 + 3 + 1


def test_tokens_of_all_ranges(spark):
    texts = ["", "abc", "é" * 9, "ÿ" * 4 + "a", "Ā" * 5, "漢字 a", "🎉é", "…" * 7, "x" * 4001, "\u2e7f\u2e80"]
    want = [math.ceil(len(WIDE.findall(t)) / 1.5 + (len(t.encode("utf-16-le")) // 2 - len(WIDE.findall(t))) / 4) for t in texts]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "i long, x string").select("i", estimate_tokens(F.col("x")).alias("n"))
    assert list(map(tokens, texts)) == want and [row.n for row in df.orderBy("i").collect()] == [*want, 0]


def test_records_of_a_huge_message_are_not_held():
    content = "\n\n".join(f"Customer {i}\nname: n{i % 100}\nrank = {i % 4}" for i in range(40000))
    tracemalloc.start()
    text = repeats.records_sampled(content, False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * len(content) and "[↑ 40000 records with similar structure, showing 3 samples]\n  name: 100 unique values\n  rank: 0, 1, 2, 3\n" in text
    assert text.startswith("Customer 0\nname: n0\nrank = 0\n") and text.endswith("Customer 39999\nname: n99\nrank = 3")


def test_messages_come_in_batches_bounded_by_bytes(spark):
    engine.Engine().apply(spark.createDataFrame([(1, "x", "tool_output")], "msg_id long, content string, category string"))

    @F.arrow_udf("long")
    def batch(contents: pa.Array) -> pa.Array:
        return pa.array([len(contents)] * len(contents), pa.int64())

    many = spark.range(0, 2000, 1, 1).select(batch(F.repeat(F.lit("0123456789"), F.lit(10000))).alias("n"))
    assert many.agg(F.max("n")).first()[0] <= 200


def test_a_message_is_compacted_once(spark):
    df = spark.createDataFrame([(1, "x", "tool_output")], "msg_id long, content string, category string")
    plan = engine.rule_hits(engine.Engine().apply(df))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
