"""The operators over columns, which SQL checks, against those for one message, which the engine runs."""

import random

from pyspark.sql import functions as F

from loomdigest.functions.plain import tokens, trim
from loomdigest.operators import budget, lines, profiles, repeats
from test_scenarios import SCENARIOS, R


def texts():
    found = []
    for name, (make, _, _) in SCENARIOS.items():
        R.seed(name)
        found.append(make())
    r = random.Random(5)
    parts = ["error: no such file", "warning: slow", "deprecated, error inside", "Tests: 5 passed, 1 failed", "plain", "  plain  ", "", "漢字 log", "🎉 done", "panic", "id 12ab34cd56ef 2024-01-01T10:00:00Z", "x" * 90, " ", "tab\tline"]
    found += ["\n".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(120)]
    return found


def test_columns_and_messages_agree(spark):
    every = texts()
    df = spark.createDataFrame(list(enumerate(every)), "msg_id long, content string").persist()
    want = {i: repeats.lines_once(t) for i, t in enumerate(every)}
    assert {r.msg_id: r.content for r in lines.dedup_lines(df).collect()} == {i: t for i, t in want.items() if t is not None}
    for limit in (60, 1200):
        cut = {r.msg_id: r.content for r in profiles.truncate(df, limit).collect()}
        assert cut == {i: budget.truncate(t, limit) for i, t in enumerate(every) if tokens(t) > limit}
        ends = {r.msg_id: (r.content, r.omitted) for r in lines.head_tail(df, limit).collect()}
        for i, t in enumerate(every):
            if ends.get(i, ("", 0))[1]:
                assert ends[i][0] == budget.head_tail(t, limit), i
            elif tokens(t) > limit and i in ends:
                assert budget.head_tail(t, limit) == t, i
    counts = {}
    for i, t in enumerate(every):
        found = [budget.severity(trim(x), budget.WIDE) for x in t.split("\n")]
        if any(found):
            counts[i] = tuple(found.count(k) for k in ("error", "warning", "summary"))
    parts = lines.explode_lines(df).withColumn("s", profiles.severity(F.trim(F.col("line"), F.lit("  \t"))))
    sums = parts.where("s is not null").groupBy("msg_id").agg(*[F.count_if(F.col("s") == k).cast("int").alias(k) for k in ("error", "warning", "summary")])
    assert {r.msg_id: tuple(r)[1:] for r in sums.collect()} == counts
    df.unpersist()
