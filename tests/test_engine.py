from loomdigest.config import Config, resolve_config
from loomdigest.operators.lines import dedup_lines, head_tail
from loomdigest.plans import queries
from oracle_check import differences


def test_queries_match_sql(spark):
    assert differences(spark, "/root/testdata/sf0.001", queries.SQL.keys()) == {}


def test_config_order():
    c = resolve_config({"LOOMDIGEST_PATCH_MAX_TOKENS": "700"}, {"patch_max_tokens": 5, "aggressiveness": "odd"})
    assert (c.patch_max_tokens, c.aggressiveness) == (700, "moderate")
    assert Config(aggressiveness="aggressive").multiplier == 0.6


def test_dedup_lines_keeps_first(spark):
    df = spark.createDataFrame([(1, "\n".join(["a", *["x"] * 8, "b"])), (2, "short")], "msg_id long, content string")
    assert [tuple(r) for r in dedup_lines(df).collect()] == [(1, "a\nx\n  [↑ repeated 8× total, showing once]\nb")]


def test_head_tail_within_budget(spark):
    df = spark.createDataFrame([(1, "\n".join(["word " * 4] * 50))], "msg_id long, content string")
    r = head_tail(df, 50).first()
    assert (r.head_lines, r.tail_lines, r.omitted) == (6, 4, 40)


def test_engine_over_a_table(spark):
    from test_dispatch import CASES

    from loomdigest.plans import engine

    rows = [(i, kind, rule, text) for i, (rule, (kind, text)) in enumerate(CASES.items())] + [(98, "tool_output", None, None), (99, "text", None, "x" * 40000)]
    done = engine.Engine().apply(spark.createDataFrame(rows, "msg_id long, category string, want string, content string")).persist()
    assert done.where("not (result.rule <=> want)").count() == 0
    assert done.where("msg_id = 98").first().result.content is None
    total = engine.totals(done).first()
    assert (total.messages, total.distillations) == (len(rows), len(CASES)) and total.saved == sum(r.saved for r in engine.rule_hits(done).collect())
    off = engine.Engine(Config(enabled=False)).apply(done.drop("result"))
    assert off.where("result.distilled").count() == 0


def test_columns_agree_with_plain_functions(spark):
    from loomdigest.functions.plain import tokens
    from loomdigest.functions.text import estimate_tokens
    from loomdigest.operators import budget, profiles

    texts = ["", "a", "漢字 text", "🎉🎉", "x\n" * 900, "long " * 3000, "é\u2003\n" + "word " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id long, content string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.orderBy("msg_id").select(estimate_tokens(F.col("content"))).collect()] == list(map(tokens, texts))
    cut = {r.msg_id: r.content for r in profiles.truncate(df, 100).collect()}
    assert cut == {i: budget.truncate(t, 100) for i, t in enumerate(texts) if tokens(t) > 100}
    lines = ["panic: x", "deprecated call", "Tests: 5 passed", "warning: error inside", "terror", "éerror", "", "5 failed"]
    found = spark.createDataFrame([(x,) for x in lines], "x string").select("x", profiles.severity(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in found} == {x: budget.severity(x, budget.WIDE) for x in lines}


def test_blocks_of_messages(spark):
    from pyspark.sql import functions as F

    from loomdigest.plans.engine import flatten, rewrite_blocks

    df = spark.createDataFrame([(1, [("text", "a"), ("image", "i"), ("text", ""), ("text", "b")]), (2, [("image", "i")])], "id long, blocks array<struct<type string, text string>>")
    made = df.orderBy("id").select(flatten(F.col("blocks")).alias("c"), rewrite_blocks(F.col("blocks"), F.lit("new")).alias("b")).collect()
    assert [r.c for r in made] == ["a\nb", ""]
    assert [tuple(x) for x in made[0].b] == [("text", "new"), ("image", "i"), ("text", "new"), ("text", "new")]
    assert [tuple(x) for x in made[1].b] == [("text", "new"), ("image", "i")]


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomdigest.plans.engine import Engine
    from loomdigest.sources.messages import ago, lifetime, lifetime_rules, read_facts, read_messages
    from loomdigest.streaming.compaction import compact_stream, running_ratio_stream

    log = "\n".join(f"line {i} of a log" for i in range(1000))
    spark.createDataFrame([(1, "t", log), (2, "t", "short")], "msg_id long, tool_name string, content string").write.parquet(f"{tmp_path}/in")
    assert read_facts(spark, f"{tmp_path}/facts").count() == 0
    stream = spark.readStream.schema("msg_id long, tool_name string, content string").parquet(f"{tmp_path}/in")
    compact_stream(stream, Engine(), f"{tmp_path}/out", f"{tmp_path}/facts", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    assert read_messages(spark, f"{tmp_path}/out").count() == 2
    found = read_facts(spark, f"{tmp_path}/facts")
    assert lifetime(found).first().distillations == 1 and lifetime_rules(found).first().rule == "tool-output-truncation/head-tail"
    spark.createDataFrame([("a", 0.5, 2), ("a", 0.25, 1)], "k string, ratio double, s long").selectExpr("k", "ratio", "timestamp_seconds(s) as ts").coalesce(1).write.parquet(f"{tmp_path}/r")
    stream = spark.readStream.schema("k string, ratio double, ts timestamp").parquet(f"{tmp_path}/r")
    running_ratio_stream(stream, "k").writeStream.outputMode("update").format("memory").queryName("averages").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert abs(spark.table("averages").first().average - ((0.9 + 0.025) * 0.9 + 0.05)) < 1e-12
    spoken = spark.range(1).select(*[ago(F.lit(n), F.lit(10**9)).alias(str(n)) for n in (0, 10**9 - 2500, 10**9 - 5400_000)]).first()
    assert list(spoken) == ["never", "3s ago", "2h ago"]
