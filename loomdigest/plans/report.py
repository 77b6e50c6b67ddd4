"""Reports: the engine's state as text, and cases with what they must reach."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.messages import ago, lifetime, lifetime_rules, loads, since_reset
from .engine import Engine, totals


def status(engine: Engine, results: DataFrame, facts: DataFrame, runs: DataFrame, now: datetime) -> str:
    """Lifetime figures since the last reset, this session's, rule hits, configuration and rules, as Markdown."""
    lasting = since_reset(facts, runs)
    times = lifetime(lasting).withColumn("ago", ago(F.unix_millis("last_at"), F.unix_millis(F.lit(now)))).first()
    session = totals(results).first()
    hits = lifetime_rules(lasting).orderBy(F.col("hits").desc(), "rule").collect()  # a row for each rule
    c, stamp = engine.config, lambda t: t.isoformat() if t else "never"
    lines = ["## Engine status", "", "### Lifetime"]
    lines += [f"- Compacted messages: {times.distillations}", f"- Tokens saved: {times.saved:,}", f"- Starts: {loads(runs)}", f"- First: {stamp(times.first_at)}", f"- Last: {times.ago}" + (f" ({stamp(times.last_at)})" if times.last_at else "")]
    lines += ["", "### Session", f"- Messages: {session.messages}", f"- Compacted messages: {session.distillations}", f"- Tokens saved: {session.saved:,}"]
    lines += ["", "### Rule hits", *([f"- {r.rule}: {r.hits}" for r in hits] or ["- none yet"])]
    lines += ["", "### Configuration", f"- Enabled: {str(c.enabled).lower()}", f"- Aggressiveness: {c.aggressiveness}", f"- Limits in tokens: tool output {c.tool_output_max_tokens}, patch {c.patch_max_tokens}, file content {c.file_content_max_tokens}, message {c.message_max_tokens}", f"- Preserve patterns: {', '.join(c.preserve_patterns) or 'none'}"]
    own = [f"- [{r.priority}] {r.name}" + (f": {r.description}" if r.description else "") for r in engine.own]
    lines += ["", f"### Rules of the profile {engine.profile}", *dict.fromkeys(f"- {name}" for _, name in engine.rules()), *own]
    return "\n".join(lines)


def _percent(part: Column, whole: Column) -> Column:
    """In whole percent, halves up."""
    return F.floor(part / F.greatest(whole, F.lit(1)) * 100 + 0.5).cast("long")


def judged(results: DataFrame) -> DataFrame:
    """Results with ``result``, ``expected_rule`` and ``expected_text`` (may be null): saved, percent,
    rule_match, text_found and whether the case passes. A compacted case passes if it saves a tenth,
    one left as it is if it had under 150 tokens."""
    r, hit = F.col("result"), F.coalesce(F.col("result.distilled"), F.lit(False))
    saved = F.when(hit, r["tokens_before"] - r["tokens_after"]).otherwise(F.lit(0)).cast("long")
    percent = F.when(hit, _percent(saved, r["tokens_before"])).otherwise(F.lit(0)).cast("long")
    family = F.split_part(F.col("expected_rule"), F.lit("/"), F.lit(1))
    match = hit & ((r["rule"] == F.col("expected_rule")) | F.startswith(r["rule"], family))
    # the expected text may write line ends as backslash and n; its first line's beginning counts
    wanted = F.substring(F.split_part(F.col("expected_text"), F.lit("\\n"), F.lit(1)), 1, 30)
    found = hit & F.coalesce(F.contains(r["content"], wanted), F.lit(True))
    passes = F.when(hit, (saved > 0) & (percent >= 10)).otherwise(r["tokens_before"] < 150)
    return results.select("*", saved.alias("saved"), percent.alias("percent"), F.coalesce(match, F.lit(False)).alias("rule_match"), found.alias("text_found"), passes.alias("passes"))


def summary(cases: DataFrame, *group: str) -> DataFrame:
    """Of judged cases: how many, passed, failed, tokens, saved, saved_percent, mean_percent."""
    before = F.sum("result.tokens_before").cast("long")
    saved = F.sum("saved").cast("long")
    made = [F.count("*").alias("cases"), F.count_if("passes").alias("passed"), F.count_if(~F.col("passes")).alias("failed"), before.alias("tokens"), saved.alias("saved"), _percent(saved, before).alias("saved_percent"), F.floor(F.avg("percent") + 0.5).cast("long").alias("mean_percent")]
    return cases.groupBy(*group).agg(*made)
