"""The engine over tables of messages: one pass, no exchange; only messages above a limit go to Python."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, configure
from ..functions.text import category, estimate_tokens, threshold
from ..operators import budget, dispatch, recall
from ..operators.analysis import LEAST_MULTIPLIER

COMPACTED = "content string, tokens long, rule string, failed array<string>"
_WRITTEN = pa.struct([("content", pa.string()), ("tokens", pa.int64()), ("rule", pa.string())])
_COMPACTED = pa.struct([*_WRITTEN, ("failed", pa.list_(pa.string()))])


def small_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Messages go to Python in batches of so many rows and bytes at most, however many a partition has."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def flatten(blocks: Column) -> Column:
    """The text blocks of array<struct<type, text>> joined by line ends; empty ones left out."""
    texts = F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != ""))
    return F.array_join(F.transform(texts, lambda b: b["text"]), "\n")


def one_block(content: Column) -> Column:
    """A tool result's blocks after compaction: a single one of text."""
    return F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))


def rewrite_blocks(blocks: Column, content: Column) -> Column:
    """Every text block holds the new content, other blocks stay; a text block is put first if there was none."""
    made = F.transform(blocks, lambda b: F.struct(b["type"].alias("type"), F.when(b["type"] == "text", content).otherwise(b["text"]).alias("text")))
    return F.when(F.exists(blocks, lambda b: b["type"] == "text"), made).otherwise(F.concat(one_block(content), made))


@dataclass(frozen=True)
class Engine:
    """``summarize(content, instruction, max_tokens)`` gives a text; it runs on executors and is off by default."""

    config: Config = field(default_factory=Config)
    profile: str = "sync"
    summarize: Callable[[str, str, int], str] | None = None
    own: tuple[dispatch.Rule, ...] = ()

    def add_rule(self, rule: dispatch.Rule) -> Engine:
        """An engine that also asks this rule, by its priority, in the profile ``rules``."""
        return replace(self, own=(*self.own, rule))

    def configured(self, **changes: object) -> Engine:
        return replace(self, config=configure(self.config, **changes))

    def rules(self) -> list[tuple[str, str]]:
        """(category, rule) in the order tried."""
        own = self.own if self.profile == "rules" else ()
        return [(c, s.name) for c, found in dispatch.STRATEGIES[self.profile].items() for s in dispatch.with_rules(found, own, c)]

    def _least(self, kind: Column) -> Column:
        """Tokens up to which no rule of the profile looks at a category."""
        floor = threshold(kind, self.config)
        lower = F.when(kind == "tool_output", F.floor(floor * LEAST_MULTIPLIER)).otherwise(floor) if self.profile == "sync" else floor
        allowed = list(dispatch.STRATEGIES[self.profile])
        return F.when(kind.isin(allowed) & (kind != "text"), lower)

    def apply(self, messages: DataFrame) -> DataFrame:
        """The messages with ``category`` and ``result``: distilled, content, tokens_before,
        tokens_after, rule, ratio, failed (rules that raised and were passed over). Needs ``content``;
        ``tool_name`` and ``category`` are used where given. Null content stays null, with 0 tokens."""
        config, profile, summarize, own = self.config, self.profile, self.summarize, self.own
        preserve = tuple(map(re.compile, config.preserve_patterns))

        @F.arrow_udf(COMPACTED)
        def compacted(contents: pa.Array, kinds: pa.Array) -> pa.Array:
            rows = []
            # a text at a time: a batch is not held as strings as well
            for content, kind in zip(contents, kinds):
                failed: list[str] = []
                found = dispatch.compact(content.as_py(), kind.as_py(), config, profile, summarize, preserve, failed, own) if content.is_valid else None
                rows.append((*(found or (None, None, None)), failed or None))
            return pa.array(rows, _COMPACTED)

        small_batches(messages.sparkSession)
        kind = F.col("category") if "category" in messages.columns else category(F.col("content"), F.col("tool_name") if "tool_name" in messages.columns else None)
        measured = messages.withColumn("category", kind).withColumn("_before", estimate_tokens(F.col("content")))
        asked = F.when(F.lit(config.enabled) & (F.col("_before") > self._least(F.col("category"))), F.col("content"))
        # not deterministic: a filter on the result would have every message compacted twice
        made = measured.withColumn("_made", compacted.asNondeterministic()(asked, F.col("category")))
        hit = F.col("_made.rule").isNotNull()
        after = F.when(hit, F.col("_made.tokens")).otherwise(F.col("_before"))
        result = F.struct(
            hit.alias("distilled"),
            F.when(hit, F.col("_made.content")).otherwise(F.col("content")).alias("content"),
            F.col("_before").alias("tokens_before"),
            after.alias("tokens_after"),
            F.col("_made.rule").alias("rule"),
            F.when(hit, after / F.col("_before")).alias("ratio"),
            F.col("_made.failed").alias("failed"),
        )
        return made.withColumn("result", result).drop("_made", "_before")

    def write_messages(self, messages: DataFrame) -> DataFrame:
        """The messages with ``result`` as they are before writing: outputs of tools above the limit
        (not scaled) cut from both ends if that gains 5 %, others above the message limit as
        envelopes. Needs ``role`` and ``content``; ``session_id`` and ``ts`` go into envelopes where given."""
        config = self.config

        @F.arrow_udf("content string, tokens long, rule string")
        def written(contents: pa.Array, roles: pa.Array, sessions: pa.Array, times: pa.Array) -> pa.Array:
            rows = []
            for row in zip(contents, roles, sessions, times):
                content, role, session, ts = (x.as_py() for x in row)
                found, rule = None, None
                if content is not None and role in ("tool", "toolResult"):
                    found, rule = budget.head_tail(content, config.tool_output_max_tokens, partial=True), "tool-output-truncation/head-tail"
                    found = found if dispatch.tokens(found) < dispatch.tokens(content) * 0.95 else None
                elif content is not None:
                    found, rule = recall.envelope(content, role, config, session, ts), "layered-recall/message"
                    found = found if found is not None and dispatch.tokens(found) < dispatch.tokens(content) else None
                rows.append((found, dispatch.tokens(found), rule) if found is not None else (None, None, None))
            return pa.array(rows, _WRITTEN)

        small_batches(messages.sparkSession)
        tool = F.col("role").isin("tool", "toolResult")
        given = lambda name: F.col(name).cast("string") if name in messages.columns else F.lit(None).cast("string")
        most = F.when(tool, config.tool_output_max_tokens).when(F.col("role").isin("user", "assistant"), config.message_max_tokens)
        measured = messages.withColumn("_before", estimate_tokens(F.col("content")))
        asked = F.when(F.lit(config.enabled) & (F.col("_before") > most), F.col("content"))
        made = measured.withColumn("_made", written.asNondeterministic()(asked, F.col("role"), given("session_id"), given("ts")))
        hit = F.col("_made.rule").isNotNull()
        after = F.when(hit, F.col("_made.tokens")).otherwise(F.col("_before"))
        result = F.struct(hit.alias("distilled"), F.coalesce("_made.content", "content").alias("content"), F.col("_before").alias("tokens_before"), after.alias("tokens_after"), F.col("_made.rule").alias("rule"), F.when(hit, after / F.col("_before")).alias("ratio"))
        return made.withColumn("result", result).drop("_made", "_before")


def rule_hits(results: DataFrame) -> DataFrame:
    """(rule, hits, tokens_before, tokens_after, saved) of compacted messages."""
    r = results.where("result.distilled").select("result.rule", "result.tokens_before", "result.tokens_after")
    return r.groupBy("rule").agg(F.count("*").alias("hits"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"), F.sum(F.col("tokens_before") - F.col("tokens_after")).alias("saved"))


def totals(results: DataFrame) -> DataFrame:
    """One row: messages, distillations, tokens saved, tokens saved in percent."""
    r = results.select("result.*")
    saved = F.coalesce(F.sum(F.when(F.col("distilled"), F.col("tokens_before") - F.col("tokens_after"))), F.lit(0))
    return r.agg(F.count("*").alias("messages"), F.count_if("distilled").alias("distillations"), saved.alias("saved"), F.round(saved * 100.0 / F.sum("tokens_before"), 1).alias("saved_percent"))


#: Ratios further back weigh less than 0.9 ** 400, about 5e-19: below what a double near 1 holds.
HORIZON = 400


def running_ratio(ratios: DataFrame, group: list[str], *order: str) -> DataFrame:
    """(group, average) of ``ratio``: from 1.0, each ratio in order counts a tenth and what was before it
    nine tenths. In closed form over ranks from the last one; the limit on ranks lets each partition
    keep its last rows alone before the exchange, so a group of any size stays small."""
    w = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    last = ratios.where("ratio is not null").withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= HORIZON)
    share = F.pow(F.lit(0.9), F.col("_rank") - 1)
    return last.groupBy(*group).agg((F.sum(F.col("ratio") * 0.1 * share) + F.pow(F.lit(0.9), F.count("*"))).alias("average"))
