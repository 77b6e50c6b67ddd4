"""Operators over the lines of messages; ``msg_id`` deals out all windows, so one exchange serves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, template, trim, utf16_length


def explode_lines(messages: DataFrame) -> DataFrame:
    """(msg_id, pos, line, n_lines) from (msg_id, content); pos starts at 0."""
    parts = messages.select("msg_id", F.split("content", "\n").alias("parts"))
    return parts.select("msg_id", F.size("parts").alias("n_lines"), F.posexplode("parts").alias("pos", "line"))


def _joined(rows: DataFrame, *order: str) -> DataFrame:
    """msg_id and the rows' ``line`` joined in order."""
    gathered = F.sort_array(F.collect_list(F.struct(*order, "line")))
    return rows.groupBy("msg_id").agg(F.array_join(F.transform(gathered, lambda r: r["line"]), "\n").alias("content"))


def repeated_lines(messages: DataFrame) -> DataFrame:
    """(msg_id, line, times, first_pos): trimmed lines met over 3 times in messages of 10 lines or more."""
    lines = explode_lines(messages).where("n_lines >= 10").withColumn("line", trim(F.col("line"))).where("line <> ''")
    return lines.groupBy("msg_id", "line").agg(F.count("*").alias("times"), F.min("pos").cast("long").alias("first_pos")).where("times > 3")


def dedup_lines(messages: DataFrame) -> DataFrame:
    """(msg_id, content) of messages with repeated lines: the first stays, with a count below it."""
    lines = explode_lines(messages).where("n_lines >= 10").withColumn("key", trim(F.col("line")))
    same = Window.partitionBy("msg_id", "key")
    marked = lines.withColumn("times", F.when(F.col("key") != "", F.count("*").over(same)).otherwise(0)).withColumn("turn", F.row_number().over(same.orderBy("pos")))
    found = marked.withColumn("most", F.max("times").over(Window.partitionBy("msg_id"))).where("most > 3")
    kept = found.where("times <= 3 or turn = 1")
    note = F.format_string("  [↑ repeated %d× total, showing once]", "times")
    line = F.when(F.col("times") > 3, F.concat("line", F.lit("\n"), note)).otherwise(F.col("line"))
    return _joined(kept.withColumn("line", line), "pos")


def template_groups(messages: DataFrame) -> DataFrame:
    """(msg_id, template, times, first_pos) of 5 or more lines alike but for masked parts, in messages of 20 lines or more."""
    lines = explode_lines(messages).where("n_lines >= 20").withColumn("line", trim(F.col("line"))).where(utf16_length(F.col("line")) >= 10)
    masked = lines.withColumn("template", template(F.col("line"))).where("template <> line")
    return masked.groupBy("msg_id", "template").agg(F.count("*").alias("times"), F.min("pos").cast("long").alias("first_pos")).where("times >= 5")


def head_tail(messages: DataFrame, max_tokens: int) -> DataFrame:
    """(msg_id, head_lines, tail_lines, omitted, content): lines from both ends within 60 and 40 % of the tokens."""
    head = int(max_tokens * 0.6 + 0.5)
    lines = explode_lines(messages).withColumn("tok", estimate_tokens(F.col("line")))
    down = Window.partitionBy("msg_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("msg_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = lines.withColumn("down", F.sum("tok").over(down)).withColumn("up", F.sum("tok").over(up))
    sums = sums.withColumn("part", F.when(F.col("down") <= head, 0).when(F.col("up") <= max_tokens - head, 2).otherwise(1))
    ends = sums.groupBy("msg_id").agg(*[F.count_if(F.col("part") == p).alias(n) for p, n in ((0, "head_lines"), (1, "omitted"), (2, "tail_lines"))], F.coalesce(F.sum(F.when(F.col("part") != 1, F.col("tok"))), F.lit(0)).alias("kept"))
    whole = messages.select("msg_id", estimate_tokens(F.col("content")).alias("all"), F.col("content").alias("old"))
    marker = ends.join(whole, "msg_id").withColumn("line", F.format_string("\n[… %d lines omitted (%d tokens) …]\n", "omitted", F.col("all") - F.col("kept")))
    rows = sums.where("part <> 1").select("msg_id", "part", "pos", "line").unionByName(marker.where("omitted > 0").select("msg_id", F.lit(1).alias("part"), F.lit(0).alias("pos"), "line"))
    return _joined(rows, "part", "pos").join(ends, "msg_id").select("msg_id", "head_lines", "tail_lines", "omitted", "content")
