"""Figures of messages as tables: severities, tables' columns, diffs, listings, records, blocks, kinds.

Lines are exploded where the scan put them and aggregated before any exchange, so only counts and
distinct values travel (of tables, whole columns); running sums and runs of lines stay within a row
as array folds.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import apart, either, estimate_tokens, for_spark, once, trim, trimmed_start, utf16_length
from .lines import explode_lines


def truncate(messages: DataFrame, max_tokens: int) -> DataFrame:
    """(msg_id, kept, content) of messages above the budget: leading whole lines within it, or the
    share of a first line that is above it. Rows stay where they are."""
    split = messages.where(estimate_tokens(F.col("content")) > max_tokens).select("msg_id", F.split("content", "\n").alias("l"))
    costs = split.withColumn("t", F.transform("l", estimate_tokens))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(True).alias("open"))

    def step(at: Column, t: Column) -> Column:
        fits = at["open"] & (at["sum"] + t <= max_tokens)
        return F.struct((at["n"] + fits.cast("int")).alias("n"), (at["sum"] + F.when(fits, t).otherwise(F.lit(0).cast("long"))).alias("sum"), fits.alias("open"))

    counted = costs.select("msg_id", "l", F.element_at("t", 1).alias("first"), F.aggregate("t", start, step, lambda at: at["n"]).alias("n"))
    line = F.element_at("l", 1)
    part = F.concat(F.substring(line, F.lit(1), F.floor(utf16_length(line) * (F.lit(float(max_tokens)) / F.col("first")) * 0.9).cast("int")), F.lit("…"))
    kept = F.greatest("n", F.lit(1))
    rest = F.size("l") - kept
    body = F.when(F.col("n") == 0, part).otherwise(F.array_join(F.slice("l", F.lit(1), F.col("n")), "\n"))
    note = F.when(rest > 0, F.format_string("\n\n[… truncated, %d more lines]", rest)).otherwise("")
    return counted.select("msg_id", kept.alias("kept"), F.concat(body, note).alias("content"))


def severity(line: Column) -> Column:
    """summary, warning, error or null, for a trimmed line."""
    warning = line.rlike(either((P.WARNING,), True)) & ~line.rlike(either((P.GRAVE,), True))
    return F.when(line == "", None).when(line.rlike(either(P.SUMMARY_WIDE, False)), "summary").when(line.rlike(either(P.ERRORS_WIDE, True)), F.when(warning, "warning").otherwise("error"))


def severity_counts(messages: DataFrame) -> DataFrame:
    """(msg_id, errors, warnings, summaries) of messages with any."""
    classes = explode_lines(messages).select("msg_id", severity(trim(F.col("line"))).alias("c")).where("c is not null")
    return classes.groupBy("msg_id").agg(*[F.count_if(F.col("c") == c).alias(n) for c, n in (("error", "errors"), ("warning", "warnings"), ("summary", "summaries"))])


def delimiter(content: Column) -> Column:
    """What cuts the first five lines into equally many columns, three or more, named like columns."""

    def by_lines(lines: Column) -> Column:
        first = F.element_at(lines, 1)
        found = F.when(trim(first).rlike(r"^(\[|\{|#|//|<!--)"), None)
        for d in "\t,|;":
            width = F.size(F.split(first, f"[{d}]"))
            even = F.forall(lines, lambda x: F.size(F.split(x, f"[{d}]")) == width)  # noqa: B023
            named = F.forall(F.split(first, f"[{d}]"), lambda n: (utf16_length(trim(n)) < 80) & ~n.rlike(r"[({]"))
            found = found.when((width > 2) & even & named, d)
        return found

    return once(F.split(F.substring_index(content, "\n", 5), "\n"), by_lines)


def csv_profile(messages: DataFrame, columns: int = 10) -> DataFrame:
    """(msg_id, col, name, filled, numeric, low, high, mean, distinct) of the first columns of tables
    of five filled lines or more; figures of numbers only where over 80 % of the filled cells are.
    Cells stay within the row, as an array a column."""
    clean = lambda c: once(trim(c), lambda t: F.when(t.contains('"'), F.regexp_replace(t, r'^"|"\z', "")).otherwise(t))
    # a backslash and a sign: cut by that sign, without a pattern
    split = lambda x, d: F.split(x, F.concat(F.lit("\\"), d))
    filled = F.filter(F.split("content", "\n"), lambda x: trim(x) != "")

    def by_column(names: Column, rows: Column) -> Column:
        values = lambda i: F.filter(F.transform(rows, lambda r: clean(F.get(r, i))), lambda v: v != "")
        return F.transform(F.sequence(F.lit(0), F.least(F.size(names), F.lit(columns)) - 1), lambda i: F.struct(i.alias("col"), clean(F.get(names, i)).alias("name"), values(i).alias("values")))

    def cells(lines: Column, d: Column) -> Column:
        rows = F.transform(F.slice(lines, F.lit(2), F.size(lines) - 1), lambda r: F.slice(split(r, d), 1, columns))
        return once(split(F.element_at(lines, 1), d), lambda names: once(rows, lambda r: by_column(names, r)))

    table = once(delimiter(F.col("content")), lambda d: F.when(d.isNotNull(), once(filled, lambda l: F.when(F.size(l) >= 5, cells(l, d)))))
    found = messages.select("msg_id", F.explode_outer(table).alias("c")).select("msg_id", "c.*").where(F.size("values") > 0)
    # rows that repeat an id and a name are one column
    found = found.groupBy("msg_id", "col", "name").agg(F.flatten(F.collect_list("values")).alias("v"))

    def number(cell: Column) -> Column:
        return once(trim(cell), lambda t: F.when(t == "", F.lit(0.0)).when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)\z"), t.try_cast("double")))

    def figures(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda at, n: at + n)
        return F.struct(F.size(x).cast("long").alias("numeric"), F.array_min(x).alias("low"), F.array_max(x).alias("high"), total.alias("sum"))

    numbers = once(F.filter(F.transform("v", number), lambda x: x.isNotNull()), figures)
    found = found.select("msg_id", "col", "name", F.size("v").cast("long").alias("filled"), F.size(F.array_distinct("v")).cast("long").alias("distinct"), apart(numbers).alias("x")).select("*", "x.*")
    numeric = F.col("numeric") > F.col("filled") * 0.8
    return found.select("msg_id", "col", "name", "filled", "numeric", *[F.when(numeric, F.col(c)).alias(c) for c in ("low", "high")], F.when(numeric, F.col("sum") / F.col("numeric")).alias("mean"), "distinct")


def diff_stats(messages: DataFrame) -> DataFrame:
    """(msg_id, files, added, deleted, hunks)."""
    x = F.col("line")
    file = x.startswith("+++ ") | x.startswith("--- ")
    count = lambda sign: F.count_if(x.startswith(sign) & ~x.startswith(sign * 3))
    counts = explode_lines(messages).groupBy("msg_id").agg(F.greatest(F.lit(1), F.ceil(F.count_if(file) / 2.0)).cast("long").alias("files"), count("+").alias("added"), count("-").alias("deleted"), F.count_if(x.startswith("@@")).alias("hunks"))
    return counts


def listing_extensions(messages: DataFrame, most: int = 8) -> DataFrame:
    """(msg_id, ext, times, place): the commonest extensions, ties by first sight, of listings."""
    listed = for_spark(P.LISTING_LINE)
    filled = F.filter(F.split("content", "\n"), lambda x: trim(x) != "")
    alike = F.size(F.filter("l", lambda x: x.contains("/") | x.contains("\\") | x.rlike(listed)))
    lists = messages.select("msg_id", filled.alias("l")).where(F.size("l") >= 20).where(alike >= F.size("l") * 0.6)
    paths = lists.select("msg_id", F.posexplode("l").alias("pos", "line")).where(F.col("line").contains("/"))
    ends = paths.select("msg_id", "pos", F.regexp_extract(trim(F.col("line")), r"\.([A-Za-z0-9_]+)\z", 1).alias("ext")).where("ext <> ''")
    counts = ends.groupBy("msg_id", "ext").agg(F.count("*").alias("times"), F.min("pos").alias("pos"))
    w = Window.partitionBy("msg_id").orderBy(F.col("times").desc(), "pos")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("pos")


def record_fields(messages: DataFrame) -> DataFrame:
    """(msg_id, label, records, distinct) of labels met five times or more, in messages of 30 lines or
    more with two such labels and five records; records are apart by blank lines, the last value counts."""
    field = for_spark(P.FIELD_LINE)
    long = messages.where(F.size(F.split("content", "\n")) >= 30)
    lines = explode_lines(long).withColumn("blank", (trim(F.col("line")) == "").cast("int"))
    label = F.when(F.col("line").rlike(field), F.lower(trim(F.regexp_extract("line", field, 2))))
    marked = lines.select("msg_id", "pos", F.sum("blank").over(Window.partitionBy("msg_id").orderBy("pos")).alias("island"), label.alias("label"), trim(F.regexp_extract("line", field, 3)).alias("value")).where("label is not null")
    known = marked.withColumn("times", F.count("*").over(Window.partitionBy("msg_id", "label"))).where("times >= 5")
    last = known.groupBy("msg_id", "island", "label").agg(F.max_by("value", "pos").alias("value"))
    # of each record, its smallest label stands for it, so records are counted without a second pass over lines
    stands = F.min("label").over(Window.partitionBy("msg_id", "island")) == F.col("label")
    values = last.withColumn("stands", stands.cast("int")).groupBy("msg_id", "label", "value").agg(F.count("*").alias("n"), F.sum("stands").alias("stands"))
    found = values.groupBy("msg_id", "label").agg(F.sum("n").alias("records"), F.count("*").alias("distinct"), F.sum("stands").alias("stands"))
    whole = Window.partitionBy("msg_id")
    sized = found.withColumn("all", F.sum("stands").over(whole)).withColumn("labels", F.count("*").over(whole))
    return sized.where("all >= 5 and labels >= 2").select("msg_id", "label", "records", "distinct")


def common_blocks(messages: DataFrame, size: int = 3) -> DataFrame:
    """(msg_id, block, times, first_pos): of messages of 20 lines or more, the commonest run of lines
    of 20 characters or more, if met three times; ties by first sight. Runs are made, sorted and counted
    within the row, so only each message's commonest run is grouped; of rows that repeat an id, the best run of one."""
    top = once(F.split("content", "\n"), lambda l: F.when(F.size(l) >= 20, _commonest(l, size)))
    best = messages.select("msg_id", apart(top).alias("t")).where("t.times >= 3").groupBy("msg_id").agg(F.max_by("t", F.struct("t.times", -F.col("t.first_pos"))).alias("t"))
    return best.select("msg_id", "t.block", F.col("t.times").cast("long").alias("times"), "t.first_pos")


def _commonest(lines: Column, size: int) -> Column:
    """block, times and first_pos of the commonest run, null or of fewer times where none is met three times."""
    block = lambda i: trim(F.concat_ws("\n", *[F.get(lines, i + k) for k in range(size)]))
    runs = F.transform(F.sequence(F.lit(0), F.size(lines) - size), lambda i: F.struct(block(i).alias("block"), i.alias("pos")))
    found = F.filter(runs, lambda r: (F.length(r["block"]) >= 20) | (utf16_length(r["block"]) >= 20))
    counted = lambda block, times, first: F.struct(block.alias("block"), times.alias("times"), first.alias("first_pos"))
    none = counted(F.lit(""), F.lit(0), F.lit(0))

    def step(at: Column, r: Column) -> Column:
        run, top = at["run"], at["top"]
        again = counted(run["block"], run["times"] + 1, run["first_pos"])
        commoner = (run["times"] >= top["times"]) | ((run["times"] + 1 == top["times"]) & (run["first_pos"] < top["first_pos"]))
        more = F.struct(again.alias("run"), F.when(commoner, again).otherwise(top).alias("top"))
        return F.when(run["block"] == r["block"], more).otherwise(F.struct(counted(r["block"], F.lit(1), r["pos"]).alias("run"), top.alias("top")))

    # a run met three times leaves two that were met before, so most messages need no sort
    repeated = lambda r: F.size(r) - F.size(F.array_distinct(F.transform(r, lambda x: x["block"]))) >= 2
    return once(found, lambda r: F.when(repeated(r), F.aggregate(F.sort_array(r), F.struct(none.alias("run"), none.alias("top")), step, lambda at: at["top"])))


def met(text: Column, patterns: tuple[str, ...]) -> list[Column]:
    """Whether each pattern is met in a text of small letters; most texts lack what it needs and are not searched."""
    found = []
    for p, needed in zip(patterns, P.NEEDED[patterns], strict=True):
        here = text.rlike(("(?imd)" if p.startswith("(?m)") else "(?i)") + for_spark(p.removeprefix("(?m)")))
        found.append(reduce(or_, map(text.contains, needed)) & here)
    return found


def kind_of_text(content: Column) -> Column:
    """The kind of a tool's output that is no JSON: data_output, install_log, usage_help, error_output or generic."""
    hits = lambda start, patterns: reduce(add, [m.cast("int") for m in met(start, patterns)])

    def by_start(start: Column) -> Column:
        return F.when(hits(start, P.INSTALL) >= 2, "install_log").when(hits(start, P.HELP) >= 2, "usage_help").when(reduce(or_, met(start, P.ERRORS_NARROW)), "error_output").otherwise("generic")

    links = F.regexp_count(content, F.lit(for_spark(P.URL))) >= 3
    return F.when(links, "data_output").otherwise(once(F.lower(trimmed_start(content, 2000)), by_start))


def key_counts(objects: DataFrame, by: str, text: str) -> DataFrame:
    """(by, key, times) of JSON objects held as text."""
    keys = objects.select(by, F.explode(F.json_object_keys(F.col(text))).alias("key"))
    return keys.groupBy(by, "key").agg(F.count("*").alias("times"))
