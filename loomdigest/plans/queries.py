"""The engine's registered queries over the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import patterns as P
from ..functions.text import ASTRAL, BLANK, CJK, MASKS, category, either, estimate_tokens, for_re2, threshold
from ..operators import lines, profiles
from . import engine, report


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("msg_id"), F.col("text").alias("content"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("msg_id", estimate_tokens(F.col("content")).alias("tokens"))


def classify_and_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = category(F.col("text"))
    measured = turns.select("conv_id", "turn", "role", kind.alias("category"), estimate_tokens(F.col("text")).alias("tokens"))
    # turns are short, so the gate is taken at a lower limit
    limit = threshold(F.col("category"), Config(message_max_tokens=100))
    return measured.withColumn("threshold", limit).where(F.col("tokens") > F.col("threshold"))


def line_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(_messages(spark, sf_dir))


def line_dedup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_messages(spark, sf_dir))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of each customer's orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string"), F.lit("status"), F.col("o_orderstatus"))
    gathered = orders.groupBy(F.col("o_custkey").alias("msg_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    return gathered.select("msg_id", F.array_join(F.transform("l", lambda r: r["line"]), "\n").alias("content"))


def template_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.template_groups(_logs(spark, sf_dir))


def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    config = Config()
    over = messages.where(estimate_tokens(F.col("content")) > config.tool_output_max_tokens)
    return lines.head_tail(over, config.tool_output_max_tokens)


def truncate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.truncate(_messages(spark, sf_dir), 1000)


def _texts(rows: DataFrame, key: Column, order: list[str], line: Column, first: str = "", sep: str = "\n") -> DataFrame:
    """A message a key: its lines in order, after a first one."""
    gathered = rows.groupBy(key.alias("msg_id")).agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))).alias("l"))
    return gathered.select("msg_id", F.concat(F.lit(first), F.array_join(F.transform("l", lambda r: r["line"]), sep)).alias("content"))


def _event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of each user's events, with sums, warnings and errors among them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("Total: "), n)).when(F.col("event_id") % 11 == 0, F.concat(F.lit("warning: slow "), n)).otherwise(F.concat("event_type", F.lit(" event "), n))
    return _texts(events, F.col("user_id"), ["event_id"], line)


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.severity_counts(_event_logs(spark, sf_dir))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of each supplier's items, as text."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("l_partkey", "l_quantity", "l_discount", "l_returnflag")])
    return _texts(items, F.col("l_suppkey"), ["l_orderkey", "l_linenumber"], line, "part,quantity,discount,flag\n")


def csv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the order of a sum differs between engines; nine digits are the same in all
    return profiles.csv_profile(_tables(spark, sf_dir)).withColumn("mean", F.round("mean", 9))


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff of each customer's orders: one hunk an order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    line = F.concat(F.lit("@@ "), key, F.lit(" @@\n same "), key, F.lit("\n-status O\n+status "), "o_orderstatus", F.lit("\n+priority "), "o_orderpriority")
    return _texts(orders, F.col("o_custkey"), ["o_orderkey"], line, "diff a b\n--- a/orders\n+++ b/orders\n")


def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.diff_stats(_diffs(spark, sf_dir))


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of parts, in twenty listings."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    ending = F.when(F.col("p_size") % 3 == 0, "py").when(F.col("p_size") % 5 == 0, "md").when(F.col("p_size") % 7 == 0, "tar_gz").otherwise("rs")
    line = F.concat(F.lit("src/"), "p_brand", F.lit("/"), "p_type", F.lit("/f"), F.col("p_partkey").cast("string"), F.lit("."), ending)
    return _texts(parts, F.col("p_partkey") % 20, ["p_partkey"], line)


def listing_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.listing_extensions(_listings(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of each customer of a nation, apart by blank lines."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("Customer "), key, F.lit("\nname: "), "c_name", F.lit("\nMarket Segment = "), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("\nrank: "), (F.col("c_custkey") % 4).cast("string"))).otherwise(""))
    return _texts(customers, F.col("c_nationkey").cast("long"), ["c_custkey"], line, sep="\n\n")


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.record_fields(_records(spark, sf_dir))


def common_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.common_blocks(_diffs(spark, sf_dir), 2).unionByName(profiles.common_blocks(_messages(spark, sf_dir), 2))


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("msg_id"), F.col("html").alias("content"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("msg_id"), F.col("text").alias("content"))
    helps = _listings(spark, sf_dir).select((F.col("msg_id") + 10**9).alias("msg_id"), F.concat(F.lit("usage: tool\noptions: none\n"), "content").alias("content"))
    installs = _records(spark, sf_dir).select((F.col("msg_id") + 2 * 10**9).alias("msg_id"), F.concat(F.lit("npm install x\nadded 3 packages\n"), "content").alias("content"))
    logs = _event_logs(spark, sf_dir).select((F.col("msg_id") + 3 * 10**9).alias("msg_id"), "content")
    return pages.unionByName(turns).unionByName(helps).unionByName(installs).unionByName(logs)


def content_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir).select("msg_id", profiles.kind_of_text(F.col("content")).alias("kind"))


def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.key_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "props")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all forms above, each with its category."""
    kinds = (("tool_output", 0, _event_logs), ("tool_output", 1, _tables), ("patch", 2, _diffs), ("tool_output", 3, _listings), ("tool_output", 4, _records), ("file_content", 5, _messages))
    parts = [make(spark, sf_dir).select((F.col("msg_id") * 10 + n).alias("msg_id"), "content", F.lit(kind).alias("category")) for kind, n, make in kinds]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def compacted_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.Engine().apply(_payloads(spark, sf_dir)).select("msg_id", "category", "result.*")


def compacted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.Engine(profile="rules").apply(_payloads(spark, sf_dir)).select("msg_id", "category", "result.*")


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.rule_hits(engine.Engine().apply(_payloads(spark, sf_dir)))


def long_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of documents above the limit of messages, outputs of tools cut from both ends."""
    docs = _messages(spark, sf_dir).withColumn("role", F.when(F.col("msg_id") % 2 == 0, "user").otherwise("tool"))
    return engine.Engine().write_messages(docs).select("msg_id", "role", "result.*")


def running_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tenth of each event's value does to an average, by user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", (F.col("value") / 1000).alias("ratio"))
    return engine.running_ratio(events, ["user_id"], "event_id").select("user_id", F.round("average", 9).alias("average"))


def case_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged cases made of orders, by status: priced as tokens, cut by their customer's number."""
    before = F.floor(F.col("o_totalprice") / 100).cast("long")
    hit = F.col("o_custkey") % 5 != 0
    after = F.floor(before * (F.col("o_custkey") % 101) / 100).cast("long")
    made = F.struct(hit.alias("distilled"), F.col("o_orderpriority").alias("content"), before.alias("tokens_before"), after.alias("tokens_after"), F.concat(F.lit("rule/"), F.col("o_orderstatus")).alias("rule"))
    cases = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", made.alias("result"), F.lit("rule/F").alias("expected_rule"), F.lit("1-URGENT").alias("expected_text"))
    judged = report.judged(cases)
    counts = judged.groupBy("o_orderstatus").agg(F.count_if("rule_match").alias("matches"), F.count_if("text_found").alias("found"))
    return report.summary(judged, "o_orderstatus").join(counts, "o_orderstatus")


QUERIES = {
    f.__name__: f
    for f in (
        token_estimate, classify_and_gate, line_dedup_stats, line_dedup_text, template_groups, head_tail, truncate_budget, severity_counts, csv_profile, diff_stats,
        listing_extensions, record_fields, common_blocks, content_analysis, json_keys, compacted_sync, compacted_rules, rule_hits, long_messages, running_ratio, case_report,
    )
}


def _tokens(x: str) -> str:
    wide = f"len(regexp_extract_all({x}, '{CJK}'))"
    return f"CAST(ceil({wide}/1.5e0 + (length({x}) + len(regexp_extract_all({x}, '{ASTRAL}')) - {wide})/4e0) AS BIGINT)"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{BLANK}+', ''), '{BLANK}+$', '')"


def _masked(x: str) -> str:
    for pattern, mask in MASKS:
        x = f"regexp_replace({x}, '{pattern}', '{mask}', 'g')"
    return x


_LINES = "SELECT doc_id AS msg_id, u.pos - 1 AS pos, u.line, len(string_split(text, chr(10))) AS n_lines, text FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos)"
SQL = {
    "token_estimate": f"SELECT doc_id AS msg_id, {_tokens('text')} AS tokens FROM documents",
    "classify_and_gate": f"""
        WITH t AS (SELECT conv_id, turn, role, CASE WHEN contains(text, '@@') AND contains(text, '---') AND contains(text, '+++') THEN 'patch' ELSE 'text' END AS category, {_tokens("text")} AS tokens FROM conversations)
        SELECT *, CAST(CASE category WHEN 'patch' THEN 600 ELSE 100 END AS BIGINT) AS threshold FROM t WHERE tokens > CASE category WHEN 'patch' THEN 600 ELSE 100 END""",
    "line_dedup_stats": f"WITH l AS ({_LINES}) SELECT msg_id, {_trim('line')} AS line, count(*) AS times, min(pos) AS first_pos FROM l WHERE n_lines >= 10 GROUP BY ALL HAVING count(*) > 3 AND {_trim('line')} <> ''",
    "line_dedup_text": f"""
        WITH l AS ({_LINES}), k AS (SELECT *, {_trim("line")} AS key FROM l WHERE n_lines >= 10),
        c AS (SELECT *, CASE WHEN key <> '' THEN count(*) OVER (PARTITION BY msg_id, key) ELSE 0 END AS times, row_number() OVER (PARTITION BY msg_id, key ORDER BY pos) AS turn FROM k),
        m AS (SELECT *, max(times) OVER (PARTITION BY msg_id) AS most FROM c)
        SELECT msg_id, string_agg(CASE WHEN times > 3 THEN line || chr(10) || '  [↑ repeated ' || times || '× total, showing once]' ELSE line END, chr(10) ORDER BY pos) AS content
        FROM m WHERE most > 3 AND (times <= 3 OR turn = 1) GROUP BY msg_id""",
    "template_groups": f"""
        WITH l AS (SELECT o_custkey AS msg_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n_lines, 'order ' || o_orderkey || ' status ' || o_orderstatus AS line FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
        m AS (SELECT msg_id, pos, line, {_masked("line")} AS template FROM l WHERE n_lines >= 20 AND length(line) >= 10)
        SELECT msg_id, template, count(*) AS times, min(pos) AS first_pos FROM m WHERE template <> line GROUP BY ALL HAVING count(*) >= 5""",
    "head_tail": f"""
        WITH l AS (SELECT *, {_tokens("line")} AS tok, {_tokens("text")} AS whole FROM ({_LINES})),
        s AS (SELECT *, sum(tok) OVER (PARTITION BY msg_id ORDER BY pos) AS down, sum(tok) OVER (PARTITION BY msg_id ORDER BY pos DESC) AS up FROM l WHERE whole > 1200),
        p AS (SELECT *, CASE WHEN down <= 720 THEN 0 WHEN up <= 480 THEN 2 ELSE 1 END AS part FROM s),
        e AS (SELECT msg_id, count(*) FILTER (part = 0) AS head_lines, count(*) FILTER (part = 2) AS tail_lines, count(*) FILTER (part = 1) AS omitted, coalesce(sum(tok) FILTER (part <> 1), 0) AS kept, any_value(whole) AS whole FROM p GROUP BY msg_id),
        r AS (SELECT msg_id, part, pos, line FROM p WHERE part <> 1 UNION ALL SELECT msg_id, 1, 0, chr(10) || '[… ' || omitted || ' lines omitted (' || (whole - kept)::BIGINT || ' tokens) …]' || chr(10) FROM e WHERE omitted > 0)
        SELECT e.msg_id, head_lines, tail_lines, omitted, string_agg(line, chr(10) ORDER BY part, pos) AS content FROM e JOIN r USING (msg_id) GROUP BY ALL""",
}


def _text(table: str, key: str, order: str, line: str, first: str = "''", sep: str = "chr(10)") -> str:
    return f"SELECT {key} AS msg_id, {first} || string_agg({line}, {sep} ORDER BY {order}) AS content FROM {table} GROUP BY 1"


def _each(content: str) -> str:
    return f"SELECT msg_id, u.pos - 1 AS pos, u.line, len(string_split(content, chr(10))) AS n_lines, content FROM ({content}), unnest(string_split(content, chr(10))) WITH ORDINALITY AS u(line, pos)"


_DOCS = "SELECT doc_id AS msg_id, text AS content FROM documents"
_LOGS = _text("events", "user_id", "event_id", "CASE WHEN event_id % 7 = 0 THEN 'Total: ' || event_id WHEN event_id % 11 = 0 THEN 'warning: slow ' || event_id ELSE event_type || ' event ' || event_id END")
_CSV_ROW = "concat_ws(',', l_partkey, l_quantity, l_discount, l_returnflag)"
_TABLES = _text("lineitem", "l_suppkey", f"l_orderkey, l_linenumber, {_CSV_ROW}", _CSV_ROW, "'part,quantity,discount,flag' || chr(10)")
_N = "' || chr(10) || '"
_DIFFS = _text("orders", "o_custkey", "o_orderkey", f"'@@ ' || o_orderkey || ' @@{_N} same ' || o_orderkey || '{_N}-status O{_N}+status ' || o_orderstatus || '{_N}+priority ' || o_orderpriority", f"'diff a b{_N}--- a/orders{_N}+++ b/orders' || chr(10)")
_LISTS = _text("part", "p_partkey % 20", "p_partkey", "'src/' || p_brand || '/' || p_type || '/f' || p_partkey || '.' || CASE WHEN p_size % 3 = 0 THEN 'py' WHEN p_size % 5 = 0 THEN 'md' WHEN p_size % 7 = 0 THEN 'tar_gz' ELSE 'rs' END")
_RECORDS = _text("customer", "CAST(c_nationkey AS BIGINT)", "c_custkey", f"'Customer ' || c_custkey || '{_N}name: ' || c_name || '{_N}Market Segment = ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'rank: ' || c_custkey % 4 ELSE '' END", sep="chr(10) || chr(10)")


def _severity(x: str) -> str:
    has = lambda patterns, ignore: f"regexp_matches({x}, '{either(patterns, ignore, for_re2)}')"
    warning = f"{has((P.WARNING,), True)} AND NOT {has((P.GRAVE,), True)}"
    return f"CASE WHEN {x} = '' THEN NULL WHEN {has(P.SUMMARY_WIDE, False)} THEN 'summary' WHEN {has(P.ERRORS_WIDE, True)} THEN CASE WHEN {warning} THEN 'warning' ELSE 'error' END END"


def _hits(x: str, patterns: tuple[str, ...]) -> str:
    cases = [("(?im)" if p.startswith("(?m)") else "(?i)") + for_re2(p.removeprefix("(?m)")) for p in patterns]
    return " + ".join(f"CAST(regexp_matches({x}, '{c}') AS INT)" for c in cases)


def _blocks(content: str) -> str:
    """Runs of two lines, the commonest of each message."""
    runs = f"SELECT msg_id, pos, {_trim('line || chr(10) || next')} AS block FROM (SELECT *, lead(line) OVER (PARTITION BY msg_id ORDER BY pos) AS next FROM ({_each(content)}) WHERE n_lines >= 20) WHERE next IS NOT NULL"
    counts = f"SELECT msg_id, block, count(*) AS times, CAST(min(pos) AS INT) AS first_pos FROM ({runs}) WHERE length(block) + len(regexp_extract_all(block, '{ASTRAL}')) >= 20 GROUP BY ALL HAVING count(*) >= 3"
    return f"SELECT msg_id, block, times, first_pos FROM ({counts}) QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY times DESC, first_pos) = 1"


_FIELD = for_re2(P.FIELD_LINE)
_URL = for_re2(P.URL).replace("'", "''")
SQL |= {
    "truncate_budget": f"""
        WITH l AS (SELECT *, {_tokens("line")} AS tok FROM ({_each(_DOCS)}) WHERE {_tokens("content")} > 1000),
        s AS (SELECT *, sum(tok) OVER (PARTITION BY msg_id ORDER BY pos) AS down, first_value(tok) OVER (PARTITION BY msg_id ORDER BY pos) AS head, first_value(line) OVER (PARTITION BY msg_id ORDER BY pos) AS top FROM l),
        k AS (SELECT msg_id, any_value(n_lines) AS n_lines, any_value(head) AS head, any_value(top) AS top, count(*) FILTER (down <= 1000) AS n, string_agg(line, chr(10) ORDER BY pos) FILTER (down <= 1000) AS body FROM s GROUP BY msg_id)
        SELECT msg_id, CAST(greatest(n, 1) AS INT) AS kept,
        CASE WHEN n = 0 THEN left(top, CAST(floor((length(top) + len(regexp_extract_all(top, '{ASTRAL}'))) * (1000e0 / head) * 0.9e0) AS INT)) || '…' ELSE body END
        || CASE WHEN n_lines > greatest(n, 1) THEN chr(10) || chr(10) || '[… truncated, ' || (n_lines - greatest(n, 1)) || ' more lines]' ELSE '' END AS content FROM k""",
    "severity_counts": f"""
        WITH c AS (SELECT msg_id, {_severity("line")} AS c FROM (SELECT msg_id, {_trim("line")} AS line FROM ({_each(_LOGS)})))
        SELECT msg_id, count(*) FILTER (c = 'error') AS errors, count(*) FILTER (c = 'warning') AS warnings, count(*) FILTER (c = 'summary') AS summaries FROM c WHERE c IS NOT NULL GROUP BY msg_id""",
    "csv_profile": f"""
        WITH r AS (SELECT msg_id, string_split(line, ',') AS cells FROM ({_each(_TABLES)}) WHERE pos > 0 AND n_lines >= 5),
        v AS (SELECT msg_id, CAST(i AS INT) AS col, ['part', 'quantity', 'discount', 'flag'][i + 1] AS name, cells[i + 1] AS cell, TRY_CAST(cells[i + 1] AS DOUBLE) AS x FROM r, range(4) AS t(i))
        SELECT msg_id, col, name, count(*) AS filled, count(x) AS numeric, CASE WHEN count(x) > count(*) * 0.8 THEN min(x) END AS low, CASE WHEN count(x) > count(*) * 0.8 THEN max(x) END AS high,
        CASE WHEN count(x) > count(*) * 0.8 THEN round(sum(x) / count(x), 9) END AS mean, count(DISTINCT cell) AS "distinct" FROM v GROUP BY ALL""",
    "diff_stats": f"""
        SELECT msg_id, CAST(greatest(1, ceil(count(*) FILTER (line LIKE '+++ %' OR line LIKE '--- %') / 2e0)) AS BIGINT) AS files, count(*) FILTER (line LIKE '+%' AND line NOT LIKE '+++%') AS added,
        count(*) FILTER (line LIKE '-%' AND line NOT LIKE '---%') AS deleted, count(*) FILTER (line LIKE '@@%') AS hunks FROM ({_each(_DIFFS)}) GROUP BY msg_id""",
    "listing_extensions": f"""
        WITH e AS (SELECT msg_id, regexp_extract(line, '\\.([A-Za-z0-9_]+)$', 1) AS ext, pos FROM ({_each(_LISTS)}) WHERE n_lines >= 20),
        c AS (SELECT msg_id, ext, count(*) AS times, min(pos) AS pos FROM e WHERE ext <> '' GROUP BY ALL)
        SELECT msg_id, ext, times, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY times DESC, pos) AS INT) AS place FROM c QUALIFY place <= 8""",
    "record_fields": f"""
        WITH l AS (SELECT *, sum(CAST({_trim("line")} = '' AS INT)) OVER (PARTITION BY msg_id ORDER BY pos) AS island, lower({_trim(f"regexp_extract(line, '{_FIELD}', 2)")}) AS label, {_trim(f"regexp_extract(line, '{_FIELD}', 3)")} AS value FROM ({_each(_RECORDS)}) WHERE n_lines >= 30),
        k AS (SELECT *, count(*) OVER (PARTITION BY msg_id, label) AS times FROM l WHERE label <> ''),
        v AS (SELECT msg_id, island, label, arg_max(value, pos) AS value FROM k WHERE times >= 5 GROUP BY ALL),
        n AS (SELECT msg_id FROM v GROUP BY msg_id HAVING count(DISTINCT island) >= 5 AND count(DISTINCT label) >= 2)
        SELECT msg_id, label, count(*) AS records, count(DISTINCT value) AS "distinct" FROM v SEMI JOIN n USING (msg_id) GROUP BY ALL""",
    "common_blocks": f"{_blocks(_DIFFS)} UNION ALL {_blocks(_DOCS)}",
    "content_analysis": f"""
        WITH o AS (SELECT page_id AS msg_id, html AS content FROM pages UNION ALL SELECT -1 - conv_id * 1000 - turn, text FROM conversations UNION ALL
        SELECT msg_id + 1000000000, 'usage: tool{_N}options: none' || chr(10) || content FROM ({_LISTS}) UNION ALL SELECT msg_id + 2000000000, 'npm install x{_N}added 3 packages' || chr(10) || content FROM ({_RECORDS}) UNION ALL
        SELECT msg_id + 3000000000, content FROM ({_LOGS})), s AS (SELECT *, lower(left({_trim("content")}, 2000)) AS start FROM o)
        SELECT msg_id, CASE WHEN len(regexp_extract_all(content, '{_URL}')) >= 3 THEN 'data_output' WHEN {_hits("start", P.INSTALL)} >= 2 THEN 'install_log' WHEN {_hits("start", P.HELP)} >= 2 THEN 'usage_help'
        WHEN regexp_matches(start, '{either(P.ERRORS_NARROW, True, for_re2)}') THEN 'error_output' ELSE 'generic' END AS kind FROM s""",
    "case_report": """
        WITH o AS (SELECT o_orderstatus, o_custkey % 5 <> 0 AS hit, o_orderpriority AS content, floor(o_totalprice / 100)::BIGINT AS before, o_custkey FROM orders),
        r AS (SELECT *, CASE WHEN hit THEN before - floor(before * (o_custkey % 101) / 100)::BIGINT ELSE 0 END AS saved FROM o),
        c AS (SELECT *, CASE WHEN hit THEN floor(saved / greatest(before, 1) * 100 + 0.5e0)::BIGINT ELSE 0 END AS percent FROM r),
        p AS (SELECT *, CASE WHEN hit THEN saved > 0 AND percent >= 10 ELSE before < 150 END AS passes FROM c)
        SELECT o_orderstatus, count(*) AS cases, count(*) FILTER (passes) AS passed, count(*) FILTER (NOT passes) AS failed, sum(before)::BIGINT AS tokens, sum(saved)::BIGINT AS saved,
        floor(sum(saved)::DOUBLE / greatest(sum(before), 1)::DOUBLE * 100 + 0.5e0)::BIGINT AS saved_percent, floor(avg(percent) + 0.5e0)::BIGINT AS mean_percent,
        count(*) FILTER (hit) AS matches, count(*) FILTER (hit AND contains(content, '1-URGENT')) AS found FROM p GROUP BY o_orderstatus""",
    "json_keys": "SELECT event_type, k AS key, count(*) AS times FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL",
    "running_ratio": """
        WITH r AS (SELECT user_id, value / 1000 AS ratio, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS back FROM events WHERE value IS NOT NULL)
        SELECT user_id, round(sum(ratio * 0.1e0 * pow(0.9e0, back)) + pow(0.9e0, count(*)), 9) AS average FROM r GROUP BY user_id""",
}
