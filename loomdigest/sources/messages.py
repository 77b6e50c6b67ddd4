"""Messages from tables and streams, and the table of facts that compaction leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.engine import flatten

FACTS = "batch long, msg_id long, rule string, tokens_before long, tokens_after long, ratio double, at timestamp"


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Messages with ``content`` as text; where ``content`` is an array of blocks, they become ``blocks``."""
    found = spark.read.format(fmt).load(path)
    if dict(found.dtypes).get("content", "string").startswith("array"):
        found = found.withColumnRenamed("content", "blocks").withColumn("content", flatten(F.col("blocks")))
    return found


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """The facts written so far; an empty table before the first write."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(FACTS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FACTS)


def facts(results: DataFrame, batch: int = 0) -> DataFrame:
    """One row a compacted message."""
    hits = results.where("result.distilled")
    at = F.col("ts").cast("timestamp") if "ts" in results.columns else F.current_timestamp()
    return hits.select(F.lit(batch).cast("long").alias("batch"), F.col("msg_id").cast("long").alias("msg_id"), "result.rule", "result.tokens_before", "result.tokens_after", F.col("result.ratio").alias("ratio"), at.alias("at"))


RUNS = "kind string, at timestamp"


def record_run(spark: SparkSession, path: str, kind: str = "load") -> None:
    """Note a start of the engine, or with ``reset`` that lifetime figures begin anew."""
    if kind not in ("load", "reset"):
        raise ValueError("a run is a load or a reset")
    spark.range(1).select(F.lit(kind).alias("kind"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(RUNS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUNS)


def loads(runs: DataFrame) -> int:
    """Starts of the engine; resets leave them as they are."""
    return runs.where("kind = 'load'").count()


def since_reset(found: DataFrame, runs: DataFrame) -> DataFrame:
    """The facts after the last reset; the facts themselves stay written."""
    last = runs.where("kind = 'reset'").agg(F.max("at")).first()[0]
    return found if last is None else found.where(F.col("at") > F.lit(last))


def lifetime(found: DataFrame) -> DataFrame:
    """One row: distillations, tokens saved, first and last time."""
    return found.agg(F.count("*").alias("distillations"), F.coalesce(F.sum(F.col("tokens_before") - F.col("tokens_after")), F.lit(0)).alias("saved"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def lifetime_rules(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("hits"))


def ago(then_ms: Column, now_ms: Column) -> Column:
    """How long ago in words, from milliseconds; null or 0 gives never."""
    past = now_ms - then_ms
    word = lambda unit, mark: F.concat(F.floor(past / float(unit) + 0.5).cast("string"), F.lit(mark))
    text = F.when(past < 60_000, word(1_000, "s ago")).when(past < 3_600_000, word(60_000, "m ago")).when(past < 86_400_000, word(3_600_000, "h ago")).otherwise(word(86_400_000, "d ago"))
    return F.when(F.coalesce(then_ms, F.lit(0)) == 0, "never").otherwise(text)
