"""What the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder named in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that no later read needs."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo; null ids give null."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def share(column: Column, rate: float) -> Column:
    """A repeatable choice of about that share of the rows, by a hash of the column."""
    return F.pmod(F.xxhash64(column, F.lit("sample")), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))


#: Keys that may be broadcast as hot ones, at most; a row of them is a key, a few numbers and no text.
HOT_KEYS = 20_000


def hot_bound(total: int, least: int = 200) -> int:
    """Rows from which a key is a large one: there are at most ``HOT_KEYS`` such among so many rows."""
    return max(least, total // HOT_KEYS)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int, size: str = "size", largest: int | None = None) -> DataFrame:
    """rows joined with groups (one row a key, with the number of its rows in column ``size``).

    Rows of large groups meet them by broadcast and are not dealt by key, so one key may hold
    most of the ``total`` rows. Where the caller knows that the ``largest`` group is no large
    one, the plan is a plain join. Rows whose key is in no group go.
    """
    bound = hot_bound(total)
    if min(total, total if largest is None else largest) <= bound:
        return rows.join(groups, key)
    hot = F.broadcast(groups.where(F.col(size) > bound))
    cold = groups.where(F.col(size) <= bound)
    cold_rows = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(cold_rows.join(cold, key))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of so many rows at most: a batch lies in memory several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def whole_rows(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns clash with none of them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]) if df.columns else F.struct(F.lit(None))


_resident: dict[str, tuple[Any, Any]] = {}


def resident(key: Any, build: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: one operator's tables at a time.

    Workers outlive stages, so what the stage before kept is let go first.
    """
    held = _resident.get("held")
    if held is None or held[0] != key:
        _resident.clear()
        _resident["held"] = held = (key, build())
    return held[1]
