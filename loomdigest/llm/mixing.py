"""Mixing sources to target weights along a time-varying curriculum, with SQL functions only.

A source's weight changes linearly over training time t in [0, 1]. Its demand for words up
to t is its target times the share of its weight's integral up to t. A document's place in
its source's stream is the words before it; inverting the cumulative demand at that place
gives the document's training position, and the result is range-sorted by position.

Sums run in buckets of a hash of id and text: window partitions hold a bucket of a source, never
a whole source, and bucket totals (a bounded table of sources x buckets) are summed in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, whole_rows

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words taken over all words; the most a document or a source is repeated.
SHARE, MOST = 1.5, 2.0
#: Change of the weight from t=0 to t=1 over its mean, by the source's place, repeating.
SLOPES = (0.0, 1.0, -1.0)


def words(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, total_share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """source, rank, weight, source_size, target from rows of (source, source_size).

    The share is dealt by weight; a source stops at ``most`` times its size and the excess
    is dealt again by weight until none is above. In order of size over weight the stopped
    sources come first, so one ordered pass finds them.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("rank", rank).withColumn("weight", w)
    t = t.withColumn("all_words", F.sum("source_size").over(everything) * F.lit(float(total_share)))
    fill = everything.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("left", F.col("all_words") - F.coalesce(F.sum(F.col("source_size") * F.lit(float(most))).over(before), F.lit(0.0)))
    t = t.withColumn("rate", F.col("left") / F.sum("weight").over(after))
    t = t.withColumn("stopped", F.col("rate") * F.col("weight") >= F.col("source_size") * F.lit(float(most)))
    first = F.first(F.when(~F.col("stopped"), F.col("rate")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("level", first).drop("left")
    target = F.when(F.col("stopped") | F.col("level").isNull(), F.col("source_size") * F.lit(float(most))).otherwise(F.col("level") * F.col("weight"))
    return t.select("source", "rank", "weight", "source_size", target.cast("double").alias("target"))


def _placed(rows: DataFrame, total_share: float, most: float, weights, slopes, bucket_rows: int) -> DataFrame:
    """rows (doc_id, source, size, h, and what travels with them) with their source's figures, the
    words before them in it and what the mix takes of them.

    Rows are dealt by source and bucket; the place of each follows from its own row alone, so
    rows that repeat an id, or have none, are placed each for itself.
    """
    sized = checkpoint(rows.select("source", "size", "h"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    t = checkpoint(targets(per, total_share, most, weights).withColumn("source", key))
    # a bounded number of buckets; their order is that of the hash, so their number changes nothing
    bits = min(16, max(0, int(sized.count() // bucket_rows).bit_length()))
    bucket = F.shiftright(F.conv(F.substring("h", 1, 4), 16, 10).cast("long"), 16 - bits)
    totals = sized.select(key.alias("source"), bucket.alias("bucket"), "size").groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    in_turn = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("start", F.coalesce(F.sum("words").over(in_turn), F.lit(0))).drop("words").join(t, "source")
    rows = rows.withColumn("bucket", bucket).withColumn("source", key)
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["source", "bucket"])
    at = at.withColumn("before", F.col("start") + F.col("inside"))
    full = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.col("target") - full * F.col("source_size")
    extra = (F.col("before") + F.col("size") / 2 <= rest).cast("long")
    times = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(full + extra, F.lit(int(most))))
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), (F.pmod(F.col("rank") - 1, F.lit(len(slopes))) + 1).cast("int"))
    return at.withColumn("times", times.cast("long")).withColumn("slope", slope)


def _narrow(doc_id: str, text: str, source: str) -> list:
    own = [F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size")]
    # rows that repeat an id are apart if their texts are; SQL has this hash too
    whole = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    return [*own, F.md5(whole.cast("binary")).alias("h")]


def _position(turn) -> Column:
    """The time of a use: demand(t) = target * (t + slope * (t**2 - t) / 2), solved for the words before."""
    b = F.col("slope")
    before = (F.col("before") + turn * F.col("source_size")).cast("double")
    u = F.least(F.try_divide(before, F.col("target")), F.lit(1.0))
    a = 1 - b / 2
    return F.when(b == 0, u).otherwise(F.try_divide(F.sqrt(a * a + 2 * b * u) - a, b))


def place(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_share: float = SHARE, most: float = MOST, weights=WEIGHTS, slopes=SLOPES, bucket_rows: int = 2_000) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, position; and the words
    before it in its source and the source's slope.

    Size counts words (null text: 0). Each document is taken floor(target / source_size)
    times, and in order of a hash of its id and text once more while that brings its source
    nearer its target; ``taken`` is words with repeats. ``position`` is the time of its first
    use; null if the mix does not take it or it has no words. Null sources form a source of
    their own, last; null and repeated ids are rows like others; rows equal in id, text and
    source may swap. Other columns are not read. An empty table gives no rows.
    """
    placed = _placed(docs.select(*_narrow(doc_id, text, source)), total_share, most, weights, slopes, bucket_rows)
    taken = F.col("times") * F.col("size")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.when(taken > 0, _position(F.lit(0))).alias("position"), "before", "slope")


def schedule(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """What ``place`` gives, range-sorted by position (what is not taken comes first)."""
    return place(docs, doc_id, text, source, **options).orderBy("position", "doc_id")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_share: float = SHARE, most: float = MOST, weights=WEIGHTS, slopes=SLOPES, bucket_rows: int = 2_000) -> DataFrame:
    """The documents of the mix in training order with all their columns; repeats are rows of their own.

    Every row of docs is there as often as ``place`` takes it: rows that repeat an id, or have
    none, each for itself. Documents without words are no part of a mix and stay, once, at the
    start. Columns may have any name, as rows travel as one struct.
    """
    rows = docs.select(*_narrow(doc_id, text, source), whole_rows(docs).alias("row"))
    placed = _placed(rows, total_share, most, weights, slopes, bucket_rows)
    turns = F.when(F.col("size") == 0, F.array(F.lit(0).cast("long"))).when(F.col("times") > 0, F.sequence(F.lit(0).cast("long"), F.col("times") - 1))
    uses = placed.withColumn("turn", F.explode(turns))
    position = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(_position(F.col("turn")))
    return uses.select(position.alias("at"), "doc_id", "h", "row").orderBy("at", "doc_id", "h").select("row.*")


def _nth(values) -> str:
    return f"[{', '.join(str(float(x)) for x in values)}][((rank - 1) % {len(values)}) + 1]"


#: The same as ``schedule`` with its defaults: doc_id, size, source_size, target, taken, position.
SQL = f"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
            md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS h FROM documents),
        per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM per),
        weighed AS (SELECT *, {_nth(WEIGHTS)} AS weight, {_nth(SLOPES)} AS b, source_size * {MOST}::DOUBLE AS most FROM ranked),
        filled AS (SELECT *, (sum(source_size) OVER ()) * {SHARE}::DOUBLE - coalesce(sum(most) OVER (
                    ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS remaining,
                sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
            FROM weighed),
        levels AS (SELECT *, remaining / weights AS rate, (remaining / weights) * weight >= most AS stopped FROM filled),
        level AS (SELECT rate AS level FROM levels WHERE NOT stopped ORDER BY source_size / weight, rank LIMIT 1),
        t AS (SELECT source, source_size, b, 1 - b / 2 AS a, CASE WHEN stopped OR level IS NULL THEN most ELSE level * weight END AS target
            FROM levels LEFT JOIN level ON true),
        placed AS (SELECT doc_id, size, source_size, target, a, b, coalesce(sum(size) OVER (
                PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        counted AS (SELECT *, floor(target / greatest(source_size, 1)) AS full_times, CASE WHEN target > 0 THEN least(before::DOUBLE / target, 1.0) END AS u FROM placed),
        taken AS (SELECT *, (CASE WHEN size = 0 THEN 0 ELSE least(full_times
                + CASE WHEN before + size / 2.0 <= target - full_times * source_size THEN 1 ELSE 0 END, {int(MOST)}) * size END)::BIGINT AS taken FROM counted)
    SELECT doc_id, size, source_size, target, taken,
        CASE WHEN taken > 0 THEN CASE WHEN b = 0 THEN u ELSE (sqrt(a * a + 2 * b * u) - a) / b END END AS position
    FROM taken
"""
