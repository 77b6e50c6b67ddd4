"""Exact deduplication that shuffles only what a Bloom filter finds possibly repeated.

Pass one reads the texts' hashes and marks, in a filter dealt out by segments, the slots
hit more than once. Pass two tests every row against the marked slots: a row whose slots
were not all hit twice has a text of its own and passes straight through; the others are
shuffled and compared by their whole digest. False positives only shuffle more.

The filter is broadcast. It has eight slots a row, up to ``max_slots`` (2**28 slots are 32 MB of
bits): at two slots a row, 134 million rows, still only one row in fourteen is shuffled
needlessly. Beyond, more and more rows shuffle, of which ``classes`` sends digests only;
results stay whole at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, join_groups, whole_rows

SEGMENT_BITS = 18
MAX_SLOTS = 1 << 28
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two slots of each 64-bit hash, one row each."""
    return (hashes.view(np.uint64)[None, :] * _ODD[:, None]) >> np.uint64(64 - bits)


def filter_bits(rows: int, max_slots: int) -> int:
    """log2 of the slots: 8 a row, whole segments, within the bound."""
    return max(SEGMENT_BITS, min(int(max_slots).bit_length() - 1, int(max(1, rows) * 8 - 1).bit_length()))


def repeated_slots(hashes: DataFrame, bits: int) -> DataFrame:
    """(segment, slots): positions in each segment hit by two rows or more.

    A task sends each slot it met once, with a mark if met again, as 4 bytes; a segment
    has 2**18 slots, and what one task sends for it is at most 1 MB.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, held = [], 0

        def rows():
            # the two hash functions share the slots: a row that hits one slot twice counts once
            found, times = np.unique(np.concatenate(once), return_counts=True)
            segment = (found >> np.uint64(SEGMENT_BITS)).astype(np.int64)
            packed = ((found & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.uint32) << np.uint32(1)) | (times > 1).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(segment, prepend=-1))
            ends = np.append(cuts[1:], len(segment))
            return pa.RecordBatch.from_arrays([pa.array(segment[cuts]), pa.array([packed[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], ["segment", "met"])

        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            if len(h):
                first, second = slots(h, bits)
                once += [first, second[second != first]]
                held += 2 * len(h)
            if held > 4_000_000:
                yield rows()
                once, held = [], 0
        if held:
            yield rows()

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SEGMENT_BITS, bool)
        twice = np.zeros(1 << SEGMENT_BITS, bool)
        for batch in batches:
            for met in batch.column(1).to_pylist():
                packed = np.frombuffer(met, np.uint32)
                at = packed >> np.uint32(1)
                twice[at] |= seen[at] | (packed & np.uint32(1)).astype(bool)
                seen[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "twice"])

    met = hashes.mapInArrow(meet, "segment long, met binary")
    return met.groupBy("segment").applyInArrow(merge, "segment long, twice binary")


def possibly_repeated(hashes: DataFrame, max_slots: int = MAX_SLOTS) -> Callable[[Column], Column]:
    """A test of a hash column: false only where no other row of ``hashes`` (one column) has this hash."""
    spark = hashes.sparkSession
    bits = filter_bits(hashes.count(), max_slots)
    marks = np.zeros((1 << bits) // 8, np.uint8)
    for r in repeated_slots(hashes, bits).toLocalIterator():
        part = np.frombuffer(r["twice"], np.uint8)
        marks[r["segment"] * len(part) : (r["segment"] + 1) * len(part)] = part
    shared = spark.sparkContext.broadcast(marks.tobytes())

    @F.arrow_udf("boolean")
    def maybe(hashes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = np.frombuffer(shared.value, np.uint8)
        for array in hashes:
            at = slots(array.to_numpy(zero_copy_only=False), bits)
            hit = (marks[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1
            yield pa.array(hit.all(axis=0))

    return maybe


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_slots: int = MAX_SLOTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the
    largest doc_id stays (null ids are smallest); of rows that repeat that id as well, one
    stays. Other columns are not read. An empty table gives no rows.

    Texts are read once: digest, hash and a number of each row are written, and the passes
    read these. Rows of large groups meet their group by broadcast, whatever their ids are.
    """
    digests = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(_whole(text).cast("binary"), 256).alias("text_sha256"), F.xxhash64(_whole(text)).alias("hash"))
    rows = checkpoint(digests.withColumn("row", F.monotonically_increasing_id()))
    maybe = possibly_repeated(rows.select("hash"), max_slots)
    marked = rows.withColumn("maybe", maybe(F.col("hash")))
    alone = marked.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    more = checkpoint(marked.where("maybe").select("doc_id", "text_sha256", "row"))
    best = F.max(F.struct("doc_id", "row"))
    groups = more.groupBy("text_sha256").agg(best["doc_id"].alias("keep_id"), best["row"].alias("keep_row"), F.count("*").alias("group_size"))
    both = join_groups(more, groups, "text_sha256", more.count(), "group_size")
    return alone.unionByName(both.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_slots: int = MAX_SLOTS) -> DataFrame:
    """The rows of docs that ``classes`` keeps, with all their columns, whatever their names.

    Of rows that repeat text and id, the one with the largest hash of all columns stays, so
    reruns agree. Each task sends one row of a text on at most (a limit on the rank before the
    shuffle), so a group of copies of any size is no load.
    """
    maybe = possibly_repeated(docs.select(F.xxhash64(_whole(text)).alias("hash")), max_slots)
    everything = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map" in t else F.col(f"`{c}`") for c, t in docs.dtypes])
    rows = docs.select(F.col(doc_id).alias("id"), _whole(text).alias("whole"), maybe(F.xxhash64(_whole(text))).alias("maybe"), everything.alias("tie"), whole_rows(docs).alias("row"))
    alone = rows.where(~F.col("maybe")).select("row.*")
    more = rows.where("maybe").withColumn("sha", F.sha2(F.col("whole").cast("binary"), 256)).select("sha", "id", "tie", "row")
    turn = F.row_number().over(Window.partitionBy("sha").orderBy(F.col("id").desc_nulls_last(), F.col("tie").desc()))
    return alone.unionByName(more.withColumn("turn", turn).where("turn = 1").select("row.*"))
