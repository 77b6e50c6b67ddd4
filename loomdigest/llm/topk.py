"""Exact top-k inner products with block-at-a-time pruning.

Vectors are floored to integers. Candidates lie in blocks of neighbouring ids, each with its
forward index (the vectors) and, for each term (component), its largest and smallest value.
A query's bound in a block sums, over its terms, the larger of its two products. For each
query the blocks of a shard are taken in descending order of bound and scored until the
bound falls below the k-th best score. Queries come by at every shard in batches, and the
shards' k best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

_LONG = 2**63 - 1


def _floor(x: Column) -> Column:
    """floor as a double: Spark's own gives a long, which large values leave."""
    whole = F.rint(x)
    return F.when(whole > x, whole - 1).otherwise(whole)


def _matrix(vectors: list[list[float]], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int, rows: np.ndarray | None = None, query_rows: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best in the shard; ties go to smaller ids.

    A query's own row is none of its candidates: by its number in ``rows``, or else by its id.
    """
    rows, query_rows = (ids, query_ids) if rows is None else (rows, query_rows)
    order = np.argsort(ids, kind="stable")
    ids, vectors, rows = ids[order], vectors[order], rows[order]
    # sums of products stay exact in doubles; beyond, Python's integers are used
    exact = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1] < 2**52
    if not exact:
        vectors, queries = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (vectors, queries))
    starts = list(range(0, len(ids), block))
    high = np.stack([vectors[a : a + block].max(axis=0) for a in starts])
    low = np.stack([vectors[a : a + block].min(axis=0) for a in starts])
    up = np.where(queries > 0, queries, 0)
    bounds = up @ high.T + (queries - up) @ low.T
    turn = np.argsort(-bounds.astype(float), axis=1, kind="stable")
    best_score = [np.zeros(0, queries.dtype)] * len(queries)
    best_id = [np.zeros(0, np.int64)] * len(queries)
    live = np.arange(len(queries))
    for step in range(len(starts)):
        # each query's next block; those that share it are scored together
        block_of = turn[live, step]
        full = np.array([len(best_id[q]) >= k and bounds[q, b] < best_score[q][-1] for q, b in zip(live, block_of, strict=True)], bool)
        live, block_of = live[~full], block_of[~full]
        if not len(live):
            break
        for b in np.unique(block_of):
            mine = live[block_of == b]
            a = starts[b]
            scores = queries[mine] @ vectors[a : a + block].T
            own, own_rows = ids[a : a + block], rows[a : a + block]
            for q, row in zip(mine, scores, strict=True):
                fit = own_rows != query_rows[q]
                if len(best_id[q]) >= k:
                    fit &= row >= best_score[q][-1]
                at = np.flatnonzero(fit)
                if not len(at):
                    continue
                s, i = np.concatenate([best_score[q], row[at]]), np.concatenate([best_id[q], own[at]])
                top = sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k] if len(s) < 64 or not exact else np.lexsort((i, -s))[:k]
                best_score[q], best_id[q] = s[top], i[top]
    return [(int(query_ids[q]), int(i), max(-_LONG - 1, min(_LONG, int(s)))) for q in range(len(queries)) for s, i in zip(best_score[q], best_id[q], strict=True)]


def top_k(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = 256, shard: int = 65_536, queries: int = 2_048) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each query row.

    Components become floor(scale * x). Vectors that are null or hold a null or non-finite
    component, and null ids, take no part; missing components of a shorter vector are zero.
    Rows that repeat an id are candidates each, also for another row of that id; a repeated
    query id counts once, by the first of its rows in order of components. Scores beyond a
    long stop at its ends. An empty table gives no rows; other columns are not read.

    Every candidate is sent once, to its shard; every query is sent to all shards, where it
    comes by in batches of ``queries`` behind the candidates. A shard and a batch are all that
    a task holds.
    """
    x = F.col(vector)
    sound = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = rows.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: _floor(v.cast("double") * scale)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    # a row's number tells it from others of its id; written, so that it stays
    usable = checkpoint(usable.withColumn("row", F.monotonically_increasing_id()))
    n = usable.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    shards, width = max(1, -(-n["n"] // shard)), max(1, n["w"] or 1)
    first = F.row_number().over(Window.partitionBy("vec_id").orderBy("v", "row"))
    asked = usable.where("q").withColumn("turn", first).where("turn = 1").select("vec_id", "v", "row")
    # neighbouring rows share a shard, whatever their ids are
    placed = usable.select(F.pmod(F.xxhash64(F.shiftright("row", 8)), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "vec_id", "v", "row")
    everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "vec_id", "v", "row")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held, waiting = None, [], None, 0

        def columns(tables: list[pa.Table]) -> tuple:
            t = pa.concat_tables(tables)
            return t.column("vec_id").to_numpy(), _matrix(t.column("v").to_pylist(), width), t.column("row").to_numpy()

        def found() -> Iterator[pa.RecordBatch]:
            if held is None or not parts:
                return
            (ids, vectors, own), (query_ids, wanted, query_rows) = held, columns(parts)
            hits = search_shard(ids, vectors, query_ids, wanted, k, block, own, query_rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*hits, strict=True) if hits else ((), (), ()))], ["query_id", "vec_id", "score"])

        # rows come by shard, the candidates of each before its queries
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = table.column("shard").to_numpy() * 2 + table.column("asks").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if key[lo] != at:
                    if at is not None and at % 2:
                        yield from found()
                        held = None
                    elif parts:
                        held = columns(parts)
                    parts, waiting, at = [], 0, int(key[lo])
                    if not at % 2:
                        held = None
                parts.append(table.slice(lo, hi - lo))
                waiting += hi - lo
                if at % 2 and waiting >= queries:
                    yield from found()
                    parts, waiting = [], 0
        if at is not None and at % 2:
            yield from found()

    dealt = placed.unionByName(everywhere).repartition("shard").sortWithinPartitions("shard", "asks")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    hits = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    return hits.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
