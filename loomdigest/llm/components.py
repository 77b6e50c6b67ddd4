"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Links of one node that a task goes through.
MOST = 16_000_000


def _starred(links: DataFrame, step: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(u, v) that ``step`` makes of the links of each lot of a node u, which come by in order of v.

    ``step`` gets u, v, the lot's first v and whether a row is the lot's first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # node, lot, last and first neighbour of what may go on in the next batch
        for batch in batches:
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(u):
                continue
            lot = batch.column(2).to_numpy() if batch.num_columns > 2 else np.zeros(len(u), np.int32)
            first = np.append(last is None or (u[0], lot[0]) != last[:2], (u[1:] != u[:-1]) | (lot[1:] != lot[:-1]))
            fresh = first | np.append(last is None or v[0] != last[2], v[1:] != v[:-1])  # links may come twice
            starts = np.flatnonzero(first)
            low = np.empty(len(u), np.int64)
            if not first[0]:
                low[: starts[0] if len(starts) else len(u)] = last[3]
            if len(starts):
                low[starts[0] :] = np.repeat(v[starts], np.diff(starts, append=len(u)))
            last = u[-1], lot[-1], v[-1], low[-1]
            a, b = step(u[fresh], v[fresh], low[fresh], first[fresh])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    keys = [c for c in links.columns if c != "v"]
    dealt = links.repartition(*keys).sortWithinPartitions(*keys, "v")
    return dealt.select("u", "v", *keys[1:]).mapInArrow(run, "u long, v long")


def _large(u: np.ndarray, v: np.ndarray, low: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Larger neighbours move to the smallest of the node and its neighbours."""
    above = v > u
    return v[above], np.minimum(u, low)[above]


def _small(u: np.ndarray, v: np.ndarray, low: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smaller neighbours, and the node itself, move to the smallest neighbour."""
    others = v != low
    return np.concatenate([v[others], u[first]]), np.concatenate([low[others], low[first]])


def components(links: DataFrame, rounds: int = 60, most: int = MOST) -> DataFrame:
    """(node, root) of every node in links (a, b); root is the smallest node reachable.

    A round is two exchanges of links, checkpointed in the shared folder; it ends when a round
    changes nothing. Links may repeat. The root of a large component has links to all of it:
    where a node has over ``most`` links, larger neighbours are dealt into lots, and the smaller
    ones, of which there is one as a rule, go to every lot.
    """
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before = None
    for _ in range(rounds):
        lots = 1
        if edges.count() > most:
            lots = -(-edges.groupBy("v").count().agg(F.max("count")).first()[0] // most)
        up, down = edges.select(F.col("v").alias("u"), F.col("u").alias("v")), edges
        if lots > 1:
            up = up.select("u", F.pmod(F.xxhash64("v"), F.lit(lots)).cast("int").alias("lot"), "v")
            down = down.select("u", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), "v")
        edges = checkpoint(_starred(_starred(up.unionByName(down), _large), _small))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
