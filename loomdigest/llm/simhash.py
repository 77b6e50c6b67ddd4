"""SimHash near-duplicates, linked through BK-trees of bounded shards.

Texts get 64-bit fingerprints of their word shingles. Fingerprints at ``radius`` or fewer
differing bits are linked and components of links are classes. The 64 bits are cut into
runs; two fingerprints within the radius agree on at least runs - radius of them, so each
choice of that many runs is a key and linked fingerprints share one. The different
fingerprints of a key form a shard: a BK-tree whose children are keyed by their integer
Hamming distance to the parent, searched along edges within the radius only.

The number of runs follows the number of fingerprints, keys that many share are made finer,
and what is still large is cut into several trees. Trees are built where their shard's rows
meet, from rows dealt by shuffle: a Spark broadcast of all shard trees would grow with the
corpus and pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bktree
from .common import checkpoint, join_groups, small_batches, whole_rows
from .components import components

_PART = 1 << 16


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, repeats included, in parts of bounded length."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], (ends[width - 1 :] if len(words) >= width else ends[-1:])
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, _PART):
        yield np.array([hashed(whole[a:b], seed) for a, b in zip(starts[at : at + _PART].tolist(), ends[at : at + _PART].tolist(), strict=True)], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """Bits set in over half of the hashes; none give 0."""
    sums, n = np.zeros(64, np.int64), 0
    for part in parts:
        sums += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(sums * 2 > n).tobytes(), "big") if n else 0


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    return majority(shingle_hashes(text, width, seed))


def fingerprints(text: Column, width: int) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def compute(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            got = []
            for at in range(0, len(array), 512):
                got += [fingerprint(t, width) for t in array.slice(at, 512).to_pylist()]
            yield pa.array(np.array(got, np.uint64).view(np.int64) if got else [], pa.int64())

    return compute(text)


def runs(blocks: int) -> list[tuple[int, int]]:
    """(low bit, width) of each run of the 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def masks(radius: int, blocks: int) -> list[int]:
    """Each choice of ``blocks - radius`` runs: values within the radius agree on one of them at least."""
    bits = runs(blocks)
    return [sum(((1 << bits[i][1]) - 1) << bits[i][0] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def finer(mask: int, radius: int) -> list[int]:
    """The mask with one of ``radius + 1`` runs of its other bits each: again one is agreed on at least."""
    rest = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(rest) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in rest[x:y]) for x, y in zip(cuts, cuts[1:])]


def runs_for(values: int, radius: int, full: int = 64) -> int:
    """How many runs: keys of so many bits that evenly spread values come about ``full`` to a key at most."""
    blocks = radius + 2
    while values >> (64 * (blocks - radius) // blocks) > full and blocks < 2 * radius + 4:
        blocks += 1
    return blocks


def _keyed(values: DataFrame, chosen: list[int]) -> DataFrame:
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    keys = F.array(*[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("at")) for n, m in enumerate(signed)])
    return values.select("fp", F.explode(keys).alias("k")).select("fp", F.col("k.n").alias("n"), F.xxhash64("k.n", "k.at").alias("cell"))


def links(values: DataFrame, radius: int = 4, blocks: int | None = None, shard: int = 4096) -> DataFrame:
    """(a, b): links between different values of column ``fp`` whose components are those of all links.

    Keys that more than ``shard`` values share are made finer by their other bits, twice if need
    be, which loses no link; what is still large is cut by ``search``.
    """
    chosen = masks(radius, blocks or runs_for(values.count(), radius))
    keyed, found = _keyed(values, chosen), None
    for _ in range(2):
        hot = _large(keyed, shard)
        if hot.isEmpty():
            part = _linked(keyed, radius, None)
            return part if found is None else found.unionByName(part)
        part = _linked(keyed.join(hot, "cell", "left_anti"), radius, None)
        found = part if found is None else found.unionByName(part)
        below = [finer(m, radius) for m in chosen]
        chosen = [m for ms in below for m in ms]
        signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in chosen])
        sub = F.explode(F.sequence(F.col("n") * (radius + 1), F.col("n") * (radius + 1) + radius))
        rows = keyed.join(hot, "cell", "left_semi").select("fp", sub.alias("n"))
        keyed = rows.select("fp", "n", F.xxhash64("n", F.col("fp").bitwiseAND(F.element_at(signed, F.col("n") + 1))).alias("cell"))
    return found.unionByName(_linked(keyed, radius, shard))


def _linked(keyed: DataFrame, radius: int, shard: int | None) -> DataFrame:
    def find(rows: pa.Table, joined: bktree.Joined, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in hits(rows, radius):
            # equal values of a key that came twice are one
            x, y = roots[a], roots[b]
            fewest = joined.spanning(x, y)
            yield a[fewest], b[fewest]

    return search(keyed.select("cell", F.col("fp").alias("id"), F.col("fp").alias("root"), "fp"), find, shard)


# -- shards ------------------------------------------------------------------------------
#: Rows of shards that a task searches side by side; bounds its memory with ``shard``.
_SIDE_BY_SIDE = 1 << 15
#: Of both: within a shard. Tree: searched by others. Asks: searches the trees.
BOTH, TREE, ASKS = 0, 1, 2


def _few(df: DataFrame) -> DataFrame:
    """A checkpointed table of keys, to be broadcast if its counted rows are few."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= 500_000 else df


def _large(keyed: DataFrame, shard: int) -> DataFrame:
    """(cell, there) of the keys with more rows than a shard."""
    return _few(keyed.groupBy("cell").agg(F.count("*").alias("there")).where(F.col("there") > shard))


def hits(rows: pa.Table, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius, found through the BK-trees of their shards."""
    cell, values, side = (rows.column(c).to_numpy() for c in ("cell", "fp", "side"))
    values = values.view(np.uint64)
    own = np.flatnonzero(side == BOTH)
    for a, b in bktree.links(values[own], cell[own], radius):
        yield own[a], own[b]
    if (side == TREE).any():
        yield from bktree.links(values, cell, radius, side == TREE)


def _in_shards(rows: DataFrame, find: Callable) -> DataFrame:
    """(a, b): links that ``find`` gets from the rows of whole cells; ids of one root are joined already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def links_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cell = table.column("cell").to_numpy()
            changes = cell[1:] != cell[:-1]
            several = ~(np.append(True, changes) & np.append(changes, True))
            table = table.filter(pa.array(several)).combine_chunks()
            ids, root = table.column("id").to_numpy(), table.column("root").to_numpy()
            names, roots = np.unique(root, return_inverse=True)
            joined = bktree.Joined(len(names))
            for a, b in find(table, joined, roots) if len(ids) else ():
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[a], ids[b], root[a], root[b])], ["a", "b", "ra", "rb"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= _SIDE_BY_SIDE:
                table = pa.Table.from_batches(held)
                cell = table.column("cell").to_numpy()
                # the last cell may go on in the next batch; the rows are sorted by cell
                whole = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0
                if whole:
                    yield from links_of(table.slice(0, whole))
                    held, size = table.slice(whole).to_batches(), size - whole
        if held:
            yield from links_of(pa.Table.from_batches(held))

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, ra long, rb long")


def search(keyed: DataFrame, find: Callable, shard: int | None) -> DataFrame:
    """(a, b): links between ids of rows (cell, id, root, fp, ...) of one cell, enough to keep what they connect.

    A cell of up to ``shard`` rows (None: each as it is) is searched by one task. A larger one is cut into trees of
    about that size: first every tree is searched by its own rows, which also ask its first
    tree. As a rule that joins a large group of copies; then only rows outside the cell's
    largest class so far are sent to its other trees, so the rows sent stay in proportion.
    """
    side = lambda n: F.lit(n).alias("side")
    hot = None if shard is None else _large(keyed, shard)
    if hot is None or hot.isEmpty():
        return _in_shards(keyed.select("*", side(BOTH)), find).select("a", "b")
    columns = [c for c in keyed.columns if c != "cell"]
    at = lambda tree: F.xxhash64("cell", tree).alias("cell")
    small = keyed.join(hot, "cell", "left_anti").select("cell", *columns, side(BOTH))
    cut = keyed.join(hot, "cell").withColumn("trees", F.ceil(F.col("there") / shard).cast("int"))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("id", F.lit("tree")), F.col("trees")).cast("int"))
    own = cut.select(at(F.col("mine")), *columns, side(BOTH))
    leading = cut.where("mine = 0").withColumn("to", F.explode(F.expr("sequence(1, trees - 1)")))
    leading = leading.select(at(F.col("to")), *columns, side(TREE))
    found = checkpoint(_in_shards(small.unionByName(own).unionByName(leading), find))
    member = components(found.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("now"))
    now = cut.join(member, "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now")
    counts = now.groupBy("cell", "root").agg(F.count("*").alias("n"))
    main = _few(counts.groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("classes")).where("classes > 1").drop("classes"))
    if main.isEmpty():
        return found.select("a", "b")
    still = now.join(main, "cell")
    there = still.select(at(F.col("mine")), *columns, side(TREE))
    outside = still.where("root <> main").withColumn("to", F.explode(F.expr("sequence(0, trees - 1)"))).where("`to` <> mine")
    outside = outside.select(at(F.col("to")), *columns, side(ASKS))
    more = _in_shards(there.unionByName(outside), find)
    return found.select("a", "b").unionByName(more.select("a", "b"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, radius: int = 4, blocks: int | None = None, shard: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id in the component (null ids count last). Texts of
    fewer words than ``width`` have one shingle of all their words; null, empty and blank
    texts have fingerprint zero, linked like any other. Other columns are not read; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    fps = checkpoint(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), width).alias("fp")))
    return _classes(fps, radius, blocks, shard)


def _classes(fps: DataFrame, radius: int, blocks: int | None, shard: int) -> DataFrame:
    least = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    total = fps.count()
    member = components(links(least.select("fp"), radius, blocks, shard))
    rooted = least.join(member, least["fp"] == member["node"], "left").select("fp", "least", "size", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("values"))
    moved = join_groups(rooted, smallest, "root", total, "values").select("fp", "component_id", "size")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return join_groups(fps, moved, "fp", total).select("doc_id", digits, "component_id")


# -- near copies by the similarity of whole shingle sets ---------------------------------
#: Odd multipliers of the mixings whose least hashes are the shard keys of ``near_links``.
_MIX = np.random.default_rng(8).integers(0, 1 << 63, 96, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: A key is the least hashes of so many mixings.
_ROWS = 3
#: Bytes of a sketch: of the least hash in each part of the hashes' range.
SKETCH = 128
#: Standard errors below the similarity from which a sketch is far enough to discard a pair.
_ERRORS = 5


def set_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two whole sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A byte of the least hash in each of ``SKETCH`` parts of the range; an empty part has the next one's."""
    edges = np.arange(SKETCH, dtype=np.uint64) << np.uint64(57)
    at = np.searchsorted(hashes, edges)
    return (hashes[at % len(hashes)] & np.uint64(255)).astype(np.uint8)


def _shingle_set(text: str | None, width: int) -> tuple[int, np.ndarray]:
    """The fingerprint, and the different shingle hashes in order; a text without words has the hash 0 alone."""
    parts = list(shingle_hashes(text, width)) or [np.zeros(1, np.uint64)]
    return majority(parts), np.unique(np.concatenate(parts))


def _prepared(text: Column, width: int, keys: int) -> Column:
    """Fingerprint, size and digest of the shingle set, shard keys and sketch of a text."""

    @F.arrow_udf("fp long, size int, same binary, keys array<long>, sketch binary")
    def prepare(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mix = _MIX[: keys * _ROWS, None]
        for array in texts:
            rows: list[tuple] = []
            for at in range(0, len(array), 512):
                for t in array.slice(at, 512).to_pylist():
                    fp, hashes = _shingle_set(t, width)
                    least = np.full(keys * _ROWS, np.iinfo(np.uint64).max, np.uint64)
                    for lo in range(0, len(hashes), 4096):
                        np.minimum(least, (hashes[None, lo : lo + 4096] * mix).min(axis=1), out=least)
                    least = (least.reshape(keys, _ROWS) ^ (least.reshape(keys, _ROWS) >> np.uint64(29))) * _MIX[-_ROWS:]
                    rows.append((fp, len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), least.sum(axis=1, dtype=np.uint64).view(np.int64), sketch(hashes).tobytes()))
            fps, sizes, same, least, sketches = zip(*rows, strict=True) if rows else ((),) * 5
            lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * keys, np.concatenate(least) if rows else np.zeros(0, np.int64))
            yield pa.StructArray.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(same, pa.binary()), lists, pa.array(sketches, pa.binary())], ["fp", "size", "same", "keys", "sketch"])

    return prepare(text)


def _whole_set(text: Column, width: int) -> Column:
    @F.arrow_udf("binary")
    def compute(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            got: list[bytes] = []
            for at in range(0, len(array), 512):
                got += [_shingle_set(t, width)[1].tobytes() for t in array.slice(at, 512).to_pylist()]
            yield pa.array(got, pa.binary())

    return compute(text)


def _similar(rows: pa.Table, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius whose sizes allow the similarity and whose sketches do not rule it out."""
    size = rows.column("size").to_numpy()
    fixed = rows.column("sketch").combine_chunks()
    sketches = np.frombuffer(b"".join(fixed.to_pylist()), np.uint8).reshape(len(size), SKETCH)
    for a, b in hits(rows, radius):
        small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        able = small >= similarity * large
        a, b, small = a[able], b[able], small[able]
        for lo in range(0, len(a), 1 << 15):
            x, y = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
            floor = similarity - _ERRORS * np.sqrt(similarity * (1 - similarity) / np.minimum(small[lo : lo + (1 << 15)], SKETCH))
            close = (sketches[x] == sketches[y]).mean(axis=1) >= floor
            yield x[close], y[close]


def _candidates(rows: DataFrame, similarity: float, radius: int, shard: int) -> DataFrame:
    """(a, b): links between ids whose sketches may be similar, fewest that keep what all such links connect."""

    def find(rows: pa.Table, joined: bktree.Joined, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in _similar(rows, radius, similarity):
            fewest = joined.spanning(roots[a], roots[b])
            yield a[fewest], b[fewest]

    return search(_shards(rows, "fp", "size", "sketch"), find, shard)


def _shards(rows: DataFrame, *columns: str) -> DataFrame:
    keyed = rows.select("id", "root", *columns, F.posexplode("keys").alias("n", "key"))
    return keyed.select(F.xxhash64("n", "key").alias("cell"), "id", "root", *columns)


def _exact_links(rows: DataFrame, similarity: float, radius: int, shard: int) -> DataFrame:
    """(a, b): links between ids of different roots by whole sets, enough to keep what all of them connect."""

    def find(rows: pa.Table, joined: bktree.Joined, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sets = rows.column("hashes")
        for a, b in _similar(rows, radius, similarity):
            kept = []
            for n in np.flatnonzero(joined.label[roots[a]] != joined.label[roots[b]]).tolist():
                x, y = int(a[n]), int(b[n])
                if joined.label[roots[x]] != joined.label[roots[y]]:
                    both = (np.frombuffer(sets[i].as_py(), np.uint64) for i in (x, y))
                    if set_similarity(*both) >= similarity:
                        joined.spanning(roots[[x]], roots[[y]])
                        kept.append(n)
            yield a[kept], b[kept]

    keyed = _shards(rows, "fp", "size", "sketch", "hashes")
    # nothing is left to find where all rows are joined already
    several = keyed.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell")
    return search(keyed.join(several, "cell", "left_semi"), find, shard)


def _exact(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        both = zip(a.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([set_similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in both], pa.float64())

    return compare(a, b)


def near_links(docs: DataFrame, doc_id: str, text: str, width: int, similarity: float, radius: int, keys: int, shard: int) -> DataFrame:
    """(a, b): links between ids of texts of that shingle similarity, enough to keep what they connect.

    At 0.8 fingerprints differ in about ten bits, which no runs of equal bits can find. Texts
    with one set of shingles are linked by its digest, and one of them goes on. These meet in
    shards by the least of their shingles' hashes under three mixings each; similar texts miss
    all ``keys`` shards with probability (1 - similarity ** 3) ** keys. A shard is searched
    through BK-trees of fingerprints; sizes and sketches discard what is clearly far. Links
    left are confirmed by the whole shingle sets, fetched by id. Where all links of a component
    are confirmed it is settled, as true links are among the candidates; the classes that a
    refuted link joins are searched once more, with whole sets.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = checkpoint(texts.select("id", _prepared(F.col("text"), width, keys).alias("p")).select("id", "p.*"))
    one = F.min(F.struct("id", "fp", "size", "keys", "sketch")).alias("r")
    leading = checkpoint(rows.groupBy("same").agg(one, F.count("*").alias("rows")).select("same", "rows", "r.*"))
    repeated = leading.where("rows > 1").select("same", F.col("id").alias("b"), F.col("rows").alias("n"))
    copies = join_groups(rows.select("same", F.col("id").alias("a")), repeated, "same", rows.count(), "n").where("a <> b").select("a", "b")
    rows = leading.select("id", F.col("id").alias("root"), "fp", "size", "keys", "sketch")
    found = checkpoint(_candidates(rows, similarity, radius, shard))
    if found.isEmpty():
        return copies
    ids = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # one fetch serves the pair checks and the second search; of rows that repeat an id each counts
    whole = checkpoint(texts.join(_few(ids), "id", "left_semi").select("id", _whole_set(F.col("text"), width).alias("hashes")))
    sides = (whole.select(F.col("id").alias(x), F.col("hashes").alias(f"{x}_hashes")) for x in "ab")
    pairs = found.join(next(sides), "a").join(next(sides), "b")
    judged = checkpoint(pairs.select("a", "b", _exact(F.col("a_hashes"), F.col("b_hashes")).alias("s")).groupBy("a", "b").agg((F.max("s") >= similarity).alias("held")))
    confirmed = judged.where("held").select("a", "b")
    refuted = judged.where("NOT held")
    if refuted.isEmpty():
        return copies.unionByName(confirmed)
    settled = components(confirmed).select(F.col("node").alias("id"), F.col("root").alias("settled"))
    # links not found yet lie between classes that refuted links join
    ends = refuted.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    again = _few(ends.join(settled, "id", "left").select(F.coalesce("settled", "id").alias("root")).distinct())
    rows = rows.drop("root").join(settled, "id", "left").withColumn("root", F.coalesce("settled", "id")).drop("settled")
    rows = rows.join(again, "root", "left_semi").join(whole, "id")
    return copies.unionByName(confirmed).unionByName(_exact_links(checkpoint(rows), similarity, radius, shard))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 18, keys: int = 14, shard: int = 2048) -> DataFrame:
    """The rows of docs whose id is the smallest of its component of near copies, with all their columns.

    Rows of null ids stay, as no link can name them. Null, empty and blank texts are copies of
    one another. Rows that repeat an id stay or go together. An empty table gives no rows; no
    column name clashes, as the rows travel as one struct.
    """
    known = docs.where(F.col(doc_id).isNotNull())
    member = components(near_links(known, doc_id, text, width, similarity, radius, keys, shard))
    gone = _few(member.where("node <> root").select(F.col("node").alias("gone")))
    rows = docs.select(F.col(doc_id).alias("id"), whole_rows(docs).alias("row"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
