"""Token-id files: whole texts as ids, coded in independent checksummed blocks.

The file is a Parquet folder in three parts. Blocks hold at most ``BLOCK`` ids each: part
(place of the range of ids it belongs to), turn (its place there), n_ids, crc32 of the ids,
and the range-coded payload. Priors are the coder's tables of each run of blocks, with a
crc32 of their own, under the turn of the run's first block. Documents stand in the same
order: part, turn, doc_id, n_ids. Parts follow ascending doc_id, so parts and blocks in turn
are the corpus in ascending doc_id order. Spark's committer writes all, so lost executors
leave no halves.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rangecoder
from .common import checkpoint, resident, small_batches

BLOCK = 4096
#: Latin-1 letters: lower-casing is all that the normaliser does to these, and the word cut leaves
#: them whole and cuts before the marks.
_LETTERS, _MARKS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+"), ".,;:!?*#$%&|"
#: Ids of a run of blocks, coded side by side in a task; bounds its memory.
CHUNK = BLOCK * 2048


class Encoder:
    """The tokenizers library over whole texts.

    The tokenizer cuts at white space before it merges, so a text's ids are those of its
    runs between ASCII blanks and line ends. Arrow cuts a batch into runs and numbers the
    different ones; each of these is looked up once, by its word and the marks after it. New
    words go through the library's merges, other new runs through all its steps. Words are
    remembered; past ``remember`` letters the memory starts anew. ``splits`` is false for a
    tokenizer without that cut; then each text is encoded at once.
    """

    def __init__(self, file: str, end_id: int, remember: int = 14_000_000, splits: bool = True):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end, self.remember, self.splits = Tokenizer.from_file(file), end_id, remember, splits
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known: dict[str, bytes] = {}
        self.letters = 0
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {i: spell.pre_tokenize_str(chr(i))[0][0] for i in range(256) if chr(i).isalpha()}

    def _ids(self, runs: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each run."""
        if self.letters > self.remember:  # common words are soon met again
            self.known.clear()
            self.letters = 0
        known, letters, merges, spelled, packed = self.known, _LETTERS.fullmatch, self.tokenizer.model.tokenize, self.spelled, array
        out, others = list(map(known.get, runs)), {}
        missing = [n for n, got in enumerate(out) if got is None]
        words = [runs[n].rstrip(_MARKS) for n in missing]
        lowers = [w.lower() for w in words]
        for n, word, lower, ids in zip(missing, words, lowers, list(map(known.get, lowers)), strict=True):
            run = runs[n]
            if ids is None:
                ids = known.get(lower)  # met since, in this batch
            if ids is None:
                if letters(word) is None:
                    others[run] = b""
                    continue
                ids = known[lower] = packed("I", [t.id for t in merges(lower.translate(spelled))]).tobytes()
                self.letters += len(lower) + 8
            if len(word) < len(run):
                marks = run[len(word) :]
                after = known.get(marks)
                if after is None:
                    after = known[marks] = packed("I", self.tokenizer.encode(marks, add_special_tokens=False).ids).tobytes()
                    self.letters += len(marks) + 8
                ids += after
            out[n] = ids
        if others:
            others = dict(zip(others, self.tokenizer.encode_batch(list(others), add_special_tokens=False), strict=True))
            out = [packed("I", others[r].ids).tobytes() if got is None else got for r, got in zip(runs, out, strict=True)]
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), each with the end id, one after another; and each text's number of ids."""
        texts = pc.fill_null(texts, "")
        if not self.splits:
            coded = [np.array([*e.ids, self.end], np.uint32) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(coded) if coded else np.zeros(0, np.uint32), np.array(list(map(len, coded)), np.int64)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        runs = cut.flatten().dictionary_encode()
        ids = self._ids(runs.dictionary.to_numpy(zero_copy_only=False).tolist())  # a sixth of to_pylist's time
        size = np.array([*map(len, ids), 4]) >> 2  # the end id is one more run
        pool = np.concatenate([np.frombuffer(b"".join(ids), np.uint32), np.array([self.end], np.uint32)])
        begins = np.cumsum(size) - size
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        run = np.insert(runs.indices.to_numpy(), ends, len(ids))
        sizes = size.take(run)
        after = np.cumsum(sizes)
        at = np.repeat((begins.take(run) - after + sizes).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        last = after[ends + np.arange(len(ends))] if len(ends) else after
        return pool.take(at), np.diff(last, prepend=0)


def _encoder(file: str, end_id: int, splits: bool) -> Encoder:
    return resident(("token_file", file, end_id, splits), lambda: Encoder(file, end_id, splits=splits))


_SCHEMA = "part int, turn long, doc_id long, n_ids long, crc32 long, payload binary, kind string"
_ARROW = pa.schema([("part", pa.int32()), ("turn", pa.int64()), ("doc_id", pa.int64()), ("n_ids", pa.int64()), ("crc32", pa.int64()), ("payload", pa.binary()), ("kind", pa.string())])


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", splits: bool = True, parts: int | None = None, chunk: int = CHUNK) -> None:
    """Write the file to ``path``/blocks and ``path``/documents.

    ``chunk`` ids, whole blocks, make a run. Ids are 64-bit integers; a null id comes first. Null texts count as empty and hold the
    end id alone. Rows that share an id follow one another, by a hash of their texts where
    they are many, else by text. Texts of any length are encoded whole; other columns are not
    read. An empty table writes a file without blocks.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = parts or _parts(docs)
    ordered = narrow.repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer_file, end_id, splits)
        held: list[np.ndarray] = []
        size = turn = block = 0

        def rows(kind: list, turns, doc_ids, n_ids, crcs, payloads) -> pa.RecordBatch:
            columns = ([part] * len(n_ids), turns, doc_ids, n_ids, crcs, payloads, kind * len(n_ids))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        def run_of(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal block
            prior, blocks = rangecoder.pack(ids, BLOCK)
            lone = [None] * len(blocks)
            got = rows(["blocks"], range(block, block + len(blocks)), lone, *zip(*blocks, strict=True))
            first = rows(["priors"], [block], [None], [len(ids)], [zlib.crc32(prior)], [prior])
            block += len(blocks)
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(first.columns, got.columns, strict=True)], schema=_ARROW)

        for piece in _slices(batches):
            ids, n = encoder(piece.column(1))
            none = [None] * len(n)
            yield rows(["documents"], range(turn, turn + len(n)), piece.column(0), n, none, none)
            turn += len(n)
            held.append(ids)
            size += len(ids)
            if size >= chunk:
                data = np.concatenate(held)
                whole = len(data) // chunk * chunk
                for at in range(0, whole, chunk):
                    yield run_of(data[at : at + chunk])
                held, size = [data[whole:]], len(data) - whole
        if size:
            yield run_of(np.concatenate(held))

    ordered.mapInArrow(code, _SCHEMA).write.partitionBy("kind").parquet(path)


def _parts(docs: DataFrame) -> int:
    """Parts of about 16 MB by the estimate of the plan's size, and no fewer than shuffles have."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, size >> 24))


def _slices(batches: Iterator[pa.RecordBatch], letters: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about so many bytes of text, at least one row at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = before[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(before, done + letters - size, side="right")))
            held.append(batch.slice(at, end - at))
            size += int(before[end - 1] - done)
            at = end
            if size >= letters or at < batch.num_rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def read(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian bytes) of each document in the file.

    A task decodes a run of blocks of one part; a document that crosses runs is put together
    from their pieces.
    """
    return _documents(spark, path, True, chunk)


def summary(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the decoded blocks, without the ids."""
    return _documents(spark, path, False, chunk)


def _documents(spark: SparkSession, path: str, with_ids: bool, chunk: int) -> DataFrame:
    written = spark.read.schema(_SCHEMA).parquet(path)
    # the prior of a run goes before its blocks
    block = F.when(F.col("kind") == "priors", -1).otherwise(F.col("turn"))
    blocks = written.where("kind <> 'documents'").select("part", "turn", block.alias("block"), "n_ids", "crc32", "payload")
    per_run = chunk // BLOCK
    documents = written.where("kind = 'documents'").select("part", "turn", "doc_id", F.col("n_ids").alias("n_tokens"))
    totals = documents.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = checkpoint(totals.select("part", before.alias("part_start")))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    placed = documents.withColumn("inside", F.coalesce(own, F.lit(0)))
    placed = checkpoint(placed.join(starts, "part").withColumn("start", F.col("part_start") + F.col("inside")).drop("part_start"))
    # the pieces of each document in each run of blocks
    first, last = F.floor(F.col("inside") / chunk), F.floor((F.col("inside") + F.col("n_tokens") - 1) / chunk)
    pieces = placed.withColumn("run", F.explode(F.sequence(first, last)))
    runs = blocks.withColumn("run", F.floor(F.col("turn") / per_run))

    def cut(key, coded: pa.Table, docs: pa.Table) -> pa.Table:
        order = np.argsort(coded.column("block").to_numpy())
        n, crc, payload = (coded.column(c).to_pylist() for c in ("n_ids", "crc32", "payload"))
        if zlib.crc32(payload[order[0]]) != crc[order[0]]:
            raise ValueError("a prior does not match its checksum")
        ids = rangecoder.unpack(payload[order[0]], [(n[i], crc[i], payload[i]) for i in order[1:]])
        base = key[1].as_py() * chunk
        a = np.maximum(docs.column("inside").to_numpy() - base, 0)
        b = np.minimum(docs.column("inside").to_numpy() + docs.column("n_tokens").to_numpy() - base, len(ids))
        parts = [ids[x:y].tobytes() for x, y in zip(a, b, strict=True)]
        whole = docs.column("n_tokens").to_numpy() == b - a
        return pa.table([docs.column("doc_id"), docs.column("start"), docs.column("n_tokens"), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts if with_ids else [None] * len(parts), pa.binary()), pa.array(whole), pa.array([key[1].as_py()] * len(parts), pa.int64()), pa.array(list(map(len, parts)), pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids", "whole", "run", "n_bytes"])

    found = runs.groupBy("part", "run").cogroup(pieces.groupBy("part", "run")).applyInArrow(cut, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary, whole boolean, run long, n_bytes long")

    if not with_ids:
        # a piece's crc and length are all that its neighbours need, so blocks are decoded once
        @F.arrow_udf("long")
        def combined(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for array in arrays:
                yield pa.array([join_crcs([(p["crc"], p["n"]) for p in parts]) for parts in array.to_pylist()], pa.int64())

        each = F.array_sort(F.collect_list(F.struct("run", F.col("ids_crc32").alias("crc"), F.col("n_bytes").alias("n"))))
        grouped = found.groupBy("start", "doc_id", "n_tokens").agg(each.alias("p"))
        return grouped.select("doc_id", "start", "n_tokens", combined("p").alias("ids_crc32"))
    whole = checkpoint(found)
    # a document in several runs: few, as a run is long; each is shorter than memory as its text was
    split = whole.where("not whole").groupBy("start", "doc_id", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("run", "ids"))).alias("p"))

    @F.arrow_udf("long")
    def crc(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.array([zlib.crc32(b) for b in array.to_pylist()], pa.int64())

    columns = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    split = split.withColumn("ids", F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"])))
    joined = split.withColumn("ids_crc32", crc("ids"))
    return whole.where("whole").select(columns).unionByName(joined.select(columns))


_CRC_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of the crc, the highest power in the lowest bit."""
    product = 0
    while a:
        if a & 1 << 31:
            product ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (_CRC_POLYNOMIAL if b & 1 else 0)
    return product


def join_crcs(parts: list[tuple[int, int]]) -> int:
    """The crc32 of pieces in a row, from (crc32, bytes) of each: what comes before moves up by a piece's length."""
    crc = 0
    for own, n in parts:
        shift, power = 1 << 31, 1 << 23  # 1, and the power for one byte
        while crc and n:
            shift = _times(shift, power) if n & 1 else shift
            power = _times(power, power)
            n >>= 1
        crc = _times(shift, crc) ^ own if crc else own
    return crc


def fresh_path(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        checkpoint(spark.range(1))
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/tokens-{uuid.uuid4().hex}"
