"""The token file against the tokenizers library, and the coder against general compression."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from loomdigest.llm import queries, rangecoder, token_file

FILE = queries.public("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def library(texts):
    t = Tokenizer.from_file(FILE)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def same(texts):
    ids, n = token_file.Encoder(FILE, 1)(pa.array(texts, pa.string()))
    assert [part.tolist() for part in np.split(ids, np.cumsum(n)[:-1])] == library(texts)


def test_encoder_equals_the_library_on_documents():
    same(pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist())


def test_encoder_equals_the_library_on_odd_texts():
    rng = np.random.default_rng(11)
    odd = list("ab Z.,!|\t\n\r\x0b\x0c\x00\x1f\x85\xa0ßŸÉéİıKÅﬁ½²٣日本🎉ǅΣσς'’") + ["́", "​", "　", " ", "'s", "'LL", "<|endoftext|>", "</w>", "don't", "  ", "Ça", "...", "naïve"]
    texts = ["".join(rng.choice(odd, rng.integers(0, 30))) for _ in range(6000)]
    same([*texts, None, "", "x" * 5000, "é" * 3000 + " " + "." * 3000])


def test_encoder_starts_its_memory_anew():
    encoder = token_file.Encoder(FILE, 1, remember=20)
    for text in ("one two three four", "five Six, seven!", "one two three four"):
        ids, _ = encoder(pa.array([text]))
        assert ids.tolist() == library([text])[0]


def test_documents_across_runs_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 40)), " ".join(rng.choice(["Alpha", "beta,", "gamma", "日本", "x"], int(n)))) for n in (0, 1, 3000, 20, 5000, 9000, 30, 4000)]
    rows += [(None, "first"), (3, None), (3, ""), rows[2]]
    df = spark.createDataFrame(rows, SCHEMA)
    path = token_file.fresh_path(spark)
    token_file.write(df, path, FILE, chunk=4096)
    got = sorted(map(tuple, token_file.summary(spark, path, chunk=4096).collect()), key=lambda r: r[1])
    want = sorted((-1 if i is None else i, np.array(ids, "<u4").tobytes()) for (i, _), ids in zip(rows, library([r[1] for r in rows]), strict=True))
    assert sorted((-1 if i is None else i, n * 4, crc) for i, _, n, crc in got) == sorted((i, len(b), zlib.crc32(b)) for i, b in want)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert [-1 if r[0] is None else r[0] for r in got] == [i for i, _ in want]
    whole = token_file.read(spark, path, chunk=4096).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in whole) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in whole)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, part int, kind string")
    for rows, n in ((df, 1), (df.limit(0), 0)):
        path = token_file.fresh_path(spark)
        token_file.write(rows, path, FILE)
        assert token_file.summary(spark, path).count() == token_file.read(spark, path).count() == n


def test_coder_is_smaller_than_general_compression():
    """About 1 byte an id on the documents, with the prior; zlib over 16-bit ids takes over 1.1."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    ids, _ = token_file.Encoder(FILE, 1)(pa.array(texts))
    prior, blocks = rangecoder.pack(ids, token_file.BLOCK)
    assert (rangecoder.unpack(prior, blocks) == ids).all()
    ours = len(prior) + sum(len(b[2]) for b in blocks)
    assert ours < 0.95 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    assert ours < 1.1 * len(ids)


def test_a_changed_block_is_noticed():
    ids = np.random.default_rng(1).integers(0, 900, 9000)
    prior, blocks = rangecoder.pack(ids, 1024)
    n, crc, payload = blocks[2]
    bent = bytes([payload[0] ^ 1]) + payload[1:]
    with pytest.raises(ValueError):
        rangecoder.unpack(prior, [(n, crc, bent)])


@pytest.mark.parametrize("kinds, n", [(1, 9), (700, 1), (700, 0), (700, 1 << 22), (90_000, 1 << 21), (3, 1 << 22)])
def test_followers_are_counted_over_all_pairs_of_a_run(kinds, n):
    """Against a plain count: runs of one id, of none, long ones, and with more ids than 16 bits tell apart."""
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, kinds, n) * rng.random(n) ** 2).astype(np.uint32) * 2 + 5
    if kinds == 3:
        ids = np.tile(np.array([9, 4, 9, 7], np.uint32), n // 4)  # even places hold one id only
    prior, _ = rangecoder.Prior.of(ids)
    met, best = {}, {}
    for (a, b), k in sorted(Counter(zip(ids[:-1].tolist(), ids[1:].tolist())).items()):
        met[a] = met.get(a, 0) + k
        if k > best.get(a, (0, 0))[0]:
            best[a] = k, b
    want = [(best[a][1], min(3, 6 * best[a][0] // met[a])) if a in met else (prior.ids[0], 0) for a in prior.ids.tolist()]
    assert [(a, s) for a, s in zip(prior.ids.take(prior.follower).tolist(), prior.sure.tolist(), strict=True)] == want
