import hashlib

import numpy as np
import pytest
from oracle_check import differences
from pyspark.sql import functions as F

from loomdigest.llm import exact_dedup, langid, mixing, pieces, quality, queries, rangecoder, simhash, token_file, topk, toxicity
from loomdigest.llm.common import remainder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, __odd string"
ROWS = [(1, None, None, None, "x"), (2, "", "en", "a", None), (3, "", "en", "a", None), (4, "One two  three\nfour", "en", "b", "x"), (4, "One two  three\nfour", "en", "b", "x"), (None, "one", None, "a", None), (6, "long " * 30000, "en", "a", None), (7, "日本語 テスト é", "ja", "b", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_queries_match_sql(spark):
    assert differences(spark, SF, queries.SQL.keys()) == {}


def test_exact_dedup_edges(spark, docs):
    got = {(r.doc_id, r.kept): r for r in exact_dedup.classes(docs).collect()}
    assert sum(r.kept for r in exact_dedup.classes(docs).collect()) == exact_dedup.dedup(docs).count() == 5
    assert got[3, True].group_size == 3 and got[1, False].keep_id == 3
    assert exact_dedup.classes(docs.limit(0)).count() == 0


def test_range_coder_round_trip():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, int), np.array([9]), rng.integers(0, 49408, 9000), np.tile(rng.integers(0, 49408, 40), 300), np.full(5000, 7)):
        prior, packed = rangecoder.pack(ids, 1024)
        assert (rangecoder.unpack(prior, packed) == ids).all()
        for n in range(0, len(packed), 3):  # with the prior each block decodes by itself
            assert (rangecoder.unpack(prior, [packed[n]]) == ids[n * 1024 : n * 1024 + 1024]).all()
    n, crc, payload = packed[0]
    with pytest.raises(ValueError):
        rangecoder.unpack(prior, [(n, crc ^ 1, payload)])


def test_token_file_matches_library(spark, docs):
    import zlib

    from tokenizers import Tokenizer

    file = queries.public("word_bpe_49k.json")
    path = token_file.fresh_path(spark)
    token_file.write(docs, path, file)
    t = Tokenizer.from_file(file)
    want, start = [], 0
    for i, text in sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] or 0, r[1])):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_file.summary(spark, path).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in token_file.read(spark, path).collect())


def test_pieces_match_library(spark, docs):
    import sentencepiece

    file = queries.public("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=file)
    c = pieces.PieceCoder(file)
    for text in ["", " ", "  a \n b ", "a\0b", "▁a", "\n\n", "<s>x</s>", "ﬁ ½ 日本 🎉", "aaaa" * 400, "it's 12,345"]:
        assert c.encode(text) == m.encode(text) and c.decode(c.encode(text)) == m.decode(m.encode(text))
    for r in pieces.digests(docs, file).collect():
        assert r.doc_id != 6 or r.ids_sha256 == hashlib.sha256(",".join(map(str, m.encode("long " * 30000))).encode()).hexdigest()


def test_simhash_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40).tolist()
    values = sorted({v ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for v in base for k in (0, 2, 4, 6)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for shard in (4096, 3):
        found = [(r.a, r.b) for r in simhash.links(df, 4, 6, shard).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in found)

        def groups(pairs):
            of = {v: {v} for v in values}
            for a, b in pairs:
                if of[a] is not of[b]:
                    of[a] |= of[b]
                    for v in of[b]:
                        of[v] = of[a]
            return sorted(map(sorted, {id(g): g for g in of.values()}.values()))

        assert groups(found) == groups([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])


def test_simhash_edges(spark, docs):
    got = {r.doc_id: r for r in simhash.classes(docs, width=4).collect()}
    assert got[1].fingerprint == "0" * 16 and got[2].component_id == 1 and got[4].component_id == 4
    assert simhash.classes(docs.limit(0)).count() == 0


def test_near_dedup_catches_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:100], "changed", *words[101:]])), (3, " ".join(words[::-1])), (4, " ".join(words[:100]))]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 200 and got["c"] == 20 and got[None] == 100 and abs(got["b"] - 1420) < 1e-6


def test_mixing_edges(spark, docs):
    rows = mixing.schedule(docs).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 2 * r.size for r in rows)
    assert rows == mixing.schedule(docs).collect()
    assert mixing.schedule(docs.limit(0)).count() == 0


def test_top_k_ties_and_unusable(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (50, [-1.0]), (7, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 65536), (0, 2, 2, 65536), (50, 1, 7, -32768), (50, 2, 0, -65536)]


def test_top_k_equals_brute_force(spark):
    """Many shards and batches, repeated ids, ties, short and empty vectors; columns with clashing names."""
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.integers(-3, 4, int(rng.integers(0, 5))).astype(float).tolist(), int(i) % 7) for i in rng.integers(0, 120, 300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int").repartition(7)
    whole = [(i, [256 * int(x) for x in v]) for i, v, _ in rows]

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    want = []
    for q in sorted({i for i, _ in whole if i % 3 == 0}):
        own = min(v for i, v in whole if i == q)
        others = list(whole)
        others.remove((q, own))
        best = sorted((-dot(own, v), i) for i, v in others)[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for shard in (20, 1000):
        got = topk.top_k(df, F.col("vec_id") % 3 == 0, 4, block=4, shard=shard, queries=5).collect()
        assert sorted(map(tuple, got)) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 3 == 0).count() == 0


def test_classifiers_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = langid.train(docs, queries.vocabulary_pieces(queries.public("piece_bpe_32k.model")), remainder(F.col("doc_id"), 5) != 0)
    found = langid.identify(docs, model).join(docs, "doc_id").where(remainder(F.col("doc_id"), 5) == 0)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    q = quality.score(docs, quality.train(docs, labels, remainder(F.col("doc_id"), 4) != 2)).join(labels, "doc_id").where(remainder(F.col("doc_id"), 4) == 2)
    assert q.agg(F.avg(((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_classifiers_on_odd_rows(spark, docs):
    model = langid.train(docs, ["▁one", "on", "e"], F.lit(True))
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert found[1].lang_pred == found[2].lang_pred == "und"
    net = toxicity.fit(["a bad word", "a good word"] * 8, [1, 0] * 8)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, net).collect())
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, None)], "doc_id long, quality int")
    assert quality.score(docs, quality.train(docs, labels, F.lit(True))).count() == len(ROWS)


def test_toxicity_finds_late_words():
    rng = np.random.default_rng(1)
    clean = [" ".join(f"w{i}" for i in rng.integers(0, 300, 90)) for _ in range(120)]
    toxic = [" ".join([*t.split()[:80], "vile", *t.split()[80:]]) for t in clean[:60]]
    net = toxicity.fit(clean[:60] + toxic[:50], [0] * 60 + [1] * 50)
    s = toxicity.Scorer(net)
    assert np.mean(np.array(s(toxic[50:])) > 0.5) > 0.8 and np.mean(np.array(s(clean[60:])) < 0.5) > 0.8
