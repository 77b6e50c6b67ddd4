"""Repeated and null ids, clashing names, empty tables and ties, stage by stage; and the pipeline against plain Python."""

import hashlib
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomdigest.llm import exact_dedup, langid, mixing, pieces, quality, queries, simhash

NAMES = "at row h bucket source before turn hash maybe sha tie id gone fp size same keys root __at __hash __maybe __turn __keep".split()
MODEL = queries.public("piece_bpe_32k.model")


def clashing(spark, rows):
    """rows (doc_id, text, source) with a column of every name that an operator might use itself."""
    extra = [n for n in NAMES if n != "source"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in extra)
    return spark.createDataFrame([(*r, *[f"{n}{i}" for n in extra]) for i, r in enumerate(rows)], schema)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_mix(rows):
    """(row, size, taken) of rows (doc_id, text, source) by the rules in plain Python."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words_of(text))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        rate = left / sum(weight[s] for s in free)
        over = [s for s in free if rate * weight[s] >= 2 * sizes[s]]
        for s in over or free:
            target[s] = 2.0 * sizes[s] if over else rate * weight[s]
        left -= sum(target[s] for s in over)
        free = free - set(over) if over else set()
    out, before = [], dict.fromkeys(order, 0)

    def key(r):
        return hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest(), -1 if r[0] is None else r[0], len(words_of(r[1]))

    for r in sorted(rows, key=key):
        n, s = len(words_of(r[1])), r[2]
        whole = math.floor(target[s] / max(1, sizes[s]))
        once_more = before[s] + n / 2 <= target[s] - whole * sizes[s]
        out.append((r, n, n * min(2, whole + once_more)))
        before[s] += n
    return out


MIX = [(None, f"null {i} " + "w " * i, "a") for i in range(6)] + [(5, f"same id {i}", "b") for i in range(4)] + [(10 + i, "x " * (i * 7 % 11), [None, "a", "c", "ü"][i % 4]) for i in range(30)] + [(99, None, "a"), (98, "", None), (5, "same id 0", "b")]


def test_mixed_rows_are_what_place_takes(spark):
    df = clashing(spark, MIX)
    plain = plain_mix(MIX)
    placed = mixing.place(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r.doc_id, r["size"], r.taken) for r in placed], key=key) == sorted([(r[0], n, t) for r, n, t in plain], key=key)
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    got = [(r.doc_id, r.text, r.source) for r in mixed.collect()]
    want = [r for r, n, taken in plain for _ in range(taken // n if n else 1)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert got == [(r.doc_id, r.text, r.source) for r in mixing.mixed(df).collect()]
    assert mixing.mixed(df.limit(0)).count() == mixing.place(df.limit(0)).count() == 0


def test_positions_are_sorted_and_follow_the_curriculum(spark):
    rows = [(i, "w " * 20, f"s{i % 3}") for i in range(600)]
    # no source is used twice, so positions spread over the whole time
    placed = mixing.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string"), total_share=0.9, weights=(1, 1, 1)).collect()
    at = [r.position for r in placed if r.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    early = [sum(1 for r in placed if r.slope == b and r.position is not None and r.position < 0.5) / sum(1 for r in placed if r.slope == b and r.position is not None) for b in (-1.0, 0.0, 1.0)]
    assert early[0] > early[1] > early[2]


def test_exact_dedup_keeps_one_row_whatever_repeats(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (None, "a", "z"), (2, "b", "x"), (2, "b", "x"), (None, "c", "x"), (None, "c", "x"), (3, None, "x"), (4, "", "y"), (7, "alone", "x")] + [(50, "copy", "x")] * 700 + [(51 + i, "copy", "x") for i in range(900)]
    df = clashing(spark, rows)
    got = exact_dedup.dedup(df)
    assert got.columns == df.columns
    first = sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in got.collect())
    assert first == [("", 4), ("a", 1), ("alone", 7), ("b", 2), ("c", -1), ("copy", 950)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, exact_dedup.dedup(df.repartition(3)).collect()), key=repr)
    found = exact_dedup.classes(df).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == 6
    assert all(r.group_size == 1600 and r.keep_id == 950 for r in found if r.text_sha256 == hashlib.sha256(b"copy").hexdigest())
    for small in (exact_dedup.classes(df, max_slots=1 << 18), exact_dedup.classes(df.repartition(5))):
        assert sorted((r.keep_id or 0, r.kept, r.text_sha256) for r in small.collect()) == sorted((r.keep_id or 0, r.kept, r.text_sha256) for r in found)
    assert exact_dedup.dedup(df.limit(0)).count() == 0


def test_near_dedup_with_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text, "x"), (3, text + " more", "x"), (None, text, "x"), (9, None, "x"), (8, "", "x"), (7, "  ", "x"), (6, "two words", "x"), (6, text[::-1], "x"), (4, "two\twords", "x")]
    df = clashing(spark, rows)
    got = simhash.near_dedup(df)
    assert got.columns == df.columns
    # row 6 goes as a whole: one of its texts is a copy of row 4's
    assert sorted(((r.doc_id or -1), r.text) for r in got.collect()) == [(-1, text), (3, text + " more"), (4, "two\twords"), (7, "  ")]
    assert simhash.near_dedup(df.limit(0)).count() == 0 and simhash.near_dedup(df.limit(1)).count() == 1


def shingles(text, n=5):
    words = [w.lower() for w in words_of(text)]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def test_near_dedup_of_large_groups_and_small_shards(spark):
    """More copies than a shard holds: chains of near copies must stay one group, others apart."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for n in range(150):  # each differs from the base in a few places
        words = list(base)
        for at in rng.choice(300, 3, replace=False):
            words[at] = f"c{n}x{at}"
        rows.append((n, " ".join(words)))
    for n in range(60):  # only a shared passage
        rows.append((1000 + n, " ".join(base[:120] + [f"own{n}w{i}" for i in range(180)])))
    sets = {i: shingles(t) for i, t in rows}
    gone = {i for i, _ in rows if any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j, _ in rows)}
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shard=20).collect()}
    assert kept >= {i for i, _ in rows} - gone - set(range(150)) and 0 in kept
    assert {i for i in kept if i < 150} == {0} and {i for i in kept if i >= 1000} == set(range(1000, 1060))


def plain_fingerprint(text, n):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)]
    whole = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode("utf-8", "surrogatepass"), seed=42).intdigest() for s in whole]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    odd = list("AbÉß  \t\n\x0b\x0c\r\x1c\x85\xa0　İ.") + ["word", "Word"]
    texts = ["".join(rng.choice(odd, rng.integers(0, 40))) for _ in range(300)] + [None, "", "one", "x " * 70000]
    for width in (4, 5):
        assert [simhash.fingerprint(t, width) for t in texts] == [plain_fingerprint(t, width) for t in texts]


def test_pieces_equal_the_library_on_odd_texts():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    c = pieces.PieceCoder(MODEL, remember=50, pairs=200)
    rng = np.random.default_rng(12)
    odd = list("abcdehilnorst  \n\t.,'") + ["▁", "é", "日", "🎉", "́", "\x00", "<s>", "</s>", "<unk>", "<0x41>", "ing", "tion", "the", "ﬁ", "\xa0", "　"]
    for text in ["".join(rng.choice(odd, rng.integers(0, 60))) for _ in range(3000)] + ["a" * 3000, "ab" * 2000, " " * 500, "日" * 900, "thethe" * 500]:
        ids = m.encode(text)
        assert c.encode(text) == ids and c.decode(ids) == m.decode(ids), text[:60]
        want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest()
        assert c.digest(text) == (len(ids), *want), text[:60]


def test_a_model_that_changes_texts_is_refused():
    class Changing:
        def normalize(self, text):
            return "▁" + " ".join(text.split()).replace(" ", "▁")

    with pytest.raises(ValueError):
        pieces._check(Changing())


def test_segmentations_are_summed():
    model = langid.fit({"x": {"abcab": 3, "b": 2, "cabc": 1, "日本": 2}, "y": {"c": 5, "bca": 2, "abc" * 25: 2}}, ["a", "b", "ab", "abc", "bc", "c", "▁", "▁a", "cab", "日本", "X", "1a"])

    def chance(piece, k):
        node = int(model.trie.first[model.alphabet.get(piece[0], len(model.alphabet) + 1)])
        for c in piece[1:]:
            node = int(model.trie.step(np.array([node]), np.array([model.alphabet.get(c, len(model.alphabet) + 1)]))[0]) if node else 0
        return float(model.prob[node, k]) if node else 0.0

    def every(word, k):
        if not word:
            return 1.0
        return sum(chance(word[:n], k) * every(word[n:], k) for n in range(1, min(len(word), model.longest) + 1))

    for word in ["abcab", "zab", "日本c", "b", "é", "abcabcab"]:
        assert np.allclose(model.score([word])[0], [math.log(every("▁" + word, k)) for k in (0, 1)])
    assert np.isfinite(model.score(["z" * 5000, "ab" * 3000])).all()
    # one more round of fitting long words gives what short ones in logarithms give
    assert langid.letter_words("½ ² abc½d Ⅷ x_y a1b") == ["abc", "d", "x", "y", "a", "b"]


def test_long_words_are_fitted_like_short_ones(monkeypatch):
    counts, parts = {"x": {"abcab": 3, "cabcabc": 2, "bbbb": 1}}, ["a", "b", "ab", "abc", "bc", "c", "▁a"]
    plain = langid.fit(counts, parts).prob
    monkeypatch.setattr(langid, "_PLAIN", 1)
    assert np.allclose(langid.fit(counts, parts).prob, plain)


def test_densities_equal_direct_ones():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)), rng.integers(0, 2, 200)
    x[y == 1] = x[y == 1] * 1.7 + 1
    model = quality.fit(x, y, shrink=0.2)
    pooled = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in (0, 1)) / 198
    logs = []
    for c in (0, 1):
        own = x[y == c]
        s = 0.8 * np.cov(own.T) + 0.2 * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + 1e-4 * np.diag(pooled).mean() * np.eye(5)
        d = x - own.mean(0)
        logs.append(np.log((len(own) + 1) / 202) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_classifiers_on_empty_and_unlabelled_tables(spark):
    df = clashing(spark, [(None, "some words", "x"), (3, None, "x"), (3, "more words", "x")])
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    for docs in (df, df.limit(0)):
        for known in (labels, labels.limit(0)):
            assert quality.score(docs, quality.train(docs, known, F.lit(True))).count() == docs.count()
    tagged = df.withColumn("lang", F.lit("en"))
    for docs in (tagged, tagged.limit(0), tagged.withColumn("lang", F.lit(None).cast("string"))):
        model = langid.train(docs, ["▁some", "wor", "ds"], F.lit(True))
        assert langid.identify(docs, model).count() == docs.count()


def test_pipeline_equals_plain_python(spark, tmp_path):
    """All stages on a small table with copies, near copies on both sides of 0.8, repeated ids, odd rows."""
    import sentencepiece

    rng = np.random.default_rng(21)
    vocabulary = ["".join(rng.choice(list("abcdefghijkl"), int(rng.integers(2, 8)))) for _ in range(400)]
    rows = []
    for n in range(60):
        words = [f"{w}{n % 7}" if i % 9 == 0 else w for i, w in enumerate(rng.choice(vocabulary, 150))]
        rows.append([n * 10, " ".join(words)])
        for k, changes in enumerate((0, 2, 4, 9)[: n % 5]):
            copy = list(words)
            for at in rng.choice(np.arange(10, 140, 6), changes, replace=False):
                copy[at] += "q"
            rows.append([n * 10 + k + 1, " ".join(copy)])
    rows += [[2000, None], [2001, ""], [2002, "123 456 ½"], [2003, "日本語 テスト"], [2004, "short one"], [2005, "short  one"], [2006, "short one"], [30, rows[0][1]]]
    rows = [(i, t, ["en", "fr", None][k % 3], ["s1", "s2", "s3", None][k % 4], len(t or "")) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for r in kept:
        best[r[1]] = max(best.get(r[1], r), r, key=lambda x: x[0])
    kept = list(best.values())
    sets, group = [shingles(r[1]) for r in kept], list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if group[i] != group[j] and (kept[i][0] == kept[j][0] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(kept[i][0] for i in range(len(kept)) if group[i] == g) for g in group}
    kept = [r for i, r in enumerate(kept) if r[0] == least[group[i]]]
    assert 60 < len(kept) < 150
    mixed = [r[:2] for r, n, taken in plain_mix([(r[0], r[1], r[3]) for r in kept]) for _ in range(taken // n if n else 1)]
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, text in mixed:
        ids = m.encode(text)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for table in (docs.limit(0), docs.limit(3)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, "/root/testdata/sf0.001").columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, table, "/root/testdata/sf0.001").count() == table.count()
