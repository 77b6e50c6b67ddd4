"""The toxicity network against numeric gradients, a plain scorer, and without its letter pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdigest.llm import toxicity
from loomdigest.llm.common import remainder


def small(rng, kind=np.float64):
    d = toxicity.WORD_DIM + 1 + toxicity.PAIR_DIM
    p = {"v": rng.normal(size=2 * toxicity.H), "w": rng.normal(size=2 * toxicity.H), "c": rng.normal(size=1)}
    for s in "fb":
        p |= {"W" + s: rng.normal(size=(d, 3 * toxicity.H)) * 0.4, "b" + s: rng.normal(size=3 * toxicity.H) * 0.1, "U" + s: rng.normal(size=(toxicity.H, 3 * toxicity.H)) * 0.4}
    return {k: v.astype(kind) for k, v in p.items()}


def test_gradients_are_the_numeric_ones():
    rng = np.random.default_rng(4)
    p = small(rng)
    x = rng.normal(size=(3, 5, toxicity.WORD_DIM + 1 + toxicity.PAIR_DIM))
    real = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    x *= real[:, :, None]
    y = np.array([1.0, 0.0, 1.0])
    _, grads, dx = toxicity.gradients(p, x, real, y)

    def slope(array, at):
        kept, step = array[at], 1e-6
        array[at] = kept + step
        up = toxicity.gradients(p, x, real, y)[0]
        array[at] = kept - step
        down = toxicity.gradients(p, x, real, y)[0]
        array[at] = kept
        return (up - down) / (2 * step)

    for name, array in p.items():
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in array.shape)
            assert slope(array, at) == pytest.approx(grads[name][at], abs=1e-7), name
    for at in ((0, 2, 0), (0, 4, 12), (1, 1, 7), (2, 0, 6)):
        assert slope(x, at) == pytest.approx(dx[at], abs=1e-7)


def plain_score(net, text):
    """One window at a time, one word at a time."""

    def logistic(v):
        return 1 / (1 + np.exp(-v))

    words = toxicity.tokens(text)
    best = -np.inf
    for start in toxicity.windows(len(words)):
        part = words[start : start + toxicity.WINDOW]
        x = net.inputs(part).astype(float) if part else np.zeros((1, toxicity.WORD_DIM + 1 + toxicity.PAIR_DIM))
        states = []
        for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h, out, n = np.zeros(toxicity.H), np.zeros((len(x), toxicity.H)), toxicity.H
            for t in order:
                g, u = x[t] @ net.p["W" + d] + net.p["b" + d], net.p["U" + d]
                r, z = logistic(2 * (g[:n] + h @ u[:, :n])), logistic(2 * (g[n : 2 * n] + h @ u[:, n : 2 * n]))
                h = h + z * (np.tanh(g[2 * n :] + (r * h) @ u[:, 2 * n :]) - h)
                out[t] = h
            states.append(out)
        both = np.concatenate(states, axis=1)
        a = np.exp(both @ net.p["v"])
        best = max(best, ((a / a.sum()) @ both) @ net.p["w"] + net.p["c"][0])
    return logistic(best)


def corpus(rng, n, vile):
    clean = [" ".join(f"w{i}" for i in rng.integers(0, 300, int(rng.integers(0, 160)))) for _ in range(n)]
    return clean, [" ".join([*t.split()[:30], str(rng.choice(vile)), *t.split()[30:]]) for t in clean]


def test_scorer_equals_a_plain_one():
    rng = np.random.default_rng(3)
    clean, toxic = corpus(rng, 40, ["vile", "nasty"])
    net = toxicity.fit(clean + toxic, [0] * 40 + [1] * 40, steps=8)
    texts = [*clean[:20], *toxic[:20], None, "", "  ", "x" * 3000, "a", " ".join(["b"] * 48), " ".join(["b"] * 49), "\ud800 é 日本"]
    scorer = toxicity.Scorer(net, remember=50)
    want = [plain_score(net, t) for t in texts]
    assert np.allclose(scorer(texts), want, atol=1e-4)
    assert np.allclose(scorer(texts[::-1])[::-1], want, atol=1e-4)  # remembered words score alike


def test_letter_pairs_tell_words_that_the_sample_lacks():
    """Toxic words of the test share letters, not whole words, with those of the sample."""
    rng = np.random.default_rng(6)
    ends = ["zyxq" + "".join(rng.choice(list("abcdefgh"), 3)) for _ in range(120)]
    clean, toxic = corpus(rng, 120, ends[:80])
    unseen_clean, unseen = corpus(rng, 60, ends[80:])
    net = toxicity.fit(clean + toxic, [0] * 120 + [1] * 120)

    def right():
        s = toxicity.Scorer(net)
        return (np.mean(np.array(s(unseen)) > 0.5) + np.mean(np.array(s(unseen_clean)) < 0.5)) / 2

    with_pairs = right()
    net.p["pairs"] = np.zeros_like(net.p["pairs"])
    assert with_pairs > 0.8 and with_pairs > right() + 0.15


def test_held_out_accuracy_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    held = toxicity.score(docs.join(labels, "doc_id", "left_semi"), net).join(labels.where("toxic IS NOT NULL"), "doc_id").where(remainder(F.col("doc_id"), 5) == 0).toPandas()
    hit = (held.score >= 0.5) == (held.toxic == 1)
    print(len(held), hit.mean(), hit[held.toxic == 1].mean())
    assert hit.mean() > 0.95 and hit[held.toxic == 1].mean() > 0.9


def test_odd_tables(spark):
    rows = [(1, None, "x"), (1, "a vile word", "y"), (None, "a good word", "z"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, F.lit(True))
    assert toxicity.score(docs, net).count() == 4 and toxicity.score(docs.limit(0), net).count() == 0
    for net in (toxicity.train(docs.limit(0), labels, F.lit(True)), toxicity.train(docs, labels.limit(0), F.lit(True))):
        assert all(0 <= r.score <= 1 for r in toxicity.score(docs, net).collect())
