import numpy as np

from loomdigest.llm import simhash


def similarity(x, y):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (x, y))
    return len(a & b) / len(a | b)


def test_near_dedup_is_exact_around_the_threshold(spark):
    """Long texts in pairs between 0.75 and 0.85, each side of 0.8, against whole sets."""
    rng, rows, want = np.random.default_rng(5), [], set()
    for pair in range(120):
        words = [f"p{pair}w{i}" for i in range(400)]
        changed = list(words)
        for at in rng.choice(np.arange(10, 390, 12), 8 + pair % 4, replace=False):
            changed[at] += "x"
        texts = " ".join(words), " ".join(changed)
        rows += [(2 * pair, texts[0]), (2 * pair + 1, texts[1])]
        assert 0.74 < similarity(*texts) < 0.86
        want |= {2 * pair} | ({2 * pair + 1} if similarity(*texts) < 0.8 else set())
    assert 130 < len(want) < 230
    # the six keys and the radius are given generously: only the pair test is at issue
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keys=16, radius=40).collect()}
    assert kept == want


def test_near_dedup_searches_again_where_a_link_is_refuted(spark):
    """0 is a candidate of all but no copy; the others are copies only of one another."""
    words = [f"w{i}" for i in range(400)]

    def changed(places, mark):
        return " ".join(w + mark if i in places else w for i, w in enumerate(words))

    base = set(range(5, 395, 30))
    rows = [(0, " ".join(words))] + [(n, changed(base | {200 + n * 7}, "x")) for n in range(1, 6)]
    assert all(similarity(rows[0][1], t) < 0.8 for _, t in rows[1:])
    assert all(similarity(rows[1][1], t) >= 0.8 for _, t in rows[2:])
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keys=16, radius=40).collect()}
    assert kept == {0, 1}
