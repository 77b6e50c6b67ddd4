"""Components against a plain search, with repeated links, long chains, stars and lots."""

import numpy as np
import pytest

from loomdigest.llm.components import components


def plain(links):
    of = {}
    for a, b in links:
        of.setdefault(a, {a}), of.setdefault(b, {b})
        if of[a] is not of[b]:
            of[a] |= of[b]
            for x in of[b]:
                of[x] = of[a]
    return {x: min(group) for x, group in of.items()}


@pytest.mark.parametrize("most", [16_000_000, 7])
def test_components_equal_a_plain_search(spark, most):
    rng = np.random.default_rng(most)
    links = [(int(a), int(b)) for a, b in rng.integers(-500, 500, (350, 2))]
    links += [(1000 + i, 1001 + i) for i in range(40)]  # a chain
    links += [(3000, 2000 + i) for i in range(30)] + [(4000 + i, 3999) for i in range(30)]  # stars with the largest and the smallest in the middle
    links += links[:100] + [(7, 7)]
    got = components(spark.createDataFrame(links, "a long, b long"), most=most).collect()
    want = plain([x for x in links if x[0] != x[1]])
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_no_links(spark):
    assert components(spark.createDataFrame([(5, 5)], "a long, b long")).count() == 0
