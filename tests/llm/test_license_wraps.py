import textwrap

from loomdigest.llm import licenses


def test_wrapped_and_reflowed_texts_are_found(spark):
    """Wrapped at many widths, so that lines of the body begin with 'copyright', and on one line after the notice."""
    texts = {n: t for n, t in licenses.CATALOGUE if n in ("ISC", "MIT", "BSD-2-Clause", "BSD-3-Clause")}
    rows, want = [], {}
    for name, text in texts.items():
        whole = " ".join(text.split())
        shapes = [textwrap.fill(whole, w, break_long_words=False, break_on_hyphens=False) for w in range(30, 100, 3)]
        for shape in ["Copyright (c) 2020 X " + whole, *("Copyright 2020 X\n\n" + s for s in shapes)]:
            want[len(rows)] = name
            rows.append((len(rows), shape))
    isc = licenses.KNOWN["ISC"].replace("above copyright notice", "above\ncopyright notice")
    want[len(rows)] = "ISC"
    rows.append((len(rows), isc))
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {n: (got[n], rows[n][1][:300]) for n in want if got[n] != want[n]} == {}
