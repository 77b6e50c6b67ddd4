from loomdigest.llm import licenses


def test_every_bundled_license_is_found_as_a_document(spark):
    rows = [(n, "Copyright (c) 2021 Someone\n\n" + text) for n, (_, text) in enumerate(licenses.CATALOGUE)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: name for n, (name, _) in enumerate(licenses.CATALOGUE)}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense", "Zlib", "CC0-1.0"} <= set(got.values())
