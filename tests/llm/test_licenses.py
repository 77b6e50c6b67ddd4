from loomdigest.llm import licenses
from oracle_check import differences


def test_whole_texts_only(spark):
    isc = licenses.KNOWN["ISC"]
    rows = [(1, "Copyright (c) 2020 A\n\n" + isc.upper(), "x"), (2, isc + " more", "x"), (3, None, "x"), (4, "", "x"), (5, isc.replace(",", " ;"), "x"), (5, isc, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    assert sorted((r.doc_id, r.license or "") for r in licenses.scan(df).collect()) == [(1, "ISC"), (2, ""), (3, ""), (4, ""), (5, "ISC"), (5, "ISC")]
    assert licenses.scan(df.limit(0)).count() == 0


def test_matches_sql(spark):
    assert differences(spark, "/root/testdata/sf0.001", ["op7_license_scan"]) == {}


def test_usual_files_with_titles_rights_and_other_signs(spark):
    texts = dict(reversed(licenses.CATALOGUE))  # of variants the first
    shapes = {
        "ISC": ["ISC License\n\nCopyright (c) 2020, A B\n\n{}", "The ISC License (ISC)\n\nCopyright 2020 A\nAll rights reserved.\n\n{}"],
        "MIT": ["The MIT License (MIT)\n\nCopyright (c) 2015 A\n\n{}", "MIT License\r\n\r\nCopyright © 2021 A\r\n\r\n{}"],
        "BSD-2-Clause": ["BSD 2-Clause License\n\nCopyright (c) 2019, A\nAll rights reserved.\n\n{}", "Copyright (c) 2019, A. All rights reserved.\n\n{}"],
        "BSD-3-Clause": ['The 3-Clause BSD License\n\n{}', "BSD 3-Clause License\n\n{}"],
    }
    rows = [(name, shape.format(texts[name])) for name, all_shapes in shapes.items() for shape in all_shapes]
    rows += [(name, texts[name].replace('"', "\u201c").replace(" ", "\u00a0").replace("-", "\u2013")) for name in shapes]
    df = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert {n: got[n] for n in got if got[n] != rows[n][0]} == {}
    title = spark.createDataFrame([(1, "MIT License"), (2, "All rights reserved."), (3, "Copyright 2020 A")], "doc_id long, text string")
    assert [r.license for r in licenses.scan(title).collect()] == [None] * 3
