"""Licences on one line, and texts that copyright lines or comment borders make long, are found."""

from skyledger.llm import licenses


def test_licences_of_any_length(spark):
    mit, isc = licenses.KNOWN_TEXTS[0][1], licenses.KNOWN_TEXTS[3][1]
    holders = "\n".join(f"Copyright (c) {1900 + i} Holder Number {i} and the many other people of the project" for i in range(120))
    border = "\n".join("*" * 70 + f" {x} " + "*" * 70 for x in mit.split("\n"))
    rows = [(1, " ".join(mit.split())), (2, "a\n" + " ".join(isc.split()) + "\nb"), (3, holders + "\n\n" + mit), (4, border), (5, "=" * 20_000 + "\nLicenced under the MIT Licence.\n"), (6, "*" * 9_000 + " Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license, r.whole, r.lines) for r in licenses.find_licenses(df).collect()}
    assert got == {(1, "MIT", True, 1), (2, "ISC", False, 1), (3, "MIT", True, 0), (4, "MIT", True, 0), (5, "MIT", True, 1), (6, "CC-BY-NC-4.0", True, 1)}


def test_copyright_lines_of_all_kinds(spark):
    """With and without year or sign, with rights reserved, with holders that go on in further lines; lines of the licence that speak of copyright stay."""
    mit, bsd = licenses.KNOWN_TEXTS[0][1], dict(licenses.KNOWN_TEXTS)["BSD-2-Clause"]
    heads = ["Copyright (c) Some One", "Copyright Some One and others", "Copyright (c) 2020 Some One\nAll rights reserved.", "© Some One", "(c) 1999-2003 The Project", " * Copyright: Some One", "Copyright 2001 A\n               and B of C\n               and D", "Portions Copyright (C) X\nCopyright, Y\n# All Rights Reserved"]
    rows = [(i, f"MIT License\n\n{h}\n\n{mit}") for i, h in enumerate(heads)]
    # wrapped, so that lines begin with words about copyright
    wrapped = bsd.replace("the above copyright notice", "the above\ncopyright notice").replace("THE COPYRIGHT HOLDERS", "THE\nCOPYRIGHT HOLDERS")
    rows += [(100, "Copyright Z\n" + wrapped), (101, mit.replace("copyright notice", "copyright")), (102, "(c) You must keep this.\n" + mit)]
    got = {(r.doc_id, r.license, r.whole) for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {*((i, "MIT", True) for i in range(len(heads))), (100, "BSD-2-Clause", True)}


def test_digests_alone(spark):
    """A long text known by its digest only."""
    text = "GNU Licence of Nothing\n\nCopyright (C) 1991 Nobody\n\n" + "Nothing is allowed. " * 4000
    triple = ("Nothing", *licenses.digest_of(text))
    df = spark.createDataFrame([(1, text.upper().replace("1991", "2001")), (2, text + "more")], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.whole) for r in licenses.find_licenses(df, more=(triple,)).collect()] == [(1, "Nothing", True)]
    assert len({d for _, d, _ in licenses.KNOWN_DIGESTS}) == len(licenses.KNOWN_DIGESTS) >= 12


def test_published_texts(spark):
    """The long licences as a system ships them, where it does."""
    import os

    folder = "/usr/share/common-licenses"
    wanted = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = [(n, open(f"{folder}/{n}", encoding="utf-8").read()) for n in wanted if os.path.exists(f"{folder}/{n}")]
    rows = [(i, "\n\n" + t.replace("  ", "   ")) for i, (_, t) in enumerate(there)]
    got = {(r.doc_id, r.license) for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).where("whole").collect()}
    assert {(i, wanted[n]) for i, (n, _) in enumerate(there)} <= got


def test_query_equals_its_sql_on_long_texts(spark, tmp_path):
    """Texts beyond any old bound, by the query and by its SQL."""
    import duckdb

    mit, bsd = licenses.KNOWN_TEXTS[0][1], dict(licenses.KNOWN_TEXTS)["BSD-3-Clause"]
    holders = "\n".join(f"Copyright (c) {1700 + i} Holder Number {i}" for i in range(400))
    rows = [(1, holders + "\n" + mit), (2, " ".join(bsd.split())), (3, "=" * 30_000 + "\nSPDX-License-Identifier: MPL-2.0\n"), (4, None), (5, ""), (3, "Released under the Boost Software Licence, Version 1.0."), (6, "Copyright (c) Some One\nAll rights reserved.\n" + mit)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = set(con.execute(licenses.oracle()).fetchall())
    assert {(r.doc_id, r.license, r.whole, r.lines) for r in licenses.op9_license_digest_scan(spark, str(tmp_path)).collect()} == want
    assert want == {(1, "MIT", True, 0), (2, "BSD-3-Clause", True, 1), (3, "MPL-2.0", True, 1), (3, "BSL-1.0", True, 1), (6, "MIT", True, 0)}
