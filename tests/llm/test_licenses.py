import duckdb

from scoreloom.llm import catalogue, licenses


def test_equals_sql(spark):
    texts = {name: text for name, text in licenses.KNOWN}
    rows = [(1, None), (2, ""), (3, "MIT: \n\nlicensed, under THE mit LICENCE"), (4, "Copyright (c) 2020 X\n(c) 2021 y\n© me\nAll rights reserved"),
            (5, texts["MIT"].replace("\n\n", "\n").replace(" ", "  ")), (6, "x\n" + texts["0BSD"] + "\ny"), (7, "é Licensed under the MIT License."),
            (8, "\n\n  \n\nReleased under the MIT licence!!\n \nq"), (9, "Copyright 2020 a\nCopyright 2021 b\nCopyright 2022 c\nAll rights reserved."), (10, texts["ISC"] + " " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.per_document(docs, licenses.scan(docs, licenses.known_digests(spark))).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(con.execute(catalogue.ORACLES["op2_licenses"]).fetchall())
    by = {r.doc_id: r for r in got}
    assert by[3].licenses == "MIT" and by[4].whole and by[5].whole and by[6].n_parts == 1 and not by[7].licenses and by[10].licenses == "ISC"


def test_empty_and_clashing_names(spark, table):
    known = licenses.known_digests(spark)
    assert licenses.scan(table([]), known).count() == 0
    assert licenses.per_document(table([(1, "All rights reserved"), (1, "All rights reserved")]), licenses.scan(table([(1, "all rights reserved")]), known)).count() == 2
    assert licenses.scan(table([(1, "x")]), known.limit(0)).count() == 0
