import textwrap

import duckdb

from scoreloom.llm import catalogue, licenses

WIDE = {n: t for n, t in licenses.KNOWN if len(t) > 300 and "\n\n" in t and not t.startswith("All rights")}


def wrapped(text, width=70):
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


def test_files_as_published(spark):
    rights = "Copyright (c) 2020, Jane Doe and others"
    titles = {"MIT": "The MIT License (MIT)", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "0BSD": "Zero-Clause BSD", "Zlib": "zlib License"}
    files = [(n, f"{t}\n\n{rights}\n\n{wrapped(WIDE[n], w)}\n") for n, t in titles.items() for w in (60, 70, 78, 4000)]
    files += [("MIT", f"MIT License\n\n{rights}\n\n{wrapped(WIDE['MIT'])}"), ("Unlicense", wrapped(WIDE["Unlicense"]))]
    # wrapped so that a line begins with the word copyright
    files.append(("ISC", f"ISC License\n\n{rights}\n\n" + WIDE["ISC"].replace("above copyright", "above\ncopyright")))
    files += [(n, t) for n, t in licenses._long()]
    files += [("", "MIT License"), ("", "Copyright notice of 2020")]
    rows = [(i, t) for i, (_, t) in enumerate(files)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, licenses.per_document(docs, licenses.scan(docs, licenses.known_digests(spark))).collect()))
    assert [(r[2], r[3]) for r in got] == [(n, n != "") for n, _ in files]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert got == sorted(con.execute(catalogue.ORACLES["op2_licenses"]).fetchall())
