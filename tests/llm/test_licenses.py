import re

import duckdb

from postloom.llm import licenses


def plain(spark, cases):
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    return {r.doc_id: {f.name: f.containment for f in r.found} for r in licenses.scan(docs).collect()}


def test_notes_and_texts(spark):
    filler = " ".join(f"word{k}" for k in range(300))
    mit = licenses.TEMPLATES["mit-permission"]
    edited = re.sub(r"\bpublish\b", "print", mit)
    cases = [f"{filler} {mit} {filler}", f"{filler}\nAll Rights Reserved\n{filler}", f"{filler} {edited.upper()}",
             mit[:200], "all rights reserved words go on in the same line", None, "", "Licensed under CC-BY NC 4.0!",
             "\n".join(mit.split(" "))]
    out = plain(spark, cases)
    assert out[0] == {"mit-permission": 1.0} and out[1] == {"all-rights-reserved": 1.0}
    assert 0.8 <= out[2]["mit-permission"] < 1.0
    assert out[3] == {} and out[4] == {"all-rights-reserved": 1.0} and out[5] == {} and out[6] == {}
    assert out[7] == {"cc-by-nc-4.0-note": 1.0} and out[8] == {"mit-permission": 1.0}


def test_every_template_is_found_anywhere(spark):
    cases = [" ".join(["lorem"] * k) + " " + text + " ipsum" * k for text in licenses.TEMPLATES.values() for k in (5, 6, 7, 8)]
    names = [n for n in licenses.TEMPLATES for _ in range(4)]
    out = plain(spark, cases)
    assert all(out[k].get(n) == 1.0 for k, n in enumerate(names))


def test_common_licenses(spark):
    gnu = "under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or"
    cases = {gnu.format("General Public License", 2): "gpl-2.0-header",
             gnu.format("Lesser General Public License", 2.1): "lgpl-2.1-header",
             gnu.format("Lesser General Public License", 3): "lgpl-3.0-header",
             gnu.format("Affero General Public License", 3): "agpl-3.0-header",
             "Foo is licensed under the MIT License, see below": "mit-licensed-note",
             "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0-work",
             "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0-work",
             "All of it is licensed under CC BY-SA 4.0": "cc-by-sa-4.0-note",
             "To the extent possible under law, Ann has waived all copyright and related or neighboring rights to Foo": "cc0-1.0-waiver"}
    out = plain(spark, list(cases))
    short = {"mit-licensed-note": {"mit-short-note": 1.0}}  # its last four words are a note of their own
    assert [out[k] for k in range(len(cases))] == [{name: 1.0} | short.get(name, {}) for name in cases.values()]


def test_short_notes_on_lines_of_any_length(spark):
    """A note of few words is found on a long line, behind blanks, across lines, and in a text of nothing else."""
    filler = " ".join(f"word{k}" for k in range(500))
    cases = [f"{filler} Copyright 2020 Acme. All rights reserved. {filler}", " " * 400 + "All rights reserved.\n" + filler,
             f"{filler} all\nrights\nreserved", "All rights reserved", "all rights", f"all the rights reserved {filler}",
             "This project is under the MIT License"]
    out = plain(spark, cases)
    assert [list(out[k]) for k in range(7)] == [["all-rights-reserved"]] * 4 + [[], [], ["mit-short-note"]]


def test_documents(documents, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    rows = con.execute(licenses.brute_force_sql()).fetchall()
    got = [tuple(r) for r in licenses.license_matches(documents).select("doc_id", "n_licenses", "licenses").collect()]
    assert sorted(got) == sorted(rows) and any(n for _, n, _ in got)


def test_edges(edges, nothing):
    out = licenses.license_matches(edges).collect()
    assert len(out) == edges.count()
    assert {r.licenses for r in out if r.doc_id == 0} == {"all-rights-reserved:1.000"}
    assert licenses.license_matches(nothing).count() == 0
