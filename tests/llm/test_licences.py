import pytest

from pointloom.llm import licences

CASES = [
    (1, "Released under the MIT License."),
    (2, "Licensed under the Apache License, Version 2.0 (the License)"),
    (3, "GNU General Public License, version 3. SPDX-License-Identifier: GPL-3.0"),
    (4, None),
    (5, ""),
    (6, "mit license mit license MIT LICENSE"),
    (7, "word " * 30_000 + "apache license"),
    (8, "mitlicense apache-license mit-license licensemit"),
    (1, "Released under the MIT License."),
    (None, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (9, "Copyright (c) 2020-2024 Someone. All rights reserved. Straße ÄMIT license"),
]


def rows(frame):
    return {(r.doc_id, r.n_words): r for r in frame.collect()}


def test_cases(spark):
    df = spark.createDataFrame([(*c, 0) for c in CASES], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert licences.scan(df).count() == len(CASES)
    assert (got[1].base_labels, got[1].first_word, got[1].last_word, got[1].n_base) == ("mit", 3, 3, 1)
    assert got[1].labels == "mit" and got[1].score == 0.8
    assert got[2].labels == "apache,apache-2.0" and got[2].base_labels == "apache"
    assert "gpl-3.0" in got[3].labels.split(",") and got[3].score == 1.0
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].labels, got[4].score) == (0, 0, None, "", 0.0)
    assert got[5].n_words == 0
    assert (got[6].n_base, got[6].first_word, got[6].last_word) == (3, 0, 4)
    assert (got[7].n_words, got[7].first_word) == (30_002, 30_000)
    assert got[8].n_base == 2  # the hyphen is a gap between words
    assert got[None].labels == "mit" and got[None].base_labels == ""
    assert got[9].n_base == 0 and "copyright" in got[9].labels
    assert licences.scan(df.limit(0)).count() == 0


def test_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", CASES)
    want = sorted(map(str, con.execute(f"select doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score from ({licences.oracle()})").fetchall()))
    got = licences.scan(spark.createDataFrame(CASES, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_suppression(spark):
    """A name within a grant is suppressed by it; the identifier outranks both."""
    assert sum(map(len, licences.SENTENCES.values())) >= 180 and len(licences.rules()) > 350
    text = "spdx license identifier mit"
    got = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.labels == "mit" and got.score == 1.0


def test_rules_fire_without_other_gate_words(spark):
    """Grants and sentences count in a text of their own."""
    texts = ["released under MIT", "distributed under the BSD", "available under Apache 2.0", "neither the name of Acme nor the names of its contributors may be used to endorse"]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.labels, r.score) for r in sorted(got)] == [("mit", 0.8), ("bsd", 0.8), ("apache-2.0", 0.8), ("bsd-3-clause", 0.9)]


def test_keywords_are_in_what_their_rules_match(spark):
    """Each rule can match only texts that hold its keyword as a word, and each fires on a text of its own."""
    import re

    def sample(rx):
        """A text that the rule matches: first alternatives, no optional parts."""
        rx = rx.replace(".{0,40}?", "").replace(".{0,60}?", "").replace(".{0,80}?", "").replace(".{0,120}?", "").replace(".{0,30}?", "").replace(".{0,20}?", "").replace(".{1,80}?", "acme")
        rx = rx.replace("[cs]", "s").replace("[bc]", "b").replace("[12][0-9]{3}", "2001").replace("[0-9]", "4").replace("[a-z0-9]+", "x")
        while "(" in rx:
            rx = re.sub(r"\(\?:([^()]*)\)(\?|\*|\{0,3\})?", lambda m: "" if m[2] else m[1].split("|")[0], rx)
        return re.sub(r"(\S)\?", "", rx.split("|")[0])

    rules = licences.rules()
    texts = []
    for label, keyword, rx, _ in rules:
        text = " ".join(sample(rx[4:-2]).split())
        assert re.search(rx, " " + "  ".join(text.split()) + " "), (rx, text)
        assert keyword in text.split(), (keyword, text)
        texts.append(text)
        for part in re.split(r"\|(?![^(]*\))", rx[4:-2]):
            assert keyword in part or label in ("mit",), (keyword, part)
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(r.labels for r in got.values())
