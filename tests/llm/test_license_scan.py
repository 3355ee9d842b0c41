import re

from edges import check_edges, documents
from timing import growth

from ridgeline.llm import license_scan as L
from ridgeline.llm.common import WORD


def brute(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for i in range(len(words)):
        for phrase, label in L.BASE_PHRASES.items():
            p = phrase.split()
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.op1_license_scan(spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_edges(spark):
    rows = {r.doc_id: r for r in check_edges(spark, L.scan_licenses)}
    assert (rows[3].n_words, rows[3].base_labels, rows[3].score, rows[3].first_word) == (0, "", 0.0, None)
    assert rows[1].base_labels == "apache" and rows[1].n_base == 1


def test_overlaps_and_tags(spark):
    text = "Apache License MIT license cc BY cc by-NC x\n// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\n"
    r = L.scan_licenses(documents(spark, [(1, text, None, None, None)])).collect()[0]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (4, 0, 6, "apache,cc-by,mit")
    assert "cc-by-nc" in r.labels and "bsd" in r.labels and "gpl" in r.labels
    assert r.expressions == ["mit gpl-2.0-only or bsd-3-clause and"]


def test_expression_parser():
    names = lambda s: [x for _, x in L.parse_expression(s)]
    assert names("A or B and C with D") == ["a", "b", "c", "d", "with", "and", "or"]
    assert names("(A or B) and C") == ["a", "b", "or", "c", "and"]
    assert names("A and and B") == ["a"]
    assert names("A or (B and") == ["a"]
    assert names("") == [] and names(")") == []
    assert L.evaluate(L.parse_expression("MIT OR GPL-3.0+")) == (["gpl", "mit"], True)
    assert L.evaluate(L.parse_expression("MIT AND GPL-3.0-only")) == (["gpl", "mit"], False)


def test_places_of_many_tags():
    line = "SPDX-License-Identifier: MIT OR Apache-2.0\n"
    a = L.automaton(L.BASE_PHRASES, L.MORE_PHRASES)
    text = "word xspdx-license-identifier: MIT\n" + line * 3000
    spans = [s["word"] for s in L.scan_text(text, a)["spans"] if s["kind"] == "tag"]
    assert spans == [w for k in range(3000) for w in [5 + 8 * k] * 2]


def test_more_than_one_tag_on_a_line():
    a = L.automaton(L.BASE_PHRASES, L.MORE_PHRASES)
    r = L.scan_text("/* SPDX-License-Identifier: MIT */ SPDX-License-Identifier: Apache-2.0 OR (SPDX-License-Identifier: ISC\nBSD-2-Clause", a)
    assert r["expressions"] == ["mit", "apache-2.0", "isc"] and r["labels"] == "apache,isc,mit"
    assert [s["word"] for s in r["spans"] if s["kind"] == "tag"] == [0, 4, 11]


def test_one_long_expression_takes_linear_time():
    a = L.automaton(L.BASE_PHRASES, L.MORE_PHRASES)
    for unit in ("MIT or ", "x{} and ", "(", "(MIT or ", "(a or SPDX-License-Identifier: "):
        make = lambda n, unit=unit: "SPDX-License-Identifier: " + "".join(unit.replace("{}", str(k)) for k in range(n)) + "MIT"
        assert growth(lambda t: L.scan_text(t, a), make(4000), make(32000)) < 24, unit
