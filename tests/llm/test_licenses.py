import itertools
import re
from re import _constants as C, _parser

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tessera.llm import licenses as L
from tessera.llm.common import read
from tessera.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = L.build_rules()


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    base = sorted((s, label) for p, label in L.BASE.items() for s in range(len(words)) if words[s:s + len(p.split())] == p.split())
    norm, found = " ".join(words), []
    for r in RULES[len(L.BASE):]:
        for m in re.finditer(r["regex"], norm):
            s = norm[:m.start()].count(" ")
            found.append((s, s + m.group().count(" "), r["priority"], r))
    left = [a for a in found if not any(
        b is not a and b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2]
        and (b[:3] != a[:3] or b[3]["rule"] < a[3]["rule"]) for b in found)]
    named = [a[3] for a in left if a[3]["label"]]
    labels = {label for _, label in base} | {r["label"] for r in named}
    score = max([r["confidence"] for r in named] + [L.BASE_CONFIDENCE] * bool(base), default=0.0)
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
            ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score)


def values(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score


def test_hundreds_of_rules():
    assert len(RULES) > 300 and len({r["rule"] for r in RULES}) == len(RULES)


def test_query_equals_brute_force(spark):
    got = {r.doc_id: values(r) for r in QUERIES["op3_license_scan"](spark, SF_SMALL).collect()}
    assert got == {r.doc_id: brute(r.text) for r in read(spark, SF_SMALL, "documents").collect()}
    assert sum(1 for v in got.values() if v[5]) > 5


def test_wordings_suppression_and_edge_cases(spark, make_docs):
    texts = ["Licensed under the Apache License, Version 2.0.", "It is under the MIT license; under the mit license under the MIT License",
             "SPDX-License-Identifier: GPL-3.0-only", "not under the MIT license", "CC BY-NC CC BY NC SA 4.0 cc by nc",
             "GNU Lesser General Public License version 2.1 or any later version", "All rights reserved.", None, "", " ,; ",
             "café ümit license", "under the mit licenses", "x " * 20000 + "This work is licensed under the GNU General Public "
             "License, version 3. " * 300, "Mozilla Public License 2.0 (see the Mozilla Public License 2.0 for details)"]
    docs = [(i, t) for i, t in enumerate(texts)]
    df = make_docs(docs + [(None, texts[0]), docs[1], docs[1]]).withColumn("row", F.lit(1)).withColumn("label", F.lit("clash"))
    rows = L.license_scan(df).collect()
    assert len(rows) == len(docs) + 3
    for r in rows:
        assert values(r) == brute(texts[r.doc_id or 0]), r.doc_id
    by = {r.doc_id: r for r in rows}
    assert by[0].labels == "apache-2" and by[2].labels == "gpl-3" and by[6].labels == "all-rights-reserved"
    assert by[5].labels == "lgpl-2.1-or-later" and by[3].base_labels == "mit" and by[3].detections == []
    assert L.license_scan(df.where("false")).count() == 0


def forms(parsed):
    """Every text a rule's regex matches (look-arounds left out)."""
    parts = []
    for op, arg in parsed:
        if op is C.LITERAL:
            parts.append([chr(arg)])
        elif op is C.IN:
            parts.append([chr(x) for o, a in arg for x in ([a] if o is C.LITERAL else range(a[0], a[1] + 1))])
        elif op is C.SUBPATTERN:
            parts.append(forms(arg[-1]))
        elif op is C.BRANCH:
            parts.append([x for branch in arg[1] for x in forms(branch)])
        elif op is C.MAX_REPEAT:
            parts.append([x for n in range(arg[0], arg[1] + 1) for x in map("".join, itertools.product(forms(arg[2]), repeat=n))])
        else:
            assert op is C.ASSERT_NOT, op
    return list(map("".join, itertools.product(*parts)))


def test_gates_hold_for_every_form_of_every_rule():
    for r in RULES:
        texts = [f" {x} " for x in forms(_parser.parse(r["regex"]))]
        assert texts and not [x for x in texts if r["keyword"] not in x or not any(s in x for s in L.STEMS)], r


def test_forms_that_lack_the_usual_word(spark, make_docs):
    texts = ["All rights are reserved.", "GNU Library General Public License version 2", "licensed under the GNU Library General "
             "Public License, version 2.0", "not under the GNU library general public license v 2"]
    rows = {r.doc_id: r for r in L.license_scan(make_docs(list(enumerate(texts)))).collect()}
    assert [values(rows[i]) for i in range(4)] == [brute(t) for t in texts]
    assert [rows[i].labels for i in range(3)] == ["all-rights-reserved", "lgpl-2", "lgpl-2"]


def test_only_ascii_letters_are_lowered(spark, make_docs):
    """The Kelvin sign and the dotted I become ASCII letters in Unicode lower case: words that hold them are other words."""
    head = "Released under Creative Commons Attribution Share "
    texts = [head + "aliKe", head + "ali\u212ae", "UNDER THE M\u0130T LICENSE", "Under The MIT License \u212a", "É under the mit license"]
    got = [r for r in L.license_scan(make_docs(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert "cc-by-sa" in got[0].labels.split(",") and "cc-by-sa" not in got[1].labels.split(",")
    assert [r.base_labels for r in got] == ["", "", "", "mit", "mit"] and [r.n_words for r in got] == [7, 7, 4, 5, 5]
