"""Licence scans against a plain reading of whole tables, other licences, denials, and the words that open the scan."""

import random
import re

import pytest

from patchloom.llm import licences

DATA = "/root/testdata/sf0.001"


def _paragraphs(text):
    """The paragraphs of a text, line by line."""
    begins = {" ".join(t.split()[:2]) for ts in licences.TEMPLATES.values() for t in ts if not t.startswith("under the")} | {"this work is", "this program is", "this library is", "this file is", "copyright"}
    out, now = [], []
    for raw in re.split(r"\r\n?|\n", text.lower().replace("licence", "license")):
        line = re.sub(r"^[ \t/*#;%!>|<-]*(?:(?:dnl|rem)\b)?[ \t/*#;%!>|<-]*", "", raw)
        if not re.sub(r"[\s/*#;%!>|<-]", "", line):
            out, now = [*out, now], []
            continue
        if any(re.match(b.replace("-", "."), line) for b in begins):
            out, now = [*out, now], []
        now = [*now, line]
        if re.search(r"[.!?][\"')\]]*[ \t]*(?:\*+/|-->)?[ \t]*$", line) or "spdx-license-identifier" in line:
            out, now = [*out, now], []
    return [" ".join(p) for p in [*out, now] if p]


def _judged(model, paragraph):
    words = licences.words_of(paragraph)
    at = [model.vocabulary[g] for g in licences.grams_of(paragraph) if g in model.vocabulary]
    p = licences._softmax(((model.weights[at].sum(axis=0) + model.bias) / model.temperature)[None, :])[0]
    best = licences.CLASSES[int(p.argmax())]
    if best in (licences.NONE, licences.UNKNOWN):
        return best
    pairs = {" ".join(w) for w in zip(words, words[1:], strict=False)} | (set(words) if len(words) == 1 else set())
    confirmed = any(len(s & pairs) >= licences.CONFIRM * len(s) for s in map(licences.shingles_of, licences.TEMPLATES[best]))
    return best if confirmed and p.max() >= model.least else licences.UNKNOWN


def test_whole_table_equals_a_plain_reading(spark):
    model, docs = licences.trained(), spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: (r.licences, r.n_licences, r.n_unknown) for r in licences.scan(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        found = [_judged(model, p) for p in _paragraphs(r.text or "")]
        known = [f for f in found if f not in (licences.NONE, licences.UNKNOWN)]
        assert got[r.doc_id] == (",".join(sorted(set(known))), len(known), found.count(licences.UNKNOWN)), r.doc_id
        some += bool(known)
    assert some >= 3


def test_paragraphs_without_needed_words_are_none():
    """The words come with a proof; here it is tried on the n-grams that are left, one by one, in handfuls and all together."""
    model, rng = licences.trained(), random.Random(1)
    needed = set(model.needed())
    assert needed and not needed & licences.COMMON
    left = [k for g, k in model.vocabulary.items() if not needed & set(g.split())]
    for chosen in [*[[k] for k in left], *[rng.sample(left, rng.randint(2, len(left))) for _ in range(300)], left]:
        assert (model.weights[chosen].sum(axis=0) + model.bias).argmax() == 0


OTHER = ("Licensed under the Eclipse Public License 2.0", "Boost Software License - Version 1.0", "Not licensed under the MIT License.", "This is not licensed under the GNU General Public License version 3", "Licensed under the Foo License", "No longer available under the BSD License", "Distributed under the terms of the zlib license")
KNOWN = {"MIT License": "mit", "Distributed under the MIT licence": "mit", "Apache License, Version 2.0, January 2004": "apache-2.0", "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "gpl-3.0", "Released under the ISC licence": "isc"}
NOTHING = ("the driving license of the public office", "the MIT students met at noon", "all rights reserved", "an apache helicopter", "permission to enter is needed")


@pytest.mark.parametrize("around", ["{}", "Some words first.\n\n{}\n\nThen more of them.", "# {}"])
def test_known_other_and_no_licences(spark, around):
    texts = [*OTHER, *KNOWN, *NOTHING]
    rows = licences.scan(spark.createDataFrame([(k, around.format(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    got = {texts[r.doc_id]: (r.licences, r.n_unknown) for r in rows}
    assert {t: got[t] for t in OTHER} == dict.fromkeys(OTHER, ("", 1))
    assert {t: got[t][0] for t in KNOWN} == KNOWN
    assert {t: got[t] for t in NOTHING} == dict.fromkeys(NOTHING, ("", 0))
