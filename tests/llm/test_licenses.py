"""Licence notices, against a plain search of every phrase at every word."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import license_scan
from spanloom.llm.license_scan import BASE, NOTICES, Template, phrase

SCHEMA = "doc_id bigint, text string, row string, words string, labels string"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def scanned_expected(texts, templates, rare=8):
    """The same facts by trying every place of every text."""
    cut = [words_of(t) for t in texts]
    weight = {w: ((len(cut) + 1) // (sum(w in c for c in cut) + 1)).bit_length() for t in templates for w in t.words}
    out = []
    for words in cut:
        places, base, labels, best = [], set(), set(), 0.0
        for t in templates:
            chosen = sorted(range(len(t.words)), key=lambda i: (-weight[t.words[i]], i))[:rare]
            begins = []  # of the whole template, by phrase
            for at, own in t.key_places():
                chosen.append(min(range(at, at + len(own)), key=lambda i: (-weight[t.words[i]], i)))
                begins.append([i - at for i in range(len(words)) if words[i : i + len(own)] == own])
            for start in begins[0]:
                if t.base:
                    places.append(start)
                if all(any(abs(b - start) <= t.slack for b in more) for more in begins):
                    chosen = sorted(set(chosen))
                    near = [o for o in chosen if any(words[i] == t.words[o] for i in range(max(0, start + o - t.slack), min(len(words), start + o + t.slack + 1)))]
                    best = max(best, sum(weight[t.words[o]] for o in near) / sum(weight[t.words[o]] for o in chosen))
                    labels.add(t.label)
                    if t.base:
                        base.add(t.label)
        out.append((len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), round(best, 9)))
    return out


def scanned(spark, texts, templates, **more):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)
    got = sorted(license_scan.scan_licenses(docs, templates=templates, **more).collect())
    assert [r.doc_id for r in got] == list(range(len(texts)))
    return [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got]


def test_random_texts_and_templates(spark):
    rng = random.Random(4)
    templates = (
        phrase("x", "a b", True), phrase("y", "b b", True), phrase("x", "c", True), phrase("z", "d a d"),
        Template("long", "a b c d e f g h a b c d e f g h i j k l m n o p q r", ("a b c", "k l m n", "p q r")),
        Template("lap", "f e d c b a f e d c b a", ("f e d", "e d c", "c b a")),
    )
    notices = [t.words for t in templates]
    texts = [None, "", " -- ", "A B", "a-b.b/B"]
    for _ in range(120):
        words = []
        while len(words) < rng.randrange(1, 80):
            piece = list(rng.choice(notices)) if rng.random() < 0.5 else [rng.choice("abcdefghijklmnopqr") for _ in range(rng.randrange(1, 6))]
            if rng.random() < 0.4:
                piece.insert(rng.randrange(len(piece)), rng.choice(["x", "a"]))
            if rng.random() < 0.3:
                del piece[rng.randrange(len(piece))]
            words += piece
        texts.append(" ".join(words))
    for rare in (1, 3, 50):
        assert scanned(spark, texts, templates, rare=rare) == scanned_expected(texts, templates, rare)


def test_notices(spark):
    mit = (
        "// Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\n"
        "// documentation files (the \"Software\"), to deal in the Software without restriction, including ..."
    )
    labelled = {
        "Licensed under the Apache License, Version 2.0.": ["apache", "apache-2.0"], "Released under the MIT License.": ["mit"],
        "GNU General Public License, version 3": ["gpl", "gpl-3.0"], "Licensed under CC BY-NC 4.0.": ["cc-by-nc-4.0"],
        "SPDX-License-Identifier: MIT": ["mit"], mit: ["mit"], mit.replace("free of charge", "for money"): [],
        "GNU Lesser General Public License": ["gpl", "lgpl"], "a summit licensed by many": [], "mit  lizenz license": [],
        "the software is free of charge and without restriction": [],
    }
    got = scanned(spark, list(labelled), (*BASE, *NOTICES))
    assert [g[5] for g in got] == list(labelled.values())
    assert got == scanned_expected(list(labelled), (*BASE, *NOTICES))
    assert all((g[6] > 0) == bool(g[5]) for g in got)


def test_odd_rows(spark):
    many = "mit license " * 30_000
    rows = [(1, "MIT License"), (1, "MIT License"), (None, "MIT License"), (2, None), (3, many), (4, "x" * 300_000 + " mit\nlicense")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = license_scan.scan_licenses(docs)
    facts = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in got.collect()), key=str)
    assert facts == sorted([
        (1, 2, 1, 0, 0, ["mit"]), (1, 2, 1, 0, 0, ["mit"]), (None, 2, 1, 0, 0, ["mit"]), (2, 0, 0, None, None, []),
        (3, 60_000, 30_000, 0, 59_998, ["mit"]), (4, 3, 1, 1, 1, ["mit"]),
    ], key=str)
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan_licenses(docs, templates=(Template("x", "a b c", ("a", "c"), True),))
    with pytest.raises(ValueError):
        Template("x", "a b c", ("a c",)).key_places()
    assert isinstance(got.schema["labels"].dataType.simpleString(), str) and got.select(F.max("score")).first()[0] == 1.0
