import random
import re

import pytest
from odd import TEXTS, frame, odd_documents
from pyspark.sql import functions as F

from lakemoor.llm import license_scan as scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in scan.BASE.items():
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(spark, rows):
    found = scan.license_scan(frame(spark, [(i, text) for i, text in enumerate(rows)])).collect()
    for r in found:
        got = (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels))
        assert got == brute(rows[r.doc_id]), rows[r.doc_id][:80]
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    return {r.doc_id: r for r in found}


def test_base_places(spark):
    check(
        spark,
        [text or "" for _, text in TEXTS]
        + ["under the MIT license", "xunder the mit license", "under the mit licenses", "cc by nc cc by nc", "CC-BY-NC",
           "cc by ncé", "apache license version 2", "apache license version 20", "a" * 3 + " under-the-MIT-license!",
           "under the mit license " * 300, "w " * 995 + "under the mit license", "CCK BY NC"],
    )


def test_suppression_and_windows(spark):
    pad = "w " * 495
    rows = ["licensed under cc by nc sa 4 0", "gnu lesser general public license version 2 1", pad + "GNU GPL v3",
            "GNU General Public License", "all rights reserved", "no terms here", "apache license version 2 0"]
    rows += ["w" * n + " licensed under the gnu affero general public license version 3" for n in range(950, 1010, 7)]
    found = check(spark, rows)
    labels = {i: [one.label for one in r.detections] for i, r in found.items()}
    assert labels[0] == ["cc-by-nc-sa"] and labels[1] == ["lgpl-2-1"] and labels[2] == ["gpl-3"] and labels[3] == ["gpl"]
    assert labels[4] == ["all-rights-reserved"] and labels[5] == [] and labels[6] == ["apache-2"]
    assert all(labels[i] == ["agpl-3"] for i in range(7, len(rows)))


def test_rules():
    rules = scan.signature_rules()
    assert len(rules) > 200
    for rule in rules:
        assert any(anchor in rule.keyword for anchor in scan.ANCHORS), rule
        plain = re.sub(r"\(\?:[^()]*\)\??|\[[^]]*\]|.\?", "\n", rule.pattern)
        assert rule.keyword and rule.keyword in plain or rule.keyword in rule.pattern, rule


def test_nothing_but_expressions(spark):
    plan = scan.license_scan(frame(spark, [(1, "mit license")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_rows(spark):
    docs = odd_documents(spark, "line", "anchored", "detections", "labels", "score")
    assert scan.license_scan(docs).count() == docs.count()
    assert scan.license_scan(docs.limit(0)).collect() == []
    both = scan.license_scan(docs).filter(F.col("doc_id") == 3).collect()
    assert len(both) == 2 and both[0] == both[1]


def labels_of(spark, texts, rules=None):
    found = scan.license_scan(frame(spark, list(enumerate(texts))), rules).collect()
    return [r.labels for r in sorted(found, key=lambda r: r.doc_id)]


def test_identifiers_bodies_and_spellings(spark):
    pad = "w " * 470
    texts = {
        "// SPDX-License-Identifier: MIT": ["mit"],
        "SPDX-License-Identifier: ISC": ["isc"],
        "# SPDX-License-Identifier: (Zlib OR PostgreSQL)": ["postgresql", "zlib"],
        "SPDX-License-Identifier: OpenSSL AND Ruby": ["openssl", "ruby"],
        "SPDX-License-Identifier: GPL-2.0-or-later OR Vim": ["gpl-2", "vim"],
        "SPDX-License-Identifier: MIT OR Apache-2.0 OR BSD-3-Clause": ["apache-2", "bsd-3-clause", "mit"],
        "SPDX-License-Identifier: MIT-0": ["mit-0"],
        pad + "SPDX-License-Identifier: MIT OR ISC": ["isc", "mit"],
        "the MIT Licence": ["mit"],
        "GNU General Public Licence, version 3": ["gpl-3"],
        "European Union Public License": ["eupl"],
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal': ["mit"],
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:": ["bsd"],
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without": ["bsd-3-clause"],
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice": ["isc"],
        "This is free and unencumbered software released into the public domain.": ["unlicense"],
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": ["mpl-2"],
        "a mit, an isc and a ruby in prose; spdx": [],
    }
    assert dict(zip(texts, labels_of(spark, texts))) == texts
    bodies = [re.sub(r"\(\?:([^()|]*)[^()]*\)\??|\[(.)[^]]*\]", r"\1\2", body).replace("?", "") for _, *own in scan.BODIES for body in own]
    want = [label for label, *own in scan.BODIES for _ in own]
    assert all(label in found for label, found in zip(want, labels_of(spark, bodies)))
    assert max(map(len, bodies)) < scan.MARGIN


def test_given_rules_decide_where_to_look(spark):
    rules = (scan.Rule("own", 0.5, "house rules", "house rules(?: apply)?"),)
    assert labels_of(spark, ["Our house rules apply.", "MIT license"], rules) == [["own"], []]


def test_long_expressions(spark):
    eight = "Apache-2.0 OR BSD-3-Clause OR GPL-2.0-or-later OR LGPL-2.1-or-later OR MPL-2.0 OR CC-BY-SA-4.0 OR PostgreSQL OR Zlib"
    every = [(label, one) for label, *own in scan.SPDX for one in own]
    texts = [
        f"SPDX-License-Identifier: {eight}",
        "SPDX-License-Identifier: " + " OR ".join(one for _, one in every) + " Copyright, Ruby and MIT",
        "SPDX-License-Identifier: " + " AND ".join(["MIT"] * 20_000) + " AND (Zlib OR Vim)",
        "spdx license identifier house rules or mit; SPDX-License-Identifier: ISC WITH other",
    ]
    got = labels_of(spark, texts)
    assert len(got[0]) == 8 and {"postgresql", "zlib", "apache-2", "mpl-2"} <= set(got[0])
    assert set(got[1]) == {label for label, _ in every}
    assert got[2:] == [["mit", "vim", "zlib"], ["isc"]]


def test_rules_longer_than_a_window_sees_are_refused(spark):
    for pattern in ("word " * 60, "a(?: b)*", "x{1,300}"):
        with pytest.raises(ValueError, match="can match more"):
            labels_of(spark, ["x"], (scan.Rule("own", 0.5, "x", pattern),))


def test_suppression_against_plain_python(spark):
    rnd, rows = random.Random(10), []
    for _ in range(200):
        own = [(a, a + rnd.randrange(1, 6), "x", 0.5, rnd.randrange(4)) for a in (rnd.randrange(8) for _ in range(rnd.randrange(9)))]
        rows.append((own,))
    kind = "found array<struct<start: int, stop: int, label: string, weight: double, rank: int>>"
    for own, left in spark.createDataFrame(rows, kind).select("found", scan._surviving(F.col("found"))).collect():
        want = [
            a for a in own
            if not any(b[0] <= a[0] and b[1] >= a[1] and ((b[1] - b[0]) > (a[1] - a[0]) or b[4] < a[4]) for b in own)
        ]
        assert left == want
