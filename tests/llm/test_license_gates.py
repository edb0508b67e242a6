"""License scans against all rules on all texts: no gates, no keywords."""

import itertools
import random
import re

from fieldtally.llm import licenses

PARSER = re._parser
RULES = [(p, label, re.compile(x)) for p, label, _, x in licenses.rules()]


def samples(parsed):
    """A text for every way through a pattern's alternatives and options."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append([chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg])
        elif name == "BRANCH":
            parts.append([t for p in arg[1] for t in samples(p)])
        elif name == "SUBPATTERN":
            parts.append(samples(arg[3]))
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            parts.append(["", *samples(arg[2])])
        else:
            raise ValueError(name)
    return ["".join(x) for x in itertools.product(*parts)]


def brute(text):
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    normal = f" {'  '.join(words)} " if words else ""
    found = [(p, label, m.start(), m.end()) for p, label, x in RULES for m in x.finditer(normal)]
    left = [a for a in found if not any(b[2] <= a[2] and b[3] >= a[3] and (b[0] > a[0] or (b[0] == a[0] and b[3] - b[2] > a[3] - a[2])) for b in found)]
    base = {label for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()}
    return ",".join(sorted(base | {a[1] for a in left})), max([a[0] / 100 for a in left] + [0.5 * bool(base)])


def hand_written():
    return [(label, keyword, x) for label, (keyword, x) in licenses.NAMES.items()] + list(licenses.NOTICES)


def test_keywords_and_roots_are_in_every_match():
    assert len(hand_written()) > 200 and len(licenses.rules()) > 400
    for label, keyword, pattern in hand_written():
        for text in samples(PARSER.parse(pattern)):
            assert keyword in text, (label, text)
            assert any(r in text for r in licenses.ROOTS) or any(f"{a} {b}" in text for a, b in licenses.PAIRS), (label, text)
            assert len(text.split()) + 9 <= licenses.REACH  # with the words that declare it


def held(text):
    return any(r in text for r in licenses.ROOTS) or any(f"{a} {b}" in text for a, b in licenses.PAIRS) or bool(re.search(f"(?:{licenses.HEADS}) v?[0-9]", text))


def test_identifiers_pass_the_gate_and_hold_their_keyword():
    short = "(?:mpl 2 0|epl 1 0)"  # in place of the long lists of identifiers before or behind "and" and "or"
    for _, label, keyword, pattern in licenses.identifier_rules():
        for text in samples(PARSER.parse(re.sub(r"\(\?:[^()]{200,}\)", short, pattern))):
            assert keyword in text and len(text.split()) <= licenses.REACH
            assert held(text), text


#: (text, labels): how licenses are named most often, and sentences that name none.
TOLD = (
    ("Licensed under Apache-2.0", "apache-2.0"), ("License: MIT", "mit"), ("MPL-2.0", "mpl-2.0"), ("EPL-2.0", "epl-2.0"), ("WTFPL", "wtfpl"), ("LGPL v2.1+", "lgpl-2.1"), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2.0,mit"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"), ("GPL-3.0-or-later", "gpl-3.0"), ("GPLv2", "gpl-2.0"), ("license = \"BSD-3-Clause\"", "bsd-3-clause"), ("MIT OR Apache-2.0 OR ISC", "apache-2.0,isc,mit"),
    ("SPDX-License-Identifier: LGPL-2.1-only AND MIT AND BSD-2-Clause", "bsd-2-clause,lgpl-2.1,mit"), ("released under the GPL", "gpl"), ("CC-BY-SA-4.0", "cc-by-sa"), ("Creative Commons Attribution 4.0", "cc-by"), ("GNU AGPLv3", "agpl-3.0"),
    ("License: Unlicense", "unlicense"), ("license: ISC", "isc"), ("Mozilla Public License v2.0", "mpl-2.0"), ("Apache License, Version 2.0", "apache,apache-2.0"),
    ("She studied at MIT and works with Ruby or JSON.", ""), ("They entered the house without express written permission of the owner.", ""), ("Acme is a registered trademark of Acme Corp.", ""), ("For example, 2 of them are public.", ""), ("a simple 3 step plan", ""),
    ("Python 2.0 was released in 2000.", ""), ("The research group reserved a table.", ""),
)


def test_common_declarations_and_ordinary_sentences(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOLD)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_digest(docs).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(TOLD)] == list(TOLD)
    assert [brute(t)[0] for t, _ in TOLD] == [x for _, x in TOLD]


def test_every_alternative_is_found(spark):
    rng = random.Random(1)
    texts = ["Released under BSD-3-Clause.", "CC_BY 4.0", "CC/BY-SA", "under CC\nBY", "CC  BY-NC", "This file: 0BSD", "png licence", "All rights are reserved", "Berkeley Software Distribution License", "SPDX-License-Identifier: BSD-3-Clause", "success by", "accby", "nothing", "K\u212aelvin mit \u212aicense"]
    named = len(texts)
    for _, _, pattern in hand_written():
        for text in samples(PARSER.parse(pattern))[:40]:
            mixed = [w.upper() if rng.random() < 0.3 else w for w in text.split()]
            texts.append("".join(w + rng.choice([" ", "-", "_", ".", "\n", " / "]) for w in mixed))
    want = [brute(t) for t in texts]
    assert all(w[1] for w in want[:10] + want[named:]) and not any(w[1] for w in want[10:named])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_digest(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_pieces_of_long_texts_agree_with_whole_ones(spark):
    rng = random.Random(2)
    parts = [t for _, _, x in hand_written() for t in samples(PARSER.parse(x))[:3]] + ["released under the", "this work is licensed under the terms of the", "spdx license identifier", "the", "of", "software"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.choice([30, 300, 900]))) for _ in range(12)]
    texts += [" ".join(["x"] * k + ["this work is licensed under the terms of the mit license"] + ["x"] * 300) for k in range(185, 290, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.labels, r.score) for r in licenses.license_digest(docs).collect()} == {i: brute(t) for i, t in enumerate(texts)}
    places = licenses.licenses(docs.where("doc_id >= 12")).selectExpr("doc_id", "detections[0].first_word as a", "detections[0].end_word as b", "size(detections) as n").collect()
    assert all((r.a, r.b, r.n) == (185 + 7 * (r.doc_id - 12), 185 + 7 * (r.doc_id - 12) + 11, 1) for r in places)


def test_hits_take_time_in_proportion(spark):
    """A hundred thousand hits in one text."""
    docs = spark.createDataFrame([(1, "mit license and apache license 2.0; " * 50_000)], "doc_id long, text string")
    row = licenses.license_digest(docs).first()
    assert (row.n_base, row.labels) == (100_000, "apache,apache-2.0,mit")
