"""License scans and host rules against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from calibrix.llm import host_rules, license_scan
from calibrix.llm.text import mix, span_hash
from tests.llm.conftest import NASTY, SCHEMA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute_scan(text):
    ws = WORD.findall(lower(text or ""))
    at, labels = [], set()
    for p, label in license_scan.BASE_PHRASES.items():
        q = p.split()
        hit = [i for i in range(len(ws)) if ws[i:i + len(q)] == q]
        at += hit
        labels |= {label} if hit else set()
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = [
    "Apache License Apache License, apache  LICENSE!", "cc by cc-by-nc CC BY", "MIT License. GNU General Public License",
    "gnu general public licenses", "xmit license", "mit\nlicense", "écc by", "cc by nc",
    "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH x-exception\nmore",
]


def test_license_scan(spark):
    r = random.Random(1)
    words = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "MIT", "a", "-", "\n"]
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS + [" ".join(r.choices(words, k=40)) for _ in range(80)])]
    got = {x.doc_id: x for x in license_scan.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, _, _ in rows:
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute_scan(t), t
        assert 0 <= x.score <= 1 and set(x.base_labels.split(",")) - {""} <= set(x.labels.split(","))


TAG = re.compile(r"(?<!\w)spdx\W+license\W+identifier(?!\w)[ \t]*:?[ \t]*([^\r\n]*)", re.I | re.A)


def brute_labels(text):
    """Labels by plain search of every phrase, and of single identifiers at tags."""
    line = " " + " ".join(WORD.findall(lower(text))) + " "
    every = {**license_scan.MORE_PHRASES, **license_scan.BASE_PHRASES}
    labels = {label for p, label in every.items() if f" {p} " in line}
    names = [license_scan.label_of(m[1].split()[0]) for m in TAG.finditer(text) if m[1].split()]
    freedom = [license_scan.FREEDOM.get(x, 0.5) for x in [*labels, *names]]
    return ",".join(sorted({*labels, *names})), min(freedom, default=0.0)


def test_own_labels_and_score(spark):
    """Notices, licence bodies and tags, planted in prose, by plain search."""
    r = random.Random(6)
    phrases = [*license_scan.MORE_PHRASES, *license_scan.BASE_PHRASES]
    shown = lambda p: "".join(r.choice([c, c.upper()]) if c != " " else r.choice([" ", ", ", "\n", "-"]) for c in p)
    texts = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
             "xspdx-license-identifier: MIT\nSPDX-License-Identifier: ISC", "spdx-license-identifierx: MIT\nspdx license identifier BSL-1.0",
             "SPDX-License-Identifier: Some-Own-1.0"]
    for _ in range(150):
        parts = [r.choice(["some", "words", "licence", "the", "mit", "gnu", "by"]) for _ in range(30)]
        for _ in range(r.randint(0, 3)):
            parts.insert(r.randrange(31), shown(r.choice(phrases)))
        if r.random() < 0.2:
            parts.append("\nSPDX-License-Identifier: " + r.choice(["MIT", "GPL-3.0-only", "Own-2", "CC-BY-SA-4.0"]) + "\n")
        texts.append(" ".join(parts))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {x.doc_id: (x.labels, x.score) for x in license_scan.license_scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (brute_labels(t)[0], pytest.approx(brute_labels(t)[1])), t
    assert got[0][0] == "mit" and got[1][0] == "isc" and got[2][0] == "bsl-1.0"


def test_labels_of_the_caller(spark):
    df = spark.createDataFrame([(1, "our house rules and the apache license"), (2, "nothing")], "doc_id bigint, text string")
    got = {x.doc_id: x for x in license_scan.license_scan(df, more={"house rules": "house"}).collect()}
    assert got[1].labels == "apache,house" and got[1].score == 0.5 and got[1].n_base == 1 and got[2].labels == ""
    own = {x.doc_id: x for x in license_scan.license_scan(df, base={"house rules": "house"}, more={}).collect()}
    assert own[1].base_labels == own[1].labels == "house" and own[1].n_base == 1


def evaluated(tokens):
    """Expression value by recursive descent (with, and, or: rising looseness)."""
    at = 0

    def atom():
        nonlocal at
        at += 1
        if tokens[at - 1] == "(":
            out = level(0)
            at += 1
            return out
        return license_scan.FREEDOM.get(license_scan.label_of(tokens[at - 1]), 0.5)

    def level(n):
        nonlocal at
        if n == 3:
            return atom()
        out = level(n + 1)
        while at < len(tokens) and tokens[at] == ("or", "and", "with")[n]:
            at += 1
            right = level(n + 1)
            out = (max(out, right), min(out, right), out + (1 - out) / 2)[n]
        return out

    return level(0)


def test_random_expressions_by_descent():
    r = random.Random(8)

    def expression(depth):
        if depth == 0 or r.random() < 0.3:
            return [r.choice(["MIT", "GPL-2.0-only", "Apache-2.0", "CC-BY-NC-4.0", "Own", "MPL-2.0+"])]
        out = [*expression(depth - 1), r.choice(["and", "or", "with"]), *expression(depth - 1)]
        return ["(", *out, ")"] if r.random() < 0.5 else out

    for _ in range(400):
        tokens = expression(4)
        value, _, _ = license_scan.evaluate(license_scan.parse_expression(" ".join(tokens)))
        assert value == pytest.approx(evaluated(tokens)), tokens


def test_license_nasty(nasty, empty):
    rows = license_scan.license_scan(nasty).collect()
    want = Counter((i, *brute_scan(t)) for i, t, _, _ in NASTY)
    assert Counter((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in rows) == want
    assert license_scan.license_scan(empty).count() == 0


@pytest.mark.parametrize("text, postfix, labels", [
    ("MIT", ["MIT"], {"mit"}),
    ("MIT or Apache-2.0 and BSD-3-Clause", ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"], {"mit", "apache", "bsd"}),
    ("(MIT OR GPL-2.0+) AND ISC trailing prose", ["MIT", "GPL-2.0+", "or", "ISC", "and"], {"mit", "gpl", "isc"}),
    ("GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only", "Classpath-exception-2.0", "with"], {"gpl"}),
    ("MIT AND", ["MIT"], {"mit"}),
    ("(MIT", [], set()),
    (") MIT", [], set()),
    ("", [], set()),
])
def test_expressions(text, postfix, labels):
    assert license_scan.parse_expression(text) == postfix
    assert license_scan.evaluate(postfix)[1] == labels


def test_or_is_freer_than_and():
    free = lambda t: license_scan.evaluate(license_scan.parse_expression(t))[0]
    assert free("MIT OR GPL-3.0") == free("MIT") > free("MIT AND GPL-3.0") == free("GPL-3.0")
    assert free("GPL-2.0 WITH x") > free("GPL-2.0")


def brute_rules(t):
    t = t or ""
    ws = SPACED.findall(t)
    tri = Counter(zip(ws, ws[1:], ws[2:]))
    rep = {j for i in range(len(ws) - 2) if tri[tuple(ws[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    failed = len(ws) < 50 or 100 * len(rep) > 50 * len(ws)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), failed)


def test_rules_nasty(nasty, empty):
    rows = host_rules.host_verdicts(nasty).collect()
    got = Counter((x.doc_id, *(x[m] for m in host_rules.MEASURES), x.base_failed) for x in rows)
    assert got == Counter((i, *brute_rules(t)) for i, t, _, _ in NASTY)
    assert not any(x.kept and x.base_failed for x in rows)
    assert host_rules.host_verdicts(empty).count() == 0


def test_bad_host_drops_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short" if i % 10 else good, None, "bad") for i in range(400)]
    rows += [(1000 + 100 * h + i, good if i % 10 else "short", None, f"h{h}") for h in range(5) for i in range(80)]
    got = {x.doc_id: x for x in host_rules.host_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].host_failed and not got[i].kept for i in range(400))
    assert all(got[i].kept == (t == good) for i, t, _, s in rows if s != "bad")


def test_dup_lines_use_the_whole_hash():
    """Two different lines whose hashes agree in their low 40 bits."""
    raw = b"3174483\n2192500"
    buf = np.frombuffer(raw, np.uint8)
    h = mix(span_hash(buf, np.array([0, 8]), np.array([7, 15])) ^ mix(np.zeros(1, np.uint64)))
    assert h[0] != h[1] and (h[0] ^ h[1]) % np.uint64(1 << 40) == 0
    texts = [raw, b"", raw + b"\n" + raw, b"3174483"]
    off = np.cumsum([0, *map(len, texts)])
    dup = host_rules.measure(np.frombuffer(b"".join(texts), np.uint8), off)[3]
    assert dup.tolist() == [0, 0, 2, 0]
