"""License scans: tags and notice phrases by Aho-Corasick, expressions by a
shunting-yard parser.

Every whole text is lower-cased (A-Z), cut into words and rejoined with single
spaces; one automaton over all phrases and the identifier tag then reads it
once. At each identifier tag the raw text that follows is parsed as a licence
expression (``and``, ``or``, ``with``, parentheses, ``+``) by shunting-yard
and evaluated.

The notices are names of licences and sentences of their bodies; a label that
``FREEDOM`` does not know counts ``UNKNOWN_FREEDOM``.

Cases: a null or empty text has no word, no place, empty labels and score 0;
places may overlap and all count; repeated rows give repeated results; extra
columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.llm.text import batch_limits, pieces

# Fixed by the contract.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# The scan's own notices.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution sharealike": "cc-by-sa",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "european union public licence": "eupl",
    "microsoft public license": "ms-pl",
    "open font license": "ofl",
    "open database license": "odbl",
    # Bodies that stand without the licence's name.
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "this is free and unencumbered software released into the public domain": "public-domain",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
TAG = "spdx license identifier"
# How freely a text under a licence may be used, 0 to 1 (unknown ids: 0.5).
FREEDOM = {
    "mit": 1.0, "apache": 0.95, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0,
    "cc-by": 0.9, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2,
    "cc-by-sa": 0.4, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0,
    "bsl": 1.0, "zlib": 1.0, "artistic": 0.6, "eupl": 0.5, "ms-pl": 0.6, "ofl": 0.8, "odbl": 0.5,
}
UNKNOWN_FREEDOM = 0.5

# Words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))
# The tag stands as words: not inside or at the end of longer ones.
_TAG_AT = re.compile(rb"(?<![0-9a-z\x80-\xff])spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier"
                     rb"(?![0-9a-z\x80-\xff])[ \t]*:?[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.:\-]*\+?)")
_PREC = {"or": 1, "and": 2, "with": 3}

SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
          "base_labels string, labels string, score double, expressions array<string>")


def label_of(name: str) -> str:
    """Family label of a licence identifier: GPL-3.0-only -> gpl."""
    x = name.lower().rstrip("+")
    for key in ("agpl", "lgpl", "gpl", "apache", "mpl", "epl", "bsd", "isc", "mit", "cc0",
                "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "unlicense"):
        if x == key or x.startswith(key + "-"):
            return "public-domain" if key == "unlicense" else key
    return x


def parse_expression(text: str) -> list[str]:
    """Postfix form of the longest expression at the start of ``text``.

    Shunting-yard over identifiers, ``and``/``or``/``with`` (that order of
    precedence, rising) and parentheses. Reading ends where the grammar does;
    an operator or parenthesis left open there is dropped.
    """
    tokens, pos, want, depth = [], 0, True, 0
    good = 0  # tokens up to the last place where the expression could end
    while m := _TOKEN.match(text, pos):
        t = m[1]
        op = t.lower() if t.lower() in _PREC else None
        if want and t == "(":
            depth += 1
        elif want and op is None and t != ")":
            want = False
        elif not want and op:
            want = True
        elif not want and t == ")" and depth:
            depth -= 1
        else:
            break
        tokens.append(op or t)
        if not want and not depth:
            good = len(tokens)
        pos = m.end()
    out: list[str] = []
    stack: list[str] = []
    for t in tokens[:good]:
        if t == "(":
            stack.append(t)
        elif t == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif t in _PREC:
            while stack and stack[-1] != "(" and _PREC[stack[-1]] >= _PREC[t]:
                out.append(stack.pop())
            stack.append(t)
        else:
            out.append(t)
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[float, set[str], str]:
    """(freedom, labels, text): ``or`` offers the freer side, ``and`` binds to
    the stricter one, an exception (``with``) frees half of what is missing."""
    stack: list[tuple[float, set[str], str]] = []
    for t in postfix:
        if t not in _PREC:
            lab = label_of(t)
            stack.append((FREEDOM.get(lab, UNKNOWN_FREEDOM), {lab}, t))
            continue
        b, a = stack.pop(), stack.pop()
        text = f"({a[2]} {t.upper()} {b[2]})"
        if t == "or":
            stack.append((max(a[0], b[0]), a[1] | b[1], text))
        elif t == "and":
            stack.append((min(a[0], b[0]), a[1] | b[1], text))
        else:
            stack.append((a[0] + (1 - a[0]) / 2, a[1], text))
    return stack[0] if stack else (0.0, set(), "")


def automaton(phrases) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p, label in phrases.items():
        a.add_word(f" {p} ", (p, label))
    a.make_automaton()
    return a


def scan_text(raw: bytes, auto, base: dict[str, str]) -> tuple:
    words = raw.translate(_FOLD).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    n_base, first, last = 0, None, None
    base_labels: set[str] = set()
    labels: set[str] = set()
    seen, at = 0, 0  # words before position `at`
    tagged = False
    places = sorted((end - len(p) - 1, p, label) for end, (p, label) in auto.iter(line))
    for start, p, label in places:
        seen += line.count(" ", at, start)
        at = start
        if label is None:
            tagged = True
        elif p in base:
            n_base += 1
            first = seen if first is None else first
            last = seen
            base_labels.add(label)
        labels.add(label)
    labels.discard(None)
    freedom = [FREEDOM.get(x, UNKNOWN_FREEDOM) for x in labels]
    expressions = []
    if tagged:
        for m in _TAG_AT.finditer(raw):
            value, names, text = evaluate(parse_expression(m[1].decode("utf-8", "replace")))
            if names:
                labels |= names
                freedom.append(value)
                expressions.append(text)
    return (len(words), n_base, first, last, ",".join(sorted(base_labels)),
            ",".join(sorted(labels)), min(freedom, default=0.0), expressions)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 base: dict[str, str] | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: words, places of base phrases, labels, the score
    (freedom of the strictest licence found, 0 if none) and the expressions
    found at identifier tags. No shuffle; texts are read whole, once."""
    base = BASE_PHRASES if base is None else base
    more = MORE_PHRASES if more is None else more
    batch_limits(docs.sparkSession)

    def run(batches):
        auto = automaton({**more, **base, TAG: None})
        for rows, buf, off in pieces(batches, "_text"):
            data = buf.tobytes()
            found = [scan_text(data[off[i]:off[i + 1]], auto, base) for i in range(len(off) - 1)]
            cols = list(zip(*found, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                 "score", "expressions"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
            .mapInArrow(run, SCHEMA))
