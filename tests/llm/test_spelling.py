"""Spelling variants against pairwise comparison."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from calibrix.llm import spelling


def brute_words(docs, min_count):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= min_count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    out, form = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(near)
    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, out[w], words.get(form[w])) for w, n in words.items()}


def rows(df):
    found = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(set(found)) == len(found)
    return set(found)


def corpus(seed, n=260):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 9))) for _ in range(14)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = stems[min(int(rng.expovariate(0.4)), 13)]
            for _ in range(rng.choices([0, 1, 2], [12, 3, 1])[0]):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abé") + w[at:], w[:at] + "c" + w[at + 1:]])
            words.append(rng.choice([w, w.upper(), w.capitalize()]))
        out.append((i, rng.choice([" ", "-", "\n", "9"]).join(words)))
    # A chain of forms: counts of about 200, 35 and 6.
    return out + [(1000 + i, "zyxwvu " * 200 + "zyxwvut " * 35 + "zyxwvuts " * 6) for i in range(1)]


def test_equals_pairwise_comparison(spark):
    docs = corpus(1)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    expected = brute(brute_words(docs, 5))
    assert sum(r[1] is not None for r in expected) > 50
    assert any(r[1] is not None and r[1] != r[2] for r in expected)  # a chain of forms
    assert rows(spelling.spelling_forms(df)) == expected
    # Blocks of any number of parts give the same.
    assert rows(spelling.spelling_forms(df, chunk=3)) == expected


def test_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [tuple(r) for r in t.select("doc_id", "text").collect()]
    assert rows(spelling.spelling_forms(t)) == brute(brute_words(docs, 5))


def test_index_follows_zero_and_one_errors():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(90)})
    index = spelling.PositionIndex(words)
    for q in [*words, "", "abababab", "zz"]:
        same, longer, shorter, alike = index.near(q, len(q) // 2)
        got = {w for i, w in enumerate(words) if (same | longer | shorter) >> i & 1}
        assert got == {w for w in words if one_apart(q, w)}
        for bits, n in ((same, len(q)), (longer, len(q) + 1), (shorter, len(q) - 1)):
            assert all(len(w) == n for i, w in enumerate(words) if bits >> i & 1)
        if same | longer | shorter:
            assert {w for i, w in enumerate(words) if alike >> i & 1} == {w for w in words if w[:len(q) // 2] == q[:len(q) // 2]}


def test_tasks_hold_a_part_of_a_hot_block(spark):
    """Words of one start: no part has more than about a chunk of either kind."""
    words = [("aaaaaa" + chr(97 + i) + chr(97 + j), 5) for i in range(26) for j in range(26)]
    df = spark.createDataFrame(words, "word string, n bigint")
    parts = spelling.blocks(df, chunk=100).filter("side = 0").groupBy("base", "part", "i", "j").agg(
        F.count_if("asks").alias("asks"), F.count_if("asked").alias("asked"))
    assert parts.filter("base = 8").count() == 49
    assert parts.agg(F.max("asks"), F.max("asked")).first()[0] < 160
    got = {r["word"]: r["n_near"] for r in spelling.near_words(df, chunk=100).collect()}
    assert got == {w: 50 for w, _ in words}


def test_edge_cases(spark, nasty, empty):
    assert spelling.spelling_forms(empty).collect() == []
    found = rows(spelling.spelling_forms(nasty, min_count=1))
    docs = [tuple(r) for r in nasty.select("doc_id", "text").collect()]
    long = {"x" * 70_000, "x" * 69_999}
    assert {r for r in found if r[0] not in long} == {
        r for r in brute({w: n for w, n in brute_words(docs, 1).items() if w not in long})}
