"""Benchmark decontamination against a full alignment of every pair."""

import math
import random
import re
from collections import Counter

import pytest

from calibrix.llm import decontaminate
from tests.llm.conftest import NASTY, SCHEMA

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def toks(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def overlaps(doc, item, window=13, share=0.8):
    d, x = toks(doc), toks(item)
    if len(x) < decontaminate.MIN_ITEM:
        return 0
    w = min(window, len(x))
    best = 0
    for s in range(-len(x) + 1, len(d)):
        same = [0 <= s + j < len(d) and d[s + j] == x[j] for j in range(len(x))]
        best = max(best, *(sum(same[j:j + w]) for j in range(len(x) - w + 1)))
    return best if best >= (w if len(x) < 8 else math.ceil(share * w - 1e-9)) else 0


def brute(rows, items):
    out = []
    for i, t in rows:
        hit = {k: o for k, x in items if k is not None and x is not None and (o := overlaps(t, x))}
        out.append((i, tuple(sorted(hit)), max(hit.values(), default=0)))
    return Counter(out)


def got(df):
    return Counter((x.doc_id, tuple(x["items"]), x.most_matched) for x in df.collect())


def planted(r):
    vocab = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(r.choices(vocab, k=n))) for k, n in enumerate([13, 14, 20, 36, 59, 200, 13, 5, 3, 40])]
    items += [(50, items[2][1]), (None, "a null id " * 5), (51, None), (52, "")]
    rows = []
    for i in range(120):
        t = r.choices(vocab, k=r.randint(0, 120))
        if i % 2:
            x = items[r.randrange(10)][1].split()
            a = r.randrange(max(1, len(x) - 13))
            x = x[a:a + r.randint(10, 40)]
            for _ in range(r.randint(0, 5)):
                x[r.randrange(len(x))] = r.choice(vocab).upper()
            at = r.randrange(len(t) + 1)
            t[at:at] = x
        rows.append((i, ", ".join(t)))
    return rows, items


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 60])
def test_decontaminate(spark, block_words):
    rows, items = planted(random.Random(2))
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = got(decontaminate.decontaminate(docs, bench, block_words=block_words))
    assert found == brute(rows, items)
    assert sum(bool(x[1]) for x in found) > 20


def test_masks_miss_no_window_with_two_substitutions():
    import itertools
    for lost in itertools.combinations(range(13), 2):
        assert any(not any(o + p in lost for p in m) for m in decontaminate.MASKS for o in range(13 - m[-1]))


def test_short_items(spark):
    """Items of 4 to 12 words with each allowed number of replaced words, at all
    places: found; those of under 8 words only unchanged."""
    import itertools
    rows, items = [], []
    for n in range(3, 13):
        words = [f"item{n}word{j}" for j in range(n)]
        items.append((n, " ".join(words)))
        for lost in (c for k in range(4) for c in itertools.combinations(range(n), k)):
            if len(lost) < 3 or sum(lost) % 7 == 0:
                rows.append((len(rows), " ".join(["before", *("x" if j in lost else w for j, w in enumerate(words)), "after"])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = got(decontaminate.decontaminate(docs, bench))
    assert found == brute(rows, items)
    exact = {i for (i, hit, _) in found if hit}
    assert rows[0][0] not in exact and len(exact) > 200  # three words are not searched


def test_result_columns_replace_those_of_the_documents(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "other"), (2, "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "'mine' AS found_items", "doc_id", "'old' AS most_matched", "text", "7 AS h1", "8 AS row")
    bench = spark.createDataFrame([(5, rows[0][1]), (6, "never there at all in any of them")], "item_id bigint, text string")
    for words in (decontaminate.BLOCK_WORDS, 10):
        out = decontaminate.with_overlaps(docs, bench, block_words=words)
        assert out.columns == ["doc_id", "text", "h1", "row", "found_items", "most_matched"]
        assert sorted((x.doc_id, tuple(x.found_items), x.most_matched, x.h1) for x in out.collect()) == [
            (1, (5,), 10, 7), (2, (), 0, 7), (2, (), 0, 7)]


def test_decontaminate_nasty(spark, nasty, empty):
    bench = spark.createDataFrame([(1, "ALPHA beta, gamma delta epsilon zeta eta theta"), (2, "lorem ipsum " * 10)],
                                  "item_id bigint, text string")
    items = [(r.item_id, r.text) for r in bench.collect()]
    short = [r[:2] for r in NASTY if len(r[1] or "") < 1000]
    out = got(decontaminate.decontaminate(nasty, bench))
    assert {k: v for k, v in out.items() if k[0] not in (5, 6)} == dict(brute(short, items))
    assert {k[1] for k in out if k[0] in (5, 6)} == {(2,)}
    assert decontaminate.decontaminate(empty, bench).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(not x.contaminated for x in decontaminate.decontaminate(nasty, none).collect())
