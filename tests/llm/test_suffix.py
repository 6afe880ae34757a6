"""Run-length index and suffix dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from calibrix.llm import suffix_dedup
from calibrix.llm.run_index import RunIndex, later_matches
from tests.llm.conftest import NASTY, SCHEMA


def joined(strings):
    lens = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lens) - lens, lens


def random_strings(r, alphabet):
    base = bytes(r.choices(alphabet, k=260))
    out = []
    for _ in range(r.randint(1, 12)):
        a = r.randrange(150)
        s = bytearray(base[a:a + r.randint(0, 168)])
        for _ in range(r.randint(0, 2)):
            if s:
                s[r.randrange(len(s))] = r.choice(alphabet)
        out.append(bytes(s))
    return out


def test_later_matches():
    r = random.Random(1)
    for _ in range(150):
        reach = r.choice([7, 8, 13, 14, 28, 29, 100])
        strings = random_strings(r, r.choice([b"ab", b"abc", bytes(range(3)), b"a"]))
        seen, want = set(), set()
        for i, s in enumerate(strings):
            for o in range(len(s) - reach + 1):
                if s[o:o + reach] in seen:
                    want.add((i, o))
                seen.add(s[o:o + reach])
        a, b = later_matches(*joined(strings), reach)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_locate_and_compression():
    strings = [b"the quick brown fox jumps over it"] * 50 + [b"the quick brown fox jumped"]
    buf, starts, lens = joined(strings)
    index = RunIndex(buf, starts, lens, 10)
    assert index.runs < len(buf) / 5  # repetitive text makes few runs
    text = b"".join(s + b"\0" for s in strings)
    suffixes = sorted(range(len(text)), key=lambda i: (text[i:text.index(b"\0", i)], i))
    for row in range(len(strings), len(text), 37):
        assert index.locate(row) == suffixes[row]


def brute(rows, reach):
    """Windows by (null first, id, text hash order is only for equal ids)."""
    order = sorted({(i is not None, i or 0, (t or "").encode()) for i, t in rows})
    first = {}
    for d in order:
        for o in range(len(d[2]) - reach + 1):
            first.setdefault(d[2][o:o + reach], (d, o))
    out = []
    for i, t in rows:
        d = (i is not None, i or 0, (t or "").encode())
        gone = bytearray(len(d[2]))
        for o in range(len(d[2]) - reach + 1):
            if first[d[2][o:o + reach]] != (d, o):
                gone[o:o + reach] = b"\1" * reach
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(gone), sum(gone), spans, bytes(b for b, g in zip(d[2], gone, strict=True) if not g)))
    return Counter(out)


def got(df):
    return Counter((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in df.collect())


def corpus(seed):
    """Copies, near copies, shared passages with varying edges, periods."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeé", k=r.randint(1, 8))) for _ in range(200)]
    prose = lambda n: " ".join(r.choices(vocab, k=n))
    passage, texts = prose(40), []
    for i in range(70):
        t = prose(r.randint(0, 60))
        if i % 3 == 0:
            t = t[:r.randrange(len(t) + 1)] + passage + prose(10)
        if i % 7 == 0 and texts:
            t = texts[r.randrange(len(texts))]
        if i % 5 == 0 and texts:
            w = texts[r.randrange(len(texts))].split(" ")
            w[r.randrange(len(w))] = "edit"
            t = " ".join(w)
        if i % 11 == 0:
            t += "xyz " * r.randint(0, 120)
        if i % 13 == 0:  # a period that repeats inside one segment
            t += prose(4) * 6
        texts.append(t)
    return texts


@pytest.mark.parametrize("reach, hot", [(100, suffix_dedup.HOT), (100, 3), (40, suffix_dedup.HOT)])
def test_suffix_dedup(spark, monkeypatch, reach, hot):
    monkeypatch.setattr(suffix_dedup, "PIECE", 2000)
    texts = corpus(reach + hot)
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    found = got(suffix_dedup.suffix_dedup(df, reach=reach, hot=hot))
    assert found == brute(list(enumerate(texts)), reach)
    assert sum(x[2] > 0 for x in found) > 10


def test_suffix_nasty(nasty, empty):
    small = nasty.filter("text is null or length(text) < 10000")
    rows = [r[:2] for r in NASTY if len(r[1] or "") < 10000]
    assert got(suffix_dedup.suffix_dedup(small, reach=40)) == brute(rows, 40)
    rows = {x[0]: x for x in got(suffix_dedup.suffix_dedup(nasty))}
    # A long text of one period keeps its first 100 + 11 bytes of each pattern.
    assert rows[6][1] == 106_005 and rows[6][2] >= 105_900 and rows[5][2] > 100_000
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3, 1])
def test_repeated_rows_are_one_document(spark, monkeypatch, hot):
    """Rows of the same id and text keep what occurs in them first, alike."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    texts = corpus(9)[:24]
    alone = " ".join(f"only{i} here{i * i}" for i in range(60))
    rows = [(0, alone), (0, alone), (1, texts[0]), (None, alone[50:600]), (None, alone[50:600]), (90, alone[300:] + texts[1]),
            (91, "xyz " * 90), (91, "xyz " * 90), (92, "z" * 400), (92, "z" * 400), (92, "z" * 400)]
    rows += [(i + 2, t) for i, t in enumerate(texts)] + [(i + 2, t) for i, t in enumerate(texts) if i % 3 == 0]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA).repartition(5)
    assert got(suffix_dedup.suffix_dedup(df, hot=hot)) == brute(rows, 100)
    twins = [(5, alone), (5, alone)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in twins], SCHEMA).repartition(2)
    assert [x.n_removed for x in suffix_dedup.suffix_dedup(df, hot=hot).collect()] == [0, 0]


def test_a_passage_of_many_documents_sends_few_records(spark, monkeypatch):
    """A third of the rows share a passage: each group of pieces sends its
    segments to their anchors' tasks once, the copies go as notes of their pieces."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 2000)
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(30))
    texts = [" ".join([word(), *([passage] if i % 3 == 0 else [word() for _ in range(30)]), word()]) for i in range(600)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(2)
    packed = suffix_dedup.pack(df, "doc_id", "text").persist()
    tasks = 16
    rows = suffix_dedup.anchor_rows(packed, 100, tasks).collect()
    seen, groups = Counter(), -(-packed.count() // suffix_dedup.GROUP) + packed.rdd.getNumPartitions()
    for x in rows:
        if not x.settled:
            for s in suffix_dedup._unpack(x.rows, suffix_dedup.ANCHORS):
                seen[s["h"], s["s"]] += 1
    assert max(seen.values()) <= groups < 40 < 200
    settled = [suffix_dedup._unpack(x.rows, suffix_dedup.NOTES) for x in rows if x.settled]
    assert sum(map(len, settled)) > 200 and {x.task for x in rows if x.settled} <= set(range(tasks))
    packed.unpersist()
    assert got(suffix_dedup.suffix_dedup(df)) == brute(list(enumerate(texts)), 100)


def test_copies_compare_both_hashes():
    x = np.zeros(4, suffix_dedup.ANCHORS)
    x["h"], x["s"], x["id"] = [7, 7, 9, 7], [1, 1, 1, 2], [3, 1, 0, 2]
    x["some"] = 1
    assert suffix_dedup._copies(x).tolist() == [0]  # equal to the second, which is earlier
