"""Quality classifier: fitting, held-out accuracy, edge rows."""

import random
import zlib

import numpy as np

from calibrix.llm import quality_classifier as q
from tests.llm.conftest import SCHEMA


def corpus(n=500, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        ws = r.choices(vocab, k=r.randint(20, 80))
        good = i % 4 != 0
        if not good:
            ws = [w + r.choice(["***", "$$$", "###"]) for w in ws] if i % 8 else [w.upper() + "!!" for w in ws]
        rows.append((i, " ".join(ws), None, None))
        if i % 3:
            labels.append((i, int(good), 0))
    return rows, labels


def test_features_are_sorted_indicators():
    texts = [b"One two two, three!!", b"", b"  ", b"one"]
    off = np.cumsum([0, *map(len, texts)])
    ids, first = q.features(np.frombuffer(b"".join(texts), np.uint8), off)
    cut = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert all(x == sorted(set(x)) and x for x in cut)
    assert cut[1] == cut[2] and len(cut[1]) == 1
    alone, _ = q.features(np.frombuffer(texts[0], np.uint8), np.array([0, len(texts[0])]))
    assert alone.tolist() == cut[0]  # a text's features do not depend on its neighbours


def test_descent_separates_and_balances():
    r = np.random.default_rng(0)
    y = np.where(np.arange(200) < 30, -1, 1)
    rows = [np.unique(np.append(r.integers(20, 200, 12), 3 if s > 0 else 5)) for s in y]
    ids, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    pos = np.bincount(ids[np.repeat(y > 0, np.diff(first))], minlength=200).astype(float)
    neg = np.bincount(ids[np.repeat(y < 0, np.diff(first))], minlength=200).astype(float)
    ratio = q.log_ratio(pos, neg)
    assert ratio[3] > 0 > ratio[5]
    w, b = q.descend(ids, first, y, ratio)
    assert (np.sign(q.margins(ids, first, ratio, w, b)) == y).mean() > 0.97


def test_held_out_rows(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", q.held_out().alias("h"))
    assert {x.doc_id for x in df.collect() if x.h} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_classifier_on_held_out(spark, nasty, empty):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame([*labels, (None, 1, 0), (2, None, 0), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")
    train = q.labelled(docs, known)
    assert {x.doc_id for x in train.select("doc_id").collect()} == {
        i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5}
    for sample in (q.SAMPLE, 150):  # the bound may be under the number of rows
        rows = q.labelled(docs, known, sample=sample)
        assert sample > 150 or 90 < rows.count() < 210
        model = q.train_model(rows)
        got = {x.doc_id: x for x in q.score(docs, model).collect()}
        held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
        assert np.mean([got[i].predicted == (i % 4 != 0) for i in held]) > 0.95
        assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got.values())
    assert len(q.score(nasty, model).collect()) == nasty.count()
    assert q.score(empty, model).count() == 0
    twice = [x.score for x in q.score(nasty, model).filter("doc_id = 3").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_no_labels(spark, nasty, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert q.train_model(q.labelled(nasty, none)) is None
    assert {(x.score, x.predicted) for x in q.score(nasty, None).collect()} == {(0.5, 1)}
    one = spark.createDataFrame([(3, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert q.train_model(q.labelled(nasty, one)) is None
    assert q.train_model(q.labelled(empty, one)) is None


def test_ratios_come_from_all_labelled_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    texts, count = dict(r[:2] for r in rows), np.zeros((2, q.DIMENSIONS))
    for i, good, _ in labels:
        if zlib.crc32(str(i).encode()) % 5:
            raw = texts[i].encode()
            count[good][q.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]] += 1
    want = q.log_ratio(count[1], count[0])
    assert np.allclose(q.learn(docs, known, sample=150)["ratio"], want)
    assert not np.allclose(q.train_model(q.labelled(docs, known, sample=150))["ratio"], want)


def dual_optimum(x, y, upper, steps=60_000):
    """Dual of the balanced hinge loss by projected gradient on the dense Gram
    matrix (with the intercept as a feature of its own)."""
    x = np.column_stack([x, np.ones(len(y))])
    k = (y[:, None] * x) @ (y[:, None] * x).T
    rate, alpha = 1 / np.linalg.eigvalsh(k).max(), np.zeros(len(y))
    for _ in range(steps):
        alpha = np.clip(alpha - rate * (k @ alpha - 1), 0, upper)
    w = (alpha * y) @ x
    return w[:-1], w[-1], alpha.sum() - alpha @ k @ alpha / 2


def test_descent_reaches_the_optimum():
    """Weights, intercept and duality gap against a dense solver."""
    r = np.random.default_rng(4)
    y = np.where(np.arange(60) % 5 == 0, -1, 1)
    rows = [np.unique(r.integers(0, 25, 9)) for _ in y]
    ids, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    ratio = r.normal(size=25)
    dense = np.zeros((len(y), 25))
    for i, at in enumerate(rows):
        dense[i, at] = ratio[at] / np.linalg.norm(ratio[at])
    upper = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    w, b, dual = dual_optimum(dense, y, upper)
    weights, bias = q.descend(ids, first, y, ratio, epochs=3000)
    assert np.allclose(weights, w * ratio, atol=0.02) and abs(bias - b) < 0.02
    plain = weights / ratio
    primal = (plain @ plain + bias**2) / 2 + (upper * np.maximum(0, 1 - y * (dense @ plain + bias))).sum()
    assert 0 <= primal - dual + 1e-6 < 0.01 * dual


def test_scores_by_plain_sums(spark):
    rows, labels = corpus(160)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = q.learn(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {x.doc_id: x for x in q.score(docs, model).collect()}
    for i, text, _, _ in rows:
        raw = text.encode()
        ids = q.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
        norm = max(sum(model["ratio"][f] ** 2 for f in ids), 1e-12) ** 0.5
        z = model["slope"] * (sum(model["weights"][f] for f in ids) / norm + model["bias"]) + model["offset"]
        want = 1 / (1 + np.exp(-z))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == (got[i].score >= 0.3)
