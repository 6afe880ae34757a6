"""Source mixing: targets against plain sharing, fits against enumeration."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrix.llm import mixing


def brute_targets(words):
    """Source (None last) -> target."""
    names = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [None] * (None in words)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(words.values())
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * words[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * words[s]
            left -= out[s]
            free.remove(s)
    return out


def texts(seed, n=400):
    rng = random.Random(seed)
    sources = ["web", "Web", "books", "é", "a", None]
    return [(i, rng.choice([None, "", "x"]) if rng.random() < 0.05 else " ".join(["w"] * rng.randint(1, 90)),
             rng.choices(sources, [40, 20, 5, 3, 10, 2])[0]) for i in range(n)]


SCHEMA = "doc_id bigint, text string, source string"


def words_of(text):
    return len((text or "").split())


@pytest.mark.parametrize("seed", range(2))
def test_targets_and_sums(spark, seed):
    docs = texts(seed)
    words = Counter()
    for _, t, s in docs:
        words[s] += words_of(t)
    goal = brute_targets(words)
    got = mixing.mix(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect()
    assert sorted(r["doc_id"] for r in got) == [d[0] for d in docs]
    by_id, taken = {d[0]: d for d in docs}, Counter()
    for r in got:
        _, text, source = by_id[r["doc_id"]]
        assert (r["source"], r["size"], r["source_size"]) == (source, words_of(text), words[source])
        assert r["target"] == pytest.approx(goal[source])
        assert r["taken"] in {0, r["size"], 2 * r["size"], 3 * r["size"]}
        taken[source] += r["taken"]
    assert sum(goal.values()) == pytest.approx(sum(words.values()))
    for s in words:  # a dozen documents cannot give every sum (small sums: see below)
        few = sum(d[2] == s for d in docs) < 20
        assert abs(taken[s] - goal[s]) <= (2 if few else 0.5 + 1e-9)


@pytest.mark.parametrize("total", [10**6, 5 * 10**8, 2**31 - 4, 2**31, 10**13])
def test_targets_of_any_size(spark, total):
    """Words times a weight may pass 2^31 where the words do not."""
    words = {"a": total // 2, "b": total // 4, "c": total - total // 2 - total // 4}
    goal = brute_targets(words)
    got = mixing.targets(spark.createDataFrame(list(words.items()), "source string, words bigint")).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(goal)


def test_reruns_agree(spark):
    docs = texts(3)
    def run(order, n):
        df = spark.createDataFrame(random.Random(order).sample(docs, len(docs)), SCHEMA).repartition(n)
        return sorted(map(tuple, mixing.mix(df).select("doc_id", "taken").collect()))
    assert run(1, 2) == run(2, 7)
    other = mixing.mix(spark.createDataFrame(docs, SCHEMA), seed=1).select("doc_id", "taken")
    assert sorted(map(tuple, other.collect())) != run(1, 2)


@pytest.mark.parametrize("seed", range(40))
def test_knapsack_is_nearest(seed):
    rng = random.Random(seed)
    sizes = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 5)), reverse=True))
    counts = np.array([rng.randint(1, 3) for _ in sizes])
    budget = rng.randint(0, int((sizes * counts).sum()))
    best = min(abs(int(np.dot(sizes, k)) - budget) for k in itertools.product(*(range(c + 1) for c in counts)))
    for take in (mixing.knapsack(sizes, counts, budget), mixing.fit(sizes, counts, budget)):
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((take * sizes).sum()) - budget) == best


@pytest.mark.parametrize("seed", range(20))
def test_small_sources_repeat_documents(seed):
    rng = random.Random(seed)
    sizes = np.array(sorted(rng.sample(range(1, 40), 3), reverse=True))
    counts = np.array([rng.randint(1, 2) for _ in sizes])
    budget = rng.randint(0, 3 * int((sizes * counts).sum()))
    low = max(budget // int((sizes * counts).sum()) - 1, 0)
    best = min(abs(int(np.dot(sizes, k)) - budget)
               for k in itertools.product(*(range(low * c, 3 * c + 1) for c in counts)))
    times = mixing.copies(sizes, counts, budget)
    assert (times >= 0).all() and (times <= 3 * counts).all()
    assert abs(int((times * sizes).sum()) - budget) == best


def test_fit_shares_large_budgets():
    rng = np.random.default_rng(1)
    sizes = np.arange(5000, 0, -1)
    counts = rng.integers(1, 50, 5000)
    total = int((sizes * counts).sum())
    for budget in (total // 3, total // 2 + 1, total - 7):
        take = mixing.fit(sizes, counts, budget)
        assert (take <= counts).all() and int((take * sizes).sum()) == budget
        large = slice(0, 4000)  # above the part left to the knapsack, sizes give their share
        assert abs((take[large] * sizes[large]).sum() / (counts[large] * sizes[large]).sum() - budget / total) < 0.01
    # Only long documents: the nearest sum.
    assert mixing.fit(np.array([100_000]), np.array([9]), 270_000).tolist() == [3]


def test_one_size_is_selected_in_buckets(spark):
    """A third of the rows of one size, and repeated rows, without one group."""
    docs = [(i, "a b c", "s") for i in range(900)] + [(1000, "a b c", "s")] * 300 + [(i, "w " * 7, "t") for i in range(2000, 2300)]
    rows = mixing.sized(spark.createDataFrame(docs, SCHEMA), "doc_id", "text", "source", 1)
    assert rows.count() == 901 + 300
    placed = rows.withColumn("place", F.when(F.col("source") == "s", 0).otherwise(1).cast("long"))
    quota = spark.createDataFrame([(0, 3, 1200, 1, 500), (1, 7, 300, 0, 299)],
                                  "place long, size long, n long, whole long, extra long")
    for bucket in (10, 4096):
        got = mixing.select(placed, quota, bucket).collect()
        assert len(got) == len(docs)
        assert Counter((r["place"], r["taken"]) for r in got) == {(0, 3): 700, (0, 6): 500, (1, 0): 1, (1, 7): 299}


def test_edge_cases(spark, nasty, empty):
    assert mixing.mix(empty).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)
    assert sorted(tuple(r)[1:] for r in mixing.mix(blank).drop("source").collect()) == [(0, 0, 0.0, 0)] * 2
    got = mixing.mix(nasty).collect()
    assert len(got) == nasty.count()
    assert {r["source"] for r in got} == {"a", "b", "c", "d", None}
