"""Quality classifier: naive-Bayes scaled n-gram indicators and a linear
hinge-loss model fitted by dual coordinate descent (NB-SVM).

Features of a whole text: indicators of n-grams over two readings of each
word, its spelling (single words) and its shape (kinds of characters, last
character, length class, equal to the word before; one and two words), the
latter also by share of the text's words (at least 1, 1/2, 1/4, ...), hashed
to ``DIMENSIONS``. Labels, language, source and id are never inputs.

Class log-count ratios come from all labelled training rows: labels meet texts
by id, a task counts the features of its texts itself, and a grouped sum of at
most ``DIMENSIONS`` rows remains, so no features are shuffled. The descent uses
a bounded sample of about ``SAMPLE`` labelled rows, taken by a hash of the id
(all of them if there are fewer), whose ids are broadcast; it runs in one task,
and a logistic curve fitted on sampled rows left out of the descent turns
margins into scores. Every document is scored.

Cases: a null or empty text has the one feature "no words" and a score like
any other; training rows without a label are left out; without rows of both
classes every score is 0.5; repeated rows give repeated results; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.llm.text import (batch_limits, lowered, mix, owner_of, pieces, ranges, span_hash,
                               word_bounds)
from calibrix.session import materialize

DIMENSIONS = 1 << 18
# Bound of the labelled rows that the descent runs on (documented parameter).
SAMPLE = 20_000
THRESHOLD = 0.3

# Words of a shape n-gram at most, and the classes of its share of the words.
SHAPE_WORDS = 2
SHARES = 7


def _kind(b: int) -> int:
    """Kinds of characters, one bit each."""
    c = chr(b)
    if b >= 128:
        return 8
    if c.isspace() and b < 0x1C or b == 0x20:
        return 0
    return 1 if c.islower() else 2 if c.isupper() else 4 if c.isdigit() else 16 if c in ".,;:'\"?-()" else 32


_KIND = np.array([_kind(b) for b in range(256)], np.uint8)
# The last character: its place in a list of marks, 0 for any other.
_LAST = np.array([".,;:'\"?-()!*#$%&|<>@+=/_~^[]{}".find(chr(b)) + 1 for b in range(256)], np.uint64)


def shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, same: np.ndarray) -> np.ndarray:
    """A 15-bit code of each word's shape."""
    kinds = np.bitwise_or.reduceat(_KIND[buf], starts).astype(np.uint64)
    length = np.minimum(np.log2(ends - starts).astype(np.uint64), np.uint64(7))
    return (kinds | _LAST[buf[ends - 1]] << np.uint64(6) | length << np.uint64(11)
            | same.astype(np.uint64) << np.uint64(14))


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): sorted distinct feature ids of each text."""
    n = len(off) - 1
    starts, ends, first = word_bounds(buf, off)
    words = np.diff(first)
    top = np.uint64(32)
    packed = [np.arange(n, dtype=np.uint64) << top
              | mix(np.minimum(words, 1).astype(np.uint64) + np.uint64(77)) % np.uint64(DIMENSIONS)]
    if len(starts):
        owner = owner_of(first).astype(np.uint64)
        spelling = span_hash(lowered(buf), starts, ends)
        packed.append(owner << top | spelling % np.uint64(DIMENSIONS))
        same = np.zeros(len(starts), bool)
        same[1:] = (spelling[1:] == spelling[:-1]) & (owner[1:] == owner[:-1])
        shape = shapes(buf, starts, ends, same)
        for k in range(1, SHAPE_WORDS + 1):
            m = len(shape) - k + 1
            if m <= 0:
                break
            code = owner[:m]
            for j in range(k):
                code = code << np.uint64(15) | shape[j:m + j]
            code = np.sort(code[owner[:m] == owner[k - 1:]])
            at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            count = np.diff(np.append(at, len(code)))
            code = code[at]
            o = code >> np.uint64(15 * k)
            g = mix((code & np.uint64((1 << 15 * k) - 1)) + np.uint64(k << 50))
            share = count / np.maximum(words[o.astype(np.int64)], 1)
            for level in range(SHARES + 1):  # the last is the plain indicator
                has = share >= 2.0 ** -level if level < SHARES else np.ones(len(g), bool)
                packed.append(o[has] << top | mix(g[has] + np.uint64(level)) % np.uint64(DIMENSIONS))
    packed = np.sort(np.concatenate(packed))
    packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])] if len(packed) else packed
    return ((packed & np.uint64(0xFFFFFFFF)).astype(np.uint32),
            np.searchsorted(packed, np.arange(n + 1, dtype=np.uint64) << top))


def log_ratio(pos: np.ndarray, neg: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Naive-Bayes log-count ratio of each feature (0 where it never occurs)."""
    p, q = pos + smooth, neg + smooth
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where(pos + neg > 0, r, 0.0)


def descend(ids: np.ndarray, first: np.ndarray, y: np.ndarray, ratio: np.ndarray, cost: float = 1.0,
            epochs: int = 10, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights of the plain indicators, intercept) of the hinge-loss model
    over rows r * x / |r * x|, by dual coordinate descent with random order."""
    values = ratio[ids]
    row = owner_of(first)
    norm = np.sqrt(np.maximum(np.bincount(row, values * values, len(y)), 1e-12))
    values = values / norm[row]
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(y))
    # Balance the classes, so the rare one is not given up.
    upper = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1))) * cost
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            a, b = first[i], first[i + 1]
            at, x = ids[a:b], values[a:b]
            gradient = y[i] * (w[at] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])  # |x|^2 + 1 for the intercept
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(step))
                w[at] += step * x
                bias += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return w * ratio, bias


def margins(ids: np.ndarray, first: np.ndarray, ratio: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    row, n = owner_of(first), len(first) - 1
    norm = np.sqrt(np.maximum(np.bincount(row, ratio[ids] ** 2, n), 1e-12))
    return np.bincount(row, weights[ids], n) / norm + bias


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps (targets smoothed)."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([m, np.ones_like(m)])
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (p - t) + 1e-6 * beta
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(ids: np.ndarray, first: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> dict:
    """Model from sampled rows: four fifths for the descent, the rest for the curve."""
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    take = np.flatnonzero(~held)
    lens = np.diff(first)
    sub = ids[ranges(first[take], lens[take])]
    weights, bias = descend(sub, np.concatenate([[0], np.cumsum(lens[take])]), y[take], ratio)
    m = margins(ids, first, ratio, weights, bias)
    slope, offset = logistic(m[held] if held.any() else m, y[held] if held.any() else y)
    return {"weights": weights, "bias": bias, "slope": slope, "offset": offset}


def featurised(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(doc_id, ids binary: unsigned 32-bit feature ids, further columns)."""
    batch_limits(docs.sparkSession)
    names = ["doc_id", *more]

    def run(batches):
        for rows, buf, off in pieces(batches, "_text", 1 << 20):
            ids, first = features(buf, off)
            cut = [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(i) for i in range(len(names))), pa.array(cut, pa.binary())], [*names, "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c) for c in more),
                         F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([*source.drop("_text").schema.fields, T.StructField("ids", T.BinaryType())])
    return source.mapInArrow(run, schema)


def class_counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class with each feature, summed over all training rows.

    A task adds up its own rows first; what is grouped and collected is bounded
    by ``DIMENSIONS``, whatever the number of rows."""

    def run(batches):
        count = np.zeros((2, DIMENSIONS), np.int64)
        for b in batches:
            y = np.asarray(b.column(0))
            for side in (0, 1):
                raw = b"".join(b.column(1).filter(pa.array(y == side)).to_pylist())
                count[side] += np.bincount(np.frombuffer(raw, np.uint32), minlength=DIMENSIONS)
        at = np.flatnonzero(count.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[0, at]), pa.array(count[1, at])],
                                         ["f", "n0", "n1"])

    rows = (train.select("y", "ids").mapInArrow(run, "f bigint, n0 bigint, n1 bigint")
            .groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas())
    neg, pos = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    neg[rows.f.to_numpy()], pos[rows.f.to_numpy()] = rows.n0, rows.n1
    return pos, neg


def train_model(train: DataFrame, every: DataFrame | None = None) -> dict | None:
    """The model from the bounded rows (doc_id, y 0/1, ids) of ``labelled``,
    with the class counts of all labelled rows if ``every`` has them; None
    without rows of both classes."""
    per_class = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (per_class.get(0) and per_class.get(1)):
        return None
    pos, neg = class_counts(train if every is None else every)
    ratio = log_ratio(pos, neg)

    def run(batches):
        got = [(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches]
        rows = sorted((i, y) for ys, ids in got for y, i in zip(ys, ids, strict=True))
        rows = [rows[k] for k in np.random.default_rng(3).permutation(len(rows))]
        first = np.cumsum([0, *(len(i) // 4 for i, _ in rows)])
        model = fit(np.frombuffer(b"".join(i for i, _ in rows), np.uint32), first,
                    np.array([1 if y else -1 for _, y in rows]), ratio)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model["weights"].tobytes()], pa.binary()),
             *(pa.array([model[k]], pa.float64()) for k in ("bias", "slope", "offset"))],
            ["weights", "bias", "slope", "offset"])

    # One task for the bounded sample; what comes back is the weight vector.
    row = (train.select("y", "ids").repartition(1)
           .mapInArrow(run, "weights binary, bias double, slope double, offset double").collect()[0])
    return {"weights": np.frombuffer(row["weights"], np.float64), "ratio": ratio,
            "bias": row["bias"], "slope": row["slope"], "offset": row["offset"]}


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept columns, score, predicted) per input row; one pass, no shuffle."""
    spark = docs.sparkSession
    batch_limits(spark)
    if model is None:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c) for c in keep),
                           F.lit(0.5).alias("score"), F.lit(int(0.5 >= threshold)).alias("predicted"))
    shared = spark.sparkContext.broadcast(model)  # 2 vectors of DIMENSIONS doubles
    names = ["doc_id", *keep]

    def run(batches):
        m = shared.value
        for rows, buf, off in pieces(batches, "_text", 1 << 20):
            ids, first = features(buf, off)
            z = m["slope"] * margins(ids, first, m["ratio"], m["weights"], m["bias"]) + m["offset"]
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(i) for i in range(len(names))), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                [*names, "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c) for c in keep),
                         F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([*source.drop("_text").schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    return source.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id's text, modulo 5, is 0 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", sample: int | None = SAMPLE) -> DataFrame:
    """About ``sample`` training rows (doc_id, y, ids), or with None all of
    them: labelled, not held out."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("y"))
             .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id"))
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    if sample is not None:
        total = known.count()
        if total > sample:
            place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
            known = known.filter(place < sample / total)
        # The sample's ids and labels: about `sample` rows of 12 bytes.
        known = F.broadcast(known)
    else:  # one plan at any size: what a small table takes tells what a large one will
        known = known.hint("merge")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = own.join(known, "doc_id")
    return featurised(rows, "doc_id", "text", "y").select("doc_id", "y", "ids")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> dict | None:
    """The model of the labelled rows: counts of all, descent on the sample."""
    args = (docs, labels, id_col, text_col, label_col)
    return train_model(materialize(labelled(*args, sample=sample)), labelled(*args, sample=None))
