"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds its distinct word shingles (64-bit hashes). Documents
of equal sets form a class, so exact copies cost one grouped minimum; a class
has an 8-byte id from then on. Of each class ``HASHES`` MinHash values are banded
(``BANDS`` x ``ROWS``; a pair at the threshold 0.8 shares no band with probability
3e-6), and candidates meet in two rounds:

1. in every band bucket, each member against the bucket's first class; then,
   where members of a bucket are still in different components, against the
   bucket's class with the most links (``HUBS`` times);
2. in buckets that are still open, the members outside the first class's
   component against all members of other components, in blocks: first by their
   signatures, which names the members with a plausible partner, then these by
   their full sets. Buckets whose first classes are in one component are taken
   together, so a member is sent once and not once a bucket.

A comparison reads the signatures batch by batch and drops the pair once the
posterior probability of reaching the threshold is under ``MISS``; survivors
are confirmed on their full sets, rebuilt from the whole texts. In round 2 the
sets meet inside the block, whose members and bytes are bounded, and a member
stops at its first link to a component: what leaves a block is at most one link
for each member and component, not the pairs. So a bucket of n copies
that are alike costs n comparisons, and every pair of a bucket is either in one
component or compared. Components are minimum labels.

Cases: null, empty and word-less texts have an empty set and are linked with
nothing; a text shorter than a shingle is one shingle; a very long text is one
row of its task and one set of a block; rows may repeat and ids may be null (a
null id never names a component that has another); extra columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.llm.components import components, merge
from calibrix.llm.scratch import Scratch
from calibrix.llm.text import (batch_limits, lowered, mix, ngram_hash, owner_of, pieces, ranges, span_hash,
                               word_bounds)

WORDS = 5
PERCENT = 80
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
# Signature values read before each decision, and the posterior under which a
# pair is dropped.
BATCH = 32
MISS = 1e-6
# Members of a bucket that one block of round 2 holds, of those asking and of
# those asked, and about the bytes of their sets.
CHUNK = 2048
BLOCK_BYTES = 8 << 20
# Passes of round 1 against the most linked class of open buckets.
HUBS = 2

_rng = np.random.default_rng(20_240_601)
_A = _rng.integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, first of each text)."""
    n = len(off) - 1
    small = lowered(buf)
    starts, ends, first = word_bounds(small, off)
    h = span_hash(small, starts, ends)
    owner = owner_of(first)
    g = ngram_hash(h, words)
    whole = owner[:len(g)] == owner[len(owner) - len(g):] if len(g) else np.zeros(0, bool)
    g, o = g[whole], owner[:len(g)][whole]
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < words))
    extra = np.array([_sequence(h[first[i]:first[i + 1]]) for i in short], np.uint64)
    g, o = np.concatenate([g, extra]), np.concatenate([o, short])
    order = np.lexsort((g, o))
    g, o = g[order], o[order]
    if len(g):
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (o[1:] != o[:-1])])
        g, o = g[new], o[new]
    return g, np.searchsorted(o, np.arange(n + 1))


def _sequence(h: np.ndarray) -> int:
    """One hash for a whole sequence of word hashes (and their number)."""
    return int(ngram_hash(h, len(h))[0])


def signature(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value, one row a non-empty set."""
    x = (mix(g) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, HASHES), np.uint16)
    at = first[:-1]
    for i in range(HASHES):
        low = np.minimum.reduceat(x * _A[i] + _B[i], at)
        # The least values are small numbers; spread them before cutting.
        out[:, i] = ((low ^ (low >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def digests(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each set, whatever the order."""
    out = np.empty((len(first) - 1, 2), np.uint64)
    for seed in (0, 1):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g + np.uint64(0xABCD + seed)))])
        out[:, seed] = mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))
    return out


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, k, n, c, sig) of ``keyed`` documents: set size, digest and
    signature (both null for an empty set)."""
    batch_limits(docs.sparkSession)

    def run(batches):
        for rows, buf, off in pieces(batches, "text", 2 << 20):
            g, first = shingles(buf, off, words)
            n = np.diff(first)
            full = n > 0
            at = np.append(first[:-1][full], len(g))
            sig = iter(signature(g, at)) if full.any() else iter(())
            dig = iter(digests(g, at)) if full.any() else iter(())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(n, pa.int64()),
                 pa.array([next(dig).tobytes() if x else None for x in full], pa.binary()),
                 pa.array([next(sig).tobytes() if x else None for x in full], pa.binary())],
                ["doc_id", "k", "n", "c", "sig"])

    return docs.select("doc_id", "k", "text").mapInArrow(run, "doc_id bigint, k bigint, n bigint, c binary, sig binary")


def least_matches(batch: int = BATCH, hashes: int = HASHES, percent: int = PERCENT, miss: float = MISS
                  ) -> list[tuple[int, int]]:
    """(values read, fewest matches that stay). With a uniform prior the
    posterior of similarity >= t after m matches in n is P(Bin(n + 1, t) <= m)."""
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss or m == n:
                break
            m += 1
        out.append((n, m))
    return out


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Indexes of the signature pairs that sequential verification leaves; set
    sizes too far apart for the threshold go first (exactly)."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    live = np.flatnonzero(100 * small >= percent * large)
    matches, at = np.zeros(len(live), np.int64), 0
    for n, least in least_matches(percent=percent):
        matches += (a[live, at:n] == b[live, at:n]).sum(axis=1)
        ok = matches >= least
        live, matches, at = live[ok], matches[ok], n
    return live


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint16).reshape(-1, HASHES)


def class_table(sets: DataFrame) -> DataFrame:
    """(id, c, first, rep_k, n, sig) per class; its first document is the row of
    id ``first`` and text hash ``rep_k``."""
    found = sets.filter("c is not null").groupBy("c").agg(
        F.min("doc_id").alias("first"), F.coalesce(F.min_by("k", "doc_id"), F.max("k")).alias("rep_k"),
        F.max("n").alias("n"), F.max("sig").alias("sig"))
    # The id holds from when the table is written.
    return found.select(F.monotonically_increasing_id().alias("id"), "c", "first", "rep_k", "n", "sig")


def bayes_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the distinct candidate pairs that survive."""
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))

    def run(batches):
        for rows in batches:
            if rows.num_rows:
                col = lambda x: rows.column(rows.schema.get_field_index(x))
                live = plausible(_matrix(col("sa").to_pylist()), _matrix(col("sb").to_pylist()),
                                 col("na").to_numpy(), col("nb").to_numpy(), percent)
                yield rows.select(["a", "b"]).take(pa.array(live))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a bigint, b bigint")


def full_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(id, set) of the classes in ``wanted`` (id), from their first document's
    whole text."""
    first = wanted.join(classes, "id").select(F.col("id").alias("_class"), "c", F.col("first").alias("_id"),
                                              F.col("rep_k").alias("_k"))

    def rebuild(batches):
        for rows, buf, off in pieces(batches, "text", 2 << 20):
            g, first = shingles(buf, off, words)
            full = np.flatnonzero(np.diff(first) > 0)
            if not len(full):
                continue
            dig = digests(g, np.append(first[:-1][full], len(g)))
            owner, want = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            got = [(owner[i], g[first[i]:first[i + 1]].tobytes()) for i, d in zip(full, dig, strict=True)
                   if d.tobytes() == want[i]]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                    zip(*got, strict=True), (pa.int64(), pa.binary()), strict=True)], ["id", "set"])

    # Rows that repeat an id and text stand for one of them.
    one = docs.join(first, docs["doc_id"].eqNullSafe(first["_id"]) & (docs["k"] == first["_k"])).select(
        F.col("_class").alias("id"), "c", "text").dropDuplicates(["id"])
    return one.mapInArrow(rebuild, "id bigint, set binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def meet(batches):
        for rows in batches:
            keep = []
            for x, y in zip(rows.column(2), rows.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
              .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b"))
    return joined.select("a", "b", "sa", "sb").mapInArrow(meet, "a bigint, b bigint")


def buckets(classes: DataFrame) -> DataFrame:
    """(key, id, leader, n_members) of band buckets with two classes or more.

    Merged by key at every size: Spark sizes the ``BANDS`` rows of a class as less
    than one row of ``classes``, and would send millions of them to every task."""
    size = 2 * ROWS  # bytes of a band
    rows = classes.select("id", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sig").select(
        "id", F.xxhash64("band", F.substring("sig", F.col("band") * size + 1, F.lit(size))).alias("key"))
    leaders = (rows.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n_members"))
               .filter("n_members > 1"))
    return rows.join(leaders.hint("merge"), "key")


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, root, lead, apart) of the buckets of three or more in which some
    member is apart: not in ``lead``, the first class's component."""
    root = labels.select(F.col("node").alias("id"), "root")
    lead = labels.select(F.col("node").alias("leader"), F.col("root").alias("lead"))
    rows = (members.filter("n_members > 2").join(root, "id", "left").join(lead, "leader", "left")
            .withColumns({"root": F.coalesce("root", "id"), "lead": F.coalesce("lead", "leader")}))
    rows = rows.select("key", "id", "root", "lead", (F.col("root") != F.col("lead")).alias("apart"))
    return rows.join(rows.filter("apart").select("key").distinct(), "key", "left_semi")


def hub_pairs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of the members of open buckets with their bucket's most linked class."""
    degree = (links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("degree")))
    known = rows.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hubs = known.groupBy("key").agg(F.max(F.struct("degree", "id", "root")).alias("hub"))
    pairs = rows.join(hubs, "key").filter(F.col("root") != F.col("hub.root"))
    return pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def dealt(rows: DataFrame, weight: str, chunk: int, limit: int) -> DataFrame:
    """The members (lead, id, root, apart, ``weight``) under one lead as a grid of
    blocks (i, j), by those that ask (apart) and those asked: about ``chunk``
    members and ``limit`` bytes of each kind to a block. A member is sent more than
    once only where there is more than one block of the other kind."""
    bytes_, apart = F.col(weight), F.col("apart")
    parts = lambda n, size: F.greatest(F.ceil(n / chunk), F.ceil(size / limit), F.lit(1)).cast("int")
    grid = rows.groupBy("lead").agg(
        parts(F.count_if(apart), F.sum(F.when(apart, bytes_).otherwise(0))).alias("gi"),
        parts(F.count("*"), F.sum(bytes_)).alias("gj"))
    rows = rows.join(grid, "lead")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    cols = ["lead", "i", "j", "id", "root", "apart"]
    asking = rows.filter("apart").withColumn("i", own("gi")).withColumn("j", every("gj")).select(*cols)
    asked = rows.withColumn("apart", F.lit(False)).withColumn("j", own("gj")).withColumn("i", every("gi")).select(*cols)
    return asking.unionByName(asked)


# Members that an asking one is compared with at once.
_SLICE = 256


def _named(sig: np.ndarray, n: np.ndarray, root: np.ndarray, ask: np.ndarray, asked: np.ndarray, percent: int) -> np.ndarray:
    """Which members of a block have a partner of another component that the
    signatures leave. Once all asked ones are known to, one partner will do."""
    known = np.zeros(len(n), bool)
    for i in ask:
        others = asked[root[asked] != root[i]]
        while len(others):
            some, others = (others, others[:0]) if not known[asked].all() else (others[:_SLICE], others[_SLICE:])
            live = some[plausible(sig[some], np.broadcast_to(sig[i], (len(some), HASHES)), n[some],
                                  np.full(len(some), n[i]), percent)]
            if len(live):
                known[live] = known[i] = True
                break
    return known


def _linked(sig: np.ndarray, n: np.ndarray, root: np.ndarray, ask: np.ndarray, asked: np.ndarray, held: list[np.ndarray],
            percent: int) -> list[tuple[int, int]]:
    """(asking, asked) members of a block whose sets reach the threshold, one of
    each other component: signatures first, then shared shingles by postings."""
    hashes = np.concatenate([held[i] for i in asked])
    owner = np.repeat(np.arange(len(asked)), [len(held[i]) for i in asked])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    out = []
    for i in ask:
        live = np.flatnonzero(root[asked] != root[i])
        some = asked[live]
        live = live[plausible(sig[some], np.broadcast_to(sig[i], (len(some), HASHES)), n[some],
                              np.full(len(some), n[i]), percent)]
        if len(live):
            lo = np.searchsorted(hashes, held[i], "left")
            at = ranges(lo, np.searchsorted(hashes, held[i], "right") - lo)
            both = np.bincount(owner[at], minlength=len(asked))[live]
            live = live[100 * both >= percent * (len(held[i]) + n[asked[live]] - both)]
            _, first = np.unique(root[asked[live]], return_index=True)
            out += [(int(i), int(asked[x])) for x in live[first]]
    return out


def rest_links(rows: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """Round 2: confirmed links (a, b) across components inside open buckets."""
    signed = classes.select("id", "n", "sig")

    def parts(block: pd.DataFrame):
        apart = block.apart.to_numpy()
        return (_matrix(block.sig), block.n.to_numpy(), block.root.to_numpy(), np.flatnonzero(apart), np.flatnonzero(~apart))

    def name(block: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(block.id.to_numpy()[_named(*parts(block), percent)])
        return pd.DataFrame({"lead": np.full(len(ids), block["lead"].iloc[0]), "id": ids})

    def link(block: pd.DataFrame) -> pd.DataFrame:
        sig, n, root, ask, asked = parts(block)
        out = []
        if len(ask) and len(asked):
            held, ids = [np.frombuffer(x, np.uint64) for x in block["set"]], block.id.to_numpy()
            out = [sorted((ids[i], ids[j])) for i, j in _linked(sig, n, root, ask, asked, held, percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    members = tmp.put(rows.select("lead", "id", "root", "apart").distinct().join(classes.select("id", "n"), "id")
                      .withColumn("bytes", F.lit(8) * F.col("n")).withColumn("signature", F.lit(2 * HASHES)))
    likely = tmp.put(dealt(members, "signature", CHUNK, BLOCK_BYTES).join(signed, "id").groupBy("lead", "i", "j")
                     .applyInPandas(name, "lead bigint, id bigint").distinct())
    blocks = dealt(members.join(likely, ["lead", "id"], "left_semi"), "bytes", CHUNK, BLOCK_BYTES)
    out = tmp.put(blocks.join(signed, "id").join(sets, "id").groupBy("lead", "i", "j")
                  .applyInPandas(link, "a bigint, b bigint").distinct())
    tmp.drop(members, likely)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text binary, k): k tells rows of the same id apart by text."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")
                       ).withColumn("k", F.xxhash64("text"))


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, k, n_shingles, component_id, kept) per input row; component_id
    is the smallest id reachable over links of similarity >= percent / 100."""
    own, tmp = keyed(docs, id_col, text_col), Scratch(docs.sparkSession)
    sets = tmp.put(sets_of(own, words))
    classes = tmp.put(class_table(sets))
    members = tmp.put(buckets(classes))
    full = tmp.put(full_sets(members.select("id").distinct(), own, classes, words))

    def verified(pairs):
        return tmp.put(confirm(bayes_filter(pairs, classes, percent), full, percent))

    links = verified(members.filter("id != leader").select(
        F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())
    labels = components(links, tmp)
    for _ in range(HUBS):
        rows = tmp.put(open_buckets(members, labels))
        more = verified(hub_pairs(rows, links))
        tmp.drop(rows)
        if not more.limit(1).count():
            break
        links, labels = links.union(more), merge(labels, more, tmp)
    rows = tmp.put(open_buckets(members, labels))
    tmp.drop(members)
    if rows.limit(1).count():
        labels = merge(labels, rest_links(rows, classes, full, percent, tmp), tmp)
    tmp.drop(rows, full)
    roots = (classes.select("id", "c", "first").join(labels.select(F.col("node").alias("id"), "root"), "id", "left")
             .select("c", "first", F.coalesce("root", "id").alias("root")))
    smallest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = tmp.put(roots.join(smallest, "root").select("c", "component_id"))
    tmp.drop(classes, labels)
    out = sets.select("doc_id", "k", F.col("n").alias("n_shingles"), "c").join(by_class, "c", "left")
    out = out.withColumn("component_id", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "k", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
