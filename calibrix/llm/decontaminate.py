"""Benchmark decontamination by spaced-seed hashing.

Words (letters, digits, anything above 7F; A-Z lower-cased) are hashed. Each
fixed mask reads five of seven or eight consecutive words and ignores the rest,
so a seed survives substitutions at ignored places. Test seeds are joined with
the training texts' seeds (sorted arrays, in the tasks), and every hit fixes an
alignment of item and text that is verified: an overlap is a window of
``WINDOW`` consecutive item words (the whole item if shorter) of which at least
``SHARE`` stand at the aligned places of the text. The three masks miss no
window of 13 words with up to two substitutions.

Items of under ``WINDOW`` words have one window, so few places to hit: they get a
mask of three words in a row as well, which no allowed substitutions miss; items
of under ``EXACT`` words count only where they stand unchanged.

The benchmark is sent to the tasks in blocks of at most ``BLOCK_WORDS`` words. One
block is one pass over the texts without a shuffle. More are one pass each, and
each leaves its few overlaps as a written table before the next is read, so the
driver and the tasks hold one block whatever the benchmark's size; the overlaps
then join the texts by hash.

Cases: a null or empty text has no overlap; items of fewer than ``MIN_ITEM``
words cannot be told from chance and are not searched; null items are skipped,
repeated items report each of their ids; null item ids are skipped; a very long
text is a piece of its own; extra columns are kept, but for those named as the
two results, which these replace; an empty benchmark finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.llm.scratch import Scratch
from calibrix.llm.text import batch_limits, lowered, mix, owner_of, pieces, ranges, span_hash, utf8, word_bounds

# Places read by each mask; every pair of substitutions in 13 words leaves one whole.
MASKS = ((0, 1, 2, 6, 7), (0, 1, 3, 5, 6), (0, 3, 5, 6, 7))
# Of items of under WINDOW words: with a fifth of them replaced, three in a row stay.
SHORT_MASK = (0, 1, 2)
WINDOW = 13
SHARE = 0.8
MIN_ITEM, EXACT = 4, 8
BLOCK_WORDS = 4_000_000
# Words compared at once when alignments are verified.
_VERIFY = 1 << 21

WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text)."""
    starts, ends, first = word_bounds(buf, off, WORD)
    return span_hash(lowered(buf), starts, ends), first


def seeds(h: np.ndarray, first: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, seed hashes) of one mask where it lies inside a text."""
    mask = (*MASKS, SHORT_MASK)[number]
    m = len(h) - mask[-1]
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = owner_of(first)
    at = np.flatnonzero(owner[:m] == owner[mask[-1]:])
    g = np.full(len(at), number + 1, np.uint64)
    for o in mask:
        g = mix(g * np.uint64(3) + h[at + o])
    return at, g


class Block:
    """Word and seed arrays of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], window: int, share: float):
        buf, off = utf8(pa.array([t.encode() for t in texts], pa.binary()))
        h, first = word_hashes(buf, off)
        lens = np.diff(first)
        self.ids = np.array(ids, np.int64)
        self.words, self.first = h, first
        self.window = np.minimum(window, lens)
        self.need = np.where(lens < EXACT, lens, np.ceil(share * self.window - 1e-9)).astype(np.int64)
        owner = owner_of(first)
        short = (lens >= MIN_ITEM) & (lens < WINDOW)
        self.masks = range(len(MASKS) + bool(short.any()))
        ats, gs = [], []
        for number in self.masks:
            at, g = seeds(h, first, number)
            own = (short if number == len(MASKS) else lens >= EXACT)[owner[at]]
            ats.append(at[own])
            gs.append(g[own])
        at, g = np.concatenate(ats), np.concatenate(gs)
        order = np.argsort(g, kind="stable")
        self.seed, self.at = g[order], at[order]
        self.item = owner[self.at] if len(self.at) else self.at
        self.maybe = np.zeros(1 << 22, bool)  # first 22 bits of the seeds
        self.maybe[(self.seed >> np.uint64(42)).astype(np.int64)] = True

    def overlaps(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item index, most words of a window that agree), per overlap
        of an alignment."""
        owner = owner_of(first)
        keys = []
        for number in self.masks:
            at, g = seeds(h, first, number)
            hit = self.maybe[(g >> np.uint64(42)).astype(np.int64)]
            at, g = at[hit], g[hit]
            lo, hi = np.searchsorted(self.seed, g, "left"), np.searchsorted(self.seed, g, "right")
            n = hi - lo
            for a, b in bounded(n, _VERIFY):
                s = ranges(lo[a:b], n[a:b])
                place = np.repeat(at[a:b], n[a:b])
                item = self.item[s]
                # The text's word that item word 0 falls on (may lie before it).
                start = place - (self.at[s] - self.first[item])
                keys.append(np.unique(np.stack([owner[place], item, start], axis=1), axis=0))
        if not keys:
            return []
        keys = np.unique(np.concatenate(keys), axis=0)
        out = []
        lens = np.diff(self.first)[keys[:, 1]]
        for a, b in bounded(lens, _VERIFY):
            text, item, start = keys[a:b].T
            n = lens[a:b]
            if not len(n):
                continue
            mine = ranges(self.first[item], n)
            theirs = ranges(start, n)
            inside = (theirs >= np.repeat(first[text], n)) & (theirs < np.repeat(first[text + 1], n))
            same = inside & (self.words[mine] == h[np.where(inside, theirs, 0)])
            total = np.concatenate([[0], np.cumsum(same)])
            w = self.window[item]
            begins = np.cumsum(n) - n
            windows = ranges(begins, n - w + 1)
            score = total[windows + np.repeat(w, n - w + 1)] - total[windows]
            best = np.maximum.reduceat(score, np.cumsum(n - w + 1) - (n - w + 1))
            good = best >= self.need[item]
            out += zip(text[good].tolist(), item[good].tolist(), best[good].tolist(), strict=True)
        return out


def bounded(n: np.ndarray, limit: int):
    """Cuts (a, b) of consecutive entries that sum to ``limit`` at most, or one entry."""
    total = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(n):
        b = max(int(np.searchsorted(total, total[a] + limit, "right")) - 1, a + 1)
        yield a, b
        a = b


def block_items(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> tuple[DataFrame, int]:
    """(items (i, t, b), number of blocks): items go to blocks by a hash of
    their id, so a block holds about ``block_words``."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")
                             ).filter("i is not null and t is not null")
    words = items.agg(F.sum(F.length("t") - F.length(F.regexp_replace("t", r"\s+", "")) + 1)).first()[0] or 0
    n = -(-int(words) // block_words)
    return items.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(max(n, 1)))), n


def _overlaps(shared, rows, buf, off) -> dict[int, tuple[set[int], int]]:
    """text -> (item ids, most agreeing words) of a piece."""
    found: dict[int, tuple[set[int], int]] = {}
    block = shared.value
    for text, item, score in block.overlaps(*word_hashes(buf, off)):
        ids, top = found.get(text, (set(), 0))
        found[text] = (ids | {int(block.ids[item])}, max(top, score))
    return found


def with_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, share: float = SHARE,
                  block_words: int = BLOCK_WORDS, found: str = "found_items", most: str = "most_matched") -> DataFrame:
    """``docs`` with the sorted ids of the items each text overlaps and the
    most agreeing words of a window, as the last two columns."""
    spark = docs.sparkSession
    batch_limits(spark)
    docs = docs.drop(found, most)
    items, n = block_items(benchmark, item_id_col, item_text_col, block_words)
    none = {found: F.array().cast("array<bigint>"), most: F.lit(0).cast("bigint")}

    def send(b: int):
        rows = items.filter(F.col("b") == b).select("i", "t").collect()
        return spark.sparkContext.broadcast(Block([r["i"] for r in rows], [r["t"] for r in rows], window, share))

    if n <= 1:
        out = docs.withColumns(none)
        if not n:
            return out
        shared, schema = send(0), T.StructType(out.schema.fields)

        def run(batches):
            for rows, buf, off in pieces(batches, text_col):
                cols = [rows.column(i) for i in range(rows.num_columns)]
                hits = _overlaps(shared, rows, buf, off)
                if hits:
                    old, best = cols[-2].to_pylist(), cols[-1].to_pylist()
                    for t, (ids, top) in hits.items():
                        old[t], best[t] = sorted(ids), top
                    cols[-2:] = [pa.array(old, cols[-2].type), pa.array(best, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

        return out.mapInArrow(run, schema)

    tmp, parts = Scratch(spark), []
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    key = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]
    for b in range(n):
        shared = send(b)

        def run(batches, shared=shared):
            for rows, buf, off in pieces(batches, "t"):
                hits = _overlaps(shared, rows, buf, off)
                at = pa.array(hits.keys(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(at), rows.column(1).take(at), pa.array([sorted(x) for x, _ in hits.values()],
                                                                                pa.list_(pa.int64())),
                     pa.array([x for _, x in hits.values()], pa.int64())], ["h1", "h2", "ids", "top"])

        parts.append(tmp.put(docs.select(*key, text.alias("t")).mapInArrow(
            run, "h1 bigint, h2 bigint, ids array<bigint>, top bigint")))
        shared.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    best = every.groupBy("h1", "h2").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"), F.max("top").alias("top"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key)
    return rows.join(best, ["h1", "h2"], "left").select(
        "row.*", F.coalesce("ids", none[found]).alias(found), F.coalesce("top", none[most]).alias(most))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """(doc_id, contaminated, n_items, most_matched, items) per input row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = with_overlaps(own, benchmark, "text", **options)
    return out.select("doc_id", (F.size("found_items") > 0).alias("contaminated"),
                      F.size("found_items").cast("long").alias("n_items"), "most_matched",
                      F.col("found_items").alias("items"))
