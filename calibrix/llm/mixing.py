"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Each source has a weight, and the
targets share the size of all documents by weight; a target stops at ``MOST``
times its source's size, and what it leaves is shared again by weight.

A source is taken whole as often as its target allows. What is left of the
target is fitted by document sizes alone: documents are counted by exact size;
from the largest size down each size gives its share while much is left, and
the last ``REACH`` words are filled by bounded-knapsack dynamic programming
over the sizes and the documents they still have (a bit of one integer for each
sum). Of each size then that many documents are selected by a seeded hash. A
small source that misses its target so may repeat single documents instead.

Texts never leave the task that counts their words. The sizes of one source are
fitted in one task: its rows are different sizes, and L of them need L * L / 2
words, so 100 TB hold at most some six million (100 MB). Documents of one size
are selected in buckets of about ``BUCKET`` by hash, so no group is sorted
whole; rows that repeat an id and text are one row with a count until the end.

Cases: a null or empty text has size 0 and is never taken; a null source is a
source, the last; ids may be null; rows that repeat each get a row, some of
them taken once more than others where the fit needs so; a source whose sizes
cannot meet its target ends at the nearest sum found; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrix.llm.text import batch_limits, pieces, word_bounds
from calibrix.session import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20_240_612
# Words that are left to dynamic programming.
REACH = 1 << 15
# Documents of one size that are ordered together.
BUCKET = 4096


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(doc_id, source, h, size, copies): one row a document, without text; h
    is its seeded hash and ``copies`` the rows that repeat it."""
    batch_limits(docs.sparkSession)

    def count(batches):
        for rows, buf, off in pieces(batches, "text"):
            _, _, first = word_bounds(buf, off)
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(3)), pa.array(np.diff(first), pa.int64())],
                                             ["doc_id", "source", "h", "size"])

    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text).alias("h"), text.alias("text"))
    rows = rows.mapInArrow(count, "doc_id bigint, source string, h bigint, size bigint")
    return rows.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("copies"))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0 in the order of ``source`` (nulls
    last): places inside ranges, and the ranges' running sums."""
    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for rows in batches:
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.full(rows.num_rows, part), pa.int64()),
                 pa.array(np.arange(at, at + rows.num_rows), pa.int64())], [*rows.schema.names, "part", "at"])
            at += rows.num_rows

    order = F.col("source").asc_nulls_last()
    kinds = ", ".join(f"{c} {t}" for c, t in sources.dtypes)
    rows = materialize(sources.repartitionByRange(order).sortWithinPartitions(order)
                       .mapInArrow(number, f"{kinds}, part bigint, at bigint"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy("part").agg(F.count("*").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "part").withColumn("place", F.col("start") + F.col("at")).drop("part", "at", "start")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, words, place, target) of the sources (source, words). Every
    round shares what is left among the sources that have not stopped and stops
    those above their limit; a round brings one row of sums to the driver."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    rows = materialize(ranked(sources).withColumn("weight", weight).withColumn("limit", most * F.col("words")))
    share, stopped = None, F.lit(False)
    while True:
        left = F.col("words") - F.when(stopped, F.col("limit")).otherwise(0)
        got = rows.agg(F.sum(left).alias("left"), F.sum(F.when(~stopped, F.col("weight"))).alias("weight"),
                       F.count_if(stopped).alias("stopped")).first()
        if share is not None and got["stopped"] == known:
            break
        known = got["stopped"]
        if not got["weight"] or got["left"] is None:
            break
        # A literal below 2^31 is an int, and so would be its product.
        share = F.lit(int(got["left"])).cast("long") * F.col("weight") / F.lit(int(got["weight"]))
        stopped = stopped | (share > F.col("limit"))
    target = F.lit(0.0) if share is None else F.when(stopped, F.col("limit").cast("double")).otherwise(share)
    return rows.select("source", "words", "place", target.cast("double").alias("target"))


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents of each size whose sum is nearest to ``budget``, ties to the
    smaller sum; no size gives more than ``counts``.

    Bounded knapsack: bit s of ``sums`` is set once s is a sum. A size's count is
    cut into powers of two, each an item; a sum remembers the item that made it
    first, so the way back uses no item twice."""
    take = np.zeros(len(sizes), np.int64)
    width = 2 * budget + 1  # a larger sum is no nearer than none at all
    sums, mask = 1, (1 << width) - 1
    made_by = np.full(width, -1, np.int64)
    items: list[tuple[int, int]] = []  # (index, documents)
    for i, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        count, part = min(count, (width - 1) // size), 1
        while count and not sums >> budget & 1:
            part = min(part, count)
            new = (sums << size * part) & mask & ~sums
            if new:
                raw = np.frombuffer(new.to_bytes(width // 8 + 1, "little"), np.uint8)
                made_by[np.flatnonzero(np.unpackbits(raw, bitorder="little"))] = len(items)
                sums |= new
            items.append((i, part))
            count, part = count - part, part * 2
    reached = np.flatnonzero(made_by >= 0)
    reached = np.append(reached, 0)
    at = int(reached[np.lexsort((reached, np.abs(reached - budget)))[0]])
    while at:
        i, part = items[made_by[at]]
        take[i] += part
        at -= int(sizes[i]) * part
    return take


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, reach: int = REACH) -> np.ndarray:
    """Documents of each size (largest first) to take for ``budget`` words, at
    most ``counts`` of each."""
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    left, due = budget, 0.0
    for i, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        if left <= reach:
            break
        due += budget * (size * count / total)
        take[i] = k = max(0, min(count, left // size, int((due - (budget - left)) // size)))
        left -= k * size
    if 0 < left <= reach:
        free = np.flatnonzero((counts > take) & (sizes <= 2 * left))
        more = knapsack(sizes[free], (counts - take)[free], left)
        take[free] += more
        left -= int((more * sizes[free]).sum())
    free = np.flatnonzero(counts > take)
    if left > 0 and len(free):  # one more document, if that ends nearer
        i = free[np.argmin(np.abs(sizes[free] - left))]
        if abs(int(sizes[i]) - left) < left:
            take[i] += 1
    return take


def copies(sizes: np.ndarray, counts: np.ndarray, budget: int, most: int = MOST, reach: int = REACH) -> np.ndarray:
    """Copies of the documents of each size (largest first) to take for
    ``budget`` words: every document as often as it allows, then some once more.
    Where that misses and the words are few, copies are dealt freely, none over
    ``most`` times its document."""
    words = int((sizes * counts).sum())
    whole = min(budget // words, most)
    rest = budget - whole * words
    take = fit(sizes, counts, rest, reach) if whole < most else np.zeros(len(sizes), np.int64)
    missed = abs(rest - int((take * sizes).sum()))
    take = take + whole * counts
    low = max(whole - 1, 0)
    if missed and budget - low * words <= reach:
        free = low * counts + knapsack(sizes, (most - low) * counts, budget - low * words)
        if abs(budget - int((free * sizes).sum())) < missed:
            return free
    return take


def quotas(rows: DataFrame, sources: DataFrame, most: int = MOST, reach: int = REACH) -> DataFrame:
    """(place, size, n, whole, extra): the n documents of a size are taken
    ``whole`` times each, and ``extra`` of them once more."""
    lengths = rows.filter("size > 0").groupBy("place", "size").agg(F.sum("copies").alias("n"))
    goal = sources.select("place", "words", F.round("target").cast("long").alias("goal"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        times = copies(pdf["size"].to_numpy(), pdf.n.to_numpy(), int(pdf.goal.iloc[0]), most, reach)
        return pdf[["place", "size", "n"]].assign(whole=times // pdf.n, extra=times % pdf.n)

    return lengths.join(goal, "place").groupBy("place").applyInPandas(
        solve, "place bigint, size bigint, n bigint, whole bigint, extra bigint")


def select(rows: DataFrame, quota: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, place, size, taken), one row for each copy. Of the documents of
    a size the first ``extra`` in (bucket, hash, id) order come once more."""
    known = rows.join(quota, ["place", "size"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("n", "whole", "extra")})
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    plain = known.filter(~some).withColumn("more", F.when(F.col("extra") > 0, F.col("copies")).otherwise(0))
    # Dealt by bucket: left as the join deals them, all documents of a size would meet in one task.
    parted = known.filter(some).withColumn("bucket", F.pmod("h", F.ceil(F.col("n") / bucket).cast("long"))).repartition(
        "place", "size", "bucket")
    earlier = Window.partitionBy("place", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("place", "size", "bucket").agg(F.sum("copies").alias("held")).select(
        "place", "size", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("place", "size", "bucket").orderBy("h", "doc_id").rowsBetween(
        Window.unboundedPreceding, -1)
    parted = parted.join(starts, ["place", "size", "bucket"]).withColumn(
        "start", F.col("start") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    parted = parted.withColumn("more", F.greatest(F.lit(0), F.least("copies", F.col("extra") - F.col("start"))))
    cols = ["doc_id", "place", "size", "copies", "whole", "more"]
    both = plain.select(*cols).unionByName(parted.select(*cols))
    each = both.select("doc_id", "place", "size", "whole", "more",
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    times = F.col("whole") + (F.col("copy") <= F.col("more")).cast("long")
    return each.select("doc_id", "place", "size", (F.col("size") * times).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", reach: int = REACH) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per input row."""
    rows = materialize(sized(docs, id_col, text_col, source_col, seed))
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    sources = materialize(targets(sums, weights, most))
    own = sources.select(F.col("source").alias("_source"), "place")
    placed = materialize(rows.join(own, rows["source"].eqNullSafe(own["_source"])).select(
        "doc_id", "h", "size", "copies", "place"))
    taken = select(placed, materialize(quotas(placed, sources, most, reach)))
    return taken.join(sources, "place").select(
        "doc_id", "source", "size", F.col("words").alias("source_size"), "target", "taken")
