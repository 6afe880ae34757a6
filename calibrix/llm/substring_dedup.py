"""Substring dedup by hashing lines and their sentences.

A text is cut into units: a unit ends where its line ends, or at a word that
ends in ``.``, ``!`` or ``?``; a sentence of under ``SHORT_WORDS`` words goes with
the next one of its line. Normalised, a unit is its words with A-Z lower-cased,
so white space does not count. Two 64-bit digests of each unit are grouped over
the whole corpus; the earliest occurrence (id, text, place) stays. The others go
where they follow each other for ``MIN_WORDS`` words or more, so a repeated line
or passage goes whatever the length of its sentences, and a short sentence that
repeats alone stays. Byte offsets into the original text are kept for what goes;
a unit's bytes are those from the end of the unit before it to its own end.

A passage that begins inside a sentence of its text is found from its first
boundary on, and one without a whole unit is not found: that is the suffix
index's work.

A task makes the digests as arrays and writes them once; grouping combines in
the tasks first (earliest place and count), and the join back has one row a
digest on one side, so a unit of every document is split as a skewed key.

Cases: a null or empty text has no units; rows of the same id and text are one
document (each gets the result); ids may be null; a very long text is one row of
its task; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.llm.scratch import Scratch
from calibrix.llm.text import batch_limits, lowered, mix, pieces, span_hash, word_bounds

# Words of consecutive repeated units that go.
MIN_WORDS = 25
# A sentence of fewer words goes with the next one.
SHORT_WORDS = 4
_STOP = np.array([b in b".!?" for b in range(256)])


def bounds(buf: np.ndarray, off: np.ndarray, short: int) -> tuple[np.ndarray, ...]:
    """(word starts, word ends, first word of each unit and one more, text of
    each unit)."""
    starts, ends, first = word_bounds(buf, off)
    n = len(starts)
    if not n:
        z = np.zeros(0, np.int64)
        return starts, ends, np.zeros(1, np.int64), z
    feeds = np.concatenate([[0], np.cumsum(buf == 0x0A)])
    closed = np.zeros(n, bool)  # the last word of a line or text
    closed[:-1] = feeds[starts[1:]] > feeds[ends[:-1]]
    closed[first[1:][np.diff(first) > 0] - 1] = True
    stop = np.flatnonzero(closed | _STOP[buf[ends - 1]])
    length = np.diff(np.concatenate([[-1], stop]))
    last = stop[(length >= short) | closed[stop]]
    at = np.concatenate([[0], last + 1])
    return starts, ends, at, np.searchsorted(first, at[:-1], "right") - 1


def digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each unit's lower-cased words in order."""
    small, out = lowered(buf), []
    place = np.arange(len(starts)) - np.repeat(at[:-1], np.diff(at))
    for seed in (0, 1):
        # A word's hash and its place in the unit, summed: order counts.
        h = mix(span_hash(small, starts, ends, seed) + mix(place.astype(np.uint64) + np.uint64(seed + 11)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
        out.append(mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64))
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text binary, k): k tells rows of the same id apart by text."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")
                       ).withColumn("k", F.xxhash64("text"))


def unit_rows(docs: DataFrame, short: int = SHORT_WORDS) -> DataFrame:
    """(doc_id, k, unit, d1, d2) of each unit of ``keyed`` documents."""
    batch_limits(docs.sparkSession)

    def run(batches):
        for rows, buf, off in pieces(batches, "text"):
            starts, ends, at, text = bounds(buf, off, short)
            if not len(text):
                continue
            unit = np.arange(len(text)) - np.searchsorted(text, text)
            d1, d2 = digests(buf, starts, ends, at)
            owner = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(owner), rows.column(1).take(owner), *map(pa.array, (unit, d1, d2))],
                ["doc_id", "k", "unit", "d1", "d2"])

    return docs.select("doc_id", "k", "text").mapInArrow(run, "doc_id bigint, k bigint, unit bigint, d1 bigint, d2 bigint")


def repeated_units(rows: DataFrame) -> DataFrame:
    """The units that are not the earliest occurrence of their digest."""
    place = F.struct("doc_id", "k", "unit")
    firsts = (rows.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
              .filter("n > 1").select("d1", "d2", "first"))
    return rows.join(firsts, ["d1", "d2"]).filter(place != F.col("first"))


def removed_runs(units: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """(first unit, last unit) of the runs of repeated units (sorted) that have
    ``min_words`` words; ``words`` are those of all units of the text."""
    cut = np.flatnonzero(np.diff(units) > 1)
    lo, hi = units[np.concatenate([[0], cut + 1])], units[np.concatenate([cut, [len(units) - 1]])]
    total = np.concatenate([[0], np.cumsum(words)])
    return np.stack([lo, hi], axis=1)[total[hi + 1] - total[lo] >= min_words]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                    short: int = SHORT_WORDS) -> DataFrame:
    """(doc_id, kept binary, n_units, n_removed, removed) per input row: the
    bytes that stay, the number of units and of removed ones, and the removed
    (start, end) byte offsets in the original text."""
    own, tmp = keyed(docs, id_col, text_col), Scratch(docs.sparkSession)
    again = repeated_units(tmp.put(unit_rows(own, short)))
    found = again.groupBy("doc_id", "k").agg(F.collect_set("unit").alias("units"))
    s = found.select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "units")
    joined = own.join(s, own["doc_id"].eqNullSafe(s["_id"]) & (own["k"] == s["_k"]), "left").select(
        "doc_id", "text", "units")

    def run(batches):
        for rows, buf, off in pieces(batches, "text"):
            starts, ends, at, text = bounds(buf, off, short)
            data, edge = buf.tobytes(), np.searchsorted(text, np.arange(len(off)))
            kept, removed, gone = [], [], []
            for i, units in enumerate(rows.column(2)):
                base, end, spans, n = int(off[i]), int(off[i + 1]), [], 0
                if units.is_valid:
                    mine = at[edge[i]:edge[i + 1] + 1]
                    units = np.sort(units.values.to_numpy())
                    for lo, hi in removed_runs(units, np.diff(mine), min_words).tolist():
                        a = base if lo == 0 else int(ends[mine[lo] - 1])
                        spans.append((a, int(ends[mine[hi + 1] - 1])))
                        n += hi - lo + 1
                stay, part = [], base
                for a, b in spans:
                    stay.append(data[part:a])
                    part = b
                kept.append(b"".join([*stay, data[part:end]]))
                removed.append([{"start": a - base, "end": b - base} for a, b in spans])
                gone.append(n)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(kept, pa.binary()), pa.array(np.diff(edge)), pa.array(gone, pa.int64()),
                 pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "kept", "n_units", "n_removed", "removed"])

    return joined.mapInArrow(run, "doc_id bigint, kept binary, n_units bigint, n_removed bigint, "
                                  "removed array<struct<start:bigint,end:bigint>>")
