"""Quality rules with host-level verdicts.

Rules are measured on each whole text. A host's share of failing documents is
shrunk towards all hosts by an empirical beta prior (method of moments over
the hosts' rates), and a document of a host whose shrunk rate passes
``HOST_LIMIT`` is dropped even if it passes its own rules.

Cases: a null or empty text has no words and fails (too short); documents of a
null host form a host of their own; a table of one host, or of hosts with
equal rates, shrinks fully to the mean; repeated rows count as rows and give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.llm.text import batch_limits, mix, ngram_hash, owner_of, pieces, span_hash, word_bounds
from calibrix.session import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_LIMIT = 0.75
WINDOW = 3

_START = np.array([b & 0xC0 != 0x80 for b in range(256)])  # first byte of a code point
_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_LINE = np.array([b != 0x0A for b in range(256)])

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _repeats(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each item, whether its key stands in the same text more than once."""
    k = mix(keys ^ mix(owner.astype(np.uint64)))
    order = np.argsort(k)
    s = k[order]
    twin = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = s[1:] == s[:-1]
        twin[1:] |= eq
        twin[:-1] |= eq
    out = np.empty(len(k), bool)
    out[order] = twin
    return out


def measure(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The five measures of each text, in the order of ``MEASURES``."""
    n = len(off) - 1
    starts, ends, first = word_bounds(buf, off)
    words = np.diff(first)
    owner = owner_of(first)
    inside = np.concatenate([[0], np.cumsum(_START[buf], dtype=np.int64)])
    chars = np.bincount(owner, inside[ends] - inside[starts], n).astype(np.int64)
    # Lines that hold a word, less the distinct ones among them (by all 64 bits of the hash).
    ls, le, _ = word_bounds(buf, off, _LINE)
    worded = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le = ls[worded], le[worded]
    lo = np.searchsorted(off, ls, "right") - 1
    keys = span_hash(buf, ls, le)
    order = np.lexsort((keys, lo))
    keys = keys[order]
    again = (keys[1:] == keys[:-1]) & (lo[1:] == lo[:-1])  # lo is in order already
    dup = np.bincount(lo[1:][again], minlength=n)
    # Words under a window that stands at least twice.
    m = len(starts) - WINDOW + 1
    repeat = np.zeros(n, np.int64)
    if m > 0:
        grams = ngram_hash(span_hash(buf, starts, ends), WINDOW)
        whole = owner[:m] == owner[WINDOW - 1:]
        at = np.flatnonzero(whole)
        twice = at[_repeats(grams[at], owner[at])]
        covered = np.zeros(len(starts), bool)
        for j in range(WINDOW):
            covered[twice + j] = True
        repeat = np.bincount(owner[covered], minlength=n)
    return [words, chars, _sums(_SYMBOL[buf], off) if len(buf) else np.zeros(n, np.int64), dup, repeat]


def measures(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, host, the five measures, base_failed) per input row; no shuffle."""
    batch_limits(docs.sparkSession)

    def run(batches):
        for rows, buf, off in pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), *(pa.array(x.astype(np.int64)) for x in measure(buf, off))],
                ["doc_id", "host", *MEASURES])

    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                        F.col(text_col).cast("binary").alias("_text"))
            .mapInArrow(run, "doc_id bigint, host string, " + ", ".join(f"{m} bigint" for m in MEASURES)))
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                           | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate): failures of any host's documents, shrunk.

    The prior Beta(a, b) has the mean of all documents and the strength that
    the spread of the hosts' rates implies: m (1 - m) / v - 1, held between 0
    and 10^6 (no spread: full shrinkage). Only two moments reach the driver.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"),
                                     F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    t = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"),
                  F.var_pop(F.col("n_failed") / F.col("n_docs")).alias("v")).collect()[0]
    mean = (t["f"] / t["n"]) if t["n"] else 0.0
    strength = 1e6 if not t["v"] else min(max(mean * (1 - mean) / t["v"] - 1, 0.0), 1e6)
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(mean * strength))
                            / (F.col("n_docs") + F.lit(strength)))


def host_verdicts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
                  host_limit: float = HOST_LIMIT) -> DataFrame:
    """Measures, ``host_failed`` and ``kept`` per input row.

    The measured rows are written once (they feed the host rates and the
    result). The join back is on the host; its other side has one row a host,
    so a host with a third of all rows is split as a skewed key."""
    rows = materialize(measures(docs, id_col, host_col, text_col))
    hosts = host_rates(rows).select(
        F.coalesce("host", F.lit("")).alias("_h"), F.col("host").isNull().alias("_n"),
        (F.col("rate") > host_limit).alias("host_failed"))
    joined = rows.withColumns({"_h": F.coalesce("host", F.lit("")), "_n": F.col("host").isNull()}).join(
        hosts, ["_h", "_n"], "left")
    return joined.drop("_h", "_n").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
