"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace)
resolves every pre-token that is a vocabulary entry as a whole. Tier two:
other pre-tokens start as linked single bytes, and a heap of adjacent pairs
merges the lowest rank first (leftmost on ties). The vocabulary is read on the
driver from a rank file (its size bounds what is sent to tasks); texts are
read whole, once, with no shuffle. A task keeps the pre-tokens it has met, up
to ``KEPT`` of them, so a repeated one costs one dictionary look-up.

Cases: a null or empty text has no ids and decodes to no bytes; repeated rows
give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.llm.text import batch_limits, mix, pieces, span_hash

# Pre-tokens a task remembers before it starts afresh.
KEPT = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a rank file (base64 token, space, rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class PerfectHash:
    """Minimal perfect hash of a fixed key list: n keys on n slots.

    Keys fall into n/4 buckets; buckets are placed from the largest on, each
    with the first displacement that puts all its keys on free slots. A bucket
    of one key names its slot directly (as -slot - 1).
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = max(len(keys), 1)
        self.buckets = max(n // 4, 1)
        h = hashes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        size = np.bincount(bucket, minlength=self.buckets)
        members = np.argsort(bucket, kind="stable")
        first = np.concatenate([[0], np.cumsum(size)])
        self.displace = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-size, kind="stable"):
            if size[b] < 2:
                break
            own = members[first[b]:first[b + 1]]
            d, found = 0, None
            while found is None:
                tries = np.arange(d, d + 64, dtype=np.uint64)
                slots = (mix(h[own][None, :] + tries[:, None] * _STEP) % np.uint64(n)).astype(np.int64)
                ok = free[slots].all(axis=1)
                if size[b] > 1:
                    s = np.sort(slots, axis=1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                hit = np.flatnonzero(ok)
                if len(hit):
                    found = int(hit[0])
                    self.displace[b] = d + found
                    free[slots[found]] = False
                    self.key_at[slots[found]] = own
                d += 64
        rest = iter(np.flatnonzero(free))
        for b in np.flatnonzero(size == 1):
            slot = next(rest)
            self.displace[b] = -slot - 1
            self.key_at[slot] = members[first[b]]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the only key that may have each hash (to be compared)."""
        d = self.displace[(h % np.uint64(self.buckets)).astype(np.int64)]
        moved = (mix(h + np.maximum(d, 0).astype(np.uint64) * _STEP) % np.uint64(self.n)).astype(np.int64)
        return self.key_at[np.where(d < 0, -d - 1, moved)]


def hashes(keys: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
    buf = np.frombuffer(b"".join(keys), np.uint8)
    return span_hash(buf, np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(keys) else ends, ends)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: heap of adjacent pairs over linked parts."""
    n = len(piece)
    get = ranks.get
    end = list(range(1, n + 1))  # end of the part that starts here, 0 if none does
    prev = list(range(-1, n))  # start of the part before
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, e = heappop(heap)
        k = end[i]
        if not k or k == n or end[k] != e:
            continue
        end[i], end[k] = e, 0
        if e < n:
            prev[e] = i
            if (r := get(piece[i:end[e]])) is not None:
                heappush(heap, (r, i, end[e]))
        if i and (r := get(piece[prev[i]:e])) is not None:
            heappush(heap, (r, prev[i], e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Encoder:
    """Pre-token -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = list(ranks)
        self.ids = np.array([ranks[t] for t in self.tokens], np.uint32)
        self.ranks = ranks
        self.table = PerfectHash(self.tokens)
        self.pattern = pattern
        self.by_id = {i: t for t, i in ranks.items()}

    def resolve(self, parts: list[str]) -> dict[str, bytes]:
        raw = [p.encode() for p in parts]
        at = self.table.find(hashes(raw)).tolist()
        out = {}
        for part, r, k in zip(parts, raw, at, strict=True):
            if k >= 0 and self.tokens[k] == r:
                out[part] = self.ids[k].tobytes()
            else:
                out[part] = np.array(merge(r, self.ranks), np.uint32).tobytes()
        return out

    def encode_all(self, texts: list[str], known: dict[str, bytes], split) -> list[bytes]:
        cut = [split(t) for t in texts]
        new = set().union(*cut).difference(known) if cut else set()
        if new:
            known.update(self.resolve(list(new)))
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _shared(spark, ranks: dict[bytes, int], pattern: str):
    """The encoder, built once and broadcast; its size is the vocabulary's."""
    return spark.sparkContext.broadcast(Encoder(ranks, pattern))


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit, decoded binary) per input row."""
    shared = _shared(docs.sparkSession, ranks, pattern)
    batch_limits(docs.sparkSession)

    def run(batches):
        enc, split, known = shared.value, regex.compile(pattern).findall, {}
        for rows, buf, off in pieces(batches, "_text", 2 << 20):
            data = buf.tobytes()
            texts = [data[off[i]:off[i + 1]].decode("utf-8", "replace") for i in range(len(off) - 1)]
            ids = enc.encode_all(texts, known, split)
            if len(known) > KEPT:
                known.clear()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(ids, pa.binary()), pa.array(map(enc.decode, ids), pa.binary())],
                ["doc_id", "ids", "decoded"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
            .mapInArrow(run, "doc_id bigint, ids binary, decoded binary"))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per input row."""
    return encode_decode(docs, ranks, pattern, id_col, text_col).select("doc_id", "ids")


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids); null ids decode to no bytes."""
    shared = _shared(encoded.sparkSession, ranks, pattern)

    def run(batches):
        for b in batches:
            out = [shared.value.decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")
