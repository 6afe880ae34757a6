"""Array helpers that the operators' tasks share.

Texts reach a task as Arrow batches and are worked on as one byte buffer with
offsets: word boundaries, word hashes and n-gram hashes are numpy operations
over the whole buffer, so no Python object is made for a word. A batch is cut
into pieces of bounded size first, so a task's memory does not follow the
batch; one text longer than a piece is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# [\x20\x09-\x0D]: the white space of the word rules.
_SPACE = frozenset([0x20, *range(0x09, 0x0E)])
NOT_SPACE = np.array([b not in _SPACE for b in range(256)])

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_S29 = np.uint64(29)
_HEAD = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def batch_limits(spark) -> None:
    """Bound the bytes of a batch sent to Python where the session sets no bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key, "0") or 0) in (0, 2**31 - 1, 2**63 - 1):
            spark.conf.set(key, str(32 << 20))
    except Exception:  # noqa: BLE001  a session may refuse the setting; the default then holds
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S29
    h *= _M2
    h ^= h >> _S33
    return h


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.large_binary()
    col = col.cast(pa.large_string()).cast(wide) if pa.types.is_string(col.type) else col.cast(wide)
    if col.null_count:
        col = col.fill_null(b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def pieces(batches, text: str, limit: int = PIECE_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, off = utf8(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo), buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            lo = hi


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    return np.frombuffer(buf.tobytes().translate(LOWER), dtype=np.uint8)


def word_bounds(buf: np.ndarray, off: np.ndarray, inside: np.ndarray = NOT_SPACE
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word spans in the buffer and, per text, the index
    of its first word (one entry more than there are texts)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    m = inside[buf]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    starts = np.flatnonzero(m & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    ends = np.flatnonzero(m & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes a step; spans are taken
    longest first, so each step works on a prefix of them."""
    lens = ends - starts
    h = mix(lens.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64))
    if not len(lens):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(buf) + 1,), strides=(1,))
    # Sixteen bits sort by radix, far faster than wide integers.
    longest = int(lens.max())
    order = np.argsort((longest - lens).astype(np.uint16 if longest < 1 << 16 else np.int64), kind="stable")
    s, left, g = starts[order], lens[order], h[order]
    for j in range(0, int(left[0]) if len(left) else 0, 8):
        live = int(np.searchsorted(-left, -j, "left"))  # spans longer than j
        if live <= 16:
            break
        part = words[s[:live] + j] & _HEAD[np.minimum(left[:live] - j, 8)]
        g[:live] = mix(g[:live] ^ part) + np.uint64(0x9E3779B97F4A7C15)
    else:
        live = 0
    for i in range(live):  # a few very long spans
        x = int(g[i])
        for k in range(j, int(left[i]), 8):
            v = int.from_bytes(padded[s[i] + k:s[i] + min(k + 8, int(left[i]))].tobytes(), "little")
            x = (int(mix(np.array([x ^ v], np.uint64))[0]) + 0x9E3779B97F4A7C15) % 2**64
        g[i] = x
    h[order] = g
    return h


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (over text borders too;
    the caller keeps those inside a text)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = mix(h[:m] + np.uint64(n))
    for k in range(1, n):
        g = mix(g * np.uint64(3) + h[k:m + k])
    return g


def owner_of(first: np.ndarray) -> np.ndarray:
    """Text index of each item, from the texts' first item indexes."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + l) for each pair."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)
