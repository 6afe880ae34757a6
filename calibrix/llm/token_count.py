"""Token counts by byte-pair merging, with no ids emitted.

A word starts as one symbol per byte (the last carries the end-of-word mark);
a heap over the linked symbols pops the lowest-rank adjacent pair until none
is left. The count is the initial symbols minus the merges. The merge table is
read on the driver from a tokenizer file (its size bounds what is sent to
tasks). Texts are read whole, once, with no shuffle.

Cases: a null or empty text has 0 bytes and 0 tokens; a special token's string
inside a text counts one; repeated rows give repeated results; extra columns
are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.llm.text import batch_limits, pieces

# Words a task remembers before it starts afresh.
KEPT = 400_000
# The file's split pattern, white space as the Unicode property; fixed.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes
    that print stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def read_merges(path: str) -> tuple[dict[tuple[str, str], int], str, list[str]]:
    """(pair ranks, end-of-word mark, special strings) of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
    special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
    return {p: i for i, p in enumerate(pairs)}, model.get("end_of_word_suffix") or "", special


def count_merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of merges: lowest rank first, leftmost on ties."""
    n = len(symbols)
    get = ranks.get
    part = list(symbols)
    nxt = list(range(1, n + 1))
    prev = list(range(-1, n - 1))
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := get((part[i], part[i + 1]))) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heappop(heap)
        j = nxt[i]
        if part[i] != a or j >= n or part[j] != b:
            continue
        part[i], part[j] = a + b, ""
        merges += 1
        nxt[i] = k = nxt[j]
        if k < n:
            prev[k] = i
            if (r := get((part[i], part[k]))) is not None:
                heappush(heap, (r, i, part[i], part[k]))
        p = prev[i]
        if p >= 0 and (r := get((part[p], part[i]))) is not None:
            heappush(heap, (r, p, part[p], part[i]))
    return merges


# Lower case of capitals newer than this Python's character data,
# where the library's own data has one.
NEWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
    0xA7DC: 0x019B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


class Counter:
    def __init__(self, merges: dict[tuple[str, str], int], mark: str, special: list[str]):
        self.ranks, self.mark = merges, mark
        self.symbols = byte_symbols()
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = regex.compile(WORDS).findall
        self.known: dict[str, int] = {}

    def word(self, w: str) -> int:
        symbols = [self.symbols[b] for b in w.encode()]
        symbols[-1] += self.mark
        return len(symbols) - count_merges(symbols, self.ranks)

    def plain(self, text: str) -> int:
        if not text.isascii():
            # Lower-casing is per character: no final form of the sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").translate(NEWER)
        parts = self.words(text.lower())
        known = self.known
        for w in set(parts).difference(known):
            known[w] = self.word(w)
        total = sum(map(known.__getitem__, parts))
        if len(known) > KEPT:
            known.clear()
        return total

    def text(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        cut = self.special.split(text)
        return sum(map(self.plain, cut)) + len(cut) - 1


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per input row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_merges(tokenizer_path))
    batch_limits(spark)

    def run(batches):
        counter = Counter(*shared.value)
        for rows, buf, off in pieces(batches, "_text", 1 << 20):
            data = buf.tobytes()
            n = [counter.text(data[off[i]:off[i + 1]].decode("utf-8", "replace")) for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(off[1:] - off[:-1], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
            .mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"))
