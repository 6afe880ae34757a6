"""Suffix-array dedup of repeated byte strings with run-length indexes.

Every byte covered by a ``REACH``-byte string that also starts earlier (a
smaller id, or the same document further left) goes; strings are judged on the
input. Texts are packed into pieces of a few MB, written once. Then:

1. Anchors. The least hash of the 32-byte strings in each window of ``REACH``
   bytes cuts a text into segments of windows that share their anchor. Equal
   windows have equal anchors, so only segments of one anchor can match. A
   segment is at most 168 bytes long and travels as two hashes and its place.
2. Equal segments. Among segments with the same bytes all but the earliest are
   removed whole: first inside ``GROUP`` pieces, whose copies become notes of
   their pieces there and then, then over all. A passage of every document so
   sends its anchor's task one record of 50 bytes for each group of pieces.
3. Different segments of one anchor (edges of passages, near copies) are cut
   from their pieces and brought together in blocks. Each block gets a
   run-compressed Burrows-Wheeler index with sampled run ends; all its segments
   are streamed through, and places whose match of ``REACH`` bytes starts
   earlier are marked. An anchor with more than ``HOT`` different segments is
   not gathered: its windows are grouped by two 64-bit digests instead, which
   combines in the tasks first.
4. The marked spans return to their pieces, and each text is cut.

Cases: null and empty texts have no bytes; a null id comes before all others;
rows of the same id and text are one document, indexed once and cut alike; a very long text is a piece of its own (the
order of rows of one id with different texts follows a hash of the text); matches never cross
documents; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.llm.run_index import later_matches
from calibrix.llm.text import batch_limits, mix, pieces, ranges, span_hash
from calibrix.session import materialize

REACH = 100
ANCHOR = 32
PIECE = 2 << 20
# Pieces whose equal segments are settled together before any exchange.
GROUP = 8
# Different segments of one anchor above which it is not gathered in a block.
HOT = 20_000
# Segment bytes of one index, and anchors that one task of step 2 holds.
BLOCK_BYTES = 1 << 20
TASK_ANCHORS = 1_000_000

# A segment's place: order of documents (null first, id, text hash), start.
PLACE = [("some", "i1"), ("id", "i8"), ("key", "i8"), ("start", "i8")]
ANCHORS = np.dtype([("h", "u8"), ("s", "u8"), *PLACE, ("row", "i4"), ("len", "i4"), ("loop", "i1")])
# What returns to a piece: kind 0 removes a span; 1 and 2 want its bytes (2: hot anchor).
NOTES = np.dtype([("kind", "i1"), ("h", "u8"), ("row", "i4"), ("start", "i8"), ("len", "i4")])
SEGMENTS = np.dtype([("h", "u8"), *PLACE, ("piece", "i8"), ("row", "i4"), ("len", "i4")])


def _pack(x: np.ndarray) -> bytes:
    """Columns of a record array one after the other, compressed."""
    raw = b"".join(np.ascontiguousarray(x[n]).tobytes() for n in x.dtype.names)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = np.empty(len(raw) // kind.itemsize, kind), 0
    for n in kind.names:
        size = kind[n].itemsize * len(out)
        out[n] = np.frombuffer(raw[at:at + size], kind[n])
        at += size
    return out


def _join(blobs, kind: np.dtype) -> np.ndarray:
    got = [_unpack(b, kind) for b in blobs]
    return np.concatenate(got) if got else np.empty(0, kind)


def _place_order(x: np.ndarray, *lead: np.ndarray) -> np.ndarray:
    """Order by the leading keys, then by place."""
    return np.lexsort((x["start"], x["key"], x["id"], x["some"], *lead[::-1]))


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(piece, n, bytes, ids, keys, lens, data): texts in pieces, compressed."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for rows, buf, off in pieces(batches, "text", PIECE):
            ids = rows.column(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows.num_rows], pa.int64()), pa.array([len(buf)], pa.int64()),
                 pa.array([np.asarray(ids.is_valid()).astype(np.int8).tobytes()
                           + np.asarray(ids.fill_null(0)).astype("<i8").tobytes()], pa.binary()),
                 pa.array([np.asarray(rows.column(1)).astype("<i8").tobytes()], pa.binary()),
                 pa.array([np.diff(off).astype("<i8").tobytes()], pa.binary()),
                 pa.array([squeeze.compress(buf.tobytes())], pa.binary())],
                ["n", "bytes", "ids", "keys", "lens", "data"])

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.xxhash64("text").alias("k"), "text")
    packed = own.mapInArrow(run, "n bigint, bytes bigint, ids binary, keys binary, lens binary, data binary")
    return packed.withColumn("piece", F.monotonically_increasing_id())


class Piece:
    """One packed piece, unpacked."""

    def __init__(self, row: dict):
        n = row["n"]
        self.some = np.frombuffer(row["ids"][:n], np.int8)
        self.ids = np.frombuffer(row["ids"][n:], "<i8")
        self.keys = np.frombuffer(row["keys"], "<i8")
        lens = np.frombuffer(row["lens"], "<i8")
        self.off = np.concatenate([[0], np.cumsum(lens)])
        data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(row["bytes"], 1))
        self.buf = np.frombuffer(data, np.uint8)
        self.piece = row["piece"]


def _rows(batches):
    for b in batches:
        names = b.schema.names
        for i in range(b.num_rows):
            yield {n: b.column(j)[i].as_py() for j, n in enumerate(names)}


def gram_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each place (zeros beyond the end)."""
    padded = np.concatenate([buf, np.zeros(size + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(buf) + size,), strides=(1,))
    h = np.full(len(buf), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(0, size, 8):
        h ^= words[j:j + len(buf)]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive ones."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def segments(buf: np.ndarray, off: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, text, first window, windows, loop) of each segment:
    windows in a row with one anchor, cut after as many as an anchor can have
    (so repeats of a short period stay bounded). A segment in which the anchor
    stands twice may match itself (loop)."""
    width = reach - ANCHOR + 1
    z = np.zeros(0, np.int64)
    if len(buf) < reach:
        return z.astype(np.uint64), z, z, z, z.astype(bool)
    grams = gram_hashes(buf, ANCHOR)[:len(buf) - ANCHOR + 1]
    least = sliding_min(grams, width)
    # Windows inside one text, text by text.
    n = np.maximum(np.diff(off) - reach + 1, 0)
    at = ranges(off[:-1], n)
    text = np.repeat(np.arange(len(n)), n)
    if not len(at):
        return z.astype(np.uint64), z, z, z, z.astype(bool)
    value = least[at]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    parts = -(-size // width)
    begin = np.repeat(begin, parts) + ranges(np.zeros(len(parts), np.int64), parts) * width
    size = np.diff(np.append(begin, len(at)))
    value, first = value[begin], at[begin]
    # Anchors: grams that are the least of some window, so equal to the largest
    # of the window minima around them.
    none = np.zeros(width - 1, np.uint64)
    most = ~sliding_min(~np.concatenate([none, least, none]), width)
    anchors = np.flatnonzero(most == grams)
    lo = np.searchsorted(anchors, first)
    n = np.searchsorted(anchors, first + size + width - 1) - lo
    hits = grams[anchors[ranges(lo, n)]] == np.repeat(value, n)
    total = np.concatenate([[0], np.cumsum(hits)])
    ends = np.cumsum(n)
    return value, text[begin], first, size, total[ends] - total[ends - n] > 1


def anchor_rows(packed: DataFrame, reach: int, tasks: int) -> DataFrame:
    """(task, piece, rows, settled): step 1, with equal segments of ``GROUP``
    pieces settled. Only the earliest of them goes to its anchor's task; the
    copies are notes already, dealt by piece, so a passage of every document
    sends an anchor's task one record for each group of pieces."""

    def found(p: Piece) -> np.ndarray:
        h, text, at, windows, loop = segments(p.buf, p.off, reach)
        x = np.empty(len(h), ANCHORS)
        x["h"], x["row"], x["len"] = h, text, windows + reach - 1
        x["s"] = span_hash(p.buf, at, at + windows + reach - 1, 5)
        x["some"], x["id"], x["key"] = p.some[text], p.ids[text], p.keys[text]
        x["start"], x["loop"] = at - p.off[text], loop
        return x

    def sent(pieces_: list[int], blocks: list[np.ndarray]):
        """Rows of a group of pieces."""
        x = np.concatenate(blocks)
        owner = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
        copy = np.zeros(len(x), bool)
        copy[_copies(x)] = True
        out = []
        for i, piece in enumerate(pieces_):
            mine = x[(owner == i) & copy]
            if len(mine):
                y = np.zeros(len(mine), NOTES)
                for n in ("h", "row", "start", "len"):
                    y[n] = mine[n]
                out.append((piece % tasks, piece, _pack(y), True))
            mine = x[(owner == i) & ~copy]
            task = (mix(mine["h"]) % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(task, kind="stable")
            cuts = np.searchsorted(task[order], np.arange(tasks + 1))
            out += [(t, piece, _pack(mine[order[cuts[t]:cuts[t + 1]]]), False) for t in np.flatnonzero(np.diff(cuts)).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.bool_()),
                                                strict=True)], ["task", "piece", "rows", "settled"])

    def run(batches):
        pieces_, blocks = [], []
        for row in _rows(batches):
            p = Piece(row)
            pieces_.append(p.piece)
            blocks.append(found(p))
            if len(blocks) == GROUP or sum(b.nbytes for b in blocks) > GROUP * PIECE:
                yield from sent(pieces_, blocks)
                pieces_, blocks = [], []
        if blocks:
            yield from sent(pieces_, blocks)

    return packed.mapInArrow(run, "task bigint, piece bigint, rows binary, settled boolean")


def _copies(x: np.ndarray) -> np.ndarray:
    """Indexes of the segments equal to an earlier one (both hashes agree); rows
    of one place (a repeated document) count as that place."""
    g = mix(x["h"] ^ mix(x["s"]))
    order = np.argsort(g)
    s = g[order]
    twin = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        twin[1:] |= eq
        twin[:-1] |= eq
    some = order[twin]
    if not len(some):
        return some
    some = some[_place_order(x[some], g[some], x["h"][some], x["s"][some])]
    y = x[some]
    new = np.concatenate([[True], (y["h"][1:] != y["h"][:-1]) | (y["s"][1:] != y["s"][:-1])])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]  # the earliest of each group
    same = np.ones(len(y), bool)
    for n, _ in PLACE:
        same &= y[n] == y[n][lead]
    return some[~same]


def _new_places(x: np.ndarray) -> np.ndarray:
    """Indexes of segments, ordered by anchor and place, that start a new place."""
    new = np.zeros(len(x), bool)
    new[:1] = True
    for n in ("h", *(n for n, _ in PLACE)):
        new[1:] |= x[n][1:] != x[n][:-1]
    return np.flatnonzero(new)


def settle(anchors: DataFrame, tasks: int, hot: int) -> DataFrame:
    """(piece, notes): step 2, and which segments step 3 must compare."""

    def run(batches):
        piece, blobs = [], []
        for row in _rows(batches):
            if row["settled"]:  # notes of their piece already
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["piece"]], pa.int64()), pa.array([row["rows"]], pa.binary()),
                     pa.array([False]), pa.array([False])], ["piece", "notes", "wants", "hot"])
                continue
            blobs.append(_unpack(row["rows"], ANCHORS))
            piece.append(np.full(len(blobs[-1]), row["piece"]))
        if not blobs:
            return
        x, piece = np.concatenate(blobs), np.concatenate(piece)
        gone = np.zeros(len(x), bool)
        gone[_copies(x)] = True
        kind = np.where(gone, 0, -1).astype(np.int8)
        left = np.flatnonzero(~gone)
        by = left[np.argsort(x["h"][left])]
        h = x["h"][by]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(by)))[np.cumsum(new) - 1] if len(by) else np.zeros(0, np.int64)
        # Anchors with one place only, however many rows repeat it, have nothing to compare.
        other = np.zeros(len(by), bool)
        for n, _ in PLACE:
            other |= x[n][by] != x[n][by[first]][np.cumsum(new) - 1] if len(by) else False
        many = np.logical_or.reduceat(other, first)[np.cumsum(new) - 1] if len(by) else other
        asks = many | (x["loop"][by] > 0)
        kind[by[asks]] = 1
        kind[by[asks & (size > hot)]] = 2
        use = np.flatnonzero(kind >= 0)
        use = use[np.argsort(piece[use], kind="stable")]
        owner, y = piece[use], np.empty(len(use), NOTES)
        y["kind"] = kind[use]
        for n in ("h", "row", "start", "len"):
            y[n] = x[n][use]
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(use) else []
        yield from _notes(owner, y, begin)

    return anchors.repartition(tasks, "task").mapInArrow(run, "piece bigint, notes binary, wants boolean, hot boolean")


def _notes(owner, y, begin):
    end = np.append(begin, len(y)).astype(np.int64)
    if len(begin):
        yield pa.RecordBatch.from_arrays(
            [pa.array(owner[begin], pa.int64()),
             pa.array([_pack(y[a:b]) for a, b in zip(end[:-1], end[1:], strict=True)], pa.binary()),
             *(pa.array([bool((y["kind"][a:b] >= k).any()) for a, b in zip(end[:-1], end[1:], strict=True)])
               for k in (1, 2))],
            ["piece", "notes", "wants", "hot"])


def wanted(packed: DataFrame, notes: DataFrame, tasks: int, kinds: int) -> DataFrame:
    """Segments of one kind of note, cut from their pieces:
    (task, head, data) with compressed records and bytes."""
    asked = notes.filter("wants").groupBy("piece").agg(F.collect_list("notes").alias("notes"))

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for row in _rows(batches):
            p, y = Piece(row), _join(row["notes"], NOTES)
            y = y[y["kind"] == kinds]
            x = np.empty(len(y), SEGMENTS)
            for n in ("h", "row", "start", "len"):
                x[n] = y[n]
            x["some"], x["id"], x["key"], x["piece"] = p.some[y["row"]], p.ids[y["row"]], p.keys[y["row"]], p.piece
            task = (mix(x["h"] + np.uint64(1)) % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(task, kind="stable")
            cuts = np.searchsorted(task[order], np.arange(tasks + 1))
            full = np.flatnonzero(np.diff(cuts))
            heads, data = [], []
            for t in full:
                z = x[order[cuts[t]:cuts[t + 1]]]
                heads.append(_pack(z))
                data.append(squeeze.compress(p.buf[ranges(p.off[z["row"]] + z["start"], z["len"].astype(np.int64))].tobytes()))
            if len(full):
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(heads, pa.binary()),
                                                  pa.array(data, pa.binary())], ["task", "head", "data"])

    return packed.join(asked, "piece").mapInArrow(run, "task bigint, head binary, data binary")


def index_blocks(cut: DataFrame, tasks: int, reach: int) -> DataFrame:
    """(piece, notes): step 3 by run-length indexes, anchors in whole blocks."""

    def run(batches):
        heads, data = [], []
        unsqueeze = zstandard.ZstdDecompressor()
        for row in _rows(batches):
            heads.append(_unpack(row["head"], SEGMENTS))
            data.append(unsqueeze.decompress(row["data"]))
        if not heads:
            return
        x = np.concatenate(heads)
        buf = np.frombuffer(b"".join(data), np.uint8)
        del heads, data
        lens = x["len"].astype(np.int64)
        starts = np.cumsum(lens) - lens
        order = _place_order(x, x["h"])
        x, starts, lens = x[order], starts[order], lens[order]
        # Rows of one place (a repeated document) are indexed once.
        lead = _new_places(x)
        rows = np.diff(np.append(lead, len(x)))
        h, starts, lens = x["h"][lead], starts[lead], lens[lead]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        edge = np.append(edge, len(h))
        total = np.concatenate([[0], np.cumsum(lens)])
        found, a = [], 0
        while a < len(edge) - 1:  # whole anchors, up to BLOCK_BYTES
            b = max(int(np.searchsorted(total[edge], total[edge[a]] + BLOCK_BYTES, "right")) - 1, a + 1)
            lo, hi = edge[a], edge[b]
            # Anchors cannot match each other, so places may be told apart by any
            # order that keeps each anchor's own segments in theirs.
            string, offset = later_matches(buf, starts[lo:hi], lens[lo:hi], reach)
            n = rows[lo + string]
            own, offset = ranges(lead[lo + string], n), np.repeat(offset, n)
            y = np.empty(len(own), NOTES)
            y["kind"], y["h"], y["row"] = 0, 0, x["row"][own]
            y["start"], y["len"] = x["start"][own] + offset, reach
            found.append((x["piece"][own], y))
            a = b
        owner, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.lexsort((y["start"], y["row"], owner))
        owner, y = owner[order], y[order]
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(y) else []
        yield from _notes(owner, y, begin)

    return cut.repartition(tasks, "task").mapInArrow(run, "piece bigint, notes binary, wants boolean, hot boolean").drop("wants", "hot")


def hot_windows(cut: DataFrame, reach: int) -> DataFrame:
    """(piece, notes): step 3 for anchors of very many segments, window by
    window; a window of every document is combined in the tasks first, and the
    join back splits it as a skewed key."""
    names = ["w1", "w2", "some", "id", "key", "start", "piece", "row"]

    def run(batches):
        unsqueeze = zstandard.ZstdDecompressor()
        for r in _rows(batches):
            x, buf = _unpack(r["head"], SEGMENTS), np.frombuffer(unsqueeze.decompress(r["data"]), np.uint8)
            lens = x["len"].astype(np.int64)
            n = lens - reach + 1
            at = ranges(np.cumsum(lens) - lens, n)
            own = np.repeat(np.arange(len(x)), n)
            offset = ranges(np.zeros(len(n), np.int64), n)
            w = [span_hash(buf, at, at + reach, seed).view(np.int64) for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (*w, *(x[k][own].astype(np.int64) for k in ("some", "id", "key")),
                                       x["start"][own] + offset, x["piece"][own], x["row"][own].astype(np.int64))], names)

    rows = materialize(cut.mapInArrow(run, ", ".join(f"{n} bigint" for n in names)))
    place = F.struct("some", "id", "key", "start")
    first = rows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = rows.join(first, ["w1", "w2"]).filter(place != F.col("first")).select("piece", "row", "start")

    def notes(batches):
        for b in batches:
            owner = np.asarray(b.column(0))
            order = np.argsort(owner, kind="stable")
            y = np.zeros(len(owner), NOTES)
            y["row"], y["start"], y["len"] = np.asarray(b.column(1))[order], np.asarray(b.column(2))[order], reach
            owner = owner[order]
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
            yield from _notes(owner, y, begin)

    return later.mapInArrow(notes, "piece bigint, notes binary, wants boolean, hot boolean").drop("wants", "hot")


def cut_texts(packed: DataFrame, notes: DataFrame) -> DataFrame:
    """Step 4: (doc_id, n_bytes, n_removed, kept, spans) per document."""
    marks = notes.groupBy("piece").agg(F.collect_list("notes").alias("notes"))

    def run(batches):
        for row in _rows(batches):
            p, y = Piece(row), _join(row["notes"] or [], NOTES)
            y = y[y["kind"] == 0]
            n = len(p.buf)
            at = p.off[y["row"]] + y["start"]
            depth = np.bincount(at, minlength=n + 1) - np.bincount(at + y["len"], minlength=n + 1)
            gone = np.cumsum(depth)[:n] > 0
            lens = np.diff(p.off)
            kept = p.buf[~gone].tobytes()
            removed = np.concatenate([[0], np.cumsum(gone)])
            removed = removed[p.off[1:]] - removed[p.off[:-1]]
            to = np.concatenate([[0], np.cumsum(lens - removed)])
            border = np.zeros(n + 1, bool)
            border[p.off] = True
            start = np.flatnonzero(gone & (border[:n] | ~np.concatenate([[False], gone[:-1]]))) if n else np.zeros(0, int)
            end = np.flatnonzero(gone & (border[1:] | ~np.concatenate([gone[1:], [False]]))) + 1 if n else start
            own = np.searchsorted(p.off, start, "right") - 1
            cuts = np.searchsorted(own, np.arange(len(lens) + 1))
            spans = pa.ListArray.from_arrays(
                pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(start - p.off[own], pa.int64()), pa.array(end - p.off[own], pa.int64())], ["start", "end"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.ids, pa.int64(), mask=p.some == 0), pa.array(lens, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array([kept[a:b] for a, b in zip(to[:-1], to[1:], strict=True)], pa.binary()), spans],
                ["doc_id", "n_bytes", "n_removed", "kept", "spans"])

    return packed.join(marks, "piece", "left").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH,
                 hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept binary, spans) per input row; spans
    are the maximal removed runs, as byte offsets in the text. ``reach`` is 40
    or more."""
    if reach < ANCHOR + 8:
        raise ValueError("reach must be 40 or more")
    spark = docs.sparkSession
    batch_limits(spark)
    packed = materialize(pack(docs, id_col, text_col))
    size = packed.agg(F.sum("bytes")).first()[0] or 0
    # Tasks in step with the input: about one anchor in 36 bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (36 * TASK_ANCHORS)))
    notes = materialize(settle(anchor_rows(packed, reach, tasks), tasks, hot))
    found = [notes.select("piece", "notes"), index_blocks(wanted(packed, notes, tasks, 1), tasks, reach)]
    if notes.filter("hot").limit(1).count():
        found.append(hot_windows(wanted(packed, notes, tasks, 2), reach))
    marks = found[0]
    for f in found[1:]:
        marks = marks.unionByName(f)
    return cut_texts(packed, marks)
