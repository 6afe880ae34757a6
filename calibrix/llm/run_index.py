"""Run-length index of a block of byte strings.

The suffixes of all strings are ordered (a string's end sorts before any byte,
ends among themselves by string number), the Burrows-Wheeler transform is kept
as runs, and text positions are sampled at run ends and string starts only. Strings are streamed
through the index from their last byte to their first, all in step: each LF
step yields the row of the next longer suffix, and a row's class (rows whose
first ``reach`` bytes agree) tells which other places match that far.
"""

from __future__ import annotations

import numpy as np

from calibrix.llm.text import ranges


class RunIndex:
    def __init__(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, reach: int):
        """Index ``buf[s:s + n]`` of each pair; ``reach`` (7 or more) is the match length sought."""
        m = len(lens)
        total = int(lens.sum()) + m
        self.lens, self.reach = lens, reach
        self.first = np.cumsum(lens + 1) - (lens + 1)  # of each string in the joined text
        text = np.zeros(total, np.uint16)  # 0 ends a string, a byte b is b + 1
        text[ranges(self.first, lens)] = buf[ranges(starts, lens)].astype(np.uint16) + 1
        ends = self.first + lens
        left = np.repeat(ends, lens + 1) - np.arange(total)  # bytes up to the end
        order, classes = self._order(text, left, int(lens.max(initial=0)))
        bwt = text[order - 1]  # of a string's first byte: the end before it, never followed
        heads = np.concatenate([[0], np.flatnonzero(bwt[1:] != bwt[:-1]) + 1])
        self.run_start = heads
        self.run_char = bwt[heads].astype(np.int64)
        length = np.diff(np.append(heads, total))
        # Rows of the run's character in runs before it, plus smaller suffixes.
        by_char = np.argsort(self.run_char, kind="stable")
        before = np.empty(len(heads), np.int64)
        before[by_char] = np.cumsum(length[by_char]) - length[by_char]
        self.target = before  # row that the run's first row maps to
        self.run_end = heads + length - 1
        self.sample = order[self.run_end] - 1  # text position of the character at the run's end
        # A string's first byte follows no byte: its row and place are kept.
        self.whole_row = np.flatnonzero(bwt == 0)
        self.whole_at = order[self.whole_row]
        # Directories for the block's rows: run and class by one look-up.
        self.run_of = np.repeat(np.arange(len(heads), dtype=np.int32), length)
        self.n_classes = len(classes)
        self.class_of = np.repeat(np.arange(len(classes), dtype=np.int32), np.diff(np.append(classes, total)))

    def _order(self, text: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffix order, first rows of the classes) by prefix doubling from
        seven symbols a key."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint16)])
        key = np.zeros(n, np.uint64)
        for j in range(7):
            part = padded[j:j + n].astype(np.uint64)
            if j:
                part[left < j] = 0  # beyond the string's end nothing counts
            key = key << np.uint64(9) | part
        known, rank_half, half = 7, None, 0
        order = np.argsort(key, kind="stable")
        key = key[order]
        bits = int(n + 1).bit_length()
        while True:
            # Ranks of the first `known` symbols; equal ones stand by place.
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if known <= self.reach < 2 * known:
                rank_half, half = rank, known
            if rank_half is not None and (known > longest or new[-1] == n - 1):
                break
            after = np.zeros(n, np.int64)
            at = np.flatnonzero(left >= known)
            after[at] = rank[at + known] + 1
            known *= 2
            if 3 * bits <= 64:  # place packed below the key: sorting values beats sorting indexes
                key = (rank << bits | after).astype(np.uint64) << np.uint64(bits) | np.arange(n, dtype=np.uint64)
                key.sort()
                order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
                key >>= np.uint64(bits)
            else:
                key = rank.astype(np.uint64) * np.uint64(n + 1) + after.astype(np.uint64)
                order = np.argsort(key, kind="stable")
                key = key[order]
        a, b = order[:-1], order[1:]
        far = self.reach - half
        same = (left[a] >= self.reach) & (left[b] >= self.reach) & (rank_half[a] == rank_half[b])
        same[same] = rank_half[a[same] + far] == rank_half[b[same] + far]
        return order, np.concatenate([[0], np.flatnonzero(~same) + 1])

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def back(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(LF rows, runs) of some rows."""
        run = self.run_of[rows]
        return self.target[run] + rows - self.run_start[run], run

    def stream(self):
        """Yield (string, offset, class) arrays of every place with ``reach``
        bytes ahead of it, longest strings first, from their ends backwards."""
        order = np.argsort(-self.lens, kind="stable")
        lens = self.lens[order]
        rows = order.astype(np.int64)  # the row of a string's end is its number
        for t in range(int(lens[0]) if len(lens) else 0):
            live = int(np.searchsorted(-lens, -t, "left"))  # longer than t
            here = rows[:live]
            nxt, run = self.back(here)
            at = self.first[order[:live]] + lens[:live] - t - 1
            end = here == self.run_end[run]
            if (self.sample[run[end]] != at[end]).any():
                raise RuntimeError("a sampled run end disagrees with the streamed place")
            rows[:live] = nxt
            if t + 1 >= self.reach:
                yield order[:live], lens[:live] - t - 1, self.class_of[nxt]

    def locate(self, row: int) -> int:
        """Text position of a row's suffix: LF steps up to a sampled row."""
        steps = 0
        while True:
            nxt, run = self.back(np.array([row]))
            if row == self.run_end[run[0]]:
                return int(self.sample[run[0]]) + 1 + steps
            if self.run_char[run[0]] == 0:
                return int(self.whole_at[np.searchsorted(self.whole_row, row)]) + steps
            row, steps = int(nxt[0]), steps + 1


def later_matches(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of each place whose ``reach`` bytes also stand at an
    earlier place: in an earlier string, or earlier in the same."""
    if not len(lens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = RunIndex(buf, starts, lens, reach)
    got = list(index.stream())
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    string, offset, classes = (np.concatenate(x) for x in zip(*got, strict=True))
    place = index.first[string] + offset
    first = np.full(index.n_classes, np.iinfo(np.int64).max)
    np.minimum.at(first, classes, place)
    later = place > first[classes]
    return string[later], offset[later]
