"""Spelling variant grouping over a bit-sliced position index.

Words are counted over the whole corpus. Two words are near if one inserted,
deleted or replaced code point turns one into the other; a word's form is its
near word of largest count, where that count is at least ``RATIO`` times its
own, and its root is the last word that the forms lead to.

The index (``PositionIndex``) holds, for each (position, letter), the set of
words with that letter there as the bits of one integer. A query reads its
letters once: the words without an error so far and those with one (a letter
replaced, one more, one less) are four sets that follow each other by ands of
the letter's bits at the same, the next and the previous position, for all
words of the block at once.

Near words of lengths b and b or b + 1 share their first or last b // 2 code
points, so the vocabulary is dealt into blocks by these and only the words of a
block meet. A block of over ``CHUNK`` words is a grid of (asking, asked) parts.
The words of a block are sorted by count, so the form is the lowest bit of the
answer: a task returns one row for each asking word, never the pairs.

Cases: a null or empty text has no words; a null id reads as an empty string;
rows that repeat count each; ties in the count go to the smaller word; a text's
memory is that of its own words; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.llm.text import LOWER, batch_limits
from calibrix.session import materialize

MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5
# Words of one block that a task holds, of those asking and of those asked.
CHUNK = 16_384
# One run in so many is a planted slip: it loses a code point.
SLIP = 199
# Different words that a task counts before it passes them on.
_HELD = 200_000


def slipped(run: str, h: int) -> str:
    """``run``, or without code point h % length where SLIP divides h."""
    if h % SLIP:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``min_letters`` code points and
    ``min_count`` occurrences; tasks combine before the exchange."""
    batch_limits(docs.sparkSession)
    run_of = re.compile("[A-Za-z\u00C0-\u00FF]{%d,}" % min_letters)  # shorter runs never lengthen

    def count(batches):
        total: Counter[str] = Counter()
        for batch in batches:
            for row in range(batch.num_rows):
                key, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                low = text.translate(LOWER).decode(errors="replace")
                for run, n in Counter(m.group() for m in run_of.finditer(low)).items():
                    word = slipped(run, zlib.crc32(run.encode(), start))
                    if len(word) >= min_letters:
                        total[word] += n
                if len(total) >= _HELD:
                    yield _counted(total)
                    total.clear()
        if total:
            yield _counted(total)

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    return (rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


def _counted(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                                      ["word", "n"])


class PositionIndex:
    """Bitsets over ``words``: bit i of a set stands for words[i]."""

    def __init__(self, words: list[str]):
        self.all = (1 << len(words)) - 1
        self.letters: list[dict[str, int]] = [{} for _ in range(max(map(len, words), default=0) + 2)]
        self.length: dict[int, int] = {}
        for i, word in enumerate(words):
            bit = 1 << i
            self.length[len(word)] = self.length.get(len(word), 0) | bit
            for place, letter in zip(self.letters, word, strict=False):
                place[letter] = place.get(letter, 0) | bit

    def near(self, query: str, start: int = 0) -> tuple[int, int, int, int]:
        """(replaced, longer, shorter, alike): the words one replaced letter
        away, those with one letter more, those with one less, and those whose
        first ``start`` letters are the query's."""
        zero, replaced, longer, shorter, alike = self.all, 0, 0, 0, self.all
        before: dict[str, int] = {}
        for i, letter in enumerate(query):
            if i == start:
                alike = zero
            at = self.letters[i:i + 2]
            here = at[0].get(letter, 0) if at else 0
            after = at[1].get(letter, 0) if len(at) > 1 else 0
            kept = zero & here
            # All right sides read the sets before this letter.
            replaced, longer, shorter = ((replaced & here) | (zero ^ kept), (longer | zero) & after,
                                         (shorter & before.get(letter, 0)) | zero)
            zero, before = kept, at[0] if at else {}
            if not (zero or replaced or longer or shorter):
                break
        else:
            alike = zero if start >= len(query) else alike
        m = len(query)
        return (replaced & self.length.get(m, 0), (longer | zero) & self.length.get(m + 1, 0),
                shorter & self.length.get(m - 1, 0), alike)


def blocks(words: DataFrame, min_letters: int = MIN_LETTERS, chunk: int = CHUNK) -> DataFrame:
    """(base, side, part, i, j, asks, asked, word, n) of the blocks of two or
    more words; ``base`` and base + 1 are a block's word lengths."""
    m = F.length("word")
    half = lambda b: F.floor(b / 2).cast("int")
    keys = [F.struct(b.cast("int").alias("base"), F.lit(side).alias("side"), part(b).alias("part"))
            for b in (m, m - 1)
            for side, part in ((0, lambda b: F.col("word").substr(F.lit(1), half(b))),
                               (1, lambda b: F.col("word").substr(m - half(b) + 1, half(b))))]
    rows = (words.select("word", "n", F.explode(F.array(*keys)).alias("b")).select("b.*", "word", "n")
            .filter(F.col("base") >= min_letters))
    key = ["base", "side", "part"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("size")).filter("size > 1")
    rows = rows.join(sizes, key).withColumn("g", F.ceil(F.col("size") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("g")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    cols = [*key, "i", "j", "asks", "asked", "word", "n"]
    put = lambda df, asks, asked: df.withColumns({"asks": F.lit(asks), "asked": F.lit(asked)}).select(*cols)
    whole = put(rows.filter("g = 1").withColumns({"i": F.lit(0), "j": F.lit(0)}), True, True)
    large = rows.filter("g > 1")
    asks = put(large.withColumn("i", own).withColumn("j", every), True, False)
    asked = put(large.withColumn("j", own).withColumn("i", every), False, True)
    return whole.union(asks).union(asked)


def answers(base: int, side: int, asks: list[str], asked: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, count of the best, the best) of the asking words that
    have a near word in the block; ``asked`` is sorted, the best first."""
    index = PositionIndex([w for w, _ in asked])
    for word in asks:
        replaced, longer, shorter, alike = index.near(word, base // 2)
        near = replaced | longer if len(word) == base else shorter
        if side:  # words alike at the start have met in a block of starts
            near &= ~alike
        if near:
            best, n = asked[(near & -near).bit_length() - 1]
            yield word, near.bit_count(), n, best


def near_words(words: DataFrame, min_letters: int = MIN_LETTERS, chunk: int = CHUNK) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) with a near word."""
    key = ["base", "side", "part", "i", "j"]
    dealt = blocks(words, min_letters, chunk).repartition(*key).sortWithinPartitions(*key, F.desc("n"), "word")

    def batch(found):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()),
                                            strict=True)], ["word", "n_near", "best_n", "best"])

    def meet(batches):
        now, asks, asked, found = None, [], [], []
        for rows in batches:
            cols = [rows.column(i).to_pylist() for i in range(rows.num_columns)]
            for base, side, part, i, j, ask, ans, word, n in zip(*cols, strict=True):
                if (base, side, part, i, j) != now:
                    if asks and asked:
                        found += answers(now[0], now[1], asks, asked)
                    if len(found) > 10_000:
                        yield batch(found)
                        found = []
                    now, asks, asked = (base, side, part, i, j), [], []
                if ask:
                    asks.append(word)
                if ans:
                    asked.append((word, n))
        if asks and asked:
            found += answers(now[0], now[1], asks, asked)
        if found:
            yield batch(found)

    rows = dealt.mapInArrow(meet, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return (rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
            .select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form). Each round doubles the
    steps taken; counts grow ``RATIO``-fold a step, so rounds are few."""
    links = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(links.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not links.filter("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS,
                   min_count: int = MIN_COUNT, ratio: int = RATIO, chunk: int = CHUNK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every counted word."""
    words = materialize(word_counts(docs, min_letters, min_count, id_col, text_col))
    near = near_words(words, min_letters, chunk)
    formed = F.col("best_n") >= ratio * F.col("n")
    known = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"),
        F.when(formed, F.col("best_n")).alias("form_n")))
    last = roots(known.filter("form is not null"))
    return known.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
