"""Conversation structure repair by lightest derivations.

A conversation's rows, by turn, are edited at least cost so that the roles read
``(s?(ua)+)?`` (an optional system message, then user and assistant in turn):
Keep 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty message)
5. Blank and duplicate rows must go; a truncated row that stays costs 5 more.
Of edits that cost the same, the least string of their initials (the audit) is
taken.

The edits are deductions over a weighted hypergraph. Its items are edits of a
row, (row, edit), and prefixes, (rows read, state of the role pattern); a prefix
and an edit of the next row derive the next prefix, a prefix alone derives
another by an insertion, and a prefix of all rows in a final state derives the
goal. Knuth's agenda pops items by (cost, audit) and the first pop of an item
is final, since every rule adds its cost and appends its letters: it is
monotone and never below its antecedents. Two audits of one item and cost
cannot begin one another (what one has more are insertions, which cost), so
appending keeps their order.

Rows that repeat each other are one row with a count before anything else is
exchanged. Rows are then ranged by conversation, turn, role and text and read
as a sorted stream; a conversation that lies inside one range and has at most
``HELD`` rows is repaired there and then. Longer ones, and those that reach over
a range's border, are cut into chunks: each chunk gives the lightest derivation
from every state to every state, these are combined in order, and the texts are
streamed through the digest with the audit. Such a conversation costs a task
the memory of its audit, a byte a row, whatever its texts.

Cases: null roles and texts read as one space, null turns come first and null
conversation ids are one conversation; rows of one turn are taken by role, then
text; an empty table gives an empty result; extra columns are ignored; a very
long text counts with its own bytes in the task that reads it.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.llm.text import batch_limits
from calibrix.session import materialize

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
# Rows (and bytes of text) of one conversation that a task holds, and rows of a chunk.
HELD = 1024
HELD_BYTES = 8 << 20
_SPACE = " \t\n\x0b\x0c\r"

# States: nothing yet, after s, after u, after a. Each reads at most these roles.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = (0, 1, 2, 3), (0, 3)
# The one of user and assistant that a state reads.
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
ROLE = {"u": "user", "a": "assistant"}


def edits(initial: str, must_go: bool, cut: bool, copies: int) -> list[tuple[int, str, str | None]]:
    """(cost, letters, role read) of the edits of a row; its further copies are
    duplicates and go with it."""
    rest, more = DELETE * (copies - 1), "D" * (copies - 1)
    out = [(DELETE + rest, "D" + more, None)]
    if not must_go:
        late = CUT if cut else 0
        if initial in ("s", "u", "a"):
            out.append((KEEP + late + rest, "K" + more, initial))
        out += [(REROLE + late + rest, "R" + more, role) for role in ROLE]
    return out


def lightest(rows: list[list[tuple[int, str, str | None]]], start: int, goals: tuple[int, ...] | None
             ) -> dict[int, tuple[int, str]]:
    """state -> (cost, audit) of the lightest derivations that read all rows
    from state ``start``: the lightest of ``goals`` alone, or of every state."""
    n = len(rows)
    # (cost, audit, row, kind, state or edit): an edit's own letters are its rule's.
    agenda = [(0, "", 0, 0, start)] + [(e[0], "", i, 1, k) for i, row in enumerate(rows) for k, e in enumerate(row)]
    heapq.heapify(agenda)
    prefixes: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    ready: list[list[int]] = [[] for _ in range(n)]

    def derive(i: int, state: int, edit: int) -> None:
        cost, letters, role = rows[i][edit]
        to = state if role is None else STEP.get((state, role))
        if to is not None and to not in prefixes[i + 1]:
            before = prefixes[i][state]
            heapq.heappush(agenda, (before[0] + cost, before[1] + letters, i + 1, 0, to))

    while agenda:
        cost, audit, i, kind, x = heapq.heappop(agenda)
        if kind:
            ready[i].append(x)
            for state in prefixes[i]:
                derive(i, state, x)
        elif x not in prefixes[i]:
            prefixes[i][x] = (cost, audit)
            if i == n and goals and x in goals:
                return {x: (cost, audit)}
            to = STEP[x, NEXT[x]]
            if to not in prefixes[i]:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", i, 0, to))
            if i < n:
                for edit in ready[i]:
                    derive(i, x, edit)
    return prefixes[n]


def replay(audit: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired messages; rows are (role, text, copies)."""
    state, left, role, text = 0, 0, "", ""
    for letter in audit:
        if letter == "I":
            state = STEP[state, NEXT[state]]
            yield ROLE["a" if state == 3 else "u"], ""
            continue
        if not left:
            role, text, left = next(rows)
        left -= 1
        if letter != "D":
            read = role[:1] if letter == "K" else NEXT[state]
            state = STEP[state, read]
            yield (role if letter == "K" else ROLE[read]), text


class Digest:
    """SHA-256 of messages as role:text lines."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.some else "") + f"{role}:{text}").encode())
        self.some = True


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text", every: int = 20) -> DataFrame:
    """(conv_id, turn, role, text, copies) with the planted faults, by the
    remainder of crc32(conv_id:turn): 0 no copy is left, 1 empties the text, 2
    takes its full stops, question and exclamation marks, 3 leaves two copies, 4
    makes the role user."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(read(conv_col), F.lit(":"), read(turn_col)).cast("binary")) % every
    text = read(text_col)
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                       read(role_col).alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def is_blank(text: str) -> bool:
    return not text.strip(_SPACE)


def is_cut(text: str) -> bool:
    return text.rstrip(_SPACE)[-1:] not in (".", "!", "?")


RESULT = ["gaps bigint", "blank bigint", "duplicate bigint", "truncated bigint", "illegal bigint", "cost bigint",
          "audit string", "repaired_sha256 string"]
NAMES = [c.split()[0] for c in RESULT]
_NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
LEGAL = ("su", "ua", "au")


def faults(rows) -> tuple[list, list[int], list[int | None]]:
    """(edits of each row, [blank, duplicate, truncated, illegal], turns) of a
    whole conversation (turn, role, text, copies)."""
    seen: set[tuple[str, str]] = set()
    counts, options, turns, before = [0, 0, 0, 0], [], [], None
    for turn, role, text, copies in rows:
        blank, again, cut = is_blank(text), (role, text) in seen, False
        seen.add((role, text))
        if blank:
            counts[0] += copies
        else:
            cut = not again and is_cut(text)
            counts[1] += copies - 1 + again
            counts[2] += cut
        initial = role[:1]
        counts[3] += copies - 1 + (before is not None and before + initial not in LEGAL)
        before = initial
        options.append(edits(initial, blank or again, cut, copies))
        turns.append(turn)
    return options, counts, turns


def repaired_at_once(rows: list[tuple[int | None, str, str, int]]) -> tuple:
    """The result row of a whole conversation."""
    if not rows:
        return _NOTHING
    options, counts, turns = faults(rows)
    (cost, audit), = lightest(options, 0, FINAL).values()
    digest = Digest()
    for message in replay(audit, ((r[1], r[2], r[3]) for r in rows)):
        digest.add(*message)
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return gaps, *counts, cost, audit, digest.sha.hexdigest()


_ROW = ["part bigint", "idx bigint", "turn bigint", "role string", "text string", "copies bigint"]
ROW_NAMES = [c.split()[0] for c in _ROW]


def _schema(conv: T.DataType, fields: list[str]) -> T.StructType:
    out = T.StructType([T.StructField("conv_id", conv)])
    for field in T._parse_datatype_string(", ".join(fields)).fields:
        out.add(field)
    return out


class Writer:
    """Rows of a schema as record batches of bounded size."""

    def __init__(self, schema: T.StructType, limit: int = HELD_BYTES):
        from pyspark.sql.pandas.types import to_arrow_schema
        self.schema, self.limit, self.rows, self.held = to_arrow_schema(schema), limit, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size + 64
        if self.held > self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, schema=self.schema)
        self.rows, self.held = [], 0


def rows_of(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def first_pass(rows: DataFrame, held: int) -> DataFrame:
    """Of ranged, sorted rows: the results of conversations that lie inside a
    range (``done``), and the rows of all others with their place."""
    schema = _schema(rows.schema["conv_id"].dataType, ["done boolean", *RESULT, *_ROW])
    no_result, no_row = (None,) * len(RESULT), (None,) * len(_ROW)

    def run(batches):
        part, idx, out = TaskContext.get().partitionId(), 0, Writer(schema)
        # open_: the rows of this conversation go to the second pass.
        first, now, own, size, open_ = True, None, [], 0, True

        def put(row):
            nonlocal idx
            idx += 1
            return out.add((now, False, *no_result, part, idx, *row), len(row[2]))

        for conv, *row in rows_of(batches):
            if first or conv != now:
                if not open_:
                    yield from out.add((now, True, *repaired_at_once(own), *no_row))
                # The first conversation of a range may have begun in the one before.
                first, open_, now, own, size = False, first, conv, [], 0
            if open_:
                yield from put(row)
            elif row[3]:  # else no copy is left
                own.append(row)
                size += len(row[2])
                if len(own) > held or size > HELD_BYTES:
                    for r in own:
                        yield from put(r)
                    own, open_ = [], True
        if not open_:  # the last may go on in the next range
            for r in own or [(None, " ", "", 0)]:
                yield from put(r)
        yield from out.flush()

    return rows.select("conv_id", "turn", "role", "text", "copies").mapInArrow(run, schema)


def flagged(rest: DataFrame) -> DataFrame:
    """The rows with a copy left, with blank, again (role and text seen
    earlier), cut and initial; the earliest place is a grouped minimum."""
    trimmed = F.btrim("text", F.lit(_SPACE))
    rows = rest.filter("copies > 0").withColumns({
        "blank": F.length(trimmed) == 0, "cut": ~F.substring(trimmed, -1, 1).isin(".", "!", "?"),
        "initial": F.substring("role", 1, 1), "digest": F.sha2("text", 256)})
    rows = rows.select("conv_id", "part", "idx", "turn", "role", "copies", "blank", "cut", "initial", "digest")
    firsts = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")
                          ).agg(F.min(F.struct("part", "idx")).alias("first"))
    same = (rows["conv_id"].eqNullSafe(firsts["_conv"]) & (rows["role"] == firsts["_role"])
            & (rows["digest"] == firsts["_digest"]))
    return rows.join(firsts, same).withColumn("again", F.struct("part", "idx") != F.col("first")).select(
        "conv_id", "part", "idx", "turn", "copies", "blank", "cut", "initial", "again")


_CHUNK = ["part bigint", "chunk bigint", "starts string", "ends string", "blank bigint", "duplicate bigint",
          "truncated bigint", "illegal bigint", "costs array<bigint>", "audits array<string>"]


def chunk_ways(rows: DataFrame, held: int) -> DataFrame:
    """For each chunk of ``held`` rows its counts, first and last role initial
    and, from every state to every state, its lightest cost and audit."""
    schema = _schema(rows.schema["conv_id"].dataType, _CHUNK)

    def ways(pdf):
        import pandas as pd
        pdf = pdf.sort_values("idx")
        options, illegal, before = [], 0, None
        for x in pdf.itertuples():
            gone = bool(x.blank or x.again)
            options.append(edits(x.initial, gone, bool(x.cut) and not gone, int(x.copies)))
            illegal += int(x.copies) - 1 + (before is not None and before + x.initial not in LEGAL)
            before = x.initial
        found = [lightest(options, state, None) for state in STATES]
        pairs = [found[p].get(q, (None, None)) for p in STATES for q in STATES]
        solid = pdf[~pdf.blank]
        return pd.DataFrame([(
            pdf.conv_id.iloc[0], pdf.part.iloc[0], pdf.chunk.iloc[0], pdf.initial.iloc[0], before,
            int(pdf.copies[pdf.blank].sum()), int((solid.copies - 1 + solid.again).sum()),
            int((solid.cut & ~solid.again).sum()), illegal, [c for c, _ in pairs], [a for _, a in pairs])],
            columns=schema.names)

    chunk = F.floor((F.col("idx") - 1) / held).cast("long")
    return rows.withColumn("chunk", chunk).groupBy("conv_id", "part", "chunk").applyInPandas(ways, schema)


def combined(chunks: DataFrame) -> DataFrame:
    """(conv_id, blank .. illegal, cost, audit): the chunks of a conversation in
    order; a prefix of chunks and a chunk's way derive the next prefix."""
    schema = _schema(chunks.schema["conv_id"].dataType, RESULT[1:-1])
    dealt = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")

    def run(batches):
        out = Writer(schema)
        for conv, group in groupby(rows_of(batches), key=lambda r: r[0]):
            counts, before, best = [0, 0, 0, 0], None, {0: (0, "")}
            for _, _, _, starts, ends, *own, costs, audits in group:
                counts = [a + b for a, b in zip(counts, own, strict=True)]
                counts[3] += before is not None and before + starts not in LEGAL
                before, ahead = ends, {}
                for p, (cost, audit) in best.items():
                    for q in STATES:
                        more, letters = costs[4 * p + q], audits[4 * p + q]
                        if more is not None and (q not in ahead or cost + more <= ahead[q][0]):
                            way = (cost + more, audit + letters)
                            ahead[q] = min(way, ahead.get(q, way))
                best = ahead
            yield from out.add((conv, *counts, *min(best[q] for q in FINAL if q in best)))
        yield from out.flush()

    return dealt.mapInArrow(run, schema)


def with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, audit, role, text, copies) as sorted streams: each conversation
    has its audit first, then its rows by turn."""
    head = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                         F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                         F.lit(0).cast("long").alias("copies"), "audit")
    body = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies",
                                            F.lit(None).cast("string").alias("audit"))
    return (head.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
            .select("conv_id", "audit", "role", "text", "copies"))


def streamed(stream: DataFrame, fields: list[str], each) -> DataFrame:
    """Rows that ``each`` (conversation, its repaired messages) yields with their size."""
    schema = _schema(stream.schema["conv_id"].dataType, fields)

    def run(batches):
        out = Writer(schema)
        for conv, group in groupby(rows_of(batches), key=lambda r: r[0]):
            audit = next(group)[1]
            for row, size in each(conv, replay(audit, ((r[2], r[3], r[4]) for r in group))):
                yield from out.add(row, size)
        yield from out.flush()

    return stream.mapInArrow(run, schema)


def second_pass(rest: DataFrame, held: int) -> DataFrame:
    """The results of conversations whose rows are in ``rest``."""
    rows = materialize(flagged(rest))
    solved = materialize(combined(chunk_ways(rows, held)))

    def digest(conv, messages):
        all_ = Digest()
        for message in messages:
            all_.add(*message)
        yield (conv, all_.sha.hexdigest()), 64

    hashes = streamed(with_audits(rest, solved), ["repaired_sha256 string"], digest)
    gaps = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    facts = rest.select("conv_id")
    for more in (solved, hashes, gaps):
        facts = facts.unionByName(more, allowMissingColumns=True)
    facts = facts.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in NAMES))  # one value of each at most
    return facts.select("conv_id", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in zip(NAMES, _NOTHING, strict=True)))


def collapsed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None
              ) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows that repeat each other as one."""
    copies = F.col(copies_col) if copies_col else F.lit(1)
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                       read(role_col).alias("role"), read(text_col).alias("text"), copies.cast("long").alias("copies")
                       ).groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", copies_col: str | None = None, held: int = HELD) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) per conversation. ``copies_col`` counts equal rows in one
    (0: the conversation is listed, the row is not there)."""
    batch_limits(rows.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    dealt = (collapsed(rows, conv_col, turn_col, role_col, text_col, copies_col)
             .repartitionByRange(*order).sortWithinPartitions(*order))
    read = materialize(first_pass(dealt, held))
    rest = read.filter("not done").select("conv_id", *ROW_NAMES)
    return read.filter("done").select("conv_id", *NAMES).union(second_pass(rest, held))


def repaired_messages(rows: DataFrame, repaired: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """(conv_id, place, role, text) of the messages after ``repaired``, the
    result of ``repair`` on the same rows."""
    def messages(conv, found):
        for place, (role, text) in enumerate(found):
            yield (conv, place, role, text), len(text)

    own = collapsed(rows, conv_col, turn_col, role_col, text_col, copies_col)
    return streamed(with_audits(own, repaired.select("conv_id", "audit")), ["place bigint", "role string", "text string"],
                    messages)
