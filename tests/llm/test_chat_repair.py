"""Conversation repair against enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from calibrix.llm import chat_repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def damage(rows):
    """(conversation -> rows after damage), by the rule's words."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        shown = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2], shown[3]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def best_repair(rows):
    """Result row of one conversation: every choice of edits, with up to two
    insertions before each row and at the end."""
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    fault, seen = [], set()
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        last = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
        fault.append("blank" if blank else "duplicate" if (role, text) in seen else "truncated" if last not in list(".!?") else "")
        seen.add((role, text))
    inserts = [list(p) for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    # Partial derivations of a prefix that read the same roles: the least stays.
    ways = {"": (0, "", ())}

    def put(into, key, way):
        if re.fullmatch("s?(ua)*u?", key) and (key not in into or way[:2] < into[key][:2]):
            into[key] = way

    for (_, role, text), f in zip(rows, fault, strict=True):
        ahead = {}
        for key, (cost, audit, kept) in ways.items():
            for more in inserts:
                k = key + "".join(m[0] for m in more)
                c, a, m = cost + 5 * len(more), audit + "I" * len(more), kept + tuple((x, "") for x in more)
                put(ahead, k, (c + 2, a + "D", m))
                if f in ("blank", "duplicate"):
                    continue
                late = 5 * (f == "truncated")
                if role[:1] in ("s", "u", "a"):
                    put(ahead, k + role[:1], (c + late, a + "K", m + ((role, text),)))
                for to in ("user", "assistant"):
                    put(ahead, k + to[0], (c + 1 + late, a + "R", m + ((to, text),)))
        ways = ahead
    done = []
    for key, (cost, audit, kept) in ways.items():
        for more in inserts:
            if re.fullmatch("(s?(ua)+)?", key + "".join(m[0] for m in more)):
                done.append((cost + 5 * len(more), audit + "I" * len(more), kept + tuple((x, "") for x in more)))
    cost, audit, kept = min(done)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, fault.count("blank"), fault.count("duplicate"),
            fault.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def result(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def random_rows(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    texts = ["Yes.", "No", "Why?", "", " \n", None, "Go on!", "so...  "]
    return [(rng.choice([*range(12), None]), rng.choice([*range(6), None]),
             rng.choices(roles, [8, 8, 3, 1, 1, 1, 1])[0], rng.choices(texts, [5, 3, 3, 1, 1, 1, 4, 2])[0])
            for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("held", [1, 2, 1024])
def test_equals_enumeration(spark, seed, held):
    rows = random_rows(seed, 90)
    got = chat_repair.repair(chat_repair.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3)),
                             copies_col="copies", held=held)
    assert result(got) == {c: best_repair(r) for c, r in damage(rows).items()}


def test_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()]
    got = chat_repair.repair(chat_repair.damaged(t), copies_col="copies")
    assert result(got) == {c: best_repair(r) for c, r in damage(rows).items()}


def test_agenda_pops_the_least_audit():
    rows = [chat_repair.edits(r, False, False, 1) for r in "uu"]
    # Rerole the second (1) is cheaper than deleting both or inserting.
    assert chat_repair.lightest(rows, 0, chat_repair.FINAL) == {3: (1, "KR")}
    # D and D cost as much as any pair of edits that ends legal: D sorts first.
    rows = [chat_repair.edits("u", False, True, 1)]
    assert chat_repair.lightest(rows, 0, chat_repair.FINAL) == {0: (2, "D")}


def test_long_and_hot_conversations(spark):
    """One conversation with most rows, in small chunks over many ranges, and
    one row repeated often: the same result as whole."""
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No", "Why?", f"{i}."])) for i in range(300)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hello.")] + [(2, 2, "user", "again")] * 200
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = result(chat_repair.repair(df, held=16))
    plain = {c: sorted((r[1:] for r in rows if r[0] == c)) for c in (1, 2)}
    assert got == {c: best_repair(r) for c, r in plain.items()}
    # The hot row reaches the exchange of the ranges once.
    assert chat_repair.collapsed(df, "conv_id", "turn", "role", "text", None).filter("conv_id = 2").count() == 3


def test_messages_are_the_repaired_rows(spark):
    rows = random_rows(9, 60)
    hurt = chat_repair.damaged(spark.createDataFrame(rows, SCHEMA))
    fixed = chat_repair.repair(hurt, copies_col="copies")
    found = {}
    for r in chat_repair.repaired_messages(hurt, fixed, copies_col="copies").orderBy("conv_id", "place").collect():
        found.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in fixed.collect():
        mine = found.get(r["conv_id"], [])
        assert hashlib.sha256("\n".join(mine).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(m[0] for m in mine))


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_repair.repair(chat_repair.damaged(empty), copies_col="copies").collect() == []
    rows = [(None, None, None, None), (None, None, "user", "x" * 300_000 + "."), (7, None, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("clash") for c in ("copies", "part", "idx", "kind", "blank", "cost", "done", "chunk", "initial")})
    got = result(chat_repair.repair(df))
    shown = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows[:2]]
    assert got[None] == best_repair(sorted(shown, key=lambda r: r[1:]))
    assert got[7] == best_repair([(None, "assistant", "Yes.")])
    # No row after damage: zeros, no audit, the digest of nothing.
    gone = spark.createDataFrame([(3, 1, "user", "Hi.", 0)], SCHEMA + ", copies bigint")
    assert result(chat_repair.repair(gone, copies_col="copies")) == {3: best_repair([])}
