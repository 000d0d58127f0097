"""Conversation repair against an exhaustive plain version."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storepulse.llm import conversations, queries
from storepulse.llm.common import table
from storepulse.llm.conversations import PieceLimits

FOLDER = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
RIGHT = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    show = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def marks(rows):
    """Fault of each row: b, d, t or nothing."""
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(BLANKS)
        out.append("b" if not end else "d" if (role, text) in seen else "" if end[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, turns) by a search over (cost, audit) in order: the first right end is the least."""
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, roles, turns = heapq.heappop(todo)
        last = roles[-1:] if roles else ""
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and RIGHT.fullmatch(roles[-1:] and "" + ("ua" if last == "a" else last)):
            return cost, audit, turns
        legal = lambda x: (x in "su" if not roles else (last + x) in ("su", "ua", "au"))
        for name in ("user", "assistant"):
            if legal(name[0]):
                heapq.heappush(todo, (cost + 5, audit + "I", i, roles + name[0], turns + ((name, ""),)))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(todo, (cost + 2, audit + "D", i + 1, roles, turns))
            if faults[i] not in ("b", "d"):
                spent = cost + 5 * (faults[i] == "t")
                if role[:1] and role[:1] in "sua" and legal(role[:1]):
                    heapq.heappush(todo, (spent, audit + "K", i + 1, roles + role[0], turns + ((role, text),)))
                for name in ("user", "assistant"):
                    if legal(name[0]):
                        heapq.heappush(todo, (spent + 1, audit + "R", i + 1, roles + name[0], turns + ((name, text),)))


def plain(convs):
    out = []
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        faults = marks(rows)
        cost, audit, turns = cheapest(rows, faults)
        known = [t for t, *_ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in turns)
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def conversation(rnd, conv, length):
    rows, turn = [], rnd.randint(0, 3)
    for _ in range(length):
        turn += rnd.choice([0, 1, 1, 1, 2])
        role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ai"])
        text = rnd.choice(["Yes.", "No!", "Why", "", None, " \t\n", "end. \n", "é?", f"text {rnd.randint(0, 9)}."])
        rows.append((conv, turn if rnd.random() > 0.1 else None, role, text))
    return rows


def random_rows(seed, conversations_=120, longest=9):
    rnd = random.Random(seed)
    return [r for c in range(conversations_) for r in conversation(rnd, c, rnd.randint(1, longest))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, ROLE string, seq int")


def test_query(spark):
    rows = [tuple(r) for r in table(spark, FOLDER, "conversations").select("conv_id", "turn", "role", "text").collect()]
    df = queries.queries()["op12_conversation_repair"](spark, FOLDER)
    assert [f.dataType.simpleString() for f in df.schema.fields[1:7]] == ["bigint"] * 6
    assert got(df) == plain(damaged(rows))


@pytest.mark.parametrize("seed, limits", [(1, PieceLimits()), (2, PieceLimits(rows=3)), (3, PieceLimits(50, 20))])
def test_odd_conversations(spark, seed, limits):
    """Pieces of few rows or bytes must give what whole conversations give."""
    data = random_rows(seed)
    data += [(None, 1, "user", "Hi."), (None, 2, None, None), (500, None, None, None), (501, 7, "assistant", "a" * 300_000 + ".")]
    data += [(502, t, "user", "Same.") for t in range(12)] + [(503, 1, "system", "S.")] * 5
    for parts in (1, 7):
        df = conversations.repair(conversations.damage(frame(spark, data).repartition(parts)), limits)
        assert got(df) == plain(damaged(data))


def test_one_long_conversation(spark):
    rnd = random.Random(9)
    data = conversation(rnd, 77, 3000) + random_rows(4, 300)
    assert got(conversations.repair(conversations.damage(frame(spark, data)))) == plain(damaged(data))


def test_turns_are_what_the_digest_covers(spark):
    rows = conversations.damage(frame(spark, random_rows(11, 200)))
    facts = {r.conv_id: r.repaired_sha256 for r in conversations.repair(rows).collect()}
    turns = {}
    for r in conversations.repaired_turns(rows, PieceLimits(rows=2)).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append(r)
    for conv, digest in facts.items():
        mine = turns.get(conv, [])
        assert [r.place for r in mine] == list(range(len(mine))) and RIGHT.fullmatch("".join(r.role[0] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == digest


def test_empty(spark):
    none = frame(spark, random_rows(1, 2)).limit(0)
    assert conversations.repair(none).count() == 0
    all_dropped = frame(spark, [(1, 2, "user", "x")]).withColumn("dropped", F.lit(True))
    assert got(conversations.repair(all_dropped)) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_piece_tables_compose():
    """The costs of a row of turns equal those of its two halves put together."""
    rnd = np.random.default_rng(3)
    for _ in range(50):
        n, cut_at = int(rnd.integers(2, 12)), int(rnd.integers(1, 2))
        code, must, cut = rnd.integers(0, 4, n), rnd.random(n) < 0.2, rnd.random(n) < 0.3
        whole = conversations.least_costs(code, must, cut, np.array([n]), conversations._CLOSED[None])
        tail = conversations.least_costs(code[cut_at:], must[cut_at:], cut[cut_at:], np.array([n - cut_at]), conversations._CLOSED[None])
        head = conversations.least_costs(code[:cut_at], must[:cut_at], cut[:cut_at], np.array([cut_at]), tail[:1])
        assert (head[0] == whole[0]).all()
