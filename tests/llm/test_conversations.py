"""Conversation repair against a search over strings of edits, row by row."""

import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from caseweave.llm import conversations, queries

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]")
KIND = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """The cost, the edits (least in ASCII) and the repaired turns, by memoised search from every row and state."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(t, state, inserted):
        found = []
        if t == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        ways = []
        if inserted < 3:
            ways.append(("I", 3, t, follow[state], inserted + 1, (names[follow[state]], "")))
        if t < len(rows):
            role, text = rows[t][2], rows[t][3]
            ways.append(("D", 4, t + 1, state, 0, None))
            if faults[t] not in ("blank", "duplicate"):
                open_end = 3 * (faults[t] == "truncated")
                ways.append(("R", 3 + open_end, t + 1, follow[state], 0, (names[follow[state]], text)))
                if role[:1] == follow[state] or (state == "" and role[:1] == "s"):
                    ways.append(("K", open_end, t + 1, role[:1], 0, (role, text)))
        for letter, cost, t2, state2, i2, turn in ways:
            rest = best(t2, state2, i2)
            if rest:
                found.append((cost + rest[0], letter + rest[1], ((turn,) if turn else ()) + rest[2]))
        return min(found, key=lambda x: x[:2]) if found else None

    return best(0, "", 0)


def brute(given, rows, order):
    out = {}
    for conv in {r[0] for r in given}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, order[r[2], r[3]]))
        faults, seen = [], set()
        for _, _, role, text in mine:
            kept = SPACE.findall(text)
            faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in mine if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:], strict=False)]
        cost, audit, repaired = cheapest(tuple(mine), tuple(faults))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def orders(spark, rows):
    """The place of each role and text among the hashes that settle the order within a turn."""
    keyed = conversations._keyed(spark.createDataFrame(rows, KIND)).select("role", "text", "d1", "d2").distinct().collect()
    return {(r.role, r.text): (r.d1, r.d2) for r in keyed}


def answers(df):
    got = df.collect()
    found = {r.conv_id: tuple(r)[1:] for r in got}
    assert len(found) == len(got)
    return found


def test_query_equals_brute_force(spark):
    given = duckdb.execute(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    rows = damaged(given)
    got = answers(queries.op12_conversation_repair(spark, SF))
    assert got == brute(given, rows, orders(spark, rows))
    assert sum(v[5] for v in got.values()) > 0


def random_rows(rng, conversations_, longest, gap):
    roles = ["user", "assistant", "system", "tool", "", "u", "User", None]
    texts = ["a.", "b", "c?", " ", "", None, "d!\n", "e. f", "…", "g. "]
    return [(None if conv == 0 else conv, None if rng.random() < 0.1 else t * gap + rng.randrange(2), rng.choice(roles[: rng.choice([3, 8])]), rng.choice(texts)) for conv in range(conversations_) for t in range(rng.randrange(longest))]


@pytest.mark.parametrize("seed, gap", [(1, 1), (2, 3000), (3, 5000), (4, 1)])
def test_odd_conversations(spark, seed, gap):
    """Null ids, roles, texts and turns, ties, repeated rows, and conversations of many segments (by the gap of turns)."""
    given = random_rows(random.Random(seed), 60, 14, gap)
    given += given[:5]
    df = spark.createDataFrame(given, KIND).selectExpr("*", "1 AS audit", "'x' AS conv", "2 AS kind")
    rows = damaged(given)
    want = brute(given, rows, orders(spark, rows))
    assert answers(conversations.repairs(conversations.damage(df), df)) == want
    turns = conversations.repaired_turns(conversations.damage(df)).collect()
    texts = {}
    for r in sorted(turns, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.place)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() for c in want} == {c: v[7] for c, v in want.items()}


def test_a_long_conversation(spark):
    """20,000 turns are five segments; every tenth is missing, every seventh of the wrong role."""
    rows = [(7, t, ("assistant" if t % 2 else "user") if t % 7 else "user", f"turn {t}." if t % 11 else "open") for t in range(20000) if t % 10]
    got = answers(conversations.repairs(spark.createDataFrame(rows, KIND)))[7]
    assert got[0] == 1999 and len(got[6]) >= len(rows)
    # the states of a plain forward program give the same cost
    costs = {"": 0}
    follow, seen = {"": "u", "s": "u", "u": "a", "a": "u"}, set()
    for _, _, role, text in rows:
        gone, cut = (role, text) in seen, 3 * (text[-1] != ".")
        seen.add((role, text))
        for _ in range(2):
            for s, c in list(costs.items()):
                costs[follow[s]] = min(costs.get(follow[s], 1e9), c + 3)
        new = {}
        for s, c in costs.items():
            new[s] = min(new.get(s, 1e9), c + 4)
            if not gone:
                keep = cut if role[0] == follow[s] else cut + 3
                new[follow[s]] = min(new.get(follow[s], 1e9), c + keep)
        costs = new
    assert got[5] == min(costs.get("", 1e9), costs.get("a", 1e9), costs.get("u", 1e9) + 3)


def test_empty_table_and_dropped_rows(spark):
    none = spark.createDataFrame([], KIND)
    assert conversations.repairs(none, none).count() == 0 and conversations.repaired_turns(none).count() == 0
    heads = spark.createDataFrame([(None,), (3,), (3,)], "conv_id long")
    zero = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert answers(conversations.repairs(none, heads)) == {None: zero, 3: zero}
