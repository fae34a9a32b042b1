import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from pagequarry.llm import conversation_repair as repair
from pagequarry.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, key string, at int"


def brute_plan(chars):
    """Least (cost, audit) over all edits, forward over (audit so far, state) by plain search."""
    # outputs are written in full, so the grammar is checked by a regular expression only at the end
    frontier = {("",): (0, "")}
    for ch in chars:
        fresh = {}
        for out, (cost, audit) in frontier.items():
            for k in range(3):
                for more in product("ua", repeat=k):
                    base = (cost + 3 * k, audit + "I" * k, (out[0] + "".join(more),))
                    ways = [(base[0] + 4, base[1] + "D", base[2])]
                    if ch not in "1234":
                        extra = 3 if ch.isupper() else 0
                        ways.append((base[0] + extra, base[1] + "K", (base[2][0] + ch.lower(),)))
                        ways += [(base[0] + 3 + extra, base[1] + "R", (base[2][0] + x,)) for x in "ua"]
                    for c, a, o in ways:
                        if re.fullmatch(r"(s?(ua)*u?)?", o[0]) and (o not in fresh or (c, a) < fresh[o]):
                            fresh[o] = (c, a)
        frontier = fresh
    ends = []
    for out, (cost, audit) in frontier.items():
        for k in range(3):
            for more in product("ua", repeat=k):
                if re.fullmatch(r"(s?(ua)+)?", out[0] + "".join(more)):
                    ends.append((cost + 3 * k, audit + "I" * k))
    return min(ends)


@pytest.mark.parametrize("n", range(5))
def test_cheapest_against_all_edits(n):
    rng = random.Random(n)
    cases = ["".join(x) for x in product("suaxSUA12", repeat=n)] if n < 3 else ["".join(rng.choice("suaxSUA12") for _ in range(n)) for _ in range(60)]
    for chars in cases:
        assert repair.cheapest(chars) == brute_plan(chars), chars


def test_checkpoints_give_what_a_full_table_gives():
    rng = random.Random(9)
    for n in (1, 15, 16, 17, 400, 5000):
        chars = "".join(rng.choice("suaaauuxUA12") for _ in range(n))
        tables = [repair._END]
        for c in reversed(chars):
            tables.append(repair._before(c, tables[-1]))
        cost, audit = repair.cheapest(chars)
        assert cost == tables[-1][repair.START]
        state, total, at = repair.START, 0, 0
        for e in audit:
            if e == "I":
                state, total = repair.OTHER[state], total + 3
                continue
            c = chars[at]
            at += 1
            assert e == "D" or c not in "1234"
            extra = 3 if c.isupper() and e != "D" else 0
            total += {"D": 4, "K": 0, "R": 3}[e] + extra
            state = state if e == "D" else repair.AFTER[c.lower()][state] if e == "K" else repair.OTHER[state]
            assert state is not None
        assert at == n and total == cost and repair.ENDS[state] == 0


def brute(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        own += [(turn is not None, turn or 0, role.encode(), text.encode(), role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort()
        turns = {x[1] for x in own if x[0]}
        seen, chars, faults = set(), "", []
        for *_, role, text in own:
            word = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not word else "duplicate" if (role, text) in seen else "truncated" if word[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            chars += c.upper() if fault == "truncated" else {"s": "1", "u": "2", "a": "3", "x": "4"}[c] if fault else c
        firsts = [x[4][:1] for x in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        cost, audit = repair.cheapest(chars) if len(own) > 5 else brute_plan(chars)
        repaired, at, last = [], 0, None
        for e in audit:
            new = "assistant" if last == "u" else "user"
            if e != "I":
                role, text = own[at][4:]
                at += 1
            if e == "D":
                continue
            repaired.append(f"{role}:{text}" if e == "K" else f"{new}:{'' if e == 'I' else text}")
            last = repaired[-1][0]
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest, repaired)
    return out


def conversations(seed=4, n=300):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n\t", None, "One. \n", "é…", "Long. " * 50, "a\nb."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            rows.append((None if conv == 7 else conv, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 2]), rng.choice(roles), rng.choice(texts), "k", 1))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_report_and_repaired_turns_against_brute_force(spark):
    rows = conversations()
    rows += [(5000, i % 40, ("user", "assistant")[i % 2], f"Text {i % 300}.", "k", 1) for i in range(3000)]  # one long conversation
    want = brute(rows)
    damaged = repair.damage(frame(spark, rows))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.report(damaged).collect()}
    assert got == {k: v[:8] for k, v in want.items()}
    turns = {}
    for r in repair.repair(damaged).orderBy("place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert turns == {k: v[8] for k, v in want.items() if v[8]}
    assert any(not v[6] for v in want.values())


def test_sql(spark, tmp_path):
    rows = [r[:4] for r in conversations(6, 150)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = {r[0]: r[1:] for r in con.sql(queries.ORACLE_SQL["op12_conversation_repair"]).fetchall()}
    assert got == {k: v[:8] for k, v in brute(rows).items()}


def test_empty_table_and_dropped_conversations(spark):
    assert repair.report(repair.damage(frame(spark, []))).count() == 0
    assert repair.repair(frame(spark, [])).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = repair.report(repair.damage(frame(spark, [(gone, 0, "user", "Hi.", "k", 1)]))).collect()
    assert tuple(row[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
