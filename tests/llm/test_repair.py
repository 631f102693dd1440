import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest
from conftest import SF

from allotau.llm import repair as R


def by_plain_recursion(symbols, entry=0, exits=(0, 3)):
    """Least (cost, audit) from the end on, over all edits."""
    n = len(symbols)

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "")] if i == n and q in exits else []
        made = 3 if q == 2 else 2
        if inserted < 4:
            found += [(3 + c, "I" + a) for c, a in [best(i, made, inserted + 1)]]
        if i < n:
            kind, fault = divmod("ABCDEFGHIJKL".index(symbols[i]), 3)
            found += [(4 + c, "D" + a) for c, a in [best(i + 1, q, 0)]]
            if fault < 2:
                found += [(3 + 3 * fault + c, "R" + a) for c, a in [best(i + 1, made, 0)]]
                to = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}.get((kind, q))
                if to is not None:
                    found += [(3 * fault + c, "K" + a) for c, a in [best(i + 1, to, 0)]]
        return min(found, default=(float("inf"), ""))

    for i in range(n, 0, -20):  # shallow calls first
        for q in range(4):
            best(i, q, 0)
    return best(0, entry, 0)


def test_search_equals_recursion():
    for symbols in itertools.chain.from_iterable(map("".join, itertools.product("ADGJEFH", repeat=k)) for k in range(5)):
        assert R.cheapest(symbols) == by_plain_recursion(symbols), symbols
    rng = random.Random(3)
    for _ in range(300):
        symbols = "".join(rng.choices(R.SYMBOLS, k=rng.randrange(5, 40)))
        assert R.cheapest(symbols) == by_plain_recursion(symbols), symbols
        q, r = rng.randrange(4), rng.randrange(4)
        got, want = R.cheapest(symbols, q, (r,)), by_plain_recursion(symbols, q, (r,))
        assert got == want or got[0] == want[0] == float("inf")


def test_blocks_joined_equal_the_whole():
    rng = random.Random(4)
    for _ in range(60):
        symbols = "".join(rng.choices(R.SYMBOLS, k=rng.randrange(2, 50)))
        cuts = sorted({0, *rng.choices(range(1, len(symbols)), k=rng.randrange(1, 7))})
        blocks = [R.between_states(symbols[a:b]) for a, b in zip(cuts, [*cuts[1:], len(symbols)], strict=True)]
        cells = [x[4 * q + r] for x, (q, r) in zip(blocks, R.way_through(blocks), strict=True)]
        assert (sum(c for c, _ in cells), "".join(a for _, a in cells)) == R.cheapest(symbols)


def brute_force(data):
    """The contract, row by row, on (conv_id, turn, role, text) that have been damaged."""
    out = {}
    for c, rows in itertools.groupby(sorted(data, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2], r[3])), key=lambda r: r[0]):
        rows, seen, symbols, n = list(rows), set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            kind = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
            symbols += "ABCDEFGHIJKL"[3 * kind + (2 if fault in ("blank", "duplicate") else 1 if fault else 0)]
        cost, audit = by_plain_recursion(symbols)
        turns = [t for _, t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        pieces, q, left = [], 0, iter(rows)
        for edit in audit:
            row = next(left) if edit != "I" else (None, None, None, "")
            if edit != "D":
                role = row[2] if edit == "K" else "assistant" if q == 2 else "user"
                q = {"s": 1, "u": 2, "a": 3}[role[0]]
                pieces.append(f"{role}:{row[3]}")
        assert re.fullmatch("(s?(ua)+)?", "".join(p[0] for p in pieces))
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(pieces).encode()).hexdigest())
    return out


def damage(data):
    out = []
    for c, t, role, text in data:
        c_, t_, role, text = [" " if x is None else x for x in (c, t, role, text)]
        k = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def answers(df):
    rows = df.collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_op11(spark):
    data = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    nothing = (0,) * 6 + ("", hashlib.sha256().hexdigest())
    want = {c: nothing for c, *_ in data} | brute_force(damage(data))
    assert answers(R.op11_conversation_repair(spark, SF)) == want


@pytest.mark.parametrize("block_bits", [1, 3, 8])
def test_odd_rows_and_long_conversations(spark, block_bits):
    rng = random.Random(block_bits)
    texts = ["Yes.", "No!", "", " \t\n", "cut off", "x" * 300_000 + ".", "ß?", "A.B", "\x0b"]
    data = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", " ", "u", "User"]), rng.choice(texts)) for c in [None, -7, 2**60 + 1, *range(6)] for _ in range(rng.randrange(1, 12))]
    data += [(77, t, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(300)}.") for t in range(400)]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "conv_id long, turn long, role string, text string, key int, at string").repartition(5)
    assert answers(R.repair(df, block_bits=block_bits)) == brute_force(data)


def test_nulls_are_one_space_and_lost_conversations_stay(spark):
    data = [(c, t, None if t % 2 else "user", None if t % 3 == 0 else f"Text {t}.") for c in (None, 1, 2, 3) for t in range(9)] + [(c, 0, "user", "Gone.") for c in range(100, 160)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = answers(R.repair(R.damaged(df), df))
    want = brute_force(damage(data))
    assert {c: got[c] for c in want} == want and len(got) == 64
    assert all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in set(got) - set(want))


def test_repaired_rows(spark):
    data = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "tool", "Hm."), (2, 0, "assistant", "Alone.")]
    turns = R.placed(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    got = sorted(map(tuple, R.repaired_turns(turns, R.plans(turns)[0]).collect()))
    want = {k: (cost, audit) for k, (*_, cost, audit, _) in brute_force(data).items()}
    assert "".join(r[2] for r in got if r[0] == "1") == want[1][1] and "".join(r[2] for r in got if r[0] == "2") == want[2][1]
    assert [r[1] for r in got if r[0] == "1"] == list(range(len(want[1][1])))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(R.damaged(df), df).collect() == []


def test_sql_equals_brute_force():
    rng = random.Random(21)
    texts = ["Yes.", "No!", "", " \t\n", "cut off", "ß?", "A.B", None]
    data = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", None, "User"]), rng.choice(texts)) for c in [None, -7, *range(60)] for _ in range(rng.randrange(1, 12))]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    nothing = (0,) * 6 + ("", hashlib.sha256().hexdigest())
    assert {r[0]: tuple(r[1:]) for r in con.sql(R.OP11_SQL).fetchall()} == {c: nothing for c, *_ in data} | brute_force(damage(data))
