import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from allotau.llm import prefix_trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(data):
    """The contract on (conv_id, turn, role, text), with the rebuilt conversations written out."""
    turns = defaultdict(list)
    for c, t, role, text in data:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(rows)] for c, rows in turns.items()}
    rebuilt = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c > 0 else -(abs(c) % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + rows[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children[node]
        leaves[node] = sum(leaves[k] for k in kids) or 1
        saved[node] = (len(members[node]) - 1) * len(node[-1][1] if node else "") + sum(saved[k] for k in kids)
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(rebuilt[c]) == len(node)))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def answers(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def trie(df):
    return T.prefix_trie(df, T.hundreds, T.head_turns)


def made_up(seed, convs, longest):
    """Conversations that share beginnings and whole texts, of unlike lengths; turns are distinct, as ties are ordered by hashes."""
    rng = random.Random(seed)
    texts = ["Hello.", "", "ß", "Yes", "x" * 1000]
    out = []
    for c in convs:
        n = rng.choice([1, 2, 3, 5, 8, longest])
        stop = rng.randrange(n + 1)
        out += [(c, t if t else None, rng.choice(["user", None, "assistant"]) if t > stop else "user", rng.choice([*texts, None]) if t > stop else texts[t % 5]) for t in range(n)]
    rng.shuffle(out)
    return out


def test_op13(spark):
    data = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert answers(T.op13_prefix_trie(spark, SF)) == brute_force(data)


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_prefixes_nulls_and_odd_ids(spark, seed):
    data = made_up(seed, [*range(0, 320, 3), 100, 200, 1000, -5, -130, 2**60], 30)
    df = spark.createDataFrame([(*r, 1, 2) for r in data] + [(None, 0, "user", "no one", 1, 2)], "conv_id long, turn long, role string, text string, f1 int, depth int").repartition(5)
    assert answers(trie(df)) == brute_force(data)


def test_one_conversation_over_many_ranges(spark):
    data = [(100, t, "user" if t % 2 else "assistant", f"text {t % 50}") for t in range(9000)] + [(101, t, "user", "a") for t in range(6)] + [(105, t, "user", f"text {t}") for t in range(3000)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(8)
    assert answers(trie(df)) == brute_force(data)


def test_a_third_of_all_conversations_are_alike(spark):
    data = [(c, t, "user", f"{t}" if c % 3 == 0 else f"{c} {t}") for c in range(600) for t in range(4)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    assert answers(trie(df)) == brute_force(data)


def test_conversations_without_turns_of_their_own(spark):
    data = [(c, 0, "user", "only") for c in range(1, 99)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = answers(trie(df))
    assert got == brute_force(data)
    empty = df.limit(0)
    assert answers(trie(empty)) == []


def test_repeated_rows_are_turns(spark):
    df = spark.createDataFrame([(100, 1, "user", "a")] * 4 + [(100, None, "user", "b")] * 2, "conv_id long, turn long, role string, text string")
    assert [r["depth"] for r in sorted(trie(df).collect(), key=lambda r: r["depth"])] == list(range(7))


def test_shared_hashes_are_noticed(spark, monkeypatch):
    """A reference that stands for two texts asks for other hashes."""
    data = made_up(5, range(0, 60), 6)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    plain, seeds = T.references, []

    def poor(rows, seed):
        seeds.append(seed)
        got = plain(rows, seed)
        return got if seed else got.withColumn("h1", F.lit(7).cast("long")).withColumn("h2", F.length("text").cast("long"))

    monkeypatch.setattr(T, "references", poor)
    assert answers(trie(df)) == brute_force(data) and seeds == [0, 1]


def test_powers(spark):
    got = spark.range(3).select("id", T.power(123_457, F.element_at(F.lit([0, 77, 2**33 + 5]).cast("array<long>"), (F.col("id") + 1).cast("int"))).alias("p")).collect()
    assert [r["p"] for r in sorted(got)] == [1, pow(123_457, 77, T.P), pow(123_457, 2**33 + 5, T.P)]


def test_sql_equals_brute_force():
    data = made_up(3, [*range(0, 320, 3), 100, 200, 1000, -5, -130, 2**60], 30)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    assert sorted(con.sql(T.OP13_SQL).fetchall(), key=repr) == brute_force(data)
