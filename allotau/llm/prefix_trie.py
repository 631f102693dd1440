"""Prefix trie of conversations that are rebuilt from a base conversation's head and their own tail.

A sequence of turns has the fingerprint sum e_i * B^i mod 2^31 - 1, in LANES lanes with a
base B each, where e_i is a hash of turn i. Fingerprints with lengths form a monoid: behind
a head of m turns, a sequence's fingerprint is multiplied by B^m and added. So a prefix of
a rebuilt conversation has the base's fingerprint at the end of the head plus that of a
range of own turns, moved; no rebuilt text is made. Running fingerprints are taken within
ranges of rows, and those of the few conversations that go over a range's end are put
together by the same rule.

Prefixes of one depth and fingerprint are a node. Equality is verified: an aggregate over
all turns shows that each turn's reference (two hashes) stands for one role and text, and
each node's members must agree in the reference of their last turn and in the prefix
before; by induction their turns are equal. If that fails, all is done again with other
hashes.

Sums over subtrees need no walk: a node belongs to its smallest member, whose nodes are
the lower end of its path. A conversation's nodes below a depth are a running sum along
it; of other members a subtree holds all or nothing of what they own, so these add up per
node. Every group is aggregated before it is shuffled. The digest of a node's ends is a
chain: its ids are joined in runs first, and one task reads the runs in order, holding a
batch of them.

Defined results: rows without a conversation id are no conversation; null roles and texts
are empty; rows of one turn come by role, then by a hash of the text; repeated rows are
turns of their own; extra columns are ignored; very long texts are hashed; an empty table
has no nodes.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allotau.llm import _base as B
from allotau.llm.mixing import running

P = (1 << 31) - 1
LANES = 4
#: Turns that a head has at the most.
HEAD = 5
#: Exponents are read in digits of DIGIT bits, DIGITS of them.
DIGIT, DIGITS = 6, 6
#: Depths of one conversation that one window sums; ids of a node's ends that are joined before they come to one task.
CHUNK_BITS, ID_BITS = 12, 10
#: Hashes to try until no two texts share one.
SEEDS = 8
NODE = ["depth", "f1", "f2"]
Lanes = list[Column]


def bases(seed: int) -> list[int]:
    rng = random.Random(seed)
    return [rng.randrange(1 << 20, P - 1) for _ in range(LANES)]


def power(base: int, n: Column) -> Column:
    """base ** n mod P for a column n, by tables of its digits."""
    out = None
    for i in range(DIGITS):
        table = F.lit([pow(base, d << (DIGIT * i), P) for d in range(1 << DIGIT)]).cast("array<long>")
        digit = F.shiftright(n, DIGIT * i).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")
        factor = F.get(table, digit)
        out = factor if out is None else out * factor % P
    return out


def unpacked(one: Column, two: Column) -> Lanes:
    return [x for f in (one, two) for x in (F.shiftright(f, 31), f.bitwiseAND(F.lit(P)))]


def packed(lanes: Lanes) -> tuple[Column, Column]:
    one, two = (F.shiftleft(a.cast("long"), 31).bitwiseOR(b.cast("long")) for a, b in zip(lanes[::2], lanes[1::2], strict=True))
    return one, two


def plus(a: Lanes, b: Lanes) -> Lanes:
    return [(x + y) % P for x, y in zip(a, b, strict=True)]


def minus(a: Lanes, b: Lanes) -> Lanes:
    return [(x - y + P) % P for x, y in zip(a, b, strict=True)]


def moved(a: Lanes, by: Lanes) -> Lanes:
    return [x * y % P for x, y in zip(a, by, strict=True)]


def named(prefix: str, lanes: Lanes) -> list[Column]:
    return [c.alias(f"{prefix}{i}") for i, c in enumerate(packed(lanes), 1)]


def references(rows: DataFrame, seed: int) -> DataFrame:
    """conv_id, turn, role, text, h1, h2: with the reference of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    every = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    return every.select("*", *[F.xxhash64("role", "text", F.lit(2 * seed + i)).alias(f"h{i}") for i in (1, 2)])


def one_text_each(turns: DataFrame) -> bool:
    """Whether each reference stands for one role and text."""
    classes = turns.groupBy("h1", "h2").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("role", "text") for f in (F.min, F.max)])
    return not classes.where("role_min <> role_max or text_min <> text_max").limit(1).count()


def fingerprinted(turns: DataFrame, seed: int) -> DataFrame:
    """conv_id, pos, h1, h2, chars, and the packed fingerprints b1, b2 before and a1, a2 behind each turn, as a table."""
    base = bases(seed)
    narrow = turns.select("conv_id", "turn", "role", "h1", "h2", F.length("text").cast("long").alias("chars"))
    dealt = narrow.repartitionByRange("conv_id", "turn", "role", "h1").sortWithinPartitions("conv_id", "turn", "role", "h1", "h2")
    dealt = B.written(dealt.select("conv_id", "h1", "h2", "chars", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "turns")
    own = Window.partitionBy("conv_id", "part").orderBy("at")
    element = [F.pmod(h if i % 2 else F.shiftright(h, 32), F.lit(P)) for h in (F.col("h1"), F.col("h2")) for i in (0, 1)]
    rows = dealt.withColumn("place", F.row_number().over(own).cast("long") - 1)
    rows = rows.select("*", *[(e * power(b, F.col("place")) % P).alias(f"t{i}") for i, (e, b) in enumerate(zip(element, base, strict=True))])
    sums = [F.sum(f"t{i}").over(own.rowsBetween(Window.unboundedPreceding, 0)) for i in range(LANES)]
    rows = rows.select("*", *[s.alias(f"s{i}") for i, s in enumerate(sums)])
    behind = [F.col(f"s{i}") % P for i in range(LANES)]
    before = [(F.col(f"s{i}") - F.col(f"t{i}")) % P for i in range(LANES)]
    laid = B.written(rows.select("conv_id", "part", "place", "h1", "h2", "chars", *named("b", before), *named("a", behind)), "laid")

    # a conversation goes on in another range at most once a range, so what comes before such parts is a table of at most one row a range
    parts = laid.groupBy("conv_id", "part").agg((F.max("place") + 1).alias("n"), *[F.max_by(a, "place").alias(a) for a in ("a1", "a2")])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.sum("n").over(earlier)).withColumn("first", F.coalesce("start", F.lit(0)).cast("long"))
    terms = moved(unpacked(F.col("a1"), F.col("a2")), [power(b, F.col("first")) for b in base])
    parts = parts.select("conv_id", "part", "start", *[t.alias(f"t{i}") for i, t in enumerate(terms)])
    parts = parts.select("conv_id", "part", "start", *[F.sum(f"t{i}").over(earlier).alias(f"f{i}") for i in range(LANES)]).where("start is not null")
    later = B.written(parts.select("conv_id", "part", "start", *named("g", [F.col(f"f{i}") % P for i in range(LANES)])), "parts")
    got = laid.join(F.broadcast(later), ["conv_id", "part"], "left")
    start = F.coalesce("start", F.lit(0)).cast("long")
    ahead = [F.coalesce(f"g{i}", F.lit(0)).cast("long") for i in (1, 2)]
    by = [power(b, start) for b in base]
    whole = {x: plus(unpacked(*ahead), moved(unpacked(F.col(f"{x}1"), F.col(f"{x}2")), by)) for x in "ba"}
    return B.written(got.select("conv_id", (start + F.col("place")).alias("pos"), "h1", "h2", "chars", *named("b", whole["b"]), *named("a", whole["a"])), "prints")


def paths(prints: DataFrame, base_of: Callable[[Column], Column], head_of: Callable[[Column], Column], seed: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, NODE, p1, p2 (the prefix before), h1, h2, chars of every turn of every rebuilt conversation; conv_id, length of every one), as tables."""
    inverse = [[pow(b, -d, P) for d in range(HEAD + 1)] for b in bases(seed)]
    convs = prints.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", base_of(F.col("conv_id")).alias("base"), head_of(F.col("conv_id")).alias("skip"))
    first_turns = prints.where(F.col("pos") < HEAD).join(convs.select(F.col("base").alias("conv_id")).distinct(), "conv_id", "left_semi")
    heads = first_turns.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "chars", "b1", "b2", "a1", "a2"))).alias("head"))  # at most HEAD turns
    tails = prints.where(F.col("pos") == head_of(F.col("conv_id"))).select("conv_id", F.col("b1").alias("o1"), F.col("b2").alias("o2"))
    facts = convs.join(heads, "base", "left").join(tails, "conv_id", "left")
    taken = F.least(F.col("skip"), F.coalesce(F.size("head"), F.lit(0)))
    facts = facts.withColumn("taken", F.when(F.col("head").isNull(), 0).otherwise(taken))
    end = F.get("head", F.col("taken") - 1)
    ends = [F.when(F.col("taken") > 0, end[f"a{i}"]).otherwise(F.lit(0)).cast("long").alias(f"e{i}") for i in (1, 2)]
    length = F.col("taken") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))
    facts = B.written(facts.select("conv_id", "skip", "taken", "head", "o1", "o2", *ends, length.cast("long").alias("length")), "facts")

    kept = ["h1", "h2", "chars", "length"]
    head = facts.select("conv_id", "length", F.explode(F.slice("head", 1, F.col("taken"))).alias("t"))
    head = head.select("conv_id", (F.col("t.pos") + 1).alias("depth"), *[F.col(f"t.a{i}").alias(f"f{i}") for i in (1, 2)], *[F.col(f"t.b{i}").alias(f"p{i}") for i in (1, 2)], *[F.col(f"t.{c}").alias(c) for c in kept[:3]], "length")
    own = prints.where(F.col("pos") >= head_of(F.col("conv_id"))).join(facts.drop("head"), "conv_id")
    back = [F.get(F.lit(table).cast("array<long>"), F.col("skip") - F.col("taken")) for table in inverse]
    whole = {x: plus(unpacked(F.col("e1"), F.col("e2")), moved(minus(unpacked(F.col(f"{x}1"), F.col(f"{x}2")), unpacked(F.col("o1"), F.col("o2"))), back)) for x in "ba"}
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("skip") + 1).alias("depth"), *named("f", whole["a"]), *named("p", whole["b"]), *kept)
    return B.written(head.unionByName(own), "paths"), facts.select("conv_id", "length")


def nodes_of(path: DataFrame) -> DataFrame:
    """NODE, p1, p2, conv_id (smallest member), n_convs, chars, agree: as a table, without the root."""
    same = ["p1", "p2", "h1", "h2"]
    agree = [F.min(c) == F.max(c) for c in same]
    found = path.groupBy(*NODE).agg(*[F.min(c).alias(c) for c in (*same[:2], "conv_id", "chars")], F.count(F.lit(1)).alias("n_convs"), (agree[0] & agree[1] & agree[2] & agree[3]).alias("agree"))
    return B.written(found, "nodes")


def ends_digests(path: DataFrame, lengths: DataFrame) -> DataFrame:
    """NODE, ends_sha256: of the ids of the conversations that end at each node where some do, ascending."""
    ends = path.where("depth = length").select(*NODE, "conv_id")
    bare = lengths.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    some = ends.unionByName(bare).groupBy(*NODE, F.shiftright("conv_id", ID_BITS).alias("run")).agg(ids.alias("ids"))  # at most 2^ID_BITS ids
    dealt = some.select(*[F.col(c).cast("long") for c in NODE], "run", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, node, digest = [], None, hashlib.sha256()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*NODE, "ends_sha256"])

        for got in batches:
            for *key, _, ids in zip(*[c.to_pylist() for c in got.columns], strict=True):
                if key == node:
                    digest.update(f",{ids}".encode())
                    continue
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            if out:
                yield batch()
                out = []
        if node is not None:
            out.append((*node, digest.hexdigest()))
            yield batch()

    return dealt.mapInArrow(run, "depth long, f1 long, f2 long, ends_sha256 string")


def verified(rows: DataFrame, base_of: Callable[[Column], Column], head_of: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, lengths, nodes) with the first hashes that tell all turns and prefixes apart."""
    for seed in range(SEEDS):
        turns = references(rows, seed)
        if not one_text_each(turns):
            continue
        path, lengths = paths(fingerprinted(turns, seed), base_of, head_of, seed)
        nodes = nodes_of(path)
        if not nodes.where("not agree").limit(1).count():
            return path, lengths, nodes
    raise RuntimeError("no hashes tell all turns apart")


def prefix_trie(rows: DataFrame, base_of: Callable[[Column], Column], head_of: Callable[[Column], Column]) -> DataFrame:
    """rows (conv_id, turn, role, text) -> NODE, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node.

    A conversation is rebuilt from the first head_of(conv_id) turns (0 to HEAD) of the
    conversation base_of(conv_id), and its own turns after as many.
    """
    path, lengths, nodes = verified(rows, base_of, head_of)
    kids = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    gain, chunk = (F.col("n_convs") - 1) * F.col("chars"), F.shiftright("depth", CHUNK_BITS)
    owned = nodes.drop("agree").join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    owned = B.written(owned.withColumn("gain", gain).withColumn("chunk", chunk), "owned")
    totals = B.written(owned.groupBy("conv_id").agg(F.sum("gain").alias("total"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")), "totals")
    mine = running(owned, ["conv_id"], "chunk", F.col("gain"), ["depth"], "above").join(totals.select("conv_id", "total"), "conv_id")
    sums = path.select("conv_id", *NODE).join(totals.where("total > 0 or leaf > 0"), "conv_id").groupBy(*NODE).agg(F.sum("total").alias("totals"), F.sum("leaf").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = B.written(ends_digests(path, lengths), "ends")

    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).first()
    below = owned.agg(F.sum("gain").alias("gain"), F.count_if(F.col("depth") == 1).alias("kids"), F.count_if(F.col("n_children") == 0).alias("leaves")).first()
    nothing = F.lit(hashlib.sha256().hexdigest())
    got = mine.join(sums, NODE, "left").join(parents, ["depth", "p1", "p2"], "left").join(ends, NODE, "left")
    above = F.when(F.col("depth") == 1, F.lit(top["conv_id"]).cast("long")).otherwise(F.col("parent_conv_id"))
    saved = F.col("total") - F.col("above") + F.coalesce("totals", F.lit(0)) - F.col("total")
    numbers = {"n_convs": F.col("n_convs"), "n_children": F.col("n_children"), "n_leaves": F.coalesce("n_leaves", F.lit(0)), "saved_tokens": saved}
    inner = got.select(*NODE, "conv_id", above.alias("parent_conv_id"), *[c.cast("long").alias(k) for k, c in numbers.items()], F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    if not top["n"]:
        return inner
    spark = rows.sparkSession
    root = spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in NODE], F.lit(top["conv_id"]).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
                                 *[F.lit(v).cast("long").alias(k) for k, v in zip(numbers, (top["n"], below["kids"], below["leaves"] or 1, below["gain"] or 0), strict=True)])
    at_root = ends.where("depth = 0").first()
    root = root.withColumn("ends_sha256", F.lit(at_root["ends_sha256"]) if at_root else nothing)
    return inner.unionByName(root)


def hundreds(conv_id: Column) -> Column:
    return conv_id - conv_id % 100


def head_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt conversations."""
    got = prefix_trie(B.table(spark, sf_dir, "conversations"), hundreds, head_turns)
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def crc32_sql(table: str, text: str) -> str:
    """SQL of the unsigned CRC-32 of a short ASCII text; `table` is a list of its 256 remainders."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: xor(c >> 8, {table}[1 + (xor(c, b) & 255)])))"


#: CTE of the remainders, by the polynomial 0xEDB88320.
CRC_SQL = "crc AS MATERIALIZED (SELECT list(x8 ORDER BY x0) AS t FROM (SELECT i AS x0, " + ", ".join(f"xor(x{k} >> 1, 3988292384 * (x{k} & 1)) AS x{k + 1}" for k in range(8)) + " FROM range(256) r(i)))"

OP13_SQL = f"""
WITH {CRC_SQL},
own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
heads AS (SELECT conv_id, turns, CAST({crc32_sql("t", "CAST(conv_id AS VARCHAR)")} % 6 AS BIGINT) AS h FROM own, crc),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), coalesce(c.turns[c.h + 1:], [])) AS seq
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
),
paths AS (SELECT conv_id, d, seq[1:d] AS node, len(seq) = d AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ids
  FROM paths GROUP BY node, d
),
kids AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
trie AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (node, d)),
below AS (
  SELECT node[1:k] AS node, k AS d, count(*) FILTER (n_children = 0) AS n_leaves,
         sum(CASE WHEN d > 0 THEN (n_convs - 1) * length(node[d].x) ELSE 0 END) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM trie) GROUP BY ALL
)
SELECT t.conv_id, CAST(t.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(t.n_convs AS BIGINT) AS n_convs,
       CAST(t.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(t.ids) AS ends_sha256
FROM trie t JOIN below b ON b.node = t.node AND b.d = t.d LEFT JOIN nodes p ON p.d = t.d - 1 AND p.node = t.node[1:t.d - 1]
"""
