"""Repair of the structure of conversations at least cost, by a bidirectional search of the edit lattice.

A conversation's rows come in order of turn (nulls first), rows of one turn by role and
text. A row's first fault counts: blank, duplicate of an earlier row, truncated. Roles must
come out as `(s?(ua)+)?` by their initials. Edits: K(eep), R(erole to user or assistant),
D(elete; a must for blank and duplicate rows), I(nsert an empty row of user or assistant).

The lattice's nodes are (rows read, state), with the states start, behind s, u or a. Two
heaps search it from its beginning and from its end until the costs on top of both exceed
the best meeting; all crossings of that cost are then joined, and the audit least in
ASCII order wins. Both searches keep the least audit of each node: nodes of one cost come
in order of rows, so no audit of a settled node changes, and no audit of a node begins
another one of the same node and cost.

No task holds a conversation: rows are dealt by ranges, and a long conversation is cut into
blocks of at most 2^BLOCK_BITS rows, each searched from every state to every state; the
blocks' tables are joined pairwise, (min, +) over the state between, and the way is read
back down. What a conversation's own task reads is one symbol a row and, for the digest of
the repaired text, which is a chain, its rows in order, of which it holds a batch.

Defined results: null conversation ids, turns, roles and texts are one space; a null id is a
conversation, a null turn comes first; a role that begins with neither s, u nor a, an empty
one too, can't be kept; repeated rows are duplicates; extra columns are ignored; very long
texts are read as they are; an empty table gives an empty result. A conversation without
rows has an empty audit and the digest of an empty string.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allotau.llm import _base as B
from allotau.llm.prefix_trie import CRC_SQL, crc32_sql

WHITE = " \t\n\x0b\x0c\r"
BLOCK_BITS = 8
#: Costs of edits; TRUNCATED comes on top for a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A row's symbol is the letter at 3 * class + fault. Classes: initials s, u, a, others; faults: none, truncated, must go.
SYMBOLS = "ABCDEFGHIJKL"
FINE, CUT, GONE = range(3)
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state behind a row of user or assistant that the edit makes up.
MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {(0, 1), (1, 2), (2, 1)}
INFINITE = float("inf")
Cell = tuple[float, str]
NO_WAY: Cell = (INFINITE, "")


def edits_of(symbol: str) -> list[tuple[int, str, int, int]]:
    """(state, edit, state behind, cost) of all edits of a row."""
    kind, fault = divmod(SYMBOLS.index(symbol), 3)
    out = [(q, "D", q, DELETE) for q in range(4)]
    if fault != GONE:
        more = TRUNCATED if fault == CUT else 0
        keeps = {0: [(START, SYSTEM)], 1: [(q, USER) for q in (START, SYSTEM, ASSISTANT)], 2: [(USER, ASSISTANT)], 3: []}
        out += [(q, "K", to, more) for q, to in keeps[kind]]
        out += [(q, "R", to, REROLE + more) for q, to in MADE.items()]
    return out


INSERTS = [(q, "I", to, INSERT) for q, to in MADE.items()]
AHEAD = {s: [[(op, to, cost) for q, op, to, cost in edits_of(s) if q == state] for state in range(4)] for s in SYMBOLS}
BACK = {s: [[(op, q, cost) for q, op, to, cost in edits_of(s) if to == state] for state in range(4)] for s in SYMBOLS}
INSERT_AHEAD = [[(op, to, cost) for q, op, to, cost in INSERTS if q == state] for state in range(4)]
INSERT_BACK = [[(op, q, cost) for q, op, to, cost in INSERTS if to == state] for state in range(4)]


def cheapest(symbols: str, entry: int = START, exits: tuple[int, ...] = (START, ASSISTANT)) -> Cell:
    """Cost and audit of the cheapest edits of the rows from state `entry` to one of `exits`; the audit least in ASCII order of all such."""
    n = len(symbols)

    def ahead(node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], str, int]]:
        i, q = node
        for op, to, cost in AHEAD[symbols[i]][q] if i < n else ():
            yield (i + 1, to), op, cost
        for op, to, cost in INSERT_AHEAD[q]:
            yield (i, to), op, cost

    def back(node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], str, int]]:
        i, q = node
        for op, before, cost in BACK[symbols[i - 1]][q] if i else ():
            yield (i - 1, before), op, cost
        for op, before, cost in INSERT_BACK[q]:
            yield (i, before), op, cost

    labels: list[dict[tuple[int, int], Cell]] = [{(0, entry): (0, "")}, {(n, q): (0, "") for q in exits}]
    heaps = [[(0, 0, q) for _, q in labels[0]], [(0, 0, q) for _, q in labels[1]]]
    settled: list[set[tuple[int, int]]] = [set(), set()]
    best = INFINITE

    def settle(side: int) -> None:
        nonlocal best
        cost, far, q = heapq.heappop(heaps[side])
        node = (far if side == 0 else n - far, q)
        if node in settled[side]:
            return
        settled[side].add(node)
        mine, others = labels[side], labels[1 - side]
        audit = mine[node][1]
        if node in others:
            best = min(best, cost + others[node][0])
        for to, op, more in (ahead if side == 0 else back)(node):
            label = (cost + more, audit + op if side == 0 else op + audit)
            if to not in mine or label < mine[to]:
                mine[to] = label
                heapq.heappush(heaps[side], (label[0], to[0] if side == 0 else n - to[0], to[1]))

    for side in (0, 1):
        for _ in range(len(heaps[side])):
            settle(side)
    # a side that has run out has settled all it can reach
    while all(heaps) and heaps[0][0][0] + heaps[1][0][0] <= best:
        settle(0 if heaps[0][0][0] <= heaps[1][0][0] else 1)

    found = NO_WAY
    for node in settled[0]:
        cost, audit = labels[0][node]
        for to, op, more in [(node, "", 0), *ahead(node)]:
            if to in settled[1]:
                rest = labels[1][to]
                whole = (cost + more + rest[0], audit + op + rest[1])
                if found == NO_WAY or whole < found:
                    found = whole
    return found


def between_states(symbols: str) -> list[Cell]:
    """cheapest() from each state to each, at 4 * entry + exit."""
    return [cheapest(symbols, q, (r,)) for q in range(4) for r in range(4)]


def joined(left: list[Cell], right: list[Cell]) -> tuple[list[Cell], list[int]]:
    """Cells of two parts one behind the other, and the states between."""
    cells, middle = [], []
    for q in range(4):
        for r in range(4):
            cost, audit, m = min((left[4 * q + m][0] + right[4 * m + r][0], left[4 * q + m][1] + right[4 * m + r][1], m) for m in range(4))
            cells.append((cost, audit) if cost < INFINITE else NO_WAY)
            middle.append(m)
    return cells, middle


def way_through(blocks: list[list[Cell]]) -> list[tuple[int, int]]:
    """(entry, exit) of each block on the cheapest way through all."""
    levels, middles = [blocks], []
    while len(levels[-1]) > 1:
        now = levels[-1]
        pairs = [joined(now[i], now[i + 1]) for i in range(0, len(now) - 1, 2)]
        levels.append([cells for cells, _ in pairs] + now[len(pairs) * 2 :])
        middles.append([m for _, m in pairs])
    whole = levels[-1][0]
    ways = [(START, min((START, ASSISTANT), key=lambda r: whole[4 * START + r]))]
    for middle in reversed(middles):
        ways = [w for i, (q, r) in enumerate(ways) for w in ([(q, middle[i][4 * q + r]), (middle[i][4 * q + r], r)] if i < len(middle) else [(q, r)])]
    return ways


def n_illegal(symbols: str) -> int:
    kinds = [SYMBOLS.index(s) // 3 for s in symbols]
    return sum(pair not in LEGAL for pair in zip(kinds, kinds[1:], strict=False))


PLAN = "key string, block long, entry int, edits string, cost long, illegal long"


def plan_alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cells = [cheapest(s) for s in pdf["symbols"]]
        yield pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "entry": START, "edits": [a for _, a in cells], "cost": [c for c, _ in cells], "illegal": [n_illegal(s) for s in pdf["symbols"]]})


def cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cells = [between_states(s) for s in pdf["symbols"]]
        yield pdf[["key", "block", "symbols"]].assign(costs=[[c for c, _ in x] for x in cells], edits=[[a for _, a in x] for x in cells])


def plan_joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one conversation."""
    pdf = pdf.sort_values("block", ignore_index=True)
    blocks = [list(zip(c, a, strict=True)) for c, a in zip(pdf["costs"], pdf["edits"], strict=True)]
    ways = way_through(blocks)
    cells = [x[4 * q + r] for x, (q, r) in zip(blocks, ways, strict=True)]
    before = ["", *[s[-1] for s in pdf["symbols"][:-1]]]
    illegal = [n_illegal(b + s) for b, s in zip(before, pdf["symbols"], strict=True)]
    return pdf[["key", "block"]].assign(entry=[q for q, _ in ways], edits=[a for _, a in cells], cost=[int(c) for c, _ in cells], illegal=illegal)


def or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations, with the faults that crc32(`conv_id:turn`) % 20 chooses: 0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    k = F.crc32(F.concat(or_space(F.col("conv_id")), F.lit(":"), or_space(F.col("turn"))).cast("binary")) % 20
    role, text = or_space(F.col("role")), or_space(F.col("text"))
    kept = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), k.alias("k")).where("k > 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1)))
    return kept.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), again.alias("again")).drop("again")


def placed(rows: DataFrame) -> DataFrame:
    """key, turn, role, text, at, kind, same: a table in which `at` rises with a conversation's order; kind is 3 * class + fault without duplicates, same the digest of role and text."""
    role, text = or_space(F.col("role")), or_space(F.col("text"))
    every = rows.select(or_space(F.col("conv_id")).alias("key"), "turn", role.alias("role"), text.alias("text"))
    # the beginning of the text splits many rows of one turn; whole texts would go to the driver's sample
    dealt = every.repartitionByRange("key", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("key", "turn", "role", "text")
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", GONE).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT)
    initial = F.substring("role", 1, 1)
    kind = 3 * F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + fault
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return B.written(dealt.select("*", F.monotonically_increasing_id().alias("at"), kind.alias("kind"), same.alias("same")), "turns")


def with_duplicates(turns: DataFrame) -> DataFrame:
    """turns -> key, at, kind (a duplicate must go), blank, duplicate, truncated."""
    firsts = turns.groupBy("key", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    rows = turns.select("key", "at", "kind").join(firsts, "at", "left")
    fault, repeated = F.col("kind") % 3, F.col("first").isNull()
    kind = F.when(repeated, F.col("kind") - fault + GONE).otherwise(F.col("kind"))
    return rows.select("key", "at", kind.alias("kind"), (fault == GONE).alias("blank"), ((fault != GONE) & repeated).alias("duplicate"), ((fault == CUT) & ~repeated).alias("truncated"))


def plans(turns: DataFrame, block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """(key, block, entry, edits, cost, illegal of every block; key, blank, duplicate, truncated of every conversation)."""
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda r: F.substring(F.lit(SYMBOLS), r["kind"] + 1, F.lit(1))), "")
    faults = ("blank", "duplicate", "truncated")
    rows = with_duplicates(turns).withColumn("block", F.shiftright("at", block_bits))
    blocks = B.written(rows.groupBy("key", "block").agg(letters.alias("symbols"), *[F.count_if(f).alias(f) for f in faults]), "blocks")
    sums = B.written(blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n_blocks"), *[F.sum(f).cast("long").alias(f) for f in faults]), "faults")
    sized = blocks.select("key", "block", "symbols").join(sums.select("key", "n_blocks"), "key")
    alone = sized.where("n_blocks = 1").select("key", "block", "symbols").mapInPandas(plan_alone, PLAN)
    cells = sized.where("n_blocks > 1").select("key", "block", "symbols").repartition("key", "block").mapInPandas(cells_of, "key string, block long, symbols string, costs array<double>, edits array<string>")
    long = cells.groupBy("key").applyInPandas(plan_joined, PLAN)
    return B.written(alone.unionByName(long), "plan"), sums.drop("n_blocks")


class Editor:
    """Follows the edits of one conversation: gives (edit, role, text) in order."""

    def __init__(self) -> None:
        self.edits, self.i, self.state = "", 0, START

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.i < len(self.edits) and self.edits[self.i] == "I":
            yield "I", self.made(), ""

    def made(self) -> str:
        self.state = MADE[self.state]
        self.i += 1
        return ROLES[self.state]

    def block(self, edits: str, entry: int) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        self.edits, self.i, self.state = edits, 0, entry

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.edits[self.i]
        if edit == "R":
            yield edit, self.made(), text
            return
        self.i += 1
        if edit == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        yield edit, role, text


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[str, str, str]], bool]]:
    """(key, some of its (edit, role, text), whether these are its first), in order."""
    key, editor = None, Editor()
    for batch in batches:
        for k, is_row, role, text, entry in zip(*[batch.column(c).to_pylist() for c in ("key", "is_row", "role", "text", "entry")], strict=True):
            if k != key:
                if key is not None and (rest := list(editor.inserted())):
                    yield key, rest, False
                key, editor = k, Editor()
                yield key, [], True
            if got := list(editor.row(role, text) if is_row else editor.block(text, entry)):
                yield key, got, False
    if key is not None and (rest := list(editor.inserted())):
        yield key, rest, False


def in_order(turns: DataFrame, plan: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Blocks' edits and the rows they are for, one behind the other, a conversation in one partition."""
    rows = turns.select("key", "at", F.lit(1).alias("is_row"), "role", "text", F.lit(0).alias("entry"))
    edits = plan.select("key", F.shiftleft("block", block_bits).alias("at"), F.lit(0).alias("is_row"), F.lit("").alias("role"), F.col("edits").alias("text"), "entry")
    return rows.unionByName(edits).repartition("key").sortWithinPartitions("key", "at", "is_row")


def repaired_turns(turns: DataFrame, plan: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """key, place, edit, role, text: the repaired rows, and the deleted ones (edit D)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out = 0, []

        def batch() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "place", "edit", "role", "text"])

        for key, some, first in edited(batches):
            place = 0 if first else place
            for edit, role, text in some:
                out.append((key, place, edit, role, text))
                place += 1
            if len(out) >= 1000:
                yield batch()
                out = []
        if out:
            yield batch()

    return in_order(turns, plan, block_bits).mapInArrow(run, "key string, place long, edit string, role string, text string")


def repaired_digests(turns: DataFrame, plan: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """key, repaired_sha256: of the repaired rows as `role:text`, joined by line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, digest, n = [], None, hashlib.sha256(), 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["key", "repaired_sha256"])

        for new, some, first in edited(batches):
            if first:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest, n = new, hashlib.sha256(), 0
                if len(out) >= 10_000:
                    yield batch()
                    out = []
            for edit, role, text in some:
                if edit != "D":
                    digest.update(f"{'\n' if n else ''}{role}:{text}".encode())
                    n += 1
        if key is not None:
            out.append((key, digest.hexdigest()))
            yield batch()

    return in_order(turns, plan, block_bits).mapInArrow(run, "key string, repaired_sha256 string")


def repair(rows: DataFrame, ids: DataFrame | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """rows (conv_id, turn, role, text) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; also of ids (conv_id) that have no rows."""
    turns = placed(rows)
    plan, faults = plans(turns, block_bits)
    gaps = turns.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    edits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda b: b["edits"]), "")
    audits = plan.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), edits.alias("audit"))
    every = (rows if ids is None else ids).select("conv_id").distinct().withColumn("key", or_space(F.col("conv_id")))
    got = every.join(gaps, "key", "left").join(faults, "key", "left").join(audits, "key", "left").join(repaired_digests(turns, plan, block_bits), "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return got.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, damaged and repaired."""
    rows = B.table(spark, sf_dir, "conversations")
    return repair(damaged(rows), rows)


def _least(*ways: tuple[str, str, str, str]) -> str:
    """SQL of the least (cost, audit) of ways (state before, cost, edit, condition)."""
    far = 1_000_000_000
    return "list_min([" + ", ".join(f"{{'c': {q}.c + CASE WHEN {ok} THEN {cost} ELSE {far} END, 'a': {q}.a || '{op}'}}" for q, cost, op, ok in ways) + "])"


_GO = ("NOT gone", f"{REROLE} + more", "R")
_ROW = {
    "n0": _least(("s0", str(DELETE), "D", "true")),
    "n1": _least(("s1", str(DELETE), "D", "true"), ("s0", "more", "K", "NOT gone AND initial = 's'")),
    "n2": _least(("s2", str(DELETE), "D", "true"), *[w for q in ("s0", "s1", "s3") for w in ((q, "more", "K", "NOT gone AND initial = 'u'"), (q, _GO[1], _GO[2], _GO[0]))]),
    "n3": _least(("s3", str(DELETE), "D", "true"), ("s2", "more", "K", "NOT gone AND initial = 'a'"), ("s2", _GO[1], _GO[2], _GO[0])),
}


def _with_inserts(source: str) -> str:
    """SQL of key, i, s0 to s3 from n0 to n3, with inserted rows behind."""
    two = "list_min([n2, " + _least(*[(q, str(INSERT), "I", "true") for q in ("n0", "n1", "n3")]) + "])"
    return f"SELECT key, i, n0 AS s0, n1 AS s1, m2 AS s2, list_min([n3, {_least(('m2', str(INSERT), 'I', 'true'))}]) AS s3 FROM (SELECT *, {two} AS m2 FROM ({source}))"


_NONE = "{'c': CAST(1000000000 AS BIGINT), 'a': ''}"

#: The search as a plain recursion over rows, with the least (cost, audit) of each state.
OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
keyed AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("t", "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations, crc
),
damaged AS (
  SELECT key, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, (VALUES (1), (2)) r(again) WHERE k > 0 AND (again = 1 OR k = 3)
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, substr(role, 1, 1) AS initial
  FROM damaged
),
rows_ AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 AS duplicate,
         lag(initial) OVER (PARTITION BY key ORDER BY i) || initial AS pair
  FROM numbered
),
faults AS MATERIALIZED (
  SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM rows_
),
search AS (
  {_with_inserts(f"SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS n0, {_NONE} AS n1, {_NONE} AS n2, {_NONE} AS n3 FROM faults")}
  UNION ALL
  {_with_inserts("SELECT key, i, " + ", ".join(f"{c} AS {n}" for n, c in _ROW.items()) + f" FROM (SELECT s.key, f.i, s0, s1, s2, s3, gone, initial, CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END AS more FROM search s JOIN faults f ON f.key = s.key AND f.i = s.i + 1)")}
),
sums AS (
  SELECT key, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY key
),
audits AS MATERIALIZED (SELECT key, list_min([s0, s3]) AS best FROM search JOIN sums USING (key) WHERE i = n),
edits AS (
  SELECT key, best.a AS audit, 0 AS j, CAST(0 AS BIGINT) AS i, 0 AS q, CAST([] AS VARCHAR[]) AS pieces FROM audits
  UNION ALL
  SELECT key, audit, j + 1, CASE WHEN op = 'I' THEN i ELSE i + 1 END,
         CASE op WHEN 'D' THEN q WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE WHEN q = 2 THEN 3 ELSE 2 END END,
         CASE op WHEN 'D' THEN pieces WHEN 'K' THEN list_append(pieces, role || ':' || text) WHEN 'I' THEN list_append(pieces, made || ':') ELSE list_append(pieces, made || ':' || text) END
  FROM (
    SELECT e.*, substr(audit, j + 1, 1) AS op, CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END AS made, f.role, f.text, f.initial
    FROM edits e LEFT JOIN faults f ON f.key = e.key AND f.i = e.i + 1 WHERE j < length(audit)
  )
),
digests AS (SELECT key, sha256(array_to_string(pieces, chr(10))) AS digest FROM edits WHERE j = length(audit))
SELECT c.conv_id, {", ".join(f"CAST(coalesce({n}, 0) AS BIGINT) AS {n}" for n in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
       CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS key FROM conversations) c
LEFT JOIN sums USING (key) LEFT JOIN audits USING (key) LEFT JOIN digests USING (key)
"""
