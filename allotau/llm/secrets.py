"""Secret scan: fixed patterns, and a battery of randomness tests for tokens that no pattern names.

All of it is column expressions: no Python runs on the executors and no row is shuffled.

Battery. A token of 20+ characters is given an encoding by its alphabet (hex, base32,
base36: letters of one case and digits, base64). '=' ends a token, as its padding, so that
the value of NAME=VALUE is tested by itself. Tokens without a digit, and those of one case
with signs among them, get no encoding and aren't tested. Three tests follow: chi-squared uniformity of the alphabet, runs of character
classes, and lag-1 serial correlation of the character codes. A token stays a candidate
if randomness isn't rejected by chi-squared or serial correlation. Its evidence against
the null "written by people" is the normal score of chi-squared below what a text of that
length gives (a noncentral chi-squared, so the length counts), or that of the runs
beyond a text's, whichever is less. False discoveries are controlled for each length class apart, by the
Benjamini-Hochberg rule over the scores of the whole corpus, kept as counts in bins of
fixed number. Tokens that a fixed pattern names already aren't among them. The null law of a
class is the normal one, or that of the corpus' own tokens where that has the wider tail:
mean and spread of the scores within CENTRE of 0, drawn towards the normal law by PRIOR tokens.

Defined results: a null or empty text has no spans, and the digest of nothing; repeated
rows each give a row; extra columns are ignored; an empty table gives an empty result.
Added spans never overlap base spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allotau.llm import _base as B

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}=*"
KINDS = ("assign", "access", "hex", "random")
#: By encoding: number of symbols, and how far from uniform people's text is over them (symbols * sum of squared shares - 1).
ENCODINGS = {"hex": (16, 1.0), "base32": (32, 1.1), "base36": (36, 1.4), "base64": (64, 3.2)}
SYMBOLS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Share of neighbours of unlike class (lower, upper, digit) in people's text.
TEXT_CHANGES = 0.15
#: Randomness is rejected beyond this normal score.
REJECT = 3.3
ALPHA = 0.01
LENGTH_CLASSES = (20, 28, 40, 64)
#: Bins on each side of 0, and their width.
BINS, BIN = 400, 0.05
CENTRE, PRIOR = 2.0, 100
#: Variance of a normal variable that is known to be within CENTRE of 0.
CENTRE_VARIANCE = 0.7737
MASK = "<SECRET>"
#: Values that one fold runs over, and how often runs are gathered to runs; characters that masked texts are cut from; beyond all positions.
RUN, LEVELS, PART, FAR = 100, 2, 1024, 2**31 - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, wherever body uses it; within lambdas, too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before_each(values: Column, op: Callable[[Column, Column], Column], first: int, levels: int = LEVELS) -> Column:
    """op over `first` and all earlier values, for each value of an array of integers; op is associative, first its neutral value.

    A fold copies what it has gathered at each step, so it only runs over RUN values; what
    comes before a run is found in the same way from the runs' own values.
    """

    def fold(run: Column, start: Column) -> Column:
        none = F.array().cast("array<int>")
        step = lambda acc, x: F.struct(op(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))
        return F.aggregate(run, F.struct(start.alias("now"), none.alias("out")), step, lambda acc: acc["out"])

    if not levels:
        return fold(values, F.lit(first))

    def by_runs(runs: Column) -> Column:
        own = F.transform(runs, lambda run: F.aggregate(run, F.lit(first), lambda a, x: op(a, x)))
        return F.flatten(F.zip_with(runs, before_each(own, op, first, levels - 1), fold))

    def cut(v: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * RUN + 1, F.lit(RUN)))

    return let(let(values, cut), by_runs)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, part) of the leftmost non-overlapping matches, in code points; part is the group."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.zip_with(F.transform(gaps, F.length), F.transform(whole, F.length), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    matches = F.slice(lengths, F.lit(1), F.size(whole))
    starts = before_each(F.transform(matches, lambda x: x["g"] + x["m"]), lambda x, y: x + y, 0)
    spans = F.zip_with(matches, starts, lambda x, at: F.struct((at + x["g"]).alias("s"), (at + x["g"] + x["m"]).alias("e")))
    found = F.zip_with(spans, part, lambda p, x: F.struct(p["s"].alias("start"), p["e"].alias("end"), x.alias("part")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,part:string>>"))


def as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end) by start, then kind."""
    assign = F.filter(located(text, ASSIGN, 2), lambda x: F.length(x["part"]) >= 8)
    return F.array_sort(F.concat(as_spans(assign, 0), as_spans(located(text, ACCESS), 1), as_spans(located(text, HEX), 2)))


def encoding_of(s: Column) -> Column:
    digit, lower, upper = s.rlike("[0-9]"), s.rlike("[a-z]"), s.rlike("[A-Z]")
    return (
        F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)=*$") & digit & (lower | upper), "hex")
        .when(s.rlike("^[A-Z2-7]+=*$") & digit & upper, "base32")
        .when(s.rlike("^([0-9a-z]+|[0-9A-Z]+)=*$") & digit & (lower | upper), "base36")
        .when(s.rlike("^[A-Za-z0-9+/_-]+=*$") & digit & lower & upper, "base64")
    )


def by_encoding(encoding: Column, value) -> Column:
    out = F.lit(None)
    for name in ENCODINGS:
        out = F.when(encoding == name, F.lit(value(name))).otherwise(out)
    return out


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def tested(token: Column) -> Column:
    """Struct of encoding and z, the evidence that the token is random rather than text; z is null if randomness is rejected."""
    enc = encoding_of(token)
    bare = F.rtrim(token, F.lit("="))
    body = F.when(enc.isin("hex", "base36"), F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    k, drift = by_encoding(enc, lambda e: float(ENCODINGS[e][0])), by_encoding(enc, lambda e: ENCODINGS[e][1])
    symbols = by_encoding(enc, lambda e: SYMBOLS[e])

    def given(st: Column) -> Column:
        n = F.size(st["chars"]).cast("double")
        counts = F.transform(F.array_distinct(st["chars"]), lambda c: F.pow(F.size(F.filter(st["chars"], lambda d: d == c)).cast("double"), F.lit(2.0)))
        chi = total(counts) * st["k"] / n - n
        df = st["k"] - 1
        # Wilson-Hilferty: normal score of chi-squared under randomness
        high = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        codes = F.transform(st["chars"], lambda c: F.instr(st["symbols"], c).cast("double"))
        mean = total(codes) / n
        off = F.transform(codes, lambda x: x - mean)
        pairs = F.zip_with(F.slice(off, 1, (n - 1).cast("int")), F.slice(off, 2, (n - 1).cast("int")), lambda x, y: x * y)
        around = total(F.transform(off, lambda x: x * x))
        serial = F.when(around > 0, total(pairs) / around * F.sqrt(n)).otherwise(F.lit(99.0))
        kinds = F.transform(st["chars"], lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[a-z]"), 1).when(c.rlike("[A-Z]"), 2).otherwise(3))
        changes = total(F.zip_with(F.slice(kinds, 1, (n - 1).cast("int")), F.slice(kinds, 2, (n - 1).cast("int")), lambda x, y: (x != y).cast("double")))
        z_runs = (changes - TEXT_CHANGES * (n - 1)) / F.sqrt(TEXT_CHANGES * (1 - TEXT_CHANGES) * (n - 1))
        pull = n * st["drift"]
        z_text = (df + pull - chi) / F.sqrt(2 * (df + 2 * pull))
        z = F.least(z_text, z_runs)  # both must speak: the larger of two p-values is one for "either null holds"
        return F.when((high <= REJECT) & (F.abs(serial) <= REJECT), z)

    state = F.array(F.struct(chars.alias("chars"), k.alias("k"), drift.alias("drift"), symbols.alias("symbols")))
    z = F.when(enc.isNotNull(), F.element_at(F.transform(state, given), 1))
    return F.struct(enc.alias("encoding"), z.alias("z"))


def candidates(text: Column) -> Column:
    """Array of (start, end, length, z) of the tokens that have an encoding."""
    got = F.transform(located(text, TOKEN), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.length(x["part"]).alias("length"), tested(x["part"]).alias("test")))
    return F.filter(got, lambda x: x["test"]["encoding"].isNotNull())


def length_class(length: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTH_CLASSES):
        out = F.when(length >= least, i).otherwise(out)
    return out


def tail(z: Column) -> Column:
    """Upper tail of the normal law, to 0.3 %, for z >= 0; a half below."""
    z = F.greatest(z, F.lit(0.0))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (0.661 * z + 0.339 * F.sqrt(z * z + 5.51))


def apart(base: Column, found: Column) -> Column:
    """Those of found, in order of start, that overlap none of the base spans: by the ends of those that begin before, and the beginnings of those behind."""

    def clear(events: Column) -> Column:
        ends = before_each(F.transform(events, lambda e: F.when(e["base"] == 1, e["end"]).otherwise(-1)), F.greatest, -1)
        begins = F.reverse(before_each(F.transform(F.reverse(events), lambda e: F.when(e["base"] == 1, e["at"]).otherwise(FAR)), F.least, FAR))
        near = F.zip_with(ends, begins, lambda end, at: F.struct(end.alias("end"), at.alias("at")))
        both = F.zip_with(events, near, lambda e, n: F.struct(e["base"].alias("base"), ((n["end"] <= e["at"]) & (n["at"] >= e["end"])).alias("clear")))
        return F.transform(F.filter(both, lambda x: x["base"] == 0), lambda x: x["clear"])

    def event(is_base: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("at"), F.lit(is_base).alias("base"), s["end"].alias("end"))

    events = F.array_sort(F.concat(F.transform(base, event(1)), F.transform(found, event(0))))
    kept = F.filter(F.zip_with(found, let(events, clear), lambda c, ok: F.struct(c.alias("c"), ok.alias("ok"))), lambda x: x["ok"])
    return F.when((F.size(base) > 0) & (F.size(found) > 0), F.transform(kept, lambda x: x["c"])).otherwise(found)


def scored_tokens(docs: DataFrame) -> DataFrame:
    """class, bin (null if randomness is rejected) and number of the tokens that no fixed pattern names; LENGTH_CLASSES x 2 BINS rows at most."""
    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).select("text", candidates(F.col("text")).alias("found"))
    base = F.when(F.size("found") > 0, base_spans(F.col("text"))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    tokens = found.select("found", base.alias("base")).select(F.explode(apart(F.col("base"), F.col("found"))).alias("c"))
    kept = tokens.select(length_class(F.col("c.length")).alias("class"), F.floor(F.least(F.greatest(F.col("c.test.z") / BIN, F.lit(float(-BINS))), F.lit(float(BINS)))).alias("bin"))
    return kept.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"))


def thresholds(docs: DataFrame, alpha: float = ALPHA) -> list[float]:
    """By length class, the least z that counts as a secret. Counts cover every token."""
    own = Window.partitionBy("class")
    z = F.col("bin") * BIN
    inner = F.when(F.abs(z) <= CENTRE, F.col("n")).otherwise(0)
    null = scored_tokens(docs).withColumn("all", F.sum("n").over(own)).withColumn("weight", F.sum(inner).over(own) + PRIOR)
    null = null.where("bin is not null").withColumn("mean", F.sum(inner * z).over(own) / F.col("weight"))
    null = null.withColumn("spread", F.sqrt((F.sum(inner * F.pow(z - F.col("mean"), F.lit(2.0))).over(own) / CENTRE_VARIANCE + PRIOR) / F.col("weight")))
    ranked = null.withColumn("above", F.sum("n").over(own.orderBy(F.col("bin").desc())))
    p = F.greatest(tail(z), tail((z - F.col("mean")) / F.col("spread")))
    passed = ranked.where((F.col("bin") >= 0) & (p * F.col("all") <= alpha * F.col("above"))).groupBy("class").agg(F.min(z).alias("z"))
    got = {r["class"]: r["z"] for r in passed.collect()}
    return [got.get(i, math.inf) for i in range(len(LENGTH_CLASSES))]


def all_spans(text: Column, base: Column, least: list[float]) -> Column:
    """base and the random tokens apart from it."""
    def enough(c: Column) -> Column:
        out = F.lit(False)
        for i, x in enumerate(least):
            if x < math.inf:
                out = out | ((length_class(c["length"]) == i) & (c["test"]["z"] >= x))
        return F.coalesce(out, F.lit(False))

    return F.array_sort(F.concat(base, as_spans(let(F.filter(candidates(text), enough), lambda found: apart(base, found)), 3)))


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs with base_found and found, arrays of (start, kind, end), beside its own columns."""
    least = thresholds(docs.select("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    got = docs.withColumn("base_found", base_spans(text))
    return got.withColumn("found", all_spans(text, F.col("base_found"), least))


def printed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span, or run of overlapping spans, replaced by MASK. What stays is cut out of PART characters each, not of the whole text."""

    def cut(parts: Column, gap: Column) -> Column:
        first, last = F.floor(gap["from"] / PART).cast("int"), F.floor((gap["to"] - 1) / PART).cast("int")
        size, at = gap["to"] - gap["from"], gap["from"] % PART + 1
        far = F.concat(F.substring(F.get(parts, first), at, F.lit(PART)), F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.substring(F.get(parts, last), F.lit(1), (gap["to"] - 1) % PART + 1))
        return F.when(size <= 0, "").when(first == last, F.substring(F.get(parts, first), at, size)).otherwise(far)

    end = F.struct(F.length(text).alias("start"), F.lit(0).alias("kind"), F.length(text).alias("end"))
    every = F.concat(spans, F.array(end))
    gaps = F.zip_with(before_each(F.transform(every, lambda s: s["end"]), F.greatest, 0), every, lambda at, s: F.struct(at.alias("from"), s["start"].alias("to")))
    state = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)).alias("parts"), F.filter(gaps, lambda g: g["from"] <= g["to"]).alias("gaps"))
    done = let(state, lambda st: F.array_join(F.transform(st["gaps"], lambda g: cut(st["parts"], g)), MASK))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = find_secrets(B.table(spark, sf_dir, "documents").select("doc_id", "text"))

    def n(kind: int) -> Column:
        return F.size(F.filter("base_found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", n(0), n(1), n(2), F.sha2(printed(F.col("base_found")), 256).alias("base_sha256"), printed(F.col("found")).alias("spans"))
