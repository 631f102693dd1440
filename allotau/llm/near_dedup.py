"""Near-duplicate detection by BagMinHash, banding and verified multiset overlap.

A text is the multiset of its five-word shingles (words: runs of ASCII letters and digits
and of all non-ASCII characters, lower case; a shorter text is one shingle). Similarity is
weighted Jaccard: shared copies over all copies. Links are pairs of 0.8 and more, classes
their connected components.

1. Equal texts are one class, by checksum; one of them stands for all. A task signs a text
   that it meets again no second time (it remembers MEMO checksums).
2. BagMinHash: weights are cut into levels, the levels into blocks (1], (1,2], (2,4],
   (4,8] ...; each block of a shingle is a Poisson process whose points fall on signature
   components and levels, and points above the weight don't count. A component keeps its
   first point. The work follows log(weight), and points beyond what the text's total
   weight needs are never made.
3. Band buckets: each text meets only the bucket's pivot (the one that meets most texts in all its
   buckets), so a bucket of n texts makes n pairs. They are verified on the texts.
4. What this leaves apart in a bucket is compared exactly, but for pairs that two bounds
   rule out. 1 - similarity is a metric, so texts x, y of pivot p can be linked only if
   |d(x,p) - d(y,p)| <= 0.2. And x and y share no more than what neither lacks of p, and what
   both hold beyond p; of that, copies which no other text of that pivot holds don't
   count. Texts outside a pivot's largest component meet the others of their buckets that
   these bounds leave.
5. Components by repeated smallest labels with pointer jumping, each round a table.

Classes are of texts: only verified similarity links them. Of each, the text of the smallest
doc_id (of those, of the smallest checksum) is kept and names the class. The class of a
document is derived from them afterwards: an id that comes with several texts belongs to the
classes of all, and documents that share a class of texts, directly or by others, are one.

Defined results: null and empty texts are classes of their own; a text without words
equals only the same text; an id that comes with several texts links documents, not texts;
rows without an id stay alone, with no class; repeated rows each give a row; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allotau.llm import _base as B

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
BATCH_BYTES = 1 << 20
MEMO = 100_000
GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64, as many as a batch has bytes."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(2 * BATCH_BYTES + 2, b, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def is_word() -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)] = True
    out[128:] = True
    return out


IS_WORD = is_word()
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def polynomial(word: bytes) -> np.uint64:
    """Sum of (byte + 1) * BASE ** place: what word_hashes takes from running sums, for a word of any length."""
    power, _ = powers()
    out = 0
    for i in range(0, len(word), BATCH_BYTES):
        raw = np.frombuffer(word[i : i + BATCH_BYTES], np.uint8)
        out += int(((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)]).sum()) * pow(BASE, i, 1 << 64)
    return np.uint64(out % (1 << 64))


def segments(texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Batches of about BATCH_BYTES: document numbers and bytes. A longer text is cut between words; a longer word comes by itself."""
    at, parts, size = [], [], 0
    for i, text in enumerate(texts):
        b = text.lower().encode("utf-8", "surrogatepass")
        x = 0
        while x < len(b):
            y = len(b)
            if y - x > BATCH_BYTES:
                gaps = np.flatnonzero(~IS_WORD[np.frombuffer(b, np.uint8, BATCH_BYTES, x)])
                gap = GAP.search(b, x + BATCH_BYTES) if not len(gaps) else None
                y = x + int(gaps[-1]) + 1 if len(gaps) else gap.start() if gap else y
            if size + y - x + 1 > BATCH_BYTES and parts:
                yield at, parts
                at, parts, size = [], [], 0
            at.append(i)
            parts.append(b[x:y])
            size += y - x + 1
            x = y
    if parts:
        yield at, parts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of every word, in order."""
    power, inverse = powers()
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, parts in segments(texts):
        if len(parts) == 1 and len(parts[0]) > BATCH_BYTES:  # one endless word
            docs.append(np.array(at))
            hashes.append(mix(np.array([polynomial(parts[0])])))
            continue
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        word = IS_WORD[raw]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * inverse[start]))
        ends = np.cumsum([len(p) + 1 for p in parts])
        docs.append(np.array(at)[np.searchsorted(ends, start, side="right")])
    return np.concatenate(docs), np.concatenate(hashes)


def shingle_counts(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, hash and count of every distinct shingle of each text; by document, then hash."""
    doc, w = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    h = np.zeros(len(w), np.uint64)
    size = np.minimum(words, n)[doc]  # words of the shingle that starts at each word
    last = np.cumsum(n)[doc]
    place = np.arange(len(w))
    whole = place + size <= last
    for k in range(words):
        live = whole & (k < size)
        h[live] = mix(h[live] * GOLD + w[place[live] + k])
    doc, h = doc[whole], h[whole]
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def bag_signatures(n_docs: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """BagMinHash signatures, n_docs x m (0 in documents without shingles)."""
    ids = np.zeros(n_docs * m, np.uint64)
    total = np.bincount(doc, weight, n_docs)
    reach = 6.0
    todo = total > 0
    while todo.any():
        limit = np.where(todo, m * (math.log(m) + reach) / np.maximum(total, 1), -1.0)
        first = np.full(n_docs * m, np.inf)
        mine = todo[doc]
        d0, s0, w0 = doc[mine], shingle[mine], weight[mine]
        block, least = 0, 0  # the block holds levels least + 1 to least + rate
        while len(d0):
            rate = max(1, least)
            seed = mix(s0 ^ mix(np.full(1, block + 1, np.uint64) * GOLD))
            d, w, x, t = d0, w0, np.zeros(len(d0)), 0
            while len(d):
                t += 1
                point = mix(seed + np.uint64(t * int(GOLD) % (1 << 64)))
                x = x - np.log(((point >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
                live = x <= limit[d]
                d, w, x, seed, point = d[live], w[live], x[live], seed[live], point[live]
                place = mix(point + GOLD)
                level = least + 1 + ((place >> np.uint64(32)) % np.uint64(rate)).astype(np.int64)
                under = level <= w
                slot = d[under] * m + ((place[under] & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
                own = x[under]
                np.minimum.at(first, slot, own)
                new = own == first[slot]
                ids[slot[new]] = point[under][new]
            block, least = block + 1, max(1, 2 * least)
            more = w0 > least
            d0, s0, w0 = d0[more], s0[more], w0[more]
        todo &= np.isinf(first).reshape(n_docs, m).any(axis=1)
        reach *= 2
    return ids.reshape(n_docs, m)


def band_hashes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLD)[None, :].repeat(len(signatures), axis=0)
    for r in range(rows):
        out = mix(out * GOLD + signatures[:, r::rows][:, :bands])
    return out.view(np.int64)


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """docs (doc_id, sum, text) -> doc_id, sum, bands (null where the task has signed the same text before)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[str] = set()
        for pdf in batches:
            out = pdf[["doc_id", "sum"]].copy()
            fresh = np.flatnonzero(~pdf["sum"].duplicated() & ~pdf["sum"].isin(known))
            texts, found = pdf["text"].iloc[fresh].tolist(), []
            for a, b in B.in_batches(texts, BATCH_BYTES):
                doc, h, n = shingle_counts(texts[a:b])
                got = band_hashes(bag_signatures(b - a, doc, h, n, bands * rows), bands, rows)
                some = np.bincount(doc, minlength=b - a) > 0
                found += [x if s else x[:0] for x, s in zip(got, some, strict=True)]
            own = np.full(len(pdf), None, object)
            for i, x in zip(fresh, found, strict=True):
                own[i] = x
            out["bands"] = own
            if len(known) > MEMO:
                known = set()
            known.update(pdf["sum"].iloc[fresh])
            yield out

    return docs.mapInPandas(run, "doc_id long, sum string, bands array<long>")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = np.where(b[0][at] == a[0], np.minimum(a[1], b[1][at]), 0).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def excess(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of what a holds beyond b."""
    if not len(b[0]):
        return a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    n = a[1] - np.where(b[0][at] == a[0], np.minimum(a[1], b[1][at]), 0)
    return a[0][n > 0], n[n > 0]


def gone(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A bit for each distinct shingle of b, set if a holds fewer copies of it; as 64-bit words."""
    if not len(b[0]) or not len(a[0]):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    bits = np.packbits(np.where(a[0][at] == b[0], a[1][at], 0) < b[1])
    return np.pad(bits, (0, -len(bits) % 8)).view(np.int64)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (x, p), texts (id, text) -> x, p, d (1 - similarity), w, w_p (shingles of x and p), more, n_more (hashes and counts of what x holds beyond p), gone (which of p's x lacks)."""
    x = texts.select(F.col("id").alias("x"), F.col("text").alias("text_x"))
    p = texts.select(F.col("id").alias("p"), F.col("text").alias("text_p"))
    both = pairs.join(p, "p").join(x, "x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, number = [], {}
            for t in pd.concat([pdf["text_x"], pdf["text_p"]]):
                if t not in number:
                    number[t] = len(texts)
                    texts.append(t)
            bags: list = [None] * len(texts)
            for a, b in B.in_batches(texts, BATCH_BYTES):
                doc, h, n = shingle_counts(texts[a:b])
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                for i in range(b - a):
                    bags[a + i] = (h[cuts[i] : cuts[i + 1]], n[cuts[i] : cuts[i + 1]])
            of_pair = [(bags[number[u]], bags[number[v]]) for u, v in zip(pdf["text_x"], pdf["text_p"], strict=True)]
            beyond = [excess(u, v) for u, v in of_pair]
            out = pd.DataFrame({"x": pdf["x"].to_numpy(), "p": pdf["p"].to_numpy(), "d": np.array([1 - overlap(u, v) for u, v in of_pair], float), "w": np.array([u[1].sum() for u, _ in of_pair], np.int64)})
            out["w_p"] = np.array([v[1].sum() for _, v in of_pair], np.int64)
            out["gone"] = [gone(u, v) for u, v in of_pair]
            out["more"], out["n_more"] = [h.view(np.int64) for h, _ in beyond], [n for _, n in beyond]
            yield out[["x", "p", "d", "w", "w_p", "more", "n_more", "gone"]]

    return both.select("x", "p", "text_x", "text_p").mapInPandas(run, "x long, p long, d double, w long, w_p long, more array<long>, n_more array<long>, gone array<long>")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> id, comp (smallest id of its component), for ids in links."""
    both = B.written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = B.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        hop = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        new = B.written(hop.join(jump, "comp").select("id", "old", F.least("comp", "far").alias("comp")), "labels")
        labels = new.select("id", "comp")
        if new.where("old <> comp").limit(1).count() == 0:
            return labels


def of_one_id(docs: DataFrame, several: DataFrame, classes: DataFrame) -> DataFrame:
    """docs (doc_id, sum), several (doc_id), classes (sum, comp) -> links (a, b) of the different classes that one doc_id comes with, to the first of them."""
    comps = docs.select("doc_id", "sum").join(several, "doc_id").distinct().join(classes.select("sum", "comp"), "sum")
    first = comps.groupBy("doc_id").agg(F.min("comp").alias("b"))
    return comps.join(first, "doc_id").where("comp <> b").select(F.col("comp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, sum (checksum of the text, null if none), class_id (smallest doc_id of the documents' class), text_class (checksum of the text that stands for the texts' class), kept (the row has that text and the smallest doc_id it comes with)."""
    far = 1 - similarity + 1e-12
    rows_in = docs.select("doc_id", F.when(F.col("text") != "", F.md5(F.col("text").cast("binary"))).alias("sum"), "text")
    real = rows_in.where("doc_id is not null and sum is not null")
    reps = signed(real, bands, rows).groupBy("sum").agg(F.first("bands", ignorenulls=True).alias("bands"), F.min("doc_id").alias("doc_id"))
    reps = B.written(reps.withColumn("id", F.monotonically_increasing_id()), "reps")  # a number for each different text, as the table holds it
    met = B.written(reps.select("id", F.explode("bands").alias("bucket")).distinct(), "bands")
    # sides that come from an aggregate are tables first: a join of two plain sides can be split where a bucket is hot
    shared = B.written(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    met = B.written(met.join(shared, "bucket"), "buckets")  # only buckets that two texts or more are in
    hubs = met.groupBy("id").agg(F.sum("n").alias("weight"))  # the text that meets most others, which is close to what they are copies of
    met = met.join(hubs, "id")
    pivots = B.written(met.groupBy("bucket").agg(F.max_by("id", F.struct("weight", "id")).alias("p")), "pivots")
    met = B.written(met.join(pivots, "bucket").select("bucket", "id", "p"), "met")

    texts = real.join(reps.select("id", "doc_id", "sum").join(met.select("id").distinct(), "id"), ["doc_id", "sum"]).select("id", "text")
    texts = B.written(texts.dropDuplicates(["id"]), "texts")  # a row that is repeated counts once
    stars = B.written(verified(met.where("id <> p").select(F.col("id").alias("x"), "p").distinct(), texts), "stars")
    links = stars.where(F.col("d") <= far).select(F.col("x").alias("a"), F.col("p").alias("b"))
    comps = components(links)

    # pivots whose buckets hold more than one component, with those who met them: (p, id, component, common buckets)
    placed = met.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = B.written(placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket"), "mixed")
    members = placed.join(mixed, "bucket").where("id <> p").groupBy("p", "id", "comp").agg(F.collect_set("bucket").alias("buckets"))  # at most `bands` each
    members = B.written(members, "members")
    by_comp = members.groupBy("p", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("p").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    by_comp = B.written(by_comp, "main")  # a plain side of the join on the pivot, which Spark then sends whole or splits
    # u: copies that of all texts compared with the same pivot x alone holds
    open_stars = stars.withColumnRenamed("x", "id").join(members.select("p", "id"), ["p", "id"], "left_semi")
    beyond = open_stars.select("p", "id", F.explode(F.arrays_zip("more", "n_more")).alias("m")).groupBy("p", "m.more").agg(F.count(F.lit(1)).alias("holders"), F.first("id").alias("id"), F.first("m.n_more").alias("n"))
    own = beyond.where("holders = 1").groupBy("p", "id").agg(F.sum("n").alias("u"))
    known = open_stars.select("p", "id", "d", "w", "w_p", "gone", F.aggregate("n_more", F.lit(0).cast("long"), lambda s, x: s + x).alias("r"))
    known = known.join(own, ["p", "id"], "left").withColumn("u", F.coalesce("u", F.lit(0))).where(F.col("u") <= far * F.col("w"))
    # last the join on the pivot alone, whose hot keys Spark can then split
    members = B.written(members.join(known, ["p", "id"]).join(by_comp, "p").withColumn("cell", F.floor(F.col("d") / far).cast("int")), "open")
    few = members.where("comp <> main").select("p", F.col("id").alias("x"), *[F.col(c).alias(c + "_x") for c in ("d", "w", "u", "r", "comp", "gone", "buckets")], F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    near = F.abs(F.col("d_x") - F.col("d")) <= far
    lost = F.aggregate(F.zip_with("gone_x", "gone", lambda i, j: F.bit_count(i.bitwiseOR(j))), F.lit(0), lambda s, n: s + n)
    shared = F.col("w_p") - lost + F.least(F.col("r_x") - F.col("u_x"), F.col("r") - F.col("u"))
    enough = shared >= (similarity - 1e-9) * (F.col("w_x") + F.col("w") - shared)
    pairs = few.join(members, ["p", "cell"]).where((F.col("comp_x") != F.col("comp")) & near & F.arrays_overlap("buckets_x", "buckets") & enough)
    pairs = pairs.select(F.least("x", "id").alias("p"), F.greatest("x", "id").alias("x")).distinct()
    pairs = B.written(pairs.join(stars.select("x", "p"), ["x", "p"], "left_anti"), "rest")
    rest = verified(pairs, texts).where(F.col("d") <= far).select(F.col("x").alias("a"), F.col("p").alias("b"))
    comps = components(links.union(rest))

    named = reps.select("id", "doc_id", "sum").join(comps, "id")
    named = named.join(named.groupBy("comp").agg(F.min(F.struct("doc_id", "sum")).alias("first")), "comp").select("id", "comp", "first")
    classes = reps.select("sum", "id", "doc_id").join(named, "id", "left")
    classes = classes.select("sum", F.coalesce("comp", "id").alias("comp"), F.coalesce("first", F.struct("doc_id", "sum")).alias("first"))
    several = B.written(real.select("doc_id", F.xxhash64("sum").alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("doc_id"), "several")
    own = F.col("first.doc_id")
    if several.limit(1).count():
        classes = B.written(classes, "classes")
        joint = components(B.written(of_one_id(real, several, classes), "one_id")).select(F.col("id").alias("comp"), F.col("comp").alias("joint"))
        joint = classes.join(joint, "comp")
        joint = joint.join(joint.groupBy("joint").agg(F.min("first.doc_id").alias("least")), "joint").select("sum", "least")
        classes, own = classes.join(joint, "sum", "left"), F.coalesce("least", own)
    classes = classes.select("sum", own.alias("class_id"), "first")
    some = F.col("doc_id").isNotNull()
    got = rows_in.select("doc_id", "sum").join(classes, "sum", "left")
    kept = F.coalesce((F.col("doc_id") == F.col("first.doc_id")) & (F.col("sum") == F.col("first.sum")), F.lit(True))
    return got.select("doc_id", *[F.when(some, c).alias(name) for name, c in (("sum", F.col("sum")), ("class_id", F.coalesce("class_id", "doc_id")), ("text_class", F.col("first.sum")), ("kept", kept))])


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the documents' class), text_class (checksum of the text that stands for the texts' class), kept (the row is that text's, of its smallest doc_id) of every document."""
    return near_duplicates(B.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "text_class", "kept")
