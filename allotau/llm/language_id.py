"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, buckets x languages, which is broadcast. Its
size is bounded: there are CELLS entries at most, or LEAST_BUCKETS rows if the fitting
sample has more languages than that leaves room for (it has FIT_ROWS at most). Tasks score
Arrow batches: the code points of many texts lie one behind the other in one array, their
n-grams are hashed at once with numpy, and the rows of the matrix that they hit are summed
by text. A very long text is read in pieces that overlap by what an n-gram needs, so that
each of its n-grams counts once wherever the pieces are cut.

Defined results: a null text, or one without any letter, is `und` with score 0.0, as is
every text when no row has a label. Rows are scored one by one, so repeated rows and
repeated ids each give a row, but repeated rows teach once; ids of any size come out as
they are; extra columns are kept; languages tie to the smaller name; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allotau.llm import _base as B

#: Buckets at most and at least, both powers of two; entries of the matrix.
BUCKETS, LEAST_BUCKETS, CELLS = 1 << 15, 1 << 10, 1 << 22
ORDERS = 3
#: Labelled rows that the classifier is fitted on, about, at most.
FIT_ROWS = 20_000
#: Code points that are read at once.
PIECE = 1 << 18
SMOOTH = 0.5


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(texts: list[str | None], piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers in order, hashes) of all n-grams of the lower-cased texts, every run of other characters as one space, one more at each end.

    A pair for each order of n-grams and about `piece` code points; a text without a letter has no n-grams.
    """
    for a, b in B.in_batches(texts, piece):
        low = [(t or "").lower() for t in texts[a:b]]
        size = np.array([len(t) + 2 for t in low])
        start = np.cumsum(size) - size
        cp = code_points(" " + "  ".join(low) + " ")
        is_letter = letters()[cp]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[start] = np.add.reduceat(is_letter, start, dtype=np.int64) > 0
        of = np.repeat(np.arange(a, b, dtype=np.int32), size)[keep]
        cp = np.where(is_letter, cp, np.uint32(32))[keep].astype(np.uint64)
        for x in range(0, len(cp), piece):
            seen = min(x, ORDERS - 1)  # code points of the piece before
            part, doc = cp[x - seen : x + piece], of[x - seen : x + piece]
            h = np.zeros(len(part), np.uint64)
            for n in range(1, min(ORDERS, len(part)) + 1):
                h = (h[: len(part) - n + 1] + part[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                whole = doc[: len(h)] == doc[n - 1 :]
                whole[: max(0, seen - n + 1)] = False
                yield doc[: len(h)][whole], h[whole]


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    prior: np.ndarray


def fit(docs: DataFrame, most: int = FIT_ROWS) -> Model:
    """docs: key, text, lang. Counts are made in tasks; the driver gets at most CELLS or LEAST_BUCKETS rows a language."""
    rows = docs.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("key", "text").alias("row"))
    rows = B.written(B.sampled(rows, F.col("row"), most).dropDuplicates(["lang", "row"]).select("text", "lang"), "languages")
    langs = sorted(r["lang"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # as many as the sample has rows, at most
    buckets = BUCKETS
    while buckets > LEAST_BUCKETS and buckets * len(langs) > CELLS:
        buckets //= 2

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                total, seen = np.zeros(buckets, np.int64), set()
                for of, h in hashed(own["text"].tolist()):
                    seen.update(np.unique(of).tolist())
                    total += np.bincount((h & np.uint64(buckets - 1)).view(np.int64), minlength=buckets)
                hit = np.nonzero(total)[0]
                yield pd.DataFrame({"lang": lang, "bucket": np.append(hit, -1), "n": np.append(total[hit], len(seen))})

    got = rows.mapInPandas(counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((buckets + 1, len(langs)))
    n[got["bucket"].to_numpy(), np.searchsorted(langs, got["lang"].to_numpy().astype(str)) if langs else []] = got["n"].to_numpy()
    docs_of, n = n[-1], n[:-1] + SMOOTH
    return Model(langs, np.log(n / n.sum(axis=0)).astype(np.float32), np.log((docs_of + SMOOTH) / (docs_of + SMOOTH).sum()) if langs else docs_of)


def scored(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its probability of each text."""
    total = np.repeat(model.prior[None, :].astype(float), len(texts), axis=0)
    known = np.zeros(len(texts), bool)
    buckets, wide = model.logp.shape[0], max(1, len(model.langs))
    for of, h in hashed(texts, max(64, PIECE // wide)) if model.langs else ():
        if len(of):
            starts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1])
            rows = model.logp.take((h & np.uint64(buckets - 1)).view(np.int64), axis=0)
            total[of[starts]] += np.add.reduceat(rows, starts, axis=0, dtype=float)
            known[of[starts]] = True
    if not known.any():
        return ["und"] * len(texts), np.zeros(len(texts))
    best = total.argmax(axis=1)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    score = np.where(known, 1.0 / p.sum(axis=1), 0.0)
    return [model.langs[k] if x else "und" for k, x in zip(best, known, strict=True)], score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a text column, and lang_pred, score beside its other columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> dict[str, pa.Array]:
        langs, score = scored(shared.value, texts)
        return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64())}

    return B.with_results(docs, "text", "lang_pred string, score double", lambda: work, 4 * PIECE)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; crc32(doc_id) mod 4 = 2 is held out from learning."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", B.held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    model = fit(docs.where(~F.col("held_out")).select(F.col("doc_id").alias("key"), "text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), model)
