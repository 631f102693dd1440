"""Toxicity by a lexicon trie intersected with Levenshtein automata, and context windows.

Lexicon: a few general insults, and what labelled texts teach: words, and stems with many
endings, that many different contexts of toxic texts hold and clean ones don't. (Contexts
are counted, not texts, so that copies of one text teach no more than the text.) Only
counts of words come to the driver, and only of the HEADS best that pass.

Misspellings: a term's length allows it up to two edits (a letter more, less or another, or
two neighbours swapped), a stem's within its own letters. A word that clean texts of the
sample hold is no misspelling, however near it is to a term. How many edits a term gets is
decided by halves of the sample: as many as clean texts of one half hold no words at that
distance which those of the other don't, to a rate of FUZZY_CLEAN. A term that gets none
this way is anchored, if words with its first letter pass: its edits leave that letter.

Matching: the trie and the Levenshtein automaton of each term are run together as one
deterministic automaton, made once on the driver by the subset construction, and broadcast
as its table (STATES rows at most). Tasks step all words of many texts through the table at
once; nearly all die after a few characters. Words are runs of letters and digits, with
single signs such as * or @ between them.

Context: a hit within quotation marks, or in a sentence with a word of reporting near it,
counts as quoted. Hits, exact or misspelled, quoted or not, feed a logistic regression with
a prior, fitted on the labelled sample, on its toxic texts with their hits misspelt and on
its clean ones with other words misspelt; a misspelt hit weighs no more than an exact one.

Defined results: a null or empty text has no hits and the score of such a text; repeated
rows each give a row, and teach once; a doc_id labelled twice counts as toxic if any label
says so; a very long text is read in parts cut at white space, and contexts reach over the
cuts; a word of more than LONGEST letters teaches nothing; extra columns are ignored; without
toxic labels the prior holds; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allotau.llm import _base as B
from allotau.llm.language_id import letters

#: Labelled texts that lexicon and weights are fitted on, at most.
FIT_ROWS = 12_000
#: General insults; fixed values.
INSULTS = ("clown", "disgusting", "dumbass", "idiot", "imbecile", "loser", "moron", "pathetic", "scumbag", "scum", "stupid", "trash", "vermin", "worthless")
#: Words of reporting; fixed values.
REPORTING = frozenset("said says saying called calls wrote writes quoted quote word words term terms phrase meaning".split())
QUOTES = "\"'“”„‟«»‘’‚‹›`"
#: Words of reporting are looked for among so many words before and after a hit, within its sentence; quotation marks within so many characters.
WORDS_BEFORE, WORDS_AFTER, WINDOW_CHARS = 6, 3, 80
SENTENCE = re.compile(r"[.!?]\s|\n")
STEM, WORD, LONGEST = 4, 3, 40
#: Words, and stems, that come to the driver, at most; states of the automaton, at most (beyond, terms get one edit less).
HEADS, STATES = 20_000, 150_000
#: A term needs so many contexts in toxic texts, and this share of them at most in clean ones.
CONTEXTS, CLEAN_SHARE = 4, 0.08
#: Edits by length of the term: (least length, edits). Share of clean texts that may hold a word at such a distance.
EDITS = ((10, 2), (4, 1), (0, 0))
FUZZY_CLEAN = 3e-4
#: Words of clean texts near terms that go to the tasks, at most, those of most texts first. In clean texts, one long word of so many is misspelt.
CLEAN_WORDS, MISSPELL_EVERY = 50_000, 7
#: Weight of a toxic text of the sample with its hits misspelt, beside the text itself.
PLANTED = 0.25
#: Share of the toxic texts that a learnt term is in, at least.
SUPPORT = 0.01
JOINERS = "*@$!"
FEATURES = ("exact", "misspelled", "quoted exact", "quoted misspelled")
#: Intercept and weights of the prior, and its widths: that of the intercept is small, so that many texts without hits don't outweigh a single hit.
PRIOR = np.array([-4.0, 7.0, 5.5, 1.0, 0.5])
PRIOR_WIDTH = np.array([0.3, 2.0, 2.0, 2.0, 2.0])
CHARS = 1 << 20
SPACE = re.compile(r"\s")


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # any ending may follow
    edits: int
    anchored: bool = False  # edits leave the first letter as it is


@dataclass
class Automaton:
    """State 0 is dead, 1 the start. kind: 0 no match, else 1 and the least edits, if the word ends here; matches: (edits, term) of all; final: whatever follows."""

    symbols: str
    table: np.ndarray
    kind: np.ndarray
    matches: list[tuple[tuple[int, int], ...]]
    final: np.ndarray


def automaton(terms: list[Term]) -> Automaton:
    """The union over terms of (trie path) x (Levenshtein automaton), made deterministic."""
    symbols = "".join(sorted({c for t in terms for c in t.text}))
    children: list[dict[str, int]] = [{}, {}]  # node 0 is the root; 1 that of the anchored terms, which no edit leaves
    ends: list[list[int]] = [[], []]
    most = [0, 0]  # edits that any term below a node allows
    for k, t in enumerate(terms):
        node = int(t.anchored)
        most[node] = max(most[node], t.edits)
        for c in t.text:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append([])
                most.append(0)
            node = children[node][c]
            most[node] = max(most[node], t.edits)
        ends[node].append(k)

    def closed(state: dict[int, int]) -> frozenset:
        """With letters of the term left out of the word; stems that are reached stay reached (as -1 - term)."""
        todo = [x for x in state.items() if not isinstance(x[0], tuple) and x[0] != 1]
        while todo:
            node, e = todo.pop()
            if node < 0:
                continue
            for k in ends[node]:
                if terms[k].stem and e <= terms[k].edits and state.get(-1 - k, 99) > e:
                    state[-1 - k] = e
            for child in children[node].values():
                if e + 1 <= most[child] and state.get(child, 99) > e + 1:
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(state.items())

    def step(state: frozenset, c: str) -> frozenset:
        new: dict = {}

        def reach(node: int, e: int) -> None:
            if e <= (most[node] if node >= 0 else 9) and new.get(node, 99) > e:
                new[node] = e

        for node, e in state:
            if isinstance(node, tuple):  # the second of two swapped letters must be this one
                if node[1] == c:
                    reach(node[0], e)
                continue
            if node < 0:
                reach(node, e)
                continue
            if node == 1:
                if c in children[1]:
                    reach(children[1][c], e)
                continue
            reach(node, e + 1)  # a letter too many
            for x, child in children[node].items():
                reach(child, e + (x != c))
                behind = children[child].get(c)
                if behind is not None and x != c and e + 1 <= most[behind] and new.get((behind, x), 99) > e + 1:
                    new[behind, x] = e + 1
        return closed(new)

    start = closed({0: 0, 1: 0})
    number = {frozenset(): 0, start: 1}
    rows: list[list[int]] = [[0] * (len(symbols) + 1)]
    order = [start]
    column = {c: i for i, c in enumerate(symbols)}

    def to(state: frozenset, c: str) -> int:
        nxt = step(state, c)
        if nxt not in number:
            number[nxt] = len(number)
            order.append(nxt)
        return number[nxt]

    for state in order:
        row = [to(state, "")] * (len(symbols) + 1)  # a letter that no way on has
        nodes = [node for node, _ in state if not isinstance(node, tuple) and node >= 0]
        # letters on the way, the next but one for a swap, and the one that a swap waits for
        ways = {c for node in nodes for c in children[node]} | {c for node in nodes for child in children[node].values() for c in children[child]}
        for c in sorted(ways | {node[1] for node, _ in state if isinstance(node, tuple)}):
            row[column[c]] = to(state, c)
        rows.append(row)
        if len(rows) > STATES and max(most) > 1:
            return automaton([replace(t, edits=min(t.edits, max(most) - 1)) for t in terms])
    kind, final = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
    matches: list[tuple[tuple[int, int], ...]] = [()] * len(rows)
    for state, i in number.items():
        at = [(node, e) for node, e in state if not isinstance(node, tuple)]
        hits = [(e, -1 - node) for node, e in at if node < 0]
        final[i] = any(e == 0 for e, _ in hits)
        hits += [(e, k) for node, e in at if node >= 0 for k in ends[node] if e <= terms[k].edits]
        if hits:
            matches[i] = tuple(sorted(hits))
            kind[i] = 1 + matches[i][0][0]
    return Automaton(symbols, np.array(rows, np.int32), kind, matches, final)


class Matcher:
    def __init__(self, a: Automaton, clean: frozenset[str] = frozenset()) -> None:
        self.a, self.clean = a, clean
        self.symbol = np.full(0x110000, len(a.symbols), np.int32)
        for i, c in enumerate(a.symbols):
            self.symbol[ord(c)] = i
        self.inside = letters().copy()
        self.inside[ord("0") : ord("9") + 1] = True
        self.joins = np.zeros(0x110000, bool)
        self.joins[[ord(c) for c in JOINERS]] = True

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, state) of the words of lower-case text that the automaton takes."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = self.inside[cp]
        if len(cp) > 2:
            inside[1:-1] |= self.joins[cp[1:-1]] & inside[:-2] & inside[2:]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, size = edge[::2], edge[1::2] - edge[::2]
        state, live, i, found = np.ones(len(start), np.int32), np.arange(len(start)), 0, []
        while len(live):
            state = self.a.table[state, self.symbol[cp[start[live] + i]]]
            i += 1
            over = (size[live] == i) & (self.a.kind[state] > 0) | (self.a.final[state] > 0)
            found += [(int(w), int(s)) for w, s in zip(live[over], state[over], strict=True)]
            on = (state > 0) & (size[live] > i) & ~over
            live, state = live[on], state[on]
        hits = [(int(start[w]), int(start[w] + size[w]), s) for w, s in sorted(found)]
        return [(a, b, s) for a, b, s in hits if self.a.kind[s] == 1 or text[a:b] not in self.clean]


def is_quoted(text: str, start: int, end: int) -> bool:
    """Between two quotation marks of one line nearby, or in a sentence with a word of reporting near."""
    before, after = text[max(0, start - WINDOW_CHARS) : start], text[end : end + WINDOW_CHARS]
    left, right = before.rpartition("\n")[2], after.partition("\n")[0]
    opened = sum(left.count(q) for q in QUOTES if q != "'" and q != "’") % 2 == 1 or re.search(r"(^|\s)['‘][^'’]*$", left) is not None
    closes = any(q in right for q in QUOTES)
    near = re.findall(r"\w+", SENTENCE.split(before)[-1])[-WORDS_BEFORE:] + re.findall(r"\w+", SENTENCE.split(after)[0])[:WORDS_AFTER]
    return (opened and closes) or any(w in REPORTING for w in near)


def parts(text: str) -> Iterator[tuple[int, int]]:
    """Parts (from, to) of a long text, cut behind white space."""
    a = 0
    while a < len(text):
        gap = SPACE.search(text, a + CHARS)
        b = gap.end() if gap else len(text)
        yield a, b
        a = b


def count_hits(matcher: Matcher, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Hits of each text by FEATURES, and (text, start, end, state) of all."""
    n, found = np.zeros((len(texts), len(FEATURES))), []
    for a, b in B.in_batches(texts, CHARS):
        low = [(t or "").lower() for t in texts[a:b]]
        joined = "\n".join(low)  # a line's end separates words and contexts
        ends = np.cumsum([len(t) + 1 for t in low])
        for x, y in parts(joined):
            for start, end, state in matcher.hits(joined[x:y]):
                k = int(np.searchsorted(ends, start + x, side="right"))
                n[a + k, int(matcher.a.kind[state] > 1) + 2 * is_quoted(joined, start + x, end + x)] += 1
                begun = int(ends[k]) - len(low[k]) - 1
                found.append((a + k, start + x - begun, end + x - begun, state))
    return n, found


def inputs(counts: np.ndarray) -> np.ndarray:
    """1, and for each kind of hit 0 if there is none, else 1 and a little more for many."""
    return np.hstack([np.ones((len(counts), 1)), np.where(counts > 0, 1 + 0.3 * np.log(np.maximum(counts, 1)), 0.0)])


def chance(weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    x = inputs(counts)
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def fit_weights(counts: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression with a normal prior about PRIOR, by Newton's steps; row i counts times[i] times."""
    w, x = PRIOR.copy(), inputs(counts)
    times = np.ones(len(y)) if times is None else times
    for _ in range(30):
        p = chance(w, counts)
        slope = x.T @ (times * (p - y)) + (w - PRIOR) / PRIOR_WIDTH**2
        curve = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag(PRIOR_WIDTH**-2.0)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    w[1:] = np.maximum(w[1:], 0.0)
    w[[2, 4]] = np.minimum(w[[2, 4]], w[[1, 3]])
    return w


def learned_terms(sample: DataFrame) -> list[Term]:
    """sample (text, toxic) -> terms. Contexts of words are counted in Spark; only the HEADS prefixes and words with most toxic and few clean ones come back."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    empty = F.array(F.lit(""))
    trios = F.arrays_zip(F.col("w").alias("word"), F.concat(empty, F.col("w")).alias("before"), F.concat(F.slice("w", F.lit(2), F.size("w")), empty).alias("after"))
    seen = sample.select("toxic", words.alias("w")).where(F.size("w") > 0).select("toxic", F.explode(trios).alias("a"))
    seen = seen.where(F.length("a.word").between(WORD, LONGEST)).select("a.word", F.xxhash64("a.before", "a.after").alias("context"), "toxic").distinct()
    by_word = seen.groupBy("word").agg(F.sum("toxic").cast("long").alias("t"), F.sum(1 - F.col("toxic")).cast("long").alias("c"))
    by_word = B.written(by_word, "words")
    heads = F.transform(F.sequence(F.lit(STEM), F.greatest(F.lit(STEM), F.length("word"))), lambda k: F.substring(F.col("word"), F.lit(1), k))
    by_head = by_word.select(F.explode(heads).alias("head"), "word", "t", "c").where(F.length("head") >= STEM)
    by_head = by_head.groupBy("head").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("forms"), F.max(F.when(F.col("t") > 0, F.col("word"))).alias("form"))
    good = (F.col("t") >= CONTEXTS) & (F.col("c") <= CLEAN_SHARE * F.col("t"))
    best = {r["head"]: r for r in sorted(by_head.where(good).orderBy(F.desc("t"), "head").limit(HEADS).collect(), key=lambda r: r["head"])}
    whole = by_word.where(good).orderBy(F.desc("t"), "word").limit(HEADS).collect()
    longer_by: dict[str, list[str]] = {}
    for head in best:
        longer_by.setdefault(head[:-1], []).append(head)
    terms: dict[str, Term] = {}
    for head, r in best.items():
        if len(head) > STEM and head[:-1] in best:
            continue  # a shorter head stands for it
        longer = head
        while nxt := [h for h in longer_by.get(longer, ()) if best[h]["t"] >= 0.98 * r["t"]]:
            longer = nxt[0]  # as long as what the toxic texts have in common goes
        if best[longer]["forms"] == 1:
            longer = best[longer]["form"]
        terms[longer] = Term(longer, best[longer]["forms"] > 1 if longer in best else False, 0)
    stems = {t.text for t in terms.values() if t.stem}
    for r in whole:
        if not any(r["word"][:k] in stems for k in range(STEM, len(r["word"]) + 1)):
            terms.setdefault(r["word"], Term(r["word"], False, 0))
    return list(terms.values())


@dataclass
class Model:
    terms: list[Term]
    automaton: Automaton
    weights: np.ndarray
    clean: frozenset[str]


def misspelt(text: str, words: list[tuple[int, int]]) -> str:
    """Lower-case text with one letter of each of the words (from, to) changed or left out."""
    low = text.lower()
    for start, end in sorted(words, reverse=True):
        at = start + 1 + (start + end) % max(1, min(end - start, STEM) - 1)
        low = low[:at] + "x" * (start % 2) + low[at + 1 :]
    return low


def seen_in(sample: DataFrame, terms: list[Term], clean: frozenset[str] = frozenset()) -> tuple[Automaton, DataFrame]:
    """Automaton of the terms; a row for each text of the sample: toxic, planted, half (0 or 1), n (counts by FEATURES), hits (4 * term + edits), and of clean texts the words (hit, word) that aren't exact.

    Planted rows are texts that are misspelt: toxic ones in their exact hits, clean ones in some of their long words.
    """
    made = automaton(terms)
    shared = sample.sparkSession.sparkContext.broadcast((made, clean))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(*shared.value)
        for pdf in batches:
            texts, toxic = pdf["text"].tolist(), pdf["toxic"].to_numpy()
            n, found = count_hits(matcher, texts)
            hits: list[set[int]] = [set() for _ in n]
            near: list[set[tuple[int, str]]] = [set() for _ in n]
            exact: dict[int, list[tuple[int, int]]] = {}
            for of, start, end, state in found:
                hits[of].update(term * 4 + e for e, term in matcher.a.matches[state])
                if toxic[of] == 1 and matcher.a.kind[state] == 1:
                    exact.setdefault(of, []).append((start, end))
                if toxic[of] == 0 and matcher.a.kind[state] > 1:
                    word = texts[of].lower()[start:end]
                    near[of].update((term * 4 + e, word) for e, term in matcher.a.matches[state])
            words = [[{"hit": h, "word": w} for h, w in sorted(x)] for x in near]
            yield pd.DataFrame({"toxic": toxic, "planted": 0, "half": pdf["half"], "n": n.tolist(), "hits": [sorted(h) for h in hits], "words": words})
            fine = {of: [m.span() for m in re.finditer(r"\w{5,}", (texts[of] or "").lower())][::MISSPELL_EVERY] for of in np.flatnonzero(toxic == 0)}
            planted = exact | fine
            again, _ = count_hits(matcher, [misspelt(texts[of] or "", words) for of, words in planted.items()])
            for y in (0, 1):
                own = again[[toxic[of] == y for of in planted]] if planted else again
                own = own[own.sum(axis=1) > 0] if y else own
                if len(own):
                    yield pd.DataFrame({"toxic": y, "planted": 1, "half": 0, "n": own.tolist(), "hits": [[] for _ in own], "words": [[] for _ in own]})

    halves = sample.select("text", F.col("toxic").cast("int"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))
    return made, B.written(halves.mapInPandas(run, "toxic int, planted int, half int, n array<double>, hits array<int>, words array<struct<hit:int,word:string>>"), "hits")


def counted(seen: DataFrame) -> pd.DataFrame:
    """Texts by toxic, planted and n: a row for each kind of text."""
    return seen.groupBy("toxic", "planted", "n").agg(F.count(F.lit(1)).alias("texts")).orderBy("toxic", "planted", "n").toPandas()


def fit(sample: DataFrame) -> Model:
    """sample (text, toxic), of bounded size."""
    texts = {t.text: t for t in (Term(w, False, 0) for w in INSULTS)} | {t.text: t for t in learned_terms(sample)}
    ordered = [Term(t.text, t.stem, next(e for least, e in EDITS if len(t.text) >= least)) for _, t in sorted(texts.items())]
    made, seen = seen_in(sample, ordered)
    counts = counted(seen)
    own = counts["planted"] == 0
    toxic, clean = (int(counts.loc[own & (counts["toxic"] == y), "texts"].sum()) for y in (1, 0))
    held, fresh = np.zeros((2, len(ordered), 4)), np.zeros((2, len(ordered), 4))  # texts by toxic, term, edits; clean texts with a word that the other half doesn't hold: all such, and those with the term's first letter
    by_term = seen.select("toxic", F.explode("hits").alias("hit")).groupBy("toxic", "hit").agg(F.count(F.lit(1)).alias("texts")).toPandas()
    held[by_term["toxic"], by_term["hit"] // 4, by_term["hit"] % 4] = by_term["texts"]
    words = seen.select("half", F.explode("words").alias("w")).select("half", "w.hit", "w.word").groupBy("hit", "word").agg(F.count(F.lit(1)).alias("texts"), F.count_distinct("half").alias("halves"))
    words = B.written(words, "near")
    unseen = words.where("halves = 1").groupBy("hit", F.substring("word", 1, 1).alias("first")).agg(F.sum("texts").alias("texts")).toPandas()
    for hit, first, n in unseen.itertuples(index=False):
        fresh[: 1 + (first == ordered[hit // 4].text[0]), hit // 4, hit % 4] += n
    # a term that clean texts hold about as often as toxic ones says nothing; nor does a learnt term of very few toxic texts
    rates = held / np.maximum(1, np.array([clean, toxic]))[:, None, None]
    least = max(3.0, SUPPORT * toxic)
    keep, used = [], []
    for i, t in enumerate(ordered):
        if held[0, i, 0] >= 3 and rates[1, i, 0] < 4 * rates[0, i, 0] or t.text not in INSULTS and held[1, i, 0] < least:
            continue
        free, anchored = (sum(1 for e in range(1, t.edits + 1) if one[i, 1 : 1 + e].sum() <= FUZZY_CLEAN * clean) for one in fresh)
        edits = free or anchored
        keep.append(Term(t.text, t.stem, edits, free == 0 < anchored))
        used += [4 * i + e for e in range(1, edits + 1)]
    known = words.where(F.col("hit").isin(used)).groupBy("word").agg(F.sum("texts").alias("texts")).orderBy(F.desc("texts"), "word").limit(CLEAN_WORDS).collect() if used else []
    clean_words = frozenset(r["word"] for r in known)
    if keep != ordered or clean_words:
        made, seen = seen_in(sample, keep, clean_words)
        counts = counted(seen)
    n = np.array(counts["n"].tolist()).reshape(-1, len(FEATURES))
    times = counts["texts"].to_numpy(dtype=float) * np.where(counts["planted"] == 1, PLANTED, 1.0)
    return Model(keep, made, fit_weights(n, (counts["toxic"].to_numpy() == 1).astype(float), times), clean_words)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> text, toxic of about `most` labelled documents, at the most."""
    one = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = docs.join(F.broadcast(B.sampled(one, F.col("doc_id"), most)), "doc_id")  # `most` rows are broadcast
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")  # an id that comes often counts once


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, learnable: Column) -> Model:
    sample = labelled_sample(docs.select("doc_id", "text").where(learnable), labels.where(learnable))
    return fit(B.written(sample, "labelled"))


def score_of(text: Column, model: Model, spark: SparkSession) -> Column:
    """Probability that the text is toxic."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value.automaton, shared.value.clean)
        for texts in batches:
            yield pd.Series(chance(shared.value.weights, count_hits(matcher, texts.tolist())[0]))

    return score(text)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; crc32(doc_id) mod 5 = 0 is held out from learning."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = B.held_out(F.col("doc_id"), 5, 0)
    model = learn(spark, docs, B.table(spark, sf_dir, "labels"), ~held)
    got = docs.select("doc_id", held.alias("held_out"), score_of(F.col("text"), model, spark).alias("score"))
    return got.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
