"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer.

Two deterministic transducers stand one behind the other. The first reads character
classes and emits where pretokens begin; it needs one character of delay (`'r` may become
`'re`, and the last of several white spaces goes to what follows). Text is cut into chunks
of CHUNK characters, wherever that falls; each chunk's map from every state to the state
behind it is computed for all chunks at once, the maps are composed by a parallel prefix
scan in log2(chunks) steps, and the states before the chunks then give the emissions.

The second reads the bytes of a pretoken. Its transitions carry by how much the number of
tokens changes, so a count is a sum along the path. By BPE's locality, the tokens of a
prefix are those of an earlier prefix and one more token that goes with the last of them,
and two tokens go together unless a merge would join them across their border before
either has grown. So the state is the longest suffix that may go on to become a token, with
the last token and the relative count of each prefix that ends within it: finitely many.
States are compiled as texts ask for them, and forgotten when there are MOST_STEPS
transitions. A pretoken starts in the first state, so its chunk map is a single count;
those of short ones are kept.

Defined results: a null text is empty and has 0 bytes and 0 tokens; added tokens of the
vocabulary (`<|endoftext|>`) inside texts count as one, as the library has it by default;
very long texts and pretokens are read in linear time; repeated rows and null ids stay
rows of their own; extra columns, whatever their names, are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allotau.llm import _base as B

LIMIT = 1024
#: Characters of a chunk whose state map is composed with the others', and of a batch of texts.
CHUNK, BATCH = 128, 1 << 20
#: Transitions and pretoken counts a task holds at the most; pretokens cut out at once; length of those that are kept.
MOST_STEPS, MOST_KEPT, AT_ONCE, SHORT = 2_000_000, 500_000, 100_000, 32

# Classes of characters: letters, numbers, others, apostrophe, space, other white space, the letters of 's 't 're 've 'm 'll 'd, end of a text.
LETTER, NUMBER, OTHER, QUOTE, SPACE, WHITE, ONE, R, V, L, E, END = range(12)
LETTERS = (LETTER, ONE, R, V, L, E)
# States: before a text; within letters, numbers, others; behind an apostrophe that begins a pretoken, and behind its r, v, l; behind a whole contraction; behind one space, two or more white spaces of which the last is a space or isn't, one other white space.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CONTRACTED, SPACED, RUN_SPACE, RUN_WHITE, ONE_WHITE = range(13)
STATES = 13
#: Emissions: a pretoken begins here, and at the character before.
HERE, BEFORE = 1, 2


def boundary_table() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by class * 16 + state."""
    begins = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: QUOTED, SPACE: SPACED, WHITE: ONE_WHITE, END: FRESH} | dict.fromkeys(LETTERS, IN_LETTERS)
    runs = {SPACE: RUN_SPACE, WHITE: RUN_WHITE}
    words = dict.fromkeys(LETTERS, IN_LETTERS)
    others = {OTHER: IN_OTHERS, QUOTE: IN_OTHERS}
    goes_on = {
        IN_LETTERS: words,
        IN_NUMBERS: {NUMBER: IN_NUMBERS},
        IN_OTHERS: others,
        QUOTED: others | {ONE: CONTRACTED, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L},
        QUOTED_R: {E: CONTRACTED},
        QUOTED_V: {E: CONTRACTED},
        QUOTED_L: {L: CONTRACTED},
        SPACED: words | others | runs | {NUMBER: IN_NUMBERS},
        RUN_SPACE: runs,
        RUN_WHITE: runs,
        ONE_WHITE: runs,
    }
    after, emits = np.zeros(12 * 16, np.uint8), np.zeros(12 * 16, np.uint8)
    for state in range(STATES):
        for cls in range(12):
            if cls in goes_on.get(state, {}):
                to, out = goes_on[state][cls], 0
            elif state in (QUOTED_R, QUOTED_V, QUOTED_L):  # no contraction: the letter begins a word
                to, out = (IN_LETTERS, BEFORE) if cls in LETTERS else (begins[cls], BEFORE | HERE)
            elif state == RUN_SPACE and cls != END:  # the last space goes to what follows
                to, out = goes_on[SPACED][cls], BEFORE
            elif state == RUN_WHITE and cls != END:
                to, out = begins[cls], BEFORE | HERE
            else:
                to, out = begins[cls], HERE
            after[cls * 16 + state], emits[cls * 16 + state] = to, out
    return after, emits


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point; white space, letters and numbers as Unicode has them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    points = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    for pattern, cls in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for found in regex.finditer(pattern, every):
            out[points[found.start() : found.end()]] = cls
    for c, cls in {"'": QUOTE, " ": SPACE, "s": ONE, "t": ONE, "m": ONE, "d": ONE, "r": R, "v": V, "l": L, "e": E}.items():
        out[ord(c)] = cls
    return out


def composed(maps: np.ndarray) -> np.ndarray:
    """maps (chunks, states) of states to states -> for each chunk the map of all chunks up to it, by doubling."""
    ahead = 1
    while ahead < len(maps):
        maps = np.concatenate([maps[:ahead], np.take_along_axis(maps[ahead:], maps[:-ahead], 1)])
        ahead *= 2
    return maps


def pretoken_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions at which pretokens, or ends of texts, stand. The last class must be END."""
    after, emits = boundary_table()
    chunks = -(-len(classes) // chunk)
    grid = np.full(chunks * chunk, END, np.intp)
    grid[: len(classes)] = classes
    columns = np.ascontiguousarray(grid.reshape(chunks, chunk).T) * 16
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for column in columns:
        maps = after.take(column[:, None] + maps)
    state = np.concatenate([[FRESH], composed(maps)[:-1, FRESH]]).astype(np.uint8)
    out = np.empty((chunk, chunks), np.uint8)
    for i, column in enumerate(columns):
        at = column + state
        out[i], state = emits.take(at), after.take(at)
    emitted = out.T.reshape(-1)[: len(classes)]
    begins = (emitted & HERE) > 0
    begins[:-1] |= (emitted[1:] & BEFORE) > 0
    return np.flatnonzero(begins)


def byte_chars() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones of Latin-1 stand for themselves, others for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The transducer over bytes, compiled as it is used."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        as_bytes = byte_chars()
        self.rank, self.parts = {}, {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key, whole = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            self.rank[key] = rank
            self.parts.setdefault(whole, (*key, rank))
        self.child, self.token, self.depth, self.inner = {}, [-1], [0], [False]
        for word, token in vocabulary.items():
            if (len(word) == 1 or token in self.parts) and all(c in as_bytes for c in word):
                self.add([as_bytes[c] for c in word], token)
        self.link()
        self.goes: dict[tuple[int, int], bool] = {}
        self.forget()

    def add(self, word: list[int], token: int) -> None:
        node = 0
        for b in word:
            key = node << 8 | b
            self.inner[node] = True
            if key not in self.child:
                self.child[key] = len(self.token)
                self.token.append(-1)
                self.depth.append(self.depth[node] + 1)
                self.inner.append(False)
            node = self.child[key]
        self.token[node] = token

    def link(self) -> None:
        """Of each node of the trie: the node of its longest proper suffix, and of its longest proper suffix that is a token."""
        self.suffix, self.shorter = [0] * len(self.token), [0] * len(self.token)
        for key, node in sorted(self.child.items(), key=lambda x: self.depth[x[1]]):
            parent, b = key >> 8, key & 255
            if parent:
                back = self.follow(self.suffix[parent], b)
                self.suffix[node] = back
                self.shorter[node] = back if self.token[back] >= 0 else self.shorter[back]

    def follow(self, node: int, b: int) -> int:
        while (to := self.child.get(node << 8 | b)) is None:
            if not node:
                return 0
            node = self.suffix[node]
        return to

    def together(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a, b as they are next to each other.

        On its way to a, the right edge is a, a's right part, that one's right part, ...,
        each until the merge that made the one before; likewise b's left edge. A merge of
        two edges comes first if its rank is below those ends; of equal merges the left
        one is made first.
        """
        if (known := self.goes.get((a, b))) is not None:
            return known
        never = len(self.rank) + 1
        out, x, x_end = True, a, never
        while out:
            y, y_end = b, never
            while True:
                rank = self.rank.get((x, y))
                if rank is not None and rank < x_end and rank <= y_end:
                    out = False
                    break
                if y not in self.parts:
                    break
                y, _, y_end = self.parts[y]
            if x not in self.parts:
                break
            _, x, x_end = self.parts[x]
        if len(self.goes) > MOST_STEPS:
            self.goes.clear()
        self.goes[a, b] = out
        return out

    def forget(self) -> None:
        # a state: node of the trie, then for each prefix that ends within the node's text, from the earliest on, its last token (-1: none, at the start) and its count beyond the present one
        self.states = [(0, (-1,), (0,))]
        self.number = {self.states[0]: 0}
        self.step: dict[int, int] = {}

    def compiled(self, state: int, b: int) -> int:
        """The transition: next state * 65,536 + 32,768 + change of the count."""
        node, last, count = self.states[state]
        node = self.follow(node, b)
        at = node
        if self.token[at] < 0:
            at = self.shorter[at]
        while True:
            token, before = self.token[at], len(last) - self.depth[at]
            if last[before] < 0 or self.together(last[before], token):
                break
            at = self.shorter[at]
        change = count[before] + 1
        while node and not self.inner[node]:
            node = self.suffix[node]
        keep = self.depth[node]
        last = (*last, token)[len(last) - keep :]
        count = tuple(c - change for c in (*count, change)[len(count) - keep :])
        key = (node, last, count)
        to = self.number.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        out = self.step[state << 8 | b] = to << 16 | 32_768 + change
        return out

    def count(self, data: bytes) -> int:
        """Tokens of one pretoken."""
        if len(self.step) > MOST_STEPS:
            self.forget()
        state = n = 0
        step = self.step
        for b in data:
            got = step.get(state << 8 | b)
            if got is None:
                got = self.compiled(state, b)
            n += (got & 65_535) - 32_768
            state = got >> 16
        return n


class Counter:
    """Token counts of texts by a byte-level BPE vocabulary, given as the text of its JSON file."""

    def __init__(self, vocabulary: str):
        told = json.loads(vocabulary)
        model, splits = told["model"], told["pre_tokenizer"] or {}
        plain = not (model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
        if model["type"] != "BPE" or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex", True) or told["normalizer"] or not plain:
            raise ValueError("not a plain byte-level BPE vocabulary")
        added = told["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens with conditions aren't supported")
        names = sorted((t["content"] for t in added if t["content"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.merges = Merges(model["vocab"], model["merges"])
        self.kept: dict[str, int] = {}

    def segments(self, texts: list[str | None]) -> tuple[list[str], list[int], list[int]]:
        """Parts of the texts between added tokens, the text of each, and how many added tokens each text has."""
        parts, owners, n_added = [], [], []
        for i, text in enumerate(texts):
            cut = self.added.split(text) if text and self.added and self.added.search(text) else [text or ""]
            parts += cut
            owners += [i] * len(cut)
            n_added.append(len(cut) - 1)
        return parts, owners, n_added

    def of_piece(self, piece: str) -> int:
        n = self.merges.count(piece.encode())
        if len(piece) <= SHORT:
            if len(self.kept) >= MOST_KEPT:
                self.kept.clear()
            self.kept[piece] = n
        return n

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        parts, owners, n_added = self.segments(texts)
        out = np.array(n_added, np.int64)
        if not parts:
            return out
        joined = "\n".join(parts) + "\n"
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = char_classes().take(np.frombuffer(joined.encode("utf-32-le"), np.uint32))
        classes[ends] = END
        starts = pretoken_starts(classes)
        real = classes[starts] != END
        first, last = starts[real], np.append(starts[1:], len(joined))[real]
        whose = np.array(owners)[np.searchsorted(ends, first)] if len(first) else first
        known, of_piece = self.kept.get, self.of_piece
        for i in range(0, len(first), AT_ONCE):
            a, b = first[i : i + AT_ONCE].tolist(), last[i : i + AT_ONCE].tolist()
            counts = [known(p) or of_piece(p) for p in (joined[x:y] for x, y in zip(a, b, strict=True))]
            out += np.bincount(whose[i : i + AT_ONCE], weights=counts, minlength=len(out)).astype(np.int64)
        return out


@lru_cache(4)
def counter(vocabulary: str) -> Counter:
    """Compiled once a Python worker."""
    return Counter(vocabulary)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_counts(docs: DataFrame, text: str, vocabulary: str, n_tokens: str = "n_tokens") -> DataFrame:
    """docs without its column `text`, and the number of its tokens; vocabulary is the text of the file, of known size, which goes to each task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        count = counter(shared.value)
        return lambda texts: {n_tokens: pa.array(count(texts))}

    return B.with_results(docs, text, f"`{n_tokens}` long", make, BATCH)


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def op12_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than 1,024 tokens) of every document."""
    import public_tokenizers

    docs = B.table(spark, sf_dir, "documents").select("doc_id", n_bytes(F.col("text")).alias("n_bytes"), "text")
    got = token_counts(docs, "text", read_vocabulary(path or public_tokenizers.path("byte_bpe_50k.json")))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
