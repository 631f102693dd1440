import numpy as np
import pytest

from allotau.llm import toxicity as X


def distance(a, b):
    """Edits, of which a swap of neighbours is one."""
    older, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
        older = old
    return row[-1]


TERMS = [X.Term("stupid", False, 1), X.Term("scum", False, 0), X.Term("clown", False, 1), X.Term("réeux", True, 0), X.Term("worthless", False, 2), X.Term("clownish", False, 1), X.Term("gredam", True, 1), X.Term("disgusting", False, 2), X.Term("moron", False, 1, True), X.Term("vermin", True, 2, True), X.Term("sstep", False, 1, True)]


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(3)
    m = X.Matcher(X.automaton(TERMS))
    letters = "abcdeghilmnoprstuwx1é"
    words = ["stupid", "stupd", "sstupid", "st1pid", "scum", "scumm", "clown", "clwn", "clowns", "clowni", "réeux", "réeuxment", "reeux", "worthlss", "wrthlss", "wothles", "clownis", "s", "noron", "omron", "oron", "xmoron", "mmoron", "mron", "vremin", "evrmin", "vvermins", "step", "ssstep"]
    for t in TERMS:
        for _ in range(150):
            w = list(t.text)
            for _ in range(rng.integers(0, 4)):
                at = rng.integers(0, len(w) + 1)
                if rng.integers(3) == 0:
                    w[at : at + 2] = w[at : at + 2][::-1]
                    continue
                w[at : at + rng.integers(0, 2)] = [letters[rng.integers(len(letters))]] * rng.integers(0, 2)
            words.append("".join(w))
    for w in filter(None, words):
        fits = []
        for t in TERMS:
            e = min(distance(w[:k], t.text) for k in range(len(w) + 1)) if t.stem else distance(w, t.text)
            if e <= t.edits and (e == 0 or not t.anchored or w[0] == t.text[0]):
                fits.append(e)
        got = m.hits(w)
        assert bool(got) == bool(fits), w
        if fits:
            assert got[0][:2] == (0, len(w)) and m.a.kind[got[0][2]] == 1 + min(fits), w
            assert sorted(e for e, _ in m.a.matches[got[0][2]])[0] == min(fits)


def test_positions_and_signs_inside_words():
    m = X.Matcher(X.automaton([X.Term("stupid", False, 1)]))
    assert [(a, b, m.a.kind[s]) for a, b, s in m.hits("a stupid, st*pid; *stupid* stupid2 xstupidx")] == [(2, 8, 1), (10, 16, 2), (19, 25, 1), (27, 34, 2)]
    assert m.hits("") == []


def test_quotation():
    for text, quoted in [('you idiot', False), ('he said idiot', True), ('the "idiot" here', True), ("an 'idiot' here", True), ('"ok" you idiot now', False), ("“idiot”", True), ("it's idiot, isn't it", False), ("he said you are an idiot", True), ("he said so. you are an idiot", False)]:
        at = text.index("idiot")
        assert X.is_quoted(text, at, at + 5) == quoted, text


def learnt(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("lo", "ri", "mat", "ke")]
    data = []
    for i in range(600):
        w = [words[k] for k in rng.integers(0, len(words), 40)]
        toxic = i % 6 == 0
        if toxic:
            w.insert(int(rng.integers(40)), ["grundle", "zorpak" + words[rng.integers(80)], "idiot"][i // 6 % 3])
        data.append((" ".join(w), int(toxic)))
    return X.fit(spark.createDataFrame(data, "text string, toxic int"))


def score(model, text):
    return float(X.chance(model.weights, X.count_hits(X.Matcher(model.automaton, model.clean), [text])[0])[0])


def test_learns_words_and_stems(spark):
    model = learnt(spark)
    terms = {t.text: t for t in model.terms}
    assert "grundle" in terms and not terms["grundle"].stem and terms["zorpak"].stem and "idiot" in terms
    assert score(model, "balo grundle beri") > 0.5 and score(model, "zorpakxyz") > 0.5 and score(model, "you grundl") > 0.5
    assert score(model, "balo beri") < 0.5 and score(model, None) == score(model, "") < 0.5
    assert score(model, 'he said "grundle" once') < score(model, "you grundle")


def test_learnt_terms_are_found_misspelt(spark):
    """Every single edit of a learnt word, and of a learnt stem, and two edits of a long word."""
    model = learnt(spark)
    assert {t.text: t.edits for t in model.terms}.items() >= {"grundle": 1, "zorpak": 1, "disgusting": 2}.items()
    for word, ending in (("grundle", ""), ("zorpak", "balo")):
        for i in range(len(word)):
            for typo in (word[:i] + word[i + 1 :], word[:i] + "x" + word[i + 1 :], word[:i] + "x" + word[i:]):
                assert score(model, f"balo {typo}{ending} beri") > 0.5, typo
    assert score(model, "so disgostin") > 0.5


def test_words_of_clean_texts_are_no_misspellings(spark):
    """What both halves of the clean texts hold is known; a term that new words keep coming near to gets no edits."""
    data = [(f"w{i} grundle v{i} lo ri", 1) for i in range(60)] + [(f"grandle trundle {i} ri lo", 0) for i in range(60)]
    model = X.fit(spark.createDataFrame(data, "text string, toxic int"))
    assert {t.text: t.edits for t in model.terms}["grundle"] == 1 and model.clean == {"grandle", "trundle"}
    assert score(model, "a grandle") < 0.5 < score(model, "a grundle") and score(model, "a grundel") > 0.5
    data = [(f"w{i} grundle v{i} lo ri", 1) for i in range(60)] + [(f"grun{chr(97 + i)}le {i} ri lo", 0) for i in range(26) if i != 3]
    model = X.fit(spark.createDataFrame(data, "text string, toxic int"))
    assert {t.text: t.edits for t in model.terms}["grundle"] == 0 and score(model, "a grunxle") < 0.5
    data = [(f"w{i} grundle v{i} lo ri", 1) for i in range(60)] + [(f"{chr(97 + i)}rundle {i} ri lo", 0) for i in range(26) if i != 6]
    model = X.fit(spark.createDataFrame(data, "text string, toxic int"))
    assert {t.text: (t.edits, t.anchored) for t in model.terms}["grundle"] == (1, True)
    assert score(model, "a 7rundle") < 0.5 < score(model, "a grunxle")


def test_a_misspelt_hit_weighs_no_more_than_an_exact_one(spark):
    model = learnt(spark)
    assert model.weights[2] <= model.weights[1] and model.weights[4] <= model.weights[3]
    for text, typo in (("idiot", "idi0t"), ("idiot", "idoit"), ("moron", "m0ron"), ("scum", "scvm")):
        assert 0.5 < score(model, f"you {typo}") <= score(model, f"you {text}"), typo


def test_cuts_of_long_texts_change_nothing(monkeypatch):
    m = X.Matcher(X.automaton(TERMS))
    texts = ['he said you are a "stupid clown" there. ' * 9 + "scum", "clown", None, "x" * 50 + " stupid", "stupd \n" * 20]
    n, found = X.count_hits(m, texts)
    monkeypatch.setattr(X, "CHARS", 7)
    got, again = X.count_hits(m, texts)
    assert got.tolist() == n.tolist() and sorted(found) == sorted(again)
    assert n.sum() == 18 + 1 + 1 + 1 + 20


def test_very_long_words_teach_nothing(spark):
    data = [("ab" * 50_000 + f" {i} grundle", 1) for i in range(30)] + [(f"fine {i}", 0) for i in range(30)]
    assert max(len(t.text) for t in X.fit(spark.createDataFrame(data, "text string, toxic int")).terms) <= X.LONGEST


def test_edges(spark):
    model = X.fit(spark.createDataFrame([], "text string, toxic int"))
    assert np.allclose(model.weights, X.PRIOR)
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, "idiot " * 300_000, 0.1), (3, "idiot", 0.1), (3, "idiot", 0.1), (None, "fine", 0.1)], "doc_id long, text string, score double")
    got = [r[0] for r in docs.select(X.score_of(F.col("text"), model, spark)).collect()]
    assert got[0] == got[1] == got[5] < 0.5 < got[3] == got[4] <= got[2] <= 1
    assert docs.limit(0).select(X.score_of(F.col("text"), model, spark)).count() == 0


def test_labels_twice_and_null(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert sorted(map(tuple, X.labelled_sample(docs, labels).collect())) == [("a", 1), ("c", 0)]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = X.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n = got.count()
    assert n > 50 and got.where("predicted = toxic").count() >= 0.93 * n
    assert got.where("score < 0 or score > 1").count() == 0
    assert pytest.approx(0.5, abs=0.5) == got.first()["score"]
