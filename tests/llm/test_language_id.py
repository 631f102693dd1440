import numpy as np
import pytest

from allotau.llm import language_id as L


def table(spark, data):
    return spark.createDataFrame(data, "key long, text string, lang string")


TEXTS = {"aa": "the quick brown fox with the thing and that ", "bb": "le petit renard brun des choses et cela ñ "}


def brute_counts(text):
    """n-grams of letters, with other characters as single spaces, by plain loops."""
    low, out = f" {text.lower()} ", []
    for c in low:
        c = c if c.isalpha() else " "
        if not (c == " " and out and out[-1] == " "):
            out.append(c)
    return ["".join(out[i : i + n]) for n in range(1, L.ORDERS + 1) for i in range(len(out) - n + 1)]


def hashes(text):
    return np.concatenate([h for _, h in L.hashed([text])])


def test_ngrams_equal_a_plain_loop():
    for text in ("Ab  c!", "x", "Éa-b\n", "a" * 50 + " . ! b", " . a"):
        grams = brute_counts(text)
        h = hashes(text)
        assert len(h) == len(grams)
        pairs = dict(zip(grams, h.tolist(), strict=True))
        assert [pairs[g] for g in grams] == h.tolist()


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 7, 1000])
def test_pieces_change_nothing(piece):
    texts = [None, "Ab  c!", "", "12", "x", "Éa-b\n", "a" * 20 + " . ! b", "abcdefg", " . ! a . . b!!"]
    whole, cut = {}, {}
    for out, size in ((whole, 1 << 20), (cut, piece)):
        for of, h in L.hashed(texts, size):
            for i, x in zip(of.tolist(), h.tolist(), strict=True):
                out.setdefault(i, []).append(x)
    assert {i: sorted(x) for i, x in whole.items()} == {i: sorted(x) for i, x in cut.items()}
    assert whole.keys() == {1, 4, 5, 6, 7, 8}


def test_batches_change_nothing(spark):
    model = L.fit(table(spark, [(i, t, k) for i, (k, t) in enumerate(TEXTS.items())]))
    texts = ["that renard", None, "7", "the thing", "des choses " * 40, "x"]
    langs, score = L.scored(model, texts)
    for t, lang, s in zip(texts, langs, score, strict=True):
        assert L.scored(model, [t])[0] == [lang] and L.scored(model, [t])[1][0] == s


def test_more_languages_than_the_matrix_has_room_for(spark, monkeypatch):
    monkeypatch.setattr(L, "CELLS", 1 << 13)
    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 5} q{chr(97 + i // 26)}", f"l{i:03}") for i in range(300)]
    model = L.fit(table(spark, rows))
    assert model.logp.shape == (L.LEAST_BUCKETS, 300)
    langs, _ = L.scored(model, [t for _, t, _ in rows])
    assert sum(a == b for a, (_, _, b) in zip(langs, rows, strict=True)) > 250


def test_one_id_that_fills_the_table_leaves_the_sample_bounded(spark):
    rows = [(None if i % 3 else 5, TEXTS["aa"] + str(i % 40), "aa") for i in range(3000)] + [(i, TEXTS["bb"] + str(i), "bb") for i in range(1500)]
    assert L.fit(table(spark, rows), 500).langs == ["aa", "bb"]


def test_ids_of_any_size_beside_a_null(spark):
    model = L.fit(table(spark, [(1, TEXTS["aa"], "aa")]))
    df = spark.createDataFrame([(None, "the"), ((1 << 60) + 1, None), ((1 << 60) + 2, "fox")], "doc_id long, text string").coalesce(1)
    assert [(r["doc_id"], r["lang_pred"]) for r in L.predict(df, model).collect()] == [(None, "aa"), ((1 << 60) + 1, "und"), ((1 << 60) + 2, "aa")]


def test_scores_equal_bayes_by_hand(spark):
    docs = table(spark, [(10 * j + i, t * 2, k) for i, (k, t) in enumerate(TEXTS.items()) for j in range(3)])
    model = L.fit(docs)
    assert model.langs == ["aa", "bb"]
    counts = {k: np.bincount((hashes(t * 2) % np.uint64(L.BUCKETS)).astype(int), minlength=L.BUCKETS) * 3 + L.SMOOTH for k, t in TEXTS.items()}
    text = "that renard thing"
    logs = [np.log(c / c.sum())[(hashes(text) % np.uint64(L.BUCKETS)).astype(int)].sum() + np.log(0.5) for c in counts.values()]
    (lang,), (score,) = L.scored(model, [text])
    p = np.exp(np.array(logs) - max(logs))
    assert lang == ["aa", "bb"][int(np.argmax(logs))] and score == pytest.approx(p.max() / p.sum(), rel=1e-3)


def test_edges(spark):
    docs = table(spark, [(1, TEXTS["aa"], "aa"), (2, TEXTS["bb"], "bb"), (3, "xx", None), (None, None, "aa")])
    model = L.fit(docs)
    ask = [(1, None), (1, ""), (2, "123 !?"), (3, "the thing"), (3, "the thing"), (None, "des choses " * 200_000)]
    asked = spark.createDataFrame([(*a, "x") for a in ask], "doc_id long, text string, lang_prediction string")
    got = L.predict(asked, model).collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "aa", "aa", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert L.predict(asked.limit(0), model).count() == 0
    nothing = L.fit(docs.limit(0))
    assert L.scored(nothing, ["the"])[0] == ["und"] and L.scored(nothing, ["the"])[1].tolist() == [0.0]


def test_held_out_accuracy(spark):
    from conftest import SF

    got = L.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert held.count() > 10 and held.where("lang_pred = lang").count() >= 0.9 * held.count()


def test_columns_of_the_results_names_give_way(spark):
    model = L.fit(spark.createDataFrame([(1, "the house and the sea", "en"), (2, "das Haus und das Meer", "de")], "key long, text string, lang string"))
    docs = spark.createDataFrame([(7, "the sea", "x", 9.0), (None, None, None, None)], "doc_id long, text string, Lang_pred string, score double")
    got = L.predict(docs, model)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    assert {(r["doc_id"], r["lang_pred"]) for r in got.collect()} == {(7, "en"), (None, "und")}
