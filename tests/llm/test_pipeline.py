import random
from collections import Counter, defaultdict

import pytest
from test_mixing import M
from test_near_dedup import brute as near_classes
from test_near_dedup import corpus
from test_secrets import brute as base_spans

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _sum int, _i int, _s int, _h int, _hash int, copies int, rank int"
CLASHING = (2, 3, 4, 5, 6, 7)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with toxic texts, copies, near copies, secrets, nulls and extra columns of clashing names; labels."""
    rng, where = random.Random(8), str(tmp_path_factory.mktemp("corpus"))
    docs, labels = [], []
    for i, t in corpus(5, 150):
        toxic = i % 7 == 0
        words = t.split()
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["idiot", "moron"]))
        if i % 11 == 0:
            words.insert(1, f'token = "{rng.getrandbits(160):040x}"')
        text = " ".join(words)
        docs.append((i, text, "en", f"s{i % 4}" if i % 5 else None, len(text), "x", 1, *CLASHING))
        labels.append((i, 1, int(toxic)))
    docs += [(910 + i, "very " * 30_000 + f"long {i}", "en", "s2", 150_006, "x", 1, *CLASHING) for i in range(2)]  # a very long text and its near copy
    docs += [(900, *[None] * 12), (901, "", "en", "s1", 0, "x", 1, *CLASHING), (docs[5][0], *docs[5][1:])]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_against_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, steps = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append(docs.collect())
        assert k == 4 or docs.columns == columns
    start, clean, unique, masked, mixed, packed = steps

    assert {r["doc_id"] for r in start} - {r["doc_id"] for r in clean} == {r["doc_id"] for r in start if r["text"] and ("idiot" in r["text"] or "moron" in r["text"])}

    classes = near_classes([(r["doc_id"], r["text"]) for r in clean])
    assert Counter(r["doc_id"] for r in unique) == Counter(set(classes.values()))
    assert {r["doc_id"]: r["text"] for r in unique}.items() <= {r["doc_id"]: r["text"] for r in clean}.items()

    now = {r["doc_id"]: r for r in masked}
    assert len(now) == len(unique) == len(masked)
    for r in unique:
        text, spans = r["text"], base_spans(r["text"])
        if text and spans:
            out, at = "", 0
            for a, _, b in spans:
                if a >= at:
                    out += text[at:a] + "<SECRET>"
                at = max(at, b)
            assert now[r["doc_id"]]["text"] == out + text[at:] and now[r["doc_id"]]["n_chars"] == len(out + text[at:])
        else:
            assert now[r["doc_id"]] == r

    sizes, taken, times = defaultdict(int), defaultdict(int), Counter(r["doc_id"] for r in mixed)
    for r in masked:
        n = len((r["text"] or "").split())
        sizes[r["source"]] += n
        taken[r["source"]] += times[r["doc_id"]] * n
        assert times[r["doc_id"]] <= 2 and (n or times[r["doc_id"]] == 1)
    names = sorted(s for s in sizes if s is not None) + [None]
    for name, target in zip(names, M.targets([sizes[n] for n in names]), strict=True):
        assert abs(taken[name] - target) <= 0.5 * max(len((r["text"] or "").split()) for r in masked) + 4 * M.BLOCK

    words = Counter()
    for r in packed:
        words[r["doc_id"]] += r["length"]
    want = Counter()
    for r in mixed:
        want[r["doc_id"]] += len((r["text"] or "").split())
    assert words == want


def test_run_equals_its_stages(spark, tables):
    assert P.run(spark, tables).count() > 50


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_one_of_each_keeps_a_row_of_every_text_class(spark, tmp_path):
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    docs = [(1, a), (5, a), (5, b), (7, b), (7, b + " end"), (8, None)]
    got = P.one_of_each(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, a), (5, b), (8, None)]
