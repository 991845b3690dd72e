import random

import pytest

from meshwright.llm import jaccard


def brute(docs, words, num, den):
    def grams(text):
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets, parent = [grams(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * (k := len(a & b)) >= num * (len(a) + len(b) - k):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: (len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(docs)}


#: Small tiles make blocks of most tiles; thresholds near the copies' own similarity make proposals fail.
@pytest.mark.parametrize(("tile", "num", "words", "edits"), [(8192, 90, 3, 0.02), (6, 90, 3, 0.03), (4, 80, 2, 0.08), (3, 70, 1, 0.1)])
def test_equals_brute_force(spark, monkeypatch, tile, num, words, edits):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(tile)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 60)) for _ in range(rng.randint(20, 160))) for _ in range(4)]
    docs = []
    for d in range(110):
        w = [x if rng.random() > edits * rng.random() * 2 else f"z{rng.randint(0, 9)}" for x in rng.choice(base).split()]
        docs.append((d * 7 % 997, " ".join(w)))
    docs += [(5000, ""), (5001, None), (5002, "a b"), (5003, "A  b"), (5004, docs[0][1]), (5005, "a b c d e " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, words, (num, 100)).collect()}
    assert got == brute(docs, words, num, 100)


def test_bitmap_bounds_difference():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, 20).astype(np.uint64)]))
        x, y = jaccard.bitmap(a).tobytes(), jaccard.bitmap(b).tobytes()
        assert jaccard._pair_differs(x, y) <= len(np.setxor1d(a, b))


def test_stage_keeps_one_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(4, long), (9, long + " tail"), (6, "other text of its own entirely"), (None, long), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string")
    kept = jaccard.near_distinct(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "6", "7", "8"]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
    assert jaccard.near_distinct(docs.limit(0)).count() == 0


def test_stage_with_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(200)) for p in "abc")
    rows = [(1, a), (1, a), (5, a + " tail"), (5, b), (None, b + " tail"), (None, c), (None, c + " tail"), (9, None), (9, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _id int")
    kept = jaccard.near_distinct(docs).collect()
    # one of each group, whatever shares an id with it; texts without words all stay
    assert sorted((str(r.doc_id), (r.text or "")[:2]) for r in kept) == sorted([("1", "a0"), ("5", "b0"), ("None", "c0"), ("9", ""), ("9", ""), ("None", ""), ("None", "")])


def test_query(same_rows):
    same_rows("op9_ngram_jaccard")
