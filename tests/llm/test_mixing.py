import random

import pytest

from meshwright.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, copies int")


def corpus(n=900):
    rng = random.Random(1)
    return [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["b", "b", "b", "a", "c", None, "é"])) for i in range(n)]


def test_levels(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 40), ("z", 0)], "_source string, _size long")
    got, count = mixing.source_targets(sizes)
    target = {r._source: r.target for r in got.collect()}
    # a (weight 3), c (2) and null (1): the capped ones take twice their size, the rest shares by weight
    assert count == 5 and sum(target.values()) == pytest.approx(1.5 * 1150)
    assert target["a"] == 20 and target["z"] == 0 and target["b"] <= 200 and target[None] <= 80
    assert target["c"] == pytest.approx(1.5 * 1150 - target["a"] - target["b"] - target[None])


def test_mass_is_kept(spark):
    rows = corpus()
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    source, largest = {i: s for i, _, s in rows}, {}
    taken, target = {}, {}
    for r in got:
        s = source[r.doc_id]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        largest[s] = max(largest.get(s, 0), r.size)
    # at most one row of a source is rounded on its own
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in target)


def test_reruns_agree_and_seeds_differ(spark):
    df = docs(spark, corpus(300))
    a, b, c = ({(r.doc_id, r.copies) for r in mixing.mix_sources(x, seed=s).collect()} for x, s in ((df, 1), (df.repartition(3), 1), (df, 2)))
    assert a == b != c


def test_fair_in_the_mean(spark):
    rows = [(i, "w " * 5, "s" if i < 40 else "t") for i in range(60)]
    df = docs(spark, rows)
    total = sum(r.copies for seed in range(6) for r in mixing.mix_sources(df, seed=seed).collect() if r.doc_id < 40)
    each = mixing.mix_sources(df).where("doc_id < 40").first()
    assert total / 240 == pytest.approx(each.target / each.source_size, abs=0.05)


def test_edges(spark):
    got = mixing.mix_sources(docs(spark, [(1, None, None), (1, "", "a"), (2, "  ", "a")])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    mixed = mixing.mixed(docs(spark, [(1, "a b", "s"), (2, "c d", "s"), (3, "e", "t")]))
    assert mixed.columns == ["doc_id", "text", "source", "copies"] and mixed.count() >= 3


def test_sources_come_near_their_targets(spark):
    """By the mass of a small row, whatever the sizes: brute-force levels of the targets, then the misses."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.8) * 10 % 20_000 + 1)), f"s{rng.randint(0, 11):02d}") for i in range(3000)]
    rows += [(9000, "w " * 60_000, "s00"), (9001, None, "s01"), (9002, "", None), (9003, "x y", None), (9004, "z", None)]
    size, weight, of = {}, {}, {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
        of[i] = s
    for k, s in enumerate(sorted(size, key=lambda s: (s is None, s))):
        weight[s] = (3, 1, 2)[k % 3]
    total, fixed = 1.5 * sum(size.values()), {}
    while True:
        level = (total - sum(fixed.values())) / sum(w for s, w in weight.items() if s not in fixed)
        over = [s for s in size if s not in fixed and weight[s] * level > 2 * size[s]]
        if not over:
            break
        fixed |= {s: 2.0 * size[s] for s in over}
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(of)
    taken = dict.fromkeys(size, 0)
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(fixed.get(s, weight[s] * level)) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in size:
        target = fixed.get(s, weight[s] * level)
        assert abs(taken[s] - target) <= max(2, 0.005 * target), (s, taken[s], target)


def test_repeated_ids_share_out_their_copies(spark):
    rows = [(i % 5, "w " * (i % 7 + 1), "s") for i in range(60)] + [(None, "a b", "t")] * 3
    df = docs(spark, rows)
    want, made = {}, {}
    for r in mixing.mix_sources(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    for r in mixing.mixed(df).collect():
        made[r.doc_id] = made.get(r.doc_id, 0) + len(r.text.split())
    assert {k: v for k, v in want.items() if v} == made
