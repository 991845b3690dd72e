import random
import zlib

import numpy as np

from meshwright.llm import quality, toxicity

INSULTS = ["scum", "moron", "clown"]


def corpus(n=900):
    rng = random.Random(0)
    vocabulary = ["w" + str(i) for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.25, rng.random() < 0.25
        words = rng.choices(vocabulary, k=rng.randint(20, 120))
        if toxic:
            for _ in range(1 + len(words) // 25):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", "!", ","]))
        if junk:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "x", 9.0) for i, t in rows], "doc_id long, text string, _label string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def accuracy(got, truth):
    own = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(own) > 100 and all(held_out(r.doc_id) for r in own)
    return np.mean([r.predicted == truth[r.doc_id] for r in own])


def test_toxicity(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, [*rows, (None, "scum clown moron"), (5000, None), (5001, "")], labels)
    model = toxicity.fit_toxicity(docs, marks)
    got = toxicity.score_toxicity(docs, model).collect()
    assert accuracy(got, {i: t for i, _, t in labels}) > 0.95
    assert {r.predicted for r in got if r.doc_id in (5000, 5001)} == {0} and {r.held_out for r in got if r.doc_id is None} == {False}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = toxicity.not_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_toxicity_without_labels(spark):
    docs, marks = frames(spark, corpus(40)[0], [])
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, marks)).collect()
    assert len(got) == 40 and {r.predicted for r in got} == {0}
    assert toxicity.not_toxic(docs.limit(0), marks).count() == 0


def test_quality(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, [*rows, (None, "A"), (5000, None), (5001, "x " * 50_000)], [*labels, (3, 1, 0), (None, 1, 1), (77_777, None, None)])
    got = quality.score_quality(docs, quality.fit_quality(docs, marks)).collect()
    assert accuracy(got, {i: q for i, q, _ in labels}) > 0.95 and len(got) == len(rows) + 3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_of_one_kind(spark):
    rows, labels = corpus(60)
    docs, marks = frames(spark, rows, [(i, 1, 0) for i, _, _ in labels])
    assert {r.predicted for r in quality.score_quality(docs, quality.fit_quality(docs, marks)).collect()} == {1}
    docs, marks = frames(spark, rows, [])
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, marks)).collect()} == {0.5}


def test_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    rows = [(np.arange(5), v) for v in x]
    w = quality.descend(rows, y, 5)
    assert (np.sign(x @ w[:5] + w[5]) == y).mean() > 0.95


def test_shapes():
    assert [quality.shape(w) for w in ("Word", "WORD!!", "a1b2", "x&&&", "")] == ["Aa", "A!", "a0a0", "a&", ""]


def test_shape_is_of_the_whole_word():
    assert quality.shape("a" * 64 + "B" * 100_000 + "7&&") == "aA0&"
    a, b = (quality.Features()("x" * 70 + tail) for tail in ("yy", "Y9!"))
    own = [np.uint64(quality.xxhash.xxh64_intdigest(s.encode(), seed=1)) + np.uint64(11) for s in ("a", "aA0!")]
    slots = quality._mix(np.array(own)) & np.uint64(quality.SLOTS - 1)
    assert slots[0] in a and slots[1] in b and slots[0] not in b


def test_toxicity_keeps_every_entry_under_its_own_name(spark):
    from pyspark.sql import functions as F

    n = 4000
    names = spark.range(n).select(F.lit(0).alias("h"), F.concat(F.lpad(F.hex("id"), 5, "0"), F.lit("x")).alias("name"), (F.col("id") % 2).alias("side"))
    many, few = F.lit(40).cast("long"), F.lit(0).cast("long")
    own = names.select("h", "name", *(F.when(F.col("side") == k, many).otherwise(few).alias(c) for k, c in enumerate(("ordinary", "toxic"))), many.alias("all"))
    common = spark.createDataFrame([(0, f"common{i}", 10, 10, 100) for i in range(n)], "h int, name string, ordinary long, toxic long, `all` long")
    for model in toxicity.fit_models(own.unionByName(common), []):
        found = [{round(float(model.ratios(f"{i:05X}x")[0]), 5) for i in range(k, n, 2)} for k in (0, 1)]
        assert all(len(x) == 1 for x in found) and max(found[0]) < 0 < max(found[1])


def brute_ratios(rows, side, common, share):
    """Log ratio of every pair by the formulas, and each text's mean; all counts held in dictionaries."""
    from collections import Counter
    from math import log

    def pairs(text):
        h, out = 0, []
        for w in text.lower().split():
            if name := w.strip(toxicity.EDGES):
                out.append((h, name))
                h = common.index(name) + 1 if name in common else h
        return out

    n, every = {0: Counter(), 1: Counter()}, Counter()
    for i, t in rows:
        own = set(pairs(t))
        every.update(own)
        if side.get(i) is not None:
            n[side[i]].update(own)

    def stems(counts):
        out = Counter()
        for (h, w), k in counts.items():
            out[h, w[: toxicity.STEM]] += k
        return out

    def discount(counts, part):
        below, values = 0, sorted(counts.values())
        for i, v in enumerate(values):
            if below + (len(values) - i) * v >= part * sum(values):
                return (part * sum(values) - below) / (len(values) - i)
            below += v

    s, s_every = {c: stems(n[c]) for c in n}, stems(every)
    d, e = {c: discount(n[c], share[0]) for c in n}, {c: discount(s[c], share[1]) for c in n}
    d0, types = toxicity.SHARED_DISCOUNT, len(every)
    after, total, kinds = Counter(w for _, w in every), Counter(), Counter()
    mass, freed, s_freed = ({c: Counter() for c in n} for _ in range(3))
    for (h, w), k in every.items():
        total[h] += k
        kinds[h] += 1
    for c in n:
        for (h, w), k in n[c].items():
            mass[c][h] += k
            freed[c][h] += min(k, d[c])
        for (h, w), k in s[c].items():
            s_freed[c][h] += min(k, e[c])
    ratios = {}
    for h, w in every:
        shared = max(every[h, w] - d0, 0) / total[h] + d0 * kinds[h] / total[h] * (max(after[w] - d0, 0) + d0) / types
        p = {}
        for c in n:
            m, stem = mass[c][h], (h, w[: toxicity.STEM])
            if not m:
                p[c] = shared
                continue
            of_stem = max(s[c][stem] - e[c], 0) / m + s_freed[c][h] / m * s_every[stem] / total[h]
            p[c] = max(n[c][h, w] - d[c], 0) / m + freed[c][h] / m * of_stem * shared / (s_every[stem] / total[h])
        ratios[h, w] = log(p[1] / p[0])
    means = [sum(ratios[x] for x in set(own)) / len(own) ** toxicity.LENGTH if (own := pairs(t)) else 0.0 for _, t in rows]
    return ratios, means


def test_toxicity_equals_brute_force(spark):
    rows, labels = corpus(300)
    rows = [(i, t.replace("w1 ", "the, ").replace("w2 ", "Und ").replace("w3 ", "de ") + " -- the the und de " + t[:20]) for i, t in rows] + [(900, "   "), (901, "?! ..")]
    docs, marks = frames(spark, rows, labels)
    common = toxicity.common_words(docs, "text")
    assert common == ["de", "the", "und"]
    labelled = toxicity.with_labels(docs.select("doc_id", "text"), marks, "toxic")
    models = toxicity.fit_models(toxicity.stored(toxicity.count_pairs(labelled, "text", common)), common)
    side = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 > toxicity.CALIBRATION}
    for model, share in zip(models, toxicity.MASSES, strict=True):
        ratios, means = brute_ratios(rows, side, common, share)
        assert len(model.words) and len(model.stems)
        for (h, w), want in ratios.items():
            assert abs(model.ratios(w)[h] - want) < 1e-9, (h, w)
        got = {r.doc_id: r._mean for r in toxicity.mean_ratios(docs, model, "text", ["doc_id"]).collect()}
        assert all(abs(got[i] - m) < 1e-9 for (i, _), m in zip(rows, means, strict=True))


def test_toxicity_of_repeats_ties_and_long_texts(spark, monkeypatch):
    rows, labels = corpus(400)
    long = " ".join(t for _, t in rows) + " " + "x" * 100_000 + " " + " ".join(f"u{i}" for i in range(20_000))
    more = [(rows[0][0], rows[0][1]), (7000, long), (7001, long), (7002, "w1 " * 50_000)]
    docs, marks = frames(spark, [*rows, *more], [*labels, (0, 1, 0), (0, 1, 1), (None, 1, 1), (8000, None, None)])
    model = toxicity.fit_toxicity(docs, marks)
    order = lambda df: sorted((str(r.doc_id), r.score, r.predicted) for r in df.collect())
    want = order(toxicity.score_toxicity(docs, model))
    assert len(want) == len(rows) + 4 and len({x for x in want if x[0] in ("7000", "7001")}) == 2
    assert len({x[1] for x in want if x[0] in ("7000", "7001")}) == 1 and len({x for x in want if x[0] == str(rows[0][0])}) == 1
    monkeypatch.setattr(toxicity, "HELD", 50)  # workers forget all the time
    assert order(toxicity.score_toxicity(docs.repartition(3), model)) == want


def test_toxicity_by_join_equals_broadcast(spark, monkeypatch):
    rows, labels = corpus()
    docs, marks = frames(spark, [*rows, (None, "scum clown moron"), (5000, None), (5001, ""), (5, "scum")], labels)
    order = lambda df: sorted((str(r.doc_id), round(r.score, 9), r.predicted) for r in df.collect())
    want, kept = order(toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, marks))), sorted(map(str, toxicity.not_toxic(docs, marks).collect()))
    monkeypatch.setattr(toxicity, "ENTRIES", 0)
    model = toxicity.fit_toxicity(docs, marks)
    assert model.entries is not None and order(toxicity.score_toxicity(docs, model)) == want
    assert sorted(map(str, toxicity.not_toxic(docs, marks).collect())) == kept


def brute_slots(text):
    """Slots of a text's words, and of the runs of one to three shapes, by the plain definition."""
    words = text.split()
    if not words:
        return set()
    one = [7 if k and w == words[k - 1] else quality.xxhash.xxh64_intdigest(quality.shape(w).encode(), seed=1) for k, w in enumerate(words)]
    mask, m = (1 << 64) - 1, lambda x: int(quality._mix(np.array([x], np.uint64))[0])
    found = {m(quality.xxhash.xxh64_intdigest(w.encode())) for w in words} | {m((a + 11) & mask) for a in one}
    two = [m((a * 3 + b) & mask) for a, b in zip(one, one[1:], strict=False)]
    three = [m((a * 5 + c) & mask) for a, c in zip(two, one[2:], strict=False)]
    return {x & (quality.SLOTS - 1) for x in (*found, *two, *three)}


def test_quality_equals_brute_force(spark):
    from math import log, sqrt

    rows, labels = corpus(250)
    rows += [(900, None), (901, ""), (902, "A A A b"), (0, rows[0][1])]
    docs, marks = frames(spark, rows, [*labels, (901, 0, 0)])
    model = quality.fit_quality(docs, marks)
    label = {i: q for i, q, _ in labels} | {901: 0}
    counts, seen = ({}, {}), [0, 0]
    for i, t in rows:
        if i in label and not held_out(i):
            seen[label[i]] += 1
            for s in brute_slots(t or ""):
                counts[label[i]][s] = counts[label[i]].get(s, 0) + 1
    want = np.zeros(quality.SLOTS)
    for s in {*counts[0], *counts[1]}:
        a, b = counts[0].get(s, 0), counts[1].get(s, 0)
        if a + b >= 3:
            want[s] = log((b + 1) / (seen[1] + 2)) - log((a + 1) / (seen[0] + 2))
    assert np.abs(model.ratios - want).max() < 1e-5
    text = dict(rows)
    for r in quality.score_quality(docs, model).collect():
        slots = sorted(brute_slots(text[r.doc_id] or ""))
        norm = sqrt(sum(want[s] ** 2 for s in slots)) or 1.0
        margin = model.bias + sum(float(model.weights[s]) * want[s] for s in slots) / norm
        assert abs(r.score - 1 / (1 + np.exp(-(model.slope * margin + model.offset)))) < 1e-5
    assert quality.score_quality(docs.limit(0), model).count() == 0
    assert len({r.score for r in quality.score_quality(docs, model).where("doc_id in (900, 901)").collect()}) == 1
    assert len({r.score for r in quality.score_quality(docs, model).where("doc_id = 0").collect()}) == 1


def test_descent_reaches_the_optimum():
    """The dual's value is that of the primal, so no other weights do better."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = np.where(x[:, 0] + rng.normal(size=60) * 0.7 > 0, 1.0, -1.0)
    rows = [(np.arange(4), v) for v in x]
    costs = quality.COST * len(y) / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())

    def value(w):
        return w @ w / 2 + (costs * np.maximum(0, 1 - y * (x @ w[:4] + w[4]))).sum()

    own = quality.descend(rows, y, 4)
    rounds = [value(own + rng.normal(size=5) * s) for s in (0.01, 0.05, 0.2) for _ in range(300)]
    assert value(own) < min(rounds) + 0.02 * value(own)


def test_common_words_count_what_is_rare_in_a_task(spark, monkeypatch):
    """c8 is once more in all texts than c7, in a task where it is one word in 4,001."""
    texts = [" ".join(f"c{k}" for k in range(1, 9)) + " "] * 200, [f"f{i} " for i in range(4000)] + ["c8"]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([("".join(t),) for t in texts], 2), "text string")
    want = ["c1", "c2", "c3", "c4", "c5", "c6", "c8"]
    assert toxicity.common_words(docs, "text") == want
    monkeypatch.setattr(toxicity, "HELD", 50)  # passes its counts on all the time
    assert toxicity.common_words(docs, "text") == want
    assert toxicity.common_words(docs.limit(0), "text") == []


def test_common_words_that_parts_leave_out_are_counted_again(spark):
    def part(n, **often):
        words = [w for w, k in often.items() for _ in range(k)]
        return words + [f"{n}-{i}" for i in range(n - len(words))]

    some, rest = part(6_000, x=160), part(20_000, x=4, y=163, **{f"c{i}": 300 for i in range(6)})
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((some, rest))], "k int, text string").repartitionByRange(2, "k")
    passed = {(r["name"], r["n"], r["left"]) for r in toxicity._name_counts(docs.select("text")).collect()}
    assert ("x", 160, 1) in passed and ("y", 163, 4) in passed and len(passed) == 10  # 160 of x are not the whole
    assert toxicity.common_words(docs, "text") == [*(f"c{i}" for i in range(6)), "x"]


def test_growing_models_are_compared_at_once(spark, monkeypatch):
    rows, marked = corpus(200)
    docs, marks = frames(spark, rows, marked)
    docs = docs.drop("_label")
    counts = toxicity.stored(toxicity.count_pairs(toxicity.with_labels(docs, marks, "toxic"), "text", ["w1", "w2"]))
    (model,) = toxicity.each_model(counts, ["w1", "w2"], constant=False)
    each = model.each()
    texts = [t for _, t in rows[:40]] + ["", None]
    assert list(zip(*map(list, toxicity.Scorer(model)(texts)))) == [tuple(toxicity.Scorer(m)(texts)) for m in each]
    for one, share in zip(each, toxicity.GROWING, strict=True):
        monkeypatch.setattr(toxicity, "GROWING", (share,))
        (alone,) = toxicity.fit_models(counts, ["w1", "w2"], constant=False)
        assert np.allclose(alone.rest, one.rest, rtol=1e-12) and np.allclose(alone.table(["scum", "w1", "w7", "none"]), one.table(["scum", "w1", "w7", "none"]), rtol=1e-9)


def brute_growing(rows, side, common, share):
    """Log ratio of every pair with discounts D (1 - exp(-n / D)), by the formulas; all counts held in dictionaries."""
    from collections import Counter
    from math import exp, log

    def pairs(text):
        h, out = 0, set()
        for w in text.lower().split():
            if name := w.strip(toxicity.EDGES):
                out.add((h, name))
                h = common.index(name) + 1 if name in common else h
        return out

    def summed(counts, key):
        out = Counter()
        for x, k in counts.items():
            out[key(*x)] += k
        return out

    def discounted(counts, part):
        """(count left, mass freed by history), with D by bisection over all pairs."""
        taken = lambda d: {x: d * (1 - exp(-k / d)) for x, k in counts.items()}
        low, high = 1e-6, 1e6
        for _ in range(200):
            middle = (low * high) ** 0.5
            low, high = (middle, high) if sum(taken(middle).values()) < part * sum(counts.values()) else (low, middle)
        off = taken(high)
        return {x: k - off[x] for x, k in counts.items()}, summed(off, lambda h, _: h)

    n, every = (Counter(), Counter()), Counter()
    for i, t in rows:
        every.update(own := pairs(t))
        if side.get(i) is not None:
            n[side[i]].update(own)
    stem, history = (lambda h, w: (h, w[: toxicity.STEM])), (lambda h, _: h)
    s_every, total, kinds, after = summed(every, stem), summed(every, history), Counter(h for h, _ in every), Counter(w for _, w in every)
    d0, ratios = toxicity.SHARED_DISCOUNT, {}
    models = [(discounted(n[c], share[0]), discounted(summed(n[c], stem), share[1]), summed(n[c], history)) for c in (0, 1)]
    for h, w in every:
        shared = (max(every[h, w] - d0, 0) + d0 * kinds[h] * (max(after[w] - d0, 0) + d0) / len(every)) / total[h]
        s, p = stem(h, w), []
        for (left, freed), (s_left, s_freed), mass in models:
            of_stem = s_left.get(s, 0) / mass[h] / (s_every[s] / total[h]) + s_freed[h] / mass[h]
            p.append(left.get((h, w), 0) / mass[h] + freed[h] / mass[h] * of_stem * shared)
        ratios[h, w] = log(p[1] / p[0])
    return ratios, {w for c in n for _, w in c}


def test_toxicity_discounts_leave_every_pair_its_share(spark, monkeypatch):
    rows, labels = corpus(300)
    rows = [(i, t.replace("w1 ", "the, ").replace("w2 ", "Und ") + f" the und only{i}") for i, t in rows]
    docs, marks = frames(spark, rows, labels)
    side = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 > toxicity.CALIBRATION}
    for share in toxicity.GROWING:
        monkeypatch.setattr(toxicity, "GROWING", (share,))
        model = toxicity.fit_toxicity(docs, marks)
        ratios, seen = brute_growing(rows, side, model.common, share)
        assert len(model.common) == 2 and len(model.words) == len(seen) > 500
        for (h, w), want in ratios.items():
            assert abs(model.ratios(w)[h] - want) < 1e-7, (h, w)
        for i in list(side)[:40]:  # a pair of one text leans to that text's class, against others of its stem
            own, others = model.ratios(f"only{i}")[2], model.ratios(f"only{i}"[: toxicity.STEM] + "zz")[2]
            assert (own > others) == bool(side[i]) and own != others
