import random

from pyspark.sql import functions as F

from meshwright.operators import graph, intervals, keys, spatial


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(55)] + [(i, i + 1) for i in range(100, 140)]
    nodes = sorted({x for e in edges for x in e} | {500, 501})
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = graph.connected_components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in nodes}


def test_greedy_equals_sequential(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.randint(0, 9), [rng.randint(0, 25) for _ in range(rng.randint(1, 4))]) for i in range(60)]
    used, want = set(), []
    for _, i, _, handles in sorted(rows, key=lambda r: (-r[2], r[1])):
        if not used & set(handles):
            used |= set(handles)
            want.append(i)
    df = spark.createDataFrame(rows, "d long, item long, score int, handles array<int>")
    got = graph.greedy_disjoint(df, "item", "handles", [F.col("score").desc(), F.col("item")], ["d"])
    assert sorted(r.item for r in got.collect()) == sorted(want)


def test_box_join_matches_all_pairs(spark):
    rng = random.Random(3)
    boxes = [(rng.randint(0, 2), i, float(x := rng.randint(-300, 300)), float(y := rng.randint(-300, 300)), float(x + rng.randint(0, 90)), float(y + rng.randint(0, 90))) for i in range(90)]
    df = spark.createDataFrame(boxes, "d int, i int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.l_i, r.r_i) for r in spatial.box_join(df, df, ["d"], 20.0, 70.0, gap="euclid").collect()}

    def gap(a, b):
        return (max(0, a[2] - b[4], b[2] - a[4]) ** 2 + max(0, a[3] - b[5], b[3] - a[5]) ** 2) ** 0.5

    assert got == {(a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and gap(a, b) <= 20}


def test_islands(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 12, 20), (1, 5, 6), (1, 40, 41), (2, 0, 1)], "k int, s int, e int")
    got = {(r.k, r.s, r.e, r.members) for r in intervals.union_spans(df, ["k"], "s", "e", 2).collect()}
    assert got == {(1, 0, 20, 3), (1, 40, 41, 1), (2, 0, 1, 1)}


def test_class_pairs_match_enumeration(spark):
    members = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "a"), (2, "c")]
    got = {(r.g, r.class_a, r.class_b): r.pairs for r in keys.class_pairs(spark.createDataFrame(members, "g int, class string"), ["g"]).collect()}
    assert got == {(1, "a", "a"): 1, (1, "a", "b"): 2, (2, "a", "c"): 2, (2, "c", "c"): 1}


def test_first_wins(spark):
    df = spark.createDataFrame([(1, 3, "late"), (1, 1, "early"), (2, 5, "only")], "k int, seq int, v string")
    assert sorted((r.k, r.v) for r in keys.first_wins(df, ["k"], ["seq"]).collect()) == [(1, "early"), (2, "only")]
