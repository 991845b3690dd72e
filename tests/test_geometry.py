import math

import pytest
from pyspark.sql import functions as F

from meshwright.functions import geometry as g


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def pt(x, y):
    return g.point(F.lit(float(x)), F.lit(float(y)))


def cloud(*points):
    return F.array(*(pt(*p) for p in points))


def xy(points):
    return [(pytest.approx(p.x, abs=1e-9), pytest.approx(p.y, abs=1e-9)) for p in points]


def test_project(spark):
    q = one(spark, g.project(pt(3, 4), pt(0, 0), pt(10, 0)))
    assert (q.gap, q.x, q.y, q.t) == (4.0, 3.0, 0.0, 0.3)
    assert one(spark, g.project(pt(-3, 4), pt(0, 0), pt(10, 0))).gap == 5.0
    assert one(spark, g.project(pt(3, 4), pt(0, 0), pt(0, 0))).gap == 5.0


def test_samples(spark):
    line = one(spark, g.sample_line(pt(0, 0), pt(47, 0)))
    assert [p.x for p in line] == [pytest.approx(i) for i in range(48)]
    circle = one(spark, g.sample_circle(pt(1, 1), F.lit(2.0)))
    assert len(circle) == 96 and all(math.hypot(p.x - 1, p.y - 1) == pytest.approx(2) for p in circle)
    ring = one(spark, g.sample_polyline(cloud((0, 0), (1, 0), (1, 1)), F.lit(True)))
    assert len(ring) == 96 and (ring[-1].x, ring[-1].y) == (0.0, 0.0)
    assert one(spark, g.sample_polyline(cloud((0, 0)), F.lit(False))) == []


def test_normalised_and_turned(spark):
    flat = one(spark, g.normalised(cloud((0, 0), (10, 5))))
    assert [(p.x, p.y) for p in flat] == [(-0.5, -0.25), (0.5, 0.25)]
    turns = {t.transform: [(p.x, p.y) for p in t.points] for t in one(spark, g.dihedral(cloud((2, 1))))}
    assert turns["rotate_90"] == [(-1.0, 2.0)] and turns["mirror_x+rotate_0"] == [(-2.0, 1.0)] and len(turns) == 8
    assert [(p.x, p.y) for p in one(spark, g.normalised(cloud((3, 3))))] == [(0.0, 0.0)]


def test_descriptor_is_invariant(spark):
    points = [(0, 0), (4, 0), (4, 1), (1, 3), (-2, 2)]
    turned = [(-y + 7, x - 3) for x, y in points]
    a, b = (one(spark, g.radial_descriptor(cloud(*p))) for p in (points, turned))
    assert a == pytest.approx(b) and sum(a) == pytest.approx(1)


def test_main_axis(spark):
    points = [(i * math.cos(0.7), i * math.sin(0.7)) for i in range(-5, 6)]
    assert all(abs(p.y) < 1e-9 for p in one(spark, g.axis_aligned(cloud(*points))))


def test_similarity(spark):
    m = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), F.lit(v)))) if kv else F.create_map().cast("map<string,int>")
    assert one(spark, g.multiset_similarity(m(a=2, b=1), m(a=1, c=1))) == 0.25
    assert one(spark, g.multiset_similarity(m(), m())) == 1.0
    assert one(spark, g.multiset_similarity(m(), m(), 0.0)) == 0.0


def test_downsample(spark):
    many = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: pt(0, 0).withField("x", i.cast("double")))
    assert [p.x for p in one(spark, g.downsampled(many, 4))] == [0.0, 3.0, 6.0, 9.0]
