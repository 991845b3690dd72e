import pytest

from meshwright.operators import matching


@pytest.mark.parametrize("huge", [10_000, 80])
def test_large_groups_give_every_shape(spark, monkeypatch, huge):
    monkeypatch.setattr(matching, "HUGE", huge)
    sizes = {1: 3, 2: 7, 3: 70, 4: 100, None: 65}
    rows = [(g, 1000 + i, 10.0 * i, 0.0, 10.0 * i + 1, 1.0) for g, n in sizes.items() for i in range(n)]
    got = matching.subset_candidates(spark.createDataFrame(rows, "`group` int, shape long, x0 double, y0 double, x1 double, y1 double"), 9.5).collect()
    assert sorted((r.mask, r["size"]) for r in got if r.group == 1) == [(1, 1), (2, 1), (3, 2), (4, 1), (6, 2), (7, 3)]
    for g in (2, 3, 4, None):
        own = [r for r in got if r.group == g]
        assert sorted(r["shape"] for r in own if r.mask is None) == list(range(1000, 1000 + sizes[g])) and {r["size"] for r in own if r.mask is None} == {1}
        assert [(r["shape"], r["size"]) for r in own if r.mask is not None] == [(None, sizes[g])]
