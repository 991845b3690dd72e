import pytest

from meshwright.operators import conductors as c

COLUMNS = "drawing long, segment long, evidence string, x1 double, y1 double, x2 double, y2 double"


def lines(spark, *segments):
    return spark.createDataFrame([(1, i, f"h{i}", *map(float, s)) for i, s in enumerate(segments)], COLUMNS)


@pytest.mark.parametrize(
    ("a", "b", "kind", "joined"),
    [
        ((0, 0, 500, 0), (505, 0, 505, 400), "endpoint_connection", True),
        ((0, 0, 500, 0), (250, 10, 250, 400), "t_junction", True),
        ((0, 0, 500, 0), (250, -300, 250, 300), "x_not_connected", False),
        ((0, 0, 500, 0), (300, 5, 800, 5), "collinear", True),
        ((0, 0, 500, 0), (0, 60, 500, 60), None, None),
        ((0, 0, 500, 500), (0, 500, 500, 0), "x_not_connected", False),
    ],
)
def test_pairs(spark, a, b, kind, joined):
    found = c.pair_events(lines(spark, a, b)).collect()
    assert [(r.kind, r.joined) for r in found] == ([(kind, joined)] if kind else [])


def test_marker_connects(spark):
    dots = spark.createDataFrame([(1, 254.0, 3.0), (2, 250.0, 0.0)], "drawing long, x double, y double")
    found = c.pair_events(lines(spark, (0, 0, 500, 0), (250, -300, 250, 300)), markers=dots).collect()
    assert [(r.kind, r.joined, r.x, r.y) for r in found] == [("x_connected", True, 250.0, 0.0)]


def test_moved_drawing_has_the_same_graph(spark):
    base = [(0, 0, 500, 0), (500, 0, 500, 400), (250, 0, 250, -300), (100, -200, 400, -200), (0, 900, 300, 900)]
    roots = []
    for dx, dy in ((0, 0), (12_345, -777)):
        moved = lines(spark, *((a + dx, b + dy, x + dx, y + dy) for a, b, x, y in base))
        roots.append({r.segment: r.root for r in c.conductor_components(moved, c.pair_events(moved)).collect()})
    assert roots[0] == roots[1] == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_dedupe(spark):
    kept = c.dedupe_segments(lines(spark, (0, 0, 200, 0), (200, 0, 0, 0), (0, 0, 100, 0), (0, 0, 200, 3))).collect()
    assert sorted(r.segment for r in kept) == [0, 3]


def test_terminals(spark):
    wires = lines(spark, (0, 120, 0, 400), (0, -115, 0, -400), (5000, 0, 5500, 0))
    devices = spark.createDataFrame([(1, 7, -50.0, -100.0, 50.0, 100.0, 2), (1, 8, 9000.0, 0.0, 9100.0, 100.0, 9)], "drawing long, equipment long, x0 double, y0 double, x1 double, y1 double, terminal_count int")
    found = {(r.equipment, r["rank"]): (r.port, r.segment, r.gap, r.confidence) for r in c.attach_terminals(devices, wires).collect()}
    assert found[7, 1] == (1, 1, 15.0, "high") and found[7, 2] == (0, 0, 20.0, "high")
    assert found[8, 1][3] == "too_far"


def test_merge(spark):
    wires = lines(spark, (0, 0, 500, 0), (250, -300, 250, 300), (250.4, 0, 250.4, 300))
    merged = c.merge_events(c.distinct_events(c.pair_events(wires))).collect()
    at = next(r for r in merged if r.conflict)
    assert (at.kind, at.state, at.raw_states) == ("t_junction", "connected", ["connected", "not_connected"])


def test_empty(spark):
    none = spark.createDataFrame([], COLUMNS)
    events = c.pair_events(none)
    assert events.count() == 0 and c.conductor_components(none, events).count() == 0


#: A port at (230, 150) is on wire 0, where 230 / 300 * 300 gives 230.00000000000003. The port at (270, 75) is on
#: wire 1, which does not meet wire 0. Wire 2 crosses 1, wire 3 crosses 0.
TIED = ((0, 150, 300, 150), (270, -300, 270, 90), (200, -200, 400, -200), (100, 50, 100, 250))
DEVICES = "drawing long, equipment long, x0 double, y0 double, x1 double, y1 double, terminal_count int"
A = (1, 7, 190.0, 0.0, 270.0, 150.0, 1)


def test_equal_gaps_go_to_the_first_segment(spark):
    wires = (*TIED, (0, 150, 350, 150))  # the port is on the last one too, without rounding
    found = {r.port: (r.segment, r.gap, r.qx, r.qy) for r in c.nearest_segments(spark.createDataFrame([A], DEVICES), lines(spark, *wires)).collect()}
    assert found == {0: (0, 0.0, 230.0, 150.0), 1: (1, 40.0, 270.0, 0.0), 2: (0, 75.0, 190.0, 150.0), 3: (1, 0.0, 270.0, 75.0)}
    turned = lines(spark, *((y2, x2, y1, x1) for x1, y1, x2, y2 in wires))
    found = {r.port: (r.segment, r.gap, r.qx, r.qy) for r in c.nearest_segments(spark.createDataFrame([(1, 7, 0.0, 190.0, 150.0, 270.0, 1)], DEVICES), turned).collect()}
    assert found[3] == (0, 0.0, 150.0, 230.0) and found[0] == (1, 0.0, 75.0, 270.0)


def test_equal_gaps_of_terminals_go_to_the_first_port(spark):
    found = c.attach_terminals(spark.createDataFrame([A], DEVICES), lines(spark, *TIED)).collect()
    assert [(r.port, r.segment, r.gap, r["rank"]) for r in found] == [(0, 0, 0.0, 1)]


def tied_nodes(spark, *devices):
    wires = lines(spark, *TIED)
    events = c.pair_events(wires)
    return c.connectivity(c.attach_terminals(spark.createDataFrame(list(devices), DEVICES), wires), c.conductor_components(wires, events), wires), events


def test_equal_gaps_make_one_node(spark):
    found = tied_nodes(spark, A)[0].collect()
    assert [(r.root, r.equipment, r.terminals, r.handles) for r in found] == [(0, [7], 1, ["h0"])]


def test_equal_gaps_join_devices_of_one_node(spark):
    below, beside = (1, 8, 230.0, -400.0, 310.0, -200.0, 1), (1, 9, 20.0, 150.0, 60.0, 200.0, 1)
    found = c.device_edges(tied_nodes(spark, A, below, beside)[0]).collect()
    assert [(r.root, r.source, r.target) for r in found] == [(0, 7, 9)]


def test_equal_gaps_keep_the_events_of_their_node(spark):
    nodes, events = tied_nodes(spark, A)
    found = c.active_events(c.distinct_events(events), nodes).collect()
    assert [(r.left, r.right, r.kind) for r in found] == [(0, 3, "x_not_connected")]
