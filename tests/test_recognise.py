import json

from meshwright.plans import recognise
from meshwright.sinks.annotation import sheets, write_annotation
from meshwright.sources import dxf
from meshwright.streaming.arrivals import on_arrival
from tests.test_sources_sinks import pairs


def line(x1, y1, x2, y2, handle):
    return [(0, "LINE"), (5, handle), (8, "W"), (10, x1), (20, y1), (11, x2), (21, y2)]


def drawing():
    box = [(0, "LWPOLYLINE"), (8, "0"), (70, 1), (10, -50), (20, -50), (10, 50), (20, -50), (10, 50), (20, 50), (10, -50), (20, 50)]
    insert = lambda h, x, y: [(0, "INSERT"), (5, h), (8, "W"), (2, "断路器1"), (10, x), (20, y)]
    return pairs(
        (0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "断路器1"), (10, 0), (20, 0), *box, (0, "ENDBLK"), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"),
        *line(0, 50, 0, 600, "A"), *line(0, -50, 0, -600, "B"), *line(-300, 300, 300, 300, "C"), *line(1000, -50, 1000, -500, "D"),
        *line(0, -600, 1000, -500, "E"), *insert("F", 0, 0), *insert("G", 0.5, 0), *insert("H", 1000, 0),
        (0, "CIRCLE"), (5, "I"), (8, "W"), (10, 0), (20, 300), (40, 10), (0, "ENDSEC"),
    )


def test_network(spark, tmp_path):
    (tmp_path / "d.dxf").write_text(drawing(), encoding="utf-8")
    rows = dxf.read_drawings(spark, str(tmp_path)).cache()
    found = recognise.recognise(rows)
    equipment = sorted(found.equipment.collect(), key=lambda r: r.equipment)
    # two inserts on one another are one device
    assert [(r.equipment, r.physical_type, r.source, len(r.handles)) for r in equipment] == [("EQ00001", "SwitchCombination", "block_name", 2), ("EQ00002", "SwitchCombination", "block_name", 1)]
    assert {r.evidence for r in found.segments.collect()} == {"A", "B", "C", "D", "E"}
    events = {r.kind: r.state for r in found.events.collect()}
    assert events["x_connected"] == "connected" and events["endpoint_connection"] == "connected"
    assert [(r.source, r.target) for r in found.edges.collect()] == [("EQ00001", "EQ00002")]
    write_annotation(tmp_path / "a.xlsx", found, "d")
    assert {k: len(v) for k, v in sheets(found, "d").items()}["missed"] == 31
    document = json.loads(recognise.documents(found).first().document)
    assert document["truth_used_during_recognition"] is False
    assert {"equipment", "terminals", "connectivity_nodes", "crossings", "device_edges"} <= set(document)


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/d.dxf").write_text(drawing(), encoding="utf-8")
    seen = []
    on_arrival(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda df, n: seen.append((n, df.count()))).awaitTermination()
    on_arrival(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda df, n: seen.append((n, df.count()))).awaitTermination()
    assert seen == [(0, 1)]
