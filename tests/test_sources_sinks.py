import json
import zipfile

import pytest
from pyspark.sql import functions as F

from meshwright.operators import text
from meshwright.plans import asset_model, templates
from meshwright.sinks import documents
from meshwright.sources import asset_xml, dxf, svg


def pairs(*items):
    return "".join(f"{code}\n{value}\n" for code, value in items)


DRAWING = pairs(
    (0, "SECTION"), (2, "TABLES"), (0, "LAYER"), (2, "HID"), (62, -3), (70, 0), (0, "LAYER"), (2, "W"), (62, 1), (70, 0), (0, "ENDSEC"),
    (0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "B"), (10, 1), (20, 0), (0, "LINE"), (8, "0"), (10, 1), (20, 0), (11, 3), (21, 0), (0, "CIRCLE"), (8, "0"), (10, 1), (20, 0), (40, 2), (0, "ENDBLK"), (0, "ENDSEC"),
    (0, "SECTION"), (2, "ENTITIES"), (0, "LINE"), (5, "A1"), (8, "W"), (10, 0), (20, 0), (11, 100), (21, 0), (0, "LINE"), (5, "A2"), (8, "HID"), (10, 0), (20, 0), (11, 1), (21, 1),
    (0, "INSERT"), (5, "A3"), (8, "W"), (2, "B"), (10, 10), (20, 20), (41, -2), (42, 2), (50, 90), (66, 1), (0, "ATTRIB"), (8, "0"), (1, "T1"), (10, 0), (20, 0), (40, 5), (0, "SEQEND"),
    (0, "INSERT"), (5, "A4"), (8, "HID"), (2, "B"), (10, 0), (20, 0), (0, "ENDSEC"), (0, "EOF"),
)


def test_drawing(spark, tmp_path):
    (tmp_path / "one.dxf").write_text(DRAWING)
    (tmp_path / "two.dxf").write_text("not a\ndrawing\n")
    rows = dxf.read_drawings(spark, str(tmp_path)).collect()
    by = {r.evidence: r for r in rows if r.record == "entity"}
    assert set(by) == {"A1", "V0000001", "V0000002", "V0000003"}
    line = by["V0000002"]
    # the block's line from (1,0) to (3,0): base (1,0) off, mirrored, doubled, turned and moved; the layer is the INSERT's
    assert [(round(p.x, 9), round(p.y, 9)) for p in line.points] == [(10.0, 20.0), (10.0, 16.0)] and line.layer == "W" and line.virtual
    assert by["V0000003"].radius == pytest.approx(4) and by["V0000001"].text == "T1"
    assert sorted((r.kind, r.reason) for r in rows if r.record == "excluded") == [("INSERT", "layer_off"), ("LINE", "layer_off")]
    assert [(r.block, r.attributes) for r in rows if r.record == "insert"] == [("B", ["T1"])]
    assert [r.drawing for r in rows if r.record == "error"] == ["two"]


MODEL = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:cim="http://c#">
<cim:Breaker rdf:ID="b1"><cim:Naming.name>10kV  进线 主进</cim:Naming.name></cim:Breaker><cim:Fuse rdf:ID="f1"/><cim:ACLineSegment rdf:ID="l1"/>
<cim:Circuit rdf:ID="c1"><cim:Circuit.SourceBreaker rdf:resource="#b1"/></cim:Circuit>
<cim:Terminal rdf:ID="t1"><cim:Terminal.ConductingEquipment rdf:resource="#b1"/><cim:Terminal.ConnectivityNode rdf:resource="#n1"/></cim:Terminal>
<cim:Terminal rdf:ID="t2"><cim:Terminal.ConductingEquipment rdf:resource="#l1"/><cim:Terminal.ConnectivityNode rdf:resource="#n1"/></cim:Terminal>
<cim:Terminal rdf:ID="t3"><cim:Terminal.ConductingEquipment rdf:resource="#l1"/><cim:Terminal.ConnectivityNode rdf:resource="#n2"/></cim:Terminal>
<cim:Terminal rdf:ID="t4"><cim:Terminal.ConductingEquipment rdf:resource="#f1"/><cim:Terminal.ConnectivityNode rdf:resource="#n2"/></cim:Terminal>
<cim:Terminal rdf:ID="t5"><cim:Terminal.ConductingEquipment rdf:resource="#f1"/></cim:Terminal></rdf:RDF>"""


def test_mining_of_a_model(spark, tmp_path):
    for name in ("a.xml", "b.xml"):
        (tmp_path / name).write_text(MODEL, encoding="utf-8")
    (tmp_path / "bad.xml").write_text("<x>")
    records = asset_xml.read_models(spark, str(tmp_path)).cache()
    assert {r.record: r["count"] for r in records.groupBy("record").count().collect()} == {"object": 8, "terminal": 8, "warning": 2, "error": 1}
    mined = asset_model.mine(asset_xml.objects(records), asset_xml.terminals(records), asset_xml.references(records), at_least=2, files_at_least=2)
    assert [(r.class_a, r.class_b, r.occurrences) for r in mined.contracted.collect()] == [("Breaker", "Fuse", 2)]
    assert [(r.switch_class_a, r.switch_class_b) for r in mined.serial.collect()] == [("Breaker", "Fuse")]
    assert {(r.class_a, r.class_b) for r in mined.direct.collect()} == {("ACLineSegment", "Breaker"), ("ACLineSegment", "Fuse")}
    roles = {(r.equipment_class, r.role, r.file_count) for r in mined.roles.collect()}
    assert roles == {("Breaker", "incoming_switch", 2), ("Breaker", "circuit_source_breaker", 2)}
    assert {(r.switch_class, r.neighbor_class): r.conditional_support for r in mined.neighbors.collect()} == {("Breaker", "Fuse"): 1.0, ("Fuse", "Breaker"): 1.0}
    assert mined.serial_contexts.count() == 1 and mined.switch_contexts.count() == 2 and mined.rules.count() == 7


SYMBOLS = """<symbol id="Breaker:cb@1" viewBox="0 0 20 10"><line x1="0" y1="5" x2="20" y2="5"/><circle cx="10" cy="5" r="5"/><use x="0" y="5" terminal-index="0"/></symbol>
<symbol id="flow:a" viewBox="bad"><path d="M  0"/></symbol><use xlink:href="#Breaker:cb@1" x="1"/><metadata><cge:PSR_Ref ObjectID="b1"/></metadata>"""


def test_template_library(spark, tmp_path):
    (tmp_path / "a.svg").write_text(SYMBOLS)
    rows = svg.read_symbols(spark, str(tmp_path / "a.svg")).cache()
    objects = spark.createDataFrame([("a", "b1", "Breaker", "CB 1")], "file string, object_id string, class string, name string")
    terminals = spark.createDataFrame([("a", "b1", 2)], "file string, object_id string, n int")
    found = {r.symbol_id: r for r in templates.build_library(rows.where("record = 'definition'").drop("object_id", "record", "error"), rows.where("record = 'use'").select("file", "symbol_id", "object_id"), objects, terminals).collect()}
    cb = found["Breaker:cb@1"]
    assert (cb.family, cb.name, cb.state, cb.usage_count, cb.xml_semantic_classes, cb.is_equipment_template) == ("Breaker", "cb", "1", 1, {"Breaker": 1}, True)
    assert cb.primitive_counts == {"circle": 1, "line": 1} and not found["flow:a"].is_equipment_template
    assert json.loads(cb.geometry)["terminals"] == [{"index": 0, "point": [0.0, 0.5]}]


def test_rules(spark):
    df = spark.createDataFrame([("10kV 环网 柜",), ("接至1号柜",), ("DTU柜",), ("变压器",), (None,)], "t string")
    assert [r[0] for r in df.select(text.cabinet_family(F.col("t"))).collect()] == ["RingMainUnit", None, "DTUCabinet", None, None]
    got = df.select(text.block_semantics(F.col("t")).alias("s"), text.text_prior(F.col("t")).alias("p")).collect()
    assert got[3].s.physical_type == "PowerTransformer" and got[3].p == "PowerTransformer" and got[4].s is None and got[4].p == ""


def test_documents(spark, tmp_path):
    documents.write_json(tmp_path / "a.json", {"名": 1})
    assert documents.read_json(tmp_path / "a.json") == {"名": 1}
    documents.write_csv(tmp_path / "a.csv", [{"a": [1], "b": None, "z": 0}], ["a", "b"])
    assert (tmp_path / "a.csv").read_bytes() == "﻿a,b\r\n[1],\r\n".encode()
    documents.write_csv(tmp_path / "none.csv", [])
    assert not (tmp_path / "none.csv").exists()
    documents.write_workbook(tmp_path / "a.xlsx", {"s<1": [["h", "v"], ["x & y", 1.5], [True, None]]}, {"s<1": {"A2:A9": ["yes", "no"]}})
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        assert b"x &amp; y" in z.read("xl/worksheets/sheet1.xml") and b"yes,no" in z.read("xl/worksheets/sheet1.xml")
    assert documents.column_name(28) == "AB" and documents.checksums([tmp_path / "a.json"]).endswith("  a.json\n")
    assert documents.sanitised({"examples": 1, "x": [{"svg_directory": "/home", "k": 2}]}) == {"x": [{"svg_directory": documents.MASK, "k": 2}]}
    assert documents.with_profile({"t": 1}, "P", {"f": 2}, "v1")["recognition_profiles"] == {"P": {"f": 2}}
    assert documents.digests(spark, str(tmp_path / "a.json")).first().sha256 == documents.checksums([tmp_path / "a.json"]).split()[0]
    assert "| a\\|b |" in documents.markdown_table(["h"], [["a|b"]])
