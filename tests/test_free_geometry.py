import pytest
from pyspark.sql import functions as F

from meshwright.plans import free_geometry, recognise, templates
from meshwright.sinks import reports
from meshwright.sources import asset_xml, dxf, files, svg
from tests.test_recognise import line
from tests.test_sources_sinks import MODEL, SYMBOLS, pairs

LIBRARY = """<symbol id="PowerTransformer:two@0" viewBox="0 0 100 100"><circle cx="0" cy="0" r="60"/><circle cx="90" cy="0" r="60"/><use terminal-index="0" x="0" y="0"/></symbol>
<symbol id="Fuse:box@0" viewBox="0 0 100 100"><polygon points="0,0 200,0 200,80 0,80"/><line x1="0" y1="40" x2="200" y2="40"/><use terminal-index="0" x="0" y="0"/></symbol>
<symbol id="Arrester:three@0" viewBox="0 0 100 100"><polyline points="0,0 50,90 100,0 150,90"/><use terminal-index="0" x="0" y="0"/></symbol>
<symbol id="Meter:round@0" viewBox="0 0 100 100"><ellipse cx="0" cy="0" rx="5" ry="6"/><use terminal-index="0" x="0" y="0"/></symbol>"""


def shape_drawing(scale=1.0):
    s = lambda v: v * scale
    circle = lambda h, x, y, r: [(0, "CIRCLE"), (5, h), (8, "W"), (10, s(x)), (20, s(y)), (40, s(r))]
    box = [(0, "LWPOLYLINE"), (5, "C"), (8, "W"), (70, 1), (10, s(2000)), (20, 0), (10, s(2200)), (20, 0), (10, s(2200)), (20, s(80)), (10, s(2000)), (20, s(80))]
    texts = [x for k in range(9) for x in ((0, "TEXT"), (5, f"T{k}"), (8, "NOTE"), (1, f"label {k}"), (10, s(300 * k)), (20, s(5000)), (40, s(100)))] if scale < 0.25 else []
    return pairs(
        (0, "SECTION"), (2, "ENTITIES"), *circle("A", 0, 0, 60), *circle("B", 90, 0, 60), *box, *line(s(2000), s(40), s(2200), s(40), "D"), *texts, (0, "ENDSEC"), (0, "EOF")
    )


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("svg") / "lib.svg"
    path.write_text(LIBRARY)
    rows = svg.read_symbols(spark, str(path))
    none = spark.createDataFrame([], "file string, object_id string, class string, name string")
    counts = spark.createDataFrame([], "file string, object_id string, n int")
    built = templates.build_library(rows.where("record = 'definition'").drop("object_id", "record", "error"), rows.where("record = 'use'").select("file", "symbol_id", "object_id"), none, counts)
    return built.cache()


def test_templates_are_sampled(library):
    found = {r.family: r for r in templates.prepared(library).collect()}
    assert {k: r.supported for k, r in found.items()} == {"PowerTransformer": True, "Fuse": True, "Arrester": True, "Meter": False}
    assert len(found["PowerTransformer"].points) == 192 and found["Fuse"].counts == {"line": 1, "polygon": 1} and len(found["Fuse"].points) == 4 * 32 + 48
    assert len(found["Arrester"].points) == 3 * 32


@pytest.mark.parametrize("scale", [1.0, 0.1])
def test_free_shapes_become_equipment(spark, tmp_path, library, scale):
    """Without any named block, and in a drawing whose texts tell a smaller unit."""
    (tmp_path / "d.dxf").write_text(shape_drawing(scale))
    rows = dxf.read_drawings(spark, str(tmp_path)).cache()
    found = recognise.recognise(rows, library=templates.prepared(library))
    own = {r.physical_type: r for r in found.equipment.collect()}
    assert {k: (r.family, sorted(r.handles), r.source) for k, r in own.items()} == {
        "PowerTransformer": ("PowerTransformer", ["A", "B"], "geometry"), "SwitchCombination": ("Fuse", ["C", "D"], "geometry"),
    }
    assert all(0.5 < r.confidence <= 1 for r in own.values())
    stats = recognise.statistics(rows, found)
    row = stats.first()
    assert (row.accepted_equipment_count, row.equipment_source_counts, row.equipment_type_counts) == (2, "geometry:2", "PowerTransformer:1,SwitchCombination:1")
    assert "| accepted equipment | 2 |" in reports.drawing_report(stats, "d") and recognise.totals(stats).first().drawings == 1
    frame = recognise.render_list(found.segments, found.equipment).where("layer = 'frame'").collect()
    assert len(frame) == 1


def test_group_candidates(spark):
    shape = lambda k, x, kind="polygon": ("d", k, f"e{k}", "LWPOLYLINE", "W", kind, [], [], [(x, 0.0), (x + 50, 50.0)], True, 10.0, x, 0.0, x + 50, 50.0)
    schema = "drawing string, seq long, evidence string, entity string, layer string, kind string, insert_path array<string>, vertices array<string>, points array<struct<x:double,y:double>>, closed boolean, length double, x0 double, y0 double, x1 double, y1 double"
    shapes = spark.createDataFrame([shape(1, 0.0), shape(2, 60.0), shape(3, 1000.0)], schema)
    members = spark.createDataFrame([("d", 1, 1), ("d", 1, 2), ("d", 1, 3)], "drawing string, group long, shape long")
    got = free_geometry.group_candidates(members, shapes).collect()
    # the far shape hangs together with none; the whole is always a candidate
    assert sorted(tuple(r.shapes) for r in got) == [(1,), (1, 2), (1, 2, 3), (2,), (3,)]
    assert {tuple(r.shapes): (r.primitives, r.closed, r.span) for r in got}[(1, 2)] == (2, 2, 110.0)


def test_listings_and_scans(spark, tmp_path):
    for name in ("b.xml", "a.xml", "c.xml"):
        (tmp_path / name).write_text(MODEL, encoding="utf-8")
    (tmp_path / "a.svg").write_text(SYMBOLS)
    (tmp_path / "z.svg").write_bytes(b"\xff\xfe\x00bad")
    assert [r.name for r in files.listing(spark, str(tmp_path), "*.xml", 2).collect()] == ["a.xml", "b.xml"]
    found = files.paired(files.listing(spark, str(tmp_path), "*.svg"), files.listing(spark, str(tmp_path), "*.xml")).collect()
    assert {r.stem: r.right is not None for r in found} == {"a": True, "z": False}
    texts = asset_xml.read_texts(spark, str(tmp_path), most=1)
    objects = {r.object_id: (r["class"], r.name) for r in asset_xml.scanned_objects(texts).collect()}
    assert objects["b1"] == ("Breaker", "10kV 进线 主进") and objects["t5"] == ("Terminal", "") and "f1" not in objects
    assert {r.object_id: r.n for r in asset_xml.scanned_terminals(texts).collect()} == {"b1": 1, "l1": 2, "f1": 2}
    assert asset_xml.read_models(spark, str(tmp_path), "*.xml", 2).select("file").distinct().count() == 2
    errors = svg.read_symbols(spark, str(tmp_path), "*.svg").where("record = 'error'").collect()
    assert [(r.file, r.error.split(":")[0]) for r in errors] == [("z", "UnicodeDecodeError")]


def test_library_reports(spark, tmp_path, library):
    errors = spark.createDataFrame([("x", "ParseError: bad")], "file string, error string")
    reports.template_workbook(tmp_path / "t.xlsx", library, errors, {"drawings": 3})
    import zipfile

    with zipfile.ZipFile(tmp_path / "t.xlsx") as z:
        sheets = [z.read(f"xl/worksheets/sheet{k}.xml").decode() for k in range(1, 5)]
        assert z.testzip() is None
    assert "PowerTransformer:two@0" in sheets[1] and "ParseError: bad" in sheets[3] and "drawings" in sheets[0]
    report = reports.library_report(library, errors, {"drawings": 3})
    assert "| equipment templates | 4 |" in report and "| Fuse | 1 |" in report
    table = spark.createDataFrame([("a", 3), ("b", 9)], "class string, occurrences long")
    assert reports.mining_report("Rules", {"pairs": table}, 1).endswith("| b | 9 |\n")


def test_use_and_metadata_distance():
    far = lambda n: f'<use xlink:href="#A"/>{" " * n}<metadata><cge:PSR_Ref ObjectID="o"/></metadata>'
    assert [r["object_id"] for r in svg.records(far(1200))] == ["o"] and not list(svg.records(far(1201)))
    two = '<use xlink:href="#A"/><use xlink:href="#B"/><metadata><cge:PSR_Ref ObjectID="o"/></metadata><metadata><cge:PSR_Ref ObjectID="p"/></metadata>'
    assert [(r["symbol_id"], r["object_id"]) for r in svg.records(two)] == [("B", "o")]
    named = list(svg.records('<symbol viewBox="0 0 0 2"><rect/></symbol><symbol id="x" viewBox="0,0,0,2"><rect x="1" y="1" width="3" height="1"/></symbol>'))
    assert len(named) == 1 and '"origin":[1.0,0.5],"size":[3.0,0.5]' in named[0]["geometry"]


def test_canonical_units(spark, tmp_path):
    (tmp_path / "d.dxf").write_text(shape_drawing(0.1))
    rows = dxf.read_drawings(spark, str(tmp_path))
    units = recognise.scale_units(rows, recognise.texts_of(rows))
    assert units.first().h == pytest.approx(10)
    radii = [r.radius for r in recognise.in_canonical_units(rows, units).where(F.col("kind") == "CIRCLE").collect()]
    assert radii == pytest.approx([60, 60])
