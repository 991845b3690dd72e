"""More queries: sources by pattern, template sampling, candidate rules, enrichment, provenance and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.bindings import B2, EQUIPMENT, devices, drawings, query, read
from meshwright.functions import geometry as g
from meshwright.operators import inference, matching, text
from meshwright.plans import recognise, templates
from meshwright.sources import asset_xml, svg


@query(r"""SELECT DISTINCT ON (file, object_id) p_brand AS file, 'p' || p_partkey % 50 AS object_id, p_type AS class, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS name
    FROM part ORDER BY file, object_id, p_partkey DESC""")
def objects_by_pattern(spark, sf_dir):
    """A file a brand; the last part of an id is the object."""
    k, kind = F.col("p_partkey"), F.col("p_type")
    one = F.concat(F.lit("<cim:"), kind, F.lit(' rdf:ID="p'), (k % 50).cast("string"), F.lit('">\n<cim:Naming.name>  '), F.col("p_name"), F.lit(" </cim:Naming.name></cim:"), kind, F.lit(">"))
    own = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("file")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), one.alias("t")))).alias("a"))
    return asset_xml.scanned_objects(own.select("file", F.array_join(F.transform("a", lambda x: x["t"]), "\n").alias("text")))


@query("SELECT l_suppkey AS file, 'p' || l_partkey AS object_id, count(*) AS n FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL")
def terminals_by_pattern(spark, sf_dir):
    """A file a supplier; a terminal without equipment counts for nothing."""
    ref = F.when(F.col("l_linenumber") != 3, F.concat(F.lit('<cim:Terminal.ConductingEquipment rdf:resource="#p'), F.col("l_partkey").cast("string"), F.lit('"/>'))).otherwise("")
    one = F.concat(F.lit('<cim:Terminal rdf:ID="t">'), ref, F.lit("</cim:Terminal>"))
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file")).agg(F.array_join(F.collect_list(one), "").alias("text"))
    return asset_xml.scanned_terminals(own)


@query("""WITH t AS (SELECT o_orderkey AS k, ['变压器', '专变', '500kVA变', '#专变柜', '柜', '2#专变 400KVA'][1 + o_orderkey % 6] AS label FROM orders)
    SELECT k, label LIKE '%变%' AND (label LIKE '%kVA%' OR label LIKE '%KVA%' OR label LIKE '%#专%' OR label LIKE '%专变%') AND label NOT LIKE '%柜%' AS names_transformer FROM t""")
def transformer_labels(spark, sf_dir):
    given = F.array(*map(F.lit, ["变压器", "专变", "500kVA变", "#专变柜", "柜", "2#专变 400KVA"]))
    own = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.element_at(given, (1 + F.col("o_orderkey") % 6).cast("int")).alias("label"))
    return own.select("k", text.transformer_label(F.col("label")).alias("names_transformer"))


FAMILIES = ["Breaker", "Disconnector", "Fuse", "PT", "Arrester", "LoadSwitch"]


@query("""WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, ['Breaker', 'Disconnector', 'Fuse', 'PT', 'Arrester', 'LoadSwitch'] AS names FROM lineitem),
    p AS (SELECT k, n, names[1 + k % 6] AS expected, names[1 + (k * 7 + n) % 6] AS actual FROM f)
    SELECT k, n, expected = actual OR (expected = 'Breaker' AND actual IN ('Breaker', 'Disconnector', 'LoadSwitch', 'GroundDisconnector', 'Fuse')) AS compatible FROM p""")
def family_compatibility(spark, sf_dir):
    names, k, n = F.array(*map(F.lit, FAMILIES)), F.col("l_orderkey"), F.col("l_linenumber")
    pick = lambda i: F.element_at(names, (1 + i % 6).cast("int"))
    return read(spark, sf_dir, "lineitem").select(k.alias("k"), n.alias("n"), matching.family_compatible(pick(k), pick(k * 7 + n)).alias("compatible"))


@query("""WITH c AS (SELECT o_custkey AS g, o_orderkey AS k, o_orderkey % 50 AS primitives, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 97) * 20.0::DOUBLE END AS span, 1 + o_orderkey % 2 AS owned, o_orderkey % 3 = 0 AS open_line FROM orders),
    s AS (SELECT * FROM c WHERE primitives <= 24 AND (span IS NULL OR span BETWEEN 20 AND 1200) AND NOT (owned = 1 AND open_line)),
    f AS (SELECT DISTINCT ON (g) * FROM c ORDER BY g, k)
    SELECT g AS "group", k AS candidate FROM s UNION ALL SELECT g, k FROM f WHERE g NOT IN (SELECT g FROM s)""")
def candidate_size_filter(spark, sf_dir):
    k = F.col("o_orderkey")
    own = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("group"), k.alias("candidate"), (k % 50).alias("primitives"), F.when(k % 11 != 0, (k % 97) * F.lit(20.0)).alias("span"), (1 + k % 2).alias("owned"), (k % 3 == 0).alias("open_line")
    )
    first = own.groupBy("group").agg(F.min_by(F.struct(*(c for c in own.columns if c != "group")), "candidate").alias("f")).select("group", "f.*")
    return matching.eligible_candidates(own, first, 12).select("group", "candidate")


@query("""WITH c AS (SELECT o_custkey AS g, o_orderkey AS k, list_sort(list_distinct([o_orderkey % 3, o_orderkey % 2])) AS h, o_orderkey % 2 AS m, o_orderkey % 4 AS n FROM orders),
    d AS (SELECT *, row_number() OVER (PARTITION BY g, h, m, n ORDER BY k) AS f FROM c)
    SELECT g AS "group", k AS seq, row_number() OVER (PARTITION BY g ORDER BY k)::INT AS number FROM d WHERE f = 1""")
def candidate_dedupe(spark, sf_dir):
    k = F.col("o_orderkey")
    own = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("group"), k.alias("seq"), F.array(k % 3, k % 2, k % 3).alias("handles"), (k % 2).alias("mode"), F.create_map(F.lit("line"), k % 4).alias("counts")
    )
    return matching.distinct_candidates(own).select("group", "seq", "number")


@query("SELECT coalesce(max(p_size + p_partkey % 7) FILTER (p_size % 2 = 0), 20) AS largest FROM part")
def largest_template(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    counts = F.create_map(F.lit("line"), size.cast("long"), F.lit("circle"), (k % 7).cast("long"))
    return matching.largest_template(read(spark, sf_dir, "part").select((size % 2 == 0).alias("supported"), counts.alias("counts")))


#: Templates from parts: a line, a circle, a closed outline of three points, or an ellipse alone, by the part's size.
def part_library(spark, sf_dir) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size") % 5
    x = (k % 13).cast("string")
    line = F.concat(F.lit('{"type":"line","start":[0.0,'), x, F.lit('.0],"end":[4.0,1.0]}'))
    circle = F.concat(F.lit('{"type":"circle","center":['), x, F.lit('.0,2.0],"radius":1.5}'))
    shape = F.concat(F.lit('{"type":"polygon","points":[[0.0,0.0],['), x, F.lit('.0,1.0],[2.0,5.0]]}'))
    ellipse = F.lit('{"type":"ellipse","center":[0.0,0.0],"radius":[1.0,2.0]}')
    parts = F.when(size == 0, ellipse).when(size == 1, line).when(size == 2, F.concat_ws(",", line, line, circle)).when(size == 3, shape).otherwise(F.concat_ws(",", ellipse, circle))
    own = F.concat(F.lit('{"primitives":['), parts, F.lit('],"terminals":[],"view_box":[0.0,0.0,1.0,1.0]}'))
    return read(spark, sf_dir, "part").select(k.alias("template_key"), F.col("p_brand").alias("family"), own.alias("geometry"), (k % 10 != 0).alias("is_equipment_template"))


@query("""WITH p AS (SELECT p_partkey AS template, p_size % 5 AS s, p_partkey % 13 AS x FROM part WHERE p_partkey % 10 <> 0)
    SELECT template, s <> 0 AS supported, [0, 48, 192, 96, 96][s + 1] AS samples,
        ['ellipse:1', 'line:1', 'circle:1,line:2', 'polygon:1', 'circle:1,ellipse:1'][s + 1] AS counts, CASE WHEN s = 0 THEN NULL ELSE 1.0::DOUBLE END AS extent FROM p""")
def template_sampling(spark, sf_dir):
    made = templates.prepared(part_library(spark, sf_dir))
    low_x, low_y, high_x, high_y = g.bounds(F.col("points"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    extent = F.when(F.col("supported"), F.round(F.greatest(high_x - low_x, high_y - low_y), 9))
    return made.select("template", "supported", F.size("points").alias("samples"), shown.alias("counts"), extent.alias("extent"))


@query("""WITH e AS (SELECT o_custkey AS drawing, 'E' || o_orderkey % 9 AS evidence, min(o_orderkey) AS k FROM orders GROUP BY ALL),
    t AS (SELECT DISTINCT o_custkey AS drawing, o_orderkey % 4 AS thing FROM orders),
    h AS (SELECT drawing, thing, unnest(['E' || thing, 'E' || (thing + 5), 'none', 'E' || (thing + 1)]) AS evidence, unnest([1, 2, 3, 4]) AS place FROM t)
    SELECT t.drawing, t.thing, coalesce(string_agg(h.evidence || '@L' || e.k % 3 || ':B' || e.k % 2, ',' ORDER BY place) FILTER (e.k IS NOT NULL), '') AS provenance
    FROM t LEFT JOIN h ON h.drawing = t.drawing AND h.thing = t.thing LEFT JOIN e ON e.drawing = h.drawing AND e.evidence = h.evidence GROUP BY t.drawing, t.thing""")
def provenance_lookup(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").withColumn("drawing", F.col("o_custkey"))
    entities = orders.groupBy("drawing", F.concat(F.lit("E"), (k % 9).cast("string")).alias("evidence")).agg(F.min("o_orderkey").alias("k"))
    rows = entities.select(
        "drawing", F.lit("entity").alias("record"), "evidence", F.col("evidence").alias("source_handle"), F.lit("LINE").alias("kind"), F.lit(False).alias("virtual"),
        F.concat(F.lit("L"), (F.col("k") % 3).cast("string")).alias("layer"), F.array(F.concat(F.lit("A1:B"), (F.col("k") % 2).cast("string"))).alias("insert_path"),
    )
    name = lambda n: F.concat(F.lit("E"), n.cast("string"))
    things = orders.select("drawing", (k % 4).alias("thing")).distinct()
    things = things.withColumn("handles", F.array(name(F.col("thing")), name(F.col("thing") + 5), F.lit("none"), name(F.col("thing") + 1)))
    found = recognise.provenance(things, rows)
    shown = F.transform("provenance", lambda p: F.concat(p["evidence"], F.lit("@"), p["layer"], F.lit(":"), F.array_join(p["block_names"], "/")))
    return found.select("drawing", "thing", F.array_join(shown, ",").alias("provenance"))


@query("""SELECT o_custkey AS drawing, 'R' || o_orderkey % 3 AS reason, 'L' || o_orderkey % 2 AS layer, count(*) AS entities, count(*) FILTER (o_orderkey % 5 = 0) AS inserts
    FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL""")
def visibility_exclusions(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("drawing"), F.when(k % 4 == 0, "entity").otherwise("excluded").alias("record"), F.concat(F.lit("R"), (k % 3).cast("string")).alias("reason"),
        F.concat(F.lit("L"), (k % 2).cast("string")).alias("layer"), F.when(k % 5 == 0, "INSERT").otherwise("LINE").alias("kind"),
    )
    return recognise.exclusion_counts(rows)


@query("""WITH t AS (SELECT o_custkey AS drawing, (1 + o_orderkey % 40)::DOUBLE AS height FROM orders),
    m AS (SELECT drawing, count(*) AS n, median(height) AS m FROM t GROUP BY ALL)
    SELECT drawing, CASE WHEN n >= 8 AND m < 25 THEN greatest(m, 1e-6) ELSE 100.0 END::DOUBLE AS h FROM m""")
def drawing_units(spark, sf_dir):
    texts = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("drawing"), (1 + F.col("o_orderkey") % 40).cast("double").alias("height"))
    return recognise.scale_units(texts.select("drawing"), texts)


@query("""WITH s AS (SELECT o_custkey AS drawing, o_orderkey AS equipment, CASE WHEN o_orderkey % 3 = 0 THEN 'SwitchCombination' ELSE 'PT' END AS class FROM orders),
    r AS (SELECT drawing, equipment, class, CASE WHEN class <> 'SwitchCombination' THEN NULL WHEN equipment % 2 = 0 THEN 'BusCouplerOrSectionSwitch' ELSE 'SerialSwitchCombination' END AS role FROM s),
    n AS (SELECT drawing, role, count(*) AS n FROM r GROUP BY ALL)
    SELECT drawing, sum(n)::BIGINT AS equipment_count, coalesce(sum(n) FILTER (role IS NOT NULL), 0)::BIGINT AS switch_count, coalesce(string_agg(role || ':' || n, ',' ORDER BY role) FILTER (role IS NOT NULL), '') AS roles FROM n GROUP BY drawing""")
def switch_enrichment(spark, sf_dir):
    """Switches of an even number have an inferred role; the others are without a node."""
    k = F.col("o_orderkey")
    own = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("drawing"), k.alias("equipment"), F.when(k % 3 == 0, "SwitchCombination").otherwise("PT").alias("class"))
    roles = own.where("equipment % 2 = 0").select("drawing", "equipment", F.lit("BusCouplerOrSectionSwitch").alias("functional_role"), F.lit(0.78).alias("confidence"), F.lit(False).alias("conflict"))
    return inference.role_summary(inference.enriched(own, roles, ["drawing"]), ["drawing"])


@query(f"""WITH {B2}, {EQUIPMENT}, r AS (SELECT d AS drawing, 'segment' AS layer, k::VARCHAR AS item, x1 AS x0, y1 AS y0, x2 AS x1, y2 AS y1 FROM seg
        UNION ALL SELECT d, 'box', equipment::VARCHAR, x0, y0, x1, y1 FROM eqp),
    f AS (SELECT drawing, min(least(x0, x1)) AS a, min(least(y0, y1)) AS b, max(greatest(x0, x1)) AS c, max(greatest(y0, y1)) AS e FROM r GROUP BY drawing)
    SELECT drawing, layer, item, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM r
    UNION ALL SELECT drawing, 'frame', '', round(a - (c - a) * 0.08, 6), round(b - (e - b) * 0.08, 6), round(c + (c - a) * 0.08, 6), round(e + (e - b) * 0.08, 6) FROM f""")
def overlay_render_list(spark, sf_dir):
    made = recognise.render_list(drawings(spark, sf_dir), devices(spark, sf_dir))
    return made.withColumns({c: F.round(c, 6) for c in ("x0", "y0", "x1", "y1")})


@query("""SELECT DISTINCT ON (page_id) page_id, sha256(g) AS signature FROM (SELECT page_id, '{"primitives":[],"terminals":[],"view_box":[0.0,0.0,' || page_id % 9 || '.0,1.0]}' AS g FROM pages)""")
def geometry_signature(spark, sf_dir):
    text_of = F.concat(F.lit('{"primitives":[],"terminals":[],"view_box":[0.0,0.0,'), (F.col("page_id") % 9).cast("string"), F.lit(".0,1.0]}"))
    return svg.signature(read(spark, sf_dir, "pages").select("page_id", text_of.alias("geometry"))).select("page_id", "signature")


