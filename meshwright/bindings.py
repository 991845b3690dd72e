"""The queries: each operator bound to the driver's tables, and the same in SQL.

Bindings: B1, an asset model from order lines; B2, drawings of segments from orders; B3, point clouds from
embeddings; B4, intervals from events; B5, markup symbols from pages; B6, keyword rules over texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.functions import geometry as g
from meshwright.operators import conductors as c
from meshwright.operators import graph, inference, intervals, keys, matching, spatial, text
from meshwright.plans import asset_model as am
from meshwright.plans import recognise, templates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with its SQL counterpart if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- B1: asset models -------------------------------------------------------------------------------------

#: What the part types stand for in the bound model.
CLASSES = am.Classes(switches=["SMALL", "MEDIUM"], connectors=["ECONOMY"], structural=["STANDARD"], busbars=["ECONOMY"], lines=[])

B1 = """
    term AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS file, l_orderkey AS node, l_partkey AS eq, p_type AS class,
                    min(l_linenumber) AS seq, count(*) AS n_lines
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    edge AS (SELECT a.file, a.node AS u, b.node AS v FROM term a JOIN term b
             ON a.file = b.file AND a.eq = b.eq AND a.class = 'ECONOMY' AND a.node <> b.node),
    reach(file, node, root) AS (SELECT DISTINCT file, node, node FROM term
             UNION SELECT r.file, r.node, e.v FROM reach r JOIN edge e ON e.file = r.file AND e.u = r.root),
    comp AS (SELECT file, node, min(root) AS root FROM reach GROUP BY file, node),
    bound AS (SELECT DISTINCT file, root, eq, class FROM term JOIN comp USING (file, node) WHERE class NOT IN ('ECONOMY', 'STANDARD')),
    conn AS (SELECT file, root, class, count(DISTINCT eq) AS n FROM term JOIN comp USING (file, node) WHERE class = 'ECONOMY' GROUP BY ALL),
    side AS (SELECT t.file, t.eq, t.class, t.node, t.seq, k.root,
                coalesce((SELECT string_agg(h.class || ':' || h.n, ',' ORDER BY h.class) FROM
                   (SELECT b.class, count(*) AS n FROM bound b WHERE b.file = t.file AND b.root = k.root AND b.eq <> t.eq GROUP BY b.class) h), '') || '|' ||
                coalesce((SELECT string_agg(x.class || ':' || x.n, ',' ORDER BY x.class) FROM conn x WHERE x.file = t.file AND x.root = k.root), '') AS s
             FROM term t JOIN comp k USING (file, node) WHERE t.class IN ('SMALL', 'MEDIUM')),
    serial AS (SELECT file, root FROM bound GROUP BY ALL HAVING count(*) = 2 AND count(*) FILTER (class IN ('SMALL', 'MEDIUM')) = 2)
"""
GRADE = """CASE WHEN occurrences >= 100 AND file_count >= 20 THEN 'high'
                WHEN occurrences >= 20 AND file_count >= 5 THEN 'medium' ELSE 'exploratory' END AS evidence_grade"""


def asset_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(objects, terminals): files are months, nodes orders, equipment parts within a file."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("file"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("class"), F.col("p_name").alias("name"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    terminals = joined.groupBy("file", F.col("l_orderkey").alias("node_id"), F.col("l_partkey").alias("equipment_id")).agg(F.min("l_linenumber").alias("sequence"))
    terminals = terminals.withColumn("terminal_id", F.col("node_id"))
    used = terminals.select("file", F.col("equipment_id").alias("object_id")).distinct()
    return used.join(parts, F.col("object_id") == F.col("p_partkey")).drop("p_partkey"), terminals


def _members(spark, sf_dir):
    objects, terminals = asset_model(spark, sf_dir)
    return objects, terminals, am.cut(am.members(objects, terminals))


def _described(spark, sf_dir):
    objects, terminals, own = _members(spark, sf_dir)
    roots = am.cut(am.contracted_nodes(own, CLASSES))
    bounds = am.cut(am.boundaries(own, roots, CLASSES))
    sides = am.equipment_roots(objects.where(F.col("class").isin(*CLASSES.switches)), terminals, roots)
    return objects, bounds, am.side_descriptors(sides, bounds, am.connector_counts(own, roots, CLASSES), CLASSES)


@query(f"""WITH m AS (SELECT DISTINCT year(o_orderdate) * 100 + month(o_orderdate) AS file, l_orderkey AS node, l_partkey AS eq, p_type AS class
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_type <> 'STANDARD'),
    p AS (SELECT least(a.class, b.class) AS class_a, greatest(a.class, b.class) AS class_b, a.file FROM m a JOIN m b ON a.file = b.file AND a.node = b.node AND a.eq < b.eq),
    n AS (SELECT class_a, class_b, count(*) AS occurrences, count(DISTINCT file) AS file_count FROM p GROUP BY ALL)
    SELECT *, {GRADE} FROM n WHERE occurrences >= 5 AND file_count >= 3""")
def relation_mining_direct(spark, sf_dir):
    return am.direct_relations(am.members(*asset_model(spark, sf_dir)), CLASSES)


@query(f"""WITH RECURSIVE {B1}, p AS (SELECT least(a.class, b.class) AS class_a, greatest(a.class, b.class) AS class_b, a.file
        FROM bound a JOIN bound b ON a.file = b.file AND a.root = b.root AND a.eq < b.eq),
    n AS (SELECT class_a, class_b, count(*) AS occurrences, count(DISTINCT file) AS file_count FROM p GROUP BY ALL)
    SELECT *, {GRADE} FROM n WHERE occurrences >= 5 AND file_count >= 3""")
def relation_mining_contracted(spark, sf_dir):
    _, _, own = _members(spark, sf_dir)
    return am.contracted_relations(am.boundaries(own, am.contracted_nodes(own, CLASSES), CLASSES))


@query(f"""WITH RECURSIVE {B1}, p AS (SELECT min(b.class) AS switch_class_a, max(b.class) AS switch_class_b, b.file FROM bound b JOIN serial USING (file, root) GROUP BY b.file, b.root),
    n AS (SELECT switch_class_a, switch_class_b, count(*) AS occurrences, count(DISTINCT file) AS file_count FROM p GROUP BY ALL)
    SELECT *, {GRADE} FROM n WHERE occurrences >= 5 AND file_count >= 3""")
def serial_pair_mining(spark, sf_dir):
    _, _, own = _members(spark, sf_dir)
    bounds = am.cut(am.boundaries(own, am.contracted_nodes(own, CLASSES), CLASSES))
    return am.serial_patterns(bounds, CLASSES)


@query(f"""WITH RECURSIVE {B1},
    m AS (SELECT s.file, x.root AS shared, s.eq, s.class || '[' || coalesce(string_agg(s.s, ' / ' ORDER BY s.seq, s.node) FILTER (s.root <> x.root), '') || ']' AS m
          FROM side s JOIN (SELECT DISTINCT z.file, z.root, q.eq FROM serial z JOIN side q ON q.file = z.file AND q.root = z.root) x
            ON x.file = s.file AND x.eq = s.eq GROUP BY s.file, x.root, s.eq, s.class),
    k AS (SELECT file, string_agg(m, ' + ' ORDER BY m) AS switch_members FROM m GROUP BY file, shared),
    n AS (SELECT switch_members, count(*) AS occurrences, count(DISTINCT file) AS file_count FROM k GROUP BY ALL)
    SELECT *, {GRADE} FROM n WHERE occurrences >= 2 AND file_count >= 2""")
def serial_context_mining(spark, sf_dir):
    _, bounds, described = _described(spark, sf_dir)
    return am.serial_contexts(am.cut(described), am.serial_roots(bounds, CLASSES), 2, 2)


@query(f"""WITH RECURSIVE {B1}, k AS (SELECT file, eq, class AS switch_class, string_agg(s, ' / ' ORDER BY s) AS terminal_sides FROM side GROUP BY ALL),
    n AS (SELECT switch_class, terminal_sides, count(*) AS occurrences, count(DISTINCT file) AS file_count FROM k GROUP BY ALL)
    SELECT *, {GRADE} FROM n WHERE occurrences >= 5 AND file_count >= 3""")
def switch_context_mining(spark, sf_dir):
    return am.switch_contexts(_described(spark, sf_dir)[2])


@query(f"""WITH RECURSIVE {B1}, k AS (SELECT DISTINCT s.file, s.eq, s.class AS switch_class, b.class AS neighbor_class FROM side s JOIN bound b ON b.file = s.file AND b.root = s.root AND b.eq <> s.eq),
    n AS (SELECT switch_class, neighbor_class, count(*) AS occurrences, count(DISTINCT file) AS file_count FROM k GROUP BY ALL),
    i AS (SELECT class AS switch_class, count(DISTINCT (file, eq)) AS switch_instance_count FROM term GROUP BY ALL)
    SELECT n.*, {GRADE}, switch_instance_count, round(occurrences / switch_instance_count, 6) AS conditional_support
    FROM n JOIN i USING (switch_class) WHERE occurrences >= 5 AND file_count >= 3""")
def switch_neighbor_support(spark, sf_dir):
    objects, _, described = _described(spark, sf_dir)
    return am.switch_neighbors(described, objects)


#: Roles by words of the part names.
PART_ROLES = [("fastener", "bolt|nut|screw"), ("moving", "gear|ring"), ("hot_part", "^hot"), ("any_widget", "widget")]


@query(f"""WITH o AS (SELECT DISTINCT year(o_orderdate) * 100 + month(o_orderdate) AS file, l_partkey AS eq, p_type AS equipment_class, p_name
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_type IN ('SMALL', 'MEDIUM')),
    r(role, pattern) AS (VALUES ('fastener', 'bolt|nut|screw'), ('moving', 'gear|ring'), ('hot_part', '^hot'), ('any_widget', 'widget')),
    n AS (SELECT equipment_class, role, 'equipment_name_keyword' AS label_source, count(*) AS occurrences, count(DISTINCT file) AS file_count
          FROM o JOIN r ON regexp_matches(p_name, pattern) GROUP BY ALL)
    SELECT *, {GRADE} FROM n""")
def role_keyword_evidence(spark, sf_dir):
    objects, _ = asset_model(spark, sf_dir)
    return am.role_evidence(objects, CLASSES, PART_ROLES)


@query(f"""WITH RECURSIVE {B1}, t AS (SELECT class, file, eq, count(*) AS t FROM term GROUP BY ALL), h AS (SELECT class, t, count(*) AS n FROM t GROUP BY ALL)
    SELECT class, sum(n)::BIGINT AS instances, string_agg(t || ':' || n, ',' ORDER BY t) AS terminal_counts FROM h GROUP BY class""")
def class_terminal_histogram(spark, sf_dir):
    return am.class_histogram(*asset_model(spark, sf_dir))


@query(f"WITH RECURSIVE {B1} SELECT file, node AS node_id, root FROM comp")
def connected_components_contracted(spark, sf_dir):
    return am.contracted_nodes(_members(spark, sf_dir)[2], CLASSES)


@query(f"""WITH RECURSIVE {B1}, f AS (SELECT file, root, class, count(*) AS n FROM bound GROUP BY ALL),
    a AS (SELECT file, root, sum(n)::BIGINT AS functional, string_agg(class || ':' || n, ',' ORDER BY class) AS functional_classes FROM f GROUP BY ALL),
    k AS (SELECT file, root, string_agg(class || ':' || n, ',' ORDER BY class) AS connectors FROM conn GROUP BY ALL)
    SELECT r.file, r.root, coalesce(functional, 0) AS functional, coalesce(functional_classes, '') AS functional_classes, coalesce(connectors, '') AS connectors
    FROM (SELECT DISTINCT file, root FROM comp) r LEFT JOIN a USING (file, root) LEFT JOIN k USING (file, root)""")
def component_boundary_histogram(spark, sf_dir):
    _, _, own = _members(spark, sf_dir)
    return am.component_summary(own, am.cut(am.contracted_nodes(own, CLASSES)), CLASSES)


@query(f"""WITH RECURSIVE {B1} SELECT t.file, t.eq AS equipment_id, string_agg(root::VARCHAR, ',' ORDER BY seq, node) AS roots
    FROM term t JOIN comp USING (file, node) GROUP BY ALL""")
def equipment_roots_ordered(spark, sf_dir):
    objects, terminals, own = _members(spark, sf_dir)
    rooted = am.equipment_roots(objects, terminals, am.contracted_nodes(own, CLASSES))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "root"))), lambda x: x["root"].cast("string"))
    return rooted.groupBy("file", "equipment_id").agg(F.array_join(ordered, ",").alias("roots"))


NODE_SQL = f"""h AS (SELECT file, node, class, count(*) AS n FROM term GROUP BY ALL),
    ctx AS (SELECT file, node, sum(n)::BIGINT AS members, coalesce(sum(n) FILTER (class IN ('SMALL')), 0)::BIGINT AS switches,
            string_agg(class || ':' || n, ',' ORDER BY class) AS classes,
            sum(n) >= 3 OR coalesce(sum(n) FILTER (class IN ('SMALL')), 0) >= 2 AS busbar_like FROM h GROUP BY ALL)"""


def _node_members(spark, sf_dir):
    return am.members(*asset_model(spark, sf_dir)).select("file", F.col("node_id").alias("node"), F.col("equipment_id").alias("equipment"), "class")


@query(f"WITH RECURSIVE {B1}, {NODE_SQL} SELECT * FROM ctx")
def node_context_busbar(spark, sf_dir):
    return inference.node_contexts(_node_members(spark, sf_dir), ["file"], "SMALL")


@query(f"""WITH RECURSIVE {B1}, {NODE_SQL},
    s AS (SELECT t.file, t.eq, x.busbar_like AS bus,
            EXISTS (SELECT 1 FROM h WHERE h.file = t.file AND h.node = t.node AND h.class = 'LARGE') AS tr,
            EXISTS (SELECT 1 FROM h WHERE h.file = t.file AND h.node = t.node AND h.class = 'PROMO') AS pt,
            EXISTS (SELECT 1 FROM h WHERE h.file = t.file AND h.node = t.node AND h.class = 'ECONOMY') AS ca
          FROM term t JOIN ctx x USING (file, node) WHERE t.class = 'SMALL'),
    r AS (SELECT file, eq, sum(bus::INT) AS buses, bool_or(NOT bus AND tr) AS tr, bool_or(NOT bus AND pt) AS pt, bool_or(NOT bus AND ca) AS ca FROM s GROUP BY ALL),
    l AS (SELECT file, eq, list_filter([CASE WHEN tr THEN 'TransformerHVFeederOrProtectionSwitch' END, CASE WHEN pt THEN 'PTIsolationOrProtectionSwitch' END,
            CASE WHEN buses >= 1 AND ca THEN 'IncomingOrOutgoingFeederSwitch' END, CASE WHEN buses >= 2 THEN 'BusCouplerOrSectionSwitch' END], lambda x: x IS NOT NULL) AS roles FROM r),
    k AS (SELECT file, eq, CASE WHEN len(roles) = 0 THEN ['SerialSwitchCombination'] ELSE roles END AS roles FROM l)
    SELECT file, eq AS equipment, roles[1] AS functional_role,
        CASE roles[1] WHEN 'TransformerHVFeederOrProtectionSwitch' THEN 0.9 WHEN 'PTIsolationOrProtectionSwitch' THEN 0.86
             WHEN 'IncomingOrOutgoingFeederSwitch' THEN 0.8 WHEN 'BusCouplerOrSectionSwitch' THEN 0.78 ELSE 0.62 END::DOUBLE AS confidence,
        array_to_string(roles, ',') AS roles, len(roles) > 1 AS conflict FROM k""")
def switch_role_inference(spark, sf_dir):
    return inference.switch_roles(_node_members(spark, sf_dir), ["file"], "SMALL", ("LARGE",), ("PROMO",), ("ECONOMY",))


@query(r"""WITH p AS (SELECT p_type AS a, 'Breaker' AS b, count(*) AS occurrences FROM part GROUP BY ALL UNION ALL
        SELECT p_type, p_brand, count(*) FROM part GROUP BY ALL),
    m AS (SELECT max(occurrences) AS most FROM p),
    s AS (SELECT s_suppkey AS equipment, CASE WHEN s_nationkey % 3 = 0 THEN 'Breaker:1 Disconnector:2' ELSE 'Fuse:1' END AS templates FROM supplier),
    c AS (SELECT equipment, least(a, b) || '+' || greatest(a, b) AS name,
            round(0.65 * CASE WHEN templates LIKE '%Breaker%' AND templates LIKE '%Disconnector%' THEN 1.0 WHEN a = 'Breaker' OR b = 'Breaker' THEN 0.35 ELSE 0.05 END
                  + 0.35 * (ln(1 + occurrences::DOUBLE) / ln(1 + most::DOUBLE)), 6) AS score, occurrences FROM s, p, m),
    r AS (SELECT *, row_number() OVER (PARTITION BY equipment ORDER BY score DESC, occurrences DESC, name) AS rank FROM c)
    SELECT equipment, name, score, occurrences, rank::INT AS rank FROM r WHERE rank <= 5""")
def physical_candidates_topk(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    a = part.groupBy(F.col("p_type").alias("class_a")).agg(F.count("*").alias("occurrences")).withColumn("class_b", F.lit("Breaker"))
    b = part.groupBy(F.col("p_type").alias("class_a"), F.col("p_brand").alias("class_b")).agg(F.count("*").alias("occurrences"))
    templates = F.when(F.col("s_nationkey") % 3 == 0, "Breaker:1 Disconnector:2").otherwise("Fuse:1")
    switches = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("equipment"), templates.alias("templates"))
    return inference.physical_candidates(switches, a.unionByName(b))


@query(f"""WITH RECURSIVE {B1}, k AS (SELECT DISTINCT s.file, s.eq, s.class AS switch_class, b.class AS neighbor_class FROM side s JOIN bound b ON b.file = s.file AND b.root = s.root AND b.eq <> s.eq),
    n AS (SELECT switch_class, neighbor_class, count(*) AS occurrences, count(DISTINCT file) AS file_count FROM k GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT file) >= 3),
    r(rule_id, functional_role, s, b) AS (VALUES ('R1', 'HV', 'SMALL', 'LARGE'), ('R1', 'HV', 'MEDIUM', 'LARGE'), ('R2', 'FEEDER', NULL, 'PROMO'), ('R3', 'COUPLER', NULL, NULL))
    SELECT rule_id, functional_role, switch_class, neighbor_class, occurrences, file_count, CASE WHEN occurrences IS NULL THEN NULL
           WHEN occurrences >= 100 AND file_count >= 20 THEN 'high' WHEN occurrences >= 20 AND file_count >= 5 THEN 'medium' ELSE 'exploratory' END AS evidence_grade
    FROM r LEFT JOIN n ON r.b = n.neighbor_class AND (r.s IS NULL OR r.s = n.switch_class)""")
def engineering_rule_evidence(spark, sf_dir):
    objects, _, described = _described(spark, sf_dir)
    rules = [("R1", ["SMALL", "MEDIUM"], ["LARGE"], "HV"), ("R2", None, ["PROMO"], "FEEDER"), ("R3", [], [], "COUPLER")]
    return am.rule_evidence(am.switch_neighbors(described, objects), rules)


@query(f"""WITH n AS (SELECT p_type, p_brand, count(*) AS occurrences, count(DISTINCT year(o_orderdate) * 100 + month(o_orderdate)) AS file_count
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT *, {GRADE} FROM n WHERE occurrences >= 5 AND file_count >= 3""")
def evidence_grade_having(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("file"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return keys.keyed_counts(joined, ["p_type", "p_brand"], at_least=5, files_at_least=3)


# --- B2: drawings of segments -----------------------------------------------------------------------------

B2 = """
    seg AS (SELECT o_custkey AS d, o_orderkey AS k, (o_orderkey * 37) % 16 * 50.0::DOUBLE AS x1, (o_orderkey * 53) % 17 * 50.0::DOUBLE AS y1,
                (o_orderkey * 37) % 16 * 50.0::DOUBLE + CASE WHEN o_orderkey % 2 = 0 THEN 150 + (o_orderkey % 9) * 50 ELSE 0 END AS x2,
                (o_orderkey * 53) % 17 * 50.0::DOUBLE + CASE WHEN o_orderkey % 2 = 1 THEN 150 + (o_orderkey % 9) * 50 ELSE 0 END AS y2 FROM orders),
    met AS (SELECT a.d, a.k AS l, b.k AS r, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
                a.k % 2 = b.k % 2 AS parallel FROM seg a JOIN seg b ON a.d = b.d AND a.k < b.k
            WHERE a.x1 - 25 <= b.x2 AND b.x1 - 25 <= a.x2 AND a.y1 - 25 <= b.y2 AND b.y1 - 25 <= a.y2),
    ends AS (SELECT *, list_sort([
            {'g': sqrt((ax1 - bx1) ** 2 + (ay1 - by1) ** 2), 'ax': ax1, 'ay': ay1, 'bx': bx1, 'by': by1}, {'g': sqrt((ax1 - bx2) ** 2 + (ay1 - by2) ** 2), 'ax': ax1, 'ay': ay1, 'bx': bx2, 'by': by2},
            {'g': sqrt((ax2 - bx1) ** 2 + (ay2 - by1) ** 2), 'ax': ax2, 'ay': ay2, 'bx': bx1, 'by': by1}, {'g': sqrt((ax2 - bx2) ** 2 + (ay2 - by2) ** 2), 'ax': ax2, 'ay': ay2, 'bx': bx2, 'by': by2}])[1] AS e,
            CASE WHEN ax1 = ax2 THEN ax1 ELSE bx1 END AS cx, CASE WHEN ay1 = ay2 THEN ay1 ELSE by1 END AS cy FROM met),
    kinds AS (SELECT d, l, r, e, cx, cy, CASE
            WHEN e.g <= 10 THEN 'endpoint_connection'
            WHEN parallel THEN CASE WHEN (ay1 = ay2 AND abs(ay1 - by1) <= 10 AND greatest(0, bx1 - ax1) <= least(ax2 - ax1, bx2 - ax1) + 10)
                                      OR (ax1 = ax2 AND abs(ax1 - bx1) <= 10 AND greatest(0, by1 - ay1) <= least(ay2 - ay1, by2 - ay1) + 10) THEN 'collinear' END
            WHEN cx BETWEEN ax1 - 25 AND ax2 + 25 AND cy BETWEEN ay1 - 25 AND ay2 + 25 AND cx BETWEEN bx1 - 25 AND bx2 + 25 AND cy BETWEEN by1 - 25 AND by2 + 25
              THEN CASE WHEN least(abs(cx - ax1) + abs(cy - ay1), abs(cx - ax2) + abs(cy - ay2), abs(cx - bx1) + abs(cy - by1), abs(cx - bx2) + abs(cy - by2)) <= 25 THEN 't_junction'
                        WHEN (cx / 50 + cy / 50)::BIGINT % 3 = 0 THEN 'x_connected' ELSE 'x_not_connected' END END AS kind FROM ends),
    ev AS (SELECT d AS drawing, l AS "left", r AS "right", kind,
            CASE kind WHEN 'endpoint_connection' THEN (e.ax + e.bx) / 2 WHEN 'collinear' THEN NULL ELSE cx END AS x,
            CASE kind WHEN 'endpoint_connection' THEN (e.ay + e.by) / 2 WHEN 'collinear' THEN NULL ELSE cy END AS y FROM kinds WHERE kind IS NOT NULL)
"""
FIRST_EVENTS = """fe AS (SELECT DISTINCT ON (drawing, kind, round_even(x / 0.5, 0), round_even(y / 0.5, 0)) *, CASE kind WHEN 'x_not_connected' THEN 'not_connected' ELSE 'connected' END AS state
            FROM ev WHERE x IS NOT NULL ORDER BY drawing, kind, round_even(x / 0.5, 0), round_even(y / 0.5, 0), "left", "right")"""
COMPONENTS = """nx AS (SELECT drawing, "left" AS u, "right" AS v FROM ev WHERE kind <> 'x_not_connected' UNION SELECT drawing, "right", "left" FROM ev WHERE kind <> 'x_not_connected'),
    rch(drawing, segment, root) AS (SELECT d, k, k FROM seg UNION SELECT q.drawing, q.segment, n.v FROM rch q JOIN nx n ON n.drawing = q.drawing AND n.u = q.root),
    cmp AS (SELECT drawing, segment, min(root) AS root FROM rch GROUP BY ALL)"""
EQUIPMENT = """eqp AS (SELECT o_custkey AS d, o_orderkey AS equipment, (o_orderkey * 29) % 16 * 50.0::DOUBLE + 30 - (20 + (o_orderkey % 3) * 10) AS x0, (o_orderkey * 41) % 17 * 50.0::DOUBLE + 35 - (15 + (o_orderkey % 4) * 5) AS y0,
            (o_orderkey * 29) % 16 * 50.0::DOUBLE + 30 + (20 + (o_orderkey % 3) * 10) AS x1, (o_orderkey * 41) % 17 * 50.0::DOUBLE + 35 + (15 + (o_orderkey % 4) * 5) AS y1,
            1 + o_orderkey % 4 AS terminal_count FROM orders WHERE o_orderkey % 5 = 0)"""
NEAREST = """prt AS (SELECT d, equipment, unnest([0, 1, 2, 3]) AS port, unnest([(x0 + x1) / 2, (x0 + x1) / 2, x0, x1]) AS px, unnest([y1, y0, (y0 + y1) / 2, (y0 + y1) / 2]) AS py FROM eqp),
    gap AS (SELECT p.*, s.k AS segment, greatest(s.x1, least(s.x2, px)) AS qx, greatest(s.y1, least(s.y2, py)) AS qy,
            sqrt((px - greatest(s.x1, least(s.x2, px))) ** 2 + (py - greatest(s.y1, least(s.y2, py))) ** 2) AS gap FROM prt p JOIN seg s USING (d)),
    near AS (SELECT DISTINCT ON (d, equipment, port) * FROM gap ORDER BY d, equipment, port, gap, segment),
    cnt AS (SELECT d, count(*) AS lines FROM seg GROUP BY d),
    one AS (SELECT *, row_number() OVER (PARTITION BY d, equipment, segment ORDER BY gap, port) AS f FROM near JOIN cnt USING (d)),
    rnk AS (SELECT *, row_number() OVER (PARTITION BY d, equipment ORDER BY gap, port) AS rank FROM one WHERE f = 1 OR lines = 1),
    trm AS (SELECT rnk.d AS drawing, rnk.equipment, port, px, py, segment, round(gap, 6) AS gap, round(qx, 6) AS qx, round(qy, 6) AS qy, rank,
            CASE WHEN gap > 200 THEN 'too_far' WHEN gap <= 20 THEN 'high' ELSE 'review' END AS confidence
            FROM rnk JOIN eqp ON eqp.d = rnk.d AND eqp.equipment = rnk.equipment WHERE rank <= terminal_count)"""
NODES = """nod AS (SELECT t.drawing, k.root, list_sort(list_distinct(list(t.equipment))) AS equipment, count(*) AS terminals FROM trm t JOIN cmp k USING (drawing, segment) WHERE confidence <> 'too_far' GROUP BY ALL),
    hnd AS (SELECT drawing, root, list_sort(list(segment)) AS handles FROM cmp GROUP BY ALL)"""


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing a customer, a segment an order, along an axis, on a grid of 50; H is 100."""
    k = F.col("o_orderkey")
    x, y, size = (k * 37) % 16 * 50.0, (k * 53) % 17 * 50.0, 150 + (k % 9) * 50
    flat = k % 2 == 0
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("drawing"), k.alias("segment"), k.alias("evidence"), x.alias("x1"), y.alias("y1"),
        (x + F.when(flat, size).otherwise(0)).alias("x2"), (y + F.when(flat, 0).otherwise(size)).alias("y2"),
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth order also stands for a device: in the bound drawings lines outnumber devices, as they do in real ones."""
    k = F.col("o_orderkey")
    x, y = (k * 29) % 16 * 50.0 + 30, (k * 41) % 17 * 50.0 + 35
    w, h = 20 + (k % 3) * 10, 15 + (k % 4) * 5
    return read(spark, sf_dir, "orders").where(k % 5 == 0).select(
        F.col("o_custkey").alias("drawing"), k.alias("equipment"), (x - w).alias("x0"), (y - h).alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"),
        (1 + k % 4).alias("terminal_count"),
    )


def _dot():
    """A crossing has a dot where its grid numbers sum to a multiple of three."""
    return (F.col("x") / 50 + F.col("y") / 50).cast("long") % 3 == 0


def _events(spark, sf_dir):
    return c.pair_events(drawings(spark, sf_dir), marked=_dot())


@query(f"""WITH {B2} SELECT d AS drawing, k AS segment, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS length, y1 = y2 AS horizontal, x1 = x2 AS vertical,
    least(x1, x2) AS x0, least(y1, y2) AS y0, greatest(x1, x2) AS bx1, greatest(y1, y2) AS by1 FROM seg""")
def segment_properties(spark, sf_dir):
    return c.with_properties(drawings(spark, sf_dir)).drop("evidence", "x1", "y1", "x2", "y2")


@query(f"""WITH {B2} SELECT DISTINCT ON (d, x1, y1, x2, y2) d AS drawing, k AS segment, x1, y1, x2, y2 FROM seg ORDER BY d, x1, y1, x2, y2, k""")
def segment_dedupe_first_wins(spark, sf_dir):
    return c.dedupe_segments(drawings(spark, sf_dir)).drop("evidence")


@query(f'WITH {B2} SELECT * FROM ev')
def segment_pair_events(spark, sf_dir):
    return _events(spark, sf_dir).drop("left_evidence", "right_evidence", "joined")


@query(f'WITH {B2}, {FIRST_EVENTS} SELECT * FROM fe')
def events_dedupe(spark, sf_dir):
    return c.distinct_events(_events(spark, sf_dir)).select("drawing", "left", "right", "kind", "x", "y", "state")


@query(f"WITH RECURSIVE {B2}, {COMPONENTS} SELECT * FROM cmp")
def conductor_components(spark, sf_dir):
    lines = drawings(spark, sf_dir)
    return c.conductor_components(lines, _events(spark, sf_dir))


@query(f"""WITH {B2}, {FIRST_EVENTS}, q AS (SELECT *, round_even(x / 2, 0) AS qx, round_even(y / 2, 0) AS qy,
        CASE kind WHEN 't_junction' THEN 5 WHEN 'endpoint_connection' THEN 4 WHEN 'x_connected' THEN 3 ELSE 1 END AS p FROM fe),
    b AS (SELECT DISTINCT ON (drawing, qx, qy) drawing, qx, qy, kind, x, y FROM q ORDER BY drawing, qx, qy, p DESC, state = 'connected' DESC, "left", "right"),
    m AS (SELECT drawing, qx, qy, list_sort(list_distinct(flatten(list(["left", "right"])))) AS handles, list_sort(list_distinct(list(kind))) AS raw_kinds, list_sort(list_distinct(list(state))) AS raw_states FROM q GROUP BY ALL)
    SELECT b.drawing, kind, x, y, CASE WHEN list_contains(raw_states, 'connected') THEN 'connected' ELSE 'not_connected' END AS state,
        array_to_string(handles, ',') AS handles, array_to_string(raw_kinds, ',') AS raw_kinds, array_to_string(raw_states, ',') AS raw_states, len(raw_states) > 1 AS conflict
    FROM b JOIN m USING (drawing, qx, qy)""")
def conflict_merge_priority(spark, sf_dir):
    merged = c.merge_events(c.distinct_events(_events(spark, sf_dir)))
    as_text = {n: F.array_join(F.transform(n, lambda v: v.cast("string")), ",") for n in ("handles", "raw_kinds", "raw_states")}
    return merged.withColumns(as_text)


@query(f"WITH {B2}, {EQUIPMENT}, {NEAREST} SELECT d AS drawing, equipment, port, px, py, segment, round(gap, 6) AS gap, round(qx, 6) AS qx, round(qy, 6) AS qy FROM near")
def port_nearest_segment(spark, sf_dir):
    return c.nearest_segments(devices(spark, sf_dir), drawings(spark, sf_dir)).withColumns({n: F.round(n, 6) for n in ("gap", "qx", "qy")})


def _terminals(spark, sf_dir):
    return c.attach_terminals(devices(spark, sf_dir), drawings(spark, sf_dir))


@query(f"WITH {B2}, {EQUIPMENT}, {NEAREST} SELECT * REPLACE (rank::INT AS rank) FROM trm")
def terminal_selection(spark, sf_dir):
    return _terminals(spark, sf_dir).withColumns({n: F.round(n, 6) for n in ("gap", "qx", "qy")})


def _nodes(spark, sf_dir):
    lines = drawings(spark, sf_dir)
    return c.connectivity(am.cut(_terminals(spark, sf_dir)), am.cut(c.conductor_components(lines, _events(spark, sf_dir))), lines)


@query(f"""WITH RECURSIVE {B2}, {EQUIPMENT}, {NEAREST}, {COMPONENTS}, {NODES}
    SELECT drawing, root, array_to_string(equipment, ',') AS equipment, terminals, array_to_string(handles, ',') AS handles FROM nod JOIN hnd USING (drawing, root)""")
def connectivity_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).withColumns({n: F.array_join(F.transform(n, lambda v: v.cast("string")), ",") for n in ("equipment", "handles")})


@query(f"""WITH RECURSIVE {B2}, {EQUIPMENT}, {NEAREST}, {COMPONENTS}, {NODES}, u AS (SELECT drawing, root, unnest(equipment) AS e FROM nod)
    SELECT a.drawing, a.root, a.e AS source, b.e AS target FROM u a JOIN u b ON a.drawing = b.drawing AND a.root = b.root AND a.e < b.e""")
def node_edges(spark, sf_dir):
    return c.device_edges(_nodes(spark, sf_dir))


@query(f"""WITH RECURSIVE {B2}, {FIRST_EVENTS}, {EQUIPMENT}, {NEAREST}, {COMPONENTS}, {NODES}, live AS (SELECT DISTINCT n.drawing, unnest(handles) AS handle FROM nod n JOIN hnd USING (drawing, root))
    SELECT fe.* FROM fe WHERE EXISTS (SELECT 1 FROM live v WHERE v.drawing = fe.drawing AND v.handle IN (fe."left", fe."right"))""")
def active_event_semijoin(spark, sf_dir):
    events = c.distinct_events(_events(spark, sf_dir))
    return c.active_events(events, _nodes(spark, sf_dir)).select("drawing", "left", "right", "kind", "x", "y", "state")


@query(f"""WITH {B2}, {EQUIPMENT} SELECT DISTINCT ON (s.d, s.x1, s.y1, s.x2, s.y2) s.d AS drawing, s.k * 2147483648 AS segment, s.x1, s.y1, s.x2, s.y2 FROM seg s
    WHERE NOT EXISTS (SELECT 1 FROM eqp e WHERE e.d = s.d AND e.equipment = s.k) ORDER BY s.d, s.x1, s.y1, s.x2, s.y2, s.k""")
def consumed_antijoin(spark, sf_dir):
    """Wires: the lines that no device owns, the first of equal ones."""
    lines = drawings(spark, sf_dir)
    shapes = lines.select(
        "drawing", F.col("segment").alias("seq"), "evidence", F.lit("LINE").alias("entity"), F.lit("line").alias("kind"), F.lit(False).alias("closed"), F.lit("W").alias("layer"),
        F.array(g.point(F.col("x1"), F.col("y1")), g.point(F.col("x2"), F.col("y2"))).alias("vertices"),
    )
    used = devices(spark, sf_dir).select("drawing", F.col("equipment").alias("evidence"))
    return recognise.wires_of(shapes, used).drop("evidence")


def _shapes(spark, sf_dir):
    return devices(spark, sf_dir).select("drawing", F.col("equipment").alias("shape"), "x0", "y0", "x1", "y1")


@query(f"""WITH RECURSIVE {EQUIPMENT},
    nr AS (SELECT a.d, a.equipment AS u, b.equipment AS v FROM eqp a JOIN eqp b ON a.d = b.d AND a.equipment <> b.equipment
           AND sqrt(greatest(0, a.x0 - b.x1, b.x0 - a.x1) ** 2 + greatest(0, a.y0 - b.y1, b.y0 - a.y1) ** 2) <= 25),
    q(d, shape, root) AS (SELECT d, equipment, equipment FROM eqp UNION SELECT q.d, q.shape, nr.v FROM q JOIN nr ON nr.d = q.d AND nr.u = q.root)
    SELECT d AS drawing, shape, min(root) AS "group" FROM q GROUP BY ALL""")
def shape_cluster_components(spark, sf_dir):
    return c.shape_clusters(_shapes(spark, sf_dir))


@query(f"""WITH {EQUIPMENT}, p AS (SELECT a.d, a.equipment AS anchor, b.equipment AS shape, sqrt(greatest(0, a.x0 - b.x1, b.x0 - a.x1) ** 2 + greatest(0, a.y0 - b.y1, b.y0 - a.y1) ** 2) AS gap,
        sqrt(((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) ** 2 + ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) ** 2) AS cg FROM eqp a JOIN eqp b ON a.d = b.d),
    r AS (SELECT *, row_number() OVER (PARTITION BY d, anchor ORDER BY gap, cg, shape) AS rank FROM p WHERE gap <= 200 AND cg <= 600),
    s AS (SELECT d, anchor, string_agg(shape::VARCHAR, ',' ORDER BY shape) AS shapes FROM r WHERE rank <= 3 GROUP BY ALL)
    SELECT d AS drawing, shapes, min(anchor) AS anchor FROM s GROUP BY ALL""")
def local_windows_topn(spark, sf_dir):
    shapes = _shapes(spark, sf_dir)
    windows = c.local_windows(shapes, shapes, most=3)
    return windows.withColumn("shapes", F.array_join(F.transform("shapes", lambda v: v.cast("string")), ","))


HANDLES = """cand AS (SELECT o_custkey AS d, o_orderkey AS k, (o_orderkey * 37) % 101 AS score, list_distinct([o_orderkey % 7, o_orderkey * 3 % 11, o_orderkey * 5 % 13]) AS handles FROM orders),
    rk AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, len(handles) DESC, k) AS rank FROM cand)"""


@query(f"""WITH RECURSIVE {HANDLES},
    st(d, rank, used, k, took) AS (SELECT DISTINCT d, 0::BIGINT, []::BIGINT[], -1::BIGINT, false FROM rk
        UNION ALL SELECT s.d, r.rank, CASE WHEN list_has_any(s.used, r.handles) THEN s.used ELSE list_concat(s.used, r.handles) END, r.k, NOT list_has_any(s.used, r.handles)
        FROM st s JOIN rk r ON r.d = s.d AND r.rank = s.rank + 1)
    SELECT d AS drawing, k AS candidate, rank::INT AS rank FROM st WHERE took""")
def greedy_disjoint_selection(spark, sf_dir):
    k = F.col("o_orderkey")
    own = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("drawing"), k.alias("candidate"), ((k * 37) % 101).alias("score"), F.array_distinct(F.array(k % 7, k * 3 % 11, k * 5 % 13)).alias("handles")
    )
    order = [F.col("score").desc(), F.size("handles").desc(), F.col("candidate")]
    return graph.greedy_disjoint(own, "candidate", "handles", order, ["drawing"]).select("drawing", "candidate", "rank")


@query("""WITH RECURSIVE it AS (SELECT o_custkey AS d, o_orderkey AS k, o_orderkey % 3 AS kind, (o_orderkey * 29) % 16 * 50.0::DOUBLE AS x, (o_orderkey * 41) % 17 * 50.0::DOUBLE AS y,
        row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY (o_orderkey * 37) % 101 DESC, o_orderkey) AS rank FROM orders),
    st(d, kind, rank, leads, k, leader) AS (SELECT DISTINCT d, kind, 0::BIGINT, []::STRUCT(k BIGINT, x DOUBLE, y DOUBLE)[], -1::BIGINT, -1::BIGINT FROM it
        UNION ALL SELECT s.d, s.kind, i.rank,
            CASE WHEN len(list_filter(s.leads, lambda z: sqrt((z.x - i.x) ** 2 + (z.y - i.y) ** 2) <= 160)) = 0 THEN list_append(s.leads, {'k': i.k, 'x': i.x, 'y': i.y}) ELSE s.leads END,
            i.k, coalesce(list_filter(s.leads, lambda z: sqrt((z.x - i.x) ** 2 + (z.y - i.y) ** 2) <= 160)[1].k, i.k)
        FROM st s JOIN it i ON i.d = s.d AND i.kind = s.kind AND i.rank = s.rank + 1)
    SELECT k AS item, leader FROM st WHERE k >= 0""")
def coincident_leader_cluster(spark, sf_dir):
    k = F.col("o_orderkey")
    order = Window.partitionBy("o_custkey", k % 3).orderBy(((k * 37) % 101).desc(), k)
    own = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("drawing"), (k % 3).alias("kind"), k.alias("item"), ((k * 29) % 16 * 50.0).alias("x0"), ((k * 41) % 17 * 50.0).alias("y0"), F.row_number().over(order).alias("rank")
    )
    own = am.cut(own.withColumns({"x1": F.col("x0"), "y1": F.col("y0")}))
    pairs = spatial.box_join(own, own, ["drawing", "kind"], 160.0, 500.0, gap="euclid").where("l_item <> r_item")
    near = pairs.select(F.col("l_item").alias("item"), F.col("r_item").alias("other"), F.col("r_rank").alias("other_rank"))
    return graph.leader_clusters(own, near, "item")


@query(f"""WITH {B2}, {EQUIPMENT} SELECT s.d AS drawing, s.k AS segment, e.equipment FROM seg s JOIN eqp e ON e.d = s.d AND s.x1 BETWEEN e.x0 AND e.x1 AND s.y1 BETWEEN e.y0 AND e.y1""")
def point_in_box_members(spark, sf_dir):
    points = drawings(spark, sf_dir).select("drawing", "segment", F.col("x1").alias("x"), F.col("y1").alias("y"))
    found = spatial.points_in_boxes(points, devices(spark, sf_dir).select("drawing", "equipment", "x0", "y0", "x1", "y1"), ["drawing"], 500.0)
    return found.select("drawing", F.col("l_segment").alias("segment"), F.col("r_equipment").alias("equipment"))


@query(f"""WITH {B2}, bus AS (SELECT d, k, y1 AS y, x1 AS x0, x2 AS x1 FROM seg WHERE y1 = y2), pr AS (SELECT d, min(k) AS k FROM bus GROUP BY d),
    lv AS (SELECT b.*, p.k AS pk FROM bus b JOIN pr p USING (d) JOIN bus q ON q.d = p.d AND q.k = p.k WHERE abs(b.y - q.y) <= 20),
    o AS (SELECT *, max(x1) OVER (PARTITION BY d ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lv),
    i AS (SELECT *, sum(CASE WHEN x0 <= reach + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY d ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS isl FROM o)
    SELECT i.d AS drawing, i.pk AS label, i.k AS segment FROM i JOIN (SELECT d, isl FROM i WHERE k = pk) z ON z.d = i.d AND z.isl = i.isl""")
def bus_growth_islands(spark, sf_dir):
    lines = c.with_properties(drawings(spark, sf_dir)).where("horizontal")
    buses = lines.select("drawing", "segment", F.col("y0").alias("y"), "x0", F.col("bx1").alias("x1"))
    primary = buses.groupBy("drawing").agg(F.min("segment").alias("segment")).withColumn("label", F.col("segment"))
    return c.bus_growth(buses, primary, 20.0, 100.0)


@query(f"""WITH RECURSIVE {B2}, {COMPONENTS}, {EQUIPMENT},
    tch AS (SELECT DISTINCT e.d, k.root, e.equipment, (e.y0 + e.y1) / 2 AS cy FROM eqp e JOIN seg s ON s.d = e.d JOIN cmp k ON k.drawing = s.d AND k.segment = s.k
            WHERE e.x0 - 10 <= s.x2 AND s.x1 <= e.x1 + 10 AND e.y0 - 10 <= s.y2 AND s.y1 <= e.y1 + 10),
    nr AS (SELECT a.d, a.equipment AS u, b.equipment AS v FROM tch a JOIN tch b ON a.d = b.d AND a.root = b.root AND a.equipment <> b.equipment AND abs(a.cy - b.cy) <= 300),
    q(d, container, root) AS (SELECT d, equipment, equipment FROM eqp UNION SELECT q.d, q.container, nr.v FROM q JOIN nr ON nr.d = q.d AND nr.u = q.root)
    SELECT d AS drawing, container, min(root) AS cluster FROM q GROUP BY ALL""")
def engineering_clusters(spark, sf_dir):
    lines = drawings(spark, sf_dir)
    boxes = devices(spark, sf_dir).select("drawing", F.col("equipment").alias("container"), "x0", "y0", "x1", "y1")
    roots = c.conductor_components(lines, _events(spark, sf_dir))
    return c.container_clusters(boxes, lines, roots, reach=0.1, band=3.0)


LABELS = """lab AS (SELECT o_custkey AS d, o_orderkey AS label, (o_orderkey * 31) % 16 * 50.0::DOUBLE AS x, (o_orderkey * 59) % 40 * 50.0::DOUBLE AS y FROM orders WHERE o_orderkey % 3 = 1)"""


def _labels(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").where(k % 3 == 1).select(F.col("o_custkey").alias("drawing"), k.alias("label"), ((k * 31) % 16 * 50.0).alias("x"), ((k * 59) % 40 * 50.0).alias("y"))


@query(f"""WITH {EQUIPMENT}, {LABELS}, p AS (SELECT l.d, label, equipment AS frame, CASE WHEN x BETWEEN x0 AND x1 THEN 0 ELSE least(abs(x - x0), abs(x - x1)) END + abs(y - y1) AS g
        FROM lab l JOIN eqp e ON e.d = l.d AND x BETWEEN x0 - 1000 AND x1 + 1000 AND y BETWEEN y0 - 300 AND y1 + 1200),
    n AS (SELECT DISTINCT ON (d, label) d, label, frame FROM p ORDER BY d, label, g, frame)
    SELECT d AS drawing, min(label) AS label, frame FROM n GROUP BY d, frame""")
def label_to_frame(spark, sf_dir):
    frames = devices(spark, sf_dir).select("drawing", F.col("equipment").alias("frame"), "x0", "y0", "x1", "y1")
    return text.labels_to_frames(_labels(spark, sf_dir), frames, ["drawing"])


@query(f"""WITH {B2}, {LABELS}, p AS (SELECT l.d, label, s.k AS segment, l.y - s.y1 AS v, CASE WHEN x BETWEEN s.x1 AND s.x2 THEN 0 ELSE least(abs(x - s.x1), abs(x - s.x2)) END AS h
        FROM lab l JOIN seg s ON s.d = l.d AND s.y1 = s.y2)
    SELECT DISTINCT ON (d, label) d AS drawing, label, segment FROM p WHERE v BETWEEN 200 AND 6000 AND h <= 3000 ORDER BY d, label, v + h * 1.5, segment""")
def label_to_bus(spark, sf_dir):
    lines = c.with_properties(drawings(spark, sf_dir)).where("horizontal")
    return text.labels_to_buses(_labels(spark, sf_dir), lines.select("drawing", "segment", F.col("y0").alias("y"), "x0", F.col("bx1").alias("x1")), ["drawing"])


@query(f"""WITH {B2}, {EQUIPMENT}, p AS (SELECT e.d, e.equipment AS transformer, s.k % 4 AS container, s.k AS segment, s.y1 - e.y1 AS v,
        CASE WHEN (e.x0 + e.x1) / 2 BETWEEN s.x1 AND s.x2 THEN 0 ELSE least(abs((e.x0 + e.x1) / 2 - s.x1), abs((e.x0 + e.x1) / 2 - s.x2)) END AS h FROM eqp e JOIN seg s ON s.d = e.d AND s.y1 = s.y2)
    SELECT DISTINCT ON (d, transformer) d AS drawing, transformer, container, segment FROM p WHERE v BETWEEN 0 AND 5000 AND h <= 200 ORDER BY d, transformer, v + h * 2, container, segment""")
def transformer_to_bus(spark, sf_dir):
    lines = c.with_properties(drawings(spark, sf_dir)).where("horizontal")
    buses = lines.select("drawing", (F.col("segment") % 4).alias("container"), "segment", F.col("y0").alias("y"), "x0", F.col("bx1").alias("x1"))
    own = devices(spark, sf_dir).select("drawing", F.col("equipment").alias("transformer"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y1").alias("top"))
    return text.transformers_to_buses(own, buses, ["drawing"])


@query(f"""WITH {B2} SELECT count(*) AS segments, count(DISTINCT d) AS drawings, count(*) FILTER (y1 = y2) AS horizontal, max(n)::BIGINT AS largest_drawing,
    (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM ev WHERE kind = 't_junction') AS t_junctions, (SELECT count(*) FROM ev WHERE kind = 'x_not_connected') AS open_crossings
    FROM seg JOIN (SELECT d, count(*) AS n FROM seg GROUP BY d) USING (d)""")
def statistics_block(spark, sf_dir):
    lines = c.with_properties(drawings(spark, sf_dir))
    by = lines.groupBy("drawing").agg(F.count("*").alias("n"), F.sum(F.col("horizontal").cast("long")).alias("h"))
    first = by.agg(F.sum("n").alias("segments"), F.count("*").alias("drawings"), F.sum("h").alias("horizontal"), F.max("n").alias("largest_drawing"))
    count_of = lambda k: F.sum((F.col("kind") == k).cast("long"))
    second = _events(spark, sf_dir).agg(F.count("*").alias("events"), count_of("t_junction").alias("t_junctions"), count_of("x_not_connected").alias("open_crossings"))
    return first.join(second, F.lit(True))


@query("""WITH p AS (SELECT o_custkey AS d, o_orderkey AS k, ['i' || o_orderkey % 3, 'j' || o_orderkey % 5, 'k' || o_orderkey % 2][1:1 + (o_orderkey % 3)::INT] AS path FROM orders),
    i AS (SELECT DISTINCT d, path FROM p)
    SELECT i.d AS drawing, array_to_string(i.path, '/') AS insert_path, count(*) AS descendants, string_agg(p.k::VARCHAR, ',' ORDER BY p.k) AS members
    FROM i JOIN p ON p.d = i.d AND p.path[1:len(i.path)] = i.path GROUP BY i.d, i.path""")
def path_prefix_descendants(spark, sf_dir):
    k = F.col("o_orderkey")
    parts = F.array(F.concat(F.lit("i"), (k % 3).cast("string")), F.concat(F.lit("j"), (k % 5).cast("string")), F.concat(F.lit("k"), (k % 2).cast("string")))
    own = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("drawing"), k.alias("evidence"), F.slice(parts, 1, (1 + k % 3).cast("int")).alias("insert_path"))
    path = F.array_join("insert_path", "/").alias("seq")
    inserts = own.select("drawing", F.lit("insert").alias("record"), path, "insert_path").distinct()
    members = F.array_join(F.transform(F.array_sort(F.collect_list("evidence")), lambda v: v.cast("string")), ",")
    below = recognise.insert_members(inserts, own)
    return below.groupBy("drawing", F.col("insert_seq").alias("insert_path")).agg(F.count("*").alias("descendants"), members.alias("members"))


@query("""WITH s AS (SELECT o_custkey AS d, list_distinct(list(o_orderkey % 7)) AS a, list_distinct(list(o_orderkey % 5 + 2)) AS b FROM orders GROUP BY ALL),
    j AS (SELECT d, a, b, list_sort(list_distinct(list_concat(a, b))) AS u, list_sort(list_intersect(a, b)) AS i, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS e FROM s)
    SELECT d AS drawing, array_to_string(u, ',') AS both, array_to_string(i, ',') AS common, array_to_string(e, ',') AS only_first, len(i) > 0 AS overlap FROM j""")
def handle_set_ops(spark, sf_dir):
    own = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("drawing")).agg(F.collect_set(F.col("o_orderkey") % 7).alias("a"), F.collect_set(F.col("o_orderkey") % 5 + 2).alias("b"))
    as_text = lambda x: F.array_join(F.transform(F.array_sort(x), lambda v: v.cast("string")), ",")
    return own.select("drawing", as_text(F.array_union("a", "b")).alias("both"), as_text(F.array_intersect("a", "b")).alias("common"), as_text(F.array_except("a", "b")).alias("only_first"), F.arrays_overlap("a", "b").alias("overlap"))


@query(f"""WITH RECURSIVE {EQUIPMENT}, ix AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY equipment) - 1 AS i, count(*) OVER (PARTITION BY d) AS n FROM eqp),
    gr AS (SELECT DISTINCT d, n FROM ix),
    nr AS (SELECT a.d, a.i AS u, b.i AS v FROM ix a JOIN ix b ON a.d = b.d AND a.i <> b.i AND a.n <= 6
           AND sqrt(greatest(0, a.x0 - b.x1, b.x0 - a.x1) ** 2 + greatest(0, a.y0 - b.y1, b.y0 - a.y1) ** 2) <= 100),
    mk AS (SELECT d, unnest(range(1, (1 << n::INT)::BIGINT)) AS mask FROM gr WHERE n <= 6),
    lo AS (SELECT mk.d, mask, min(i) AS i FROM mk JOIN ix ON ix.d = mk.d AND (mask >> i) & 1 = 1 GROUP BY ALL),
    re(d, mask, i) AS (SELECT d, mask, i FROM lo UNION SELECT re.d, re.mask, nr.v FROM re JOIN nr ON nr.d = re.d AND nr.u = re.i AND (re.mask >> nr.v) & 1 = 1),
    ok AS (SELECT d, mask, count(*)::INT AS size FROM re GROUP BY ALL HAVING count(*) = bit_count(mask))
    SELECT d AS "group", mask, NULL::BIGINT AS shape, size FROM ok UNION SELECT d, (1 << n::INT)::BIGINT - 1, NULL, n::INT FROM gr WHERE n <= 6
    UNION ALL SELECT d, NULL, equipment, 1 FROM ix WHERE n > 6 UNION ALL SELECT d, -1, NULL, n::INT FROM gr WHERE n > 6""")
def powerset_connected_subsets(spark, sf_dir):
    shapes = devices(spark, sf_dir).select(F.col("drawing").alias("group"), F.col("equipment").alias("shape"), "x0", "y0", "x1", "y1")
    return matching.subset_candidates(shapes, 100.0)


# --- B3: point clouds -------------------------------------------------------------------------------------

B3 = """pts AS (SELECT vec_id, label, list_transform(range(0, 32), lambda i: {'x': embedding[2 * i + 1]::DOUBLE, 'y': embedding[2 * i + 2]::DOUBLE}) AS points FROM embeddings),
    ext AS (SELECT vec_id, label, points, list_min(list_transform(points, lambda p: p.x)) AS x0, list_max(list_transform(points, lambda p: p.x)) AS x1, list_min(list_transform(points, lambda p: p.y)) AS y0, list_max(list_transform(points, lambda p: p.y)) AS y1 FROM pts),
    nrm AS (SELECT vec_id, label, list_transform(points, lambda p: {'x': (p.x - (x0 + x1) / 2) / greatest(x1 - x0, y1 - y0, 1e-12), 'y': (p.y - (y0 + y1) / 2) / greatest(x1 - x0, y1 - y0, 1e-12)}) AS points FROM ext),
    flt AS (SELECT vec_id, label, unnest(range(0, 32)) AS i, unnest(points) AS p FROM nrm),
    mean AS (SELECT vec_id, avg(p.x) AS mx, avg(p.y) AS my FROM flt GROUP BY vec_id),
    rad AS (SELECT f.vec_id, sqrt((f.p.x - mx) ** 2 + (f.p.y - my) ** 2) AS r FROM flt f JOIN mean USING (vec_id)),
    bins AS (SELECT vec_id, least(floor(r / greatest(max(r) OVER (PARTITION BY vec_id), 1e-12) * 16), 15)::INT AS bin FROM rad),
    dsc AS MATERIALIZED (SELECT v.vec_id, v.bin, coalesce(n, 0) / 32.0::DOUBLE AS share FROM (SELECT vec_id, unnest(range(0, 16))::INT AS bin FROM pts) v LEFT JOIN (SELECT vec_id, bin, count(*) AS n FROM bins GROUP BY ALL) b USING (vec_id, bin)),
    kc AS (SELECT vec_id, 1 + vec_id % 3 AS line, vec_id % 2 AS circle FROM pts),
    apt AS (SELECT x.vec_id AS candidate, y.vec_id AS template, sum(abs(x.share - y.share)) AS apart FROM dsc x JOIN dsc y ON x.bin = y.bin AND x.vec_id % 20 <> 0 AND y.vec_id % 20 = 0 GROUP BY ALL),
    crs AS (SELECT candidate, template, t.label, round(0.55 * ((least(a.line, b.line) + least(a.circle, b.circle)) / (greatest(a.line, b.line) + greatest(a.circle, b.circle)))
              + 0.45 * greatest(0, 1 - 0.5 * apart), 9) AS coarse FROM apt JOIN pts t ON t.vec_id = template JOIN kc a ON a.vec_id = candidate JOIN kc b ON b.vec_id = template),
    crk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY coarse DESC, template) AS rank FROM crs),
    fam AS (SELECT candidate, list_distinct(list(label)) AS fams FROM crk WHERE rank <= 8 GROUP BY candidate),
    scd AS (SELECT candidate, min(rank) AS second FROM crk JOIN fam USING (candidate) WHERE len(fams) < 2 AND NOT list_contains(fams, label) GROUP BY candidate),
    shl AS MATERIALIZED (SELECT crk.* FROM crk LEFT JOIN scd USING (candidate) WHERE rank <= 8 OR rank = second)"""
ALIGNED = """mom AS (SELECT f.vec_id, sum((f.p.x - mx) ** 2) AS xx, sum((f.p.y - my) ** 2) AS yy, sum((f.p.x - mx) * (f.p.y - my)) AS xy, any_value(mx) AS mx, any_value(my) AS my FROM flt f JOIN mean USING (vec_id) GROUP BY f.vec_id),
    ang AS (SELECT *, atan2(2 * xy, xx - yy) / 2 AS a FROM mom),
    aln AS (SELECT f.vec_id, i, (f.p.x - mx) * cos(-a) - (f.p.y - my) * sin(-a) AS x, (f.p.x - mx) * sin(-a) + (f.p.y - my) * cos(-a) AS y FROM flt f JOIN ang USING (vec_id))"""
TURNED = """trn(k, transform, a, b, c, e) AS (VALUES (0, 'rotate_0', 1, 0, 0, 1), (1, 'rotate_90', 0, -1, 1, 0), (2, 'rotate_180', -1, 0, 0, -1), (3, 'rotate_270', 0, 1, -1, 0),
        (4, 'mirror_x+rotate_0', -1, 0, 0, 1), (5, 'mirror_x+rotate_90', 0, -1, -1, 0), (6, 'mirror_x+rotate_180', 1, 0, 0, -1), (7, 'mirror_x+rotate_270', 0, 1, 1, 0)),
    tpt AS (SELECT f.vec_id, k, transform, i, a * f.p.x + b * f.p.y AS x, c * f.p.x + e * f.p.y AS y FROM flt f, trn)"""
CHAMFER = f"""{B3}, {ALIGNED}, {TURNED},
    dst AS MATERIALIZED (SELECT s.candidate, s.template, t.k, t.transform, p.i, t.i AS j, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) AS d FROM shl s JOIN aln p ON p.vec_id = s.candidate JOIN tpt t ON t.vec_id = s.template),
    fwd AS (SELECT candidate, template, k, avg(m) AS m FROM (SELECT candidate, template, k, i, min(d) AS m FROM dst GROUP BY ALL) GROUP BY ALL),
    bwd AS (SELECT candidate, template, k, avg(m) AS m FROM (SELECT candidate, template, k, j, min(d) AS m FROM dst GROUP BY ALL) GROUP BY ALL),
    ch AS (SELECT candidate, template, k, round((fwd.m + bwd.m) / 2, 9) AS distance FROM fwd JOIN bwd USING (candidate, template, k)),
    bst AS (SELECT DISTINCT ON (candidate, template) candidate, template, distance FROM ch ORDER BY candidate, template, distance, k),
    sco AS (SELECT b.candidate, b.template, s.label, distance, round(least(100, 100 * (0.85 * exp(-8 * distance) + 0.15 * ((least(x.line, y.line) + least(x.circle, y.circle)) / (greatest(x.line, y.line) + greatest(x.circle, y.circle))))), 2) AS combined_score
            FROM bst b JOIN shl s USING (candidate, template) JOIN kc x ON x.vec_id = b.candidate JOIN kc y ON y.vec_id = b.template)"""


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, raw, points, counts): 32 points an embedding, raw and normalised."""
    e = F.col("embedding")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: g.point(F.get(e, 2 * i), F.get(e, 2 * i + 1)))
    counts = F.map_from_arrays(F.array(F.lit("line"), F.lit("circle")), F.array((1 + F.col("vec_id") % 3).cast("int"), (F.col("vec_id") % 2).cast("int")))
    own = read(spark, sf_dir, "embeddings").select("vec_id", "label", pairs.alias("raw"), counts.alias("counts"))
    return own.withColumn("points", g.normalised(F.col("raw")))


def _sides(spark, sf_dir):
    own = clouds(spark, sf_dir)
    candidates = own.where("vec_id % 20 <> 0").select(F.col("vec_id").alias("candidate"), "points", "counts")
    templates = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("template"), F.col("label").alias("family"), "points", "counts")
    return candidates, templates


def _by_point(df, name="points"):
    return df.select("vec_id", F.posexplode(name).alias("i", "p")).select("vec_id", "i", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


@query(f"WITH {B3} SELECT vec_id, i::INT AS i, round(p.x, 9) AS x, round(p.y, 9) AS y FROM flt")
def normalize_points(spark, sf_dir):
    return _by_point(clouds(spark, sf_dir))


@query(f"WITH {B3}, {TURNED} SELECT vec_id, transform, round(sum(x * (i + 1)), 9) AS x_moment, round(sum(y * (i + 1)), 9) AS y_moment FROM tpt GROUP BY ALL")
def dihedral_variants(spark, sf_dir):
    own = clouds(spark, sf_dir)
    turned = own.select("vec_id", F.explode(g.dihedral(F.col("points"))).alias("t")).select("vec_id", "t.transform", F.posexplode("t.points").alias("i", "p"))
    return turned.groupBy("vec_id", "transform").agg(F.round(F.sum(F.col("p.x") * (F.col("i") + 1)), 9).alias("x_moment"), F.round(F.sum(F.col("p.y") * (F.col("i") + 1)), 9).alias("y_moment"))


@query(f"WITH {B3} SELECT vec_id, bin, share FROM dsc")
def radial_descriptor(spark, sf_dir):
    own = clouds(spark, sf_dir)
    return own.select("vec_id", F.posexplode(g.radial_descriptor(F.col("points"))).alias("bin", "share"))


@query(f"WITH {B3}, {ALIGNED} SELECT vec_id, i::INT AS i, round(x, 7) AS x, round(y, 7) AS y FROM aln")
def pca_align(spark, sf_dir):
    own = clouds(spark, sf_dir).withColumn("points", g.axis_aligned(F.col("points")))
    return own.select("vec_id", F.posexplode("points").alias("i", "p")).select("vec_id", "i", F.round("p.x", 7).alias("x"), F.round("p.y", 7).alias("y"))


@query(f"WITH {B3} SELECT candidate, template, label AS family, coarse, rank::INT AS rank FROM shl")
def coarse_shortlist(spark, sf_dir):
    return matching.coarse_shortlist(*_sides(spark, sf_dir))


def _scores(spark, sf_dir):
    candidates, templates = _sides(spark, sf_dir)
    short = am.cut(matching.coarse_shortlist(candidates, templates))
    distances = matching.chamfer_distances(short.select("candidate", "template", "family"), candidates, templates)
    distances = distances.join(candidates.select("candidate", F.col("counts").alias("_c")), "candidate").join(templates.select("template", F.col("counts").alias("_t")), "template")
    return matching.combined_scores(distances, g.multiset_similarity(F.col("_c"), F.col("_t"))).drop("_c", "_t")


@query(f"WITH {CHAMFER} SELECT candidate, template, label AS family, round(distance, 6) AS distance, combined_score, row_number() OVER (PARTITION BY candidate ORDER BY combined_score DESC, template)::INT AS rank FROM sco")
def chamfer_topk(spark, sf_dir):
    return _scores(spark, sf_dir).select("candidate", "template", "family", F.round("distance", 6).alias("distance"), "combined_score", "rank")


@query(f"""WITH {CHAMFER}, f AS (SELECT candidate, label, max(combined_score) AS s FROM sco GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY s DESC, label) AS k FROM f)
    SELECT candidate, max(CASE WHEN k = 1 THEN label END) AS best_family, max(CASE WHEN k = 1 THEN s END) AS best, round(max(CASE WHEN k = 1 THEN s END) - coalesce(max(CASE WHEN k = 2 THEN s END), 0), 2) AS margin FROM r GROUP BY candidate""")
def family_margin(spark, sf_dir):
    return matching.family_margin(_scores(spark, sf_dir))


@query(f"""WITH {CHAMFER}, e AS (SELECT candidate, max(combined_score) AS score FROM sco GROUP BY candidate),
    t AS (SELECT candidate // 5 AS "group", candidate, score, 1 + candidate % 3 + candidate % 2 AS primitives, score >= 40 AS accepted, 1 + candidate % 4 AS owned FROM e),
    k AS (SELECT *, CASE WHEN accepted AND primitives > 1 THEN 2 WHEN accepted THEN 1 ELSE 0 END AS tier, round(score + least(log2(greatest(primitives, 1)) * 0.75, 2.5), 9) AS selection FROM t)
    SELECT DISTINCT ON ("group") "group", candidate, tier, score FROM k ORDER BY "group", tier DESC, selection DESC, score DESC, owned DESC, candidate""")
def group_winner(spark, sf_dir):
    best = _scores(spark, sf_dir).groupBy("candidate").agg(F.max("combined_score").alias("score"))
    k = F.col("candidate")
    own = best.select(F.floor(k / 5).alias("group"), "candidate", "score", (1 + k % 3 + k % 2).alias("primitives"), (F.col("score") >= 40).alias("accepted"), (1 + k % 4).alias("owned"))
    return matching.group_winners(own).select("group", "candidate", "tier", "score")


# --- B4: intervals ----------------------------------------------------------------------------------------

B4 = """iv AS (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + (round_even(value * 1000, 0))::BIGINT * 100000 AS e FROM events),
    op AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
    il AS (SELECT *, sum(CASE WHEN s <= reach + 25000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM op),
    sp AS (SELECT user_id, island::BIGINT AS island, min(s) AS s, max(e) AS e, count(*) AS members FROM il GROUP BY ALL)"""


def _spans(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    own = read(spark, sf_dir, "events").select("user_id", "event_id", start.alias("s"), (start + F.rint(F.col("value") * 1000).cast("long") * 100000).alias("e"))
    return intervals.union_spans(own, ["user_id"], "s", "e", 25_000_000)


@query(f"WITH {B4} SELECT * FROM sp")
def interval_islands(spark, sf_dir):
    return _spans(spark, sf_dir)


@query(f"""WITH {B4}, b AS (SELECT min(s) AS lo, max(e) AS hi FROM sp)
    SELECT user_id, sum(e - s)::BIGINT AS covered, round(least(1.0, sum(e - s) / any_value(hi - lo)), 9) AS share FROM sp, b GROUP BY user_id""")
def interval_union_coverage(spark, sf_dir):
    spans = am.cut(_spans(spark, sf_dir))
    whole = spans.agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    found = intervals.coverage(spans.join(F.broadcast(whole), F.lit(True)), ["user_id"], "s", "e", "lo", "hi")
    return found.withColumn("share", F.round("share", 9))


# --- B5: markup symbols -----------------------------------------------------------------------------------

TAGS = ["p", "li", "a", "div", "h1", "ul", "b", "br"]
TAG_SQL = "tg AS (SELECT page_id, url, html, unnest(['p', 'li', 'a', 'div', 'h1', 'ul', 'b', 'br']) AS tag FROM pages), ct AS (SELECT page_id, url, tag, len(regexp_extract_all(html, '<' || tag || '[ >]')) AS n FROM tg)"


def _tag_counts(spark, sf_dir):
    counts = F.array(*(F.regexp_count("html", F.lit(f"<{t}[ >]")) for t in TAGS))
    return read(spark, sf_dir, "pages").select("page_id", "url", F.map_from_arrays(F.array(*map(F.lit, TAGS)), counts).alias("counts"))


@query(f"WITH {TAG_SQL} SELECT page_id, tag, n::INT AS n FROM ct WHERE n > 0")
def tag_counts(spark, sf_dir):
    return _tag_counts(spark, sf_dir).select("page_id", F.explode("counts").alias("tag", "n")).where("n > 0")


@query(f"""WITH {TAG_SQL} SELECT a.page_id, b.page_id AS template, round(CASE WHEN sum(greatest(a.n, b.n)) > 0 THEN sum(least(a.n, b.n)) / sum(greatest(a.n, b.n)) ELSE 1 END, 9) AS similarity
    FROM ct a JOIN ct b ON a.tag = b.tag AND b.page_id % 50 = 0 GROUP BY ALL""")
def multiset_jaccard(spark, sf_dir):
    own = am.cut(_tag_counts(spark, sf_dir).select("page_id", "counts"))  # each page is searched once
    templates = own.where("page_id % 50 = 0").select(F.col("page_id").alias("template"), F.col("counts").alias("_t"))
    return own.join(templates, F.lit(True)).select("page_id", "template", F.round(g.multiset_similarity(F.col("counts"), F.col("_t")), 9).alias("similarity"))


SYMBOL_SQL = f"""{TAG_SQL}, sg AS (SELECT page_id, regexp_extract(url, 'example\\.([a-z]+)', 1) || ':' || regexp_extract(url, '/([a-z]{{2}})/', 1) AS symbol_id,
        sha256(string_agg(tag || least(n, 3), ',' ORDER BY tag)) AS signature FROM ct GROUP BY page_id, url),
    vr AS (SELECT symbol_id, signature, count(*) AS definitions FROM sg GROUP BY ALL)"""


def _symbols(spark, sf_dir):
    own = _tag_counts(spark, sf_dir)
    symbol = F.concat(F.regexp_extract("url", r"example\.([a-z]+)", 1), F.lit(":"), F.regexp_extract("url", r"/([a-z]{2})/", 1))
    parts = [F.concat(F.lit(t), F.least(F.col("counts")[t], F.lit(3)).cast("string")) for t in sorted(TAGS)]
    return own.select("page_id", symbol.alias("symbol_id"), F.sha2(F.concat_ws(",", *parts), 256).alias("signature"))


@query(f"WITH {SYMBOL_SQL} SELECT * FROM vr")
def symbol_variants(spark, sf_dir):
    definitions = _symbols(spark, sf_dir).select("symbol_id", "signature", F.lit("pages").alias("file"), F.col("page_id").alias("seq"), F.col("page_id").alias("geometry"))
    return templates.variants(definitions).select("symbol_id", "signature", F.col("definition_occurrences").alias("definitions"))


@query(f"""WITH {SYMBOL_SQL} SELECT symbol_id, signature, symbol_id || CASE WHEN count(*) OVER (PARTITION BY symbol_id) > 1
    THEN '#v' || row_number() OVER (PARTITION BY symbol_id ORDER BY signature) ELSE '' END AS template_key FROM vr""")
def template_version_numbering(spark, sf_dir):
    from meshwright.plans.templates import template_keys

    return template_keys(_symbols(spark, sf_dir).select("symbol_id", "signature").distinct())


@query(r"""WITH s AS (SELECT DISTINCT p_brand || CASE WHEN p_size % 3 = 0 THEN '' ELSE ':' || p_name || CASE WHEN p_size % 2 = 0 THEN '@' || (p_size % 4) ELSE '' END END AS symbol_id FROM part),
    q AS (SELECT symbol_id, split_part(symbol_id, ':', 1) AS family, CASE WHEN instr(symbol_id, ':') > 0 THEN substr(symbol_id, instr(symbol_id, ':') + 1) ELSE '' END AS rest FROM s)
    SELECT symbol_id, family, CASE WHEN rest = '' THEN family WHEN instr(rest, '@') > 0 THEN regexp_replace(rest, '@[^@]*$', '') ELSE rest END AS name,
        CASE WHEN instr(rest, '@') > 0 THEN regexp_extract(rest, '@([^@]*)$', 1) ELSE '' END AS state FROM q""")
def symbol_id_split(spark, sf_dir):
    from meshwright.plans.templates import symbol_parts

    size = F.col("p_size")
    tail = F.when(size % 2 == 0, F.concat(F.lit("@"), (size % 4).cast("string"))).otherwise("")
    symbol = F.concat("p_brand", F.when(size % 3 == 0, "").otherwise(F.concat(F.lit(":"), F.col("p_name"), tail)))
    own = read(spark, sf_dir, "part").select(symbol.alias("symbol_id")).distinct()
    family, name, state = symbol_parts(F.col("symbol_id"))
    return own.select("symbol_id", family.alias("family"), name.alias("name"), state.alias("state"))


# --- B6: texts --------------------------------------------------------------------------------------------

PART_RULES = [(("gear", "ring"), "Rotor", "Moving", 2), (("bolt", "nut"), "Fastener", "Fixed", 1), (("hot",), "Heater", "Fixed", 3), (("widget",), "Widget", "Any", 2)]
RULE_SQL = """CASE WHEN {t} LIKE '%GEAR%' OR {t} LIKE '%RING%' THEN '{a}' WHEN {t} LIKE '%BOLT%' OR {t} LIKE '%NUT%' THEN '{b}' WHEN {t} LIKE '%HOT%' THEN '{c}' WHEN {t} LIKE '%WIDGET%' THEN '{d}' END"""


@query(f"""WITH t AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS t FROM part)
    SELECT p_partkey, {RULE_SQL.format(t='t', a='Rotor', b='Fastener', c='Heater', d='Widget')} AS physical_type, {RULE_SQL.format(t='t', a='Moving', b='Fixed', c='Fixed', d='Any')} AS family FROM t""")
def keyword_priority_semantics(spark, sf_dir):
    found = text.block_semantics(F.col("p_name"), PART_RULES)
    return read(spark, sf_dir, "part").select("p_partkey", found["physical_type"].alias("physical_type"), found["family"].alias("family"))


@query(f"""WITH t AS (SELECT p_partkey, upper(p_brand) AS a, upper(replace(p_name, ' ', '')) AS b, upper(p_type) AS c FROM part),
    r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN {RULE_SQL.format(t='b', a='Rotor', b='Fastener', c='Heater', d='Widget')} END AS x,
          CASE WHEN p_partkey % 2 = 0 THEN {RULE_SQL.format(t='b', a='Rotor', b='Fastener', c='Heater', d='Widget')} END AS y, {RULE_SQL.format(t='b', a='Rotor', b='Fastener', c='Heater', d='Widget')} AS z FROM t)
    SELECT p_partkey, coalesce(x, y, z) AS physical_type, CASE WHEN x IS NOT NULL THEN 'ATTRIB' WHEN y IS NOT NULL THEN 'ATTDEF' WHEN z IS NOT NULL THEN 'block_name' END AS source,
        CASE WHEN x IS NOT NULL THEN 0.99 WHEN y IS NOT NULL THEN 0.97 WHEN z IS NOT NULL THEN 0.94 END::DOUBLE AS confidence FROM r""")
def attribute_priority_coalesce(spark, sf_dir):
    k, name, none = F.col("p_partkey"), F.col("p_name"), F.array().cast("array<string>")
    attributes = F.when(k % 3 == 0, F.array(F.lit("plain"), name)).otherwise(none)
    defaults = F.when(k % 2 == 0, F.array(name)).otherwise(none)
    found = text.prioritised([(attributes, "ATTRIB", 0.99), (defaults, "ATTDEF", 0.97), (F.array(name), "block_name", 0.94)], PART_RULES)
    return read(spark, sf_dir, "part").select("p_partkey", found["physical_type"].alias("physical_type"), found["source"].alias("source"), found["confidence"].alias("confidence"))


@query("""WITH t AS (SELECT l_suppkey AS d, l_orderkey * 10 + l_linenumber AS seq, l_returnflag || l_linestatus AS text, l_quantity * 0.7 AS x, l_tax * 100 AS y, 10 + l_linenumber * 1.0 AS height FROM lineitem),
    q AS (SELECT *, round_even(x / (height * 0.02), 0) AS qx, round_even(y / (height * 0.02), 0) AS qy FROM t)
    SELECT d AS drawing, text, min(seq) AS seq FROM q GROUP BY d, text, qx, qy""")
def text_dedupe_quantised(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("drawing"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat("l_returnflag", "l_linestatus").alias("text"),
        (F.col("l_quantity") * 0.7).alias("x"), (F.col("l_tax") * 100).alias("y"), (10 + F.col("l_linenumber") * 1.0).alias("height"),
    )
    return text.dedupe_texts(own, ["drawing"], ["seq"]).select("drawing", "text", "seq")


@query(f"""WITH {EQUIPMENT}, {LABELS}, n AS (SELECT d, label, x, y, CASE label % 4 WHEN 0 THEN 'PowerTransformer' WHEN 1 THEN 'PT' ELSE '' END AS family FROM lab),
    p AS (SELECT e.d, e.equipment AS box, label AS text_id, family, sqrt(((x0 + x1) / 2 - x) ** 2 + ((y0 + y1) / 2 - y) ** 2) AS g FROM eqp e JOIN n ON n.d = e.d AND family <> '')
    SELECT DISTINCT ON (d, box) d AS drawing, box, text_id, family, round(g, 3) AS distance FROM p WHERE g <= 500 ORDER BY d, box, g, text_id""")
def nearest_text_prior(spark, sf_dir):
    boxes = devices(spark, sf_dir).select("drawing", F.col("equipment").alias("box"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    words = F.when(F.col("label") % 4 == 0, "1号配变").when(F.col("label") % 4 == 1, "P T").otherwise("note")
    return text.nearest_prior(boxes, _labels(spark, sf_dir).select("drawing", F.col("label").alias("text_id"), "x", "y", words.alias("t")), ["drawing"], 500.0, text.text_prior(F.col("t")))
