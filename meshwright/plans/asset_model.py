"""Mining connection rules from asset models: objects and the terminals that tie them to nodes.

objects: (file, object_id, class, name, ...). terminals: (file, terminal_id, equipment_id, node_id, sequence).
Ids are unique within a file. Every step keeps the file in its keys, so many files are one job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.operators.graph import connected_components
from meshwright.operators.keys import class_pairs, histogram_text, keyed_counts
from meshwright.operators.lineage import cut

#: The classes of asset models by what they do in a network.
SWITCH_CLASSES = ["Breaker", "LoadBreakSwitch", "Disconnector", "GroundDisconnector", "Fuse", "Switch", "Recloser", "Sectionaliser"]
CONNECTOR_CLASSES = ["ACLineSegment", "DCLineSegment", "BusbarSection", "Junction", "CableSegment", "Conductor", "SeriesCompensator"]
STRUCTURAL_CLASSES = ["Pole", "PoleSite", "Tower", "Bay", "VoltageLevel", "Substation", "EquipmentContainer"]
BUSBAR_CLASSES = ["BusbarSection"]
LINE_CLASSES = ["ACLineSegment", "DCLineSegment", "CableSegment"]

#: Roles and the patterns that name them; every role that matches counts.
ROLE_PATTERNS = [
    ("bus_coupler", "母联|母线联络"),
    ("tie_switch", "联络"),
    ("incoming_switch", "进线|主进|进柜"),
    ("outgoing_switch", "出线|主出|出柜"),
    ("sectionalizing_switch", "分段"),
    ("transformer_switch", "配变|变压器|台变|专变"),
    ("grounding_switch", "地刀|接地"),
]

#: The template family of an asset class.
TEMPLATE_FAMILY = {
    "Breaker": "Breaker",
    "LoadBreakSwitch": "LoadSwitch",
    "Disconnector": "Disconnector",
    "GroundDisconnector": "GroundDisconnector",
    "Fuse": "Fuse",
    "PowerTransformer": "PowerTransformer",
    "TransformerWinding": "PowerTransformer",
    "PotentialTransformer": "PT",
    "VoltageTransformer": "PT",
    "CurrentTransformer": "CT",
    "Junction": "ConnectivePoint",
}

MINIMUM_OCCURRENCES, MINIMUM_FILES = 5, 3


@dataclass
class Classes:
    """What the classes of a model do. A model of other names brings its own."""

    switches: list[str] = field(default_factory=lambda: SWITCH_CLASSES)
    connectors: list[str] = field(default_factory=lambda: CONNECTOR_CLASSES)
    structural: list[str] = field(default_factory=lambda: STRUCTURAL_CLASSES)
    busbars: list[str] = field(default_factory=lambda: BUSBAR_CLASSES)
    lines: list[str] = field(default_factory=lambda: LINE_CLASSES)

    def functional(self, column: str = "class") -> Column:
        return ~F.col(column).isin(*self.connectors, *self.structural)


def members(objects: DataFrame, terminals: DataFrame) -> DataFrame:
    """(file, node_id, equipment_id, class): an object once for each node it touches."""
    touched = terminals.select("file", "node_id", "equipment_id").distinct()
    known = objects.select("file", F.col("object_id").alias("equipment_id"), "class")
    return touched.join(known, ["file", "equipment_id"])


def relation_counts(members: DataFrame, group: list[str], at_least: int, files_at_least: int) -> DataFrame:
    """(class_a, class_b, occurrences, file_count, evidence_grade) of pairs of members that share a group."""
    pairs = class_pairs(members, ["file", *group])
    return keyed_counts(pairs, ["class_a", "class_b"], weight="pairs", at_least=at_least, files_at_least=files_at_least)


def direct_relations(members: DataFrame, classes: Classes, at_least: int = MINIMUM_OCCURRENCES, files_at_least: int = MINIMUM_FILES) -> DataFrame:
    """Class pairs that share a node. Connectors count; structural objects don't."""
    return relation_counts(members.where(~F.col("class").isin(*classes.structural)), ["node_id"], at_least, files_at_least)


def contracted_nodes(members: DataFrame, classes: Classes) -> DataFrame:
    """(file, node_id, root): nodes joined by connectors, by the least node of their component.

    A connector links its nodes as a star around the least one.
    """
    nodes = members.select("file", "node_id").distinct().withColumn("node", F.struct("file", "node_id"))
    carried = members.where(F.col("class").isin(*classes.connectors)).select("file", "equipment_id", "node_id").distinct()
    hubs = carried.groupBy("file", "equipment_id").agg(F.min("node_id").alias("hub"))
    edges = carried.join(hubs, ["file", "equipment_id"]).where("node_id <> hub").select(
        F.struct("file", "node_id").alias("a"), F.struct("file", F.col("hub").alias("node_id")).alias("b")
    )
    found = connected_components(nodes, edges)
    return found.select("file", "node_id", F.col("component.node_id").alias("root"))


def boundaries(members: DataFrame, roots: DataFrame, classes: Classes) -> DataFrame:
    """(file, root, equipment_id, class): functional objects at each component's boundary."""
    own = members.where(classes.functional()).join(roots, ["file", "node_id"])
    return own.select("file", "root", "equipment_id", "class").distinct()


def connector_counts(members: DataFrame, roots: DataFrame, classes: Classes) -> DataFrame:
    """(file, root, class, n): connectors inside each component, each counted once."""
    own = members.where(F.col("class").isin(*classes.connectors)).join(roots, ["file", "node_id"])
    return own.select("file", "root", "equipment_id", "class").distinct().groupBy("file", "root", "class").agg(F.count("*").alias("n"))


def component_summary(members: DataFrame, roots: DataFrame, classes: Classes) -> DataFrame:
    """(file, root, functional, functional_classes, connectors): class histograms of every component."""
    inside = boundaries(members, roots, classes).groupBy("file", "root", "class").agg(F.count("*").alias("n"))
    functional = inside.groupBy("file", "root").agg(F.sum("n").alias("functional"), histogram_text("class", "n").alias("functional_classes"))
    carried = connector_counts(members, roots, classes).groupBy("file", "root").agg(histogram_text("class", "n").alias("connectors"))
    all_roots = roots.select("file", "root").distinct()
    out = all_roots.join(functional, ["file", "root"], "left").join(carried, ["file", "root"], "left")
    return out.select("file", "root", F.coalesce("functional", F.lit(0)).alias("functional"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("functional_classes", "connectors")))


def contracted_relations(bounds: DataFrame, at_least: int = MINIMUM_OCCURRENCES, files_at_least: int = MINIMUM_FILES) -> DataFrame:
    """Class pairs at the boundary of one component; a pair that shares two components counts twice."""
    return relation_counts(bounds, ["root"], at_least, files_at_least)


def serial_roots(bounds: DataFrame, classes: Classes) -> DataFrame:
    """(file, root): components between exactly two functional objects, both switches."""
    switch = F.sum(F.col("class").isin(*classes.switches).cast("int"))
    return bounds.groupBy("file", "root").agg(F.count("*").alias("n"), switch.alias("s")).where("n = 2 and s = 2").select("file", "root")


def serial_patterns(bounds: DataFrame, classes: Classes, at_least: int = MINIMUM_OCCURRENCES, files_at_least: int = MINIMUM_FILES) -> DataFrame:
    own = bounds.join(serial_roots(bounds, classes), ["file", "root"], "left_semi")
    found = relation_counts(own, ["root"], at_least, files_at_least)
    return found.withColumnsRenamed({"class_a": "switch_class_a", "class_b": "switch_class_b"})


def sequence_key(sequence: Column) -> Column:
    """Terminal numbers in order; those that are none go last."""
    text = sequence.cast("string")
    return F.when(text.rlike("^[0-9]+$"), text.cast("int")).otherwise(F.lit(9999))


def equipment_roots(objects: DataFrame, terminals: DataFrame, roots: DataFrame) -> DataFrame:
    """(file, equipment_id, class, position, root): each terminal's component in terminal order, repeats kept."""
    known = objects.select("file", F.col("object_id").alias("equipment_id"), "class")
    own = terminals.join(known, ["file", "equipment_id"]).join(roots, ["file", "node_id"])
    order = Window.partitionBy("file", "equipment_id").orderBy(sequence_key(F.col("sequence")), "terminal_id")
    return own.withColumn("position", F.row_number().over(order)).select("file", "equipment_id", "class", "position", "root")


def side_descriptors(sides: DataFrame, bounds: DataFrame, connectors: DataFrame, classes: Classes) -> DataFrame:
    """`sides` (file, equipment_id, class, position, root) with what is met there: the neighbours' and the
    connectors' class histograms as text, has_busbar and has_line.

    Neighbours come from the component's class histogram less the object itself, so no pairs are made.
    """
    inside = bounds.groupBy("file", "root", "class").agg(F.count("*").alias("n"))
    item = F.struct(F.col("class").alias("c"), F.col("n").alias("n"))
    inside = inside.groupBy("file", "root").agg(F.array_sort(F.collect_list(item)).alias("inside"))
    carried = connectors.groupBy("file", "root").agg(
        histogram_text("class", "n").alias("connectors"),
        F.max(F.col("class").isin(*classes.busbars)).alias("has_busbar"),
        F.max(F.col("class").isin(*classes.lines)).alias("has_line"),
    )
    own = sides.join(inside, ["file", "root"], "left").join(carried, ["file", "root"], "left")
    others = F.filter(
        F.transform("inside", lambda x: F.struct(x["c"].alias("c"), (x["n"] - (x["c"] == F.col("class")).cast("int")).alias("n"))), lambda x: x["n"] > 0
    )
    return own.withColumn("others", F.coalesce(others, F.array().cast("array<struct<c:string,n:bigint>>"))).select(
        *sides.columns,
        F.transform("others", lambda x: x["c"]).alias("neighbor_classes"),
        F.array_join(F.transform("others", lambda x: F.concat(x["c"], F.lit(":"), x["n"].cast("string"))), ",").alias("neighbors"),
        F.coalesce("connectors", F.lit("")).alias("connectors"),
        F.coalesce("has_busbar", F.lit(False)).alias("has_busbar"),
        F.coalesce("has_line", F.lit(False)).alias("has_line"),
    )


def _side(neighbors: str = "neighbors", connectors: str = "connectors") -> Column:
    return F.concat(F.col(neighbors), F.lit("|"), F.col(connectors))


def switch_contexts(described: DataFrame, at_least: int = MINIMUM_OCCURRENCES, files_at_least: int = MINIMUM_FILES) -> DataFrame:
    """(switch_class, terminal_sides, ...): how often a switch class meets these sides, in any order."""
    sides = F.array_join(F.array_sort(F.collect_list(_side())), " / ")
    own = described.groupBy("file", "equipment_id", F.col("class").alias("switch_class")).agg(sides.alias("terminal_sides"))
    return keyed_counts(own, ["switch_class", "terminal_sides"], at_least=at_least, files_at_least=files_at_least)


def serial_contexts(described: DataFrame, serial: DataFrame, at_least: int = MINIMUM_OCCURRENCES, files_at_least: int = MINIMUM_FILES) -> DataFrame:
    """(switch_members, ...): the outer sides of both switches around a component between two.

    A member is its class and its sides other than the shared component, in terminal order; the two are sorted.
    """
    at = serial.select("file", F.col("root").alias("shared"))
    touching = described.select("file", "equipment_id", F.col("root").alias("shared")).distinct().join(at, ["file", "shared"])
    sides = described.join(touching, ["file", "equipment_id"])
    outer = F.when(F.col("root") != F.col("shared"), F.struct("position", _side().alias("s")))
    member = F.concat(F.col("class"), F.lit("["), F.array_join(F.transform("o", lambda x: x["s"]), " / "), F.lit("]"))
    members_ = sides.groupBy("file", "shared", "equipment_id", "class").agg(F.array_sort(F.collect_list(outer)).alias("o")).select("file", "shared", member.alias("m"))
    both = members_.groupBy("file", "shared").agg(F.array_join(F.array_sort(F.collect_list("m")), " + ").alias("switch_members"))
    return keyed_counts(both, ["switch_members"], at_least=at_least, files_at_least=files_at_least)


def switch_neighbors(described: DataFrame, objects: DataFrame, at_least: int = MINIMUM_OCCURRENCES, files_at_least: int = MINIMUM_FILES) -> DataFrame:
    """(switch_class, neighbor_class, ..., switch_instance_count, conditional_support): each neighbour class
    counts once a switch; the support is its share of all switches of the class."""
    met = described.select("file", "equipment_id", F.col("class").alias("switch_class"), F.explode("neighbor_classes").alias("neighbor_class")).distinct()
    counted = keyed_counts(met, ["switch_class", "neighbor_class"], at_least=at_least, files_at_least=files_at_least)
    instances = objects.groupBy(F.col("class").alias("switch_class")).agg(F.count("*").alias("switch_instance_count"))
    joined = counted.join(instances, "switch_class", "left").withColumn("switch_instance_count", F.coalesce("switch_instance_count", F.lit(0)))
    support = F.coalesce(F.round(F.try_divide("occurrences", "switch_instance_count"), 6), F.lit(0.0))
    return joined.withColumn("conditional_support", support)


def role_evidence(objects: DataFrame, classes: Classes, patterns: list[tuple[str, str]] | None = None, source: str = "equipment_name_keyword") -> DataFrame:
    """(equipment_class, role, label_source, ...): switches whose name matches a role's pattern, for every such role."""
    patterns = ROLE_PATTERNS if patterns is None else patterns
    named = objects.where(F.col("class").isin(*classes.switches))
    roles = F.filter(F.array(*(F.when(F.col("name").rlike(p), F.lit(r)) for r, p in patterns)), lambda x: x.isNotNull())
    own = named.select("file", F.col("class").alias("equipment_class"), F.explode(roles).alias("role"), F.lit(source).alias("label_source"))
    return keyed_counts(own, ["equipment_class", "role", "label_source"])


def source_breakers(references: DataFrame, objects: DataFrame, reference: str = "Circuit.SourceBreaker") -> DataFrame:
    """The same evidence from explicit references (file, object_id, name, target) to objects of the file."""
    known = objects.select("file", F.col("object_id").alias("target"), F.col("class").alias("equipment_class"))
    own = references.where(F.col("name") == reference).select("file", "target").join(known, ["file", "target"])
    own = own.withColumns({"role": F.lit("circuit_source_breaker"), "label_source": F.lit(reference)})
    return keyed_counts(own, ["equipment_class", "role", "label_source"])


def class_histogram(objects: DataFrame, terminals: DataFrame) -> DataFrame:
    """(class, instances, terminal_counts): objects of each class, and how many have how many terminals."""
    counted = terminals.groupBy("file", F.col("equipment_id").alias("object_id")).agg(F.count("*").alias("t"))
    own = objects.join(counted, ["file", "object_id"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    by = own.groupBy("class", "t").agg(F.count("*").alias("n"))
    item = F.struct("t", "n")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["t"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")
    return by.groupBy("class").agg(F.sum("n").alias("instances"), text.alias("terminal_counts"))


#: The rules, the switch and neighbour classes of the evidence each one cites, and its conclusion.
INTERRUPTING = ["Breaker", "LoadBreakSwitch", "Fuse", "Disconnector"]
ENGINEERING_RULES = [
    ("LOGIC_TRANSFORMER_HV_SWITCH", INTERRUPTING, ["PowerTransformer", "TransformerWinding"], "TransformerHVFeederOrProtectionSwitch"),
    ("LOGIC_PT_BRANCH_SWITCH", INTERRUPTING, ["PotentialTransformer", "VoltageTransformer"], "PTIsolationOrProtectionSwitch"),
    ("LOGIC_BUS_TO_CABLE_FEEDER_SWITCH", None, ["ACLineSegment", "Junction", "CableSegment"], "IncomingOrOutgoingFeederSwitch"),
    ("LOGIC_BUS_COUPLER", [], [], "BusCouplerOrSectionSwitch"),
    ("LOGIC_GROUND_DISCONNECTOR", [], [], "GroundingIsolation"),
    ("LOGIC_CIRCUIT_SOURCE_BREAKER", [], [], "CircuitSourceBreaker"),
    ("LOGIC_SERIAL_SWITCH_COMBINATION", [], [], "SerialSwitchCombination"),
]


def rule_evidence(neighbors: DataFrame, rules: list[tuple[str, list[str] | None, list[str], str]] | None = None) -> DataFrame:
    """(rule_id, functional_role, switch_class, neighbor_class, occurrences, file_count, evidence_grade).

    A rule without evidence of its own has one row of nulls. A rule without switch classes (None) takes any.
    """
    rules = ENGINEERING_RULES if rules is None else rules
    spark = neighbors.sparkSession
    heads = spark.createDataFrame([(r, role) for r, _, _, role in rules], "rule_id string, functional_role string")
    pairs = [(r, s, n) for r, switches, near, _ in rules for s in (switches if switches is not None else [None]) for n in near]
    cited = spark.createDataFrame(pairs, "rule_id string, s string, neighbor_class string")
    found = neighbors.join(F.broadcast(cited), "neighbor_class").where("s is null or s = switch_class")
    found = found.select("rule_id", "switch_class", "neighbor_class", "occurrences", "file_count", "evidence_grade")
    return heads.join(found, "rule_id", "left")


@dataclass
class MinedLogic:
    """Everything that one pass over asset models yields, as lazy tables."""

    direct: DataFrame
    contracted: DataFrame
    serial: DataFrame
    serial_contexts: DataFrame
    switch_contexts: DataFrame
    neighbors: DataFrame
    roles: DataFrame
    classes: DataFrame
    rules: DataFrame


def mine(
    objects: DataFrame,
    terminals: DataFrame,
    references: DataFrame | None = None,
    classes: Classes | None = None,
    at_least: int = MINIMUM_OCCURRENCES,
    files_at_least: int = MINIMUM_FILES,
) -> MinedLogic:
    """The whole mining job. The members and the components are computed once and shared by all tables."""
    classes = classes or Classes()
    own = cut(members(objects, terminals))
    roots = cut(contracted_nodes(own, classes))
    bounds = cut(boundaries(own, roots, classes))
    sides = equipment_roots(objects.where(F.col("class").isin(*classes.switches)), terminals, roots)
    described = cut(side_descriptors(sides, bounds, connector_counts(own, roots, classes), classes))
    neighbors = switch_neighbors(described, objects, at_least, files_at_least)
    roles = role_evidence(objects, classes)
    if references is not None:
        roles = roles.unionByName(source_breakers(references, objects))
    return MinedLogic(
        direct_relations(own, classes, at_least, files_at_least),
        contracted_relations(bounds, at_least, files_at_least),
        serial_patterns(bounds, classes, at_least, files_at_least),
        serial_contexts(described, serial_roots(bounds, classes), at_least, files_at_least),
        switch_contexts(described, at_least, files_at_least),
        neighbors,
        roles,
        class_histogram(objects, terminals),
        rule_evidence(neighbors),
    )
