"""What a switch is for, from what it connects to, and what it is made of, from mined patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.operators.keys import histogram_text, top_k_per

#: Classes under which devices enter the rules.
LOGIC_CLASS = {
    "VoltageTransformerFunctionalBranch": "PotentialTransformer",
    "VoltageTransformer": "PotentialTransformer",
    "CableTermination": "CableSegment",
    "CableTerminal": "CableSegment",
    "SwitchCombination": "SwitchCombination",
}
#: Roles and their confidence.
ROLES = {
    "TransformerHVFeederOrProtectionSwitch": 0.90,
    "PTIsolationOrProtectionSwitch": 0.86,
    "IncomingOrOutgoingFeederSwitch": 0.80,
    "BusCouplerOrSectionSwitch": 0.78,
    "SerialSwitchCombination": 0.62,
}


def logic_class(new_type: Column, old_type: Column) -> Column:
    given = F.coalesce(F.nullif(new_type, F.lit("")), F.nullif(old_type, F.lit("")), F.lit("Unknown"))
    known = F.create_map(*(F.lit(x) for kv in LOGIC_CLASS.items() for x in kv))
    return F.coalesce(known[given], given)


def node_contexts(members: DataFrame, key: list[str], switch: str = "SwitchCombination") -> DataFrame:
    """(key, node, members, switches, classes, busbar_like) of distinct (key, node, equipment, class) rows."""
    by = members.select(*key, "node", "equipment", "class").distinct().groupBy(*key, "node", "class").agg(F.count("*").alias("n"))
    out = by.groupBy(*key, "node").agg(
        F.sum("n").alias("members"),
        F.sum(F.when(F.col("class") == switch, F.col("n")).otherwise(0)).alias("switches"),
        histogram_text("class", "n").alias("classes"),
    )
    return out.withColumn("busbar_like", (F.col("members") >= 3) | (F.col("switches") >= 2))


def switch_roles(
    members: DataFrame,
    key: list[str],
    switch: str = "SwitchCombination",
    transformer: tuple[str, ...] = ("PowerTransformer", "TransformerWinding"),
    potential: tuple[str, ...] = ("PotentialTransformer", "VoltageTransformer"),
    cable: tuple[str, ...] = ("CableSegment",),
) -> DataFrame:
    """(key, equipment, functional_role, confidence, roles, conflict) for every switch that touches a node.

    A side that is not like a busbar tells by its neighbours; busbar sides tell by their number. All roles
    that hold are kept, the most confident first. Neighbours are counted from each node's class histogram.
    """
    own = members.select(*key, "node", "equipment", "class").distinct()
    contexts = node_contexts(own, key, switch).select(*key, "node", "busbar_like")
    counts = own.groupBy(*key, "node").agg(*(F.sum(F.col("class").isin(*c).cast("int")).alias(n) for c, n in ((transformer, "_t"), (potential, "_p"), (cable, "_c"))))
    sides = own.where(F.col("class") == switch).join(contexts, [*key, "node"]).join(counts, [*key, "node"])
    plain = ~F.col("busbar_like")
    summed = sides.groupBy(*key, "equipment").agg(
        F.sum(F.col("busbar_like").cast("int")).alias("buses"),
        *(F.max(plain & (F.col(c) > 0)).alias(c) for c in ("_t", "_p", "_c")),
    )
    holds = {
        "TransformerHVFeederOrProtectionSwitch": F.col("_t"),
        "PTIsolationOrProtectionSwitch": F.col("_p"),
        "IncomingOrOutgoingFeederSwitch": (F.col("buses") >= 1) & F.col("_c"),
        "BusCouplerOrSectionSwitch": F.col("buses") >= 2,
    }
    found = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in holds.items())), lambda r: r.isNotNull())
    roles = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("SerialSwitchCombination")))
    confidence = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    out = summed.withColumn("_r", roles)
    return out.select(
        *key, "equipment", F.col("_r")[0].alias("functional_role"), confidence[F.col("_r")[0]].alias("confidence"),
        F.array_join("_r", ",").alias("roles"), (F.size("_r") > 1).alias("conflict"),
    )


#: Patterns that a library may have: its classes are few, and their pairs are named in the plan.
PATTERNS = 2_000


def physical_candidates(switches: DataFrame, patterns: DataFrame, k: int = 5) -> DataFrame:
    """(equipment, name, score, occurrences, rank): what a switch may be made of.

    switches: (equipment, templates: text of its matched templates); patterns: (class_a, class_b, occurrences), of
    which there are at most PATTERNS. Geometry weighs 0.65, the pattern's frequency on a log scale 0.35.
    """
    most = F.greatest(F.coalesce(F.max("occurrences"), F.lit(1)), F.lit(1))
    top = patterns.agg(most.alias("_most"))
    most_seen = top.first()["_most"]
    known = patterns.withColumn("_most", F.lit(most_seen)).withColumns({"_a": F.least("class_a", "class_b"), "_b": F.greatest("class_a", "class_b")})
    if (count := patterns.count()) > PATTERNS:
        raise ValueError(f"{count} patterns are more than the {PATTERNS} that a switch is compared with")
    kind = "array<struct<_a:string,_b:string,occurrences:bigint,_most:bigint>>"
    listed = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in ("_a", "_b", "occurrences", "_most"))) for r in known.collect())).cast(kind)
    pairs = switches.select("*", F.explode(listed).alias("_p")).select(*switches.columns, "_p.*")
    both = F.col("templates").contains("Breaker") & F.col("templates").contains("Disconnector")
    either = F.col("_a").isin("Breaker", "Disconnector") | F.col("_b").isin("Breaker", "Disconnector")
    geometry = F.when(both, 1.0).when(either, 0.35).otherwise(0.05)
    frequency = F.try_divide(F.log1p(F.col("occurrences").cast("double")), F.log1p(F.col("_most").cast("double")))
    scored = pairs.select("equipment", F.concat_ws("+", "_a", "_b").alias("name"), F.round(0.65 * geometry + 0.35 * frequency, 6).alias("score"), "occurrences")
    return top_k_per(scored, ["equipment"], [F.col("score").desc(), F.col("occurrences").desc(), F.col("name")], k)


def enriched(equipment: DataFrame, roles: DataFrame, key: list[str], switch: str = "SwitchCombination") -> DataFrame:
    """`equipment` (key, equipment, class, ...) with the role of each switch, its confidence and whether roles conflict.

    What is no switch has none of these; a switch without a node keeps the role of a serial one.
    """
    own = roles.select(*key, "equipment", "functional_role", "confidence", "conflict")
    joined = equipment.join(own.withColumnRenamed("confidence", "role_confidence"), [*key, "equipment"], "left")
    is_switch = F.col("class") == switch
    serial = "SerialSwitchCombination"
    return joined.withColumns(
        {
            "functional_role": F.when(is_switch, F.coalesce("functional_role", F.lit(serial))),
            "role_confidence": F.when(is_switch, F.coalesce("role_confidence", F.lit(ROLES[serial]))),
            "conflict": F.when(is_switch, F.coalesce("conflict", F.lit(False))),
        }
    )


def role_summary(equipment: DataFrame, key: list[str]) -> DataFrame:
    """(key, equipment_count, switch_count, roles: text of role:count) of enriched() rows."""
    by = equipment.groupBy(*key, "functional_role").agg(F.count("*").alias("n"))
    known = F.col("functional_role").isNotNull()
    return by.groupBy(*key).agg(
        F.sum("n").alias("equipment_count"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("switch_count"),
        histogram_text("functional_role", "n", where=known).alias("roles"),
    )
