"""Ordered keyword rules over texts, and texts near to things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions import geometry as g
from meshwright.operators.keys import first_wins
from meshwright.operators.spatial import box_join, points_in_boxes

#: What block names and attributes say, by the first rule with a token in them:
#: tokens, physical type, template family, terminals.
BLOCK_RULES = [
    (("双绕组变压器", "室内变压器", "专用变压器", "配电变压器", "变压器"), "PowerTransformer", "PowerTransformer", 2),
    (("电压互感器", "PT"), "VoltageTransformer", "PT", 1),
    (("电流互感器", "CT"), "CurrentTransformer", "CT", 2),
    (("断路器", "负荷开关", "隔离开关", "刀闸", "双刀", "熔断器"), "SwitchCombination", "Breaker", 2),
    (("电缆终端", "电缆头", "接头"), "CableTermination", "ConnectivePoint", 1),
    (("T接箱",), "JunctionBox", "JunctionBox", 3),
    (("高压计量表", "电能表", "计量表"), "Meter", "Meter", 2),
]
#: Layers that hold annotations.
ANNOTATION_LAYERS = ["TEXT", "DIM", "TITLE", "TABLE", "DEFPOINT", "文字", "标注", "尺寸", "图框", "表格", "图签"]
#: Blocks that are no equipment.
NON_EQUIPMENT_BLOCKS = ["FRAM", "FRAME", "AVE_RENDER", "AVE_GLOBAL", "SH_SPOT", "T1000", "图框", "标题栏", "配电室", "铁塔"]
#: Labels of cabinets. A text that points elsewhere is none.
CABINET_MARK, DIRECTIONS = "柜", ["引来", "引至", "来自", "接至", "去往"]
CABINET_RULES = [("环网柜", "RingMainUnit"), ("DTU柜", "DTUCabinet"), ("智能", "SmartPublicCabinet"), ("公用柜", "PublicCabinet"), ("", "Cabinet")]


def compact(text: Column, upper: bool = False) -> Column:
    """Without any white space."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", "")
    return F.upper(bare) if upper else bare


def contains_any(text: Column, tokens: list[str] | tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in tokens:
        found = found | text.contains(t)
    return found


def first_rule(text: Column, rules: list[tuple], value: int = 1) -> Column:
    """Item `value` of the first rule whose tokens (item 0) the text contains; null if none does."""
    chosen = None
    for rule in rules:
        tokens = rule[0] if isinstance(rule[0], tuple) else (rule[0],)
        hit = contains_any(text, [t.upper() for t in tokens])
        chosen = F.when(hit, F.lit(rule[value])) if chosen is None else chosen.when(hit, F.lit(rule[value]))
    return chosen


def block_semantics(text: Column, rules: list[tuple] | None = None) -> Column:
    """(physical_type, family, terminals) of the first rule that the compact upper-case text meets, or null."""
    rules = BLOCK_RULES if rules is None else rules
    bare = compact(text, upper=True)
    found = F.struct(*(first_rule(bare, rules, i).alias(n) for i, n in ((1, "physical_type"), (2, "family"), (3, "terminals"))))
    return F.when(found["physical_type"].isNotNull(), found)


def prioritised(sources: list[tuple[Column, str, float]], rules: list[tuple] | None = None) -> Column:
    """(physical_type, family, terminals, source, confidence) of the first source with a meaning; arrays of
    texts are searched in order."""
    out = []
    for texts, name, confidence in sources:
        hits = F.filter(F.transform(texts, lambda t: block_semantics(t, rules)), lambda s: s.isNotNull())
        hit = F.get(hits, F.lit(0))
        out.append(F.when(hit.isNotNull(), F.struct(hit["physical_type"].alias("physical_type"), hit["family"].alias("family"), hit["terminals"].alias("terminals"), F.lit(name).alias("source"), F.lit(confidence).alias("confidence"))))
    return F.coalesce(*out)


def annotation_layer(layer: Column, tokens: list[str] | None = None) -> Column:
    return contains_any(F.upper(F.coalesce(layer, F.lit(""))), ANNOTATION_LAYERS if tokens is None else tokens)


def cabinet_family(text: Column) -> Column:
    """The family of the cabinet that a label names; null if it names none."""
    bare = compact(text)
    family = None
    for token, name in CABINET_RULES:
        hit = bare.contains(token)
        family = F.when(hit, F.lit(name)) if family is None else family.when(hit, F.lit(name))
    return F.when(bare.contains(CABINET_MARK) & ~contains_any(bare, DIRECTIONS), family)


#: Families that a nearby text suggests, by the first rule with a token in it; one text that must match as a whole.
PRIOR_RULES = [(("配变", "变压器"), "PowerTransformer"), (("电压互感",), "PT")]
PRIOR_WORD = ("PT", "PT")


def text_prior(text: Column) -> Column:
    """The family that a nearby text suggests; empty if none."""
    bare = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(""))
    by_rule = F.coalesce(first_rule(bare, PRIOR_RULES), F.lit(""))
    return F.when((F.upper(bare) == PRIOR_WORD[0]) & (by_rule == ""), PRIOR_WORD[1]).otherwise(by_rule)


#: Labels of transformers hold the mark and one of the ratings.
TRANSFORMER_MARK, RATINGS = "变", ["kVA", "KVA", "#专", "专变"]


def transformer_label(text: Column) -> Column:
    """Whether a text names a transformer, and no cabinet."""
    given = F.coalesce(text, F.lit(""))
    return given.contains(TRANSFORMER_MARK) & contains_any(given, RATINGS) & ~given.contains(CABINET_MARK)


def dedupe_texts(texts: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first of texts of the same words at the same rounded place; the grain is a fiftieth of their height."""
    q = F.greatest(F.col("height") * 0.02, F.lit(1e-6))
    keyed = texts.where("text <> ''").withColumns({"_qx": F.rint(F.col("x") / q).cast("long"), "_qy": F.rint(F.col("y") / q).cast("long")})
    return first_wins(keyed, [*group, "text", "_qx", "_qy"], order).drop("_qx", "_qy")


def nearest_prior(boxes: DataFrame, texts: DataFrame, key: list[str], reach: float, family: Column) -> DataFrame:
    """(key, box, text, family, distance): each box's nearest text with a family, within reach of its centre.

    boxes: (key, box, x, y); texts: (key, text_id, x, y, ...). Ties go to the first text.
    """
    known = texts.withColumn("family", family).where("family <> ''")
    a = boxes.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")}).select(*key, "box", "x0", "y0", "x1", "y1")
    b = known.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")}).select(*key, "text_id", "family", "x0", "y0", "x1", "y1")
    pairs = box_join(a, b, key, reach, max(reach, 1.0), gap="euclid")
    near = pairs.groupBy(*key, F.col("l_box").alias("box")).agg(F.min_by(F.struct("r_text_id", "r_family", "gap"), F.struct("gap", "r_text_id")).alias("n"))
    return near.select(*key, "box", F.col("n.r_text_id").alias("text_id"), F.col("n.r_family").alias("family"), F.round("n.gap", 3).alias("distance"))


def _in_windows(points: DataFrame, windows: DataFrame, key: list[str], h: float) -> DataFrame:
    """(key, ...) of every point (x, y) in a window (x0, y0, x1, y1) of its key, by a grid, with the other columns of both."""
    met = points_in_boxes(points, windows, key, 20 * h)
    own = [F.col(f"l_{c}").alias(c) for c in points.columns if c not in key]
    return met.select(*key, *own, *(F.col(f"r_{c}").alias(c) for c in windows.columns if c not in (*key, "x0", "y0", "x1", "y1")))


def labels_to_frames(labels: DataFrame, frames: DataFrame, key: list[str], h: float = g.CANONICAL_H) -> DataFrame:
    """(key, label, frame): each label's nearest frame in its window; of labels with one frame the first has it.

    labels: (key, label, x, y); frames: (key, frame, x0, y0, x1, y1).
    """
    windows = frames.select(
        *key, "frame", F.col("x0").alias("left"), F.col("x1").alias("right"), F.col("y1").alias("top"),
        (F.col("x0") - 10 * h).alias("x0"), (F.col("x1") + 10 * h).alias("x1"), (F.col("y0") - 3 * h).alias("y0"), (F.col("y1") + 12 * h).alias("y1"),
    )
    pairs = _in_windows(labels.select(*key, "label", "x", "y"), windows, key, h)
    gap = g.interval_distance(F.col("x"), F.col("left"), F.col("right")) + F.abs(F.col("y") - F.col("top"))
    near = pairs.groupBy(*key, "label").agg(F.min_by("frame", F.struct(gap, F.col("frame"))).alias("frame"))
    return near.groupBy(*key, "frame").agg(F.min("label").alias("label")).select(*key, "label", "frame")


def labels_to_buses(labels: DataFrame, buses: DataFrame, key: list[str], h: float = g.CANONICAL_H) -> DataFrame:
    """(key, label, segment): the horizontal bus below each label, by height and half as much again of the width between."""
    windows = buses.select(
        *key, "segment", F.col("y").alias("bus_y"), F.col("x0").alias("left"), F.col("x1").alias("right"),
        (F.col("x0") - 30 * h).alias("x0"), (F.col("x1") + 30 * h).alias("x1"), (F.col("y") + 2 * h).alias("y0"), (F.col("y") + 60 * h).alias("y1"),
    )
    near = _in_windows(labels.select(*key, "label", "x", "y"), windows, key, h)
    down, aside = F.col("y") - F.col("bus_y"), g.interval_distance(F.col("x"), F.col("left"), F.col("right"))
    near = near.where(down.between(2 * h, 60 * h) & (aside <= 30 * h))
    return near.groupBy(*key, "label").agg(F.min_by("segment", F.struct(down + aside * 1.5, F.col("segment"))).alias("segment"))


def transformers_to_buses(transformers: DataFrame, buses: DataFrame, key: list[str], h: float = g.CANONICAL_H) -> DataFrame:
    """(key, transformer, container, segment): the bus above each transformer.

    transformers: (key, transformer, x, top); buses: (key, container, segment, y, x0, x1).
    """
    windows = buses.select(
        *key, "container", "segment", F.col("y").alias("bus_y"), F.col("x0").alias("left"), F.col("x1").alias("right"),
        (F.col("x0") - 2 * h).alias("x0"), (F.col("x1") + 2 * h).alias("x1"), (F.col("y") - 50 * h).alias("y0"), F.col("y").alias("y1"),
    )
    near = _in_windows(transformers.select(*key, "transformer", "x", F.col("top").alias("y")), windows, key, h)
    up, aside = F.col("bus_y") - F.col("y"), g.interval_distance(F.col("x"), F.col("left"), F.col("right"))
    near = near.where(up.between(0, 50 * h) & (aside <= 2 * h))
    best = near.groupBy(*key, "transformer").agg(F.min_by(F.struct("container", "segment"), F.struct(up + aside * 2, F.col("container"), F.col("segment"))).alias("b"))
    return best.select(*key, "transformer", "b.*")
