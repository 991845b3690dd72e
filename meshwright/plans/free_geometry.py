"""Equipment drawn as free shapes: seeds grow to groups, groups give candidates, and templates decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import geometry as g
from meshwright.operators import conductors, graph, groups, matching, text
from meshwright.operators.keys import numbered, top_k_per
from meshwright.operators.lineage import cut
from meshwright.plans.recognise import TYPE_BY_FAMILY, device_seed


def grown_groups(shapes: DataFrame, owned: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """(drawing, group, shape): seeds that no equipment owns, clustered by nearness, with the parts around them.

    shapes: of recognise.shapes_of(); their `seq` names them.
    """
    free = cut(shapes.join(owned.select("drawing", "evidence"), ["drawing", "evidence"], "left_anti").withColumnRenamed("seq", "shape"))
    seeds = free.where(device_seed(h)).select("drawing", "shape", "x0", "y0", "x1", "y1")
    clusters = conductors.shape_clusters(seeds, h)
    parts = free.select("drawing", "shape", "kind", "closed", "length", text.annotation_layer(F.col("layer")).alias("annotation"), "x0", "y0", "x1", "y1")
    return groups.expand_groups(clusters.select("drawing", "group", "shape"), parts, h)


def group_candidates(members: DataFrame, shapes: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """(drawing, group, seq, mode, shapes, handles, points, counts, primitives, owned, closed, circles, open_line, span, box) of
    each group's connected subsets, single shapes and the whole, the first of equal ones."""
    own = cut(members.join(shapes.withColumnRenamed("seq", "shape"), ["drawing", "shape"]))
    name = F.concat_ws("/", F.col("drawing").cast("string"), F.col("group").cast("string"))
    keyed = own.select(name.alias("group"), "shape", "x0", "y0", "x1", "y1")
    place = F.row_number().over(matching.Window.partitionBy("drawing", "group").orderBy("shape")) - 1
    ranked = own.withColumns({"_name": name, "_place": place})
    subsets = matching.subset_candidates(keyed, g.INITIAL_GROUP_GAP_H * h).withColumnRenamed("shape", "_single").withColumnRenamed("group", "_name")
    met = subsets.join(ranked, "_name")
    inside = F.when(F.col("_single").isNotNull(), F.col("_single") == F.col("shape")).when(F.col("mask") == -1, F.lit(True)).otherwise(F.getbit("mask", F.least("_place", F.lit(62)).cast("int")) == 1)
    seq = F.struct("size", F.coalesce("mask", F.lit(0)).alias("mask"), "_single")
    is_closed = F.col("kind").isin("circle", "polygon", "arc") | F.col("closed")
    by = met.where(inside).groupBy("drawing", "group", seq.alias("seq")).agg(
        F.array_sort(F.collect_list(F.struct("shape", "evidence", "kind", "points"))).alias("_s"),
        F.sum(is_closed.cast("int")).alias("closed"), F.sum((F.col("kind") == "circle").cast("int")).alias("circles"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    kinds = F.array_sort(F.array_distinct(F.transform("_s", lambda s: s["kind"])))
    counts = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter("_s", lambda s: s["kind"] == k)).cast("long")))
    made = by.select(
        "drawing", "group", "seq", F.lit("subset").alias("mode"), F.transform("_s", lambda s: s["shape"]).alias("shapes"), F.transform("_s", lambda s: s["evidence"]).alias("handles"),
        F.flatten(F.transform("_s", lambda s: s["points"])).alias("points"), counts.alias("counts"), F.size("_s").alias("primitives"), F.size("_s").alias("owned"), "closed", "circles",
        ((F.size("_s") == 1) & F.get("_s", F.lit(0))["kind"].isin("line", "polyline") & (F.col("closed") == 0)).alias("open_line"),
        F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("span"), "x0", "y0", "x1", "y1",
    )
    return made


def free_equipment(shapes: DataFrame, known: DataFrame, library: DataFrame, h: float = g.CANONICAL_H) -> DataFrame:
    """(drawing, candidate, family, score, margin, reason, handles, x0, y0, x1, y1): the accepted candidates, which share no shape.

    known: equipment with handles that is recognised already. library: (template, family, points, counts, supported).
    """
    owned = known.select("drawing", F.explode("handles").alias("evidence"))
    members = grown_groups(shapes, owned, h)
    made = cut(group_candidates(members, shapes, h))
    largest = matching.largest_template(library).first()["largest"]
    named = made.withColumnsRenamed({"group": "_g"}).withColumn("group", F.struct("drawing", "_g")).withColumn("candidate", F.concat_ws("/", "drawing", "_g", F.to_json("seq")))
    single = F.row_number().over(matching.Window.partitionBy("group").orderBy(F.col("owned"), "seq"))
    fallback = named.withColumn("_n", single).where("_n = 1").drop("_n")
    chosen = cut(matching.distinct_candidates(matching.eligible_candidates(named, fallback, largest, h)))
    templates = cut(library.where("supported").select("template", "family", "points", "counts"))
    usable = chosen.select("candidate", g.normalised(F.col("points")).alias("points"), "counts")
    short = cut(matching.coarse_shortlist(usable, templates))
    similar = g.multiset_similarity(F.col("counts"), F.col("t_counts"))
    measured = matching.chamfer_distances(short.select("candidate", "template", "family"), usable, templates)
    both = measured.join(usable.select("candidate", "counts"), "candidate").join(templates.select("template", F.col("counts").alias("t_counts")), "template")
    scores = cut(matching.combined_scores(both.withColumn("_sim", similar).drop("counts", "t_counts"), F.col("_sim")))
    best = top_k_per(scores.drop("rank"), ["candidate"], [F.col("combined_score").desc(), F.col("template")], 1).drop("rank")
    facts = best.join(matching.family_margin(scores).select("candidate", "margin"), "candidate").join(chosen, "candidate")
    accepted, reason = matching.acceptance(F.col("family"), F.col("combined_score"), F.col("margin"), F.col("owned"), F.col("closed"), F.col("circles"), F.col("span"), F.col("family").isin(*TYPE_BY_FAMILY), h)
    judged = facts.withColumns({"accepted": accepted, "reason": reason, "score": F.col("combined_score")})
    winners = matching.group_winners(judged.select("group", "candidate", "accepted", "primitives", "score", "owned")).where("accepted").select("candidate")
    won = cut(judged.join(winners, "candidate", "left_semi"))
    order = [F.col("score").desc(), F.size("handles").desc(), F.col("candidate")]
    kept = graph.greedy_disjoint(won, "candidate", "handles", order, ["drawing"])
    return kept.select("drawing", "candidate", "family", "score", "margin", "reason", "handles", "x0", "y0", "x1", "y1")


def with_free(equipment: DataFrame, free: DataFrame) -> DataFrame:
    """The equipment of blocks and that of free shapes, numbered together from left to right."""
    types = F.create_map(*(F.lit(x) for kv in TYPE_BY_FAMILY.items() for x in kv))
    made = free.select(
        "drawing", types[F.col("family")].alias("physical_type"), "family", F.when(F.col("family").isin("PT", "ConnectivePoint"), 1).otherwise(2).alias("terminal_count"),
        F.round(F.col("score") / 100, 4).alias("confidence"), F.lit("geometry").alias("source"), "handles", "x0", "y0", "x1", "y1",
    )
    columns = made.columns
    whole = equipment.select(*columns, F.col("insert_seq")).unionByName(made.withColumn("insert_seq", F.lit(None).cast("long")))
    middle = [(F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.col("insert_seq"), F.array_join("handles", ",")]
    return numbered(whole, ["drawing"], middle, "equipment", "EQ")
