"""Matching point clouds against a template library: coarse shortlist, Chamfer distance, choice."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions import geometry as g
from meshwright.operators.keys import top_k_per
from meshwright.operators.lineage import cut

#: Points kept of a candidate and a template, templates compared exactly, and the scores' weights.
CANDIDATE_POINTS, TEMPLATE_POINTS, SHORTLIST = 256, 128, 8
MINIMUM_TEMPLATE_SCORE, MINIMUM_FAMILY_MARGIN = 78.0, 2.0
SWITCH_FAMILIES = ["Breaker", "Disconnector", "LoadSwitch", "GroundDisconnector", "Fuse"]
#: A template library is broadcast up to this many rows; a larger one is dealt out with its candidates.
LIBRARY_ROWS = 20_000
#: Decimals to which scores are rounded before they are compared, so that sums in another order rank alike.
DIGITS = 9


def coarse_scores(candidates: DataFrame, templates: DataFrame, prior: str | None = None) -> DataFrame:
    """(candidate, template, family, coarse): counts, outline and text prior of every pair.

    candidates: (candidate, points, counts); templates: (template, family, points, counts), and what the
    column `prior` of a candidate names gets a bonus. Every template meets every candidate, as the library is
    a small dimension: the side that is broadcast is counted first.
    """
    outline = lambda df: df.withColumn("outline", g.radial_descriptor(F.col("points")))
    t = outline(templates).select("template", "family", F.col("counts").alias("t_counts"), F.col("outline").alias("t_outline"))
    if templates.count() <= LIBRARY_ROWS:
        t = F.broadcast(t)
    own = outline(candidates).select("candidate", "counts", "outline", *([prior] if prior else []))
    pairs = own.join(t, F.lit(True))
    apart = F.aggregate(F.zip_with("outline", "t_outline", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    score = 0.55 * g.multiset_similarity(F.col("counts"), F.col("t_counts")) + 0.45 * F.greatest(F.lit(0.0), 1 - 0.5 * apart)
    if prior:
        score = score + F.when(F.col("family") == F.col(prior), 0.05).otherwise(0.0)
    return pairs.select("candidate", "template", "family", F.round(score, DIGITS).alias("coarse"), *([prior] if prior else []))


def shortlist(scores: DataFrame, k: int = SHORTLIST, prior: str | None = None) -> DataFrame:
    """The k best templates of each candidate, then the best of a second family if they are all of one, and
    the best of the prior family if it is missing."""
    order = [F.col("coarse").desc(), F.col("template")]
    w = Window.partitionBy("candidate").orderBy(*order)
    ranked = scores.withColumn("rank", F.row_number().over(w))
    top = Window.partitionBy("candidate")
    ranked = ranked.withColumn("_families", F.array_distinct(F.collect_list(F.when(F.col("rank") <= k, F.col("family"))).over(top)))
    other = F.when(~F.array_contains("_families", F.col("family")), F.col("rank"))
    ranked = ranked.withColumn("_second", F.when(F.size("_families") < 2, F.min(other).over(top)))
    keep = (F.col("rank") <= k) | (F.col("rank") == F.col("_second"))
    if prior:
        wanted = F.when((F.col("family") == F.col(prior)) & ~F.array_contains("_families", F.col(prior)), F.col("rank"))
        ranked = ranked.withColumn("_wanted", F.min(wanted).over(top))
        keep = keep | (F.col("rank") == F.col("_wanted"))
    return ranked.where(F.coalesce(keep, F.lit(False))).drop("_families", "_second", "_wanted")


def chamfer(a: np.ndarray, clouds: np.ndarray) -> np.ndarray:
    """For each of the clouds, the mean of the two mean distances to the nearest point of the other one."""
    dx = a[None, :, None, 0] - clouds[:, None, :, 0]
    dy = a[None, :, None, 1] - clouds[:, None, :, 1]
    d = np.sqrt(dx * dx + dy * dy)
    return (d.min(2).mean(1) + d.min(1).mean(1)) / 2


def coarse_shortlist(candidates: DataFrame, templates: DataFrame, k: int = SHORTLIST, prior: str | None = None) -> DataFrame:
    """shortlist(coarse_scores(...)) with the same rows. A library of counted, bounded size goes to every worker as arrays, so
    that candidates are ranked where they are and only their shortlists leave the task; a larger one is joined."""
    if templates.count() > LIBRARY_ROWS:
        return shortlist(coarse_scores(candidates, templates, prior), k, prior)
    outlined = lambda df, *more: df.select(*more, F.map_keys("counts").alias("_k"), F.map_values("counts").alias("_v"), g.radial_descriptor(F.col("points")).alias("_o"))
    library = outlined(templates, "template", "family").orderBy("template").toPandas()
    kinds = {x: i for i, x in enumerate(sorted({x for own in library["_k"] for x in own}))}
    families = library["family"].to_numpy()
    outlines = np.array(library["_o"].tolist(), float).reshape(len(library), -1)

    def counted(keys: list, values: list) -> tuple[np.ndarray, float]:
        """Counts by the library's kinds, and how many are of other kinds."""
        own, other = np.zeros(len(kinds)), 0.0
        for x, n in zip(keys, values, strict=True):
            if x in kinds:
                own[kinds[x]] += n
            else:
                other += n
        return own, other

    counts = np.array([counted(a, b)[0] for a, b in zip(library["_k"], library["_v"], strict=True)]).reshape(len(library), len(kinds))
    names = library["template"].to_numpy()
    extra = [prior] if prior else []

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            hints = frame[prior].tolist() if prior else [None] * len(frame)
            for name, keys, values, outline, hint in zip(frame["candidate"].tolist(), frame["_k"], frame["_v"], frame["_o"], hints, strict=True):
                own, other = counted(keys, values)
                low, high = np.minimum(counts, own).sum(1), np.maximum(counts, own).sum(1) + other
                alike = np.divide(low, high, out=np.ones(len(high)), where=high > 0)
                score = 0.55 * alike + 0.45 * np.maximum(0.0, 1 - 0.5 * np.abs(outlines - np.asarray(outline, float)).sum(1))
                if hint is not None:
                    score = score + 0.05 * (families == hint)
                score = np.round(score, DIGITS)
                order = np.argsort(-score, kind="stable")  # the library comes by name
                chosen, seen = list(range(min(k, len(order)))), {*families[order[:k]]}
                ranked = families[order]
                if len(seen) < 2 and len(others := np.flatnonzero(~np.isin(ranked, list(seen)))):
                    chosen.append(int(others[0]))
                if hint is not None and hint not in seen and len(wanted := np.flatnonzero(ranked == hint)):
                    chosen.append(int(wanted[0]))
                for place in sorted({*chosen}):
                    at = order[place]
                    out.append((name, names[at], families[at], float(score[at]), *([hint] if prior else []), place + 1))
            yield pd.DataFrame(out, columns=["candidate", "template", "family", "coarse", *extra, "rank"])

    rows = outlined(candidates, "candidate", *extra)
    kind = dict(candidates.dtypes) | dict(templates.dtypes)
    schema = ", ".join(f"`{c}` {kind[c]}" for c in ("candidate", "template", "family")) + ", coarse double" + "".join(f", `{c}` {kind[c]}" for c in extra) + ", rank int"
    return rows.mapInPandas(task, schema)


#: Turned templates that a worker remembers.
TURNED = 4_096


def chamfer_distances(pairs: DataFrame, candidates: DataFrame, templates: DataFrame) -> DataFrame:
    """`pairs` with distance and transform: the least over the eight turned and mirrored templates.

    Candidates are aligned to their main axis. Clouds are bounded, so an Arrow batch holds both; they travel as flat
    arrays of numbers, and a worker turns a template once.
    """
    flat = lambda points: F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))
    a = candidates.select("candidate", flat(g.downsampled(g.axis_aligned(F.col("points")), CANDIDATE_POINTS)).alias("_a"))
    b = templates.select("template", flat(g.downsampled(F.col("points"), TEMPLATE_POINTS)).alias("_b"))
    if templates.count() <= LIBRARY_ROWS:
        b = F.broadcast(b)
    names = list(g.DIHEDRAL)
    turns = np.stack([np.array(m, float).reshape(2, 2).T for m in g.DIHEDRAL.values()])

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turned: dict = {}
        for frame in frames:
            best, how = [], []
            for name, own, other in zip(frame["template"].tolist(), frame["_a"], frame["_b"], strict=True):
                clouds = turned.get(name)
                if clouds is None:
                    if len(turned) >= TURNED:
                        turned.clear()
                    y = np.asarray(other, float).reshape(-1, 2)
                    clouds = turned[name] = np.stack([y @ m for m in turns])
                d = np.round(chamfer(np.asarray(own, float).reshape(-1, 2), clouds), DIGITS)
                k = int(d.argmin())  # the first of equal distances wins
                best.append(float(d[k]))
                how.append(names[k])
            yield frame.drop(columns=["_a", "_b"]).assign(distance=best, transform=how)

    both = pairs.join(a, "candidate").join(b, "template").select(*pairs.columns, "_a", "_b")
    kept = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    return both.mapInPandas(task, f"{kept}, distance double, transform string")


def combined_scores(distances: DataFrame, similarity: Column, bonus: Column | None = None) -> DataFrame:
    """`distances` with geometry, primitive, base and combined scores (0 to 100), and rank within the candidate."""
    geometry = F.exp(-8.0 * F.col("distance"))
    base = 100.0 * (0.85 * geometry + 0.15 * similarity)
    extra = F.lit(0.0) if bonus is None else bonus
    scored = distances.withColumns(
        {
            "geometry_score": F.round(geometry * 100, 2),
            "primitive_score": F.round(similarity * 100, 2),
            "base_score": F.round(base, 2),
            "combined_score": F.round(F.least(F.lit(100.0), base + extra), 2),
        }
    )
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("candidate").orderBy(F.col("combined_score").desc(), "template")))


def family_margin(scores: DataFrame) -> DataFrame:
    """(candidate, best_family, best, margin): the best family's lead over the second; all of it if there is one."""
    by = scores.groupBy("candidate", "family").agg(F.max("combined_score").alias("s"))
    ranked = top_k_per(by, ["candidate"], [F.col("s").desc(), F.col("family")], 2)
    pick = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    out = ranked.groupBy("candidate").agg(pick("family", 1).alias("best_family"), pick("s", 1).alias("best"), pick("s", 2).alias("second"))
    return out.select("candidate", "best_family", "best", F.round(F.col("best") - F.coalesce("second", F.lit(0.0)), 2).alias("margin"))


def family_alternatives(scores: DataFrame, k: int = 5) -> DataFrame:
    """The best row of each family, the k best families of a candidate."""
    best = top_k_per(scores.drop("rank"), ["candidate", "family"], [F.col("combined_score").desc(), F.col("template")], 1)
    return top_k_per(best.drop("rank"), ["candidate"], [F.col("combined_score").desc(), F.col("template")], k)


def acceptance(
    family: Column, score: Column, margin: Column, owned: Column, closed: Column, circles: Column, span: Column, in_scope: Column, h: float = g.CANONICAL_H
) -> tuple[Column, Column]:
    """(accepted, reason) of a candidate's best template, by an ordered list of rules."""
    switch = family.isin(*SWITCH_FAMILIES)
    connective = (family == "ConnectivePoint") & (closed > 0) & (circles == 0) & span.between(0.5 * h, 3 * h)
    reason = (
        F.when(~in_scope, "template_family_not_in_equipment_scope")
        .when((span < 0.2 * h) | (span > 12 * h), "component_scale_outside_h_range")
        .when((family == "PowerTransformer") & (circles < 2), "transformer_requires_two_circle_primitives")
        .when((family == "PowerTransformer") & ((score < 55) | (margin < 3)), "transformer_template_evidence_too_weak")
        .when(family == "PowerTransformer", "two_circle_transformer_template_accepted")
        .when(score < MINIMUM_TEMPLATE_SCORE, "template_score_below_threshold")
        .when((margin < MINIMUM_FAMILY_MARGIN) & (score < 90), "template_family_margin_too_small")
        .when((owned == 1) & connective, "single_closed_connective_symbol")
        .when((owned == 1) & switch & (closed > 0) & (score >= 88), "single_closed_switch_symbol")
        .when(owned == 1, "single_generic_primitive_rejected")
        .otherwise("full_template_candidate_accepted")
    )
    good = ["two_circle_transformer_template_accepted", "single_closed_connective_symbol", "single_closed_switch_symbol", "full_template_candidate_accepted"]
    return reason.isin(*good), reason


def family_compatible(expected: Column, actual: Column) -> Column:
    """Whether a family may stand for what a block's name says: itself, or any switch for a breaker."""
    return (expected == actual) | ((expected == "Breaker") & actual.isin(*SWITCH_FAMILIES))


#: The size that counts where no template is known, and how much larger and how wide, in H, a candidate may be.
USUAL_SIZE, LARGER, LEAST_SPAN, MOST_SPAN = 20, 2, 0.2, 12.0


def largest_template(templates: DataFrame) -> DataFrame:
    """(largest): the most primitives of a supported template, from (supported, counts: map)."""
    size = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, v: a + v)
    return templates.agg(F.coalesce(F.max(F.when(F.col("supported"), size)), F.lit(USUAL_SIZE)).alias("largest"))


def eligible_candidates(candidates: DataFrame, fallback: DataFrame, largest: int, h: float = g.CANONICAL_H) -> DataFrame:
    """The candidates of a size that templates have; a group without any has its fallback candidates.

    Both: (group, candidate, primitives, span or null, owned, open_line, ...); owned counts the group's own shapes and
    open_line says that the only one is an open line.
    """
    sized = F.col("span").isNull() | F.col("span").between(LEAST_SPAN * h, MOST_SPAN * h)
    kept = candidates.where((F.col("primitives") <= LARGER * largest) & sized & ~((F.col("owned") == 1) & F.col("open_line")))
    return kept.unionByName(fallback.join(kept.select("group").distinct(), "group", "left_anti"))


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """The first in `seq` of a group's candidates with the same handles, mode and counts, numbered after that.

    candidates: (group, seq, handles: array, mode, counts: map, ...).
    """
    entries = F.array_sort(F.map_entries("counts"))
    keyed = candidates.withColumns({"_h": F.array_sort(F.array_distinct("handles")), "_c": F.to_json(entries)})
    first = F.row_number().over(Window.partitionBy("group", "_h", "mode", "_c").orderBy("seq"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("seq"))
    return keyed.withColumn("_first", first).where("_first = 1").drop("_h", "_c", "_first").withColumn("number", place)


def group_winners(evaluations: DataFrame) -> DataFrame:
    """The candidate that each group chooses: (group, candidate, accepted, primitives, score, owned) rows in,
    one a group out, by acceptance tier, score with a small bonus for more primitives, score, and size."""
    bonus = F.least(F.log2(F.greatest(F.col("primitives"), F.lit(1))) * 0.75, F.lit(2.5))
    tier = F.when(F.col("accepted") & (F.col("primitives") > 1), 2).when(F.col("accepted"), 1).otherwise(0)
    scored = evaluations.withColumns({"tier": tier, "selection": F.round(F.col("score") + bonus, DIGITS)})
    order = [F.col(c).desc() for c in ("tier", "selection", "score", "owned")] + [F.col("candidate")]
    return top_k_per(scored, ["group"], order, 1).drop("rank")


def connected_subsets(shapes: list[tuple[float, float, float, float]], gap: float) -> list[int]:
    """Masks of the proper subsets of at most six boxes that hang together within the gap, and the whole."""
    n = len(shapes)
    near = [0] * n
    for i, a in enumerate(shapes):
        for j, b in enumerate(shapes):
            dx, dy = max(0.0, a[0] - b[2], b[0] - a[2]), max(0.0, a[1] - b[3], b[1] - a[3])
            if math.hypot(dx, dy) <= gap:
                near[i] |= 1 << j
    found = []
    for mask in range(1, 1 << n):
        seen = mask & -mask
        while True:
            grown = seen
            for i in range(n):
                if seen >> i & 1:
                    grown |= near[i] & mask
            if grown == seen:
                break
            seen = grown
        if seen == mask:
            found.append(mask)
    return found


#: A group of more shapes is joined by broadcast, so that it spreads over the tasks that read it.
HUGE = 10_000


def subset_candidates(groups: DataFrame, gap: float, most: int = 6) -> DataFrame:
    """(group, mask, shape, size) of each group's candidate subsets; groups above `most` shapes give single shapes and the whole.

    groups: (group, shape, x0, y0, x1, y1); shapes number from the least. Up to `most` shapes a candidate is a mask;
    above, a single shape is named in `shape`, without a mask, and the whole is the mask -1.
    """
    kinds = dict(groups.dtypes)

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("shape")
        masks = connected_subsets(list(frame[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)), gap)
        whole = (1 << len(frame)) - 1
        masks = [m for m in masks if m != whole] + [whole]
        return pd.DataFrame({"group": frame["group"].iloc[0], "mask": masks, "size": [m.bit_count() for m in masks]})

    counts = cut(groups.groupBy(F.col("group").alias("_group")).agg(F.count("*").alias("_n")))
    huge = F.broadcast(counts.where(F.col("_n") > HUGE))  # at most one row for HUGE of the input
    same = F.col("group").eqNullSafe(F.col("_group"))
    others = groups.join(huge, same, "left_anti").join(counts.where(F.col("_n") <= HUGE), same)
    large = others.where(F.col("_n") > most).select("group", "shape").unionByName(groups.join(huge.where(F.col("_n") > most), same, "left_semi").select("group", "shape"))
    few = others.where(F.col("_n") <= most).select("group", "shape", "x0", "y0", "x1", "y1")
    no_mask, no_shape = F.lit(None).cast("long").alias("mask"), F.lit(None).cast(kinds["shape"]).alias("shape")
    masks = few.groupBy("group").applyInPandas(task, f"group {kinds['group']}, mask long, size int").select("group", "mask", no_shape, "size")
    singles = large.select("group", no_mask, "shape", F.lit(1).alias("size"))
    wholes = counts.where(F.col("_n") > most).select(F.col("_group").alias("group"), F.lit(-1).cast("long").alias("mask"), no_shape, F.col("_n").cast("int").alias("size"))
    return masks.unionByName(singles).unionByName(wholes)
