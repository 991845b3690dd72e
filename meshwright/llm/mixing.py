"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every row gets target / source size copies on average: a whole part that is certain and a fraction that
is rounded. Two fractional rows meet and move mass (copies times size) from one to the other at random,
fairly, until one of them is integral; the other goes on. So a source's mass stays what it was, and at
most one row of a source is left over. Rows meet in chunks of bounded size, the chunks' leftovers meet in
chunks of chunks, and so on: a reduction tree whose tasks never grow.

The smaller of two rows tends to be settled, so what the tree leaves over tends to be large. Some RESERVE rows of
each source, picked by hash, therefore wait at its root. There rows are settled by descending size, and what each
is off goes to the next, so that a source misses its target by about the size of its smallest waiting row.

Defined cases: a null text has size 0; null is a source of its own, last in order; a row of size 0, or
in a source of target 0, is taken 0 times. Rows that repeat an id are rounded one by one. Random numbers
are hashes of the ids and the seed, so reruns agree. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.common import WORD, blank, cut, numbered, on_small

#: Rows that meet in one chunk, and rows of a source that wait at the root, on average.
CHUNK, RESERVE = 32, 256
ITEM = "struct<order:bigint,id:bigint,mark:bigint,size:bigint,base:bigint,p:double>"
DONE = "array<struct<id:bigint,mark:bigint,size:bigint,copies:bigint>>"


def word_count(text: str | Column) -> Column:
    return F.regexp_count(blank(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, int]:
    """(_source, source_size, rows, target) from (_source, _size) rows, and the number of sources.

    Sources take the weights in turn, by code point, null last. The level at which weight times level
    fills the total is found by rounds of one distributed aggregate each: sources above their limit are
    set to it and the others share the rest.
    """
    stats = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows"))
    ranked = numbered(stats, [F.col("_source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("_weight", weight.cast("double")).withColumn("_limit", F.col("source_size") * F.lit(most)))
    whole, weighed, count = ranked.agg(F.sum("source_size"), F.sum("_weight"), F.count("*")).first()
    total, level = share * (whole or 0), 0.0
    if whole:
        level = total / weighed
        while True:
            above = F.col("_weight") * F.lit(level) > F.col("_limit")
            fixed, rest = ranked.agg(
                F.coalesce(F.sum(F.when(above, F.col("_limit"))), F.lit(0.0)),
                F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0.0)),
            ).first()
            if not rest or (new := (total - fixed) / rest) <= level:
                break
            level = new
    target = F.least(F.col("_limit"), F.col("_weight") * F.lit(level))
    return ranked.select("_source", "source_size", "rows", target.alias("target")), count


def _uniform(*parts: Column | str) -> Column:
    """In [0, 1), from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _settled(x: Column, up: Column) -> Column:
    return F.struct(x["id"].alias("id"), x["mark"].alias("mark"), x["size"].alias("size"), (x["base"] + F.when(up, 1).otherwise(0)).cast("long").alias("copies"))


def _with_p(x: Column, p: Column) -> Column:
    return F.struct(*(x[c].alias(c) for c in ("order", "id", "mark", "size", "base")), p.alias("p"))


def _meet(items: Column, seed: int) -> Column:
    """Folds an array of ITEM to (left: the fractional item or null, done: DONE)."""

    def step(state: Column, b: Column) -> Column:
        a = state.left
        up = F.least((1 - a.p) * a["size"], b.p * b["size"])  # mass that can go from b to a
        down = F.least(a.p * a["size"], (1 - b.p) * b["size"])
        rise = _uniform(a.order, b.order, a.id, b.id, F.lit(seed)) * (up + down) < down
        # which of the two becomes integral: the one whose bound is met first
        a_ends = F.when(rise, (1 - a.p) * a["size"] <= b.p * b["size"]).otherwise(a.p * a["size"] <= (1 - b.p) * b["size"])
        mass = F.when(rise, up).otherwise(-down)
        stays = F.when(a_ends, _with_p(b, b.p - mass / b["size"])).otherwise(_with_p(a, a.p + mass / a["size"]))
        ends = F.when(a_ends, _settled(a, rise)).otherwise(_settled(b, ~rise))
        tiny = F.lit(1e-12)
        both = (stays.p <= tiny) | (stays.p >= 1 - tiny)
        done = F.when(both, F.concat(state.done, F.array(ends, _settled(stays, stays.p > 0.5)))).otherwise(F.concat(state.done, F.array(ends)))
        met = F.struct(F.when(~both, stays).otherwise(F.lit(None).cast(ITEM)).alias("left"), done.alias("done"))
        return F.when(a.isNull(), F.struct(b.alias("left"), state.done.alias("done"))).otherwise(met)

    empty = F.struct(F.lit(None).cast(ITEM).alias("left"), F.array().cast(DONE).alias("done"))
    return F.aggregate(items, empty, step)


def _settle(items: Column, seed: int) -> Column:
    """DONE of an array of ITEM by descending size: each is rounded at random, and takes over what those before are off."""

    def step(state: Column, x: Column) -> Column:
        p = x["p"] + state["off"] / x["size"]
        up = _uniform(x["order"], x["id"], F.lit(seed)) < p
        off = (p - F.when(up, 1).otherwise(0)) * x["size"]
        return F.struct(off.alias("off"), F.concat(state["done"], F.array(_settled(x, up))).alias("done"))

    empty = F.struct(F.lit(0.0).alias("off"), F.array().cast(DONE).alias("done"))
    return F.aggregate(items, empty, step)["done"]


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, size, source_size, target, copies, taken, _mark) for every row; copies is how often the mix repeats it.

    _mark is a hash of the row's text.
    """
    rows = cut(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).alias("_source"), word_count(text_col).alias("_size"), F.xxhash64(text_col).alias("_mark")))
    sources, count = source_targets(rows, weights, share, most)
    sources = cut(sources)
    hinted = on_small(sources, count)
    same = F.col("r._source").eqNullSafe(F.col("s._source"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = rows.alias("r").join(hinted.alias("s"), same).select("r._source", "r._id", "r._mark", "r._size", "rows", each.alias("_each"))
    base = F.floor(F.col("_each") + 1e-12)
    part = F.greatest(F.col("_each") - base, F.lit(0.0))
    split = placed.withColumns({"base": base.cast("long"), "p": part})
    certain = (F.col("_size") == 0) | (F.col("p") <= 1e-12)
    done = split.where(certain).select("_source", F.col("_id").alias("id"), F.col("_mark").alias("mark"), F.col("_size").alias("size"), F.when(F.col("_size") == 0, F.lit(0)).otherwise(F.col("base")).cast("long").alias("copies"))
    order = F.xxhash64("_id", "_size", F.lit(seed))
    fractional = cut(
        split.where(~certain).select(
            "_source",
            F.ceil(F.col("rows") / CHUNK).alias("_chunks"),
            (F.pmod(F.xxhash64("_id", "_mark", F.lit(seed + 1)), F.ceil(F.col("rows") / RESERVE)) == 0).alias("_waits"),
            order.alias("order"),
            F.col("_id").alias("id"),
            F.col("_mark").alias("mark"),
            F.col("_size").alias("size"),
            "base",
            "p",
        )
    )
    item = F.struct("order", "id", "mark", "size", "base", "p")
    left = fractional.where("not _waits").drop("_waits")
    chunks = -(-(sources.agg(F.max("rows")).first()[0] or 0) // CHUNK)
    while True:
        met = (
            left.withColumn("_chunk", F.pmod(F.xxhash64("order", "id", F.lit(chunks)), F.col("_chunks")))
            .groupBy("_source", "_chunks", "_chunk")
            .agg(F.sort_array(F.collect_list(item)).alias("items"))
            .select("_source", "_chunks", _meet(F.col("items"), seed).alias("m"))
        )
        met = cut(met)
        done = done.unionByName(met.select("_source", F.explode("m.done").alias("d")).select("_source", "d.*"))
        left = met.where("m.left is not null").select("_source", F.ceil(F.col("_chunks") / CHUNK).alias("_chunks"), "m.left.*")
        if chunks <= 1:
            break
        chunks = -(-chunks // CHUNK)
    # at the root: one row a source at most that is left over, and those that have waited
    root = left.drop("_chunks").unionByName(fractional.where("_waits").drop("_waits", "_chunks"))
    by_size = F.struct((-F.col("size")).alias("less"), "order", "id", "mark", "size", "base", "p")
    last = root.groupBy("_source").agg(F.sort_array(F.collect_list(by_size)).alias("items")).select("_source", F.explode(_settle(F.col("items"), seed + 1)).alias("d")).select("_source", "d.*")
    d = done.unionByName(last).alias("d")
    return d.join(hinted.alias("s"), F.col("d._source").eqNullSafe(F.col("s._source"))).select(
        F.col("id").alias(id_col),
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.col("mark").alias("_mark"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as mix_sources() takes it, with their own columns.

    Rows go by id and hash of the text; those that share both share out the copies decided for them.
    """
    mix = mix_sources(docs, id_col=id_col, text_col=text_col, **settings)
    copies = mix.groupBy(F.col(id_col).alias("_mix_id"), "_mark").agg(F.sort_array(F.collect_list(F.col("copies").cast("int"))).alias("_copies"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash"))
    joined = rows.join(copies, F.col("_id").eqNullSafe(F.col("_mix_id")) & (F.col("_hash") == F.col("_mark")))
    place = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_id"))
    own = joined.withColumn("_n", F.element_at("_copies", place)).where("_n > 0")
    return own.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_repeat")).select("_row.*")
