"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow.llm.common import uniform
from binflow.session import materialize

#: Items that one step of the reduction tree rounds together.
FANOUT = 64
#: Halvings between two classes of sizes.
HALVINGS = 3
#: Rows of one unit that one array spells out.
CHUNK = 100_000


def source_targets(sizes: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Adds ``target`` to one row per source (``_source``, ``source_size``).

    Sources by code point, NULL last, get the weights in turn and share the total
    by them. No target is above ``cap`` times its source's size; what is cut is
    shared again. The level at which this ends is where the sources, ordered by
    size over weight, stop being capped, so it takes one pass, not rounds.
    The windows run over one row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("_source"))
    turn = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), turn)
    limit = F.lit(float(cap)) * F.col("source_size")
    rows = sizes.withColumn("_w", w).withColumn("_limit", limit)
    by_limit = Window.orderBy(F.col("_limit") / F.col("_w"), F.asc_nulls_last("_source")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(by_limit), F.lit(0.0))
    open_w = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by_limit), F.lit(0.0))
    levels = rows.withColumn("_level", left / open_w)
    fits = F.when(F.col("_level") <= F.col("_limit") / F.col("_w"), F.col("_level"))
    first = F.min_by(fits, F.when(fits.isNotNull(), F.col("_limit") / F.col("_w"))).over(everything)
    target = F.least(F.col("_limit"), F.coalesce(first * F.col("_w"), F.col("_limit")))
    return levels.select(*sizes.columns, target.alias("target"))


def _integral(p: Column) -> Column:
    return (p <= 0.0) | (p >= 1.0)


def _pair(a: Column, b: Column, seed: int) -> Column:
    """Two items after the transfer of words between them: struct (pa, pb), at least one of them 0 or 1.

    The words p * size of both together stay; each direction has the chance that
    keeps the expected p of each.
    """
    room_a, room_b = (1.0 - a["p"]) * a["size"], (1.0 - b["p"]) * b["size"]
    has_a, has_b = a["p"] * a["size"], b["p"] * b["size"]
    to_a, to_b = F.least(room_a, has_b), F.least(room_b, has_a)
    lift_a = uniform(F.lit(seed), a["id"], a["k"], b["id"], b["k"]) * (to_a + to_b) < to_b
    lifted_a = F.struct(
        F.when(room_a <= has_b, 1.0).otherwise(a["p"] + to_a / a["size"]).alias("pa"),
        F.when(has_b <= room_a, 0.0).otherwise(b["p"] - to_a / b["size"]).alias("pb"),
    )
    lifted_b = F.struct(
        F.when(has_a <= room_b, 0.0).otherwise(a["p"] - to_b / a["size"]).alias("pa"),
        F.when(room_b <= has_a, 1.0).otherwise(b["p"] + to_b / b["size"]).alias("pb"),
    )
    return F.when(lift_a, lifted_a).otherwise(lifted_b)


def _step(state: Column, item: Column, seed: int) -> Column:
    """Pairs the carried item with the next: the integral one is done, the other is carried."""
    carry = state["carry"]

    def settle(moved: Column) -> Column:
        a, b = carry.withField("p", moved["pa"]), item.withField("p", moved["pb"])
        a_done = _integral(moved["pa"])
        return F.struct(
            F.when(a_done, b).otherwise(a).alias("carry"),
            F.concat(state["done"], F.array(F.when(a_done, a).otherwise(b))).alias("done"),
        )

    moved = F.when(_integral(carry["p"]), F.struct(carry["p"].alias("pa"), item["p"].alias("pb"))).otherwise(
        _pair(carry, item, seed)
    )
    # A one-element array binds the moved pair, so it is computed once.
    return F.get(F.transform(F.array(moved), settle), 0)


def _reduce(level: DataFrame, most: int, seed: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds items (_source, _block, _item) up a tree: those decided at each level, and one open item a source.

    ``most`` is the largest number of items of a source.
    """
    decided, depth, n_blocks = [], 0, max(1, -(-most // FANOUT))
    while True:
        grouped = level.groupBy("_source", "_block").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
        start = F.struct(F.get("_items", 0).alias("carry"), F.slice("_items", 1, 0).alias("done"))
        rest = F.slice("_items", 2, F.size("_items"))
        state = F.aggregate(rest, start, lambda s, x: _step(s, x, seed + 3 + depth))
        done = materialize(grouped.select("_source", "_block", state.alias("_s")).select("_source", "_block", "_s.*"))
        decided.append(done.select("_source", F.explode("done").alias("_item")))
        last = done.select("_source", "_block", F.col("carry").alias("_item"))
        if n_blocks == 1:
            return decided, last.select("_source", "_item")
        level = last.withColumn("_block", F.floor(F.col("_block") / FANOUT))
        n_blocks = -(-n_blocks // FANOUT)
        depth += 1


def mix_sources(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    cap: float = 3.0,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    seed: int = 20,
) -> DataFrame:
    """How often each document goes into a mix in which sources have their target sizes.

    Returns one row per row of ``docs``: the id, the source, ``size``,
    ``source_size``, ``target`` (of the source), ``copies`` and ``taken`` = copies
    times size. Every document of a source has the expected copies target over
    source size. Their whole part is sure; the fractions are rounded in pairs:
    words move between two documents at random until one fraction is 0 or 1, and
    the other goes on. Words are kept in every pair. Blocks of about ``FANOUT`` documents leave one open
    fraction each, blocks of blocks again, up to one per source.

    Large documents are decided first: sizes fall into classes (HALVINGS), and the one
    that a class leaves open is paired with all smaller documents of its source together, whose
    expected copies, between 0 and ``cap``, take up the words. So a source ends within one document of the
    smallest class of its target, as far as its smaller documents can take up what the larger ones leave.

    Random numbers depend on ids and ``seed`` only, so reruns agree. Rows of equal
    id, source and size are interchangeable: they are counted, not gathered, and
    numbered when they are rounded. A NULL size is 0; a document of size 0 gets
    the whole part of its expected copies and takes nothing. A NULL source is the
    last source. NULL ids are ids like others. Other columns are not read, so
    their names cannot clash. An empty table gives an empty table.
    """
    n_words = F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")
    units = materialize(
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words.alias("_size"))
        .groupBy("_id", "_source", "_size")
        .agg(F.count(F.lit(1)).alias("_m"))
        .withColumn("_class", F.when(F.col("_size") > 0, F.floor(F.log2("_size") / HALVINGS)).otherwise(-1).cast("int"))
    )
    # One row a source and class: how many it holds, and the words of all smaller classes.
    smaller = Window.partitionBy("_source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    held = materialize(
        units.groupBy("_source", "_class")
        .agg(F.sum(F.col("_size") * F.col("_m")).alias("_words"), F.sum("_m").alias("_n"))
        .withColumn("_below", F.coalesce(F.sum("_words").over(smaller), F.lit(0)))
    )
    sizes = held.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = materialize(source_targets(sizes, cap, weights).withColumn("_ratio", ratio).withColumnRenamed("_source", "_of"))
    ratios = targets.select("_of", "_ratio")
    targets = targets.drop("_ratio")
    base, fraction = F.floor("_ratio"), F.col("_ratio") - F.floor("_ratio")
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / CHUNK))
    within = F.sequence(F.col("_c") * CHUNK, F.least((F.col("_c") + 1) * CHUNK, F.col("_m")) - 1)
    item = F.struct(
        (-F.col("_size")).alias("order"),
        uniform(F.lit(seed + 1), "_id", "_size", "_k").alias("tie"),
        F.col("_id").alias("id"),
        F.col("_size").alias("size"),
        F.col("_k").alias("k"),
        F.when(F.col("_size") > 0, fraction).otherwise(0.0).alias("p"),
        base.alias("base"),
        F.col("source_size").alias("source_size"),
        F.col("target").alias("target"),
    )

    def spelled(at: Column) -> DataFrame:
        """Items of the classes chosen, with the expected copies of their source by now."""
        rows = units.where(at).join(targets, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
        rows = rows.join(ratios, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
        return rows.withColumn("_c", F.explode(chunks)).withColumn("_k", F.explode(within))

    decided = [spelled(F.col("_class") < 0).select("_source", item.alias("_item"))]
    # At most some twenty classes, whatever the input.
    per_class = held.where("_class >= 0").groupBy("_class").agg(F.max("_n").alias("n")).collect()
    for label, most in sorted(((r["_class"], r["n"]) for r in per_class), reverse=True):
        rows = spelled(F.col("_class") == label)
        decided.append(rows.where(fraction == 0).select("_source", item.alias("_item")))
        count = held.where(F.col("_class") == label).select(F.col("_source").alias("_of"), "_n", "_below")
        open_ = rows.where(fraction > 0).join(count, F.col("_source").eqNullSafe(F.col("_of")))
        blocks = F.greatest(F.ceil(F.col("_n") / FANOUT), F.lit(1)).cast("long")
        block = F.pmod(F.xxhash64(F.lit(seed + 2), "_id", "_size", "_k"), blocks)
        done, last = _reduce(open_.select("_source", block.alias("_block"), item.alias("_item")), most, seed)
        decided += done
        # The open item and the smaller documents of its source, as one item of all words that they can give.
        last = last.join(count, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
        last = last.join(ratios, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
        share, words = F.col("_ratio") / cap, F.col("_below") * cap
        pool = F.struct(F.lit(f"class {label}").alias("id"), F.lit(0).alias("k"), share.alias("p"), words.alias("size"))
        settled = _integral(F.col("_item.p")) | (F.col("_below") == 0)
        moved = F.when(settled, F.struct(F.col("_item.p").alias("pa"), share.alias("pb"))).otherwise(
            _pair(F.col("_item"), pool, seed)
        )
        last = materialize(last.select("_source", "_item", moved.alias("_moved")))
        p = F.col("_moved.pa")
        lot = uniform(F.lit(seed), "_item.id", "_item.k")
        bit = F.when(_integral(p), p).otherwise(F.when(lot < p, 1.0).otherwise(0.0))
        decided.append(last.select("_source", F.col("_item").withField("p", bit).alias("_item")))
        after = last.select("_source", (F.col("_moved.pb") * cap).alias("_new"))
        ratios = materialize(
            ratios.join(after, F.col("_of").eqNullSafe(F.col("_source")), "left").select("_of", F.coalesce("_new", "_ratio").alias("_ratio"))
        )
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    copies = (F.col("_item.base") + F.round("_item.p")).cast("long")
    return out.select(
        F.col("_item.id").alias(id_col),
        F.col("_source").alias(source_col),
        F.col("_item.size").alias("size"),
        F.col("_item.source_size").alias("source_size"),
        F.col("_item.target").alias("target"),
        copies.alias("copies"),
        (copies * F.col("_item.size")).alias("taken"),
    )
