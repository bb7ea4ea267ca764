"""Benchmark decontamination with spaced seeds that tolerate substituted words."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binflow.llm.common import letter_words, pieces

#: Token positions that the two seeds look at; the others are ignored.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW, MATCHES = 13, 11
#: Words of a piece of a long document.
PIECE = 1024
#: Benchmark words up to which the seeds of the benchmark are broadcast (about 300 bytes each).
BROADCAST_WORDS = 500_000


def seeds_cover(masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, matches: int = MATCHES) -> bool:
    """Whether every stretch of up to ``window`` words with ``matches`` equal ones holds a whole seed."""
    for length in range(matches, window + 1):
        for gone in combinations(range(length), length - matches):
            equal = set(range(length)).difference(gone)
            if not any(equal.issuperset(o + i for i in m) for m in masks for o in range(length - m[-1])):
                return False
    return True


def _seeds(tokens: Column, pos: Column, masks: tuple[tuple[int, ...], ...]) -> Column:
    """One hash per mask at a position; NULL where the mask runs over the end."""
    return F.array(
        *[
            F.when(
                pos + m[-1] < F.size(tokens), F.xxhash64(F.lit(i), *[F.get(tokens, pos + o) for o in m])
            )
            for i, m in enumerate(masks)
        ]
    )


def _hashed(df: DataFrame, key: str, text_col: str, name: str) -> DataFrame:
    words = letter_words(F.col(text_col))
    return df.select(F.col(key).alias(name), F.transform(words, lambda w: F.xxhash64(w)).alias(f"{name}_t"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple[tuple[int, ...], ...] = MASKS,
    window: int = WINDOW,
    matches: int = MATCHES,
) -> DataFrame:
    """Documents that hold passages of benchmark items, a few words of which may be substituted.

    Words are lower-cased runs of letters and digits. A passage counts where some
    stretch of at most ``window`` words of a document, laid word against word on
    an item, has ``matches`` or more equal words. Each seed hashes the words at
    its mask's positions; the masks are proven to leave no such stretch without
    an equal seed, and every equal seed is verified over the words around it, so
    the result is exact. Returns one row per document and item: the two ids,
    ``first_word`` and ``last_word`` (positions from 0 of the passages in the
    document) and ``most_equal`` (equal words in the best stretch).

    NULL, empty or short texts hold nothing; items of fewer than ``matches`` words
    cannot be found. A NULL document id groups with other NULL ids; rows of one id
    count as one document. Other columns are not read. An empty document or
    benchmark table gives an empty table.

    A document's hashed words are cut into overlapping pieces, which the seeds refer to;
    only verified hits are shuffled. The benchmark's seeds are broadcast after
    its words are counted; from BROADCAST_WORDS on, Spark joins by shuffle.
    """
    if not seeds_cover(masks, window, matches):
        raise ValueError("the masks miss some passages")
    items = _hashed(benchmark, item_col, item_text_col, "_item").where(F.size("_item_t") >= matches)
    reach = window - 1
    # The item's words around a position, NULL beyond its ends.
    around = F.transform(
        F.sequence(F.lit(-reach), F.lit(reach)), lambda o: F.get(F.col("_item_t"), F.col("_q") + o)
    )
    planted = (
        items.select("_item", "_item_t", F.posexplode("_item_t").alias("_q", "_w"))
        .select("_item", around.alias("_around"), F.explode(_seeds(F.col("_item_t"), F.col("_q"), masks)).alias("_seed"))
        .where(F.col("_seed").isNotNull())
    )
    words = items.agg(F.sum(F.size("_item_t")).alias("n")).first()["n"] or 0
    if words <= BROADCAST_WORDS:
        planted = F.broadcast(planted)
    texts = _hashed(docs, id_col, text_col, "_doc").where(F.size("_doc_t") >= matches)
    cut = texts.select("_doc", F.explode(pieces(F.col("_doc_t"), PIECE, window)).alias("_c"))
    places = F.sequence(F.col("_c.lead"), F.col("_c.lead") + F.col("_c.count") - 1)
    probes = (
        cut.select("_doc", F.col("_c.words").alias("_doc_t"), F.col("_c.from").alias("_from"), F.explode(places).alias("_p"))
        .select("_doc", "_doc_t", "_from", "_p", F.explode(_seeds(F.col("_doc_t"), F.col("_p"), masks)).alias("_seed"))
        .where(F.col("_seed").isNotNull())
    )
    equal = F.transform(
        F.sequence(F.lit(0), F.lit(2 * reach)),
        lambda o: F.when(F.get(F.col("_doc_t"), F.col("_p") + o - reach) == F.get(F.col("_around"), o), 1).otherwise(0),
    )
    hits = probes.join(planted, "_seed").select("_doc", "_item", (F.col("_from") + F.col("_p")).alias("_p"), equal.alias("_eq"))
    in_stretch = lambda s: F.slice(F.col("_eq"), s + 1, window)
    count = lambda s: F.aggregate(in_stretch(s), F.lit(0), lambda a, x: a + x)
    last = lambda s: s + window - 1 - (F.array_position(F.reverse(in_stretch(s)), 1).cast("int") - 1)
    stretches = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(reach)), lambda s: (F.get(F.col("_eq"), s) == 1) & (count(s) >= matches)),
        lambda s: F.struct((F.col("_p") - reach + s).alias("first"), (F.col("_p") - reach + last(s)).alias("last"), count(s).alias("equal")),
    )
    return (
        hits.select("_doc", "_item", F.inline(stretches))
        .groupBy("_doc", "_item")
        .agg(F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.max("equal").alias("most_equal"))
        .withColumnsRenamed({"_doc": id_col, "_item": item_col})
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the documents that :func:`contaminated` finds; all columns stay.

    Rows whose id is NULL go if any of them holds a passage.
    """
    found = contaminated(docs, benchmark, id_col, text_col, **settings).select(F.col(id_col).alias("_found")).distinct()
    kept = docs.alias("d").join(found, F.col(f"d.{id_col}").eqNullSafe(F.col("_found")), "left_anti")
    return kept
