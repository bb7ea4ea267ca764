"""N-gram Jaccard join: links of near copies by token-combination prefixes, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binflow.llm.common import if_small, small_batches, uniform
from binflow.llm.hashing import WordHashes, mix64, rows_of, shingles, signature
from binflow.session import materialize

SHINGLE, SIMILARITY = 5, Fraction(3, 4)
#: Documents up to which a token is indexed alone; more frequent ones in pairs.
FREQUENT = 48
#: Numbers of 64 bits in the bitmap of a set.
BITMAP = 64
#: Smallest keys of a set that its rows carry.
CARRIED = 16
#: Rows per batch that tasks send on.
BATCH = 200_000


def _probe_length(n: int, share: Fraction) -> tuple[int, int]:
    """Length of the first prefix and the tokens of it that a partner must share."""
    least = -(-n * share.numerator // share.denominator)
    shared = min(least, n // 16 + 1)
    return n - least + shared, shared


def _describe(n: int):
    """Rows (id, text) to (id, n_shingles, s1, s2): the size and the signature of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes, one, two = [], [], []
            for t in texts:
                tokens = np.unique(shingles(memo.of(t.as_py()), n))
                a, b = signature(tokens)
                sizes.append(len(tokens))
                one.append(a)
                two.append(b)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                ["id", "n_shingles", "s1", "s2"],
            )

    return run


def _probes(n: int, share: Fraction):
    """Rows (text) to (s1, token) for the tokens of the first prefix, in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sets, tokens, rows = WordHashes(), [], [], 0

        def send():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(np.concatenate(tokens))], ["s1", "token"])

        for (text,) in rows_of(batches, "text"):
            mine = np.unique(shingles(memo.of(text), n))
            if len(mine) == 0:
                continue
            first = mine[: _probe_length(len(mine), share)[0]].view(np.int64)
            sets.append(np.full(len(first), signature(mine)[0], np.int64))
            tokens.append(first)
            rows += len(first)
            if rows >= BATCH:
                yield send()
                sets, tokens, rows = [], [], 0
        if rows:
            yield send()

    return run


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """One bit for each token by its hash."""
    bits = np.zeros(BITMAP * 64, np.uint8)
    bits[(tokens >> np.uint64(20)) % np.uint64(len(bits))] = 1
    return np.packbits(bits).view(np.int64)


def _sets(n: int):
    """Rows (text, s1) to (s1, n_shingles, tokens, bits), where the text has that signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            one, sizes, values, offsets, bits = [], [], [np.zeros(0, np.int64)], [0], [np.zeros(0, np.int64)]
            for text, s1 in rows_of(iter([batch]), "text", "s1"):
                tokens = np.unique(shingles(memo.of(text), n))
                if signature(tokens)[0] != s1:
                    continue  # another row of the same id
                one.append(s1)
                sizes.append(len(tokens))
                values.append(tokens.view(np.int64))
                offsets.append(offsets[-1] + len(tokens))
                bits.append(bitmap(tokens))
            maps = pa.ListArray.from_arrays(pa.array(np.arange(len(one) + 1) * BITMAP, pa.int32()), pa.array(np.concatenate(bits)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(one, pa.int64()), pa.array(sizes, pa.int64()), lists, maps], ["s1", "n_shingles", "tokens", "bits"]
            )

    return run


def prefix_signatures(n: int, tokens: np.ndarray, often: np.ndarray, share: Fraction = SIMILARITY) -> np.ndarray:
    """Keys under which a set of ``n`` tokens is indexed.

    ``tokens`` are those that another set has too, ``often`` whether each is
    frequent. The order of tokens is: held by one set alone, rare, frequent; by
    hash inside each class. A partner B of A has a + share * b <= (1 - share) * n,
    with a tokens of A alone and b of B alone. To share no rare token of A's
    prefix costs one of a for each; to share no two neighbours of its x frequent
    ones costs 2a + b >= x - 1, so at least (x - 1) / 2. The prefix ends where
    rare + (x - 1) / 2 is above (1 - share) * n: any partner shares a key.
    """
    budget = (1 - share) * n
    keys = np.sort(tokens[~often])
    spent = n - len(tokens)
    take = min(len(keys), max(0, int(budget) + 1 - spent))
    single = keys[:take]
    rest = budget - spent - take
    if rest < 0:
        return mix64(single)
    frequent = np.sort(tokens[often])[: int(2 * rest) + 2]
    pairs = mix64(frequent[:-1]) * np.uint64(0x9E3779B97F4A7C15) + frequent[1:]
    return np.concatenate([mix64(single), mix64(pairs ^ np.uint64(0xA5A5A5A5A5A5A5A5))])


def _index(share: Fraction):
    """Rows (s1, n_shingles, shared: array of (token, often)) to (key, s1, n_shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(batch.schema.get_field_index("shared"))
            flat = shared.flatten()
            tokens = flat.field("token").to_numpy(zero_copy_only=False).view(np.uint64)
            often = flat.field("often").to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.array([len(x) for x in shared], np.int64))
            one = batch.column(batch.schema.get_field_index("s1")).to_numpy()
            sizes = batch.column(batch.schema.get_field_index("n_shingles")).to_numpy()
            keys, owners, counts = [np.zeros(0, np.uint64)], [], []
            for i, end in enumerate(ends):
                start = ends[i - 1] if i else 0
                mine = prefix_signatures(int(sizes[i]), tokens[start:end], often[start:end], share)
                keys.append(mine)
                owners.append(one[i])
                counts.append(len(mine))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.repeat(np.array(owners, np.int64), counts)),
                    pa.array(np.repeat(np.array(sizes, np.int64), counts)),
                ],
                ["key", "s1", "n_shingles"],
            )

    return run


def _similar(inter: Column, total: Column, share: Fraction) -> Column:
    """inter / (total - inter) >= share in whole numbers."""
    return inter * (share.numerator + share.denominator) >= total * share.numerator


def _sizes_fit(a: Column, b: Column, share: Fraction) -> Column:
    return F.least(a, b) * share.denominator >= F.greatest(a, b) * share.numerator


def _may_be_similar(bits_a: Column, bits_b: Column, n_a: Column, n_b: Column, share: Fraction) -> Column:
    """False only for sets that are not similar: a bit that only one set has stands for a token that only it has."""
    alone = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, c: t + c
    )
    most = F.least(n_a - alone(bits_a, bits_b), n_b - alone(bits_b, bits_a))
    return _similar(most, n_a + n_b, share)


def _verify(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.

    Bitmaps, a tenth of a set's size, rule out most pairs; the rest are compared exactly.
    """
    side = lambda name, *cols: sets.select(F.col("s1").alias(name), *[F.col(c).alias(f"_{c}_{name}") for c in cols])
    seen = pairs.join(side("a", "bits", "n_shingles"), "a").join(side("b", "bits", "n_shingles"), "b")
    may = _may_be_similar(F.col("_bits_a"), F.col("_bits_b"), F.col("_n_shingles_a"), F.col("_n_shingles_b"), share)
    hopeful = materialize(seen.where(may).select("a", "b"))
    both = hopeful.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")
    inter = F.size(F.array_intersect("_tokens_a", "_tokens_b"))
    return both.where(_similar(inter, F.size("_tokens_a") + F.size("_tokens_b"), share)).select("a", "b")


def connected(edges: DataFrame) -> DataFrame:
    """Components of edges (a, b): rows (node, label), the label being the smallest node of the component.

    Labels go to neighbours and then to the label of the label, so that chains
    halve in each round; every round is written, and no label reaches the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("_to"))
            .agg(F.min("label").alias("_near"))
        )
        least = labels.join(near, labels["node"] == near["_to"]).select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("_label")
        )
        up = labels.select(F.col("node").alias("_label"), F.col("label").alias("_up"))
        jumped = materialize(
            least.join(up, "_label", "left").select(
                "node", "_old", F.least("_label", F.coalesce("_up", "_label")).alias("label")
            )
        )
        moved = jumped.where(F.col("_old") != F.col("label")).limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels


def _links(members: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """Components (node, label) of all links between sets that share an index key.

    Keys under which the same sets stand count once. First each set is compared
    with one set, the smallest under any of its keys. After that only pairs of
    different components are open, and each set in turn is compared with all sets
    of other components under its keys: one set of 512, then one of 64, one of 8,
    and in the end all that are left. The early ones join large groups of true
    copies, so these never list their pairs, and no link is lost. A pair
    is listed under one key: the first keys of both sets, which each row carries,
    show whether a smaller key lists it. Each row carries a small bitmap of its
    set too, so that most pairs that are no links are not made.
    """
    first = members.groupBy("key").agg(
        F.min(F.struct("s1", "n_shingles")).alias("_c"),
        F.max("s1").alias("_last"),
        F.count(F.lit(1)).alias("_g"),
        F.bit_xor(F.xxhash64("s1")).alias("_x"),
        F.bit_xor(F.xxhash64(F.lit(1), "s1")).alias("_y"),
    )
    first = first.where(F.col("_c.s1") != F.col("_last"))
    first = first.groupBy("_g", "_x", "_y").agg(F.min("key").alias("key"), F.min("_c").alias("_c")).select("key", "_c")
    members = materialize(members.join(first, "key").select("key", "s1", "n_shingles", "_c"))
    stars = members.where(
        (F.col("_c.s1") != F.col("s1")) & _sizes_fit(F.col("_c.n_shingles"), F.col("n_shingles"), share)
    )
    checked = materialize(stars.groupBy(F.col("s1").alias("b")).agg(F.min("_c.s1").alias("a")).select("a", "b"))
    edges = materialize(_verify(checked, sets, share))
    for share_of_sets in (1 / 512, 1 / 64, 1 / 8, 1.0):
        labels = connected(edges)
        known = members.join(labels.withColumnRenamed("node", "s1"), "s1", "left").select(
            "key", "s1", "n_shingles", F.coalesce("label", "s1").alias("label")
        )
        open_keys = known.groupBy("key").agg(F.min("label").alias("_x"), F.max("label").alias("_y"))
        left = materialize(known.join(open_keys.where(F.col("_x") != F.col("_y")).select("key"), "key"))
        keys = left.groupBy("s1").agg(F.slice(F.array_sort(F.collect_list("key")), 1, CARRIED).alias("_first"))
        # Bitmaps folded to a quarter, so that each row can carry one.
        folded = F.transform(
            F.sequence(F.lit(0), F.lit(BITMAP // 4 - 1)),
            lambda i: reduce(lambda x, y: x.bitwiseOR(y), [F.get(F.col("bits"), i + k * (BITMAP // 4)) for k in range(4)]),
        )
        brief = sets.select("s1", folded.alias("_bits"))
        rows = materialize(left.join(keys, "s1").join(brief, "s1").withColumn("_lot", uniform(F.lit(1), F.col("s1"))))
        a, b = rows.where(F.col("_lot") < share_of_sets).alias("a"), rows.alias("b")
        # The one with the smaller lot has its turn first, so each pair is made once.
        order = F.struct("a._lot", "a.s1") < F.struct("b._lot", "b.s1")
        earlier = F.coalesce(F.array_min(F.array_intersect("a._first", "b._first")) < F.col("a.key"), F.lit(False))
        apart = (F.col("a.label") != F.col("b.label")) & _sizes_fit(F.col("a.n_shingles"), F.col("b.n_shingles"), share)
        may = _may_be_similar(F.col("a._bits"), F.col("b._bits"), F.col("a.n_shingles"), F.col("b.n_shingles"), share)
        pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & order & apart & ~earlier & may).select(
            F.least("a.s1", "b.s1").alias("a"), F.greatest("a.s1", "b.s1").alias("b")
        )
        pairs = materialize(pairs.distinct().join(checked, ["a", "b"], "left_anti"))
        found = materialize(_verify(pairs, sets, share))
        checked, edges = materialize(checked.union(pairs)), materialize(edges.union(found))
    return connected(edges)


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, similarity: Fraction = SIMILARITY
) -> DataFrame:
    """Components of documents whose sets of ``words``-word shingles have Jaccard ``similarity`` or more.

    Words are runs without blanks, A-Z lower-cased. A text of fewer words is one
    shingle. Returns one row per row of ``docs``: the id, ``n_shingles`` and
    ``component_id``, the smallest id that links reach. Equal sets are linked and
    compared once, under their signature. A text without words (NULL, empty) has
    an empty set and is its own component. A row without an id has no component
    (NULL) and links nothing. Rows of one id are compared by their own texts. Other
    columns are not read. An empty table gives an empty table.

    1. Of each distinct set the first tokens by hash, longer than a prefix needs,
       are counted; sets too few of whose tokens occur elsewhere have no partner.
    2. The others count all their tokens and are indexed by prefixes: rare tokens
       alone, frequent ones in pairs of neighbours (:func:`prefix_signatures`).
    3. Sets under one key are compared exactly (:func:`_links`).
    """
    if not Fraction(1, 2) <= similarity <= 1:
        raise ValueError("similarity must be in [1/2, 1]")
    with small_batches(docs.sparkSession):
        return _components(docs, id_col, text_col, words, similarity)


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: Fraction) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    described = materialize(
        rows.mapInArrow(_describe(words), f"id {id_type}, n_shingles long, s1 long, s2 long")
    )
    named = described.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    reps = materialize(named.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles")))
    probes = rows.where(F.col("id").isNotNull()).select("text").mapInArrow(_probes(words, similarity), "s1 long, token long")
    alone = probes.groupBy("token").agg(F.min("s1").alias("s1"), F.max("s1").alias("_other"))
    alone = alone.where(F.col("s1") == F.col("_other")).groupBy("s1").agg(F.count(F.lit(1)).alias("_alone"))
    n = F.col("n_shingles")
    least = F.ceil(n * similarity.numerator / similarity.denominator)
    shared = F.least(least, F.floor(n / 16) + 1)
    hopeful = materialize(
        reps.join(alone, "s1", "left").where(n - least + shared - F.coalesce("_alone", F.lit(0)) >= shared).select("rep", "s1")
    )
    texts = rows.join(if_small(hopeful), rows["id"] == hopeful["rep"]).select("text", "s1")
    sets = materialize(
        texts.mapInArrow(_sets(words), "s1 long, n_shingles long, tokens array<long>, bits array<long>").dropDuplicates(["s1"])
    )
    tokens = sets.select("s1", "n_shingles", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") > 1)
    both = tokens.join(often, "token").groupBy("s1", "n_shingles").agg(
        F.collect_list(F.struct("token", (F.col("_df") > FREQUENT).alias("often"))).alias("shared")
    )
    members = materialize(both.mapInArrow(_index(similarity), "key long, s1 long, n_shingles long"))
    labels = _links(members, sets, similarity)
    of = reps.join(labels.withColumnRenamed("node", "s1"), "s1", "left").withColumn("label", F.coalesce("label", "s1"))
    smallest = of.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = materialize(of.join(smallest, "label").select("s1", "s2", "component_id"))
    out = described.join(of, ["s1", "s2"], "left")
    own = F.when(F.col("id").isNull(), F.lit(None)).when(n == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id; all columns stay.

    Rows without an id stay. Rows of one id are one document: they stay if any
    of them carries its component's id, else they go.
    """
    found = near_components(docs, id_col, text_col, **settings)
    gone = found.groupBy(F.col(id_col).alias("_gone")).agg(F.max(F.col(id_col) == F.col("component_id")).alias("_stays"))
    gone = materialize(gone.where(~F.col("_stays")).select("_gone"))
    return docs.join(if_small(gone), docs[id_col] == gone["_gone"], "left_anti")
