"""Filter interaction audit: what five filters remove in each of their 120 orders, and what they have in common."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binflow.llm.common import if_small
from binflow.session import materialize

FILTERS = "ABCDE"
#: The filter that looks at other documents.
COPY = 1 << FILTERS.index("E")
MIN_WORDS = 200
BLANK = r"[\x20\x09-\x0D]+"


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails.

    A: under 200 words. B: fewer than half of the words are distinct. C: more than 2 % of the code points
    are A-Z. D: holds one of ``#$%&*|``.
    """
    words = F.array_remove(F.split(text, BLANK), "")
    n = F.size(words)
    fails = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.char_length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    bits = F.lit(0)
    for i, fail in enumerate(fails):
        bits = bits + F.when(fail, 1 << i).otherwise(0)
    return bits


def copies(rows: DataFrame) -> DataFrame:
    """The rows (id, part, hash, text) whose text a row with a smaller id has too, without the text.

    Only texts with a repeated hash take part. Their rows shrink to one per text and task before the shuffle, with
    the smallest id, which is there if any smaller one is; the left-semi join on hash, exact text and smaller
    id follows. The reduced side is written, so both sides are plain exchanges and a text that a third of all rows
    hold may be split over tasks.
    """
    repeated = materialize(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("hash"))
    held = rows.join(if_small(repeated), "hash", "left_semi").select("id", "part", "hash", "text").alias("d")
    least = materialize(held.groupBy("hash", "text").agg(F.min("id").alias("least"))).alias("s")
    same = (F.col("d.hash") == F.col("s.hash")) & (F.col("d.text") == F.col("s.text"))
    return held.join(least, same & (F.col("s.least") < F.col("d.id")), "left_semi").select("id", "part", "hash")


def _states() -> Column:
    """Every filter with every set of others before it: 80 structs (before, bit)."""
    found = []
    for i in range(len(FILTERS)):
        others = [j for j in range(len(FILTERS)) if j != i]
        for k in range(len(others) + 1):
            for before in combinations(others, k):
                found.append(F.struct(F.lit(sum(1 << j for j in before)).alias("before"), F.lit(1 << i).alias("bit")))
    return F.array(*found)


def _orders() -> list[tuple[str, int, int, int]]:
    """Rows (filter_order, step, before, bit) of all orders."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            rows.append(("".join(order), step, before, bit))
            before |= bit
    return rows


def audit_filters(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """Counts of what each filter does at each step of each order, by value of ``part_col``.

    The filters are those of :func:`own_failures` and E: another row with a smaller id has the same text,
    whatever becomes of that row. Returns one row per part, ``filter_order`` and ``step``
    with the long columns ``kept`` (after the step), ``removed`` (in it), ``redundant`` (fail its filter, removed
    before), ``unique_fails`` (fail its filter only), ``good_lost`` and ``toxic_lost`` (removed here, with
    ``quality`` or ``toxic`` 1 in ``labels``) and ``shapley`` (``removed`` of its filter, summed over all orders).

    Each row of ``docs`` is a document, repeated rows too; rows of one id are no copies of each other. A NULL text is
    empty, a NULL part the empty string. A NULL id is smaller than none, has none below it and no label.
    Several label rows of an id count as one that has each 1 of theirs. Other columns are not read. An empty table
    gives an empty table.

    Texts are read once for the filters A to D and once for the copies; from then on rows hold an id, a hash and bits.
    A part shrinks to its at most 31 combinations of failures before any order is looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), part.alias("part"), text.alias("text"), F.xxhash64(text).alias("hash"))
    own = materialize(rows.select("id", "part", "hash", own_failures(F.col("text")).alias("bits")))
    one = F.lit(1).cast("long")
    failed = (
        own.where(F.col("bits") > 0)
        .select("id", "part", "hash", "bits", one.alias("n"), F.lit(0).alias("m"))
        .unionByName(copies(rows).select("id", "part", "hash", F.lit(COPY).alias("bits"), F.lit(0).alias("n"), one.alias("m")))
    )
    # Rows equal in id, part and text fail the same filters; n or m says how many there are.
    combined = failed.groupBy("id", "part", "hash").agg(
        F.bit_or("bits").alias("bits"), F.greatest(F.sum("n"), F.sum("m")).alias("n")
    )
    marks = labels.select(F.col(id_col).alias("_id"), (F.col("quality") == 1).alias("_good"), (F.col("toxic") == 1).alias("_toxic"))
    marks = marks.where("_good or _toxic").groupBy("_id").agg(F.max("_good").alias("_good"), F.max("_toxic").alias("_toxic"))
    counts = (
        combined.join(marks, combined["id"] == marks["_id"], "left")
        .groupBy("part", "bits")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("_good"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("_toxic"), F.col("n")).otherwise(0)).alias("toxic"),
            F.lit(0).cast("long").alias("whole"),
        )
    )
    zero = F.lit(0).cast("long")
    parts = own.groupBy("part").agg(
        F.lit(0).alias("bits"), zero.alias("n"), zero.alias("good"), zero.alias("toxic"), F.count(F.lit(1)).alias("whole")
    )
    state = counts.unionByName(parts).withColumn("_s", F.explode(_states())).select("*", "_s.before", "_s.bit")
    bits, before, bit = F.col("bits"), F.col("before"), F.col("bit")
    fails = bits.bitwiseAND(bit) != 0
    earlier = bits.bitwiseAND(before) != 0
    total = lambda value, when: F.sum(F.when(when, value).otherwise(0))
    n = F.col("n")
    # A document that fails k filters is removed by each of them in 120 / k orders.
    share = F.expr("120 * n div greatest(bit_count(bits), 1)")
    figures = state.groupBy("part", "before", "bit").agg(
        (F.sum("whole") - total(n, fails | earlier)).alias("kept"),
        total(n, fails & ~earlier).alias("removed"),
        total(n, fails & earlier).alias("redundant"),
        total(n, bits == bit).alias("unique_fails"),
        total(F.col("good"), fails & ~earlier).alias("good_lost"),
        total(F.col("toxic"), fails & ~earlier).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )
    spark = docs.sparkSession
    orders = F.broadcast(spark.createDataFrame(_orders(), "filter_order string, step int, before int, bit int"))
    return figures.join(orders, ["before", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


#: DuckDB text of the audit.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
lab AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(least < w.doc_id, false)} AS fails
  FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
c AS (SELECT part, fails, good, toxic, count(*) AS n, len([x FOR x IN map_values(fails) IF x]) AS n_fails FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
p AS (SELECT c.*, filter_order, step, fails[filter_order[step]] AS here,
    len([i FOR i IN range(1, step) IF fails[filter_order[i]]]) > 0 AS earlier FROM c CROSS JOIN s),
r AS (SELECT part, filter_order, step, filter_order[step] AS letter,
    coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS removed,
    coalesce(sum(n) FILTER (here AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (here AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(n) FILTER (here AND NOT earlier AND good), 0) AS good_lost,
    coalesce(sum(n) FILTER (here AND NOT earlier AND toxic), 0) AS toxic_lost FROM p GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""
