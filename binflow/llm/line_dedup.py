"""Line dedup: lines that many documents share stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binflow.llm.common import BLANKS, ascii_lower, without


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line that is long enough to count: document, position, key hash."""
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(text_col).alias("_text"),
        F.posexplode(F.split(text_col, "\n")).alias("_pos", "_line"),
    )
    keyed = rows.select("_id", "_text", "_pos", line_key(F.col("_line")).alias("_key"))
    # Two 64-bit hashes of different seeds: 128 bits, so keys of any corpus stay apart.
    return keyed.where(F.char_length("_key") >= min_chars).select(
        "_id", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")
    )


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Lines to drop: ``_id``, ``_text`` (hash of the whole text), ``_pos``.

    A key with fewer rows than ``min_docs`` cannot have that many documents, so
    one count with map-side combination leaves few keys; only their lines are
    joined and counted by distinct document. A key that a third of all documents
    hold is one row on the key side of each join, so AQE may split its lines.
    """
    lines = _lines(docs, id_col, text_col, min_chars)
    often = lines.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_docs)
    found = lines.join(often.drop("_n"), ["_h1", "_h2"])
    # groupBy before the distinct count: one row per key and document after the combine.
    holders = found.where(F.col("_id").isNotNull()).groupBy("_h1", "_h2", "_id").agg(F.lit(1).alias("_one"))
    shared = (
        holders.groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("_keeper"))
        .where(F.col("_docs") >= min_docs)
        .drop("_docs")
    )
    hits = found.join(shared, ["_h1", "_h2"])
    return hits.where(~F.col("_id").eqNullSafe(F.col("_keeper"))).select("_id", "_text", "_pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Documents without the lines that at least ``min_docs`` documents share.

    A text splits at ``\\n``. A line's key is the line stripped of blanks at both
    ends, A-Z lower-cased. Keys of at least ``min_chars`` code points that
    ``min_docs`` distinct ids hold lose all their lines, except in the largest id
    that holds them; there each of its lines stays. The other lines stay in
    order, joined by ``\\n``. Returns the columns of ``docs`` with the new text,
    then ``n_lines`` and ``n_dropped`` (long); input columns of these two names
    are replaced, all others pass through.

    A NULL or empty text is one empty line and stays as it is. A NULL id neither
    counts as a document nor keeps a line. Rows of one id are one document: a
    line counts once for them, and the keeper keeps it in each of its rows. An
    empty table gives an empty table.

    The lines of a document come back through one row of positions per text, and
    ``array_except`` over positions takes time in proportion to them.
    """
    drops = (
        shared_lines(docs, id_col, text_col, min_chars, min_docs)
        .groupBy("_id", "_text")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    rest = without(docs, "n_lines", "n_dropped")
    kept_names = rest.columns
    left = rest.withColumn("_row_text", F.xxhash64(text_col)).alias("d")
    both = left.join(
        drops.alias("x"),
        F.col(f"d.{id_col}").eqNullSafe(F.col("x._id")) & (F.col("d._row_text") == F.col("x._text")),
        "left",
    )
    split = both.withColumn("_all", F.split(F.coalesce(F.col(f"d.{text_col}"), F.lit("")), "\n"))
    positions = F.sequence(F.lit(0), F.size("_all") - 1)
    kept = F.array_join(
        F.transform(F.array_except(positions, F.col("_drop")), lambda i: F.get(F.col("_all"), i)), "\n"
    )
    text = F.when(F.col("_drop").isNull(), F.col(f"d.{text_col}")).otherwise(kept).alias(text_col)
    return split.select(
        *[text if c == text_col else F.col(f"d.`{c}`") for c in kept_names],
        F.size("_all").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
