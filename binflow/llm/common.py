"""Column expressions and small task-side helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words and blanks at line ends: space, tab, LF, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    # lower() does the same to text of single-byte characters, and faster.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def n_words(text: Column) -> Column:
    """Number of words as long; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits in order; an empty array for NULL."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(runs, "")


def uniform(*parts: Column) -> Column:
    """Number in [0, 1) that depends on the parts alone, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, in any case of letters."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def if_small(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``df``, a written table of a few narrow columns, to be broadcast if it has at most ``rows`` rows.

    Above that Spark joins by shuffle. Two million rows of two numbers are about 50 MB.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pieces(words: Column, size: int, margin: int) -> Column:
    """A long array cut up: array of (from, lead, count, words).

    Each piece owns ``count`` positions from the ``lead``-th of its words on, and has up to ``margin``
    more words on both sides; ``from`` is where its words begin in the whole. Rows that are
    made from a piece carry it, so their memory does not grow with the text.
    """
    n = F.size(words)

    def cut(start: Column) -> Column:
        begin = F.greatest(start - margin, F.lit(0))
        return F.struct(
            begin.alias("from"),
            (start - begin).alias("lead"),
            F.least(F.lit(size), n - start).alias("count"),
            F.slice(words, begin + 1, F.lit(size + 2 * margin)).alias("words"),
        )

    return F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), cut)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Tables written inside go to Python workers in batches of at most ``rows`` rows.

    A batch of whole texts, or of arrays made from them, is held by the JVM and the worker at once; the usual ten
    thousand rows can be a hundred megabytes on each side.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
