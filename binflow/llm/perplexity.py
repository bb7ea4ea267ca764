"""Quality rules: N-gram perplexity under a modified Kneser-Ney model, with bands per language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binflow.llm.common import BLANKS, if_small, small_batches, without
from binflow.llm.hashing import rows_of
from binflow.session import materialize

#: Symbols of a word that one N-gram spans, at most: an N-gram packs ORDER numbers of BITS bits.
ORDER, BITS = 4, 10
EDGE = 1
#: N-grams that tasks look up in arrays, the most frequent; words with others meet these by a join.
MOST = 1 << 22
#: Distinct words that a task counts before it sends their N-grams on.
WORDS = 200_000
#: Bins to a doubling of the frequency, by whole ones of which the N-grams of the arrays are chosen.
STEPS = 8
#: Width of the bins in which log perplexities are counted, in nats per symbol.
BIN = 0.002
#: Distance from the median, in units of the usual spread, from which a document is rejected; the README has
#: the rates of labelled documents that follow.
REACH = 4.0
#: Least half width of a band in nats per symbol; short of it languages of few documents would reject at random.
LEAST_REACH = 0.03
#: A document of fewer symbols gets a band wider by the square root of its lack, as its mean is less certain.
SURE_SYMBOLS = 1000.0

SYMBOLS = "#*$%&|<>"


def words_of(text: str) -> list[str]:
    """Runs of other than space and \\x09-\\x0D: what ``bytes`` split at, and nothing else of Unicode's blanks."""
    parts = text.encode("utf-8", "surrogatepass").split()
    return b"\n".join(parts).decode("utf-8", "surrogatepass").split("\n") if parts else []


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol numbers of the words one after another, each between two edges, and the length of each with edges.

    Code points below 0x300 are symbols of their own; the others share 128 by remainder.
    """
    joined = "\x01" + "\x01".join(words) + "\x01"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    points = np.where(points < 0x300, points, 0x300 + points % 128)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return points, lengths


def _packed(points: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` symbols that end at each position as one number, with 0 before the start."""
    out = np.zeros(len(points), np.int64)
    for k in range(order):
        out[k:] |= points[: len(points) - k] << (BITS * k)
    return out


def _masked(points: np.ndarray) -> np.ndarray:
    """Symbols since the last edge (with it) at each position, at least 1."""
    at = np.arange(len(points))
    edge = np.maximum.accumulate(np.where(points == EDGE, at, -1))
    # The edge that ends a word belongs to that word's context.
    before = np.concatenate([[-1], edge[:-1]])
    return at - np.maximum(before, 0) + 1


def word_ngrams(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol of each word after its first edge: the packed N-gram that ends there, the number
    of symbols in it (it never reaches back over the first edge), and the index of the word."""
    if not words:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    points, lengths = codes_of(words)
    spans = np.minimum(_masked(points), order)
    grams = _packed(points, order) & ((np.int64(1) << (BITS * spans)) - 1)
    inner = np.ones(len(points), bool)
    inner[0] = False  # the first edge of all; a shared edge ends one word and begins the next
    owner = np.repeat(np.arange(len(words)), lengths - 1)
    return grams[inner], spans[inner], owner


def _count(order: int):
    """Rows (text) to (span, gram, n): how often each N-gram of full reach occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def send() -> pa.RecordBatch:
            words = list(counts)
            grams, spans, owner = word_ngrams(words, order)
            times = np.fromiter(counts.values(), np.int64, len(words))[owner]
            keys, where = np.unique(grams, return_inverse=True)
            total = np.bincount(where, times, len(keys)).astype(np.int64)
            span = np.zeros(len(keys), np.int64)
            span[where] = spans
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(span), pa.array(keys), pa.array(total)], ["span", "gram", "n"])

        for (text,) in rows_of(batches, "text"):
            counts.update(words_of(text))
            if len(counts) >= WORDS:
                yield send()
        if counts:
            yield send()

    return run


def count_ngrams(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Rows (span, gram, n) over all words of all texts: N-grams of ``order`` symbols, and shorter ones at
    the beginning of words. Tasks sum over their words first, so a frequent N-gram is a row per task."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))
    rows = texts.mapInArrow(_count(order), "span long, gram long, n long")
    return rows.groupBy("span", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[dict[int, DataFrame], float]:
    """Tables (gram, log_p, log_b) of the interpolated model for each order, from its full counts, and the log
    probability of a symbol that none of them has.

    The highest order counts occurrences, as do N-grams at the beginning of a word, which have no
    longer context; the others count the distinct symbols before them. Each order has three discounts
    from its counts of counts. ``log_b`` is the weight that an N-gram leaves, as a context, to the
    next lower order. The tables hold every N-gram of the counts.
    """
    top = counts.where(F.col("span") == order).select("gram", "n")
    tables: dict[int, DataFrame] = {order: top}
    for k in range(order - 1, 0, -1):
        low = (1 << (BITS * k)) - 1
        longer = tables[k + 1].select(F.col("gram").bitwiseAND(F.lit(low)).alias("gram"), F.lit(1).cast("long").alias("n"))
        starts = counts.where(F.col("span") == k).select("gram", "n")
        tables[k] = materialize(longer.union(starts).groupBy("gram").agg(F.sum("n").alias("n")))
    lower: DataFrame | None = None
    out: dict[int, DataFrame] = {}
    for k in range(1, order + 1):
        rows = tables[k]
        few = {r["n"]: r["c"] for r in rows.where(F.col("n") <= 4).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
        c = [few.get(i, 0) for i in range(1, 5)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] and c[1] else 0.5
        cut = [min(i * 0.95, max(0.05, i - (i + 1) * y * c[i] / c[i - 1])) if c[i - 1] else 0.5 for i in (1, 2, 3)]
        discount = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        context = F.shiftright("gram", BITS)
        whole = rows.withColumn("ctx", context).withColumn("cut", discount)
        sums = whole.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
        joined = whole.join(sums, "ctx").withColumn("share", (F.col("n") - F.col("cut")) / F.col("total"))
        weight = F.col("left") / F.col("total")
        if lower is None:
            # The lowest order shares its rest evenly among the symbols.
            p = joined.withColumn("p", F.col("share") + weight / F.lit(float(1 << BITS)))
        else:
            low = (1 << (BITS * (k - 1))) - 1
            below = lower.select(F.col("gram").alias("_low"), F.col("p").alias("_p"))
            p = joined.join(below, F.col("gram").bitwiseAND(F.lit(low)) == F.col("_low"), "left").withColumn(
                "p", F.col("share") + weight * F.coalesce("_p", F.lit(1e-9))
            )
        lower = materialize(p.select("gram", "n", "p"))
        out[k] = lower
        # The weight belongs to the context, an N-gram of the order below.
        rest = sums.select(F.col("ctx").alias("_ctx"), F.log(F.col("left") / F.col("total")).alias("log_b"))
        if k == 1:
            # What the lowest order leaves to all symbols alike; without counts they have everything.
            whole_rest = rest.first()
            log_unseen = float((whole_rest["log_b"] if whole_rest else 0.0) - np.log(1 << BITS))
            continue
        out[k - 1] = out[k - 1].join(rest, F.col("gram") == F.col("_ctx"), "left").drop("_ctx")
    final = {}
    for k, rows in out.items():
        b = F.col("log_b") if k < order else F.lit(0.0)
        final[k] = rows.select("gram", F.log("p").alias("log_p"), F.coalesce(b, F.lit(0.0)).alias("log_b"))
    return final, log_unseen


def split_model(counts: DataFrame, tables: dict[int, DataFrame], most: int = MOST) -> tuple[dict[int, DataFrame], DataFrame | None]:
    """Tables of the most frequent N-grams of the counts, at most ``most`` in all, and rows (gram, log_p) of the others.

    Words of the counted texts have no N-gram that is not counted, so with both no text needs a lower order. A gram
    of the others is marked by its number of symbols (:func:`_marked`). There is None if all are few enough.
    """
    order = max(tables)
    step = F.floor(F.log2("n") * STEPS)
    left, least = most, None
    sizes = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("s")).collect()
    for size in sizes:
        left -= size["c"]
        if left < 0:
            break
        least = size["s"]
    if left >= 0:
        return tables, None
    frequent = F.lit(False) if least is None else step >= least
    marked = counts.select("span", "gram", frequent.alias("_frequent"))
    near, far = {}, []
    for k, rows in tables.items():
        own = rows.join(marked.where(F.col("span") == k), "gram")
        near[k] = own.where("_frequent").select("gram", "log_p", F.lit(0.0).alias("log_b"))
        far.append(own.where(~F.col("_frequent")).select(_marked(F.col("gram"), k).alias("gram"), F.col("log_p").cast("float").alias("log_p")))
    return near, materialize(reduce(DataFrame.union, far))


def _marked(gram, span):
    """An N-gram and its number of symbols as one number."""
    return gram * 8 + span


class Model:
    """Sorted arrays of N-grams, and beside them log probability and log weight, one set per order."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], log_unseen: float):
        self.tables = tables
        self.log_unseen = log_unseen
        self.order = max(tables, default=0)

    @classmethod
    def of(cls, tables: dict[int, DataFrame], log_unseen: float) -> Model:
        """Fetches the tables; :func:`split_model` bounds them."""
        arrays = {}
        for k, df in tables.items():
            t = df.select("gram", "log_p", "log_b").toArrow()
            gram = t.column("gram").to_numpy()
            at = np.argsort(gram)
            arrays[k] = (gram[at], t.column("log_p").to_numpy()[at].astype(np.float32), t.column("log_b").to_numpy()[at].astype(np.float32))
        return cls(arrays, log_unseen)

    def _find(self, k: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.tables[k][0]
        if not len(keys):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return at, keys[at] == grams

    def log_p(self, grams: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each N-gram after the others."""
        out = np.zeros(len(grams))
        open_ = np.ones(len(grams), bool)
        for k in range(self.order, 0, -1):
            mine = np.flatnonzero(open_ & (spans >= k))
            if not len(mine):
                continue
            part = grams[mine] & ((np.int64(1) << (BITS * k)) - 1)
            at, there = self._find(k, part)
            out[mine[there]] += self.tables[k][1][at[there]]
            open_[mine[there]] = False
            rest = mine[~there]
            if k > 1:
                at, there = self._find(k - 1, part[~there] >> BITS)
                out[rest[there]] += self.tables[k - 1][2][at[there]]
        out[open_] += self.log_unseen
        return out

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log probabilities and number of symbols (with the closing edge) of each word."""
        grams, spans, owner = word_ngrams(words, self.order)
        return np.bincount(owner, self.log_p(grams, spans), len(words)), np.bincount(owner, minlength=len(words))


    def near_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of log probabilities of each word over the N-grams that the tables hold; of the others the mark and the
        index of the word."""
        grams, spans, owner = word_ngrams(words, self.order)
        p, there = np.zeros(len(grams)), np.zeros(len(grams), bool)
        for k in range(1, self.order + 1):
            mine = np.flatnonzero(spans == k)
            at, there[mine] = self._find(k, grams[mine])
            p[mine[there[mine]]] = self.tables[k][1][at[there[mine]]]
        return np.bincount(owner, p, len(words)), _marked(grams, spans)[~there], owner[~there]


def base_figures(text: str | None) -> tuple[list[str], np.ndarray, int, int, int, int]:
    """Distinct words, the number of each word in order, and the figures of the base rules: characters in words,
    symbols, repeated lines, words in repeated windows.

    A line counts where it has a word and equals an earlier line. A word counts
    where a window of three words over it occurs twice or more in the text.
    """
    if not text:
        return [], np.zeros(0, np.int64), 0, 0, 0, 0
    words = words_of(text)
    lines = Counter(x for x in text.split("\n") if x.strip(BLANKS))
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    repeated = 0
    if len(words) > 3:
        m = len(number)
        # Numbers of pairs first, so that a window is a pair of small numbers.
        pairs = np.unique(at[:-1] * m + at[1:], return_inverse=True)[1]
        _, which, times = np.unique(pairs[:-1] * m + at[2:], return_inverse=True, return_counts=True)
        twice = times[which] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeated = int(covered.sum())
    return list(number), at, sum(map(len, words)), sum(map(text.count, SYMBOLS)), sum(lines.values()) - len(lines), repeated


def _score(shared, min_words: int, most_repeated: int):
    """Rows (id, text, lang) to their figures and mean log probability per symbol.

    The mean is without the N-grams ``far`` (marks, with repeats in ``far_n``) that the arrays do not hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)  # plain arrays travel; classes of this package do not
        memo: dict[str, float] = {}
        missing: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, columns = batch.column(batch.schema.get_field_index("text")), [[] for _ in range(9)]
            for value in texts:
                words, at, chars, symbols, lines, repeated = base_figures(value.as_py())
                if len(memo) > WORDS:
                    memo.clear()
                    missing.clear()
                new = [w for w in words if w not in memo]
                if new:
                    scores, marks, owner = model.near_scores(new)
                    memo.update(zip(new, scores.tolist()))
                    begins = np.flatnonzero(np.diff(owner, prepend=-1))
                    if len(marks):
                        missing.update(zip((new[i] for i in owner[begins]), np.split(marks, begins[1:])))
                sums = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
                # Each word has its characters and the closing edge.
                n = chars + len(at)
                failed = len(at) < min_words or 100 * repeated > most_repeated * len(at)
                times = np.bincount(at, minlength=len(words))
                mean = -float(sums @ times) / n if n else None
                rare = [i for i, w in enumerate(words) if w in missing] if missing else []
                marks = np.concatenate([missing[words[i]] for i in rare]) if rare else times[:0]
                repeats = np.repeat(times[rare], [len(missing[words[i]]) for i in rare]) if rare else times[:0]
                for column, x in zip(columns, (len(at), chars, symbols, lines, repeated, failed, mean, marks, repeats)):
                    column.append(x)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64()] + [pa.list_(pa.int64())] * 2
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity", "far", "far_n"]
            rest = [(f, batch.column(i)) for i, f in enumerate(batch.schema.names) if f != "text"]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(c, k) for c, k in zip(columns, kinds)], [f for f, _ in rest] + names)

    return run


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_perplexity double"


def _with_far(scored: DataFrame, far: DataFrame) -> DataFrame:
    """Scored rows whose log perplexity has the N-grams of their column ``far`` too, joined with (gram, log_p)."""
    rows = materialize(scored.withColumn("_row", F.monotonically_increasing_id()))
    used = rows.select("_row", F.inline(F.arrays_zip(F.col("far").alias("gram"), F.col("far_n").alias("far_n"))))
    sums = used.join(far, "gram").groupBy("_row").agg(F.sum(F.col("far_n") * F.col("log_p").cast("double")).alias("_sum"))
    n = F.greatest(F.col("word_chars") + F.col("n_words"), F.lit(1))
    whole = F.col("log_perplexity") - F.coalesce("_sum", F.lit(0.0)) / n
    return rows.drop("far", "far_n").join(sums, "_row", "left").withColumn("log_perplexity", whole).drop("_row", "_sum")


def bands(scored: DataFrame, reach: float = REACH, least: float = LEAST_REACH) -> DataFrame:
    """One row per language (``_lang``, ``_mid``, ``_half``): median log perplexity and ``reach`` usual spreads.

    The usual spread is 1.4826 times the median distance from the median. Both medians
    come from counts per bin over all documents with words that pass the base rules,
    so no language is gathered, however many documents it has.
    """

    def median(rows: DataFrame, value: str, name: str) -> DataFrame:
        binned = rows.groupBy("_lang", F.floor(F.col(value) / BIN).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy("_lang").orderBy("_bin")
        ranked = binned.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_all", F.sum("_c").over(Window.partitionBy("_lang")))
        half = ranked.where(2 * F.col("_upto") >= F.col("_all")).groupBy("_lang").agg(F.min("_bin").alias("_bin"))
        return half.select("_lang", ((F.col("_bin") + 0.5) * BIN).alias(name))

    sound = scored.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull()).select(
        F.coalesce("lang", F.lit("")).alias("_lang"), "log_perplexity"
    )
    middle = materialize(median(sound, "log_perplexity", "_mid"))
    away = sound.join(middle, "_lang").withColumn("_away", F.abs(F.col("log_perplexity") - F.col("_mid")))
    spread = median(away, "_away", "_spread")
    half = F.greatest(F.lit(reach * 1.4826) * F.col("_spread"), F.lit(least))
    both = middle.join(spread, "_lang")
    return materialize(both.select("_lang", "_mid", half.alias("_half")))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 50,
    most_repeated: int = 50,
    order: int = ORDER,
    reach: float = REACH,
    most: int | None = None,
) -> DataFrame:
    """Figures and verdict of each document: one row per row of ``docs`` with the id, the figures of
    the base rules, ``base_failed``, ``log_perplexity``, the band ``low`` to ``high`` and ``kept``.

    The model is over symbols: the N-grams are runs of up to ``order`` characters inside a word and
    its two edges, counted by Spark over all words of all documents, and smoothed by modified
    Kneser-Ney discounts. Characters are few, so the counts sum up before they are shuffled. All N-grams
    stay in the model: tasks have up to ``most`` (MOST), the most frequent, in arrays, and the occurrences of others meet
    their probabilities by a join. A document's log perplexity is the mean over the symbols of its words. It
    is rejected outside its language's band (wider for short documents), or when the base rules fail: fewer than ``min_words``
    words, or more than ``most_repeated`` percent of them in repeated windows of three words.

    A NULL or empty text has no words, NULL perplexity and fails the base rules. A NULL language is a
    language of its own ("", as the empty name). Rows of one id are judged each. Other columns
    are not read. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    spark = docs.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    with small_batches(spark):
        counts = materialize(count_ngrams(rows, "text", order))
        tables, log_unseen = kneser_ney(counts, order)
        near, far = split_model(counts, tables, MOST if most is None else most)
        model = Model.of(near, log_unseen)
        shared = spark.sparkContext.broadcast((model.tables, model.log_unseen))
        fields = f"id {kind}, lang string, {FIGURES}, far array<long>, far_n array<long>"
        scored = rows.mapInArrow(_score(shared, min_words, most_repeated), fields)
        scored = materialize(scored.drop("far", "far_n") if far is None else _with_far(scored, far))
    limits = bands(scored, reach)
    out = scored.join(limits, F.coalesce("lang", F.lit("")) == F.col("_lang"), "left")
    lack = F.sqrt(F.greatest(F.lit(1.0), F.lit(SURE_SYMBOLS) / F.greatest(F.col("word_chars") + F.col("n_words"), F.lit(1))))
    out = out.withColumn("low", F.col("_mid") - F.col("_half") * lack).withColumn("high", F.col("_mid") + F.col("_half") * lack)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select(
        F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_perplexity", "low", "high",
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """``docs`` without the documents that :func:`judge` rejects; all columns stay, under any names.

    Rows meet their verdicts by id, text and language, so rows of one id are judged by their own texts.
    """
    mark = F.xxhash64(F.col(text_col), F.col(lang_col))
    marked = docs.withColumn("_mark", mark)
    keyed = docs.select(F.struct(F.col(id_col).alias("i"), mark.alias("m")).alias("_key"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l"))
    verdicts = judge(keyed, "_key", "_t", "_l", **settings).where(~F.col("kept")).select(F.col("_key.i").alias("_i"), F.col("_key.m").alias("_m"))
    gone = materialize(verdicts.distinct())
    rest = marked.join(if_small(gone), marked[id_col].eqNullSafe(gone["_i"]) & (marked["_mark"] == gone["_m"]), "left_anti")
    return without(rest, "_mark")
