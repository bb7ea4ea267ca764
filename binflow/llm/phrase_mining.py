"""Phrase collocation mining after Toivonen: a sample proposes, full passes count, border failures expand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow.llm.common import small_batches, uniform
from binflow.llm.hashing import mix64, rows_of
from binflow.session import materialize

LEAST, TOP, LONGEST = 10, 2000, 3
#: Share of the documents that the sample takes, by the hash of their text.
SAMPLE = 1 / 16
#: A set of N-grams is sent to the tasks as so many bits (8 MB), which never grow. N-grams that fall on a bit by chance are counted for nothing.
SET_BITS = 26
BUCKET_BITS = 15
#: Words and bytes of words that a task remembers the number of before it starts anew.
REMEMBERED, REMEMBERED_BYTES = 300_000, 16_000_000
#: Lots of a language's candidates that are ranked apart first.
LOTS = 32
#: Words that are looked at together.
STEP = 100_000
ODD = np.uint64(0x9E3779B97F4A7C15)

_ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_END = bytes.maketrans(_ENDS, b"\n" * len(_ENDS))
#: Stands for the end of a piece: no lower-cased word looks like this.
_END = b"A"


class _Numbers(dict):
    """Number of each word of one language; ``fresh`` collects those met for the first time."""

    def __init__(self, lang: str, attempt: int):
        self.lang, self.fresh, self.bytes = lang, [], 0
        self.seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace"), attempt)
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        # 0 is the end of a piece.
        self[word] = number = xxhash.xxh3_64_intdigest(word, self.seed) or 1
        self.fresh.append(word)
        self.bytes += len(word)
        return number


ENCODED = "ids array<long>, lot double, lang string, n long, word string, id long"


def _encode(attempt: int):
    """Rows (text, lang, lot) to two kinds of rows: (ids, lot, lang, n) per document and (lang, word, id) per word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: dict[str, _Numbers] = {}
        docs: list[tuple] = []
        held = 0
        for text, lang, lot in rows_of(batches, "text", "lang", "lot"):
            memo = memos.get(lang)
            if memo is None:
                memo = memos[lang] = _Numbers(lang, attempt)
            words = text.encode("utf-8", "replace").lower().translate(_TO_END).replace(b"\n", b" " + _END + b" ").split()
            words.append(_END)
            ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
            docs.append((ids, lot, lang))
            held += len(ids)
            if held >= STEP:
                yield _packed(docs, memos)
                docs, held = [], 0
                if sum(map(len, memos.values())) > REMEMBERED or sum(m.bytes for m in memos.values()) > REMEMBERED_BYTES:
                    memos.clear()
        if docs:
            yield _packed(docs, memos)

    return run


def _packed(docs: list[tuple], memos: dict[str, _Numbers]) -> pa.RecordBatch:
    """The rows of some documents and of the words that they brought."""
    new = [(m.lang, w, m[w]) for m in memos.values() for w in m.fresh]
    for memo in memos.values():
        memo.fresh.clear()
    n, extra = len(docs), len(new)
    ends = np.cumsum([len(ids) for ids, _, _ in docs])
    lists = pa.ListArray.from_arrays(
        pa.array(np.r_[0, ends, np.full(extra, ends[-1])], pa.int32()),
        pa.array(np.concatenate([ids for ids, _, _ in docs]).view(np.int64)),
        mask=pa.array(np.arange(n + extra) >= n),
    )
    sizes = [int(np.count_nonzero(ids)) for ids, _, _ in docs]
    return pa.RecordBatch.from_arrays(
        [
            lists,
            pa.array([lot for _, lot, _ in docs] + [None] * extra, pa.float64()),
            pa.array([lang for _, _, lang in docs] + [x[0] for x in new], pa.string()),
            pa.array(sizes + [None] * extra, pa.int64()),
            pa.array([None] * n + [x[1].decode("utf-8", "replace") for x in new], pa.string()),
            pa.array(np.r_[np.zeros(n, np.uint64), np.array([x[2] for x in new], np.uint64)].view(np.int64)),
        ],
        ["ids", "lot", "lang", "n", "word", "id"],
    )


def encode(docs: DataFrame) -> DataFrame:
    """Written rows of :func:`_encode`, in which every number belongs to one word of one language.

    Should two words share a number, all words are numbered anew with another seed.
    """
    attempt = 0
    while True:
        rows = materialize(docs.mapInArrow(_encode(attempt), ENCODED))
        owners = rows.where(F.col("word").isNotNull()).groupBy("id").agg(
            F.min(F.struct("lang", "word")).alias("a"), F.max(F.struct("lang", "word")).alias("b")
        )
        if owners.where(F.col("a") != F.col("b")).isEmpty():
            return rows
        attempt += 1


class KeySet:
    """A set of 64-bit keys as bits; it may hold more keys than were put in, never fewer."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = np.zeros(1 << (SET_BITS - 3), np.uint8) if bits is None else bits

    @classmethod
    def of(cls, keys: DataFrame) -> KeySet:
        """The set of the column ``key``. Tasks combine the bits, so the driver gets the bits and no keys: 8 MB at most."""
        place = F.shiftrightunsigned("key", 64 - SET_BITS)
        buckets = keys.select(
            F.shiftright(place, BUCKET_BITS).alias("bucket"), place.bitwiseAND((1 << BUCKET_BITS) - 1).alias("bit")
        )
        made = cls()
        size = 1 << (BUCKET_BITS - 3)
        for bucket, bits in buckets.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
            made.bits[bucket * size : (bucket + 1) * size] = np.frombuffer(bytes(bits), np.uint8)
        return made

    def with_(self, other: KeySet) -> KeySet:
        return KeySet(self.bits | other.bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(64 - SET_BITS)
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


# A key says in its lowest bits how many words it has and whether they were proposed; the other bits are a hash.
def _tagged(keys: np.ndarray, words: int, proposed: np.ndarray | bool) -> np.ndarray:
    flag = np.asarray(proposed).astype(np.uint64)
    return (keys & ~np.uint64(7)) | np.uint64(2 * words) | flag


def _words_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, 1).bitwiseAND(3)


def _unproposed(key: Column) -> Column:
    return key.bitwiseAND(1) == 0


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of word numbers: for N = 1 to 3 the keys of the N-grams that begin in the run, and whether each is one."""
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy().view(np.uint64)
        for start in range(0, len(flat), STEP):
            ids = np.r_[flat[start : start + STEP + LONGEST - 1], np.zeros(LONGEST - 1, np.uint64)]
            m = min(STEP, len(flat) - start)
            word = ids != 0
            one = mix64(ids)
            two = mix64(one[:-1] * ODD + ids[1:])
            three = mix64(two[:-1] * ODD + ids[2:])
            pair = word[:-1] & word[1:]
            yield ids, m, (one, two, three), (word, pair, pair[:-1] & word[2:])


def _sample_keys():
    """Rows (ids) to (key, n): words and pairs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, m, keys, there in _windows(batches):
            tagged = [_tagged(keys[k][:m][there[k][:m]], k + 1, False) for k in (0, 1)]
            yield _tally(np.concatenate(tagged))

    return run


def _tally(keys: np.ndarray) -> pa.RecordBatch:
    values, counts = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])


def _border_keys(seen, proposed):
    """Rows (ids) to (key, n): N-grams whose parts are all in ``proposed`` and were not all in ``seen``.

    Both are broadcast pairs of sets, of words and of pairs of words; ``seen`` is None in the first full pass, which counts the
    words, too. Proposals and their negative border are counted alike, because both are what has all parts
    proposed; the key tells them apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = proposed.value
        for _, m, (one, two, three), (word, pair, triple) in _windows(batches):
            w, p = words.has(one), pairs.has(two)
            wants2, wants3 = pair & w[:-1] & w[1:], triple & p[:-1] & p[1:]
            if seen is not None:
                old_w, old_p = seen.value[0].has(one), seen.value[1].has(two)
                wants2 &= ~(old_w[:-1] & old_w[1:])
                wants3 &= ~(old_p[:-1] & old_p[1:])
            parts = [_tagged(two[:m][wants2[:m]], 2, p[:m][wants2[:m]]), _tagged(three[:m][wants3[:m]], 3, True)]
            if seen is None:
                parts.append(_tagged(one[:m][word[:m]], 1, w[:m][word[:m]]))
            yield _tally(np.concatenate(parts))

    return run


def _exact_counts(frequent):
    """Rows (ids) to (w1, w2, w3, n) for the N-grams whose keys are in the broadcast sets; w2 and w3 are 0 in shorter ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m, keys, there in _windows(batches):
            for k in range(LONGEST):
                at = np.flatnonzero(there[k][:m] & frequent.value[k].has(keys[k][:m]))
                order = np.argsort(keys[k][at], kind="stable")
                at = at[order]
                columns = [ids[at + j] if j <= k else np.zeros(len(at), np.uint64) for j in range(LONGEST)]
                # Neighbours in the order of keys that are the same words; a shared key alone does not join them.
                starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(at) else at
                counts = np.diff(np.r_[starts, len(at)]).astype(np.int64)
                arrays = [pa.array(c[starts].view(np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts)], ["w1", "w2", "w3", "n"])

    return run


def frequent_keys(texts: DataFrame, least: int = LEAST, sample: float = SAMPLE) -> tuple[KeySet, KeySet, KeySet]:
    """Sets that hold the keys of all words, pairs and triples of words with at least ``least`` occurrences in ``texts`` (ids, lot).

    The sample proposes words and pairs by a lowered count. The first full pass counts all words, the pairs of
    proposed words and the triples of proposed pairs: the proposals and their negative border (a word has no parts, and what a sample
    would add at the last level is counted anyway). What is frequent there without having been proposed is a border
    failure. Failures join the proposals, and a further pass counts what that lets in, until a pass has no failure. Nothing
    frequent is missed, for all parts of a frequent N-gram are frequent. The sample decides only how much is counted.
    """
    context = texts.sparkSession.sparkContext
    lowered = max(1, int(least * sample))
    keys = texts.where(F.col("lot") < sample).select("ids").mapInArrow(_sample_keys(), "key long, n long")
    keys = materialize(keys.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= lowered).select("key"))
    proposed = tuple(KeySet.of(keys.where(_words_of(F.col("key")) == k)) for k in (1, 2))
    frequent = [KeySet() for _ in range(LONGEST)]
    seen_sent = None
    while True:
        sent = context.broadcast(proposed)
        counted = texts.select("ids").mapInArrow(_border_keys(seen_sent, sent), "key long, n long")
        often = materialize(counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"))
        frequent = [f.with_(KeySet.of(often.where(_words_of(F.col("key")) == k))) for k, f in enumerate(frequent, 1)]
        failed = often.where(_unproposed(F.col("key")))
        if seen_sent is not None:
            seen_sent.unpersist()
        if failed.isEmpty():
            sent.unpersist()
            return tuple(frequent)
        new = [KeySet.of(failed.where(_words_of(F.col("key")) == k)) for k in (1, 2)]
        seen_sent, proposed = sent, tuple(p.with_(x) for p, x in zip(proposed, new))


def _wide(c: Column) -> Column:
    return c.cast("decimal(15,0)")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals, which hold all digits up to 10^15 occurrences."""
    top = (F.lit(1_000_000).cast("decimal(7,0)") * (_wide(a) * _wide(a))).cast("decimal(38,0)")
    return F.call_function("div", top, (_wide(left) * _wide(right)).cast("decimal(38,0)"))


def mine_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    sample: float = SAMPLE,
) -> DataFrame:
    """The strongest collocations of two and three words of each language.

    Texts, A-Z lower-cased, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at ``[\\x20\\x09]+`` into words. Candidates
    are phrases with at least ``least`` occurrences (``a``). A cut after the first words has ``l`` and ``r`` occurrences of its two
    parts and the score floor(1000000 a a / (l r)); the lowest cut counts, ties go to the first. A pair that lies in
    a candidate of three words with at least half of its occurrences is dropped. Returns the first ``top`` of each language by
    score, then ``a``, both descending, then phrase in byte order: lang, rank (from 1), phrase, a, l, r, n (words of the language), score.

    A NULL text is empty, a NULL lang is ``und``. Each row counts, repeated rows too. Other columns are not read. Texts without
    words and an empty table give no rows. Counts are exact: numbers of words are checked to be distinct, and what is
    counted by hash is counted again by words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        text.alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), uniform(text).alias("lot")
    )
    with small_batches(docs.sparkSession):
        encoded = encode(rows)
        texts = encoded.where(F.col("word").isNull())
        sent = docs.sparkSession.sparkContext.broadcast(frequent_keys(texts.select("ids", "lot"), least, sample))
        exact = texts.select("ids").mapInArrow(_exact_counts(sent), "w1 long, w2 long, w3 long, n long")
        exact = materialize(exact.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    words = exact.where("w2 = 0").select(F.col("w1").alias("w"), F.col("a").alias("f"))
    pairs = exact.where("w2 <> 0 and w3 = 0").select("w1", "w2", "a")
    triples = exact.where("w3 <> 0").select("w1", "w2", "w3", "a")

    def word(name: str, count: str) -> DataFrame:
        return words.select(F.col("w").alias(name), F.col("f").alias(count))

    a, low, high = F.col("a"), F.col("c1.score"), F.col("c2.score")
    cut = lambda left, right: F.struct(
        _score(a, F.col(left), F.col(right)).alias("score"), F.col(left).alias("l"), F.col(right).alias("r")
    )
    three = (
        triples.join(word("w1", "f1"), "w1")
        .join(word("w3", "f3"), "w3")
        .join(pairs.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"])
        .join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
        .select("w1", "w2", "w3", "a", cut("f1", "f23").alias("c1"), cut("f12", "f3").alias("c2"))
        .select("w1", "w2", "w3", "a", F.when(low <= high, F.col("c1")).otherwise(F.col("c2")).alias("c"))
    )
    # A triple of one word repeated holds its pair twice.
    inside = triples.select("w1", "w2", "a").union(triples.select("w2", "w3", "a"))
    inside = inside.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    two = (
        pairs.join(inside, ["w1", "w2"], "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * a))
        .join(word("w1", "f1"), "w1")
        .join(word("w2", "f2"), "w2")
        .select("w1", "w2", F.lit(0).cast("long").alias("w3"), "a", cut("f1", "f2").alias("c"))
    )
    named = encoded.where(F.col("word").isNotNull()).select("id", "lang", "word")
    named = named.join(words.select(F.col("w").alias("id")), "id", "left_semi")
    named = materialize(named.groupBy("id").agg(F.min("lang").alias("lang"), F.min("word").alias("word")))
    spelled = three.unionByName(two).join(named.select(F.col("id").alias("w1"), "lang", F.col("word").alias("x1")), "w1")
    for k in (2, 3):
        spelled = spelled.join(named.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"x{k}")), f"w{k}", "left")
    found = spelled.select("lang", F.concat_ws(" ", "x1", "x2", "x3").alias("phrase"), "a", "c.l", "c.r", "c.score")
    # A language may hold most candidates: its lots are cut to their first ones before they come together.
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    lots = found.withColumn("_lot", F.pmod(F.xxhash64("phrase"), F.lit(LOTS)))
    first = F.row_number().over(Window.partitionBy("lang", "_lot").orderBy(*order))
    found = lots.withColumn("_first", first).where(F.col("_first") <= top).drop("_lot", "_first")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    best = found.withColumn("rank", rank).where(F.col("rank") <= top)
    sizes = texts.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n"))
    joined = best.join(sizes, best["lang"] == sizes["_lang"])
    return joined.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: DuckDB text of the mining.
SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM d),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, w[i:i + k - 1] AS ws, k, count(*) AS f FROM i, (VALUES (1), (2), (3)) ks(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
c AS (SELECT lang, ws, k, f AS a FROM g WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.*, j, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN g x ON x.lang = c.lang AND x.ws = c.ws[1:j] JOIN g y ON y.lang = c.lang AND y.ws = c.ws[j + 1:]),
s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1),
inside AS (SELECT lang, ws[1:2] AS ws, a FROM c WHERE k = 3 UNION ALL SELECT lang, ws[2:3], a FROM c WHERE k = 3),
dropped AS (SELECT DISTINCT s.lang, s.ws FROM s JOIN inside b ON s.lang = b.lang AND s.ws = b.ws WHERE 100 * b.a >= 50 * s.a),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank,
  array_to_string(ws, ' ') AS phrase, a, l, r, CAST(n.n AS BIGINT) AS n, score
FROM s JOIN n ON n.lang = s.lang WHERE NOT EXISTS (SELECT 1 FROM dropped x WHERE x.lang = s.lang AND x.ws = s.ws)
QUALIFY rank <= 2000
"""
