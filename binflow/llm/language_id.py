"""Language identification: the family first, then linear support vector machines between its languages."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binflow.llm.common import held_out
from binflow.session import materialize

#: Families of languages by their codes; a language that is not named is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "semitic": ("am", "ar", "he", "mt"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}
#: Hashed runs of one to three characters.
BUCKETS, ORDERS = 4096, (1, 2, 3)
#: Documents that the fit reads: about so many of each language, and in all.
PER_LANGUAGE, IN_ALL = 500, 4000


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), f"only {lang}")


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed character runs in the whole lower-cased text; length 1."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    # All ASCII that is no letter counts as one blank.
    points = np.where((points < 97) | ((points > 122) & (points < 128)), np.uint64(32), points)
    out = np.zeros(BUCKETS)
    run = points
    for k in ORDERS:
        if len(points) < k:
            break
        if k > 1:
            run = run[: len(points) - k + 1] * np.uint64(0x100000001B3) + points[k - 1 :]
        mixed = (run + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        out += np.bincount((mixed >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    return np.sqrt(out / max(1.0, out.sum()))


def fit_svm(x: np.ndarray, sign: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights with the intercept last: squared hinge loss, accelerated gradient steps; classes weigh alike."""
    z = np.column_stack([x, np.ones(len(x))])
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    w = v = np.zeros(z.shape[1])
    step = 1.0 / (4.0 + penalty)  # rows have length sqrt(2), so the loss bends by 4 at most
    for i in range(rounds):
        short = np.maximum(0.0, 1.0 - sign * (z @ v))
        new = v - step * (penalty * v - 2.0 * z.T @ (share * short * sign))
        v, w = new + i / (i + 3.0) * (new - w), new
    return w


def fit_pairs(x: np.ndarray, names: list[str]) -> dict[tuple[str, str], np.ndarray]:
    """One machine for each two names: above 0 for the first."""
    names_of = np.array(names)
    out = {}
    for a, b in combinations(sorted(set(names)), 2):
        mine = (names_of == a) | (names_of == b)
        out[a, b] = fit_svm(x[mine], np.where(names_of[mine] == a, 1.0, -1.0))
    return out


def vote(x: np.ndarray, names: list[str], pairs: dict[tuple[str, str], np.ndarray]) -> tuple[str, float]:
    """The name with most won pairs, ties by margin and then by name, and its mean confidence over its pairs."""
    won, trust = dict.fromkeys(names, 0.0), {n: [] for n in names}
    for (a, b), w in pairs.items():
        p = 1 / (1 + np.exp(-4.0 * float(np.clip(x @ w[:-1] + w[-1], -8, 8))))
        won[a if p >= 0.5 else b] += 1
        trust[a].append(p)
        trust[b].append(1 - p)
    mean = {n: float(np.mean(trust[n])) if trust[n] else 1.0 for n in names}
    best = min(names, key=lambda n: (-won[n], -mean[n], n))
    return best, mean[best]


class Hierarchy:
    """Machines between families, and between the languages of each family."""

    def __init__(self, langs: dict[str, list[str]], families: dict, within: dict[str, dict]):
        self.langs, self.families, self.within = langs, families, within

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> Hierarchy:
        group = [family_of(n) for n in langs]
        names = {f: sorted({n for n, g in zip(langs, group) if g == f}) for f in sorted(set(group))}
        within = {}
        for f in names:
            mine = [i for i, g in enumerate(group) if g == f]
            within[f] = fit_pairs(x[mine], [langs[i] for i in mine])
        return cls(names, fit_pairs(x, group), within)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        x = features(text)
        family, p = vote(x, list(self.langs), self.families)
        lang, q = vote(x, self.langs[family], self.within[family])
        return lang, p * q


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()).astype(np.float32) for t in batch.column(1)]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BUCKETS, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["lang", "x"])


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Hierarchy(*shared.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["id", "lang_pred", "score"],
            )

    return run


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    in_all: int = IN_ALL,
) -> DataFrame:
    """Language of each document: id, ``held_out``, ``lang_pred`` and ``score`` (0 to 1).

    Learned from documents outside the held-out fold (crc32 of the id modulo 4 is
    2) that have a language and a letter. About ``per_language`` documents of each
    language, chosen by a hash of the id, at most about ``in_all``, reach the
    driver as vectors of BUCKETS numbers. Linear machines separate each two
    families, then each two languages of the family; votes decide. Every document is
    predicted from its whole text alone.

    A text that is NULL or has no letter is ``und`` with score 0, as is every
    text if there is nothing to learn from. A NULL id is not held out and is
    learned from. Ties go to the larger margin, then to the first name. Repeated
    rows get equal answers. Other columns are not read. An empty table gives an
    empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = materialize(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    n_langs = max(1, counts.count())
    each = max(1, min(per_language, in_all // n_langs))
    # One row per language.
    rates = counts.select(F.col("lang").alias("_lang"), (F.lit(float(each)) / F.col("n")).alias("_rate"))
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(4), "id", "text"), 11) / F.lit(float(1 << 53))
    sample = usable.join(rates, F.col("lang") == F.col("_lang")).where(lot < F.col("_rate")).select("lang", "text")
    learned = sample.mapInArrow(_featured, "lang string, x array<float>").orderBy("lang", F.xxhash64("x")).toArrow()
    langs = learned.column("lang").to_pylist()
    flat = [c.flatten().to_numpy() for c in learned.column("x").chunks]
    x = np.concatenate(flat).reshape(-1, BUCKETS).astype(float) if langs else np.zeros((0, BUCKETS))
    model = Hierarchy.fit(x, langs)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.families, model.within))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("id", "text").mapInArrow(_predicted(shared), f"id {kind}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
