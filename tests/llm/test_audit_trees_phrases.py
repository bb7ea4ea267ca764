"""Filter audit, SimHash trees and phrase mining against brute force and on awkward rows."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from binflow.llm.filter_audit import FILTERS, audit_filters
from binflow.llm.phrase_mining import KeySet, mine_phrases
from binflow.llm.simhash_trees import BKTree, fingerprint, links_within, near_fingerprints, refine, signed

# Columns named like those the operators make on the way.
SCHEMA = "doc_id long, text string, lang string, source string, id long, hash string, bits string, n string, label string, fp string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z", "q", "f", "r") for r in rows], SCHEMA)


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


AWKWARD = [
    (1, "Tom #1 " * 150, "en", "a"),
    (1, "Tom #1 " * 150, "en", "a"),
    (2, "Tom #1 " * 150, "en", None),
    (3, None, None, None),
    (4, "", "en", ""),
    (None, "", "en", "b"),
    (None, "Tom #1 " * 150, "en", "b"),
    (5, "\n\n  \n", "fr", "b"),
    (6, " ".join(f"w{i}" for i in range(300)), "en", "b"),
    (7, " ".join(f"w{i}" for i in range(300)), "en", "b"),
    (7, "other | text", "en", "b"),
    (8, "x" * 200_000 + " " + "Y" * 10_000, "zz", "c"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, AWKWARD)


def brute_audit(rows, labels):
    texts = defaultdict(set)
    for i, t, _, _ in rows:
        if i is not None:
            texts[t or ""].add(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, t, _, s in rows:
        t = t or ""
        w = blank_words(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": i is not None and min(texts[t]) < i,
        }
        docs.append((s or "", fails, i in good, i in toxic))
    out, removed = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations(FILTERS):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                stay = [d for d in left if not d[1][x]]
                redundant = sum(d[1][x] for d in mine) - len(gone)
                unique = sum(d[1][x] and sum(d[1].values()) == 1 for d in mine)
                out[part, "".join(order), step] = [
                    len(stay), len(gone), redundant, unique, sum(d[2] for d in gone), sum(d[3] for d in gone)
                ]
                removed[part, x] += len(gone)
                left = stay
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(df):
    return {(r[0], r[1], r[2]): tuple(r)[3:] for r in df.collect()}


def test_audit_awkward(spark, awkward):
    labels = [(1, 1, 0), (1, 0, 1), (7, 1, None), (None, 1, 1), (2, None, 1), (99, 1, 1), (4, 1, 0)]
    table = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, bits int")
    got = audit_rows(audit_filters(awkward, table))
    assert len(got) == 600 * 4  # '', a, b, c
    assert got == brute_audit(AWKWARD, labels)


def test_audit_empty(spark, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(awkward.limit(0), labels).count() == 0
    assert audit_rows(audit_filters(awkward, labels)) == brute_audit(AWKWARD, [])


def test_audit_many_copies(spark):
    """One text holds a third of all rows, over several parts."""
    rows = [(i, "same words here" if i % 3 == 0 else f"text {i} " * 210, "en", f"s{i % 4}") for i in range(900)]
    labels = spark.createDataFrame([(i, i % 2, i % 5 == 0) for i in range(900)], "doc_id long, quality int, toxic boolean")
    labels = labels.withColumn("toxic", F.col("toxic").cast("int"))
    got = audit_rows(audit_filters(frame(spark, rows).repartition(13), labels))
    assert got == brute_audit(rows, [(i, i % 2, int(i % 5 == 0)) for i in range(900)])


# SimHash trees


def near_values(rng, n):
    """Numbers that cluster: bits flipped one to four at a time from a few centres."""
    values = [rng.getrandbits(64) for _ in range(8)] + [0]
    while len(values) < n:
        v = rng.choice(values)
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    return sorted(set(values))


def brute_groups(values, radius):
    group = {v: {v} for v in values}
    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= radius and group[a] is not group[b]:
            group[a] |= group[b]
            for v in group[b]:
                group[v] = group[a]
    return {frozenset(g) for g in group.values()}


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_tree_finds_all_within(radius):
    rng = random.Random(radius)
    values = near_values(rng, 400)
    rng.shuffle(values)
    tree = BKTree()
    for v in [*values, *values[:50]]:
        tree.add(v)
    assert len(tree.values) == len(values)
    for node, edges in enumerate(tree.children):
        assert all((tree.values[node] ^ tree.values[child]).bit_count() == d for d, child in edges.items())
    for q in values[:100] + [rng.getrandbits(64)]:
        assert set(tree.within(q, radius)) == {v for v in values if (v ^ q).bit_count() <= radius}
    assert list(BKTree().within(3, radius)) == []


def test_refined_masks_cover_all_open_bits():
    masks = refine(0, 2)
    assert masks[0] | masks[1] | masks[2] == 2**64 - 1 and sum(m.bit_count() for m in masks) == 64
    for m in masks:
        finer = refine(m, 2)
        assert len(finer) == 3 and finer[0] | finer[1] | finer[2] == 2**64 - 1
        assert all(f & m == m for f in finer)


@pytest.mark.parametrize("shard", [8, 2048])
def test_links_connect_what_brute_force_connects(spark, shard):
    """Small shards force many rounds of refinement; the groups stay the same."""
    values = near_values(random.Random(shard), 300)
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = [(a % 2**64, b % 2**64) for a, b in links_within(fps, 2, shard).collect()]
    group = {v: {v} for v in values}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for v in group[b]:
                group[v] = group[a]
    assert {frozenset(g) for g in group.values()} == brute_groups(values, 2)


def brute_fingerprint(spark, text):
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in blank_words(text)]
    if not words:
        return 0
    n = min(3, len(words))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    hashes = [r[0] % 2**64 for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "a a a a a", "É A\x0bB\x0cC ß D e F ÄX", "x y " * 40_000])
def test_fingerprint(spark, text):
    assert fingerprint(text) == brute_fingerprint(spark, text)


def test_near_fingerprints_awkward(spark, awkward):
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(2000)]
    near = list(base)
    near[1000] = "other"
    rows = [*AWKWARD, (20, " ".join(base), "en", "a"), (15, " ".join(near).upper(), "en", "a"), (30, " ".join(base), None, None)]
    docs = frame(spark, rows)
    got = near_fingerprints(docs).collect()
    assert len(got) == len(rows)
    prints = {(i, t): fingerprint(t) for i, t, _, _ in rows}
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{p:016x}") for (i, t), p in [((r[0], r[1]), prints[r[0], r[1]]) for r in rows])
    least = {}
    for g in brute_groups(sorted({p for (i, _), p in prints.items() if i is not None}), 2):
        smallest = min(i for (i, _), p in prints.items() if p in g and i is not None)
        least |= {p: smallest for p in g}
    for r in got:
        assert r.component_id == (None if r.doc_id is None else least[int(r.fingerprint, 16)])
    assert near_fingerprints(awkward.limit(0)).count() == 0


def test_near_fingerprints_on_tables(spark, small):
    """All components of the smallest table against all pairs."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in near_fingerprints(docs).collect()}
    prints = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    for g in brute_groups(sorted(set(prints.values())), 2):
        members = [i for i, p in prints.items() if p in g]
        assert {got[i].component_id for i in members} == {min(members)}


# Phrases


def brute_phrases(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made_texts(rng, n_docs):
    common = [f"c{i}" for i in range(12)]
    rare = [f"r{i}" for i in range(60)]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 60)):
            x = rng.random()
            words.append("new york city" if x < 0.1 else "Los Angeles" if x < 0.2 else rng.choice(common) if x < 0.8 else rng.choice(rare))
            if rng.random() < 0.1:
                words.append(rng.choice([". ", ",", "!\n", " ;; "]))
        rows.append((i, " ".join(words), rng.choice(["en", "en", "fr", None, "und"]), "a"))
    return rows


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    extra = [
        (1000, None, "en", "a"),
        (1001, "", None, None),
        (1002, "aa aa aa aa " * 30, "x1", "a"),
        (1003, "Ä é\x00b \x0b ß Ä é\x00b " * 20, "x1", "a"),
        (1003, "Ä é\x00b \x0b ß Ä é\x00b " * 20, "x1", "a"),
        (None, "tie one . tie two . " * 15, "x2", "a"),
        (1005, "y" * 100_000 + " z " + "y" * 100_000, "x2", "a"),
        (1006, "long text of words " * 30_000, "x3", "a"),
    ]
    return made_texts(rng, 300) + extra


@pytest.mark.parametrize("sample", [0.0, 0.01, 1 / 16, 1.0])
def test_phrases_do_not_depend_on_the_sample(spark, texts, sample):
    """Without a sample everything frequent is a border failure, and is found by the expansion passes."""
    docs = frame(spark, texts).repartition(5)
    got = sorted(tuple(r) for r in mine_phrases(docs, sample=sample).collect())
    assert got == brute_phrases(texts)


def test_phrases_top_and_least(spark, texts):
    docs = frame(spark, texts)
    got = sorted(tuple(r) for r in mine_phrases(docs, least=4, top=7).collect())
    assert got == brute_phrases(texts, 4, 7)
    assert mine_phrases(docs.limit(0)).count() == 0
    assert mine_phrases(frame(spark, [(1, "...", None, None), (2, None, "en", "a")])).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    from binflow.llm.phrase_mining import _score

    rows = [(3_000_000_000, 4_000_000_000, 5_000_000_001), (10**12, 10**12, 10**12), (7, 10**12, 9)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = [r[0] for r in df.select(_score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in rows]


def test_key_set(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    made = KeySet.of(spark.createDataFrame([(int(k),) for k in keys[:1000].view(np.int64)], "key long"))
    assert made.has(keys[:1000]).all() and made.has(keys[1000:]).mean() < 0.01
