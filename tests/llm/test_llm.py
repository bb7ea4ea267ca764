"""The dealt operators against brute force and on awkward rows."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from binflow.llm.common import n_words
from binflow.llm.compact_windows import (
    MARGIN, PIECE, _beside_first, _joint, _later_rounds, _windows, compact_windows, extend, lines, match, match_plain, may_match, merge, repeated_passages, shared_keys
)
from binflow.llm.compression_quality import BLOCK, BLOCKS_PER_DOC, _sample_blocks, score_quality
from binflow.llm.language_id import identify
from binflow.llm.license_scan import _bands, scan_licenses
from binflow.llm.line_dedup import dedup_lines
from binflow.llm.ngram_join import keep_one, near_components, prefix_signatures
from binflow.llm.perplexity import judge, keep_good
from binflow.llm.pivotal_mix import mix_sources
from binflow.llm.spaced_seed import MASKS, contaminated, decontaminate, seeds_cover
from binflow.llm.url_filter import judge_urls
from binflow.session import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, label string, n_lines string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "y", "z") for r in rows], SCHEMA)


WORDS = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(1)
    base = sentence(rng, 120)
    rows = [
        (1, base, "en", "a"),
        (1, base, "en", "a"),
        (2, base.upper(), "en", None),
        (3, None, None, None),
        (4, "", "en", "a"),
        (None, base, "en", "b"),
        (5, "\n\n  \n", "fr", "b"),
        (6, sentence(rng, 30_000), "en", "b"),
        (7, "one two", None, "c"),
        (8, "#*$ 😀 \x00 1234", "zz", "c"),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def test_line_dedup_awkward(awkward, empty):
    out = dedup_lines(awkward).toPandas()
    assert len(out) == 10 and list(out.columns) == [c for c in awkward.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    # The base line has the ids 1, 2 and NULL: two documents only.
    assert out.n_dropped.sum() == 0
    assert dedup_lines(empty).count() == 0


def test_line_dedup_keeps_largest(spark):
    line = "a line of more than twenty characters"
    docs = frame(spark, [(i, f" {line.upper()}\t\nown {i}\n{line}", "en", "a") for i in (3, 9, 4)])
    out = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert [out[i].n_dropped for i in (3, 4, 9)] == [2, 2, 0]
    assert out[3].text == "own 3" and out[9].text.endswith(line)


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def mutated(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = rng.choice(WORDS)
    return " ".join(words)


def test_ngram_join_matches_brute_force(spark):
    rng = random.Random(2)
    base = sentence(rng, 150)
    texts = [mutated(rng, base, rng.choice([0, 1, 2, 3, 5, 8])) for _ in range(120)]
    texts += [sentence(rng, rng.choice([1, 3, 5, 6, 8, 40])) for _ in range(60)]
    texts += [mutated(rng, t, 1) for t in texts[-30:]] + ["", "a b", "A B", "a b c d e", "a b c d e f"]
    docs = list(enumerate(texts))
    got = near_components(frame(spark, [(i, t, "en", "a") for i, t in docs])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


def test_prefix_signatures_always_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(3, 60))
        pool = rng.integers(1, 2**63, n + 40).astype(np.uint64)
        often = {int(x): bool(rng.random() < 0.6) for x in pool}
        a = np.unique(pool[:n])
        gone = int(rng.integers(0, max(1, n // 7) + 1))
        b = np.unique(np.concatenate([a[gone:], pool[n : n + int(rng.integers(0, max(1, n // 7) + 1))]]))
        inter = len(np.intersect1d(a, b))
        if 4 * inter < 3 * (len(a) + len(b) - inter):
            continue
        key = lambda x: set(prefix_signatures(len(x), x, np.array([often[int(t)] for t in x])).tolist())
        assert key(a) & key(b)


def test_ngram_join_awkward(awkward, empty):
    got = near_components(awkward).toPandas()
    assert len(got) == 10
    of = {r.doc_id: r.component_id for r in got.itertuples() if not pd.isna(r.doc_id)}
    assert of[2] == 1 and of[3] == 3 and of[4] == 4 and got[got.doc_id.isna()].component_id.isna().all()
    assert near_components(empty).count() == 0
    kept = keep_one(awkward).toPandas()
    assert sorted(kept.doc_id.dropna()) == [1, 1, 3, 4, 5, 6, 7, 8] and kept.doc_id.isna().sum() == 1


def test_spaced_seeds(spark, awkward, empty):
    assert seeds_cover() and not seeds_cover((MASKS[0],))
    rng = random.Random(4)
    item = sentence(rng, 40)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short one"), (1, item)], "item_id long, text string")
    far = item.split()
    far[::4] = ["zz"] * len(far[::4])
    near = item.split()
    near[10], near[15] = "zz", "yy"
    docs = frame(
        spark,
        [(1, f"{sentence(rng, 50)} {' '.join(near).upper()}! {sentence(rng, 9)}", "en", "a"), (2, " ".join(far), "en", "a"), (3, sentence(rng, 900), "en", "a"), (4, None, None, None)],
    )
    found = contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.first_word) for r in found] == [(1, 1, 50)]
    assert sorted(r.doc_id for r in decontaminate(docs, bench).collect()) == [2, 3, 4]
    assert contaminated(awkward, bench.limit(0)).count() == 0 and contaminated(empty, bench).count() == 0
    assert decontaminate(awkward, bench).count() == 10


def test_mix(spark, awkward, empty):
    out = mix_sources(awkward, n_words(F.col("text"))).toPandas()
    assert len(out) == 10 and (out.taken <= 3 * out["size"]).all()
    assert mix_sources(empty, n_words(F.col("text"))).count() == 0
    rng = random.Random(5)
    docs = frame(spark, [(i, sentence(rng, rng.randint(1, 60)), "en", rng.choice("aaaab") if i % 7 else None) for i in range(700)])
    a, b = (mix_sources(docs.repartition(n), n_words(F.col("text"))).toPandas().sort_values("doc_id").reset_index(drop=True) for n in (3, 7))
    pd.testing.assert_frame_equal(a, b)
    sums = a.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), all=("size", "sum"))
    assert ((sums.taken - sums.target).abs() <= 60).all() and abs(sums.target.sum() - a["size"].sum()) < 1e-6
    # Targets by rounds: share what is open by weight, cut at three times the source.
    size = {s: float(x) for s, x in sums["all"].items()}
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (not isinstance(s, str), str(s))))}
    fixed = {}
    while True:
        rest = sum(size.values()) - sum(fixed.values())
        open_ = [s for s in size if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s: 3 * size[s] for s in open_ if share[s] > 3 * size[s]}
        if not above:
            break
        fixed |= above
    for s, t in (fixed | share).items():
        row = sums[sums.index.isna()] if not isinstance(s, str) else sums.loc[[s]]
        assert abs(row.target.iloc[0] - t) < 1e-6


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(40)
    sizes = [rng.choice((3, 5, 40, 60, 300, 900, 5000)) for _ in range(400)]
    docs = spark.createDataFrame([(i, "abc"[i % 3], n) for i, n in enumerate(sizes)], "doc_id long, source string, n long")
    runs = [mix_sources(docs, F.col("n"), seed=seed).toPandas() for seed in (1, 2)]
    for out in runs:
        sums = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
        # The small documents of a source are few, and may all be used up by what larger ones leave.
        assert ((sums.taken - sums.target).abs() <= 0.001 * sums.target).all()
        assert (out.taken <= 3 * out["size"]).all() and (out.copies >= 0).all()
    # Seeds choose different documents.
    assert not runs[0].sort_values("doc_id").copies.reset_index(drop=True).equals(runs[1].sort_values("doc_id").copies.reset_index(drop=True))
    # One source of a single large document and few words else: they take up what they can.
    few = spark.createDataFrame([(1, "a", 9000), (2, "a", 10), (3, "b", 50), (4, None, None), (5, "b", 0)], "doc_id long, source string, n long")
    out = mix_sources(few, F.col("n")).toPandas()
    assert len(out) == 5 and (out.taken <= 3 * out["size"]).all()


def test_letters_of_languages(spark):
    docs = frame(spark, [(1, "the cat and the dog", "en", "a"), (2, "le chat et le chien", "fr", "a"), (3, "\u00bd \u00b2 12", "fr", "a"), (5, "\u4f60", None, "a")])
    out = {r["doc_id"]: r["lang_pred"] for r in identify(docs).collect()}
    assert out[3] == "und" and out[5] != "und"


def test_perplexity(spark, awkward, empty):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "ne", "lu", "sa"]) for _ in range(rng.randint(2, 4)))
    good = [(i, " ".join(word() for _ in range(200)), "en", "a") for i in range(80)]
    junk = (99, " ".join("".join(rng.choice("qxzjk#%&") for _ in range(7)) for _ in range(200)), "en", "a")
    docs = frame(spark, [*good, junk])
    out = judge(docs).toPandas().set_index("doc_id")
    assert not out.kept[99] and not out.base_failed[99] and out.kept.drop(99).mean() > 0.97
    assert set(keep_good(docs).columns) == set(docs.columns)
    odd = judge(awkward).toPandas()
    assert len(odd) == 10 and odd[odd.n_words < 50].base_failed.all()
    assert judge(empty).count() == 0 and keep_good(empty).count() == 0
    assert keep_good(awkward).count() == odd.kept.sum()


def test_bands_reject_bad_and_keep_good(spark, small):
    at = small.replace("sf0.001", "sf0.01")
    out = judge(spark.read.parquet(f"{at}/documents.parquet")).where("not base_failed")
    rates = out.join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg((~F.col("kept")).cast("int")).alias("r"))
    rate = {r.quality: r.r for r in rates.collect()}
    assert rate[0] > 0.5 and rate[1] < 0.01


def test_base_figures(spark):
    text = "a b c\na b c\n\n\nd | e # f\na b c"
    r = judge(frame(spark, [(1, text, "en", "a")])).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (14, 14, 2, 2, 9)


def test_quality(spark, awkward, empty):
    rng = random.Random(7)
    rows = [(i, sentence(rng, 80) if i % 3 else "### ".join(sentence(rng, 80).split()), "en", "a") for i in range(600)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    out = score_quality(docs, labels).toPandas()
    assert out.score.between(0, 1).all()
    held = out[out.held_out]
    assert ((held.doc_id % 3 > 0).astype(int) == held.predicted).mean() > 0.95
    assert score_quality(awkward, labels.limit(0)).toPandas().score.between(0, 1).all()
    assert score_quality(awkward, labels).count() == 10 and score_quality(empty, labels).count() == 0


def test_sampled_blocks_span_the_text():
    import pyarrow as pa

    for n in (0, 1, 5, 6, 11, 17, 40):
        text = "".join(chr(65 + i) * BLOCK for i in range(n))
        batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([text])], ["quality", "text"])
        at = [b.as_py()[0] - 65 for b in next(_sample_blocks(iter([batch]))).column(1)]
        assert at == sorted({i * n // BLOCKS_PER_DOC for i in range(BLOCKS_PER_DOC)} if n else [])


def test_language(spark, small, awkward, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (out[out.held_out].lang_pred == out[out.held_out].lang).mean() > 0.95
    odd = identify(awkward).toPandas().set_index("doc_id")
    assert len(odd) == 10 and set(odd.lang_pred[[3, 4, 5, 8]]) == {"und"} and odd.score.between(0, 1).all()
    assert identify(empty).count() == 0


def test_urls(spark):
    urls = [None, "", "no host", "http://A.Example.com/en/x", "https://www.example.com/en/?a#b", "http://x.net/es/1", "http://free.casino.org/", "http://x.org/porn?", "http://x.org/sporno", "http://com", "http://com/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = judge_urls(pages).toPandas().sort_values("page_id")
    assert out.verdict.tolist() == ["allow", "allow", "allow", "block", "allow", "block", "block", "block", "allow", "allow", "allow"]
    assert out.rule.tolist()[3:6] == ["example.com/en/", "www.example.com/en/", "net/es/"] and out.rule.tolist()[9:] == [None, "com/"]
    assert judge_urls(pages.limit(0)).count() == 0


def test_licenses(spark, awkward, empty):
    rng = random.Random(8)
    rows = [(1, sentence(rng, 37) + "\nReleased under the MIT License.", "en", "a"), (2, "Licensed under the Apache License, Version 2.0! " + sentence(rng, 20), "en", "a"), (3, sentence(rng, 500) + " ALL RIGHTS RESERVED", "en", "a"), (4, sentence(rng, 300), "en", "a")]
    got = {(r.doc_id, r.license, r.first_word) for r in scan_licenses(frame(spark, rows)).collect()}
    assert got == {(1, "MIT", 37), (2, "Apache-2.0", 0), (3, "all-rights-reserved", 500)}
    assert scan_licenses(awkward).count() == 0 and scan_licenses(empty).count() == 0


def test_license_bands_are_independent(spark):
    rng, n = random.Random(24), 10000
    pairs = [[rng.randrange(-(2**63), 2**63) for _ in range(7)] for _ in range(n)]
    sides = [_bands(spark.createDataFrame([(i, 0, p[:m]) for i, p in enumerate(pairs)], "id long, _at int, _pairs array<long>")) for m in (7, 2)]
    met = sides[0].select("id", "_band").join(sides[1].select("id", "_band"), ["id", "_band"]).select("id").distinct().count()
    assert n - met <= 0.006 * n


def test_compact_windows_match_the_definition():
    rng = np.random.default_rng(9)
    for n, least in ((60, 7), (200, 46), (30, 30), (20, 21)):
        h = rng.integers(0, 50 if n == 60 else 2**62, n).astype(np.uint64)
        want = set()
        for c in range(n):
            lo = c
            while lo > 0 and h[lo - 1] > h[c]:
                lo -= 1
            hi = c
            while hi + 1 < n and h[hi + 1] >= h[c]:
                hi += 1
            if hi - lo + 1 >= least:
                want.add((lo, c, hi))
        assert set(zip(*(x.tolist() for x in compact_windows(h, least)))) == want


def test_passages(spark, awkward, empty):
    rng = random.Random(10)
    shared = sentence(rng, 70)
    rows = [(i, f"{sentence(rng, 40)} {shared if i % 2 else mutated(rng, shared, 1)} {sentence(rng, 30)}", "en", "a") for i in range(12)]
    rows += [(100 + i, sentence(rng, 200), "en", "a") for i in range(12)]
    out = repeated_passages(frame(spark, rows)).toPandas()
    exact = {i for i in range(12) if i % 2}
    assert exact <= set(out.doc_id) <= set(range(12))
    assert (out.last_word - out.first_word >= 49).all()
    odd = repeated_passages(awkward).toPandas()
    assert set(odd.doc_id) == {1, 2} and (odd.of_doc_id == 1).all()
    assert repeated_passages(empty).count() == 0


def test_rows_that_match_are_never_ruled_out():
    rng = np.random.default_rng(3)
    for _ in range(300):
        core = rng.integers(0, 1 << 40, int(rng.integers(30, 80)))
        a = np.concatenate([rng.integers(0, 1 << 40, int(rng.integers(0, 60))), core, rng.integers(0, 1 << 40, int(rng.integers(0, 60)))])
        b = np.concatenate([rng.integers(0, 1 << 40, int(rng.integers(0, 60))), core, rng.integers(0, 1 << 40, int(rng.integers(0, 60)))])
        for x, y in ((a, b), (b, a)):
            if match(x, y, 46, 0.75):
                assert may_match(x, y, 46, 0.75, False)
    # A common run too short for any passage.
    core = rng.integers(0, 1 << 40, 36)
    a, b = (np.concatenate([rng.integers(0, 1 << 40, 50), core, rng.integers(0, 1 << 40, 50)]) for _ in range(2))
    assert not match(a, b, 46, 0.75) and not may_match(a, b, 46, 0.75, False)


def test_later_rounds_find_every_passage_of_a_key(spark):
    rng = random.Random(12)
    parts = [sentence(rng, 70) for _ in range(12)]
    texts = [(i, f"{sentence(rng, 20)} {parts[i % 12] if i < 24 else sentence(rng, 70)} {sentence(rng, 20)}") for i in range(30)]
    left = spark.createDataFrame([(1, i, 20, 85, 50) for i, _ in texts], "key long, id long, l int, r int, a int")
    schema = "id long, of long, first_word int, last_word int, of_first_word int, of_last_word int"
    found = [r for f in _later_rounds(left, spark.createDataFrame(texts, "id long, text string"), 46, 0.75, schema) for r in f.collect()]
    assert {frozenset((r["id"], r["of"])) for r in found} == {frozenset((i, i + 12)) for i in range(12)}


def test_settled_documents_stay_partners(spark):
    rng = random.Random(20)
    rows, chains = [], 12
    for k in range(chains):
        z, core, y = (" ".join(f"{c}{k}x{rng.randrange(10**6)}" for _ in range(n)) for c, n in (("z", 20), ("c", 46), ("y", 8)))
        texts = (f"{z} {core} {sentence(rng, 30)}", f"{z} {core} {y} {sentence(rng, 20)}", f"{sentence(rng, 30)} {core} {y} {sentence(rng, 20)}")
        rows += [(100 * i + k, t, "en", "a") for i, t in enumerate(texts)]
    out = repeated_passages(frame(spark, rows)).toPandas()
    assert set(out.doc_id) == {100 * i + k for i in range(3) for k in range(chains)}


def test_every_place_of_a_document_is_compared(spark):
    rng = random.Random(21)
    rows, cases = [], 8
    for k in range(cases):
        core, y = (" ".join(f"{c}{k}x{rng.randrange(10**6)}" for _ in range(n)) for c, n in (("c", 49), ("y", 8)))
        rows.append((k, f"{core} {sentence(rng, 60)} {core} {y} {sentence(rng, 20)}", "en", "a"))
        rows.append((100 + k, f"{sentence(rng, 30)} {core} {y} {sentence(rng, 20)}", "en", "a"))
    out = repeated_passages(frame(spark, rows)).toPandas()
    assert set(out.doc_id) == {100 * i + k for i in range(2) for k in range(cases)}


def test_later_rounds_compare_every_place(spark):
    rng = random.Random(22)
    core, y = sentence(rng, 45), sentence(rng, 20)
    texts = [(1, f"{core} {sentence(rng, 60)} {core} {y}"), (2, f"{sentence(rng, 40)} {core} {y}")]
    left = spark.createDataFrame([(1, 1, 0, 60, 20), (1, 1, 105, 165, 125), (1, 2, 40, 100, 60)], "key long, id long, l int, r int, a int")
    schema = "id long, of long, first_word int, last_word int, of_first_word int, of_last_word int"
    found = [r for f in _later_rounds(left, spark.createDataFrame(texts, "id long, text string"), 46, 0.75, schema) for r in f.collect()]
    assert {frozenset((r["id"], r["of"])) for r in found} == {frozenset((1, 2))}


def test_near_copies_are_found(spark):
    rng = random.Random(23)
    rows, pairs = [], 60
    for k in range(pairs):
        word = lambda: f"k{k}x{rng.randrange(10**6)}"  # noqa: B023, E731
        core = [word() for _ in range(50 + 5 * (k % 3))]
        other = [*core[: len(core) // 2], word(), *core[len(core) // 2 + 1 :]]
        rows += [(2 * k + i, " ".join([*(word() for _ in range(30)), *part, *(word() for _ in range(30))]), "en", "a") for i, part in enumerate((core, other))]
    tokens = {i: [tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)] for i, t, *_ in rows}
    codes = collections.defaultdict(lambda: len(codes))
    shingles = {i: np.array([codes[x] for x in v]) for i, v in tokens.items()}
    want = {2 * k for k in range(pairs) if match(shingles[2 * k], shingles[2 * k + 1], 46, 0.75)}
    found = set(repeated_passages(frame(spark, rows)).toPandas().doc_id)
    assert len(want) == pairs and len(want & found) >= 0.98 * pairs


def test_lines_of_functions():
    found = lines(9)
    assert len(found) == 12
    # Two functions lie on one line, and any five hold one.
    assert all(sum(set(p) <= set(t) for t in found) == 1 for p in itertools.combinations(range(9), 2))
    assert all(any(set(t) <= set(five) for t in found) for five in itertools.combinations(range(9), 5))


def test_windows_of_many_texts_are_those_of_each():
    rng = random.Random(30)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(n)) for n in (60, 0, 3, 49, 50, 51, 700, PIECE + 3 * MARGIN)]
    run = lambda chosen: {
        tuple(r.values())
        for batch in _windows(5, 46, 3)(iter([pa.RecordBatch.from_pydict({"id": [k for k, _ in chosen], "text": [t for _, t in chosen]})]))
        for r in batch.to_pylist()
    }
    rows = list(enumerate(texts))
    assert run(rows) == set().union(*(run([row]) for row in rows))
    found = [b for b in _windows(5, 46, 1)(iter([pa.RecordBatch.from_pydict({"id": [1], "text": [texts[-1]]})]))]
    centres = np.sort(np.concatenate([b.column(3).to_numpy() for b in found]))
    # No centre twice, and none missing where two pieces overlap.
    assert (np.diff(centres) > 0).all() and np.diff(centres).max() < 2 * 46


def test_shared_keys_hold_every_key_of_two_documents(spark):
    rng = random.Random(33)
    part = sentence(rng, 300)
    texts = [(i, f"{sentence(rng, 200)} {part if i % 2 else sentence(rng, 300)}") for i in range(8)]
    rows = [r for b in _windows(5, 46, 9)(iter([pa.RecordBatch.from_pydict({"id": [i for i, _ in texts], "text": [t for _, t in texts]})])) for r in b.to_pylist()]
    owners = collections.defaultdict(set)
    for r in rows:
        owners[r["key"]].add(r["id"])
    keys = np.array(list(owners), np.int64).view(np.uint64)
    held = shared_keys(spark.createDataFrame(texts, "id long, text string"), sum(len(t) for _, t in texts), 46, 9).has(keys)
    twice = np.array([len(v) > 1 for v in owners.values()])
    assert twice.sum() > 20 and held[twice].all() and held[~twice].mean() < 0.1


def test_rows_beside_the_first_of_their_key_over_batches():
    rng = random.Random(36)
    rows = sorted({(rng.randrange(12), f"d{rng.randrange(6)}", *[rng.randrange(3)] * 3) for _ in range(150)})
    want = set()
    for k in {r[0] for r in rows}:
        of = min(r[1] for r in rows if r[0] == k)
        theirs = tuple(r[2:] for r in rows if r[:2] == (k, of))
        want |= {(*r, of, theirs) for r in rows if r[0] == k and r[1] != of}
    names = ["key", "id", "l", "r", "a"]
    for size in (1, 2, 7, 200):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        got = [r for b in _beside_first(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(want)
        assert {(*(r[n] for n in names), r["of"], tuple((t["l"], t["r"], t["a"]) for t in r["theirs"])) for r in got} == want


def test_quick_match_is_the_match():
    rng, found = np.random.default_rng(34), 0
    for _ in range(500):
        core = rng.integers(0, 1 << 40, int(rng.integers(35, 80)))
        other = np.where(rng.random(len(core)) < rng.choice([0, 0.05, 0.2]), rng.integers(0, 1 << 40, len(core)), core)
        cut = int(rng.integers(0, len(other)))
        other = np.concatenate([other[:cut], rng.integers(0, 1 << 40, int(rng.integers(0, 30))), other[cut:]])
        a, b = (np.concatenate([rng.integers(0, 1 << 40, int(rng.integers(0, 30))), x, rng.integers(0, 1 << 40, 9)]) for x in (core, other))
        at_a, at_b = ({x: i for i, x in enumerate(v.tolist())} for v in (a, b))
        want = match(a, b, 46, 0.75)
        assert match_plain(a.tolist(), at_a, b.tolist(), at_b, 46, 0.75) == want
        found += want is not None
    assert 50 < found < 450


def test_passages_need_little_shuffle_and_scratch(spark, tmp_path, monkeypatch):
    """Texts are not written and shuffled whole, and windows that no other document has not at all."""
    from binflow.llm import compact_windows as module

    rng, written = random.Random(35), []
    monkeypatch.setattr(module, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    part = sentence(rng, 80)
    rows = [(i, f"{sentence(rng, 400)} {part if i < 4 else ''}", "en", "a") for i in range(200)]
    assert {r.doc_id for r in repeated_passages(frame(spark, rows)).collect()} == {0, 1, 2, 3}
    assert max(t.count() for t in written if "text" in t.columns) == 4
    assert sum(t.count() for t in written if "key" in t.columns) < 2000


def test_joint_keys_match_the_definition():
    rng = random.Random(31)
    rows = []
    for doc in range(4):
        windows = []
        for f in range(9):
            at = 0
            while at < 400:
                c, width = at + rng.randrange(1, 40), rng.randrange(1, 60)
                windows.append({"key": rng.randrange(-(2**63), 2**63), "f": f, "c": c + 60, "l": c + 60 - 45, "r": c + 60 - 45 + 45 + width - 1})
                at = c + 60 + width
        rng.shuffle(windows)
        rows.append((doc, windows))
    kind = pa.list_(pa.struct([("key", pa.int64()), ("f", pa.int32()), ("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([w for _, w in rows], kind)], ["id", "windows"])
    got = collections.Counter(tuple(r[k] for k in ("id", "l", "r", "a")) for b in _joint(46, 9)(iter([batch])) for r in b.to_pylist())
    want = collections.Counter()
    for doc, windows in rows:
        by = collections.defaultdict(list)
        for w in windows:
            by[w["f"]].append((max(w["l"], w["c"] - 45), min(w["c"], w["r"] - 45), w["c"]))
        for line in lines(9):
            for trio in itertools.product(*(by[f] for f in line)):
                s, e = max(x[0] for x in trio), min(x[1] for x in trio)
                if s <= e:
                    want[doc, s, e + 45, min(x[2] for x in trio)] += 1
    assert got == want and want


def test_matches_are_lengthened_and_merged():
    rng = np.random.default_rng(32)
    core = rng.integers(0, 1 << 40, 3000)
    a, b = (np.concatenate([rng.integers(0, 1 << 40, k), core, rng.integers(0, 1 << 40, 30)]) for k in (40, 90))
    assert extend(a, b, (500, 560, 550, 610), 0.75) == (40, 3039, 90, 3089)
    # Over a replaced stretch, not into what differs.
    b[1000:1005] = 1
    assert extend(a, b, (500, 560, 550, 610), 0.75) == (40, 3039, 90, 3089)
    assert extend(a, b, (0, 0, 0, 0), 0.75) == (0, 0, 0, 0)
    assert merge(a, b, [(40, 500, 90, 550), (450, 3039, 500, 3089), (60, 100, 110, 150)], 0.75) == [(40, 3039, 90, 3089)]


def test_repeats_are_reported_whole(spark):
    rng = random.Random(33)
    rows, want, pairs = [], set(), 200
    for k in range(pairs):
        n = 3000 if k == 0 else rng.randrange(50, 121)
        word = lambda: f"r{k}x{rng.randrange(10**6)}"  # noqa: B023, E731
        core = [word() for _ in range(n)]
        starts = [rng.randrange(0, 60) for _ in range(2)]
        for i, start in enumerate(starts):
            text = [*(f"u{word()}" for _ in range(start)), *core, *(f"u{word()}" for _ in range(rng.randrange(0, 60)))]
            rows.append((2 * k + i, " ".join(text), "en", "a"))
            want.add((2 * k + i, 2 * k, start, start + n - 1, starts[0], starts[0] + n - 1))
    out = repeated_passages(frame(spark, rows)).toPandas()
    assert set(map(tuple, out[["doc_id", "of_doc_id", "first_word", "last_word", "of_first_word", "of_last_word"]].to_numpy())) == want


def test_queries_match_duckdb(spark, small):
    import duckdb

    from binflow.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    text = lambda f: sorted(tuple(str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False))
    for name, sql in ORACLES.items():
        assert text(QUERIES[name](spark, small).toPandas()) == text(con.execute(sql).df()), name


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = corpus_pipeline.run(spark, small).toPandas()
    assert 0 < len(out) <= docs.count() and out.doc_id.is_unique and len(corpus_pipeline.STAGES) == 5
