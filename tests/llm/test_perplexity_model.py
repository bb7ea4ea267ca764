"""The character model is a probability model, and its splitting of words is the contract's."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from binflow.llm import perplexity
from binflow.llm.perplexity import BITS, ORDER, Model, base_figures, count_ngrams, judge, keep_good, kneser_ney, split_model, words_of


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    letters = "aabbccdeé߀中"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(60)) for _ in range(20)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string")
    return Model.of(*kneser_ney(count_ngrams(rows)))


def test_every_context_sums_to_one(model):
    rng = random.Random(3)
    symbols = np.arange(1 << BITS)
    seen = model.tables[ORDER - 1][0]
    contexts = [0, *(int(g) for g in rng.sample(list(seen), 40)), *(rng.getrandbits(BITS * (ORDER - 1)) for _ in range(10))]
    for context in contexts:
        for span in range(1, ORDER + 1):
            low = (1 << (BITS * (span - 1))) - 1
            grams = (np.int64(context & low) << BITS) + symbols
            total = np.exp(model.log_p(grams, np.full(len(grams), span))).sum()
            assert total == pytest.approx(1, abs=2e-3), (context, span)


def test_an_unseen_symbol_has_what_the_counts_leave(model):
    known = model.tables[1][0]
    unseen = next(s for s in range(1 << BITS) if s not in set(known.tolist()))
    p = float(np.exp(model.log_p(np.array([unseen]), np.array([1]))[0]))
    rest = 1 - np.exp(model.tables[1][1].astype(float)).sum()
    assert p == pytest.approx(rest / ((1 << BITS) - len(known)), rel=1e-3)


def test_a_model_without_texts(spark):
    empty = Model.of(*kneser_ney(count_ngrams(spark.createDataFrame([], "text string"))))
    assert empty.word_scores(["ab"])[0][0] == pytest.approx(-3 * np.log(1 << BITS))


@pytest.fixture(scope="module")
def mixed(spark):
    """Documents of two languages and odd ones; rows of one id, too."""
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choice("abcdeé中") for _ in range(rng.randint(1, 6))) for _ in range(60)), "xy"[i % 2]) for i in range(40)]
    rows += [(90, None, "x"), (91, "", None), (91, "ab cd " * 40, None), (92, "q\x00\x01z 😀 " * 60 + "ß", "y"), (93, "中" * 300, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


def test_every_ngram_is_in_the_model(mixed):
    """N-grams never share a place: the tables have as many as the counts and the orders below them."""
    counts = count_ngrams(mixed)
    tables, _ = kneser_ney(counts)
    for k, rows in tables.items():
        own = counts.where(f"span = {k}").select("gram")
        assert own.exceptAll(rows.select("gram")).isEmpty() and rows.count() == rows.select("gram").distinct().count()


@pytest.mark.parametrize("most", [0, 20, 300])
def test_ngrams_beyond_the_arrays_count_in_full(mixed, most):
    counts = count_ngrams(mixed)
    near, far = split_model(counts, kneser_ney(counts)[0], most)
    assert sum(t.count() for t in near.values()) <= most and far is not None
    assert far.count() + sum(t.count() for t in near.values()) == counts.count()
    want, got = (sorted(judge(mixed, **x).collect(), key=lambda r: (r.doc_id, r.n_words)) for x in ({}, {"most": most}))
    assert len(got) == len(want) == mixed.count()
    for a, b in zip(want, got):
        assert a[:9] == b[:9] and a.log_perplexity == (b.log_perplexity and pytest.approx(b.log_perplexity, rel=1e-9))
    kept = [sorted(keep_good(mixed, **x).collect(), key=str) for x in ({}, {"most": most})]
    assert kept[0] == kept[1] and kept[0]


def test_the_pipeline_keeps_the_same_documents_beyond_the_arrays(spark, mixed, monkeypatch):
    want = sorted(corpus_pipeline.quality_rules(spark, mixed, "").collect(), key=str)
    monkeypatch.setattr(perplexity, "MOST", 20)
    seen = []
    plain = perplexity._with_far
    monkeypatch.setattr(perplexity, "_with_far", lambda *x: seen.append(1) or plain(*x))
    assert sorted(corpus_pipeline.quality_rules(spark, mixed, "").collect(), key=str) == want and want and seen


@pytest.mark.parametrize("text", ["", " \n", "a\x1cb c d \te\x0bf\x0cg\rh", "é ß\n\n€ 中文 😀", "one", "\x00 \x01"])
def test_words(text):
    want = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert words_of(text) == want
    words, at, chars, symbols, lines, repeated = base_figures(text)
    assert [words[i] for i in at] == want and chars == sum(map(len, want))


def test_figures_against_plain_counting():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", " ", "\n", "#", "|", "\t", "é", "a b a b "]) for _ in range(rng.randint(0, 80)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        got = base_figures(text)[2:]
        assert got == (sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
