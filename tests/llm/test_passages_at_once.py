"""What tasks of the passage operator do for many rows at once, against the same one by one."""

import collections
import random

import numpy as np
import pyarrow as pa

from binflow.llm import compact_windows, hashing
from binflow.llm.compact_windows import SAMPLE, _beside_first_packed, _compare_near, _pack, _places, _unpack, _whole_parts, _window_keys, match, match_many, match_plain
from binflow.llm.hashing import WordHashes, shingled, shingles


def test_words_are_hashed_together(monkeypatch):
    rng = random.Random(40)
    letters, blanks = "abXYZäß😀é漢\x00\x7f\x85\xa0\x1c[@`{", [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  "]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17, 40])))
    texts = [None, "", "  ", "a", *(rng.choice(["", " "]).join(["", *(word() + rng.choice(blanks) for _ in range(rng.randrange(40)))]) for _ in range(400)), "", None, "Z"]
    want = [shingles(WordHashes().of(t), 5).tolist() for t in texts]
    # No word is looked up, unless it is long.
    monkeypatch.setattr(WordHashes, "of", None)
    for size in (1 << 17, 100, 1):
        monkeypatch.setattr(hashing, "HASHED_TOGETHER", size)
        for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x y", *texts]).slice(1)):
            assert [x.tolist() for x in shingled(column, 5, WordHashes())] == want
    plain = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": [" ".join(f"w{rng.randrange(10**6)}" for _ in range(90)) for _ in range(50)]})
    assert sum(b.num_rows for b in _window_keys(5, 46, 9, 6)(iter([plain])))


def _near_pair(rng):
    """Two runs without repeats that share most of a stretch, or some of it."""
    core = rng.integers(0, 1 << 40, int(rng.integers(20, 110)))
    other = np.where(rng.random(len(core)) < rng.choice([0, 0.05, 0.1, 0.3]), rng.integers(0, 1 << 40, len(core)), core)
    if rng.random() < 0.3:
        i, j = sorted(rng.integers(0, len(core), 2))
        other = np.concatenate([other[j:], other[:i], other[i:j]])
    pad = lambda: rng.integers(0, 1 << 40, int(rng.integers(1, 50)))
    return [np.concatenate([pad(), x, pad()]) for x in (core, other)]


def test_many_matches_are_those_of_each():
    rng, want, shared = np.random.default_rng(41), [], ([], [], [])
    for k in range(600):
        a, b = (x.tolist() for x in _near_pair(rng))
        at_a, at_b = _places(a), _places(b)
        want.append(match_plain(a, at_a, b, at_b, 46, 0.75))
        assert want[-1] == match(np.array(a), np.array(b), 46, 0.75)
        for x in a:
            if x in at_b:
                for column, value in zip(shared, (k, at_a[x], at_b[x])):
                    column.append(value)
    got = match_many(*map(np.array, shared), len(want), 46, 0.75)
    assert [tuple(g) if g[0] >= 0 else None for g in got.tolist()] == want
    assert 100 < sum(w is not None for w in want) < 500


def test_leaders_meet_all_rows_in_any_order():
    rng, rows, want = np.random.default_rng(42), [], set()
    for key in range(40):
        a, b = _near_pair(rng)
        if key % 4 == 0:  # a run with a repeat
            b = np.append(b, b[0])
        leader = {"id": "a", "l": 1, "lo": 10, "near": a.tolist(), "loose": False}
        for doc, near in (("a", a), ("b", b)):
            rows.append({"key": key, "id": doc, "l": 1, "lo": 10 if doc == "a" else 20, "near": near.tolist(), "loose": len(set(near.tolist())) < len(near), "others": [leader]})
        found = match(b, a, 46, 0.75)
        if found:
            want.add(("b", "a", 20 + found[0], 20 + found[1] + 4, 10 + found[2], 10 + found[3] + 4))
    order = rng.permutation(len(rows))
    for size in (1, 7, 100):
        picked = [rows[i] for i in order]
        batches = [pa.RecordBatch.from_pylist(picked[i : i + size]) for i in range(0, len(picked), size)]
        got = {tuple(r.values()) for b in _compare_near(5, 46, 0.75)(iter(batches)) for r in b.to_pylist()}
        assert got == want and len(want) > 5


def test_packed_rows_beside_the_first_of_their_key(monkeypatch):
    monkeypatch.setattr(compact_windows, "ROWS", 50)
    rng, parts = random.Random(43), 4
    kind = pa.schema([("key", pa.int64()), ("id", pa.string()), ("l", pa.int32()), ("r", pa.int32()), ("a", pa.int32())])
    # Documents are whole in what a task sends; one key is in nearly all of them.
    docs = [f"d{i:02}" for i in rng.sample(range(60), 40)]
    rows = [[(k, d, p, p + 50, p + 3) for k in {0, rng.randrange(1, 50), rng.randrange(-50, 50)} for p in {rng.randrange(5), 7}] for d in docs]
    packed = []
    for i in range(0, len(docs), 8):
        sent = sorted(r for d in rows[i : i + 8] for r in d)
        first = {k: min(r[1] for r in sent if r[0] == k) for k, *_ in sent}
        for later in (False, True):
            by = collections.defaultdict(list)
            for r in sent:
                if (r[1] > first[r[0]]) == later:
                    by[r[0] % 3].append(dict(zip(kind.names, r)))
            packed += [{"bucket": b, "later": later, "rows": _pack(pa.Table.from_pylist(x, kind))} for b, x in by.items()]
    packed.sort(key=lambda p: (p["bucket"], p["later"]))
    want = collections.Counter()
    every = [r for d in rows for r in d]
    for k in {r[0] for r in every}:
        of = min(r[1] for r in every if r[0] == k)
        theirs = tuple(sorted(r[2:] for r in every if r[:2] == (k, of)))
        want.update((*r, of, theirs) for r in every if r[0] == k and r[1] != of)
    for size, large in ((1, 0), (5, 3000), (1000, 1 << 24)):
        monkeypatch.setattr(compact_windows, "LARGE", large)
        batches = [pa.RecordBatch.from_pylist(packed[i : i + size]) for i in range(0, len(packed), size)]
        beside = sorted((r for b in _beside_first_packed(parts)(iter(batches)) for r in b.to_pylist()), key=lambda r: r["part"])
        schema = pa.schema([("part", pa.int32()), ("some", pa.binary()), ("others", pa.binary())])
        whole = [r for b in _whole_parts(iter(pa.Table.from_pylist(beside, schema).to_batches())) for r in b.to_pylist()]
        assert len({r["part"] for r in whole}) == len(whole)
        got = collections.Counter()
        for r in whole:
            for name in ("some", "others"):
                for x in _unpack([r[name]]).to_pylist() if r[name] else []:
                    assert (x["key"] % SAMPLE == 0) == (name == "some") and {x["id"], x["of"]} <= set(r["ids"])
                    got[(*(x[n] for n in kind.names), x["of"], tuple((t["l"], t["r"], t["a"]) for t in x["theirs"]))] += 1
        assert got == want
