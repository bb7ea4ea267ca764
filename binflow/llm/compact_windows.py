"""Substring dedup: near-duplicate passages by compact windows of several min-hash functions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations
from math import isqrt
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binflow.llm.common import WORD, if_small, small_batches
from binflow.llm.hashing import WordHashes, mix64, rows_of, shingled
from binflow.session import materialize

SHINGLE = 5
#: Words of the shortest passage; in shingles it is SHINGLE - 1 less.
PASSAGE = 50
SIMILARITY = 0.75
#: Min-hash functions; those of a line (:func:`lines`) must agree on one pair of subsequences. The README has the recall.
FUNCTIONS = 9
#: Halving steps that look for the ends of a window go up to REACH; with all of them it stops less than MARGIN from its centre.
REACH = 1 << 8
MARGIN = 2 * REACH
#: Shingles of a piece of a long text, and of the texts whose windows a task sends on together; those hashed together are fewer.
PIECE = 1 << 18
TOGETHER = 1 << 16
#: Documents of a key that the others are compared with in a later round: twice as many each round, up to the last.
LEADERS, MOST_LEADERS = 8, 64
#: Shingle values that a task sends on at once.
VALUES = 1_000_000
#: The set of shared keys has a bit for so many characters of text, and at most 2 to the MOST_BITS (64 MB).
CHARS_A_BIT, MOST_BITS = 32, 29
#: Rows of joint keys that a task packs together.
ROWS = 1 << 18
#: Bytes of packed rows that a task looks at together.
LARGE = 1 << 24
#: The square of the number of parts of the joint keys is that of the characters by this: parts and what a task sends to each grow alike.
CHARS_A_SQUARE = 1 << 16
#: Packed parts that go to a task's Python at once, packed rows that tasks have sent, and rows with a text.
PARTS_TOGETHER, PACKED_A_BATCH, TEXTS_A_BATCH = 1, 256, 2000
#: The ends of a passage and of the one that it repeats.
ENDS = ("first_word", "last_word", "of_first_word", "of_last_word")
#: One key in so many finds the passages that most spots of near copies lie in; then all keys are looked at.
SAMPLE = 16


def _mixed(values: np.ndarray, function: int) -> np.ndarray:
    return mix64(values ^ np.uint64((0x9E3779B97F4A7C15 * (function + 1)) & 0xFFFFFFFFFFFFFFFF))


def _minima(levels: list[np.ndarray], at: np.ndarray, side: int) -> np.ndarray:
    """How many positions to one side (-1, 1) of each position hold nothing smaller, found by halving steps."""
    n = len(levels[0])
    here, edge = levels[0][at], at.copy()
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        low = edge - step if side < 0 else edge + 1
        fits = (low >= 0) & (low + step <= n) & (low < len(levels[k]))
        ok = np.flatnonzero(fits)
        # To the left equal values stop the window, to the right they do not: ties go to the first.
        least = levels[k][low[ok]]
        clear = ok[least > here[ok]] if side < 0 else ok[least >= here[ok]]
        edge[clear] += side * step
    return edge


def _levels(hashes: np.ndarray, reach: int) -> list[np.ndarray]:
    """Minima of all runs of 1, 2, 4, ... up to ``reach`` positions."""
    levels, n = [hashes], len(hashes)
    while (1 << len(levels)) <= min(n, reach):
        k = len(levels)
        levels.append(np.minimum(levels[-1][: n - (1 << k) + 1], levels[-1][(1 << (k - 1)) : n - (1 << (k - 1)) + 1]))
    return levels


def _centres(levels: list[np.ndarray], least: int) -> np.ndarray:
    """Positions of the minima of the runs of ``least`` positions."""
    hashes, n, k = levels[0], len(levels[0]), least.bit_length() - 1
    lows = np.minimum(levels[k][: n - least + 1], levels[k][least - (1 << k) : n - (1 << k) + 1])
    # Each minimum of a run, once: a smaller one has just come in at the end; where the last one was left behind, look for the next.
    fall = np.flatnonzero(lows[1:] < lows[:-1]) + least
    at = np.concatenate([[0], np.flatnonzero(lows[1:] > lows[:-1]) + 1])
    low = lows[at]
    for j in range(k, -1, -1):
        # The first of its kind is in the first half of what is left, unless that half holds larger ones only.
        inside = at < len(levels[j])
        at += (inside & (levels[j][np.where(inside, at, 0)] > low)) << j
    centre = np.zeros(n, bool)
    centre[fall] = centre[at] = True
    return np.flatnonzero(centre)


def _spread(levels: list[np.ndarray], centres: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left, right = _minima(levels, centres, -1), _minima(levels, centres, 1)
    wide = right - left + 1 >= least
    return left[wide], centres[wide], right[wide]


def compact_windows(hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of the nodes of the Cartesian tree over the hashes that span at least ``least`` positions.

    A node is the first minimum of all subsequences that hold it inside its span, so
    these share its hash as their signature. A node spans ``least`` positions
    if it is the minimum of some run of that length, so only those minima are
    looked up; spans stop REACH positions from their centre.
    """
    if len(hashes) < least:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    levels = _levels(hashes, max(REACH, least))
    return _spread(levels, _centres(levels, least), least)


def lines(functions: int) -> list[tuple[int, int, int]]:
    """Triples of functions: the lines of the plane of three by three points, of those of its points that are used.

    Two points lie on one line. Of the nine functions any five hold a line, and so do 72 of
    the 126 choices of four; all triples would be seven times as many keys.
    """
    return [t for t in combinations(range(functions), 3) if sum(t) % 3 == 0 and sum(f // 3 for f in t) % 3 == 0]


class SharedKeys:
    """Keys that two documents have, as bits; it may hold more keys, never fewer."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (8 * len(bits)).bit_length() + 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> self.shift
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _shingled(batches: Iterator[pa.RecordBatch], n: int, memo: WordHashes, text: str = "text") -> Iterator[tuple]:
    """(id, shingles of the text) of each row."""
    for batch in batches:
        ids, texts = (batch.column(batch.schema.get_field_index(x)) for x in ("id", text))
        yield from zip(ids.to_pylist(), shingled(texts, n, memo))


def _documents(batches: Iterator[pa.RecordBatch], n: int, least: int) -> Iterator[tuple[list, list]]:
    """Texts as pieces of shingles: (ids, pieces (shingles, start, first, last, number of the id)), whole documents only.

    Pieces of a long text overlap by MARGIN on both sides; each position in [first, last) belongs to one of them.
    """
    memo, parts, ids, size = WordHashes(), [], [], 0
    for doc, tokens in _shingled(batches, n, memo):
        if len(tokens) < least:
            continue
        for start in range(0, max(1, len(tokens) - 2 * MARGIN), PIECE - 2 * MARGIN):
            piece = tokens[start : start + PIECE]
            end = start + PIECE >= len(tokens)
            if len(piece) >= least:
                parts.append((piece, start, start + MARGIN if start else 0, len(tokens) if end else start + PIECE - MARGIN, len(ids)))
                size += len(piece)
            if end:
                break
        ids.append(doc)
        if size >= PIECE:
            yield ids, parts
            parts, ids, size = [], [], 0
    if parts:
        yield ids, parts


def _nodes(parts: list, least: int, functions: int, shared: SharedKeys | None = None, spans: bool = True) -> list[np.ndarray]:
    """Windows of pieces as columns (key, number of the document, f, c, l, r); only those of ``shared`` keys.

    Pieces are hashed as one array, each followed by a zero that no window crosses. Without ``spans`` the last
    two columns are empty, and a centre whose window is too narrow for equal hashes beside it counts too.
    """
    columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
    gap, begin = np.zeros(1, np.uint64), 0
    while begin < len(parts):
        end, size = begin, 0
        while end < len(parts) and (end == begin or size + len(parts[end][0]) <= TOGETHER):
            size += len(parts[end][0])
            end += 1
        chunk, begin = parts[begin:end], end
        tokens = np.concatenate([x for p in chunk for x in (p[0], gap)])
        ends = np.cumsum([len(p[0]) + 1 for p in chunk])
        start, first, last, number = (np.array([p[i] for p in chunk], np.int64) for i in (1, 2, 3, 4))
        shifts = start - np.concatenate([[0], ends[:-1]])
        for f in range(functions):
            hashes = _mixed(tokens, f)
            hashes[ends - 1] = 0
            levels = _levels(hashes, max(REACH, least) if spans else least)
            c = _centres(levels, least)
            key = _mixed(tokens[c], f + 101)
            if shared is not None:
                held = shared.has(key)
                c, key = c[held], key[held]
            part = np.searchsorted(ends, c, "right")
            at = c + shifts[part]
            own = (c != ends[part] - 1) & (at >= first[part]) & (at < last[part])
            c, key, part = c[own], key[own], part[own]
            lo = hi = np.zeros(0, np.int64)
            if spans:
                lo, wide, hi = _spread(levels, c, least)
                kept = np.isin(c, wide, assume_unique=True)
                c, key, part = wide, key[kept], part[kept]
                lo, hi = lo + shifts[part], hi + shifts[part]
            for column, values in zip(columns, (key, number[part], np.full(len(c), f), c + shifts[part], lo, hi)):
                column.append(values)
    return [np.concatenate(c) for c in columns]


def _windows(n: int, least: int, functions: int):
    """Rows (id, text) to (key, id, f, c, l, r): key is the shingle at the centre under function f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, parts in _documents(batches, n, least):
            key, number, *places = _nodes(parts, least, functions)
            columns = [pa.array(key.view(np.int64)), pa.array(ids).take(pa.array(number)), *(pa.array(x.astype(np.int32)) for x in places)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "id", "f", "c", "l", "r"])

    return run


def _window_keys(n: int, least: int, functions: int, bucket_bits: int):
    """Rows (id, text) to (bucket, keys): 32 bits of each window's key after those of the bucket, twice if two documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            # Of a key that many of these documents have, two tell as much.
            keys = keys[np.concatenate([np.ones(min(2, len(keys)), bool), keys[2:] != keys[:-2]])]
            cuts = np.searchsorted(keys >> np.uint64(64 - bucket_bits), np.arange((1 << bucket_bits) + 1, dtype=np.uint64))
            low = (keys >> np.uint64(32 - bucket_bits)).astype(np.uint32)
            full = [b for b in range(1 << bucket_bits) if cuts[b] < cuts[b + 1]]
            packed = [low[cuts[b] : cuts[b + 1]].tobytes() for b in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "keys"])

        for _, parts in _documents(batches, n, least):
            key, number, *_ = _nodes(parts, least, functions, spans=False)
            order = np.lexsort((number, key))
            key, number = key[order], number[order]
            held.append(key[np.concatenate([[True], (key[1:] != key[:-1]) | (number[1:] != number[:-1])])])
            size += len(held[-1])
            if size >= VALUES:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    return run


def shared_keys(texts: DataFrame, chars: int, least: int, functions: int) -> SharedKeys:
    """Keys of windows that more than one document of (id, text) has, ``chars`` characters in all.

    Tasks send 32 bits a key by bucket; a bucket's task sends its bits of the set. So the driver gets a
    bit for CHARS_A_BIT characters, 64 MB at most; a set that is too full lets more windows pass, and
    those that no other document has meet nobody.
    """
    bits = min(MOST_BITS, max(16, (chars // CHARS_A_BIT).bit_length()))
    bucket_bits = min(13, bits - 3, max(6, (chars >> 22).bit_length()))
    inner = bits - bucket_bits

    def seen_twice(table: pa.Table) -> pa.Table:
        keys = np.sort(np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32))
        marks = np.zeros(1 << inner, np.uint8)
        marks[keys[1:][keys[1:] == keys[:-1]] >> np.uint32(32 - inner)] = 1
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": [np.packbits(marks, bitorder="little").tobytes()]})

    keys = texts.mapInArrow(_window_keys(SHINGLE, least, functions, bucket_bits), "bucket int, keys binary")
    found = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (inner - 3)
    for bucket, part in keys.groupBy("bucket").applyInArrow(seen_twice, "bucket int, bits binary").collect():
        found[bucket * size : (bucket + 1) * size] = np.frombuffer(bytes(part), np.uint8)
    return SharedKeys(found)


def _meet(doc: np.ndarray, key: np.ndarray, f: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int, functions: int) -> list[np.ndarray]:
    """Columns (key, number of the document, l, r, a): runs in which windows of the functions of a line meet.

    A window is the signature of the runs of ``least`` shingles that start in [s, e]; for one
    function these intervals do not overlap, so at most one window of each other
    function is open where a window begins, and each line through its function
    gives one key at most. ``a`` is the first centre, by which two documents are laid
    on each other.
    """
    s, e = np.maximum(lo, c - least + 1), np.minimum(c, hi - least + 1)
    at = (doc << 32) | s
    of = [np.flatnonzero(f == g) for g in range(functions)]
    of = [i[np.argsort(at[i], kind="stable")] for i in of]

    def open_at(i: np.ndarray, function: int, other: int) -> np.ndarray:
        """The window of another function that is open where each of ``i`` begins, or -1; equal starts count for the later function."""
        if not len(of[other]):
            return np.full(len(i), -1)
        j = np.searchsorted(at[of[other]], at[i], "right") - 1
        w = of[other][np.maximum(j, 0)]
        held = (j >= 0) & (doc[w] == doc[i]) & (e[w] >= s[i])
        if other > function:
            held &= s[w] < s[i]
        return np.where(held, w, -1)

    found: list[tuple] = []
    for last in range(functions):
        through = [t for t in lines(functions) if last in t]
        open_ = {g: open_at(of[last], last, g) for g in {g for t in through for g in t} - {last}}
        for line in through:
            all_ = np.stack([of[last] if g == last else open_[g] for g in line])
            all_ = all_[:, (all_ >= 0).all(axis=0)]
            joint = key[all_[0]]
            for w in all_[1:]:
                joint = joint * np.uint64(0x100000001B3) + key[w]
            # Lines are told apart, so that three functions never meet three others.
            joint = mix64(joint + np.uint64(line[0] * 100 + line[1] * 10 + line[2]))
            begin = s[all_].max(axis=0)
            found.append((joint.view(np.int64), doc[all_[0]], begin, e[all_].min(axis=0) + least - 1, c[all_].min(axis=0)))
    return [np.concatenate(x) for x in zip(*found)]


def _joint(least: int, functions: int):
    """Rows (id, windows) to (key, id, l, r, a): the runs of :func:`_meet`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("windows"))
            doc = np.repeat(np.arange(len(lists), dtype=np.int64), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            key, f, c, lo, hi = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("key", "f", "c", "l", "r"))
            places = (x.astype(np.int64) for x in (c, lo, hi))
            yield _joint_rows(batch.column(batch.schema.get_field_index("id")), _meet(doc, key.view(np.uint64), f, *places, least, functions))

    return run


def _joint_rows(ids: pa.Array, columns: list[np.ndarray]) -> pa.RecordBatch:
    joint, owner, *places = columns
    arrays = [pa.array(joint), ids.take(pa.array(owner)), *(pa.array(x.astype(np.int32)) for x in places)]
    return pa.RecordBatch.from_arrays(arrays, ["key", "id", "l", "r", "a"])


def _pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpack(packed: list[bytes]) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in packed).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    """A column of :func:`_unpack` as one array."""
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _ranks(*columns: pa.Array) -> list[np.ndarray]:
    """The values of some columns of one type as numbers of the same order."""
    codes = pa.concat_arrays(columns).dictionary_encode()
    rank = np.empty(len(codes.dictionary), np.int64)
    rank[pc.sort_indices(codes.dictionary).to_numpy()] = np.arange(len(rank))
    numbers = rank[codes.indices.to_numpy(zero_copy_only=False)]
    return np.split(numbers, np.cumsum([len(c) for c in columns])[:-1])


def _part(ids: pa.Array, parts: int) -> np.ndarray:
    """The number of the part, out of ``parts``, that the rows of an id go to."""
    codes = ids.dictionary_encode()
    if pa.types.is_integer(ids.type):
        hashes = mix64(codes.dictionary.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64))
    else:
        hashes = np.array([xxhash.xxh3_64_intdigest(str(x).encode("utf-8", "replace")) for x in codes.dictionary.to_pylist()], np.uint64)
    return (hashes % np.uint64(parts)).astype(np.int32)[codes.indices.to_numpy(zero_copy_only=False)]


def _in_order(rows: pa.Table) -> pa.Table:
    """Rows (key, id, l, r, a) by key, id and place; under one key a document has one place that begins at ``l``."""
    (rank,), key, l = _ranks(_column(rows, "id")), _column(rows, "key").to_numpy(), _column(rows, "l").to_numpy().astype(np.int64)
    rank_bits, l_bits = (int(x.max(initial=0)).bit_length() for x in (rank, l))
    place = (rank << l_bits) | l
    order = np.argsort(key)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(np.concatenate([[False], key[order][1:] != key[order][:-1]])[: len(key)])
    if len(key).bit_length() + rank_bits + l_bits < 63:
        order = np.argsort((number << (rank_bits + l_bits)) | place)
    else:
        order = np.lexsort((place, number))
    return rows.take(pa.array(order))


def _joint_of_texts(n: int, least: int, functions: int, shared, parts: int):
    """Rows (id, text) to packed rows (key, id, l, r, a), from the windows whose key is in the broadcast set.

    They go by ``bucket`` of the key; apart go the ``later`` ones, those of keys that a smaller id has among the
    rows that the task sends together. So the first document of a key is among few rows, however many have the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            key, (rank,) = _column(rows, "key").to_numpy(), _ranks(_column(rows, "id"))
            order = np.argsort(key)
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            least_rank = np.repeat(np.minimum.reduceat(rank[order], first), np.diff(np.append(first, len(key))))
            group = 2 * (key[order].view(np.uint64) % np.uint64(parts)).astype(np.int64) + (rank[order] > least_rank)
            by = np.argsort(group.astype(np.int16) if 2 * parts < 1 << 15 else group, kind="stable")
            rows, group = rows.take(pa.array(order[by])), group[by]
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            packed = [_pack(rows.slice(i, j - i)) for i, j in zip(begin.tolist(), np.append(begin[1:], len(group)).tolist())]
            which = group[begin]
            columns = [pa.array((which // 2).astype(np.int32)), pa.array(which % 2 == 1), pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "later", "rows"])

        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field("id").type
        for ids, pieces in _documents(chain([first], batches), n, least):
            key, number, *places = _nodes(pieces, least, functions, SharedKeys(shared.value))
            found = _joint_rows(pa.array(ids, kind), _meet(number, key, *places, least, functions))
            if found.num_rows:
                held.append(found)
                size += found.num_rows
            if size >= ROWS:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    return run


def _beside_first_packed(parts: int):
    """Packed rows (bucket, later, rows), those of a bucket in order, to (part, some, others): packed rows of :func:`_beside_first`.

    ``part`` is that of the id. ``some`` has the rows of one key in SAMPLE, ``others`` the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []
        size = 0

        def keep(rows: pa.Table) -> None:
            nonlocal size
            for found in _beside_first(iter(rows.combine_chunks().to_batches())):
                done.append(found)
                size += found.num_rows

        def several(rows: pa.Table) -> pa.Table:
            """Without the keys that have one row."""
            key = _column(rows, "key").to_numpy()
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            again = np.zeros(len(key), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            return rows.filter(pa.array(again))

        def firsts(rows: pa.Table) -> pa.Table:
            """The rows of the first document of each key; ``rows`` are in order."""
            key, (rank,) = _column(rows, "key").to_numpy(), _ranks(_column(rows, "id"))
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            return rows.filter(pa.array(rank == np.repeat(rank[begin], np.diff(np.append(begin, len(key))))))

        def send() -> pa.RecordBatch:
            rows = pa.Table.from_batches(done).combine_chunks()
            some = (_column(rows, "key").to_numpy() & (SAMPLE - 1)) == 0
            group = 2 * _part(_column(rows, "id"), parts).astype(np.int64) + some
            order = np.argsort(group, kind="stable")
            rows, group = rows.take(pa.array(order)), group[order]
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            packed = [_pack(rows.slice(i, j - i)) for i, j in zip(begin.tolist(), np.append(begin[1:], len(group)).tolist())]
            which = group[begin]
            columns = [pa.array((which // 2).astype(np.int32)), *(pa.array([p if w % 2 == x else None for p, w in zip(packed, which)], pa.binary()) for x in (1, 0))]
            return pa.RecordBatch.from_arrays(columns, ["part", "some", "others"])

        def of_firsts(first: pa.Table, keys: np.ndarray, packed: list[bytes]) -> None:
            """Rows of keys that are all among the first ones."""
            more = _unpack(packed)
            at = _found(keys, np.unique(_column(more, "key").to_numpy()))[1]
            keep(_in_order(pa.concat_tables([first.filter(pa.array(at)), more]).combine_chunks()))

        bucket, waiting, first, held = None, [], None, 0

        def finish() -> None:
            if first is not None:
                of_firsts(*first, waiting)
            elif waiting:
                keep(_in_order(several(_unpack(waiting))))

        for b, later, rows in rows_of(batches, "bucket", "later", "rows"):
            if b != bucket:
                finish()
                bucket, waiting, first, held = b, [], None, 0
            if later and held + len(rows) > LARGE:
                # The first documents stay, the others go on in lots.
                if first is None:
                    whole = _in_order(_unpack(waiting))
                    keep(whole)
                    first = firsts(whole)
                    first = (first, _column(first, "key").to_numpy())
                else:
                    of_firsts(*first, waiting)
                waiting, held = [], 0
            waiting.append(rows)
            held += len(rows)
            if size >= ROWS:
                yield send()
                done, size = [], 0
        finish()
        if size:
            yield send()

    return run


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows (part, some, others), those of a part in order, to one row a part, with the ``ids`` of its documents."""
    last, held = None, ([], [])

    def send() -> pa.RecordBatch:
        rows = [_unpack(x) if x else None for x in held]
        ids = pc.unique(pa.concat_arrays([_column(r, c) for r in rows if r is not None for c in ("id", "of")]))
        packed = [pa.array([None if r is None else _pack(r)], pa.binary()) for r in rows]
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), *packed, lists], ["part", "some", "others", "ids"])

    for part, *packed in rows_of(batches, "part", "some", "others"):
        if part != last and last is not None:
            yield send()
            held = ([], [])
        last = part
        for x, y in zip(held, packed):
            if y:
                x.append(y)
    if last is not None:
        yield send()


def _within(group: np.ndarray, spans: list[np.ndarray], of: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """Whether a span of its group holds each place: ``group`` of each span, in order, and ``of`` each place; ends of spans in turn."""
    count = np.bincount(group, minlength=int(of.max(initial=0)) + 1)
    start = np.cumsum(count) - count
    inside, rows, k = np.zeros(len(of), bool), np.flatnonzero(count[of] > 0), 0
    while len(rows):
        i = start[of[rows]] + k
        hit = np.ones(len(rows), bool)
        for x, (low, high) in zip(at, zip(spans[::2], spans[1::2])):
            hit &= (x[rows] >= low[i]) & (x[rows] <= high[i])
        inside[rows[hit]] = True
        k += 1
        rows = rows[~hit & (count[of[rows]] > k)]
    return inside


def _spots(with_known: bool):
    """Packed rows of each part to (id, of, spots, known): the places of each pair, those of ``some`` keys.

    Or, given the passages ``known`` of the part, those of all keys that these do not cover.
    """
    empty = pa.list_(pa.struct([(x, pa.int32()) for x in ("first_word", "last_word", "of_first_word", "of_last_word")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, packed in enumerate(rows_of(iter([batch]), *(("some", "others") if with_known else ("some",)))):
                packed = [x for x in packed if x]
                if not packed:
                    continue
                rows = _unpack(packed)
                ids, ofs = _column(rows, "id"), _column(rows, "of")
                spans = batch.column("known").slice(row, 1).flatten() if with_known else pa.array([], pa.struct([("id", ids.type), ("of", ids.type)]))
                rank, of_rank, k_rank, k_of = _ranks(ids, ofs, *(spans.field(x).cast(ids.type) for x in ("id", "of")))
                size = int(max(of_rank.max(initial=0), k_of.max(initial=0), rank.max(initial=0))) + 1
                pair, pair_of_known = np.split(np.unique(np.concatenate([rank * size + of_rank, k_rank * size + k_of]), return_inverse=True)[1], [len(rank)])
                l, r, a = (_column(rows, x).to_numpy().astype(np.int64) for x in ("l", "r", "a"))
                cuts, theirs = _lists(_column(rows, "theirs"))
                ta = theirs.field("a").to_numpy().astype(np.int64)
                keep = np.ones(len(pair), bool)
                by = np.argsort(pair_of_known, kind="stable")
                if with_known and len(by):
                    a0, a1, b0, b1 = (x[by] for x in _ints(spans, "first_word", "last_word", "of_first_word", "of_last_word"))
                    owner = np.repeat(np.arange(len(pair)), np.diff(cuts))
                    inside = _within(pair_of_known[by], [a0, a1 - (SHINGLE - 1), b0, b1 - (SHINGLE - 1)], pair[owner], [a[owner], ta])
                    keep[:] = False
                    keep[owner[~inside]] = True
                chosen = np.flatnonzero(keep)
                chosen = chosen[np.lexsort((ta[cuts[:-1]][chosen], a[chosen], -r[chosen], l[chosen], pair[chosen]))]
                if not len(chosen):
                    continue
                # Under many keys a pair has the same places.
                same = np.ones(len(chosen), bool)
                same[0] = False
                for x in (pair, l, r, a, *(theirs.field(x).to_numpy()[cuts[:-1]] for x in ("l", "r", "a"))):
                    same[1:] &= x[chosen][1:] == x[chosen][:-1]
                one = np.diff(cuts)[chosen] == 1
                same[1:] &= one[1:] & one[:-1]
                chosen = chosen[~same]
                begin = np.flatnonzero(np.concatenate([[True], pair[chosen][1:] != pair[chosen][:-1]]))
                picked = rows.take(pa.array(chosen))
                mine = pa.StructArray.from_arrays([_column(picked, x) for x in ("l", "r", "a")], ["l", "r", "a"])
                spots = pa.StructArray.from_arrays([mine, _column(picked, "theirs")], ["mine", "theirs"])
                ends = np.append(begin, len(chosen))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spots)
                known = pa.array([[]] * len(begin), empty)
                if with_known and len(by):
                    group = pair_of_known[by]
                    i, j = (np.searchsorted(group, pair[chosen][begin], side) for side in ("left", "right"))
                    at = np.repeat(i - np.cumsum(j - i) + (j - i), j - i) + np.arange((j - i).sum())
                    plain = pa.StructArray.from_arrays([spans.field(f.name).take(pa.array(by[at])) for f in empty.value_type], names=[f.name for f in empty.value_type])
                    known = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(j - i)]), pa.int32()), plain)
                heads = pa.array(begin)
                yield pa.RecordBatch.from_arrays([_column(picked, "id").take(heads), _column(picked, "of").take(heads), lists, known], ["id", "of", "spots", "known"])

    return run


def _settled_rows(keys_only: bool, wanted=None):
    """Packed rows of each part, with the passages ``sides`` of its documents, to rows (key, id, l, r, a, of, at, open).

    A row is ``open`` if no passage of its document covers its centre; ``at`` is the first place of the other
    document. Or ``keys_only``, of open rows; or the rows of the ``wanted`` keys, a broadcast array in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (some, others) in enumerate(rows_of(iter([batch]), "some", "others")):
                rows = _unpack([x for x in (some, others) if x])
                if wanted is not None:
                    if not len(wanted.value):
                        continue
                    rows = rows.filter(pa.array(_found(_column(rows, "key").to_numpy(), wanted.value)[1])).combine_chunks()
                if not rows.num_rows:
                    continue
                spans, ids = batch.column("sides").slice(row, 1).flatten(), _column(rows, "id")
                opened = np.ones(rows.num_rows, bool)
                if len(spans):
                    rank, owner = _ranks(ids, spans.field("id").cast(ids.type))
                    by = np.argsort(owner, kind="stable")
                    low, high = (x[by] for x in _ints(spans, "first_word", "last_word"))
                    opened = ~_within(owner[by], [low, high], rank, [_column(rows, "a").to_numpy()])
                if keys_only:
                    yield pa.RecordBatch.from_arrays([pc.unique(_column(rows, "key").filter(pa.array(opened)))], ["key"])
                    continue
                cuts, theirs = _lists(_column(rows, "theirs"))
                at = theirs.field("a").take(pa.array(cuts[:-1]))
                columns = [_column(rows, x) for x in ("key", "id", "l", "r", "a", "of")]
                yield pa.RecordBatch.from_arrays([*columns, at, pa.array(opened)], ["key", "id", "l", "r", "a", "of", "at", "open"])

    return run


def _beside_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, l, r, a), in order, to (key, id, l, r, a, of, theirs): those of other documents than the first of their key.

    ``theirs`` are the places of the first. Only these go on from batch to batch, so a key of very many documents is no burden.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key, id_, *places = (batch.column(i) for i in range(5))
        keys, codes = key.to_numpy(zero_copy_only=False), id_.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        is_first = codes == codes[start][group]
        firsts = np.bincount(group[is_first])
        held = batch.slice(start[-1], firsts[-1])
        rows = np.flatnonzero(~is_first)
        begin, many = start[group[rows]], firsts[group[rows]]
        ends = np.cumsum(many)
        at = pa.array(np.repeat(begin - ends + many, many) + np.arange(many.sum()))
        theirs = pa.StructArray.from_arrays([p.take(at) for p in places], ["l", "r", "a"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), theirs)
        columns = [c.take(pa.array(rows)) for c in (key, id_, *places)]
        yield pa.RecordBatch.from_arrays([*columns, id_.take(pa.array(begin)), lists], ["key", "id", "l", "r", "a", "of", "theirs"])


def match(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> tuple[int, int, int, int] | None:
    """The passage that two runs of shingles share: ends in ``a`` and in ``b`` (both inclusive), or None.

    It goes from the first to the last shingle of each run that the other has, and
    counts if both sides are ``least`` long and their sets are similar enough;
    else each end that holds the longer foreign stretch is cut back, and so on.
    """
    in_a, in_b = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    while len(in_a) and len(in_b):
        a0, a1, b0, b1 = in_a[0], in_a[-1], in_b[0], in_b[-1]
        if a1 - a0 + 1 < least or b1 - b0 + 1 < least:
            return None
        x, y = np.unique(a[a0 : a1 + 1]), np.unique(b[b0 : b1 + 1])
        same = len(np.intersect1d(x, y, assume_unique=True))
        if same >= similarity * (len(x) + len(y) - same):
            return int(a0), int(a1), int(b0), int(b1)
        # Cut at the widest gap between shared shingles of the side with more foreign ones; keep the longer part.
        own = in_a if len(x) >= len(y) else in_b
        gaps = np.diff(own)
        if not len(gaps) or gaps.max() == 1:
            return None
        cut = int(gaps.argmax())
        keep = own[: cut + 1] if own[cut] - own[0] >= own[-1] - own[cut + 1] else own[cut + 1 :]
        if own is in_a:
            in_a = keep
            part = np.isin(b, a[keep[0] : keep[-1] + 1])
            in_b = in_b[part[in_b]]
        else:
            in_b = keep
            part = np.isin(a, b[keep[0] : keep[-1] + 1])
            in_a = in_a[part[in_a]]
    return None


def match_plain(
    a: list[int], at_a: dict[int, int], b: list[int], at_b: dict[int, int], least: int, similarity: float
) -> tuple[int, int, int, int] | None:
    """:func:`match` of two short runs without repeats, given the position of each of their shingles."""
    in_a = [at_a[x] for x in a if x in at_b]
    if not in_a or in_a[-1] - in_a[0] + 1 < least:
        return None
    in_b = [at_b[x] for x in b if x in at_a]
    while True:
        a0, a1, b0, b1, same = in_a[0], in_a[-1], in_b[0], in_b[-1], len(in_a)
        x, y = a1 - a0 + 1, b1 - b0 + 1
        if x < least or y < least:
            return None
        if same >= similarity * (x + y - same):
            return a0, a1, b0, b1
        own = in_a if x >= y else in_b
        gaps = list(map(sub, own[1:], own))
        widest = max(gaps, default=1)
        if widest == 1:
            return None
        cut = gaps.index(widest)
        keep = own[: cut + 1] if own[cut] - own[0] >= own[-1] - own[cut + 1] else own[cut + 1 :]
        if keep[-1] - keep[0] + 1 < least:
            return None
        if own is in_a:
            in_a, in_b = keep, sorted([at_b[a[i]] for i in keep])
        else:
            in_a, in_b = sorted([at_a[b[i]] for i in keep]), keep


def match_many(pair: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, pairs: int, least: int, similarity: float) -> np.ndarray:
    """:func:`match_plain` of many pairs of runs at once: rows (ends in a, ends in b), -1 where there is no passage.

    Each value that the runs of a pair share is given by the pair, its position in the one and in the other run; pairs in order.
    """
    spans = np.full((pairs, 4), -1, np.int64)
    while len(pair):
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        same = np.diff(np.append(first, len(pair)))
        a0, a1, b0, b1 = (g.reduceat(at, first) for at in (at_a, at_b) for g in (np.minimum, np.maximum))
        x, y = a1 - a0 + 1, b1 - b0 + 1
        wide = (x >= least) & (y >= least)
        good = wide & (same >= similarity * (x + y - same))
        spans[pair[first[good]]] = np.stack([a0, a1, b0, b1], axis=1)[good]
        # The others are cut at the widest gap of their longer side.
        go = wide & ~good
        here = np.repeat(go, same)
        pair, at_a, at_b, same = pair[here], at_a[here], at_b[here], same[go]
        if not len(pair):
            break
        own = np.where(np.repeat((x >= y)[go], same), at_a, at_b)
        order = np.argsort((pair << 32) | own)
        pair, at_a, at_b, own = pair[order], at_a[order], at_b[order], own[order]
        first = np.concatenate([[0], np.cumsum(same)[:-1]])
        last = first + same - 1
        gap = np.append(own[1:], 0) - own
        gap[last] = 0
        widest = np.maximum.reduceat(gap, first)
        place = np.arange(len(pair))
        cut = np.minimum.reduceat(np.where(gap == np.repeat(widest, same), place, len(pair)), first)
        left = own[cut] - own[first] >= own[last] - own[np.minimum(cut + 1, last)]
        keep = ((place <= np.repeat(cut, same)) == np.repeat(left, same)) & np.repeat(widest > 1, same)
        pair, at_a, at_b = pair[keep], at_a[keep], at_b[keep]
    return spans


def _places(run: list[int]) -> dict[int, int]:
    return {x: i for i, x in enumerate(run)}


def _match(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> tuple[int, int, int, int] | None:
    """:func:`match`, the quick way where no shingle repeats."""
    plain_a, plain_b = a.tolist(), b.tolist()
    at_a, at_b = _places(plain_a), _places(plain_b)
    if len(at_a) == len(a) and len(at_b) == len(b):
        return match_plain(plain_a, at_a, plain_b, at_b, least, similarity)
    return match(a, b, least, similarity)


def _onward(same: np.ndarray, share: float) -> int:
    """The longest beginning that ends with an equal position and of which ``share`` is equal."""
    upto = np.cumsum(same)
    good = np.flatnonzero(same & (upto >= share * np.arange(1, len(same) + 1)))
    return int(good[-1]) + 1 if len(good) else 0


def _distinct(a: np.ndarray) -> np.ndarray:
    """The values in order, each once."""
    x = np.sort(a)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _both(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two arrays without repeats have in common."""
    z = np.sort(np.concatenate([x, y]))
    return int(np.count_nonzero(z[1:] == z[:-1]))


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    x, y = _distinct(a), _distinct(b)
    same = _both(x, y)
    return same / max(1, len(x) + len(y) - same)


def _held_by_both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions in ``a`` and in ``b`` of the values that both have, and whether neither has any value twice."""
    both = np.concatenate([a, b])
    order = np.argsort(both)
    values = both[order]
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    of_b = order >= len(a)
    size = np.diff(np.append(begin, len(values)))
    in_b = np.add.reduceat(of_b, begin, dtype=np.int64) if len(begin) else begin
    held = np.zeros(len(values), bool)
    held[order] = np.repeat((in_b > 0) & (in_b < size), size)
    plain = bool((in_b <= 1).all() and (size - in_b <= 1).all())
    return np.flatnonzero(held[: len(a)]), np.flatnonzero(held[len(a) :]), plain


def _further(a: np.ndarray, b: np.ndarray, share: float) -> int:
    """How far two runs go on together from their beginnings; looks on only where they do."""
    n, size = min(len(a), len(b)), 1 << 10
    while True:
        reach = _onward(a[: min(n, size)] == b[: min(n, size)], share)
        if size >= n or reach < size // 2:
            return reach
        size *= 4


def extend(a: np.ndarray, b: np.ndarray, span: tuple[int, int, int, int], similarity: float) -> tuple[int, int, int, int]:
    """A passage that two texts share (ends inclusive), lengthened at both ends as far as the texts go on alike.

    First over replaced words, where the sets stay similar enough; else over equal shingles only,
    which leaves no set less similar.
    """
    a0, a1, b0, b1 = span
    for share in (2 * similarity / (1 + similarity), 1.0):
        on = _further(a[a1 + 1 :], b[b1 + 1 :], share)
        back = _further(a[:a0][::-1], b[:b0][::-1], share)
        wide = (a0 - back, a1 + on, b0 - back, b1 + on)
        if share == 1.0 or _jaccard(a[wide[0] : wide[1] + 1], b[wide[2] : wide[3] + 1]) >= similarity:
            return wide
    return span


def merge(a: np.ndarray, b: np.ndarray, spans: list[tuple[int, int, int, int]], similarity: float) -> list[tuple[int, int, int, int]]:
    """Passages of two texts that overlap in both become one where it is similar enough as a whole."""
    done: list[tuple[int, int, int, int]] = []
    for s in sorted(set(spans)):
        for i in range(len(done) - 1, -1, -1):
            d = done[i]
            if s[0] <= d[1] + 1 and s[2] <= d[3] + 1 and d[2] <= s[3] + 1:
                whole = (d[0], max(d[1], s[1]), min(d[2], s[2]), max(d[3], s[3]))
                if whole == d or _jaccard(a[whole[0] : whole[1] + 1], b[whole[2] : whole[3] + 1]) >= similarity:
                    done[i] = whole
                    break
        else:
            done.append(s)
    return done


def _spans(at: np.ndarray, start: int, end: int, least: int, fewest: float = 1) -> bool:
    """Whether there are ``fewest`` of the sorted positions in [start, end) and the first and the last of them span ``least``."""
    i, j = at.searchsorted(start), at.searchsorted(end)
    return bool(j - i >= fewest and at[j - 1] - at[i] + 1 >= least)


def _lists(column: pa.Array) -> tuple[list[int], pa.Array]:
    """Where each list of a column begins and ends in the values of all."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]), column.flatten()


def _ints(values: pa.Array, *names: str) -> list[np.ndarray]:
    """Fields of a column of structs."""
    return [values.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names]


def _laid(spots: pa.Array) -> Iterator[list[tuple]]:
    """Of each row every place of the one document with every place of the other, key by key; long and early places first.

    Each is (a, back, on, b, back, on): the two centres, and how far the windows reach to both sides of them.
    """
    cuts, flat = _lists(spots)
    l, r, a = _ints(flat.field("mine"), "l", "r", "a")
    inner, theirs = _lists(flat.field("theirs"))
    tl, tr, ta = _ints(theirs, "l", "r", "a")
    row = np.repeat(np.arange(len(spots)), np.diff(cuts))
    order = np.lexsort((a, -r, l, row))
    many = np.diff(inner)[order]
    ends = np.cumsum(many)
    mine, other = np.repeat(order, many), np.repeat(inner[:-1][order] - ends + many, many) + np.arange(many.sum())
    a, ta = a[mine], ta[other]
    columns = (a, a - l[mine], r[mine] - a, ta, ta - tl[other], tr[other] - ta)
    begin = np.concatenate([[0], ends])[cuts].tolist()
    for i, j in zip(begin[:-1], begin[1:]):
        yield list(zip(*(x[i:j].tolist() for x in columns)))


def _passages(ids: list, ofs: list, rows: list, kind: pa.DataType, parts: int | None = None) -> pa.RecordBatch:
    names = ["first_word", "last_word", "of_first_word", "of_last_word"]
    both, columns = [pa.array(ids, kind), pa.array(ofs, kind)], [pa.array([r[i] for r in rows], pa.int32()) for i in range(4)]
    if parts:
        names += ["part", "of_part"]
        columns += [pa.array(_part(x, parts)) for x in both]
    return pa.RecordBatch.from_arrays([*both, *columns], ["id", "of", *names])


def _known(spans: pa.Array, n: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """The passages in a column of lists, by their shingles."""
    cuts, flat = _lists(spans)
    a0, a1, b0, b1 = _ints(flat, "first_word", "last_word", "of_first_word", "of_last_word")
    every = list(zip(a0.tolist(), (a1 - n + 1).tolist(), b0.tolist(), (b1 - n + 1).tolist()))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield every[i:j]


def _pairs(batch: pa.RecordBatch, n: int, memo: WordHashes) -> Iterator[tuple]:
    """(id, of, shingles, shingles) of rows (id, of, text, of_text); texts of the same document that follow each other are hashed once."""
    ids, ofs = batch.column("id").to_pylist(), batch.column("of").to_pylist()
    new = [i for i, of in enumerate(ofs) if not i or of != ofs[i - 1]]
    others, at = shingled(batch.column("of_text").take(pa.array(new, pa.int64())), n, memo), 0
    other = None
    for i, mine in enumerate(shingled(batch.column("text"), n, memo)):
        if at < len(new) and new[at] == i:
            other, at = next(others), at + 1
        yield ids[i], ofs[i], mine, other


def _compare(n: int, least: int, similarity: float, parts: int | None = None):
    """Rows (id, of, text, of_text, spots, known) to (id, of, first, last, of_first, of_last): verified passages.

    With ``parts`` also the numbers of the parts of both ids.

    ``spots`` are the joint windows of both documents (``mine``, ``theirs``) under each common key, ``known``
    the passages of the two that were found before; they are in the result, merged with the new ones.
    Places that a found passage covers need no comparison, nor do those whose surroundings
    hold no span of ``least`` between shingles that both documents have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            ids, ofs, rows = [], [], []
            for (doc, of, mine, other), spots, covered in zip(_pairs(batch, n, memo), _laid(batch.column("spots")), _known(batch.column("known"), n)):
                tried: set[tuple[int, int, int, int]] = set()
                in_mine = in_other = None
                for a, a_back, a_on, b, b_back, b_on in spots:
                    if any(c[0] <= a <= c[1] and c[2] <= b <= c[3] for c in covered):
                        continue
                    # Around the two centres as far as either window reaches.
                    back, on = max(a_back, b_back), max(a_on, b_on)
                    around = (max(0, a - back), a + on + 1, max(0, b - back), b + on + 1)
                    if around in tried:
                        continue
                    tried.add(around)
                    if in_mine is None:
                        in_mine, in_other, plain = _held_by_both(mine, other)
                        # Sets of that size that are similar have so many values in common, if none comes twice.
                        fewest = 2 * least * similarity / (1 + similarity) - 1e-9 if plain else 1
                    a0, a1, b0, b1 = around
                    if not (_spans(in_mine, a0, a1, least, fewest) and _spans(in_other, b0, b1, least, fewest)):
                        continue
                    found = _match(mine[a0:a1], other[b0:b1], least, similarity)
                    if found:
                        span = (a0 + found[0], a0 + found[1], b0 + found[2], b0 + found[3])
                        covered.append(extend(mine, other, span, similarity))
                for c in merge(mine, other, covered, similarity):
                    ids.append(doc)
                    ofs.append(of)
                    rows.append((c[0], c[1] + n - 1, c[2], c[3] + n - 1))
            yield _passages(ids, ofs, rows, batch.schema.field("id").type, parts)

    return run


def _extend_all(n: int, similarity: float):
    """Rows (id, of, text, of_text, spans) to (id, of, ...): the passages of a pair, lengthened and merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            ids, ofs, rows = [], [], []
            for (doc, of, mine, other), spans in zip(_pairs(batch, n, memo), _known(batch.column("spans"), n)):
                for c in merge(mine, other, [extend(mine, other, s, similarity) for s in spans], similarity):
                    ids.append(doc)
                    ofs.append(of)
                    rows.append((c[0], c[1] + n - 1, c[2], c[3] + n - 1))
            yield _passages(ids, ofs, rows, batch.schema.field("id").type)

    return run


def _fields(batch: pa.RecordBatch, *names: str) -> Iterator[dict[str, np.ndarray]]:
    """The fields of ``spots``, a list of structs, row by row."""
    lists = batch.column(batch.schema.get_field_index("spots"))
    cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    flat = lists.flatten()
    columns = {x: flat.field(x).to_numpy(zero_copy_only=False) for x in names}
    for i in range(len(lists)):
        yield {x: values[cuts[i] : cuts[i + 1]] for x, values in columns.items()}


def _near_tokens(n: int):
    """Rows (id, text, spots) to (id, token): each shingle around any of the spots, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            kind = batch.schema.field("id").type
            ids, found, size = [], [], 0

            def send() -> pa.RecordBatch:
                owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
                token = pa.array(np.concatenate(found).view(np.int64))
                return pa.RecordBatch.from_arrays([pa.array(ids, kind).take(pa.array(owner)), token], ["id", "token"])

            for (doc, tokens), w in zip(_shingled(iter([batch]), n, memo), _fields(batch, "a", "back", "on")):
                steps = np.zeros(len(tokens) + 1, np.int32)
                np.add.at(steps, np.maximum(0, w["a"] - w["back"]), 1)
                np.add.at(steps, np.minimum(len(tokens), w["a"] + w["on"] + 1), -1)
                ids.append(doc)
                found.append(_distinct(tokens[np.cumsum(steps[:-1]) > 0]))
                size += len(found[-1])
                if size >= VALUES:
                    yield send()
                    ids, found, size = [], [], 0
            if found:
                yield send()

    return run


def _surroundings(n: int, least: int, similarity: float):
    """Rows (id, text, spots, common) to (key, grp, id, l, a, lo, near, loose, open): the shingles from ``a - back`` to ``a + on``.

    ``lo`` is the position of the first; ``loose`` tells that a shingle occurs twice among them. Spots that
    cannot match any document, given the shingles ``common`` to this one and others, give no row.
    """

    names = ["key", "grp", "id", "l", "a", "lo", "near", "loose", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, ids, rows, size = WordHashes(), [], [], 0

        def send(kind: pa.DataType) -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(ids)), [len(r[0]) for r in rows])
            key, grp, l, a, lo, loose, open_, many, near = (np.concatenate(c) for c in zip(*rows))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(near.view(np.int64)))
            places = (pa.array(x.astype(np.int32)) for x in (l, a, lo))
            columns = [pa.array(key), pa.array(grp), pa.array(ids, kind).take(pa.array(owner)), *places, lists, pa.array(loose), pa.array(open_)]
            return pa.RecordBatch.from_arrays(columns, names)

        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("id").type
            spots = _fields(batch, "key", "grp", "l", "a", "back", "on", "open")
            cuts, every = _lists(batch.column("common"))
            every = every.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, ((doc, tokens), w) in enumerate(zip(_shingled(iter([batch]), n, memo), spots)):
                inside = np.isin(tokens, every[cuts[i] : cuts[i + 1]])
                upto = np.concatenate([[0], np.cumsum(inside)])
                lo, hi = np.maximum(0, w["a"] - w["back"]), np.minimum(len(tokens), w["a"] + w["on"] + 1)
                # A shingle that another document repeats may make that one's set small, so only the plain bound of :func:`may_match` holds.
                hopeful = np.flatnonzero(upto[hi] - upto[lo] >= similarity * least)
                if not len(hopeful):
                    continue
                again, total = _again(tokens), np.cumsum(hi[hopeful] - lo[hopeful], dtype=np.int64)
                for part in np.split(hopeful, np.flatnonzero(np.diff(total // VALUES)) + 1):
                    begin, many = lo[part].astype(np.int64), (hi[part] - lo[part]).astype(np.int64)
                    near = tokens[np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    ids.append(doc)
                    rows.append((*(w[x][part] for x in ("key", "grp", "l", "a")), begin, again[begin] < begin + many, w["open"][part], many, near))
                    size += len(near)
                    if size >= VALUES:
                        yield send(kind)
                        ids, rows, size = [], [], 0
        if rows:
            yield send(kind)

    return run


def _again(tokens: np.ndarray) -> np.ndarray:
    """From each position on: the first position by which a value has come twice."""
    after = np.full(len(tokens), len(tokens))
    values = np.sort(tokens)
    values = values[1:][values[1:] == values[:-1]]
    if len(values):
        at = np.flatnonzero(_found(tokens, values)[1])
        order = at[np.argsort(tokens[at], kind="stable")]
        same = tokens[order][1:] == tokens[order][:-1]
        after[order[:-1][same]] = order[1:][same]
    return np.minimum.accumulate(after[::-1])[::-1]


def may_match(near: np.ndarray, shared: np.ndarray, least: int, similarity: float, loose: bool) -> bool:
    """False only if no run of ``near`` of at least ``least`` shingles can be similar to one of another document.

    ``shared`` are the shingles that other documents have near the same key. Sets
    of x and y shingles, i of them common, are similar if i >= s / (1 + s) * (x + y), so
    i >= s * x; y is ``least`` at least where no shingle repeats (else ``loose``). A run of
    four times ``least`` holds a part of two to four times ``least`` with its share of common shingles.
    """
    return _may_match(np.isin(near, shared), least, similarity, loose)


def _may_match(inside: np.ndarray, least: int, similarity: float, loose: bool) -> bool:
    if inside.sum() < similarity * (1 if loose else 2 / (1 + similarity)) * least:
        return False
    if loose:
        return True
    upto = np.concatenate([[0], np.cumsum(inside)])
    for m in range(least, min(len(inside), 4 * least) + 1):
        if (upto[m:] - upto[:-m]).max() >= max(similarity * m, similarity / (1 + similarity) * (m + least)) - 1e-9:
            return True
    return False


def _groups(*columns: pa.Array) -> Iterator[np.ndarray]:
    """Numbers of the rows that are equal in all columns."""
    codes = np.stack([c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in columns])
    order = np.lexsort(codes)
    new = (codes[:, order[1:]] != codes[:, order[:-1]]).any(axis=0)
    if len(order):
        yield from np.split(order, np.flatnonzero(new) + 1)


def _gathered(values: np.ndarray, cuts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lists of some rows, and where each list begins and ends."""
    many = cuts[rows + 1] - cuts[rows]
    ends = np.concatenate([[0], np.cumsum(many)])
    return values[np.repeat(cuts[rows] - ends[:-1], many) + np.arange(ends[-1])], ends


def _found(values: np.ndarray, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in a sorted array that is not empty, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return at, sorted_[at] == values


def _hopeful(least: int, similarity: float, names: list[str]):
    """The rows whose ``near`` may match given ``common``; columns ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            cuts, near = _lists(batch.column("near"))
            of, common = _lists(batch.column("common"))
            near, common = near.to_numpy(zero_copy_only=False), common.to_numpy(zero_copy_only=False)
            loose, lo = batch.column("any_loose").to_pylist(), batch.column("lo").to_pylist()
            # Rows of a document and a group have their common shingles.
            for rows in _groups(batch.column("grp"), batch.column("id")):
                shared = np.sort(common[of[rows[0]] : of[rows[0] + 1]])
                if not len(shared):
                    continue
                flat, ends = _gathered(near, cuts, rows)
                _, held = _found(flat, shared)
                upto = np.concatenate([[0], np.cumsum(held)])
                known: dict[tuple, bool] = {}
                for j in np.flatnonzero(upto[ends[1:]] - upto[ends[:-1]] >= similarity * least).tolist():
                    i, a, b = int(rows[j]), ends[j], ends[j + 1]
                    what = (lo[i], int(b - a), loose[i])
                    if what not in known:
                        known[what] = _may_match(held[a:b], least, similarity, loose[i])
                    keep[i] = known[what]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return run


def _compare_near(n: int, least: int, similarity: float):
    """Rows (key, id, l, lo, near, loose, others) to (id, of, ...): the passages shared with the others, the leaders of the key.

    All of them are tried: each leaves the key afterwards, and may have no other document to match. Two
    leaders meet once. Runs without repeats that have too few shingles in common cannot match.
    """
    fewest = 2 * least * similarity / (1 + similarity) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l, lo, loose = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("l", "lo", "loose"))
            cuts, near = _lists(batch.column("near"))
            near = near.to_numpy(zero_copy_only=False)
            whose, others = _lists(batch.column("others"))
            o_l, o_lo, o_loose = (others.field(x).to_numpy(zero_copy_only=False) for x in ("l", "lo", "loose"))
            o_cuts, o_near = _lists(others.field("near"))
            o_near = o_near.to_numpy(zero_copy_only=False)
            rank, o_rank = _ranks(batch.column("id"), others.field("id"))
            found: list[tuple[np.ndarray, ...]] = []
            waiting: list[tuple[np.ndarray, ...]] = []
            asked: list[tuple[np.ndarray, np.ndarray]] = []
            pairs = size = 0

            def settle() -> None:
                row, o = (np.concatenate(x) for x in zip(*asked))
                spans = match_many(*(np.concatenate(x) for x in zip(*waiting)), pairs, least, similarity)
                hit = np.flatnonzero(spans[:, 0] >= 0)
                found.append((row[hit], o[hit], spans[hit]))

            for rows in _groups(batch.column("key")):
                leaders = np.arange(whose[rows[0]], whose[rows[0] + 1])
                if not len(leaders):
                    continue
                # Shingles of the leaders, and where each leader has them.
                theirs = np.concatenate([o_near[o_cuts[o] : o_cuts[o + 1]] for o in leaders])
                many = o_cuts[leaders + 1] - o_cuts[leaders]
                owner, place = np.repeat(np.arange(len(leaders)), many), np.concatenate([np.arange(m) for m in many])
                order = np.argsort(theirs)
                theirs = theirs[order]
                new = np.concatenate([[True], theirs[1:] != theirs[:-1]])
                at_leader = np.full((len(leaders), np.count_nonzero(new)), -1)
                at_leader[owner[order], np.cumsum(new) - 1] = place[order]
                flat, ends = _gathered(near, cuts, rows)
                at, held = _found(flat, theirs[new])
                held = np.flatnonzero(held)
                at, row = at[held], (np.searchsorted(ends, held, "right") - 1)
                place = held - ends[row]
                doc = rank[rows]
                is_leader = ((doc[:, None] == o_rank[leaders]) & (l[rows, None] == o_l[leaders])).any(axis=1)
                for k, o in enumerate(leaders.tolist()):
                    meets = (doc != o_rank[o]) & ~(is_leader & (doc < o_rank[o]))
                    slow = meets & (loose[rows] | o_loose[o])
                    for i in np.flatnonzero(slow).tolist():
                        span = match(flat[ends[i] : ends[i + 1]], o_near[o_cuts[o] : o_cuts[o + 1]], least, similarity)
                        if span:
                            found.append((rows[i : i + 1], np.array([o]), np.array([span])))
                    there = at_leader[k][at]
                    in_common = np.bincount(row[there >= 0], minlength=len(rows))
                    maybe = meets & ~slow & (in_common >= fewest)
                    chosen = np.flatnonzero(maybe)
                    if len(chosen):
                        here = (there >= 0) & maybe[row]
                        number = pairs - 1 + np.cumsum(maybe)
                        waiting.append((number[row[here]], place[here], there[here]))
                        asked.append((rows[chosen], np.full(len(chosen), o)))
                        pairs, size = pairs + len(chosen), size + len(waiting[-1][0])
                        if size >= TOGETHER:
                            settle()
                            waiting, asked, pairs, size = [], [], 0, 0
            if asked:
                settle()
            if found:
                row, o, spans = (np.concatenate(x) for x in zip(*found))
                here, there = lo[row], o_lo[o]
                places = (here + spans[:, 0], here + spans[:, 1] + n - 1, there + spans[:, 2], there + spans[:, 3] + n - 1)
                columns = [batch.column("id").take(pa.array(row)), others.field("id").take(pa.array(o)), *(pa.array(x.astype(np.int32)) for x in places)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "of", "first_word", "last_word", "of_first_word", "of_last_word"])

    return run


def _settled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows, no longer ``open`` where a found passage of their document covers their centre."""
    sides = found.select("id", "first_word", "last_word").union(found.select("of", "of_first_word", "of_last_word"))
    spans = materialize(sides.groupBy("id").agg(F.collect_set(F.struct("first_word", "last_word")).alias("_spans")))
    inside = F.exists("_spans", lambda s: F.col("a").between(s["first_word"], s["last_word"]))
    covered = F.coalesce(inside, F.lit(False))
    return rows.join(if_small(spans, 200_000), "id", "left").withColumn("open", F.col("open") & ~covered).drop("_spans")


def _of_open_keys(rows: DataFrame) -> DataFrame:
    """The rows of keys that have an open row."""
    keys = materialize(rows.where("open").select("key").distinct())
    return rows.join(if_small(keys), "key", "left_semi")


def _later_rounds(left: DataFrame, texts: DataFrame, least: int, similarity: float, schema: str) -> list[DataFrame]:
    """Passages of rows (key, id, l, r, a, open, grp) that do not match the first document of their key.

    Rows that are not ``open`` have a passage already; they stay as partners of the
    open ones, which may share more with them (without the column all are open).
    The rows carry the shingles around them. In each round those open rows go that hold too
    few shingles of other documents of the key to match any, and the rest is compared
    with up to LEADERS open ones, the first place of the smallest id of each part of the
    key. The leaders have then met all others, and leave the key; other places of their
    documents stay. A key is done when no open row is left. Shingles of other documents are looked up
    for all keys of one ``grp`` together (without the column each key is one), which lets more rows stay, never fewer.
    """
    kind = left.schema["id"].dataType.simpleString()
    if "open" not in left.columns:
        left = left.withColumn("open", F.lit(True))
    if "grp" not in left.columns:
        left = left.withColumn("grp", F.col("key"))
    several = (F.col("_x") != F.col("_y")) & F.col("_open")
    ends = [F.min("id").alias("_x"), F.max("id").alias("_y"), F.max("open").alias("_open")]
    reach = left.groupBy("key").agg(F.max(F.col("a") - F.col("l")).alias("back"), F.max(F.col("r") - F.col("a")).alias("on"), *ends)
    reach = reach.where(several).select("key", "back", "on")
    spots = left.join(reach, "key").groupBy("id").agg(F.collect_list(F.struct("key", "grp", "l", "a", "back", "on", "open")).alias("spots"))
    names = ["key", "grp", "id", "l", "a", "lo", "near", "loose", "open"]
    fields = f"key long, grp long, id {kind}, l int, a int, lo int, near array<long>, loose boolean, open boolean"
    spots = materialize(spots)
    texts = _texts_of(texts, spots.select("id"))
    # First a look at all keys together: most spots lie around a stretch that is shared but too short, and match nothing.
    with small_batches(texts.sparkSession, TEXTS_A_BATCH):
        tokens = materialize(spots.join(texts, "id").mapInArrow(_near_tokens(SHINGLE), f"id {kind}, token long"))
    held = tokens.groupBy("token").agg(F.min("id").alias("_x"), F.max("id").alias("_y")).where(F.col("_x") != F.col("_y")).select("token")
    common = tokens.join(held, "token").groupBy("id").agg(F.collect_list("token").alias("common"))
    around = spots.join(common, "id").join(texts, "id").select("id", "text", "spots", "common")
    with small_batches(texts.sparkSession, TEXTS_A_BATCH):
        left = materialize(around.mapInArrow(_surroundings(SHINGLE, least, similarity), fields))
    passages, leaders = [], LEADERS
    while left.where("open").limit(1).count():
        # Keys that one document alone has left are done, and those without an open row.
        keys = materialize(left.groupBy("key").agg(*ends, F.max("loose").alias("any_loose")).where(several).select("key", "any_loose"))
        live = left.join(if_small(keys), "key")
        token = F.explode("near").alias("token")
        shared = live.select("grp", "id", "open", token).groupBy("grp", "token").agg(*ends).where(several).select("grp", "token")
        asked = live.where("open").select("grp", "id", token).distinct()
        common = asked.join(shared, ["grp", "token"]).groupBy("grp", "id").agg(F.collect_list("token").alias("common"))
        asking = live.where("open").join(common, ["grp", "id"])
        with small_batches(left.sparkSession, 2 * TEXTS_A_BATCH):
            hopeful = materialize(asking.mapInArrow(_hopeful(least, similarity, names), fields))
        part = F.pmod(F.xxhash64("id"), F.lit(leaders))
        firsts = hopeful.groupBy("key", part.alias("_part")).agg(F.min(F.struct("id", "l", "lo", "near", "loose")).alias("_o"))
        lists = materialize(firsts.groupBy("key").agg(F.collect_list(F.struct("_o.id", "_o.l", "_o.lo", "_o.near", "_o.loose")).alias("others")))
        settled = left.where(~F.col("open")).join(if_small(lists.select("key")), "key", "left_semi")
        rows = hopeful.union(settled.select(names))
        led = rows.select("key", "id", "l", "lo", "near", "loose").join(lists, "key")
        # A row brings the shingles of all leaders.
        with small_batches(left.sparkSession, TEXTS_A_BATCH * LEADERS // leaders):
            found = materialize(led.mapInArrow(_compare_near(SHINGLE, least, similarity), schema))
        passages.append(found)
        gone = lists.select("key", F.explode("others").alias("_o")).select("key", "_o.id", "_o.l")
        stay = rows.join(if_small(materialize(gone)), ["key", "id", "l"], "left_anti").select(names)
        left = materialize(_of_open_keys(_settled(stay, found)))
        leaders = min(2 * leaders, MOST_LEADERS)
    return passages


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some ids, of which ``ids`` may have each more than once."""
    return texts.join(if_small(materialize(ids.distinct())), "id", "left_semi")


def _found_in_pairs(pairs: DataFrame, texts: DataFrame, least: int, similarity: float, parts: int) -> DataFrame:
    """Passages of pairs (id, of, spots, known), those of a pair together with its ``known`` ones."""
    kind = pairs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, of {kind}, {', '.join(f'{x} int' for x in ENDS)}, part int, of_part int"
    with small_batches(pairs.sparkSession, PARTS_TOGETHER):
        one = materialize(pairs)
    other = _texts_of(texts, one.select(F.col("of").alias("id"))).select(F.col("id").alias("of"), F.col("text").alias("of_text"))
    both = one.join(_texts_of(texts, one.select("id")), "id").join(other, "of")
    with small_batches(pairs.sparkSession, TEXTS_A_BATCH):
        return materialize(both.select("id", "of", "text", "of_text", "spots", "known").mapInArrow(_compare(SHINGLE, least, similarity, parts), schema))


def _of_parts(rows: DataFrame, passages: DataFrame, name: str) -> DataFrame:
    """The packed rows of each part beside its ``passages`` (part, ...), a list of the other columns."""
    few = passages.limit(200_001).count() <= 200_000
    lists = passages.groupBy("part").agg(F.collect_set(F.struct(*[x for x in passages.columns if x != "part"])).alias(name))
    return rows.join(F.broadcast(lists) if few else lists, "part", "left").select("some", "others", name)


def _left_open(rows: DataFrame, passages: DataFrame, kind: str, least: int) -> DataFrame:
    """The rows (key, id, l, r, a, grp, open) of the keys that have a row which no passage of its document covers."""
    spark = rows.sparkSession
    sides = passages.select("part", "id", "first_word", "last_word").union(passages.select("of_part", "of", "of_first_word", "of_last_word"))
    sides = _of_parts(rows, materialize(sides.distinct()), "sides")
    with small_batches(spark, PARTS_TOGETHER):
        keys = materialize(sides.mapInArrow(_settled_rows(True), "key long").distinct())
        few = keys.limit(2_000_001).count() <= 2_000_000
        wanted = spark.sparkContext.broadcast(np.sort(np.array([k for (k,) in keys.collect()], np.int64))) if few else None
        left = sides.mapInArrow(_settled_rows(False, wanted), f"key long, id {kind}, l int, r int, a int, of {kind}, at int, open boolean")
        # Keys whose first document has them in one stretch share what lies around them.
        grp = F.xxhash64("of", F.floor(F.col("at") / F.lit(least)))
        left = left.select("key", "id", "l", "r", "a", grp.alias("grp"), "open")
        return materialize(left if few else left.join(keys, "key", "left_semi"))


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = PASSAGE,
    similarity: float = SIMILARITY,
    functions: int = FUNCTIONS,
) -> DataFrame:
    """Passages of at least ``words`` words that are near duplicates of one in another document.

    Returns one row per passage: the id, ``first_word`` and ``last_word`` (positions
    from 0), and ``of_<id>``, ``of_first_word``, ``of_last_word``: the passage of another
    document under the same signature, which stands for its class (of the smallest
    id, for those that match it); that passage itself is a row that names itself.

    Shingles of five words are hashed by each function; a compact window holds all
    subsequences with the same minimum. Where windows of three functions of a line (:func:`lines`) meet over
    the length of a passage, their minima together are a key. Documents under a
    key are compared with the document of the smallest id that has it, each place with
    each of its places, over the shingles around the windows; those that do not match it meet all others of the key,
    matched or not, several a round (:func:`_later_rounds`). Passages repeated word for word always share all
    keys; a near copy is found if the functions of a line agree somewhere on it. Passages go on to both
    sides as far as both texts do.

    NULL, empty and short texts have no passages; a NULL id has none either. Equal
    texts are compared once and all get the result. Rows of one id and different
    texts: the text of the smallest hash stands for the id. Other columns are not read. An empty
    table gives an empty table.
    """
    least = words - SHINGLE + 1
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Bytes are known without a look at the text, and not fewer than characters.
    base = base.where(F.col("id").isNotNull() & (F.octet_length("text") >= 2 * words - 1))
    kind = base.schema["id"].dataType.simpleString()
    mark, mark_2 = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    marked = base.select("id", mark.alias("_a"), mark_2.alias("_b"), F.octet_length("text").alias("_chars"))
    several = (F.count(F.lit(1)) > 1).alias("_again")
    # Numbers only, so that no group is sorted.
    names = materialize(marked.groupBy("id").agg(F.min("_a").alias("_t"), F.min_by("_b", "_a").alias("_u"), F.max("_chars").alias("_chars"), several))
    copies = [F.min("id").alias("rep"), F.min_by("_again", "id").alias("_again"), F.count(F.lit(1)).alias("_copies"), F.max("_chars").alias("_chars")]
    reps = materialize(names.groupBy("_t", "_u").agg(*copies))
    of_rep = (F.col("id") == F.col("rep")) & (mark == F.col("_t")) & (mark_2 == F.col("_u"))
    texts = base.join(if_small(reps.select("rep", "_t", "_u", "_again")), of_rep).select("id", "text", "_again")
    # Only the texts of ids in several rows move: those rows may be the same.
    texts = texts.where(~F.col("_again")).select("id", "text").union(texts.where("_again").groupBy("id").agg(F.min("text").alias("text")))
    chars = reps.agg(F.sum("_chars")).first()[0] or 0
    context = docs.sparkSession.sparkContext
    with small_batches(docs.sparkSession, TEXTS_A_BATCH):
        shared = context.broadcast(shared_keys(texts, chars, least, functions).bits)
    parts = max(16, isqrt(chars // CHARS_A_SQUARE))
    joint = texts.mapInArrow(_joint_of_texts(SHINGLE, least, functions, shared, parts), "bucket int, later boolean, rows binary")
    with small_batches(docs.sparkSession, PACKED_A_BATCH):
        beside = joint.repartition("bucket").sortWithinPartitions("bucket", "later")
        beside = beside.mapInArrow(_beside_first_packed(parts), "part int, some binary, others binary")
        beside = beside.repartition("part").sortWithinPartitions("part")
        rows = materialize(beside.mapInArrow(_whole_parts, f"part int, some binary, others binary, ids array<{kind}>"))
    texts = materialize(_texts_of(texts, rows.select(F.explode("ids").alias("id"))))
    schema = f"id {kind}, of {kind}, {', '.join(f'{x} int' for x in ENDS)}"
    place = "struct<l: int, r: int, a: int>"
    of_pair = f"id {kind}, of {kind}, spots array<struct<mine: {place}, theirs: array<{place}>>>, known array<struct<{', '.join(f'{x}: int' for x in ENDS)}>>"
    # A part of the keys first: what they find covers most places of near copies, and the other keys of those need no look.
    some = _found_in_pairs(rows.select("some").mapInArrow(_spots(False), of_pair), texts, least, similarity, parts)
    known = _of_parts(rows, some.select("part", "id", "of", *ENDS), "known")
    more = _found_in_pairs(known.mapInArrow(_spots(True), of_pair), texts, least, similarity, parts)
    passages = materialize(some.join(more.select("id", "of").distinct(), ["id", "of"], "left_anti").select(more.columns).union(more))
    left = _left_open(rows, passages, kind, least)
    passages = passages.select("id", "of", *ENDS)
    ends = F.struct(*ENDS)
    later = _later_rounds(left, texts, least, similarity, schema)
    if later:
        spans = materialize(reduce(DataFrame.union, later).groupBy("id", "of").agg(F.sort_array(F.collect_set(ends)).alias("spans")))
        other = _texts_of(texts, spans.select(F.col("of").alias("id"))).select(F.col("id").alias("of"), F.col("text").alias("of_text"))
        both = spans.join(_texts_of(texts, spans.select("id")), "id").join(other, "of").select("id", "of", "text", "of_text", "spans")
        with small_batches(docs.sparkSession, TEXTS_A_BATCH):
            passages = materialize(passages.union(both.mapInArrow(_extend_all(SHINGLE, similarity), schema)))
    own = passages.select(
        F.col("of").alias("id"), "of", F.col("of_first_word").alias("first_word"), F.col("of_last_word").alias("last_word"), "of_first_word", "of_last_word"
    )
    every = passages.union(own.select(passages.columns)).distinct()
    # Documents of equal texts: each gets the rows of the one that was compared, and all of it is a passage.
    member = names.join(reps.select("_t", "_u", "rep", "_copies"), ["_t", "_u"]).select(F.col("id").alias("_member"), "rep", "_copies")
    spread = every.join(member, F.col("id") == F.col("rep")).select("_member", "of", "first_word", "last_word", "of_first_word", "of_last_word")
    copied = materialize(reps.where(F.col("_copies") > 1).select("rep", "_t", "_u"))
    last = F.regexp_count("text", F.lit(WORD)).cast("int") - 1
    lasts = base.join(if_small(copied), of_rep).groupBy("rep").agg(F.min(last).alias("last_word"))
    copies = member.where(F.col("_copies") > 1).join(lasts, "rep")
    whole = copies.select("_member", F.col("rep").alias("of"), F.lit(0).alias("first_word"), "last_word")
    whole = whole.where(F.col("last_word") + 1 >= words).select(
        "_member", "of", "first_word", "last_word", F.col("first_word").alias("of_first_word"), F.col("last_word").alias("of_last_word")
    )
    return spread.union(whole).distinct().withColumnsRenamed({"_member": id_col, "of": f"of_{id_col}"})
