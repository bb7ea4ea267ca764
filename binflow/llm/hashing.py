"""Task-side hashing of words and shingles with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words that one task remembers the hash of before it starts anew.
REMEMBERED = 400_000


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers, so that sums and multiples lose their order."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word seen; words repeat so much that most are looked up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text in order. ``bytes`` lower A-Z only and split at space and \\x09-\\x0D only."""
        words = text.encode("utf-8", "replace").lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words in order; of the whole sequence where it is shorter; none without words."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    h = words[:m]
    for k in range(1, n):
        h = mix64(h) * np.uint64(0x9E3779B97F4A7C15) + words[k : m + k]
    return mix64(h)


#: The start of the secret of XXH3 as 64-bit numbers, and its multipliers.
_SECRET = np.frombuffer(
    bytes.fromhex(
        "b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671f"
        "cb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"
    ),
    "<u8",
).tolist()
_MX1, _MX2 = np.uint64(0x165667919E3779F9), np.uint64(0x9FB21C651E98DF25)
_P2, _P3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LOW32, _BYTE, _ALL = np.uint64(0xFFFFFFFF), np.uint64(0xFF), np.uint64(0xFFFFFFFFFFFFFFFF)
#: Characters of text that are hashed together, if no single text is longer.
HASHED_TOGETHER = 1 << 17


def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def _folded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The two halves of the 128-bit product, one laid over the other."""
    a, b, c, d = x >> _u(32), x & _LOW32, y >> _u(32), y & _LOW32
    low, left, right = b * d, a * d, b * c
    middle = (low >> _u(32)) + (left & _LOW32) + right
    return (a * c + (left >> _u(32)) + (middle >> _u(32))) ^ (x * y)


def _xxh3_1_to_3(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    middle, last = (x >> ((n >> _u(1)) << _u(3))) & _BYTE, (x >> ((n - _u(1)) << _u(3))) & _BYTE
    h = ((x & _BYTE) << _u(16)) | (middle << _u(24)) | last | (n << _u(8))
    h ^= _u((_SECRET[0] & 0xFFFFFFFF) ^ (_SECRET[0] >> 32))
    h = (h ^ (h >> _u(33))) * _P2
    h = (h ^ (h >> _u(29))) * _P3
    return h ^ (h >> _u(32))


def _xxh3_4_to_8(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    h = ((x >> ((n - _u(4)) << _u(3))) & _LOW32) + (x << _u(32))
    h ^= _u(_SECRET[1] ^ _SECRET[2])
    h ^= ((h << _u(49)) | (h >> _u(15))) ^ ((h << _u(24)) | (h >> _u(40)))
    h *= _MX2
    h = (h ^ ((h >> _u(35)) + n)) * _MX2
    return h ^ (h >> _u(28))


def _xxh3_9_to_16(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    x, y = x ^ _u(_SECRET[3] ^ _SECRET[4]), y ^ _u(_SECRET[5] ^ _SECRET[6])
    h = n + x.byteswap() + y + _folded(x, y)
    h = (h ^ (h >> _u(37))) * _MX1
    return h ^ (h >> _u(32))


def _hashed(data: np.ndarray, cuts: np.ndarray, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts ``data[cuts[i]:cuts[i + 1]]``, and how many words there are before each cut."""
    size = len(data)
    padded = np.zeros((size // 8 + 3) * 8, np.uint8)
    lower = padded[:size]
    lower[:] = data
    lower |= ((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)
    solid = (lower != 32) & ((lower - np.uint8(9)) > 4)
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    # Texts follow each other without a gap.
    inner = cuts[(cuts > 0) & (cuts < size)]
    begins[inner], ends[inner - 1] = solid[inner], solid[inner - 1]
    start, n = np.flatnonzero(begins), np.flatnonzero(ends)
    before = np.searchsorted(start, cuts)
    n -= start - 1
    numbers = padded.view("<u8")

    def eight(at: np.ndarray) -> np.ndarray:
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return (numbers[word] >> shift) | ((numbers[word + 1] << _u(1)) << (_u(63) - shift))

    hashes, length, x = np.empty(len(start), np.uint64), n.astype(np.uint64), eight(start)
    few = np.flatnonzero(n <= 8)
    x[few] &= _ALL >> (_u(64) - (length[few] << _u(3)))
    some = few[n[few] <= 3]
    hashes[some] = _xxh3_1_to_3(x[some], length[some])
    some = few[n[few] > 3]
    hashes[some] = _xxh3_4_to_8(x[some], length[some])
    some = np.flatnonzero((n > 8) & (n <= 16))
    hashes[some] = _xxh3_9_to_16(x[some], eight(start[some] + n[some] - 8), length[some])
    many = np.flatnonzero(n > 16)
    if len(many):
        whole = lower.tobytes()
        hashes[many] = [memo[whole[s : s + k]] for s, k in zip(start[many].tolist(), n[many].tolist())]
    return hashes, before


def word_hashes(texts: pa.Array, memo: WordHashes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashes of the words of many texts, those of :class:`WordHashes`, some texts at a time.

    Yields (number of the first text, hashes, cuts): the words of the i-th of these texts are ``hashes[cuts[i]:cuts[i + 1]]``.
    """
    wide = texts.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    # A text that is NULL has no characters.
    lengths = pc.fill_null(pc.binary_length(wide), 0).to_numpy(zero_copy_only=False)
    begin = 0
    while begin < len(wide):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + HASHED_TOGETHER, "right")) - 1)
        cuts = at[begin : end + 1] - at[begin]
        if (np.diff(cuts) != lengths[begin:end]).any():
            end = begin + 1
            cuts = np.array([0, lengths[begin]])
        hashes, before = _hashed(data[at[begin] : at[begin] + cuts[-1]], cuts, memo)
        yield begin, hashes, before
        begin = end


def shingled(texts: pa.Array, n: int, memo: WordHashes) -> Iterator[np.ndarray]:
    """:func:`shingles` of each text."""
    for _, words, cuts in word_hashes(texts, memo):
        runs = shingles(words, n)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield runs[a : b - n + 1] if b - a >= n else shingles(words[a:b], n)


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a sorted set, as two signed numbers."""
    both = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64)
    return int(both[0]), int(both[1])


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python values, one at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)
