"""Word shingle sets of many short or long texts at once, and their MinHash bands.

Words are runs of letters and digits in lower case (every character beyond ASCII counts as one). A
word's hash is taken from prefix sums over the bytes, so no Python runs per word.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

N = 5
SIMILARITY = 0.8
RECALL = 0.9999
MOST_HASHES = 96

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def byte_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over bytes, and factors: (sums[b] - sums[a]) * factors[a] is the hash of bytes a to b."""
    power, back = _powers(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:len(data)])]), back


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in a row, and the offsets of each text among them."""
    lower = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())).cast(pa.large_binary())
    ends = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset:lower.offset + len(lower) + 1]
    if not len(lower) or ends[-1] == ends[0]:
        return np.empty(0, np.uint64), np.zeros(len(lower) + 1, np.int64)
    data = np.frombuffer(lower.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    word = _WORD[data]
    first = ends[:-1][np.diff(ends) > 0]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    opens[first[word[first]]] = True
    last = ends[1:][np.diff(ends) > 0] - 1
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    closes[last[word[last]]] = True
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums, back = byte_sums(data)
    return mix((sums[stop] - sums[start]) * back[start]), np.searchsorted(start, ends)


def shingle_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, their offsets, and the words of each text.

    A text of fewer than ``n`` words has one shingle, of all its words; one without a word has none.
    """
    words, at = word_hashes(texts)
    sizes = np.diff(at)
    count = len(words)
    runs = words.copy()
    for k in range(1, n):
        if count > k:
            runs[:count - k] = mix(runs[:count - k] + np.uint64(k)) + words[k:]
    sets, lengths = [], []
    for i, (a, m) in enumerate(zip(at[:-1].tolist(), sizes.tolist())):
        if m >= n:
            one = np.sort(runs[a:a + m - n + 1])
            one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        elif m:
            h = words[a:a + 1].copy()
            for k in range(1, m):
                h = mix(h + np.uint64(k)) + words[a + k]
            one = mix(h + np.uint64(1000 + m))
        else:
            one = words[:0]
        sets.append(one)
        lengths.append(len(one))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return (mix(np.concatenate(sets)) if sets else words[:0]), offsets, sizes


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows a band: the most rows, hence the fewest chance collisions, with which a pair of
    ``similarity`` meets in some band with probability ``recall`` under ``most`` hashes."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 128-bit key of each set, as two columns of int64: sums of two mixes of its members and size."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for k in range(2):
            mixed = mix(values + np.uint64(0x632BE59BD9B4E019 * (k + 1) & (2**64 - 1)))
            out[full, k] = mix(np.add.reduceat(mixed, offsets[:-1][full]) + np.diff(offsets)[full].astype(np.uint64))
    return out.view(np.int64)


def band_hashes(values: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One int64 a band for each non-empty set (empty sets get zeros)."""
    rng = np.random.default_rng(97)
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    if not len(full):
        return out.view(np.int64)
    starts = offsets[:-1][full]
    hashed = np.empty_like(values)
    for band in range(bands):
        joined = np.full(len(full), np.uint64(band + 1))
        for _ in range(rows):
            salt, factor = rng.integers(1, 2**63, 2, dtype=np.uint64)
            np.bitwise_xor(values, salt, out=hashed)
            np.multiply(hashed, factor * np.uint64(2) + np.uint64(1), out=hashed)
            joined = mix(joined ^ np.minimum.reduceat(hashed, starts))
        out[full, band] = joined
    return out.view(np.int64)


def linked(sets: list[np.ndarray], weights: np.ndarray, similarity: float,
           split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Verify all pairs of a block on the full sets.

    Returns, for each set, the weight of the sets linked to it (exact Jaccard of at least
    ``similarity``) and the first member of its component. With ``split``, only pairs across that position
    count. Sets meet through their shared members; a member of one set only is dropped at once.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    links, root = np.zeros(m, np.int64), np.arange(m)
    if m < 2:
        return links, root
    owner = np.repeat(np.arange(m), sizes)
    _, member, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many[member] > 1
    owner, member = owner[shared], member[shared]
    order = np.argsort(member, kind="stable")
    post_owner, post_at = owner[order], np.concatenate([[0], np.cumsum(np.bincount(member, minlength=len(many)))])
    by_set = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=m))])

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(m - 1 if split is None else split):
        mine = member[by_set[i]:by_set[i + 1]]
        if not len(mine):
            continue
        lows, highs = post_at[mine], post_at[mine + 1]
        lens = highs - lows
        at = np.repeat(lows - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))
        both = np.bincount(post_owner[at], minlength=m)
        after = i + 1 if split is None else split
        other = after + np.flatnonzero(both[after:])
        inter = both[other]
        close = other[inter >= similarity * (sizes[i] + sizes[other] - inter) - 1e-6]
        close = close[both[close] / (sizes[i] + sizes[close] - both[close]) >= similarity]
        if len(close):
            links[i] += int(weights[close].sum())
            links[close] += int(weights[i])
            for j in close.tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
    return links, np.array([find(i) for i in range(m)])
