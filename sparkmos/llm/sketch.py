"""Word shingles and fast similarity sketches of many texts at once, as NumPy arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers; hashes are taken modulo 2 ** 64.
BASE, STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
EMPTY = np.int64(2**62)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit words with every output bit depending on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def shingles(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and how many each text has.

    Words are runs of bytes other than space and 9 to 13, with A-Z in lower case. A text of
    fewer words than ``size`` has its whole sequence as one shingle, one without words none.
    """
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    space = _SPACE[raw]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, n) + 1)
    text = np.searchsorted(text_end, begin, side="right")
    # Hash of a word: the sum of its bytes' values, each mixed with its place in the word.
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(raw)]])))
    value = _BYTES[_LOWER[raw]]
    value = (value ^ (place.astype(np.uint64) * STEP)) * BASE
    value ^= value >> U(29)
    value *= STEP
    run = np.concatenate([[U(0)], np.cumsum(value, dtype=np.uint64)])
    word = mix(run[end] - run[begin] + (end - begin).astype(np.uint64))
    words = np.bincount(text, minlength=n)
    out_h, out_t = [], []
    m = len(word) - size + 1
    if m > 0:
        whole = text[:m] == text[size - 1 :]
        h = np.zeros(m, dtype=np.uint64)
        for k in range(size):
            h = mix(h + word[k : k + m] * BASE)
        out_h.append(h[whole])
        out_t.append(text[:m][whole])
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(words)])[short]
        h = words[short].astype(np.uint64) * STEP
        for k in range(size - 1):
            has = words[short] > k
            h = np.where(has, mix(h + word[np.minimum(first + k, len(word) - 1)] * BASE), h)
        out_h.append(h)
        out_t.append(short)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    h, t = np.concatenate(out_h), np.concatenate(out_t)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])[: len(h)]
    return h[new], np.bincount(t[new], minlength=n)


def sketch(h: np.ndarray, count: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of each set, ``bins`` coordinates; EMPTY throughout for empty sets.

    Round ``i`` throws every element into a random bin with value ``i`` plus a random fraction,
    and a bin keeps its smallest. From round ``bins`` on, all elements go to bin ``i - bins``, so
    after ``2 * bins`` rounds every bin is filled. A set is done when it has no empty bin; most
    are after the first round or two, and sets that are done take no part in the next.
    """
    n = len(count)
    out = np.full(n * bins, EMPTY, dtype=np.int64)
    owner = np.repeat(np.arange(n), count)
    h = h.copy()
    for i in range(2 * bins):
        if not len(h):
            break
        x = mix(h + np.array([i + 1], dtype=np.uint64) * STEP)
        value = (np.int64(i) << np.int64(40)) | (x & U((1 << 40) - 1)).astype(np.int64)
        bin_ = ((x >> U(40)) * U(bins) >> U(24)).astype(np.int64) if i < bins else np.full(len(h), i - bins)
        np.minimum.at(out, owner * bins + bin_, value)
        open_ = (out.reshape(n, bins) == EMPTY).any(axis=1)
        still = open_[owner]
        h, owner = h[still], owner[still]
    return out.reshape(n, bins)


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each ``rows`` coordinates."""
    n, bins = coordinates.shape
    parts = coordinates.view(np.uint64).reshape(n, bins // rows, rows)
    h = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64) * STEP, (n, bins // rows)).copy()
    for k in range(rows):
        h = mix(h + parts[:, :, k] * BASE)
    return h.view(np.int64)


def set_keys(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set; 0 for empty sets."""
    ends = np.cumsum(count)
    out = []
    for seed in (STEP, BASE):
        run = np.concatenate([[U(0)], np.cumsum(mix(h ^ seed), dtype=np.uint64)])
        out.append((run[ends] - run[ends - count]).view(np.int64))
    return out[0], out[1]


def links(
    a: list[np.ndarray], b: list[np.ndarray], allowed: np.ndarray, percent: int, groups: tuple[np.ndarray, np.ndarray]
) -> list[tuple[int, int]]:
    """Pairs with ``100 * common >= percent * union`` that join groups not joined yet.

    ``a`` and ``b`` are sorted sets, ``allowed`` says which pairs to look at, ``groups`` which
    sets are known to belong together. Every allowed pair between different groups is decided
    on the full sets, unless links found before have joined its groups; so the links returned
    and all links join the same sets, and there are at most ``len(a) + len(b) - 1``.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size_b = np.fromiter(map(len, b), np.int64, len(b))
    owner = np.repeat(np.arange(len(b)), size_b)
    every = np.concatenate(b) if b else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    found = []
    for i, own in enumerate(a):
        wanted = allowed[i]
        if not wanted.any():
            continue
        lo, hi = np.searchsorted(every, own, side="left"), np.searchsorted(every, own, side="right")
        times = hi - lo
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
        common = np.bincount(owner[at], minlength=len(b))
        for j in np.flatnonzero(wanted & (100 * common >= percent * (len(own) + size_b - common))).tolist():
            x, y = root(int(groups[0][i])), root(int(groups[1][j]))
            if x != y:
                parent[x] = y
                found.append((i, j))
    return found
