"""Word shingles of whole texts as 64-bit hashes, computed on all texts of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers that a worker keeps, of the base and of its inverse; longer texts make their own.
KEPT = 1 << 20


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BACK)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_POWERS = _steps(1 << 16)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if n > KEPT:
        return _steps(n)
    if len(_POWERS[0]) < n:
        _POWERS = _steps(min(KEPT, 2 * n))
    return _POWERS


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text begins and the last ends. Null counts
    as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row (A-Z lower-cased; words are runs without ASCII white
    space), and the number of words in each text. Null counts as empty."""
    return hash_words(*text_bytes(texts))


def hash_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of texts that are given by their bytes and bounds."""
    n = len(bounds) - 1
    raw = _LOWER[raw]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    word = ~_SPACE[raw]
    begins = np.empty(len(raw), bool)
    begins[0] = word[0]
    np.greater(word[1:], word[:-1], out=begins[1:])
    first = bounds[:-1][np.diff(bounds) > 0]
    begins[first] = word[first]
    starts = np.flatnonzero(begins)
    ends_mark = np.empty(len(raw), bool)
    ends_mark[-1] = word[-1]
    np.greater(word[:-1], word[1:], out=ends_mark[:-1])
    last = first[1:] - 1
    ends_mark[last] |= word[last]
    ends = np.flatnonzero(ends_mark) + 1
    powers, backs = _powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * backs[starts])
    counts = np.diff(np.searchsorted(starts, bounds))
    return hashes, counts


def _salts(width: int) -> np.ndarray:
    return mix(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each word on, across the ends of texts."""
    salts, n = _salts(width), max(len(hashes) - width + 1, 0)
    acc = np.zeros(n, np.uint64)
    for j in range(width):
        acc += hashes[j : j + n] * salts[j]
    return mix(acc)


def _short(own: np.ndarray) -> np.ndarray:
    """The one shingle of a text of few words."""
    return mix((own * _salts(len(own))).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own)))


def shingle_tokens(raw: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sets of ``shingle_sets`` for texts given by their bytes and bounds, in one flat array:
    hashes (each once a text, in order of place), and the text of each."""
    hashes, counts = hash_words(raw, bounds)
    ends = np.cumsum(counts)
    many = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), many)
    at = np.arange(len(owner)) + np.repeat(ends - counts - (np.cumsum(many) - many), many)
    tokens = _shingles(hashes, width)[at]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        more = np.concatenate([_short(hashes[ends[i] - counts[i] : ends[i]]) for i in few.tolist()])
        order = np.argsort(np.concatenate([owner, few]), kind="stable")
        tokens, owner = np.concatenate([tokens, more])[order], np.concatenate([owner, few])[order]
    pair = mix(tokens + owner.astype(np.uint64) * _BASE)
    ordered = np.sort(pair)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return tokens, owner
    # Few repeat: only these are looked at by place.
    seen = np.zeros(1 << 16, bool)
    seen[again >> np.uint64(48)] = True
    some = np.flatnonzero(seen[pair >> np.uint64(48)])
    some = some[again[np.minimum(np.searchsorted(again, pair[some]), len(again) - 1)] == pair[some]]
    some = some[np.argsort(pair[some], kind="stable")]
    keep = np.ones(len(tokens), bool)
    keep[some[1:][pair[some[1:]] == pair[some[:-1]]]] = False
    return tokens[keep], owner[keep]


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words. A text with
    fewer words has one, its whole sequence; one without words has none."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    acc = _shingles(hashes, width)
    out = []
    for s, e, c in zip(starts.tolist(), ends.tolist(), counts.tolist(), strict=True):
        if c >= width:
            own = np.sort(acc[s : e - width + 1])
            if len(own) > 1:
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
        elif c:
            own = _short(hashes[s:e])
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
    return out
