"""Hashes of the words of whole texts, by column."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def hashed_words(texts: pa.Array, clean: Callable[[str], str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's
    begin (one more offset than texts).  Words are runs without ASCII white
    space, with A-Z in lower case; ``clean`` may change a word, and words that
    it empties are left out.  Each distinct word is hashed once."""
    # bytes.lower() changes A-Z alone; the array is built anew, not sliced.
    raw = [t.lower() if t else b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    lowered = pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer(at), pa.py_buffer(b"".join(raw)))
    lists = pc.ascii_split_whitespace(lowered)
    bounds = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    if clean:
        distinct = map(clean, distinct)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in distinct), np.uint64, len(coded.dictionary))
    hashes = own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)
    real = hashes != 0
    before = np.concatenate([[0], np.cumsum(real)])
    return hashes[real], before[bounds - bounds[0]]


def mix(x: np.ndarray) -> np.ndarray:
    """An invertible scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_runs(words: np.ndarray, taken: list[int]) -> np.ndarray:
    """For each place with room, a hash of the words at the offsets ``taken``
    from there, in order."""
    n = max(0, len(words) - taken[-1])
    out = np.zeros(n, np.uint64)
    for k in taken:
        out = mix(out * _MULTIPLY + words[k: k + n])
    return out
