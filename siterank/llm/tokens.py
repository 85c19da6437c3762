"""Words of many texts at once, as numbers: whole Arrow batches are handled as arrays of bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_draw = np.random.default_rng(20)
_BYTE = _draw.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _draw.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without NULLs, and where each value starts (one more than there are values)."""
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    if data is None or not len(wide):
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    starts = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of every word: runs of bytes other than space and \\t to \\r, never across two texts."""
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.append(False, word[:-1])
    begin = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.append(word[1:], False)
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z: a random multiplier for every place, mixed with the length."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    word = np.zeros(len(data), np.int32)
    word[begin[1:]] = 1
    np.cumsum(word, out=word)
    place = np.arange(len(data)) - begin[word]
    value = _BYTE[_LOWER[data]]
    value *= _PLACE[place & 4095]
    inside = (place >= 0) & (place < length[word])
    value[~inside] = 0
    out = mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(length > 4096):  # places repeat: such a word is hashed on its own
        whole = _LOWER[data[begin[i] : end[i]]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
    return out


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first): the distinct shingles of `width` words of all texts, sorted within each text, as 52-bit
    hashes; text i has tokens[first[i]:first[i + 1]]. With fewer words the whole sequence is one; no words, none."""
    texts = len(starts) - 1
    begin, end, text = word_bounds(data, starts)
    hashes = word_hashes(data, begin, end)
    counts = np.bincount(text, minlength=texts)
    first_word = np.cumsum(counts) - counts
    of = np.maximum(counts - width + 1, np.minimum(counts, 1))
    which = np.repeat(np.arange(texts), of)
    at = first_word[which] + np.arange(len(which)) - np.repeat(np.cumsum(of) - of, of)
    value = np.zeros(len(which), np.uint64)
    last = first_word + counts
    for k in range(width):
        there = at + k < last[which]
        value[there] = mix(value[there] * np.uint64(0x9E3779B97F4A7C15) + hashes[(at + k)[there]])
    # at most 4096 texts are sorted in one go: the upper 12 bits tell them apart
    tokens, first = [], np.zeros(texts + 1, np.int64)
    for low in range(0, texts, 4096):
        part = (which >= low) & (which < low + 4096) if texts > 4096 else slice(None)
        keys = (value[part] >> np.uint64(12)) | ((which[part] - low).astype(np.uint64) << np.uint64(52))
        keys.sort()
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        tokens.append(keys & np.uint64((1 << 52) - 1))
        own = np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=min(4096, texts - low))
        first[low + 1 : low + 1 + len(own)] = own
    return (np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)), np.cumsum(first)
