"""Words, word shingles and their sets as 64-bit fingerprints, a slice of texts at a time.

Words are runs of bytes other than space and the control characters 9 to 13, with A-Z
in lower case. A fingerprint is a hash of 64 bits: two different shingles of a
document, or of a pair that is compared, get the same one with a chance of about
(number of shingles)^2 / 2^65, below 1e-11 for texts of 20,000 words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_CHUNK = 250_000
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_END = np.zeros(256, bool)
_END[[33, 46, 63]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Hashes of all words of a slice, the first word of each text (and the end), line and sentence of each word."""

    hashes: np.ndarray
    first: np.ndarray
    line: np.ndarray | None = None
    ends: np.ndarray | None = None


def _chunks(data: np.ndarray):
    """Byte ranges of about _CHUNK that end after a space, so that no word is cut."""
    start = 0
    while start < len(data):
        end = min(start + _CHUNK, len(data))
        while end < len(data):
            spaces = np.flatnonzero(_SPACE[data[end : end + _CHUNK]])
            if len(spaces):
                end += int(spaces[0]) + 1
                break
            end = min(end + _CHUNK, len(data))
        yield start, end
        start = end


def words(texts: pa.Array, places: bool = False) -> Words:
    """The words of all texts (a string array); null texts have none. With ``places``: also lines and sentence ends."""
    texts = texts.fill_null("")
    # one space after each text keeps words of neighbours apart
    joined = pa.compute.binary_join_element_wise(texts, pa.scalar(""), pa.scalar(" ")) if len(texts) else texts
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    _, offsets, values = joined.buffers() if len(joined) else (None, None, None)
    wide = pa.types.is_large_string(joined.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    hashes, starts, ends, lines, line = [], [], [], [], 0
    for a, b in _chunks(data):
        part = data[a:b]
        inside = ~_SPACE[part]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        begin = np.flatnonzero(edge == 1)
        if places:
            new = np.cumsum(part == 10) + line
            if len(part):
                lines.append(new[begin])
                line = int(new[-1])
        if not len(begin):
            continue
        stop = np.flatnonzero(edge == -1)
        if len(stop) < len(begin):
            stop = np.append(stop, len(part))
        size = stop - begin
        place = np.arange(len(part))
        place[begin[0] :] -= np.repeat(begin, np.diff(np.append(begin, len(part))))
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _STEP[0], np.uint64)]))
        value = _BYTE[part]
        value[~inside] = 0
        value *= power[np.minimum(place, len(power) - 1)]
        hashes.append(mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * _STEP[1]))
        starts.append(begin + a)
        if places:
            ends.append(_END[part[stop - 1]])
    empty = np.zeros(0, np.uint64)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    found = Words(np.concatenate(hashes) if hashes else empty, np.searchsorted(start, offsets))
    if places:
        found.line = np.concatenate(lines) if lines else np.zeros(0, np.int64)
        found.ends = np.concatenate(ends) if ends else np.zeros(0, bool)
    return found


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``k`` words, unit by unit, and where each unit's begin.

    ``first``: the first word of each unit, and the end. A unit of fewer words, but
    at least one, has one: its whole sequence.
    """
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], made) + np.arange(begin[-1])
    left = np.repeat(counts, made)
    value = np.zeros(len(at), np.uint64)
    last = len(hashes) - 1
    for j in range(k):
        here = hashes[np.minimum(at + j, last)] * _STEP[2 + j]
        value += here if j == 0 else np.where(left > j, here, np.uint64(0))
    return mix(value + np.minimum(left, k).astype(np.uint64) * _STEP[1]), begin


def sets(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each unit's distinct fingerprints in ascending order, all in a row, and where each unit's begin."""
    out = [np.unique(values[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int64)


def set_names(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit name of each unit's set (values as from ``sets``); 0 for empty sets."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ _STEP[7]))])
    size = np.diff(begin)
    name = mix(total[begin[1:]] - total[begin[:-1]] + size.astype(np.uint64) * _STEP[1])
    return np.where(size > 0, name, np.uint64(0)).view(np.int64)


def lists(values: np.ndarray, begin: np.ndarray) -> pa.ListArray:
    """Runs of 64-bit values as lists of longs."""
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values.view(np.int64)))
