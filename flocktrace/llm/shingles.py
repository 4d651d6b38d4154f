"""Words and word shingles of whole Arrow batches.

Words are told apart by their bytes: Arrow's dictionary encoding numbers the distinct ones of a batch.  Where words of
different batches meet, hashes of 64 bits stand for them; each byte enters with its place in the word, through a function
that mixes both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; longer texts are looked at on their own.
CHUNK = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all 64 bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def placed(values: np.ndarray, places: np.ndarray | int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each value at its place; sums of such hashes tell sequences apart."""
    salt = np.uint64((seed * 0xC2B2AE3D27D4EB4F + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    return mixed(mixed(values.astype(np.uint64) + salt) + np.asarray(places).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column, and the offsets between them; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def blanks(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last byte of each word; ends are the offsets between texts."""
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    word = ~blanks(data)
    first = np.zeros(n + 1, dtype=bool)
    first[ends[:-1]] = True
    starts = word.copy()
    starts[1:] &= first[1:-1] | ~word[:-1]
    stops = word.copy()
    stops[:-1] &= first[1:-1] | ~word[1:]
    return np.flatnonzero(starts), np.flatnonzero(stops) + 1


def numbered(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each span of bytes the number of its content, and the distinct contents; spans are in order and do not overlap."""
    if not len(starts):
        return np.empty(0, dtype=np.int64), pa.array([], pa.large_binary())
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts] = 1
    edge[stops] -= 1
    held = np.ascontiguousarray(data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)])
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
    return made.indices.to_numpy(), made.dictionary


def hashes(contents: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string of bytes."""
    data, ends = texts_of(contents.cast(pa.large_binary()).view(pa.large_string())) if len(contents) else (np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64))
    lengths = np.diff(ends)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(placed(data, np.arange(len(data)) - np.repeat(ends[:-1], lengths), seed), out=sums[1:])
    return mixed(sums[ends[1:]] - sums[ends[:-1]] + lengths.astype(np.uint64))


def runs(values: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `size` values, the values being hashes or numbers."""
    out = np.zeros(max(0, len(values) - size + 1), dtype=np.uint64)
    for k in range(size):
        out += placed(values[k : k + len(out)], k + 1, seed)
    return mixed(out)


def shingle_sets(column: pa.Array, size: int, fold: bool = True) -> Iterator[np.ndarray]:
    """For each string its distinct shingles as sorted 64-bit hashes.

    A shingle is a run of `size` words; a text with fewer words has one, of all its words; one without words, or null, has
    none.  fold takes A-Z as a-z.  Hashes of 64 bits stand for shingles: two different ones of a corpus of 10**6 shingles
    collide with a chance of 3 in 10**8.
    """
    data, ends = texts_of(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
        own, text_ends = data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        if fold:
            own = own + 32 * ((own >= 65) & (own <= 90)).astype(np.uint8)
        starts, stops = spans(own, text_ends)
        codes, contents = numbered(own, starts, stops)
        known = hashes(contents)
        # each distinct word is mixed once for each place that it can have in a shingle
        words = [placed(known, k + 1)[codes] for k in range(size)]
        bounds = np.searchsorted(starts, text_ends)
        made = np.zeros(max(0, len(codes) - size + 1), dtype=np.uint64)
        for k, word in enumerate(words):
            made += word[k : k + len(made)]
        made = mixed(made)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= size:
                yield np.unique(made[lo : hi - size + 1])
            elif hi > lo:
                yield mixed(np.array([sum(int(words[k][lo + k]) for k in range(hi - lo)) + hi - lo & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))
            else:
                yield np.empty(0, dtype=np.uint64)
        at = to
