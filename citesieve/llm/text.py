"""Whole texts as byte arrays: words, word shingles and per-document sets, for use inside Spark tasks.

Everything here works on one Arrow slice of a megabyte; Spark decides which rows a task gets.
A null text counts as an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 14
U64 = np.uint64

# ASCII white space is 0x20 and 0x09-0x0D; A-Z are lowered, no other letter is.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is no letter or digit parts words here; bytes of other characters never do.
NO_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random 64-bit value for each byte, so that sums of bytes say little about the text.
_BYTE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (wraps around, as unsigned numbers do)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the n + 1 places where they begin and end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a slice have at most ``limit`` bytes (and 16,384 rows); a longer text is a slice alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(ends, before + limit, "right"))))
            yield batch.slice(at, to - at)
            at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of its first word (n + 1 values)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~parts[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | begins[1:-1]
    last[:-1] &= ~solid[1:] | begins[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


#: Spans longer than this are hashed one by one; there are few of them to a megabyte.
_LONG_SPAN = 128


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes wherever they stand.

    Eight bytes at a time go through ``mix``, which no pattern in the text can cancel out.
    """
    sizes = (ends - starts).astype(np.int64)
    out = mix(sizes.astype(np.uint64) + _BASE)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))
    todo = np.flatnonzero((sizes > 0) & (sizes <= _LONG_SPAN))
    done = 0
    while len(todo):
        left = sizes[todo] - done
        chunk = at[starts[todo] + done]
        short = np.minimum(left, 8).astype(np.uint64)
        chunk = chunk & (~U64(0) >> (U64(64) - U64(8) * short))
        out[todo] = mix(out[todo] * _BASE + chunk)
        todo, done = todo[left > 8], done + 8
    for k in np.flatnonzero(sizes > _LONG_SPAN).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and the text (its number) of each; a text of 1 to n - 1 words has one run, all of it."""
    texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found, owner = [], []
    if len(words) >= n:
        runs = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            runs = mix(runs * _BASE + words[k : len(words) - n + 1 + k])
        whole = texts[: len(runs)] == texts[n - 1 :]
        found.append(runs[whole])
        owner.append(texts[: len(runs)][whole])
    counts = np.diff(first)
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        if len(short):
            runs = np.full(len(short), m, np.uint64)
            for k in range(m):
                runs = mix(runs * _BASE + words[first[short] + k])
            found.append(runs)
            owner.append(short)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owner)


def shingle_sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, text after text in ascending order, and the n + 1 places where texts begin."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    runs, owner = shingles(span_hashes(data, starts, ends), first, n)
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    runs, owner = runs[new], owner[new]
    return runs, np.searchsorted(owner, np.arange(len(offsets)))


def ragged(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """An Arrow column of lists: from place begins[i], lengths[i] values. Unsigned numbers become signed ones of their size."""
    ends = np.cumsum(lengths)
    take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - lengths), lengths)
    values = values[take]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.view(f"i{values.itemsize}")))
