"""Vectorised word scanning and hashing over UTF-8 buffers (numpy).

A batch of texts is one byte buffer and its offsets, as Arrow keeps them.
Words are the runs ``[^\\x20\\x09-\\x0D]+`` inside one text; their hashes come
from prefix sums of a polynomial over the bytes, so no Python object is made
per word.  The buffer is scanned in pieces of about ``PIECE`` bytes, cut at
word ends, so temporary memory does not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
#: Bytes up to which a polynomial names a segment.  Of longer ones unlike segments of equal polynomials can be
#: written down, whatever the base, so those are named by a cryptographic digest.
SHORT = 64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def _mix_int(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RAW = np.array([_mix_int(i + 1) for i in range(256)], dtype=np.uint64)
_FOLDED = _RAW.copy()
_FOLDED[65:91] = _RAW[97:123]  # A-Z hash as a-z
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < a power of two over n."""
    size = max(2 * PIECE, 1 << max(n - 1, 0).bit_length())
    if size > 2 * PIECE:  # one segment longer than a piece: not kept
        return _powers_upto(size)
    if size not in _POWERS:
        _POWERS[size] = _powers_upto(size)
    return _POWERS[size]


def _powers_upto(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.ones(size, dtype=np.uint64)
        done = 1
        step = base
        while done < size:  # doubling: p[done:2 done] = p[:done] * base**done
            p[done:2 * done] = p[:done] * np.uint64(step)
            step = step * step & MASK
            done *= 2
        out.append(p)
    return out[0], out[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    return data[base:int(offsets[-1])] if len(offsets) else data[:0], offsets - base


def _cuts(data: np.ndarray, offsets: np.ndarray, piece: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``piece`` bytes that end at a text's end or at a space."""
    total = len(data)
    at = 0
    while at < total:
        end = min(total, at + piece)
        if end < total:
            k = int(np.searchsorted(offsets, end, side="right")) - 1
            if int(offsets[k]) > at:
                end = int(offsets[k])  # a text starts here
            else:  # inside one long text: on to its next space or its end
                stop = int(offsets[k + 1])
                while end < stop:
                    near = np.flatnonzero(SPACE[data[end:min(stop, end + piece)]])
                    if len(near):
                        end += int(near[0])
                        break
                    end = min(stop, end + piece)
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False,
          piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, index of each text's first word).

    The second array has one entry more than there are texts.  ``fold``
    lower-cases A-Z.
    """
    hashes, first = [np.empty(0, np.uint64)], np.zeros(len(offsets), np.int64)
    for a, b in _cuts(data, offsets, piece):
        h, s, _ = _scan(data, offsets, a, b, fold)
        hashes.append(h)
        first += np.searchsorted(s + a, offsets, side="left")
    return np.concatenate(hashes), first


def words_at(data: np.ndarray, offsets: np.ndarray, fold: bool = False,
             piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, and the byte positions where each word starts and ends."""
    hashes, starts, ends = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in _cuts(data, offsets, piece):
        h, s, e = _scan(data, offsets, a, b, fold)
        hashes.append(h)
        starts.append(s + a)
        ends.append(e + a)
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(start, offsets, side="left"), start, np.concatenate(ends)


def _scan(data: np.ndarray, offsets: np.ndarray, a: int, b: int,
          fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = data[a:b]
    n = len(part)
    solid = ~SPACE[part]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offsets[np.searchsorted(offsets, a, "right"):np.searchsorted(offsets, b, "left")] - a
    begin[inner] = solid[inner]
    finish = solid.copy()
    finish[:-1] &= ~solid[1:]
    finish[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return _segment_hash(part, n, starts, ends, fold), starts, ends


def _segment_hash(part: np.ndarray, n: int, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_FOLDED if fold else _RAW)[part] * power[:n], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * inverse[starts])
    for i in np.flatnonzero(ends - starts > SHORT):
        raw = part[starts[i]:ends[i]].tobytes()
        out[i] = int.from_bytes(blake2b(raw.lower() if fold else raw, digest_size=8).digest(), "little")
    return out


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, has a word, code points, text index) of every ``\\n``-split line."""
    breaks = np.flatnonzero(data == 10)
    texts = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    # a break belongs to the text that holds it; each text has one line more than breaks
    owner = np.concatenate([np.arange(texts), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    end_owner = np.concatenate([owner_of(offsets, breaks), np.arange(texts)])
    ends = ends[np.lexsort((ends, end_owner))]
    hashes = np.empty(len(starts), np.uint64)
    worded = np.empty(len(starts), bool)
    chars = np.empty(len(starts), np.int64)
    at = 0
    while at < len(starts):  # whole lines, about PIECE bytes at a time
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        a, b = int(starts[at]), int(ends[to - 1])
        part = data[a:b]
        s, e = starts[at:to] - a, ends[at:to] - a
        hashes[at:to] = _segment_hash(part, b - a, s, e, False)
        solid = np.zeros(b - a + 1, np.int64)
        np.cumsum(~SPACE[part], out=solid[1:])
        worded[at:to] = solid[e] > solid[s]
        points = np.zeros(b - a + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=points[1:])
        chars[at:to] = points[e] - points[s]
        at = to
    return hashes, worded, chars, owner


def owner_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, side="right") - 1


def count_in_texts(flags_at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of the sorted byte positions ``flags_at`` inside each text."""
    return np.diff(np.searchsorted(flags_at, offsets, side="left"))


def ngrams(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rolling hash, start word) of every n-word window that lies in one text."""
    m = len(word) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    owner_end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(m) + n <= owner_end[:m])
    roll = np.zeros(m, np.uint64)
    for j in range(n):
        roll = roll * np.uint64(BASE) + word[j:j + m]
    return mix(roll[at]), at


def shingle_sets(word: np.ndarray, first: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-word shingle hashes.

    A text with fewer words gives its whole sequence as the only shingle, one
    without words the empty set.
    """
    roll, at = ngrams(word, first, n)
    bounds = np.searchsorted(at, first, side="left")
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= n:
            yield np.unique(roll[bounds[i]:bounds[i + 1]])
        elif b > a:
            h = b - a
            for w in word[a:b]:
                h = (h * BASE + int(w)) & MASK
            yield np.array([_mix_int(h)], np.uint64)
        else:
            yield np.empty(0, np.uint64)


#: Rows of a slice at most.
ROWS = 1 << 15


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most ``ROWS`` rows and ``limit`` bytes of text (one row at least)."""
    texts = batch.column(batch.schema.get_field_index(column))
    _, offsets = utf8(texts)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, at + ROWS)
        yield batch.slice(at, to - at)
        at = to
