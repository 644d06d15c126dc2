"""Words of Arrow text columns as 64-bit hashes, computed with numpy over flat byte arrays.

Words are runs of bytes outside `[\\x20\\x09-\\x0D]` with A-Z in lower case. A word's hash is a polynomial over
its bytes modulo 2**64, read off running sums, so the work is a few passes over the bytes and long texts are
taken in windows of bounded size.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SHINGLE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(_BASE, WINDOW + 1)
_INVERSE = _powers(_BASE_INVERSE, WINDOW + 1)


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `most` bytes of the text column; one text is never cut."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; a word never crosses an offset."""
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    cut[0] = cut[-1] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | cut[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | cut[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of all texts."""
    return _spans(data, offsets) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (one more entry at the end)."""
    data, offsets = buffers(texts)
    found, counts = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    at, size = 0, len(data)
    while at < size:
        end = min(size, at + WINDOW)
        while end < size:  # not inside a word
            tail = np.flatnonzero(_SPACE[data[at:end]])
            border = offsets[np.searchsorted(offsets, end, "right") - 1]
            stop = max(at + int(tail[-1]) + 1 if len(tail) else at, int(border))
            if stop > at:
                end = stop
                break
            end = min(size, at + 2 * (end - at))
        piece = data[at:end]
        lo, hi = np.searchsorted(offsets, [at, end])
        starts, ends = _spans(piece, offsets[lo:hi + 1][offsets[lo:hi + 1] <= end] - at)
        if len(starts):
            n = len(piece)
            power, inverse = (_POWERS, _INVERSE) if n <= WINDOW else (_powers(_BASE, n), _powers(_BASE_INVERSE, n))
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[piece] * power[:n], out=sums[1:])
            found.append(mix((sums[ends] - sums[starts]) * inverse[starts]))
            counts += np.bincount(np.searchsorted(offsets, starts + at, "right") - 1, minlength=len(counts))
        at = end
    first = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=first[1:])
    return np.concatenate(found) if found else np.zeros(0, np.uint64), first


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the array is n - 1 shorter."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out += words[k:k + m] * _SHINGLE[k]
    return mix(out + np.uint64(n))


def shingle_sets(texts: pa.Array, size: int):
    """For each text its distinct shingle hashes, sorted; a text with fewer words has its whole sequence as one."""
    words, first = word_hashes(texts)
    grams = ngram_hashes(words, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(grams[a:b - size + 1])
        elif b > a:
            yield ngram_hashes(words[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
