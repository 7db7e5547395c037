"""Word and shingle hashes of whole texts, vectorised over the bytes of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: bytes of text taken at once; a longer text is a batch of its own
BATCH_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit words over all others (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below ``length``."""
    if len(_powers[0]) < length:
        size = max(length, 2 * BATCH_BYTES)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, factor in enumerate((_BASE, inverse)):
            table = np.full(size, factor, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def batches(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, encoded texts) of consecutive runs of about ``BATCH_BYTES``."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if run and size + len(raw) > BATCH_BYTES:
            yield first, run
            first, run, size = i, [], 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def sliced(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of (id, text) batches in runs of about ``BATCH_BYTES`` of text, so that a worker holds few texts as objects.

    What the runs of a batch used is given back before the next batch is read.
    """
    for part in parts:
        ends = np.cumsum(pa.compute.binary_length(part.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        first = 0
        while first < part.num_rows:
            used = ends[first - 1] if first else 0
            past = max(int(np.searchsorted(ends, used + BATCH_BYTES, side="right")), first + 1)
            yield part.slice(first, past - first)
            first = past
        pa.default_memory_pool().release_unused()


def word_hashes(raws: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where each text's words begin.

    Words are runs of bytes other than space and 0x09-0x0D; with ``lower``, A-Z count as
    a-z. The second array has one more entry than there are texts.
    """
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    white = _WHITE[data]
    before = np.empty_like(white)
    before[0], before[1:] = True, white[:-1]
    begins = np.flatnonzero(before & ~white)
    ends = np.flatnonzero(white & ~before)
    sizes = np.fromiter((len(raw) + 1 for raw in raws), np.int64, len(raws))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    powers, inverses = _power_tables(len(data))
    table = _BYTE[_LOWER] if lower else _BYTE
    sums = np.cumsum(table[data] * powers[: len(data)], dtype=np.uint64)
    low = np.where(begins > 0, sums[begins - 1], np.uint64(0))
    hashes = (sums[ends - 1] - low) * inverses[begins]
    return mix(hashes ^ (ends - begins).astype(np.uint64)), np.searchsorted(begins, starts)


def shingle_sets(raws: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``width`` words.

    A text with fewer words has its whole sequence as its one shingle; one without any
    word has none.
    """
    words, bounds = word_hashes(raws)
    steps = np.resize(_STEPS, width) + np.arange(width, dtype=np.uint64) * np.uint64(2)
    count = len(words) - width + 1
    runs = np.zeros(max(count, 0), np.uint64)
    for k in range(width):
        if count > 0:
            runs += words[k: k + count] * steps[k]
    runs = mix(runs)
    for begin, end in zip(bounds[:-1], bounds[1:]):
        if end - begin >= width:
            yield np.unique(runs[begin: end - width + 1])
        elif end > begin:
            short = np.full(1, end - begin, np.uint64)
            for k in range(begin, end):
                short = mix(short * _STEPS[0] + words[k])
            yield short
        else:
            yield np.zeros(0, np.uint64)
