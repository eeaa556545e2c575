"""Words of whole texts as numpy arrays (shared by the text operators).

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; these bytes
never occur inside a multi-byte UTF-8 character, so splitting bytes splits
characters too.  A batch of texts is one byte buffer with document offsets;
no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most text bytes worked on at once; a single longer text is worked on alone.
BLOCK_BYTES = 8 << 20

_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xBF58476D1CE4E5B9)
_C3 = np.uint64(0x94D049BB133111EB)


class Words(NamedTuple):
    """Words of consecutive texts: byte spans in ``buf`` and the first word of each text."""

    buf: np.ndarray      # uint8, 16 zero bytes longer than the text
    starts: np.ndarray   # int64, first byte of each word
    ends: np.ndarray     # int64, byte after each word
    first: np.ndarray    # int64, len(texts) + 1: words of text i are first[i]:first[i+1]
    offsets: np.ndarray  # int64, len(texts) + 1: bytes of text i are offsets[i]:offsets[i+1]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null: empty) and the texts' offsets in them."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array, letters: np.ndarray | None = None, lower: bool = False) -> Words:
    """Word spans of every text; ``letters`` (256 booleans) says which bytes words consist of, ``lower`` makes A-Z a-z."""
    raw, offsets = text_buffer(texts)
    n = len(raw)
    buf = np.zeros(n + 16, np.uint8)
    buf[:n] = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32) if lower else raw
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~((raw == 32) | ((raw >= 9) & (raw <= 13))) if letters is None else letters[raw]
    begin = inside[:n].copy()
    begin[1:] &= ~inside[: n - 1] if n else inside[:0]
    edges = offsets[(offsets > 0) & (offsets < n)]      # a text's first byte begins a word
    begin[edges] |= inside[edges]
    finish = inside[:n] & ~inside[1:]
    finish[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(finish) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, offsets), offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time."""
    eight = np.ndarray((len(w.buf) - 7,), "<u8", w.buf.data, strides=(1,))
    length = w.ends - w.starts
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    h = mix(length.astype(np.uint64) * _C1 ^ (eight[w.starts] & masks[np.minimum(length, 8)]))
    at = np.flatnonzero(length > 8)
    done = 8
    while len(at):
        chunk = eight[w.starts[at] + done] & masks[np.minimum(length[at] - done, 8)]
        h[at] = mix(h[at] * _C1 ^ chunk)
        done += 8
        at = at[length[at] > done]
    return h


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``most`` text bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(int(np.searchsorted(ends, before + most, "right")), at + 1)
            yield batch.slice(at, stop - at)
            at = stop
