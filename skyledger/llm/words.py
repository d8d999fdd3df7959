"""Whole texts as numpy arrays, a bounded number of bytes at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes; no byte of a longer character is white space,
so bytes and characters give the same words. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

CHUNK = 4 << 20
PAD = 8
SPACES = b" \t\n\v\f\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def texts_of(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK, packed: bool = False
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts hold about ``limit`` bytes, one row at least.

    ``packed`` texts are zstd frames, counted at their full size and unpacked slice by slice.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts = texts_of(batch.column(batch.schema.get_field_index(column)))
        sizes = [zstandard.frame_content_size(t) if packed and t else len(t) for t in texts]
        begin, held = 0, 0
        for end, size in enumerate([*sizes, None]):
            if end > begin and (size is None or held + size > limit):
                part = texts[begin:end]
                yield (
                    batch.slice(begin, end - begin),
                    [unpack(t) if t else t for t in part] if packed else part,
                )
                begin, held = end, 0
            held += (size or 0) + 1


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, a line feed after each text and a few zeros at the end; starts and ends."""
    data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(PAD), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(texts)]
    return data, starts, ends


class Words:
    """The words of some texts: ``start`` and ``end`` of each, ``first`` word of each text.

    ``separators`` marks the bytes outside words, line feeds among them.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = IS_SPACE):
        self.data, self.doc_start, self.doc_end = joined(texts)
        inside = ~separators[self.data]
        inside[-PAD:] = False
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.append(np.searchsorted(self.start, self.doc_start), len(self.start))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return hash_slices(self.data, self.start, self.end)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that lets every bit reach every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each ``data[start:end]``, eight bytes at a time. ``data`` ends in padding."""
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) + _ODD)
    active, at, left = np.flatnonzero(size > 0), start[size > 0], size[size > 0]
    while len(active):
        piece = eight[at] & _LOW[np.minimum(left, 8)]
        out[active] = mix(out[active] * _ODD + piece)
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    return out


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every ``n`` consecutive items, built by doubling; ``len(h) - n + 1``."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    block, span, out, done = h, 1, None, 0
    while True:
        if n & span:
            if out is None:
                out = block
            else:
                size = len(h) - done - span + 1
                out = out[:size] * _power(span) + block[done : done + size]
            done += span
        if span * 2 > n:
            return mix(out[: len(h) - n + 1])
        size = len(h) - 2 * span + 1
        block = block[:size] * _power(span) + block[span : span + size]
        span *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ODD), n, 1 << 64))


def inside_doc(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each start of ``n`` items among ``total``: whether all lie in one text."""
    size = max(0, total - n + 1)
    return np.repeat(first[1:], np.diff(first))[:size] >= np.arange(n, size + n)


def covered(start: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` items lie in a window of ``n`` that begins at one of ``start``."""
    edge = np.bincount(start, minlength=total + 1) - np.bincount(start + n, minlength=total + 1)
    return np.cumsum(edge[:total]) > 0
