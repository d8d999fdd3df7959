"""Suffix-array dedup over bytes: strings of ``size`` bytes that occur twice anywhere go.

Every place where such a string may begin is a suffix. Suffixes travel in runs: those whose first
``size`` bytes share a minimiser n-gram are one packed string, so a bucket gets about three bytes
for each. Splitters, taken from a sample of leading
bytes spread over the whole input, range-partition the runs by the leading bytes of their n-gram
(and a hash of the n-gram deals each range to several buckets); a bucket sorts its suffixes by multikey quicksort, character
by character, where only ties go on, and compares neighbours. Equal strings hold the same n-gram
at the same place, and a splitter never parts equal leading bytes, so no pair of equal suffixes
lies on two sides of a boundary and neighbours across it need no second look.
The first character is eight bytes, the next ones are digests of blocks: equality is that of
three 64-bit digests, not of the bytes themselves.

A byte is removed if a string that covers it also begins anywhere else, in the same document or
another, overlaps included; strings are judged on the input. Null and empty texts have no bytes.
Rows that repeat each other are places of their own, so both lose what they share. Matches never
cross documents. Further columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from skyledger.llm.frames import Compute
from skyledger.llm.runs import Windows, spans, union_of, with_spans

SIZE = 400
GRAM = 16
RANGES = 64


def windows(size: int = SIZE, gram: int = GRAM) -> Windows:
    return Windows(
        size=size, gram=max(8, min(gram, size)), by_words=False, sample=16, chunk=2 << 20
    )


def _with_strings(
    docs: DataFrame, id_col: str, text: str, size: int, ddl: str, compute: Compute
) -> DataFrame:
    found = spans(docs, windows(size), False, id_col, text, RANGES)
    return with_spans(docs, found, id_col, text, ddl, compute)


def _cut(batch: pa.RecordBatch, texts: list[bytes]) -> tuple[list, list[bytes]]:
    held = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
    gone, kept = [], []
    for text, found in zip(texts, held):
        runs = union_of(found)
        gone.append(runs)
        edges = [0, *(x for r in runs for x in r), len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
    return gone, kept


def suffix_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes, removed bytes, removed runs and digest of the rest for each document."""

    def figures(batch: pa.RecordBatch, texts: list[bytes]) -> dict[str, list]:
        gone, kept = _cut(batch, texts)
        return {
            "n_bytes": [len(t) for t in texts],
            "n_removed": [sum(b - a for a, b in g) for g in gone],
            "n_spans": [len(g) for g in gone],
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
        }

    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_strings(docs, id_col, text, SIZE, ddl, figures)


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE
) -> DataFrame:
    """``docs`` with ``kept_bytes`` and the removed stretches of bytes."""

    def results(batch: pa.RecordBatch, texts: list[bytes]) -> dict[str, list]:
        gone, kept = _cut(batch, texts)
        spans_ = [[{"begin": a, "stop": b} for a, b in g] for g in gone]
        return {"kept_bytes": kept, "removed_spans": spans_}

    ddl = "kept_bytes binary, removed_spans array<struct<begin:long,stop:long>>"
    return _with_strings(docs, id_col, text, size, ddl, results)
