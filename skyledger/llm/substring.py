"""Substring dedup: words of passages that an earlier document holds are removed.

Windows of ``size`` consecutive words travel as super-k-mers: consecutive windows that share a
minimiser are one packed string, sent to the minimiser's bucket, where sorting finds every window
and the least id that holds it (``runs``). A word goes if a window over it also begins in a
document of lower id; windows are judged on the input, not on what is left. Equal windows are told
by three 64-bit digests of blocks of whole-word hashes.

Null and empty texts have no words and keep nothing. Texts shorter than a window stay whole. Rows
that share id and text are one document; a null id counts as later than all others, and rows with
null ids do not remove from each other. Further columns pass through; those named like a result
are replaced. Words that stay are joined by one space where anything was removed, and the text is
left as it is elsewhere (``kept_text``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyledger.llm.frames import Compute
from skyledger.llm.runs import Windows, spans, union_of, with_spans

SIZE = 50
GRAM = 5


def windows(size: int = SIZE, gram: int = GRAM) -> Windows:
    return Windows(size=size, gram=min(gram, size), by_words=True)


def _with_passages(
    docs: DataFrame, id_col: str, text: str, size: int, ddl: str, compute: Compute
) -> DataFrame:
    found = spans(docs, windows(size), True, id_col, text)
    return with_spans(docs, found, id_col, text, ddl, compute)


def _kept(batch: pa.RecordBatch, texts: list[bytes]) -> tuple[list, list, list[list[bytes]]]:
    held = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
    total, removed, kept = [], [], []
    for text, found in zip(texts, held):
        words = text.split()
        total.append(len(words))
        if found:
            left = np.ones(len(words), bool)
            for a, b in union_of(found):
                left[a:b] = False
            words = [words[i] for i in np.flatnonzero(left)]
        removed.append(total[-1] - len(words))
        kept.append(words)
    return total, removed, kept


def substring_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, removed words and digest of the rest for each document."""

    def figures(batch: pa.RecordBatch, texts: list[bytes]) -> dict[str, list]:
        total, removed, kept = _kept(batch, texts)
        digest = [hashlib.sha256(b" ".join(x)).hexdigest() for x in kept]
        return {"n_words": total, "n_removed": removed, "kept_sha256": digest}

    ddl = "n_words long, n_removed long, kept_sha256 string"
    return _with_passages(docs, id_col, text, SIZE, ddl, figures)


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_removed`` and the removed stretches of words."""

    def results(batch: pa.RecordBatch, texts: list[bytes]) -> dict[str, list]:
        _, removed, kept = _kept(batch, texts)
        held = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
        return {
            "kept_text": [
                (b" ".join(w) if n else t).decode("utf-8", "replace")
                for t, w, n in zip(texts, kept, removed)
            ],
            "n_removed": removed,
            "removed_spans": [
                [{"begin": a, "stop": b} for a, b in union_of(found)] for found in held
            ],
        }

    ddl = "kept_text string, n_removed long, removed_spans array<struct<begin:long,stop:long>>"
    return _with_passages(docs, id_col, text, size, ddl, results)
