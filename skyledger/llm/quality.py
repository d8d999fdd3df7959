"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the n-grams that occur twice or more in a text;
the rules bound the share of a text's word characters inside them, and inside repeated lines.
Texts are read whole, a few MB at a time; nothing is shuffled. Windows that hash alike are
compared word by word (64-bit hashes of whole words) before they count as equal.

Null and empty texts have no words, zero counts, and fail the base rule. Equal rows get equal
results. Columns of the input other than id and text take no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame

from skyledger.llm.frames import add_columns
from skyledger.llm.words import Words, chunks, covered, inside_doc, mix, rolled

#: Share of word characters that may lie inside n-grams (in words) found twice or more.
COVERAGE = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: Share of characters that may lie inside lines found twice or more.
LINE_COVERAGE = 0.40
BASE_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, line_coverage double, gram_coverage map<int,double>"
)


def repeated_words(words: Words, hashes: np.ndarray, n: int) -> np.ndarray:
    """Whether each word lies in a window of ``n`` words found twice or more in its text."""
    total = len(hashes)
    if total < n:
        return np.zeros(total, bool)
    doc = np.repeat(np.arange(len(words.counts), dtype=np.uint64), words.counts)
    begin = np.flatnonzero(inside_doc(words.first, n, total))
    key = mix(rolled(hashes, n)[begin] ^ mix(doc[begin] + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key, begin = key[order], begin[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    for i in range(n):
        same = same[hashes[begin[same] + i] == hashes[begin[same + 1] + i]]
    same = same[doc[begin[same]] == doc[begin[same + 1]]]
    return covered(np.unique(np.concatenate([begin[same], begin[same + 1]])), n, total)


def _lines(text: bytes) -> tuple[int, float]:
    """Lines with a word that equal an earlier one; share of characters in repeated lines."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\v\f\r")]
    if len(lines) < 2 or len(set(lines)) == len(lines):
        return 0, 0.0
    times = Counter(lines)
    size = {x: len(x.decode("utf-8", "replace")) for x in times}
    inside = sum(size[x] * n for x, n in times.items() if n > 1)
    return len(lines) - len(times), inside / sum(size[x] * n for x, n in times.items())


def measure(texts: list[bytes], limits: Mapping[int, float] = COVERAGE) -> dict[str, list]:
    """All figures and the verdict, a list entry for each text."""
    words = Words(texts)
    hashes, first = words.hashes(), words.first
    begins = (words.data & 0xC0) != 0x80  # of characters
    chars = np.concatenate([[0], np.cumsum(begins)])
    size = chars[words.end] - chars[words.start]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate([[0], np.cumsum(symbol[words.data])])

    def per_text(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[first[1:]] - total[first[:-1]]

    n_words, word_chars = words.counts, per_text(size)
    lines = [_lines(t) for t in texts]
    shares, repeat = {}, None
    for n in sorted({*limits, BASE_WINDOW}):
        inside = repeated_words(words, hashes, n)
        if n == BASE_WINDOW:
            repeat = per_text(inside.astype(np.int64))
        if n in limits:
            shares[n] = per_text(size * inside) / np.maximum(word_chars, 1)
    base = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PCT * n_words)
    kept = ~base & (np.array([x[1] for x in lines]) <= LINE_COVERAGE)
    for n, share in shares.items():
        kept &= share <= limits[n]
    return {
        "n_words": n_words.tolist(),
        "word_chars": word_chars.tolist(),
        "n_symbols": (symbols[words.doc_end] - symbols[words.doc_start]).tolist(),
        "n_dup_lines": [x[0] for x in lines],
        "n_repeat_words": repeat.tolist(),
        "base_failed": base.tolist(),
        "kept": kept.tolist(),
        "line_coverage": [x[1] for x in lines],
        "gram_coverage": [list(zip(shares, map(float, s))) for s in zip(*shares.values())],
    }


def quality_rules(
    docs: DataFrame, text: str = "text", limits: Mapping[int, float] = COVERAGE
) -> DataFrame:
    """``docs`` with figures and verdict; a column of the same name is replaced."""
    return add_columns(docs, text, SCHEMA, lambda _, texts: measure(texts, limits))
