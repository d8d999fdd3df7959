"""Token counts: Viterbi over a unigram vocabulary, without forming the pieces.

Aho-Corasick enumerates every vocabulary piece inside a segment, end by end; dynamic programming
carries the best score of a prefix and the number of pieces on its path. Tie rules are those of the
unigram tokenizer: of equal scores the path whose last piece begins first wins; a character that is
no piece costs ten less than the lowest score; unknown characters become their bytes where the
model falls back on them, else neighbouring ones count as one. Only normal pieces match: the names
of control, unknown and byte pieces are ordinary text.

A space is written as the mark U+2581 and one mark is put in front. If no piece has a mark after
another character, texts fall apart before such marks without changing the best path, so segments
are words, and a worker counts each different word once (``CACHED`` at most are remembered; the
result does not depend on it). The vocabulary is the only thing broadcast.

Null and empty texts have no pieces and score 0. A text without spaces is one segment, which takes
17 bytes a character. Equal rows get equal counts. Further columns pass
through; those named like a result are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from skyledger.llm.frames import add_columns

MARK = "▁"
CACHED = 400_000
UNKNOWN_PENALTY = 10.0
NO_MATCH = (-1, None)


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces that text may match, with their scores, and whether unknown characters become bytes.

    Control, unknown, byte and unused pieces of a sentencepiece model match no text.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    other = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    pieces = [
        (model.id_to_piece(i), model.get_score(i)) for i in ids if not any(is_(i) for is_ in other)
    ]
    return pieces, sum(map(model.is_byte, ids)) == 256


class Counter:
    """Counts pieces of texts under one vocabulary."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]], byte_fallback: bool = False):
        self.matches = ahocorasick.Automaton()
        self.single: set[str] = set()
        for piece, score in vocabulary:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        self.matches.make_automaton()
        names = {p for p, _ in vocabulary}
        self.as_bytes = byte_fallback
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        crossing = re.compile(f"[^{MARK}]{MARK}")
        known = MARK in self.single or self.as_bytes  # else an unknown mark may join others
        self.by_words = known and not any(crossing.search(p) for p in names)
        self.cache: dict[str, tuple[int, float]] = {}

    def segment(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path through a marked text: 17 bytes a character."""
        n = len(text)
        score = array("d", bytes(8 * n + 8))
        pieces = array("q", bytes(8 * n + 8))
        fused = bytearray(n + 1)  # the path ends in an unknown character
        single, unknown = self.single, self.unknown
        matches = self.matches.iter(text)  # by their ends
        end, match = next(matches, NO_MATCH)
        for e in range(1, n + 1):
            best, start, known = None, 0, True
            while end == e - 1:  # longest first, so the earliest start wins ties
                size, s = match
                end, match = next(matches, NO_MATCH)
                candidate = score[e - size] + s
                if best is None or candidate > best:
                    best, start = candidate, e - size
            if text[e - 1] not in single:
                candidate = score[e - 1] + unknown
                if best is None or candidate > best:
                    best, start, known = candidate, e - 1, False
            score[e] = best
            if known:
                pieces[e] = pieces[start] + 1
            elif self.as_bytes:
                pieces[e] = pieces[start] + len(text[start].encode("utf-8", "replace"))
            else:
                pieces[e] = pieces[start] + (not fused[start])
            fused[e] = not known
        return pieces[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        if not self.by_words:
            return self.segment(marked)
        if MARK + MARK in marked:
            parts = re.findall(f"{MARK}+[^{MARK}]*", marked)
        else:
            parts = marked.split(MARK)[1:]
            parts = [MARK + p for p in parts]
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        total, score = 0, 0.0
        for p in parts:
            got = cache.get(p)
            if got is None:
                got = cache[p] = self.segment(p)
            total += got[0]
            score += got[1]
        return total, score


_counters: dict[int, Counter] = {}


def _counter(held) -> Counter:
    """One for each worker process, not for each task."""
    if held.id not in _counters:
        _counters.clear()
        _counters[held.id] = Counter(*held.vocabulary.value)
    return _counters[held.id]


class _Held:
    def __init__(self, vocabulary):
        self.vocabulary = vocabulary
        pieces, byte_fallback = vocabulary.value
        self.id = hash((tuple(pieces), byte_fallback))


def token_counts(
    docs: DataFrame,
    vocabulary: Sequence[tuple[str, float]],
    byte_fallback: bool = False,
    text: str = "text",
) -> DataFrame:
    """``docs`` with ``n_pieces`` and ``score``, the best path's log weight.

    ``vocabulary`` holds the pieces that text may match. With ``byte_fallback`` an unknown
    character counts as many pieces as it has bytes.
    """
    context = docs.sparkSession.sparkContext
    held = _Held(context.broadcast((list(vocabulary), byte_fallback)))

    def compute(_: pa.RecordBatch, texts: list[bytes]) -> dict[str, list]:
        counter = _counter(held)
        got = [counter.count(t.decode("utf-8", "replace")) for t in texts]
        return {"n_pieces": [g[0] for g in got], "score": [g[1] for g in got]}

    return add_columns(docs, text, "n_pieces long, score double", compute)
