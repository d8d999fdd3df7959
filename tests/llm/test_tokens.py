import random
from pathlib import Path

import pytest
from tokenizers import Tokenizer, models

from skyledger.llm.queries import TOKENIZERS
from skyledger.llm.tokens import MARK, Counter, read_vocabulary, token_counts
from tests.llm.conftest import odd_rows

MODEL = str(Path(TOKENIZERS, "piece_bpe_32k.model"))


BYTES = [(f"<0x{b:02X}>", 0.0) for b in range(256)]


def reference(vocabulary, byte_fallback):
    """The tokenizer itself. It matches names of special pieces, so texts must not hold them."""
    special = [("<unk>", 0.0)] + BYTES * byte_fallback
    t = Tokenizer(models.Unigram(special + list(vocabulary), unk_id=0, byte_fallback=byte_fallback))
    return lambda text: len(t.encode(MARK + text.replace(" ", MARK)).ids) if text else 0


def test_counts_of_an_odd_table(odd, nothing):
    vocabulary, byte_fallback = read_vocabulary(MODEL)
    want = reference(vocabulary, byte_fallback)
    small = odd.filter("doc_id is null or doc_id != 1004")
    got = token_counts(small, vocabulary, byte_fallback)
    rows = got.collect()
    assert len(rows) == sum(r[0] != 1004 for r in odd_rows())
    for r in rows:
        assert r.n_pieces == want(r.text or "")
    assert token_counts(nothing, vocabulary).count() == 0


@pytest.mark.parametrize("crossing", [False, True])
def test_ties_unknowns_and_marks(crossing):
    """Small vocabularies with equal scores and few letters, against the tokenizer."""
    rng = random.Random(6)
    for _ in range(150):
        letters = "abc" + MARK
        pieces = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(12)}
        if not crossing:
            pieces = {p for p in pieces if MARK not in p[1:]} | {MARK}
        vocabulary = [(p, -float(rng.randrange(1, 4))) for p in sorted(pieces)]
        counter, want = Counter(vocabulary), reference(vocabulary, False)
        assert counter.by_words == (MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces))
        for _ in range(20):
            text = "".join(rng.choice("abcd é ") for _ in range(rng.randrange(0, 14)))
            assert counter.count(text)[0] == want(text), (vocabulary, text)


def test_the_score_is_the_best_of_all_paths():
    vocabulary = [("<unk>", 0.0), (MARK + "a", -1.0), ("a", -2.0), ("ab", -2.5), ("b", -1.0), (MARK, -3.0)]
    counter = Counter(vocabulary)

    def best(text):
        if not text:
            return 0.0
        options = [best(text[len(p) :]) + s for p, s in vocabulary[1:] if text.startswith(p)]
        return max(options) if options else -1e9

    for text in ("ab", "aab", "abab b", "bbaa a"):
        assert counter.count(text)[1] == best(MARK + text.replace(" ", MARK))


def test_names_of_special_pieces_are_text():
    """What the encoder's rules say: control, unknown and byte pieces match no text."""
    vocabulary, byte_fallback = read_vocabulary(MODEL)
    names = {p for p, _ in vocabulary}
    assert byte_fallback and not names & {"<s>", "</s>", "<unk>", "<0x41>"}
    counter = Counter(vocabulary, byte_fallback)
    scores = dict(vocabulary)

    def best(text):
        """Pieces of the best path; the one whose last piece begins first wins ties."""
        got = [(0.0, 0)]
        for e in range(1, len(text) + 1):
            paths = [(got[b][0] + scores[text[b:e]], -b) for b in range(e) if text[b:e] in scores]
            score, b = max(paths)
            got.append((score, got[-b][1] + 1))
        return got[-1][1]

    for text in ("a<s>b", "q<0x41>", "b<unk>c", "</s> <s>", "<0xZZ><0x41"):
        assert counter.count(text)[0] == best(MARK + text.replace(" ", MARK)) >= 4


def test_columns_named_like_results(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, N_Pieces string, score int")
    got = token_counts(docs, [("a", -1.0), ("b", -1.0), (MARK, -1.0)])
    assert sorted(c.lower() for c in got.columns) == ["doc_id", "n_pieces", "score", "text"]
    assert got.select("n_pieces", "score").first() == (4, -4.0)
