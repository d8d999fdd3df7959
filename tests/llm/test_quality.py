import re
from collections import Counter

from skyledger.llm.quality import COVERAGE, LINE_COVERAGE, quality_rules
from tests.llm.conftest import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(w, n):
    grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    times = Counter(grams)
    return {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + n)}


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, w))
    dup = len(repeated(w, 8))
    base = len(w) < 20 or 100 * dup > 30 * len(w)
    times = Counter(lines)
    size = sum(map(len, lines))
    share = sum(len(x) for x in lines if times[x] > 1) / size if size else 0.0
    if len(times) == len(lines):
        share = 0.0
    kept = not base and share <= LINE_COVERAGE
    for n, most in COVERAGE.items():
        inside = sum(len(w[j]) for j in repeated(w, n))
        kept = kept and inside / max(chars, 1) <= most
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), chars, symbols, len(lines) - len(times), dup, base, kept


def test_figures_and_verdicts(odd):
    got = quality_rules(odd)
    assert got.columns.count("n_words") == 1 and "KEPT" not in got.columns
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    mine = Counter((r.doc_id, r.text, *(r[n] for n in names)) for r in got.collect())
    assert mine == Counter((r[0], r[1], *brute(r[1])) for r in odd_rows())
    assert {r[-1] for r in mine} == {True, False}


def test_repetition_below_the_base_window_is_caught(spark):
    five = "one two three four five "
    rest = [f"x{i} y{i} " for i in range(12)]
    text = "".join(five + r for r in rest)
    row = quality_rules(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert (row.base_failed, row.kept) == (False, False)
    assert row.gram_coverage[5] > 0.4 and row.gram_coverage[8] == 0.0


def test_empty_table(nothing):
    assert quality_rules(nothing).count() == 0
