"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import connect
from skyledger.llm import spelling
from skyledger.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, min_length=5, min_count=3, ratio=2, noise=None):
    counts = Counter()
    for name, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if name is None else name}:{word}".encode())
            if noise and h % noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= min_length and c >= min_count}
    gaps = {}
    for w in n:  # words that share one deletion, or of which one is the other's deletion
        for key in {(w, -1)} | {(w[:i] + w[i + 1 :], i) for i in range(len(w))}:
            gaps.setdefault(key[0], set()).add(w)
    found = {w: set() for w in n}
    for group in gaps.values():
        for a in group:
            found[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(found[w]), form[w], n.get(form[w]), root))
    return out


def got(df):
    rows = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), max_size=25), st.sampled_from(["", "pre"]))
def test_sweep_finds_every_near_pair(words, start):
    words = sorted(start + w for w in words)
    pairs = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words))]
    right = {(i, j) for i, j in pairs if near(words[i], words[j])}
    seen = list(spelling.near_pairs(words))
    assert {(i, j) for i, j, _ in seen} == right and len(seen) == len(right)
    assert all(words[i][:at] == words[j][:at] for i, j, at in seen)


def corpus(seed, n, letters="abcdé", longest=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, longest)))
    pool = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        text = []
        for _ in range(rng.randrange(60)):
            w = rng.choice(pool)
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice(letters), w[at] + "x"]) + w[at + 1 :]
            text.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(rng.choice([" ", "-", "\n", "ß ", "日"]).join(text))
    return list(enumerate(texts))


@pytest.mark.parametrize("bucket", [1, 3, 256])
def test_against_every_pair(spark, bucket):
    rows = corpus(5, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(spelling.spelling_variants(df, noise=5, bucket=bucket)) == expected(rows, noise=5)


def test_one_hot_bucket_is_cut(spark):
    """All words share their ends, so that only smaller stretches tell them apart."""
    rng = random.Random(2)
    words = {"anfang" + "".join(rng.choice("abc") for _ in range(6)) + "ende" for _ in range(300)}
    rows = [(0, " ".join(sorted(words) * 3)), (1, " ".join(sorted(words)[::3]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = spelling.vocabulary(df)
    sizes = spelling.buckets(words, 5, 20).groupBy(*spelling.PLACE).count().collect()
    assert max(r["count"] for r in sizes) < 100 and any(r["hi"] - r["lo"] <= 2 for r in sizes)
    assert got(spelling.spelling_variants(df, bucket=20)) == expected(rows)


def test_odd_table(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    clashing = odd.withColumnsRenamed({"source": "word", "lang": "root", "n_words": "form"})
    right = expected(rows, min_length=1, noise=3)
    assert right and got(spelling.spelling_variants(clashing, min_length=1, noise=3)) == right
    assert spelling.spelling_variants(nothing).count() == 0
    assert spelling.spelling_variants(odd.filter("text is null")).count() == 0


def test_very_long_words_and_ties(spark):
    def rows(times):
        long = "langes" * times
        ties = "haus häus hause hauss hausa " * 4
        return [(1, f"{long} {long[:-1]} " * 3), (2, long), (None, ties)]

    df = spark.createDataFrame(rows(50_000), "doc_id long, text string")
    longer = lambda w: w.replace("langes" * 3, "langes" * 49_998, 1) if w else w
    right = {
        (longer(w), n, n_near, longer(form), form_n, longer(root))
        for w, n, n_near, form, form_n, root in expected(rows(5), min_length=4)
    }
    assert got(spelling.spelling_variants(df, min_length=4)) == right


def test_chains_of_forms(spark):
    words = {"aaaaaa": 3, "aaaaab": 6, "aaaabb": 12, "aaabbb": 24, "aabbbb": 48, "abbbbb": 96}
    rows = [(i, f"{w} " * n) for i, (w, n) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = got(spelling.spelling_variants(df))
    assert found == expected(rows) and {r[-1] for r in found} == {"abbbbb"}


def test_query_on_the_whole_table(spark, sf):
    rows = connect(sf).execute("SELECT doc_id, text FROM documents").fetchall()
    assert got(QUERIES["op12_spelling_variants"](spark, sf)) == expected(rows, noise=97)
