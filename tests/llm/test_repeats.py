"""Substring and suffix-array dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import runs, substring, suffixes
from skyledger.llm.runs import NULL_ID, Windows
from tests.llm.conftest import corpus, odd_rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_words(rows, k=50):
    """(id, text) to (words, removed, digest); equal id and text is one document."""
    first = {}
    split = [(NULL_ID if i is None else i, WORD.findall((t or "").encode())) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def brute_bytes(texts, k=400):
    texts = [(t or "").encode() for t in texts]
    times = Counter(t[j : j + k] for t in texts for j in range(len(t) - k + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - k + 1):
            if times[t[j : j + k]] > 1:
                gone[j : j + k] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_words_of_an_odd_table(odd):
    got = substring.substring_digest(odd)
    assert [c for c in got.columns if c in ("a.b", "KEPT", "tilings")] == ["KEPT", "tilings", "a.b"]
    mine = Counter(
        (r.doc_id, r.text, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()
    )
    rows = [(r[0], r[1]) for r in odd_rows()]
    theirs = Counter((i, t, *x) for (i, t), x in zip(rows, brute_words(rows)))
    assert mine == theirs
    assert sum(r[3] > 0 for r in mine) > 10


def test_bytes_of_an_odd_table(odd):
    small = odd.filter("doc_id is null or doc_id < 1003")
    got = suffixes.suffix_digest(small).collect()
    mine = Counter((r.doc_id, r.text, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    rows = [(r[0], r[1]) for r in odd_rows() if r[0] is None or r[0] < 1003]
    theirs = Counter((i, t, *x) for (i, t), x in zip(rows, brute_bytes([t for _, t in rows])))
    assert mine == theirs


def test_planted_passages_show_in_the_removed_bytes(spark):
    """60 words go from op3 if they fill 400 bytes, from op2 either way; the size tells neither."""
    long, short = (" ".join(f"{c}{i:0{n}d}" for i in range(60)) for c, n in (("p", 7), ("q", 3)))
    assert len(long) == 539 and len(short) == 299
    plant = [long] * 5 + [short] * 5 + [""] * 10
    rows = [
        (i, " ".join([*(f"a{i}.{j}" for j in range(80)), p, *(f"b{i}.{j}" for j in range(80))]))
        for i, p in enumerate(plant)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(suffixes.suffix_digest(docs).collect())
    # ".79 " before a passage and " b" after it are shared as well.
    assert [r.n_removed for r in got] == [545] * 5 + [0] * 15
    assert [r.n_bytes for r in got] == [len(t) for _, t in rows]
    mine = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got]
    assert mine == brute_bytes([t for _, t in rows])
    words = sorted(substring.substring_digest(docs).collect())
    assert [r.n_removed for r in words] == [0, *[60] * 4, 0, *[60] * 4, *[0] * 10]


def test_a_text_longer_than_a_chunk_is_cut_without_loss(odd, monkeypatch):
    """Every window lies in just one piece."""
    small = Windows(size=40, gram=8, by_words=False, sample=4, chunk=700)
    monkeypatch.setattr(suffixes, "windows", lambda size: small)
    rows = [(i, t) for i, t in enumerate(corpus(7, 30))]
    df = odd.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.suffix_digest(df).collect()
    mine = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    assert mine == {(i, *x) for (i, _), x in zip(rows, brute_bytes([t for _, t in rows], 40))}


@pytest.mark.parametrize("hot", [0, 1, 2])
def test_any_order_of_grams_gives_the_same_windows(hot):
    """Each window lies in one run, whichever n-grams rank last."""
    texts = [t.encode() for t in corpus(5, 12)]
    for w in (Windows(50, 5, True), Windows(400, 16, False, 16), Windows(6, 2, True, 2)):
        grams = np.unique(runs.Units(texts, w).grams)
        some = [grams[:0], grams[::3], grams][hot]
        found = runs.runs_of(texts, w, some)
        seen = defaultdict(list)
        for s, d, at in zip(found.strings(), found.doc, found.place):
            seen[int(d)] += range(int(at), int(at) + runs.window_count(s, w))
        for d, t in enumerate(texts):
            total = len(WORD.findall(t)) if w.by_words else len(t)
            assert sorted(seen[d]) == list(range(max(0, total - w.size + 1)))


def test_empty_table_and_texts_kept_whole(nothing, spark):
    assert substring.substring_digest(nothing).count() == 0
    assert suffixes.suffix_digest(nothing).count() == 0
    a = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (2, "x  y\n" + a), (3, " p  q ")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring.substring_dedup(df).collect()}
    assert got[1].kept_text == a and got[3].kept_text == " p  q "
    assert (got[2].kept_text, got[2].n_removed) == ("x y", 60)
    assert [tuple(s) for s in got[2].removed_spans] == [(2, 62)]
    cut = {r.doc_id: r for r in suffixes.suffix_dedup(df.filter("doc_id = 3")).collect()}
    assert bytes(cut[3].kept_bytes) == b" p  q " and cut[3].removed_spans == []


def test_many_equal_rows_without_id(spark):
    """Their spans are kept once, not once for each pair of row and place."""
    text = " ".join(f"w{i}" for i in range(120))
    other = "x " + text
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    one = spark.createDataFrame([(5, other), (None, "lone")], "doc_id long, text string")
    docs = rows.unionByName(one)
    found = runs.spans(docs, suffixes.windows(), False, "doc_id", "text").collect()
    assert max(len(r["__spans"]) for r in found) < 40
    got = substring.substring_digest(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(None, 120, 120, 100_000), (5, 121, 0, 1), (None, 1, 0, 1)}
    got = suffixes.suffix_digest(docs).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    size = len(text)
    assert {tuple(r) for r in got} == {(None, size, 1, 100_000), (5, size, 1, 1), (None, 0, 0, 1)}


@pytest.mark.parametrize("period", ["x", "ab", "wort "])
def test_long_text_of_a_short_period(spark, period):
    text = period * (5_000_000 // len(period))
    docs = spark.createDataFrame([(1, text), (2, period * 90), (3, "y" * 399)], "doc_id long, text string")
    found = {r["__id"]: r["__spans"] for r in runs.spans(docs, suffixes.windows(), False, "doc_id", "text").collect()}
    assert len(found[1]) < 500
    got = {r.doc_id: r for r in suffixes.suffix_digest(docs).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (len(text), 1)
    assert got[2].n_removed == (450 if len(period) == 5 else 0) and got[3].n_removed == 0
    words = {r.doc_id: r for r in substring.substring_digest(docs).collect()}
    assert words[1].n_removed == 0
    assert words[2].n_removed == (90 if period == "wort " else 0)
