import random
import re

import numpy as np
import pytest
import xxhash

from skyledger.llm import simhash
from skyledger.llm.components import components
from tests.llm.conftest import odd_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = WORD.findall((text or "").translate(LOWER))
    parts = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, distance=4):
    """Least index reachable, for each value."""
    label = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= distance:
                x, y = label[i], label[j]
                label = [min(x, y) if z in (x, y) else z for z in label]
    return label


def test_an_odd_table(odd):
    got = simhash.simhash_digest(odd)
    rows = sorted({(r[0] if r[0] is not None else 1 << 62, r[1]) for r in odd_rows()}, key=str)
    rows.sort(key=lambda r: r[0])
    prints = [brute(t) for _, t in rows]
    label = classes(prints)
    want = {}
    for (i, t), f, c in zip(rows, prints, label):
        real = lambda x: None if x == 1 << 62 else x
        want.setdefault(real(i), set()).add((f"{f:016x}", real(rows[c][0])))
    mine = {}
    for r in got.collect():
        mine.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert mine == want
    assert got.count() == len(odd_rows())


@pytest.mark.parametrize("block", [4, 4096])
def test_links_of_clustered_points(spark, monkeypatch, block):
    """Points around a few centres, chains included; cells larger than a block are cut."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    points = set()
    for centre in rng.integers(0, 1 << 63, 6):
        at = int(centre)
        for _ in range(25):
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                at ^= 1 << int(bit)
            points.add(at)
    points |= {int(x) for x in rng.integers(0, 1 << 63, 60)} | {0, 1, 0xFF, (1 << 64) - 1}
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.grid_links(df, len(points))
    for r in links.collect():
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 64
    root = {r.node: r.root for r in components(links).collect()}
    label = classes(points)
    mine = [root.get(p, p) for p in signed]
    pairs = {(a, b) for a, b in zip(mine, label)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_manhattan_distance_never_exceeds_the_bits():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    half = np.uint64(0x5555555555555555)

    def unary(x):
        y = x >> np.uint64(1)
        return ((x | y) & half) | ((x & y & half) << np.uint64(1))

    counts = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * s)) & np.uint64(3)) for s in range(32)])
    manhattan = np.abs(counts(a).astype(int) - counts(b)).sum(axis=0)
    assert (np.bitwise_count(unary(a) ^ unary(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    df = spark.createDataFrame([*chain, chain[0]], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1050)}}
    assert components(df.filter("false")).count() == 0


def test_one_of_each_group_stays(odd, nothing):
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns
    ids = [r.component_id for r in simhash.simhash_digest(odd).select("component_id").distinct().collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(ids)
    assert simhash.simhash_digest(nothing).count() == 0
    assert simhash.simhash_dedup(nothing).count() == 0


def test_unlinked_texts_that_share_an_id_all_stay(spark):
    rng = random.Random(6)
    texts = [" ".join(words(rng, 40, 5000)) for _ in range(9)]
    label = classes([brute(t) for t in texts])
    assert label == list(range(9))
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0])]  # only null ids
    rows += [(5, texts[4]), (5, texts[5]), (6, texts[5]), (7, texts[6]), (7, texts[6])]
    rows += [(3, texts[7]), (None, texts[7]), (3, texts[8])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in simhash.simhash_dedup(df).collect()]
    ids = [None] * 4 + [5, 5, 7, 3, 3]
    assert sorted(kept, key=str) == sorted(zip(ids, texts), key=str)
