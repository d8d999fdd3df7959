import random
import re

import numpy as np

from skyledger.llm import decontaminate as dc
from tests.llm.conftest import odd_rows, words

TOKEN = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")


def split(text):
    return TOKEN.findall((text or "").lower())


def brute_tiles(doc, item, n=5):
    """Longest common stretch of unmarked tokens, marked again and again."""
    n = min(n, len(item))
    free_d, free_i = [True] * len(doc), [True] * len(item)
    tiles = []
    while True:
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while (
                    i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]
                    and free_d[i + k] and free_i[j + k]
                ):
                    k += 1
                if k >= max(n, 1) and (best is None or k > best[2]):
                    best = i, j, k
        if best is None:
            return tiles
        i, j, k = best
        free_d[i : i + k] = [False] * k
        free_i[j : j + k] = [False] * k
        tiles.append(best)


def tilings(texts, item, least):
    """Figures of one item in each text, by the seeds of both."""
    own, _ = dc.tokens([item])
    size = len(own)
    n = min(dc.MATCH, size)
    asked = dc.grams(own, n)
    out = []
    for text in texts:
        seeds = dc.grams(dc.tokens([text])[0], n)
        both = np.intersect1d(seeds, asked)
        shared = [(np.flatnonzero(seeds == s), np.flatnonzero(asked == s)) for s in both]
        found = [t[2] for t in dc.pair_tiles(shared, n, size, least * size)]
        out.append(
            [{"item_id": 1, "item_tokens": size, "matched": sum(found), "tiles": len(found),
              "longest": max(found)}] if found else []
        )
    return out


def test_tiles_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        item = [f"t{rng.randrange(6)}" for _ in range(rng.randrange(5, 40))]
        doc = [f"t{rng.randrange(6)}" for _ in range(rng.randrange(0, 60))]
        at = rng.randrange(len(item))
        doc = doc + item[at:] + doc[:7] + item[:at]
        texts = [" ".join(doc).encode()]
        want = brute_tiles(doc, item)
        got = tilings(texts, " ".join(item).encode(), 0.0)[0]
        if not want:
            assert not got
            continue
        assert got[0]["matched"] == sum(t[2] for t in want)
        assert (got[0]["tiles"], got[0]["longest"]) == (len(want), max(t[2] for t in want))


def benchmark(rng):
    items = [(i, " ".join(words(rng, rng.randrange(15, 60), 3000))) for i in range(30)]
    items += [(30, "only three Words"), (31, None), (32, ""), (33, items[3][1]), (None, items[4][1])]
    return items


def planted(rng, items):
    docs = []
    for i, text in items[:20]:
        t = text.split()
        third = len(t) // 3
        noise = lambda n: words(rng, n, 3000)
        kind = i % 5
        if kind == 0:
            t = noise(30) + t + noise(30)
        elif kind == 1:  # in another order, apart
            t = t[2 * third :] + noise(9) + t[:third] + noise(9) + t[third : 2 * third]
        elif kind == 2:  # other case and punctuation
            t = noise(5) + [x.upper() + "," for x in t]
        elif kind == 3:  # too little
            t = noise(40) + t[: max(5, int(0.4 * len(t)))] + noise(10)
        else:
            t = noise(100)
        docs.append((i, " ".join(t)))
    docs += [(100, "Is it only THREE words, then?"), (101, None), (102, ""), (None, items[0][1])]
    return docs + [docs[0], docs[0]]


def test_whole_tables_against_brute_force(spark):
    rng = random.Random(8)
    items = benchmark(rng)
    docs = planted(rng, items)
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in docs:
        for i, u in items:
            if split(u):
                tiles = brute_tiles(split(t), split(u))
                matched = sum(x[2] for x in tiles)
                if matched >= dc.COVERAGE * len(split(u)):
                    want.append((d, i, len(split(u)), matched, len(tiles)))
    got = dc.contamination(a, b).collect()
    mine = [(r.doc_id, r.item_id, r.item_tokens, r.matched, r.tiles) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    hit = {r[0] for r in want}
    assert {i for i in range(20) if i % 5 < 3} <= hit
    assert not {i for i in range(20) if i % 5 > 2} & hit
    held = dc.with_tilings(a, b).filter("size(tilings) > 0")
    assert sum(len(r.tilings) for r in held.collect()) == len(want)
    clean = dc.decontaminate(a, b)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(20) if i % 5 > 2] + [101, 102]


def test_odd_and_empty_tables(odd, nothing, spark):
    rows = odd_rows()
    items = spark.createDataFrame([(7, rows[0][1]), (8, None)], "item_id int, text string")
    got = dc.decontaminate(odd, items)
    assert got.columns == odd.columns and got.count() < odd.count()
    assert dc.contamination(nothing, items).count() == 0
    assert dc.contamination(odd, items.filter("false")).count() == 0
    assert dc.decontaminate(odd, items.filter("item_id = 8")).count() == odd.count()


def test_repeated_passages_cost_little():
    item = " ".join(f"a{i}" for i in range(40))
    got = tilings([(" ".join([item] * 2000)).encode()], item.encode(), 0.5)[0]
    assert got == [{"item_id": 1, "item_tokens": 40, "matched": 40, "tiles": 1, "longest": 40}]
    assert np.array_equal(dc.tokens([b"", b"x"])[1], [0, 0, 1])


def test_short_items_leave_clean_documents(spark):
    rng = random.Random(5)
    around = lambda t: " ".join([*words(rng, 40), t, *words(rng, 40)])
    items = [
        (1, "Paris"),
        (2, "TRUE"),
        (3, "What is the capital of France?"),
        (4, "in the middle of the road they met someone"),
        (5, "one of the most"),
        (6, None),
        (7, ""),
        (8, "a b c d e f g h i j k l m n o p"),
    ]
    clean = [
        around("we saw Paris in spring and it is true"),
        around("So what is the capital of Spain?"),
        around("a fire in the middle of the night"),
        around("one of the most important"),
        around("a b c d e f g"),
        "Paris is one of the most beautiful cities and that is true",
    ]
    dirty = [
        (around("what is the capital of france"), 3),
        (around("In the middle of the road, they met"), 4),
        (around(items[3][1]), 4),
        (around("a b c d e f g h"), 8),
        ("Paris!", 1),
        ("One of the most", 5),
    ]
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(100 + i, t) for i, (t, _) in enumerate(dirty)]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in dc.contamination(a, b).collect())
    want = [(100 + i, item) for i, (_, item) in enumerate(dirty)]
    assert got == want
    left = [r.doc_id for r in dc.decontaminate(a, b).collect()]
    assert sorted(left) == list(range(len(clean)))
    short = {r.item_id: r.item_tokens for r in dc.short_items(b).collect()}
    assert short == {1: 1, 2: 1, 5: 4, 6: 0, 7: 0}


def test_rarest_seeds_miss_no_text_that_covers_enough():
    rng = random.Random(9)
    for _ in range(300):
        n, size = rng.randrange(1, 5), rng.randrange(5, 30)
        values = [rng.randrange(12) for _ in range(size - n + 1)]
        texts = [set(rng.sample(range(12), rng.randrange(0, 12))) for _ in range(20)]
        docs = {v: sum(v in t for t in texts) for v in values}
        place = [i for i, v in enumerate(values) if docs[v]]
        need = rng.randrange(0, size + 1)
        chosen = dc.rarest(
            np.array(place, int), np.array([values[i] for i in place], int),
            np.array([docs[values[i]] for i in place], int), size, n, need,
        )
        for text in texts:
            covered = {i + x for i, v in enumerate(values) if v in text for x in range(n)}
            if covered and len(covered) >= need:
                assert text & set(chosen.tolist())


def test_common_passages_and_many_copies(spark):
    rng = random.Random(12)
    common = " ".join(f"answer{i}" for i in range(9))
    items = [(i, common + " " + " ".join(words(rng, 30, 5000))) for i in range(40)]
    items += [(100 + i, items[0][1]) for i in range(50)]
    docs = [(i, common + " " + " ".join(words(rng, 60, 5000))) for i in range(200)]
    docs += [(1000 + i, items[0][1] + " tail") for i in range(100)]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(a, b).collect()
    assert len(got) == 100 * 51 and {r.doc_id for r in got} == {1000 + i for i in range(100)}
    assert dc.decontaminate(a, b).count() == 200
    asked = dc.item_seeds(b.select("text"))
    assert asked.select("item_key").distinct().count() == 40
    met = dc.text_seeds(a.select("text"), dc.seed_filter(asked), [5])
    pairs = dc.candidates(met, asked, dc.COVERAGE, dc.MATCH, dc.EVIDENCE)
    assert pairs.count() == 1  # the passage that all share brings no pair together


def test_long_repeats_and_clashing_names(spark):
    item = " ".join(["tick"] * 60 + ["tock"] * 8)
    rows = [(1, " ".join(["tick"] * 30_000), 5, 0.5), (2, item, 6, None), (3, None, 7, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, tilings double")
    items = spark.createDataFrame([(1, item), (2, "none of it is here at all today")], "item_id long, text string")
    want = [(1, 60, 1), (2, 68, 1)]
    got = sorted((r.doc_id, r.matched, r.tiles) for r in dc.contamination(docs, items).collect())
    assert got == want
    held = dc.with_tilings(docs, items)
    assert held.columns == ["doc_id", "text", "key", "tilings"]
    assert sorted(len(r.tilings) for r in held.collect()) == [0, 1, 1]
    kept = dc.decontaminate(docs, items).collect()
    assert [tuple(r) for r in kept] == [rows[2]]
