import random
import re
from collections import Counter, defaultdict

from skyledger.llm.packing import best_fit, best_fit_packing, conflict_masks
from tests.llm.conftest import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_best_fit(sizes, tags, capacity):
    """Tightest bin that has room and shares no tag; of equal ones the oldest."""
    bins, out = [], []
    for size, tag in zip(sizes, tags):
        fits = [
            (room, b) for b, (room, held) in enumerate(bins) if room >= size and not held & tag
        ]
        if fits:
            room, b = min(fits)
        else:
            room, b = capacity, len(bins)
            bins.append((capacity, set()))
        out.append((b, capacity - room))
        bins[b] = room - size, bins[b][1] | tag
    return out


def test_best_fit_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n, capacity = rng.randrange(0, 60), rng.randrange(5, 40)
        sizes = [rng.randrange(1, capacity + 1) for _ in range(n)]
        sources = [rng.choice([None, "hot", "hot", "a", "b"]) for _ in range(n)]
        clusters = [rng.choice([None, rng.randrange(6), rng.randrange(100)]) for _ in range(n)]
        tags = [
            ({("s", s)} if s else set()) | ({("c", c)} if c is not None else set())
            for s, c in zip(sources, clusters)
        ]
        masks = conflict_masks(sources, clusters)
        assert best_fit(sizes, masks, capacity) == brute_best_fit(sizes, tags, capacity)


def check(pieces, rows, capacity):
    """Every word of every row once, bins within bounds, no conflict in a bin."""
    want = Counter()
    for i, t, *_ in rows:
        n = len(WORD.findall(t or ""))
        want.update([(i, p, p * capacity, min(capacity, n - p * capacity)) for p in range(-(-n // capacity))])
        if not n:
            want[i, 0, 0, 0] += 1
    assert Counter((r.doc_id, r.piece, r.first_word, r.n_words) for r in pieces) == want
    bins = defaultdict(list)
    for r in pieces:
        assert (r.bin is None) == (r.n_words == 0)
        if r.bin is not None:
            bins[r.bin].append(r)
    source, text = {r[0]: r[3] for r in rows}, {r[0]: r[1] for r in rows}
    for held in bins.values():
        held.sort(key=lambda r: r.place)
        assert [r.place for r in held] == [sum(x.n_words for x in held[:k]) for k in range(len(held))]
        assert {r.bin_words for r in held} == {sum(r.n_words for r in held)}
        assert sum(r.n_words for r in held) <= capacity
        known = [source[r.doc_id] for r in held if source[r.doc_id] is not None]
        assert len(known) == len(set(known))
        texts = [text[r.doc_id] for r in held]
        assert len(texts) == len(set(texts))


def test_an_odd_table(odd, nothing):
    for capacity, group in ((64, 4096), (300, 8), (100_000, 4096)):
        got = best_fit_packing(odd, capacity=capacity, group=group)
        check(got.collect(), odd_rows(), capacity)
    assert best_fit_packing(nothing).count() == 0


def test_the_same_rows_give_the_same_bins(odd):
    a = best_fit_packing(odd, capacity=200).collect()
    b = best_fit_packing(odd.repartition(5), capacity=200).collect()
    assert Counter(a) == Counter(b)


def test_a_named_cluster(spark):
    rows = [(i, f"t{i} " * 3, None, i % 2 if i < 6 else None) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, near int")
    got = best_fit_packing(df, cluster="near", capacity=12).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.bin].append(rows[r.doc_id][3])
    for held in bins.values():
        known = [c for c in held if c is not None]
        assert len(known) == len(set(known))
