"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from checks.compare import connect
from skyledger.llm import tries
from skyledger.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth int, `a.b` string"
FIELDS = [f.name for f in tries.struct(tries.NODE)]


def turn_id(role, text):
    role = role or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text or ''}".encode()).digest()[:16]


def expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = (turn is not None, turn or 0, (role or "").encode(), turn_id(role, text))
            own[conv].append((key, (role or "", text or "")))
    own = {c: [said for _, said in sorted(t, key=lambda x: x[0])] for c, t in own.items()}
    members = defaultdict(list)
    children = defaultdict(set)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        opener = c - int(c - 20 * int(c / 20))
        full[c] = tuple(own.get(opener, [])[:h] + turns[h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
            if d:
                children[full[c][: d - 1]].add(full[c][:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if full[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append(
            (min(convs), len(node), parent, len(convs), len(children[node]), leaves[node],
             saved[node], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def got(df):
    assert df.columns == FIELDS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)


def talks(seed, n, kinds=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "bot"]), f"say {rng.randrange(kinds)} " * rng.randrange(3)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [1, 4, 1024])
def test_against_a_dictionary(spark, most):
    rows = talks(1, 150)
    assert got(tries.prefix_trie(frame(spark, rows), most)) == expected(rows)


@pytest.mark.parametrize("most", [2, 1024])
def test_copies_and_growing_logs(spark, most):
    """A hot conversation, and one that is logged again after each turn: deep heads that burst."""
    rows = [(c, t, "user", f"hello {t}") for c in range(0, 400, 20) for t in range(4)]
    rows += [(c, t, "user", f"hello {t}") for c in range(1000, 1300) for t in range(5)]
    rows += [(5000 + 20 * n, t, "user", f"log {t}") for n in range(40) for t in range(n + 1)]
    assert got(tries.prefix_trie(frame(spark, rows), most)) == expected(rows)


@pytest.mark.parametrize("most", [1, 1024])
def test_odd_rows(spark, most):
    rows = [
        (None, 1, "user", "lost"), (None, None, None, None),
        (1, None, "user", "first"), (1, 0, None, None), (1, 0, "a", None), (1, 0, "a", None),
        (1, 0, "", "a"), (2, 3, "user", "a b c d\x0b e"), (2, 3, "user", "a"), (0, 1, "user", "x " * 200_000),
        (0, 0, "us", "erx"), (0, 0, "user", "x"), (-7, 1, "u", "t"), (-7, 2, "u", "t"), (-20, 5, "u", "t"),
        (43, 0, "u", "only"), (44, 0, "u", "only"), (45, 0, "u", "only"), (46, 0, "u", "only"),
    ]
    assert got(tries.prefix_trie(frame(spark, rows), most)) == expected(rows)


def test_empty_and_turnless(spark):
    assert tries.prefix_trie(frame(spark, [])).count() == 0
    assert tries.prefix_trie(frame(spark, [(None, 1, "u", "t")])).count() == 0
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "u", "t")]  # its opener is absent and its own first three turns go
    assert got(tries.prefix_trie(frame(spark, rows))) == expected(rows)
    assert len(expected(rows)) == 1


def test_a_long_conversation_and_short_runs(spark, monkeypatch):
    rows = [(20, t, "user", f"turn {t % 7}") for t in range(20_000)]
    rows += [(21, t, "user", f"turn {t % 7}") for t in range(19_000)]
    found = {tuple(r) for r in tries.prefix_trie(frame(spark, rows)).collect()}
    top = [r for r in found if r[1] == 0]
    assert top == [(20, 0, None, 2, 1, 1, 19_000 * 2, tries.NO_ENDS)]
    assert len(found) == 20_001
    convs = tries.conversations(frame(spark, talks(3, 90, kinds=1, longest=3)))
    one, many = (
        sorted((tuple(map(str, r)) for r in tries.sequences(convs, n).collect())) for n in (2, 4096)
    )
    assert one == many


def test_query_on_the_whole_table(spark, sf):
    rows = connect(sf).execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert got(QUERIES["op11_prefix_trie"](spark, sf)) == expected(rows)
