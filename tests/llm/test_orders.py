"""Hilbert sharding and training order."""

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import tiktoken

from skyledger.llm import materialise, shards
from skyledger.llm.queries import TOKENIZERS
from tests.llm.conftest import odd_rows

RANKS = Path(TOKENIZERS, "byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("dims, bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_step_by_step(dims, bits):
    grid = np.indices([1 << bits] * dims).reshape(dims, -1).T
    index = shards.hilbert_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    assert (path[0] == 0).all()


def test_shards_of_an_odd_table(odd, nothing):
    got = shards.hilbert_shards(odd)
    rows = got.collect()
    texts = [(r[0], (r[1] or "").encode()) for r in odd_rows()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len(t) + 8, zlib.crc32(t)) for i, t in texts
    )
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in ordered] == sorted(r.hilbert for r in rows)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert shards.hilbert_shards(nothing).count() == 0
    few = shards.hilbert_shards(odd.filter("doc_id < 5 and doc_id != 1"))
    assert sorted(r.slot for r in few.collect()) == [0] * few.count()


def test_written_shards_hold_the_documents(odd, tmp_path):
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).select(
        "doc_id", "text", "lang", "source"
    )
    placed = shards.hilbert_shards(unique)
    path = str(tmp_path / "sharded")
    shards.write_sharded(unique, placed, path)
    back = odd.sparkSession.read.parquet(path)
    assert back.count() == unique.count()
    assert back.select("doc_id", "shard", "slot").exceptAll(
        placed.select("doc_id", "shard", "slot")
    ).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_keyed_bijection(n):
    seen = [materialise.feistel(np.arange(n), n, key) for key in (0, 1, -7)]
    for slots in seen:
        assert sorted(slots) == list(range(n))
    if n > 100:
        assert (seen[0] != seen[1]).mean() > 0.9


def test_feistel_one_by_one():
    """The network in plain integers."""
    top = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ x >> 27) * 0x94D049BB133111EB & top
        return x ^ x >> 31

    def slot(x, n, key):
        half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            for i in range(1, materialise.ROUNDS + 1):
                left, right = right, left ^ mix((right + mix((i + key) & top)) & top) & mask
            x = left << half | right
            if x < n:
                return x

    for n in (7, 300):
        assert materialise.feistel(np.arange(n), n, 99).tolist() == [slot(i, n, 99) for i in range(n)]


def encoding():
    return materialise.Encoder(RANKS.read_bytes())


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", " a b", "a  b", "a \n b", "it's 'll x", "é 日本  x", "a  b", "\ta b ",
     "x  y", "a 1 b22 !! ??x", "\x1c a", "a \x85b", "one two\nthree four"],
)
def test_ids_are_those_of_the_whole_text(text):
    encoder = encoding()
    for t in (text, text * 3):
        assert np.frombuffer(encoder.packed(t), "<u2").tolist() == encoder.own.encode_ordinary(t)


def test_sequences_of_an_odd_table(odd, nothing, tmp_path, spark):
    ranks = RANKS.read_bytes()
    small = odd.filter("doc_id is null or doc_id != 1004")
    got = materialise.training_order(small, ranks, key=5, length=64, per_shard=50)
    path = str(tmp_path / "order")
    materialise.write_shards(got, path)
    rows = spark.read.parquet(path).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == sorted(r.number for r in rows) == list(range(n))
    by_number = sorted(rows, key=lambda r: r.number)
    want = materialise.feistel(np.arange(n), n, 5).tolist()
    assert [r.slot for r in by_number] == want
    assert {(r.slot // 50, r.slot % 50) for r in rows} == {(r.shard, r.record) for r in rows}
    assert {len(r.tokens) for r in rows} == {128}
    plain = tiktoken.Encoding(
        "own", pat_str=materialise.PATTERN, mergeable_ranks=encoding().own._mergeable_ranks,
        special_tokens={},
    )
    texts = []
    ids: list[int] = []
    for r in by_number:  # numbers run through each text
        ids += np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist()
        if r.n_tokens < 64 or ids[-1] == 50256:
            assert ids[-1] == 50256
            texts.append((r.doc_id, plain.decode(ids[:-1])))
            ids = []
    have = [(r[0], r[1]) for r in odd_rows() if r[1] and r[0] != 1004]
    assert Counter(texts) == Counter(have)
    part = materialise.read_from(spark, path, 45, 20, per_shard=50).collect()
    assert [r.slot for r in part] == list(range(45, 65))
    assert materialise.training_order(nothing, ranks).count() == 0


def test_partitions_are_in_slot_order_and_hold_whole_shards(odd, spark):
    ranks = RANKS.read_bytes()
    got = materialise.training_order(odd.filter("doc_id < 1004"), ranks, key=3, length=16, per_shard=20)
    held = got.select("slot", "shard").rdd.glom().map(lambda rows: [tuple(r) for r in rows]).collect()
    assert all(held)
    slots = [slot for rows in held for slot, _ in rows]
    assert slots == list(range(len(slots)))
    shards = [{shard for _, shard in rows} for rows in held]
    assert not any(a & b for a, b in zip(shards, shards[1:]))


def test_binary_shards_are_read_by_offset(odd, spark, tmp_path):
    ranks, path = RANKS.read_bytes(), tmp_path / "order"
    docs = odd.filter("doc_id is null or doc_id < 1004")
    got = materialise.training_order(docs, ranks, key=5, length=64, per_shard=50)
    rows = {r.slot: bytes(r.tokens) for r in got.collect()}
    manifest = materialise.write_binary(got, str(path)).collect()
    assert sum(r.records for r in manifest) == len(rows) and not list((path / "_temporary").iterdir())
    for slot in (0, 49, 50, 51, len(rows) - 1):  # with nothing but seek and read
        with open(path / materialise.shard_file(slot // 50), "rb") as file:
            head = materialise.HEADER
            magic, stride, _, first = head.unpack(file.read(head.size))
            file.seek(head.size + (slot - first) * stride)
            assert magic == materialise.MAGIC and file.read(stride) == rows[slot]
    read = materialise.read_binary(spark, f"file://{path}", 45, 120, per_shard=50).collect()
    assert {r.slot: bytes(r.tokens) for r in read} == {i: rows[i] for i in range(45, 165)}
    beyond = materialise.read_binary(spark, str(path), len(rows) - 2, 500, per_shard=50)
    assert sorted(r.slot for r in beyond.collect()) == [len(rows) - 2, len(rows) - 1]
    # A run that was cut off: one shard is missing and one half written.
    names = sorted(r.file for r in manifest)
    times = {n: (path / n).stat().st_mtime_ns for n in names}
    (path / names[0]).unlink()
    (path / names[1]).write_bytes(b"half")
    with pytest.raises(Exception, match="no complete shard|unpack"):
        materialise.read_binary(spark, str(path), 50, 1, per_shard=50).collect()
    materialise.write_binary(got, str(path))
    again = materialise.read_binary(spark, str(path), 0, len(rows), per_shard=50).collect()
    assert {r.slot: bytes(r.tokens) for r in again} == rows
    assert all((path / n).stat().st_mtime_ns == times[n] for n in names[2:])


def test_binary_shards_of_nothing(nothing, spark, tmp_path):
    got = materialise.training_order(nothing, RANKS.read_bytes())
    assert materialise.write_binary(got, str(tmp_path / "none")).count() == 0
    assert materialise.read_binary(spark, str(tmp_path / "none"), 0, 10).count() == 0
