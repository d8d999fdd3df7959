"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of words.

A bin holds at most ``capacity`` words, no two documents of one source and no two of one cluster of
duplicates. Bins are kept in order of residual with a bitmap of the sources and clusters they
hold; the search begins at the first bin with room enough and goes on to the next until one has
no bit in common, which is the tightest that fits. Else a bin is opened. Documents come largest
first; equal sizes by id. A document longer than a bin is cut into full bins of its own and a rest
that is packed like any other.

Documents are dealt to groups of about ``GROUP`` by a hash of id and text, so no source, cluster or
key gathers in one task; a group that repeated rows make larger is packed ``2 * GROUP`` rows at a
time. Only ids, sizes and digests are shuffled.

Null and empty texts get a row without a bin. A null source conflicts with nothing. The cluster is
a digest of the text unless a column names it; a null cluster conflicts with nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skyledger.llm.frames import struct

CAPACITY = 2048
GROUP = 4096
WORD = r"[^\x20\x09-\x0D]+"

OUT = (
    "id long, piece int, first_word long, n_words long, bin long, place int, bin_words int"
)


def best_fit(sizes: list[int], masks: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and place in it for each size, in the order given."""
    open_: list[tuple[int, int]] = []
    held: list[int] = []
    out = []
    for size, mask in zip(sizes, masks):
        i = bisect_left(open_, (size, -1))
        while i < len(open_) and held[open_[i][1]] & mask:
            i += 1
        if i < len(open_):
            room, b = open_.pop(i)
            held[b] |= mask
        else:
            room, b = capacity, len(held)
            held.append(mask)
        out.append((b, capacity - room))
        if room > size:
            insort(open_, (room - size, b))
    return out


def conflict_masks(sources: list, clusters: list) -> list[int]:
    """A bit for each source, and for each cluster of two members or more."""
    bits: dict = {}
    often = Counter(c for c in clusters if c is not None)
    masks = []
    for s, c in zip(sources, clusters):
        mask = 0
        if s is not None:
            mask |= 1 << bits.setdefault(("s", s), len(bits))
        if c is not None and often[c] > 1:
            mask |= 1 << bits.setdefault(("c", c), len(bits))
        masks.append(mask)
    return masks


def pack_group(rows: list[tuple], capacity: int, first_bin: int) -> tuple[list[tuple], int]:
    """Rows ``(id, source, cluster, n_words)`` to pieces; the number of the next bin."""
    out, rest, bins = [], [], first_bin
    for row in rows:
        n = row[3]
        if n == 0:
            out.append((row[0], 0, 0, 0, None, None, None))
        for piece in range(n // capacity):
            out.append((row[0], piece, piece * capacity, capacity, bins, 0, capacity))
            bins += 1
        if n % capacity:
            rest.append((n % capacity, n // capacity, row))
    rest.sort(key=lambda x: -x[0])
    masks = conflict_masks([r[2][1] for r in rest], [r[2][2] for r in rest])
    placed = best_fit([r[0] for r in rest], masks, capacity)
    filled = Counter()
    for (size, _, _), (b, _) in zip(rest, placed):
        filled[b] += size
    for (size, piece, row), (b, at) in zip(rest, placed):
        out.append((row[0], piece, piece * capacity, size, bins + b, at, filled[b]))
    return out, bins + len(filled)


def best_fit_packing(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: str | None = None,
    capacity: int = CAPACITY,
    group: int = GROUP,
) -> DataFrame:
    """A row for each piece: where in the document it begins, its bin and its place there.

    The number of a bin holds that of its group in the upper bits.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    light = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.xxhash64(body).alias("digest"),
        (F.xxhash64(F.col(f"`{cluster}`")) if cluster else F.xxhash64(body)).alias("cluster"),
        (F.col(f"`{cluster}`").isNull() if cluster else F.lit(False)).alias("alone"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_words"),
    )
    groups = max(1, round(docs.count() / group))
    dealt = light.withColumn("bucket", F.pmod(F.xxhash64("id", "digest"), F.lit(groups)))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "id", "digest", "source")
    arrow = to_arrow_schema(struct(OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket, bins = None, 0

        def packed() -> pa.RecordBatch:
            nonlocal bins
            out, bins = pack_group(held, capacity, bins)
            columns = [list(c) for c in zip(*out)]
            columns[4] = [None if b is None else (bucket << 32) + b for b in columns[4]]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], names=arrow.names
            )

        for batch in batches:
            names = ("bucket", "id", "source", "cluster", "n_words", "alone")
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            for b, i, s, c, n, alone in zip(*columns):
                if held and (b != bucket or len(held) >= 2 * group):
                    yield packed()
                if b != bucket:
                    bucket, bins = b, 0
                held.append((i, s, None if alone else c, n))
        if held:
            yield packed()

    packed_ = dealt.mapInArrow(run, struct(OUT))
    return packed_.withColumnRenamed("id", id_col)
