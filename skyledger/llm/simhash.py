"""SimHash near-dedup by segment popcounts.

A fingerprint has 64 bits; bit ``i`` is set if over half of the shingles' XXH64 have it set.
Fingerprints of at most ``distance`` differing bits link. Each is embedded as the bit counts of
its 32 segments of two bits; the Manhattan distance of two count vectors never exceeds the bits
that differ. The segments form ``distance + 2`` groups, so a linked pair has equal counts in two
groups at least: every choice of two groups is a grid, pairs meet in its cells, are filtered by
Manhattan distance, and verified bit by bit. Counts are kept in unary (00, 01, 11), which makes
the Manhattan distance the popcount of an exclusive or.

Equal fingerprints are one point, so copies never multiply. A cell of more than ``BLOCK`` points is
cut into blocks, and each pair of blocks is a task's group of its own. A group hands on a spanning
star of each of its clusters, not all pairs; ``components`` joins them.

Null and empty texts have fingerprint zero, linked like any other. A text of fewer than four words
is one shingle. A null id is greater than all others. Repeated rows and ties share fingerprint and
component; further columns take no part, or are replaced if named like a result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.components import components
from skyledger.llm.frames import map_texts
from skyledger.llm.runs import NULL_ID, Units, Windows, prepared
from skyledger.sources.tables import stage

SHINGLE = 4
DISTANCE = 4
SEED = 42
SEGMENTS = 32
BLOCK = 4096
ROWS = 60_000
_HIGH = 0x5555555555555555


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints of whole texts."""
    units = Units([t.lower() for t in texts], Windows(1, 1, True))
    out = np.zeros(len(texts), np.uint64)
    n_words = units.last - units.first
    filled = np.flatnonzero(n_words > 0)
    if not len(filled):
        return out
    n = np.maximum(n_words[filled] - shingle + 1, 1)
    edge = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(edge[-1]) + np.repeat(units.first[filled] - edge[:-1], n)
    end = np.minimum(begin + shingle, np.repeat(units.last[filled], n))
    left, right = units.slice(begin, end)
    body, digest = units.body.tobytes(), xxhash.xxh64_intdigest
    values = np.fromiter(
        (digest(body[a:b], SEED) for a, b in zip(left.tolist(), right.tolist())),
        np.uint64,
        len(left),
    )
    for a in range(0, len(filled), 256):
        b = min(a + 256, len(filled))
        part = values[edge[a] : edge[b]]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, edge[a:b] - edge[a], axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > n[a:b, None], axis=1, bitorder="little")
        out[filled[a:b]] = packed.view(np.uint64).ravel()
    return out


def fingerprint_table(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``__id, __hash, fp``: the fingerprint of each row as a signed long."""

    def compute(batch: pa.RecordBatch, texts: list[bytes]) -> dict[str, list]:
        at = batch.schema.get_field_index
        return {
            "__id": batch.column(at("__id")),
            "__hash": batch.column(at("__hash")),
            "fp": fingerprints(texts, shingle).view(np.int64),
        }

    return map_texts(
        prepared(docs, id_col, text), "__text", "__id long, __hash long, fp long", compute
    )


def unary(x: str) -> F.Column:
    """Bit counts of the two-bit segments of ``x``, in unary."""
    c, half = F.col(x), F.lit(_HIGH)
    one = (c.bitwiseOR(F.shiftrightunsigned(c, 1))).bitwiseAND(half)
    two = (c.bitwiseAND(F.shiftrightunsigned(c, 1))).bitwiseAND(half)
    return one.bitwiseOR(F.shiftleft(two, 1))


def group_masks(groups: int) -> list[int]:
    edges = [SEGMENTS * i // groups for i in range(groups + 1)]
    return [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:])]


def grid_links(points: DataFrame, n_points: int, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: links that span, with those of other cells, all pairs within ``distance`` bits.

    ``points`` holds different values of ``fp``.
    """
    masks = group_masks(distance + 2)
    grids = [masks[i] | masks[j] for i, j in combinations(range(len(masks)), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in grids]
    cells = points.withColumn("u", unary("fp")).select(
        "fp", F.posexplode(F.array(*[F.col("u").bitwiseAND(F.lit(m)) for m in signed]))
    )
    cells = cells.withColumnsRenamed({"pos": "grid", "col": "cell"})
    large = cells.groupBy("grid", "cell").count().filter(F.col("count") > BLOCK)
    blocks = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / F.lit(BLOCK)).cast("int")
    placed = cells.join(large, ["grid", "cell"], "left").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    low, high = F.least("own", "other"), F.greatest("own", "other")
    buckets = max(8, len(grids) * n_points // ROWS)
    keyed = placed.select(
        "fp",
        F.xxhash64("grid", "cell", low, high).alias("key"),
    ).withColumn("bucket", F.pmod("key", F.lit(buckets)))

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        key = table.column("key").to_numpy()
        a, b = close_pairs(fp, key, distance)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    links = keyed.groupBy("bucket").applyInArrow(run, "a long, b long")
    return links.distinct()


def close_pairs(
    fp: np.ndarray, key: np.ndarray, distance: int
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the points that share a key and differ in ``distance`` bits at most."""
    order = np.lexsort((fp, key))
    fp, key = fp[order], key[order]
    half = np.uint64(_HIGH)
    one = (fp | (fp >> np.uint64(1))) & half
    two = fp & (fp >> np.uint64(1)) & half
    u = one | (two << np.uint64(1))
    label = np.arange(len(fp))
    left = np.arange(len(fp) - 1)
    found_a, found_b, held, step = [], [], 0, 1
    while True:
        left = left[left + step < len(fp)]
        left = left[key[left] == key[left + step]]
        if not len(left):
            break
        near = left[np.bitwise_count(u[left] ^ u[left + step]) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= distance]
        if len(near):
            found_a.append(near)
            found_b.append(near + step)
            held += len(near)
        if held > 500_000:
            label = settled(label, np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [], [], 0
        step += 1
    if held:
        label = settled(label, np.concatenate(found_a), np.concatenate(found_b))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def settled(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each cluster after joining those of ``a`` and ``b``."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new[a], new[b]) and np.array_equal(new, label):
            return new
        label = new


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
) -> DataFrame:
    """``__id, __hash, fp, root, component`` of each row: ``component`` is the least id reachable
    over links, which components may share; ``root``, the least fingerprint, tells them apart."""
    table = stage(fingerprint_table(docs, id_col, text, shingle), "fingerprints")
    points = stage(table.groupBy("fp").agg(F.min("__id").alias("low")), "points")
    links = grid_links(points.select("fp"), points.count(), distance)
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = points.join(roots, "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    classes = rooted.join(lowest, "root").select("fp", "root", "component")
    return table.join(classes, "fp")


def simhash_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, fingerprint as 16 hexadecimal digits, and component of each row."""
    got = simhash_groups(docs, id_col, text)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return got.select(
        real("__id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        real("component").alias("component_id"),
    )


def simhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
) -> DataFrame:
    """One row of each component: that of the least id, and one of those that repeat it.

    Components stay apart where they share their least id, null included.
    """
    got = simhash_groups(docs, id_col, text, shingle, distance)
    hashes = got.filter(F.col("__id") == F.col("component"))
    keep = hashes.groupBy("root").agg(
        F.min("__id").alias("__id"), F.min("__hash").alias("__hash")
    )
    keyed = docs.withColumns(
        {
            "__id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)),
            "__hash": F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))),
        }
    )
    kept = keyed.join(keep, ["__id", "__hash"], "left_semi")
    return kept.dropDuplicates(["__id", "__hash"]).select(*[f"`{c}`" for c in docs.columns])
