"""Sharding along a Hilbert curve.

Metadata dimensions (language, source, size) are quantised to ``BITS`` bits each: a number by the
logarithm of its value, anything else by a digest, so no dictionary is gathered. Documents are
sorted by their index on the Hilbert curve through that grid, and the curve is cut into runs: the
law is ``rows``, so the counts of two shards differ by one at most. A shard then covers a compact
region in all dimensions, and readers that filter on any of them skip files.

Ties on the curve go by digest of the text, then id, so a cell with a third of all rows is still
split between tasks and shards. Ranks come from a range sort whose partitions are counted: one row
for each partition, which bounds the join's small side. Texts are read once and not shuffled.

Null texts count as empty (size 8, checksum 0); a null in a dimension is the value 0 there; null
ids sort first. Repeated rows take neighbouring slots. Fewer rows than shards leave some empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.frames import struct
from skyledger.sources.tables import stage

SHARDS = 24
BITS = 8
OVERHEAD = 8
DIMENSIONS = ("lang", "source", "__size")


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of each row of ``points``, whose columns are the coordinates.

    Undoes the curve's rotations from the top bit down, removes the Gray code, and interleaves.
    """
    x = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            high = (x[d] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else x[0]
    for d in range(1, dims):
        x[d] = x[d] ^ x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | (((x[d] ^ flip) >> b) & 1)
    return out


def quantised(df: DataFrame, name: str, bits: int = BITS) -> Column:
    """A coordinate of ``bits`` bits."""
    most = (1 << bits) - 1
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.NumericType):
        scaled = F.floor(F.log2(F.greatest(column, F.lit(0)) + F.lit(1)) * F.lit(8))
        return F.coalesce(F.least(scaled, F.lit(most)), F.lit(0)).cast("int")
    return F.coalesce(F.pmod(F.crc32(column.cast("string")), F.lit(most + 1)), F.lit(0)).cast(
        "int"
    )


def hilbert_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    dimensions: Sequence[str] = DIMENSIONS,
    shards: int = SHARDS,
    bits: int = BITS,
) -> DataFrame:
    """Shard and slot of every document; ``__size`` names the size as a dimension."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sized = docs.withColumn("__size", (F.octet_length(body) + F.lit(OVERHEAD)).cast("long"))
    light = sized.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col("__size").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("digest"),
        *[quantised(sized, d, bits).alias(f"c{i}") for i, d in enumerate(dimensions)],
    )
    names = [f"c{i}" for i in range(len(dimensions))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index
            points = np.stack([b.column(at(c)).to_numpy() for c in names], axis=1)
            index = pa.array(hilbert_index(points, bits), pa.int64())
            kept = [b.column(at(c)) for c in ("id", "size", "text_crc32", "digest")]
            yield pa.RecordBatch.from_arrays(
                [*kept, index], names=["id", "size", "text_crc32", "digest", "hilbert"]
            )

    id_type = light.schema["id"].dataType.simpleString()
    ddl = f"id {id_type}, size long, text_crc32 long, digest long, hilbert long"
    placed = stage(light.mapInArrow(run, struct(ddl)), "curve")
    keys = ["hilbert", "digest", "id"]
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id of a row holds its partition and, in the lower 33 bits, its place there
    ordered = placed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    ordered = stage(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = ordered.withColumns({"part": part, "place": place}).drop("at", "digest")
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = stage(counts.withColumn("before", F.coalesce(before, F.lit(0))), "offsets")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rank = F.col("before") + F.col("place")
    ranked = ordered.join(F.broadcast(counts.drop("n")), "part").withColumn("rank", rank)
    size, larger = divmod(total, shards)  # the first ``larger`` shards hold one more
    edge = larger * (size + 1)
    past = F.col("rank") - F.lit(edge)
    in_large = F.col("rank") < F.lit(edge)
    shard = F.when(in_large, F.floor(F.col("rank") / F.lit(size + 1))).otherwise(
        F.floor(past / F.lit(max(size, 1))) + F.lit(larger)
    )
    slot = F.when(in_large, F.pmod("rank", F.lit(size + 1))).otherwise(
        F.pmod(past, F.lit(max(size, 1)))
    )
    return ranked.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )


def write_sharded(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Whole documents in one folder for each shard, in curve order; ids must be unique."""
    rows = docs.join(placed.select(id_col, "shard", "slot"), id_col)
    rows = rows.repartition("shard").sortWithinPartitions("shard", "slot")
    rows.write.mode("overwrite").partitionBy("shard").parquet(path)
