"""Token ids in training order: fixed-stride records behind a keyed permutation.

Texts become ids of a byte-level BPE, each followed by the end mark, cut into sequences of
``length`` ids and padded with the end mark. Sequences are numbered over the whole corpus, and a
keyed Feistel network with cycle-walking maps numbers to slots: a bijection on 0 to N - 1 that
needs no sort and no state, so the slot of a sequence and the sequence of a slot follow from key
and N. Shards are runs of ``per_shard`` slots, written in order with records of one size
(``length`` little-endian ids of 16 bits), so reading can begin at any slot: ``write_binary`` makes
files in which a slot is a byte offset, ``write_shards`` makes Parquet.

Texts are read once. The tokenised table is written to the shared folder, which fixes the numbers:
its partitions are counted (one row each, so the join's small side is bounded by the number of
tasks) and a sequence's number is its partition's offset plus its place.

Null and empty texts have no sequence. Repeated rows have sequences of their own; a null id stays
null. Further columns take no part.
"""

from __future__ import annotations

import base64
import re
import sys
import uuid
from array import array
from collections.abc import Iterator
from struct import Struct as struct_format

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skyledger.llm.frames import struct
from skyledger.llm.warc import commit, open_files
from skyledger.llm.words import chunks, mix
from skyledger.sources.tables import stage

LENGTH = 1024
PER_SHARD = 4096
#: Records of one task; more data makes more tasks.
RANGE_BYTES = 128 << 20
#: Fixed value: the start of a shard file, with its stride, records and first slot.
HEADER = struct_format("<8sQQQ")
MAGIC = b"SLOTS\x00\x00\x01"
ROUNDS = 8
CACHED = 400_000

#: Fixed value: the split pattern published with the vocabulary.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: White space other than the space and line feed, in any version of the pattern's engine.
ODD_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CROWDED = re.compile(r" \s|\s ")


def crowded(text: str) -> bool:
    """Whether a space stands beside other white space or at an end."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
        return True
    return bool(ODD_SPACE.search(text) and CROWDED.search(text))


#: Letters below are letters in every version of Unicode that a pattern may know.
PLAIN_LETTERS = "\u0530"


def little_endian(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder(dict):
    """Packed ids of whole texts; maps words seen before, each with a space in front, to theirs.

    A lone space always begins a new piece of the split pattern, so words before and after it are
    independent.
    """

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.own = tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.end = max(table.values()) + 1
        if self.end > 0xFFFF:
            raise ValueError("ids of more than 16 bits do not fit the records")
        self.marks = {c: self.whole(c) for c in ".,"}

    def whole(self, text: str) -> bytes:
        return little_endian(self.own.encode_ordinary(text))

    def __missing__(self, word: str) -> bytes:
        """Ids of ``word`` after a space; the split pattern is run only where it could matter."""
        if word.isalpha() and (word.isascii() or max(word) < PLAIN_LETTERS):  # one piece
            got = little_endian(self.own._encode_single_piece(" " + word))
        elif word[-1:] in self.marks and word[-2:-1].isalpha() and word[-2] < PLAIN_LETTERS:
            got = self[word[:-1]] + self.marks[word[-1]]  # the mark is a piece of its own
        else:
            got = self.whole(" " + word)
        self[word] = got
        return got

    def packed(self, text: str) -> bytes:
        """Little-endian ids of 16 bits."""
        if crowded(text):
            return self.whole(text)
        if len(self) > CACHED:
            self.clear()
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


_encoders: dict[int, Encoder] = {}


def _encoder(ranks) -> Encoder:
    """One for each worker process, not for each task."""
    key = hash(ranks.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks.value)
    return _encoders[key]


def sequences(
    docs: DataFrame, ranks: bytes, id_col: str, text: str, length: int = LENGTH
) -> DataFrame:
    """``id, seq_no, n_tokens, tokens`` with the task and the place in it of each sequence."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    ddl = "id long, seq_no int, n_tokens int, tokens binary, part int, place long"
    arrow = to_arrow_schema(struct(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place = _encoder(held), TaskContext.get().partitionId(), 0
        end, stride = encoder.end.to_bytes(2, "little"), 2 * length
        for batch, texts in chunks(batches, "text"):
            names: list = []
            seq_no: list[int] = []
            sizes: list[int] = []
            bodies: list[bytes] = []
            for name, body in zip(batch.column(0).to_pylist(), texts):
                if not body:
                    continue
                ids = encoder.packed(body.decode("utf-8", "replace")) + end
                count = -(-len(ids) // stride)
                last = len(ids) - (count - 1) * stride
                names += [name] * count
                seq_no += range(count)
                sizes += [length] * (count - 1) + [last // 2]
                ids += end * ((stride - last) // 2)
                bodies += [ids[at : at + stride] for at in range(0, len(ids), stride)]
            places = range(place, place + len(names))
            place += len(names)
            columns = (names, seq_no, sizes, bodies, [part] * len(names), places)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], names=arrow.names
            )

    source = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")
    )
    return source.mapInArrow(run, struct(ddl))


def feistel(x: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed bijection of 0 to ``n`` - 1: a balanced network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    salts = mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key % (1 << 64)))
    out = np.asarray(x).astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> shift, out[walk] & mask
        for salt in salts:
            left, right = right, left ^ (mix(right + salt) & mask)
        out[walk] = (left << shift) | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def training_order(
    docs: DataFrame,
    ranks: bytes,
    id_col: str = "doc_id",
    text: str = "text",
    key: int = 0,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
) -> DataFrame:
    """Every sequence with its number, slot, shard and record in the shard, shards in order."""
    made = stage(sequences(docs, ranks, id_col, text, length), "sequences")
    counts = made.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = stage(counts.withColumn("before", F.coalesce(before, F.lit(0))), "offsets")
    total = counts.agg(F.sum("n")).first()[0] or 0
    out = struct(
        "slot long, shard long, record long, number long, id long, seq_no int, n_tokens int,"
        " tokens binary"
    )
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column(b.schema.get_field_index("number")).to_numpy()
            slot = feistel(number, total, key)
            more = {"slot": slot, "shard": slot // per_shard, "record": slot % per_shard}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(more[f.name], f.type)
                    if f.name in more
                    else b.column(b.schema.get_field_index(f.name))
                    for f in arrow
                ],
                names=arrow.names,
            )

    numbered = made.join(F.broadcast(counts.drop("n")), "part").withColumn(
        "number", F.col("before") + F.col("place")
    )
    placed = numbered.drop("part", "place", "before").mapInArrow(run, out)
    shards = max(1, -(-total // per_shard))
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(shards, max(wide, -(-total * 2 * length // RANGE_BYTES)))
    span = -(-shards // ranges)
    ranges = -(-shards // span)
    # Range numbers are partition numbers: a range is one partition, and partitions are in order.
    dealt = placed.repartitionById(ranges, F.floor(F.col("shard") / F.lit(span)).cast("int"))
    return dealt.sortWithinPartitions("slot").withColumnRenamed("id", id_col)


def write_shards(ordered: DataFrame, path: str) -> None:
    """One folder for each shard, records in order of their slots."""
    ordered.write.mode("overwrite").partitionBy("shard").parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, n: int, per_shard: int = PER_SHARD):
    """``n`` records from ``slot`` on, in order; only the shards that hold them are read."""
    first, last = slot // per_shard, (slot + n - 1) // per_shard
    got = spark.read.parquet(path).filter(F.col("shard").between(first, last))
    return got.filter(F.col("slot").between(slot, slot + n - 1)).orderBy("slot")


def shard_file(shard: int) -> str:
    return f"shard-{shard:010d}.bin"


def shard_body(first: int, records: list[bytes]) -> bytes:
    return HEADER.pack(MAGIC, len(records[0]), len(records), first) + b"".join(records)


def records_of(file, slot: int, n: int) -> tuple[int, list[bytes]]:
    """The records of an open shard file among ``n`` from ``slot`` on, and the slot of the first."""
    head = file.read(HEADER.size)
    magic, stride, records, first = HEADER.unpack(head.ljust(HEADER.size, b"\0"))
    if magic != MAGIC or file.size() != HEADER.size + stride * records:
        raise ValueError("no complete shard")
    begin, end = max(slot, first), min(slot + n, first + records)
    if begin >= end:
        return begin, []
    file.seek(HEADER.size + (begin - first) * stride)
    body = file.read((end - begin) * stride)
    return begin, [body[at : at + stride] for at in range(0, len(body), stride)]


def write_binary(ordered: DataFrame, path: str) -> DataFrame:
    """Writes every shard as one file of records of one size, and returns the manifest.

    ``ordered`` comes from ``training_order``: a shard lies whole in one partition, in order. A file
    holds ``HEADER`` and its records, so slot ``s`` of a shard that begins at ``f`` is found at
    ``HEADER.size + (s - f) * stride``. Files get temporary names, unique to the attempt; those that
    the committed manifest names are renamed. A shard whose file is complete is not written again,
    so a run that was cut off goes on where it stopped.
    """
    out = struct("file string, temporary string, bytes long, first long, records long")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_files(path)
        files.create_dir(f"{root}/_temporary", recursive=True)
        attempt = uuid.uuid4().hex

        def closed(shard: int, first: int, held: list[bytes]) -> pa.RecordBatch:
            file = shard_file(shard)
            body = shard_body(first, held)
            temporary = f"_temporary/{file}.{attempt}"
            done = files.get_file_info(f"{root}/{file}")
            if done.size != len(body):
                with files.open_output_stream(f"{root}/{temporary}", compression=None) as stream:
                    stream.write(body)
            row = (file, temporary, len(body), first, len(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, arrow)], names=arrow.names
            )

        now, first, held = None, 0, []
        for batch in batches:
            for slot, shard, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if held:
                        yield closed(now, first, held)
                    now, first, held = shard, slot, []
                held.append(tokens)
        if held:
            yield closed(now, first, held)

    records = ordered.select("slot", "shard", "tokens")
    manifest = stage(records.mapInArrow(run, out), "manifest")
    commit(manifest, path)
    return manifest


def read_binary(
    spark: SparkSession, path: str, slot: int, n: int, per_shard: int = PER_SHARD
) -> DataFrame:
    """``slot, tokens`` of ``n`` records from ``slot`` on, each read from its byte offset.

    Slots beyond the last give no row. Shards are read side by side, the records of each in order.
    """
    out = struct("slot long, tokens binary")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_files(path)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                name = f"{root}/{shard_file(shard)}"
                if files.get_file_info(name).type == fs.FileType.NotFound:
                    continue
                with files.open_input_file(name) as file:
                    begin, tokens = records_of(file, slot, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(begin, begin + len(tokens)), arrow[0].type),
                        pa.array(tokens, arrow[1].type),
                    ],
                    names=arrow.names,
                )

    shards = spark.range(slot // per_shard, (slot + max(n, 1) - 1) // per_shard + 1)
    return shards.mapInArrow(run, out)
