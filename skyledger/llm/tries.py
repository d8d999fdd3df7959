"""Prefix trie of conversations, built as a burst trie over the cluster.

A node is a distinct sequence of first turns; its members are the conversations that start with
it. The trie is cut into containers, each the sequences that pass through one node, its head:

1. ``conversations`` gives each turn a 128-bit id of its role and text and a number of words, and
   strings the ids of a conversation together; texts do not travel. ``rebuilt`` then makes the
   conversations whose trie is wanted, and ``sequences`` merges equal ones: ids of conversations
   are sorted across the cluster and travel in runs, so a group of copies is split and only its
   digest is put together in one place, a run at a time.
2. ``burst`` starts from one container under the root and bursts it: its sequences go to a
   container for each next turn id. A container of more than ``BURST`` sequences bursts again.
   A round looks twice as many turns ahead as the one before, so rounds are few for deep heads.
3. ``sweep`` deals containers over the cluster, sorts the sequences of each, and sweeps over them
   with a stack: a node is closed when a sequence no longer passes through it. What is held at a
   time is one path and the children of its nodes, ``BURST`` at most besides the path.
4. ``burst_nodes`` sums up what the containers report for the heads that were burst, which are
   themselves nodes.

Defined results: rows without conv_id belong to no conversation and are left out; a null role or
text is an empty one; a null turn comes first; turns of one number follow each other by role and
id, so repeated rows are turns of their own; an empty table has no nodes. Texts are read whole.
Further columns are left out and may have any name. A conversation takes 20 bytes a turn wherever
it is one row, so one of 100 million turns is the longest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skyledger.llm.frames import struct
from skyledger.sources.tables import stage

BURST = 1024
GROUP = 20
HEAD_TURNS = 4
#: Ids of conversations in one run.
RUN = 4096
ID = 16
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()

SEQUENCE = "ids binary, words binary, n long, least long, ends string"
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, ends_sha256 string"
)
SUMMARY = (
    "path binary, path_words binary, n long, conv long, leaves long, saved long, children long,"
    " ends string"
)


def digest(data: Column) -> Column:
    """128 bits of the SHA-256."""
    return F.unhex(F.substring(F.sha2(data, 256), 1, 2 * ID))


def conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, ids, words``: the ids and numbers of words of a conversation's turns, in order."""
    said, by = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (text, role))
    name = F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said)
    rows = turns.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        by.alias("role"),
        digest(name).alias("id"),
        F.regexp_count(said, F.lit(WORD)).cast("int").alias("words"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "id"]
    sorted_ = rows.repartition("conv_id").sortWithinPartitions(*order)
    out = struct("conv_id long, ids binary, words binary")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, words = None, [], []

        def closed() -> list:
            return [last, b"".join(ids), b"".join(words)]

        for batch in batches:
            conv_ids = batch.column(0).to_numpy()
            names = b"".join(batch.column(1).to_pylist())
            sizes = batch.column(2).to_numpy().astype(">i4").tobytes()
            cuts = np.flatnonzero(np.diff(conv_ids)) + 1
            done = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(conv_ids)]):
                if a == b:
                    continue
                if last is not None and conv_ids[a] != last:
                    done.append(closed())
                    ids, words = [], []
                last = int(conv_ids[a])
                ids.append(names[ID * a : ID * b])
                words.append(sizes[4 * a : 4 * b])
            if done:
                yield batch_of(done, arrow)
        if last is not None:
            yield batch_of([closed()], arrow)

    return sorted_.select("conv_id", "id", "words").mapInArrow(run, out)


def batch_of(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], names=schema.names
    )


def rebuilt(convs: DataFrame, group: int = GROUP, most: int = HEAD_TURNS) -> DataFrame:
    """Conversations that open like another: c takes its first h turns from c - c % ``group``.

    h is the CRC-32 of c in decimal modulo ``most``; c's own turns follow after its first h. The
    remainder of a negative number is negative, as in SQL.
    """
    openers = convs.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("opener"),
        F.substring("ids", 1, ID * (most - 1)).alias("opener_ids"),
        F.substring("words", 1, 4 * (most - 1)).alias("opener_words"),
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = convs.withColumn("opener", F.col("conv_id") - F.col("conv_id") % group)
    both = own.join(openers, "opener", "left").withColumn("h", h)

    def spliced(first: str, then: str, wide: int) -> Column:
        head = F.coalesce(F.col(first), F.lit(b"")).substr(F.lit(1), F.col("h") * wide)
        tail = F.col(then).substr(F.col("h") * wide + 1, F.octet_length(then))
        return F.concat(head, tail)

    return both.select(
        "conv_id",
        spliced("opener_ids", "ids", ID).alias("ids"),
        spliced("opener_words", "words", 4).alias("words"),
    )


def sequences(convs: DataFrame, run_size: int = RUN) -> DataFrame:
    """Distinct sequences with their conversations: number, least id, digest of the ids."""
    runs_ddl = struct("seq binary, first long, n long, listed string, ids binary, words binary")
    runs_arrow = to_arrow_schema(runs_ddl)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive conversations of one sequence as one row."""
        now, held = None, []

        def closed() -> list:
            return [now[0], held[0], len(held), ",".join(map(str, held)), *now[1:]]

        for batch in batches:
            done = []
            for conv, *key in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and (key[0] != now[0] or len(held) == run_size):
                    done.append(closed())
                    held = []
                now = key
                held.append(conv)
            yield batch_of(done, runs_arrow)
        if now is not None:
            yield batch_of([closed()], runs_arrow)

    out = struct(f"seq binary, {SEQUENCE}")
    arrow = to_arrow_schema(out)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of a sequence, in order, as one row."""
        now, listed = None, None
        for batch in batches:
            done = []
            for seq, first, n, names, ids, words in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and seq == now[0]:
                    listed.update(b",")
                    now[3] += n
                else:
                    if now is not None:
                        done.append([*now, listed.hexdigest()])
                    now, listed = [seq, ids, words, n, first], hashlib.sha256()
                listed.update(names.encode())
            yield batch_of(done, arrow)
        if now is not None:
            yield batch_of([[*now, listed.hexdigest()]], arrow)

    keyed = convs.select("conv_id", digest(F.col("ids")).alias("seq"), "ids", "words")
    dealt = keyed.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    packed = dealt.mapInArrow(runs, runs_ddl)
    met = packed.repartition("seq").sortWithinPartitions("seq", "first")
    return met.mapInArrow(joined, out)


def burst(seqs: DataFrame, most: int = BURST) -> DataFrame:
    """Sequences with ``burst``: how many turns lead to the last head on their way that burst."""
    size = (F.octet_length("ids") / ID).cast("int")
    todo = seqs.withColumns({"size": size, "burst": F.lit(0)})
    done: DataFrame | None = None
    ahead = 1
    while True:
        reach = F.least(F.col("burst") + ahead, F.col("size"))
        depths = F.when(reach > F.col("burst"), F.sequence(F.col("burst") + 1, reach))
        seen = todo.select("seq", "ids", F.explode(depths).alias("depth")).select(
            "seq", "depth", digest(F.col("ids").substr(F.lit(1), F.col("depth") * ID)).alias("head")
        )
        large = stage(
            seen.groupBy("head").agg(F.count("*").alias("members")).filter(F.col("members") > most),
            "large",
        )
        deepest = seen.join(large.select("head"), "head").groupBy("seq").agg(
            F.max("depth").alias("deepest")
        )
        judged = stage(
            todo.join(deepest, "seq", "left")
            .withColumns(
                {"started": F.col("burst"), "burst": F.coalesce("deepest", "burst").cast("int")}
            )
            .drop("deepest"),
            "burst",
        )
        on = (F.col("burst") == F.col("started") + ahead) & (F.col("size") > F.col("burst"))
        ready = judged.filter(~on).drop("started")
        done = ready if done is None else done.unionByName(ready)
        todo = judged.filter(on).drop("started")
        if todo.isEmpty():
            return done
        ahead *= 2


def common(a: bytes, b: bytes) -> int:
    """How many turns two sequences share from the start."""
    low, high = 0, min(len(a), len(b)) // ID
    if a[: high * ID] == b[: high * ID]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * ID] == b[: middle * ID]:
            low = middle
        else:
            high = middle - 1
    return low


class Open:
    """A node that sequences still pass through; ``closed`` holds its children so far."""

    __slots__ = ("closed", "conv", "depth", "ends", "leaves", "n", "saved", "words")

    def __init__(self, depth: int, words: int):
        self.depth, self.words = depth, words
        self.conv, self.n, self.leaves, self.saved = None, 0, 0, 0
        self.ends, self.closed = NO_ENDS, []

    def add(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n


class Sweep:
    """One container: sequences come sorted, nodes go out as ``NODE`` rows once they are closed."""

    def __init__(self, top: int):
        self.top, self.stack, self.last = top, [], b""
        self.out: list[tuple] = []
        self.head: Open | None = None

    def take(self, ids: bytes, words: bytes, n: int, least: int, ends: str) -> None:
        keep = common(self.last, ids) if self.stack else self.top - 1
        while self.stack and self.stack[-1].depth > keep:
            self.close()
        size = np.frombuffer(words, ">i4").tolist()
        for depth in range(max(keep, self.top - 1) + 1, len(size) + 1):
            self.stack.append(Open(depth, size[depth - 1]))
        node = self.stack[-1]
        node.add(least, n)
        node.ends = ends
        self.last = ids

    def close(self) -> None:
        node = self.stack.pop()
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.words
        self.out += [(c[0], c[1], node.conv, *c[2:]) for c in node.closed]
        if self.stack:
            above = self.stack[-1]
            above.add(node.conv, node.n)
            above.leaves += node.leaves
            above.saved += node.saved
            above.closed.append(self.row(node))
        else:
            self.head = node

    def finish(self) -> Open:
        while self.stack:
            self.close()
        return self.head

    @staticmethod
    def row(node: Open) -> tuple:
        """A ``NODE`` without its parent."""
        children = len(node.closed)
        return node.conv, node.depth, node.n, children, node.leaves, node.saved, node.ends


def sweep(placed: DataFrame) -> DataFrame:
    """Nodes of all containers. Heads come without parent but with the ``path`` to it; rows with a
    ``path`` and no depth sum up, for one task, the containers under the end of that path."""
    head = digest(F.col("ids").substr(F.lit(1), (F.col("burst") + 1) * ID))
    inside = placed.filter(F.col("size") > F.col("burst")).withColumn("head", head)
    dealt = inside.repartition("head").sortWithinPartitions("head", "ids")
    out = struct(f"{NODE}, {SUMMARY}")
    arrow = to_arrow_schema(out)
    names = ["head", "burst", "ids", "words", "n", "least", "ends"]
    blank = (None,) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, box, sums, rows = None, None, {}, []

        def closed() -> None:
            _, burst_, ids, words = now
            top = box.finish()
            path, path_words = ids[: burst_ * ID], words[: burst_ * 4]
            conv, depth, *rest = box.row(top)
            rows.extend((*row, *blank) for row in box.out)
            rows.append((conv, depth, None, *rest, path, *blank[1:]))
            found = sums.setdefault(path, [path_words, 0, top.conv, 0, 0, 0])
            found[1] += top.n
            found[2] = min(found[2], top.conv)
            found[3] += top.leaves
            found[4] += top.saved
            found[5] += 1

        def flushed() -> Iterator[pa.RecordBatch]:
            if len(sums) > 1000:
                summed()
            yield batch_of(rows, arrow)
            rows.clear()

        def summed() -> None:
            rows.extend((*blank, path, *s, None) for path, s in sums.items())
            sums.clear()

        for batch in batches:
            for key, burst_, ids, words, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or key != now[0]:
                    if now is not None:
                        closed()
                    now, box = (key, burst_, ids, words), Sweep(burst_ + 1)
                box.take(ids, words, *rest)
            yield from flushed()
        if now is not None:
            closed()
        summed()
        yield from flushed()

    return dealt.select(*names).mapInArrow(run, out)


def burst_nodes(swept: DataFrame, placed: DataFrame) -> DataFrame:
    """``NODE`` rows of the heads that were burst, with their ``key``."""
    ended = placed.filter(F.col("size") == F.col("burst")).select(
        F.col("ids").alias("path"), F.col("words").alias("path_words"), "n",
        F.col("least").alias("conv"), *[F.lit(0).cast("long").alias(c) for c in ("leaves", "saved", "children")],
        "ends",
    )
    told = swept.filter("depth is null").select(*ended.columns).unionByName(ended)

    def up(rows: DataFrame, *columns: Column) -> DataFrame:
        """Each row once for every head on its path."""
        full = (F.octet_length("path") / ID).cast("int").alias("full")
        depths = rows.select("*", full).withColumn(
            "depth", F.explode(F.sequence(F.lit(0), F.col("full")))
        )
        path = F.col("path").substr(F.lit(1), F.col("depth") * ID)
        return depths.select(digest(path).alias("key"), "depth", path.alias("path"), *columns)

    own = F.col("depth") == F.col("full")
    last = F.when(
        F.col("depth") > 0,
        F.conv(F.hex(F.col("path_words").substr(F.col("depth") * 4 - 3, F.lit(4))), 16, 10).cast("long"),
    ).otherwise(0)
    pieces = up(
        told, last.alias("last"), "n", "conv", "leaves", "saved",
        F.when(own, F.col("children")).otherwise(0).alias("children"),
        F.when(own, F.col("ends")).alias("ends"),
    )
    sums = [F.sum(c).alias(c) for c in ("n", "leaves", "saved", "children")]
    same = [F.max(c).alias(c) for c in ("path", "last", "ends")]
    above = F.col("path").substr(F.lit(1), (F.col("depth") - 1) * ID)
    heads = stage(
        pieces.groupBy("key", "depth")
        .agg(F.min("conv").alias("conv"), *sums, *same)
        .withColumns(
            {
                "parent": F.when(F.col("depth") > 0, digest(above)),
                "gain": (F.col("n") - 1) * F.col("last"),
            }
        ),
        "heads",
    )
    gains = up(heads.select("path", "gain"), "gain").groupBy("key").agg(F.sum("gain").alias("gains"))
    below = heads.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("heads_below"))
    parents = heads.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    children = F.col("children") + F.coalesce("heads_below", F.lit(0))
    return (
        heads.join(gains, "key")
        .join(below, "key", "left")
        .join(parents, "parent", "left")
        .select(
            "key",
            F.col("conv").alias("conv_id"),
            F.col("depth").cast("long").alias("depth"),
            "parent_conv_id",
            F.col("n").alias("n_convs"),
            children.alias("n_children"),
            F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.col("saved") + F.col("gains")).alias("saved_tokens"),
            F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )


def trie(convs: DataFrame, most: int = BURST) -> DataFrame:
    """A row for each node of the trie over ``conv_id, ids, words``."""
    placed = stage(burst(stage(sequences(convs), "sequences"), most), "placed")
    swept = stage(sweep(placed), "swept")
    heads = stage(burst_nodes(swept, placed), "burst_nodes")
    names = [f.name for f in struct(NODE)]
    inner = swept.filter("depth is not null and path is null").select(*names)
    tops = swept.filter("depth is not null and path is not null").drop("parent_conv_id")
    parents = heads.select("key", F.col("conv_id").alias("parent_conv_id"))
    tops = tops.withColumn("key", digest(F.col("path"))).join(parents, "key").select(*names)
    return inner.unionByName(tops).unionByName(heads.select(*names))


def prefix_trie(turns: DataFrame, most: int = BURST, **columns: str) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns."""
    return trie(stage(rebuilt(stage(conversations(turns, **columns), "conversations")), "rebuilt"), most)
