"""Repeated windows of a fixed length, found through runs of windows that share a minimiser.

The minimiser of a window is its leftmost n-gram of least rank. Consecutive windows with the same
minimiser travel as one packed string to the bucket of that minimiser, so equal windows always
meet, and a text is sent about three times over rather than once for each window.

Steps, all of them Spark jobs over whole texts:

1. ``survey``: a pass that measures the input and finds n-grams frequent within some MB of text.
   The most frequent (``HOT_GRAMS`` at most, which bounds what reaches the driver) rank last, so
   that runs of a passage that very many texts share lie inside that passage, are equal strings,
   and merge before the shuffle. The list only orders n-grams: any list gives the same result.
2. ``repeated_runs``: each task merges equal runs, compresses the strings of a bucket, and sends
   them. A bucket merges again, drops runs whose n-gram no other run has, and sorts the rest.
3. ``spans``: a second pass joins the runs of each text with those found repeated; Spark splits a
   run that very many texts have, since only a digest (128 bits) and a place travel. Spans are
   then gathered for each text.

A null id ranks after all others; texts are told apart by id and 64-bit hash of the text, so rows
that share an id by mistake do not mix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skyledger.llm.frames import Compute, add_columns, struct
from skyledger.llm.words import PAD, Words, chunks, hash_slices, joined, mix, rolled
from skyledger.sources.tables import stage

HOT_GRAMS = 1 << 16
HOT_LEAST = 200
LOCAL_LEAST = 3
BUCKET_BYTES = 10 << 20
NULL_ID = (1 << 63) - 1
TEXT_COLUMNS = ("__id", "__hash", "__text")


@dataclass(frozen=True)
class Windows:
    """``size`` units in a window, ``gram`` units in an n-gram; of which one in ``sample`` counts."""

    size: int
    gram: int
    by_words: bool
    sample: int = 1
    chunk: int = 4 << 20


@dataclass(frozen=True)
class Survey:
    bytes: int
    hot: np.ndarray
    splitters: np.ndarray

    @property
    def buckets(self) -> int:
        return max(8, 3 * self.bytes // BUCKET_BYTES)


class Units:
    """Units (words or bytes) of some texts, in one body of bytes.

    Unit ``i`` begins at ``at[i]``; text ``d`` holds the units ``first[d]`` to ``last[d]``.
    """

    def __init__(self, texts: list[bytes], windows: Windows):
        self.windows = windows
        q = windows.gram
        if windows.by_words:
            words = Words(texts)
            gap = np.zeros(len(words.data), bool)
            gap[words.end] = True
            keep = gap.copy()
            inside = np.zeros(len(words.data) + 1, np.int8)
            inside[words.start] = 1
            inside[words.end] = -1
            keep |= np.cumsum(inside[:-1]) > 0
            data = np.where(gap, np.uint8(32), words.data)[keep]
            self.body = np.concatenate([data, np.zeros(PAD, np.uint8)])
            size = words.end - words.start + 1
            self.at = np.concatenate([[0], np.cumsum(size)])
            self.first, self.last = words.first[:-1], words.first[1:]
            self.total = len(size)
            self.hash = hash_slices(self.body, self.at[:-1], self.at[1:] - 1)
            self.grams = rolled(self.hash, q)
            self.tail = 1
        else:
            self.body, self.first, self.last = joined(texts)
            self.total = len(self.body) - PAD
            self.at = None
            self.tail = 0
            eight = np.ndarray(self.total, "<u8", buffer=self.body, strides=(1,))
            size = max(0, self.total - q + 1)
            grams = mix(eight[:size])
            for i in range(8, q, 8):  # the last piece may overlap the one before
                j = min(i, q - 8)
                grams = mix(grams + eight[j : j + size])
            self.grams = grams

    def slice(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where units ``begin`` to ``end`` lie in the body."""
        if self.at is None:
            return begin, end
        return self.at[begin], self.at[end] - self.tail

    def starts_inside(self, n: int) -> np.ndarray:
        """For each start of ``n`` units, whether they lie in one text."""
        size = max(0, self.total - n + 1)
        end = np.zeros(self.total + 1, np.int64)
        np.maximum.at(end, self.first[self.first < self.last], self.last[self.first < self.last])
        end = np.maximum.accumulate(end)[:size]
        return end >= np.arange(n, size + n)


@dataclass
class Runs:
    """Runs of windows: text, first unit and number of windows of each, and its n-gram."""

    body: bytes
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    offset: np.ndarray
    gram: np.ndarray

    def strings(self) -> Iterator[bytes]:
        body = self.body
        return (body[a:b] for a, b in zip(self.begin.tolist(), self.end.tolist()))


def eligible(grams: np.ndarray, sample: int) -> np.ndarray:
    return grams % np.uint64(sample) == 0


def runs_of(texts: list[bytes], windows: Windows, hot: np.ndarray) -> Runs | None:
    units = Units(texts, windows)
    k, q = windows.size, windows.gram
    if units.total < k:
        return None
    grams = units.grams
    rank = grams >> np.uint64(34)
    chosen = np.flatnonzero(eligible(grams, windows.sample))
    other = np.ones(len(grams), bool)
    other[chosen] = False
    rank[other] |= np.uint64(2 << 30)
    if len(hot) and len(chosen):
        found = np.searchsorted(hot, grams[chosen])
        found[found == len(hot)] = 0
        rank[chosen[hot[found] == grams[chosen]]] |= np.uint64(1 << 30)
    least = sliding_min((rank << np.uint64(32)) | np.arange(len(rank), dtype=np.uint64), k - q + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = units.starts_inside(k)
    fresh = ok.copy()
    fresh[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(fresh)
    if not len(begin):
        return None
    stop = np.flatnonzero(ok & ~np.append(ok[1:] & ~fresh[1:], False)) + 1
    anchor = anchor[begin]
    filled = np.flatnonzero(units.first < units.last)
    doc = filled[np.searchsorted(units.first[filled], begin, side="right") - 1]
    return Runs(
        units.body.tobytes(),
        *units.slice(begin, stop + k - 1),
        doc,
        begin - units.first[doc],
        anchor - begin,
        grams[anchor],
    )


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every ``n`` consecutive values."""
    size, out, span = len(x) - n + 1, x, 1
    while span * 2 <= n:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < n:
        out = np.minimum(out[:size], out[n - span : n - span + size])
    return out


def pieces(
    batches: Iterator[pa.RecordBatch], windows: Windows
) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of some MB with their ids, hashes and the unit at which each begins.

    Windows over bytes cut long texts; pieces overlap so that each window lies in just one.
    """
    most, lap = windows.chunk, windows.size - 1
    for batch, texts in chunks(batches, "__text", most):
        ids = batch.column(batch.schema.get_field_index("__id")).to_numpy(zero_copy_only=False)
        own = batch.column(batch.schema.get_field_index("__hash")).to_numpy(zero_copy_only=False)
        if windows.by_words or len(texts) > 1 or len(texts[0]) <= most:
            yield texts, ids, own, np.zeros(len(texts), np.int64)
        else:
            for at in range(0, len(texts[0]), most):
                yield [texts[0][at : at + most + lap]], ids, own, np.array([at])


def prepared(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    return docs.select(key.alias("__id"), F.xxhash64(body).alias("__hash"), body.alias("__text"))


def _mapped(df: DataFrame, ddl: str, run: Callable) -> DataFrame:
    out = struct(ddl)
    arrow = to_arrow_schema(out)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return df.mapInArrow(each, out)


def survey(texts: DataFrame, windows: Windows, ranges: int = 0) -> Survey:
    """Size of the input, frequent n-grams, and ``ranges - 1`` splitters of leading bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group, _, _, _ in pieces(batches, windows):
            units = Units(group, windows)
            size = max(0, units.total - windows.gram + 1)
            chosen = np.flatnonzero(
                units.starts_inside(windows.gram) & eligible(units.grams[:size], windows.sample)
            )
            value, at, times = np.unique(
                units.grams[chosen], return_index=True, return_counts=True
            )
            often = times >= LOCAL_LEAST
            sample = at[value % np.uint64(61) == 0][:64] if ranges else at[:0]
            lead = leading(units.body, chosen[sample]).tolist()
            n = int(often.sum())
            yield (
                [*value[often].view(np.int64).tolist(), *[None] * (1 + len(lead))],
                [*times[often].tolist(), sum(map(len, group)), *[0] * len(lead)],
                [*[None] * (n + 1), *lead],
            )

    counted = stage(_mapped(texts, "gram long, n long, lead long", run), "survey")
    known = counted.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = (
        known.filter(F.col("n") >= HOT_LEAST)
        .orderBy(F.col("n").desc(), "gram")
        .limit(HOT_GRAMS)
        .collect()
    )
    hot = np.array([r.gram for r in rows], np.int64).view(np.uint64)
    marks = [i / ranges for i in range(1, ranges)] or [0.5]
    rest = counted.filter("gram is null").agg(
        F.sum("n").alias("n"), F.percentile_approx("lead", marks, 10000).alias("leads")
    )
    total, leads = rest.first()
    splitters = np.unique(np.array(leads if ranges and leads else [], np.int64))
    return Survey(total or 0, np.sort(hot), splitters)


def leading(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as a number that sorts as they do."""
    eight = np.ndarray(len(body) - 7, ">u8", buffer=body, strides=(1,))
    return (eight[at] >> np.uint64(1)).astype(np.int64)


def pack(strings: list[bytes], *columns: np.ndarray) -> bytes:
    size = np.array([len(strings), *map(len, strings)], np.int32)
    numbers = b"".join(c.astype(np.int64).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=6).compress(
        size.tobytes() + numbers + b"".join(strings)
    )


def unpack(blob: bytes, columns: int) -> tuple[list[bytes], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    size = np.frombuffer(raw, np.int32, n, 4)
    at = 4 + 4 * n
    numbers = np.frombuffer(raw, np.int64, n * columns, at).reshape(columns, n)
    edge = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]) + at + 8 * n * columns
    return [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], numbers


def merged(strings, low, high, times, offset) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Equal strings once, with least and greatest id, number of places and offset; groups."""
    seen: dict[bytes, int] = {}
    group = np.array([seen.setdefault(s, len(seen)) for s in strings], np.int64)
    out = np.empty((4, len(seen)), np.int64)
    out[0], out[1], out[2] = NULL_ID, -NULL_ID - 1, 0
    np.minimum.at(out[0], group, low)
    np.maximum.at(out[1], group, high)
    np.add.at(out[2], group, times)
    out[3][group] = offset
    return list(seen), out, group


def packed_runs(texts: DataFrame, windows: Windows, plan: Survey) -> DataFrame:
    """``bucket, blob``: the merged runs of some MB of text, by bucket."""
    hot, buckets, splitters = plan.hot, plan.buckets, plan.splitters
    sub = max(1, buckets // (len(splitters) + 1))

    def bucket_of(gram: np.ndarray, lead: np.ndarray | None) -> np.ndarray:
        if lead is None:
            return (gram % np.uint64(buckets)).astype(np.int64)
        return np.searchsorted(splitters, lead, side="right") * sub + (
            gram % np.uint64(sub)
        ).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group, ids, _, _ in pieces(batches, windows):
            runs = runs_of(group, windows, hot)
            if runs is None:
                continue
            key = ids[runs.doc].astype(np.int64)
            lead = None
            if not windows.by_words:
                lead = leading(np.frombuffer(runs.body, np.uint8), runs.begin + runs.offset)
            strings, numbers, same = merged(
                runs.strings(), key, key, np.ones(len(key), np.int64), runs.offset
            )
            bucket = np.empty(len(strings), np.int64)
            bucket[same] = bucket_of(runs.gram, lead)
            numbers[1] -= numbers[0]  # zero for most, which compresses well
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            names, blobs = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                part = order[a:b]
                names.append(int(bucket[part[0]]))
                blobs.append(pack([strings[i] for i in part], *numbers[:, part]))
            yield names, blobs

    return _mapped(texts, "bucket long, blob binary", run)


def repeated_runs(
    texts: DataFrame, windows: Windows, plan: Survey, earlier: bool
) -> DataFrame:
    """Runs with repeated windows: digest and stretches of windows with the least id of each.

    With ``earlier``, windows count that also lie in a text of lower id; else those found twice.
    """
    out = "d1 long, d2 long, begin array<int>, stop array<int>, low array<long>"
    arrow = to_arrow_schema(struct(out))

    def run(table: pa.Table) -> pa.Table:
        strings: list[bytes] = []
        numbers = []
        for blob in table.column("blob").to_pylist():
            more, columns = unpack(blob, 4)
            strings += more
            numbers.append(columns)
        low, high, times, offset = np.concatenate(numbers, axis=1)
        strings, (low, high, times, offset), _ = merged(strings, low, high + low, times, offset)
        found = repeated_windows(strings, low, times, offset, windows)
        columns: list[list] = [[], [], [], [], []]
        for i, begin, stop, least in found:
            if earlier:
                use = least < high[i]
                begin, stop, least = begin[use], stop[use], least[use]
            if len(begin):
                d = xxhash.xxh3_128_digest(strings[i])
                columns[0].append(int.from_bytes(d[:8], "little", signed=True))
                columns[1].append(int.from_bytes(d[8:], "little", signed=True))
                columns[2].append(begin.tolist())
                columns[3].append(stop.tolist())
                columns[4].append(least.tolist())
        return pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
        )

    return packed_runs(texts, windows, plan).groupBy("bucket").applyInArrow(run, out)


def repeated_windows(
    strings: list[bytes],
    low: np.ndarray,
    times: np.ndarray,
    offset: np.ndarray,
    windows: Windows,
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run with windows found twice or more: stretches of them and the least id.

    ``strings`` are different runs. Those that share their n-gram with no other are settled by
    their own count; the rest is sorted some MB at a time, n-gram by n-gram.
    """
    gram = np.concatenate(
        [
            gram_of(strings[i : i + 8192], offset[i : i + 8192], windows)
            for i in range(0, len(strings), 8192)
        ]
        or [np.empty(0, np.uint64)]
    )
    order = np.argsort(gram, kind="stable")
    cuts = np.flatnonzero(gram[order][1:] != gram[order][:-1]) + 1
    edges = np.concatenate([[0], cuts, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    batch: list[int] = []
    held = 0
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a == 1:
            i = int(order[a])
            if times[i] > 1:
                n = window_count(strings[i], windows)
                yield i, np.array([0]), np.array([n]), low[i : i + 1]
            continue
        batch += order[a:b].tolist()
        held += sum(len(strings[i]) for i in batch[a - b :])
        if held >= windows.chunk // 2:
            yield from sorted_windows(batch, strings, low, times, windows)
            batch, held = [], 0
    if batch:
        yield from sorted_windows(batch, strings, low, times, windows)


def window_count(string: bytes, windows: Windows) -> int:
    units = string.count(b" ") + 1 if windows.by_words else len(string)
    return units - windows.size + 1


def gram_of(strings: list[bytes], offset: np.ndarray, windows: Windows) -> np.ndarray:
    units = Units(strings, windows)
    return units.grams[units.first + offset]


def sorted_windows(
    batch: list[int],
    strings: list[bytes],
    low: np.ndarray,
    times: np.ndarray,
    windows: Windows,
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    units = Units([strings[i] for i in batch], windows)
    k = windows.size
    begin = np.flatnonzero(units.starts_inside(k))
    filled = units.first
    run = np.searchsorted(filled, begin, side="right") - 1
    which = np.array(batch)[run]
    order, fresh = sort_windows(units, begin)
    edges = np.flatnonzero(fresh)
    size = np.diff(np.append(edges, len(order)))
    least = np.repeat(np.minimum.reduceat(low[which[order]], edges), size)
    count = np.repeat(np.add.reduceat(times[which[order]], edges), size)
    lows, counts = np.empty_like(least), np.empty_like(count)
    lows[order], counts[order] = least, count
    twice = counts > 1
    new = twice.copy()
    new[1:] &= ~twice[:-1] | (run[1:] != run[:-1]) | (lows[1:] != lows[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return
    more = np.append(twice[1:] & ~new[1:], False)
    last = np.flatnonzero(twice & ~more)
    place = begin - filled[run]
    owner = run[first]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for part in np.split(np.arange(len(first)), cuts):
        a, b = first[part], last[part]
        yield batch[owner[part[0]]], place[a], place[b] + 1, lows[a]


def sort_windows(units: Units, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows in which equal ones are neighbours, and where groups begin.

    Multikey: windows are sorted by one character, and only those that tie go on to the next.
    Characters are the first n-gram and then digests of ever longer blocks of units.
    """
    k = units.windows.size
    values = units.hash if units.windows.by_words else BYTE_HASH[units.body[: units.total]]
    short = min(k, 8)
    rest = k - short
    half = rest - rest // 2
    keys = [rolled(values, short)[begin]]
    if half:
        block = rolled(values, half)
        keys += [block[begin + short], block[begin + k - half]]
    order = np.argsort(keys[0])
    fresh = np.diff(keys[0][order], prepend=~keys[0][order[:1]]) != 0
    for key in keys[1:]:
        group = np.cumsum(fresh)
        alone = fresh & np.append(fresh[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        own = order[tied]
        inner = np.lexsort((key[own], group[tied]))
        order[tied] = own[inner]
        value, group = key[own[inner]], group[tied]
        fresh[tied[1:]] |= (value[1:] != value[:-1]) & (group[1:] == group[:-1])
    return order, fresh


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) << np.uint64(20))


def spans(
    docs: DataFrame, windows: Windows, earlier: bool, id_col: str, text: str, ranges: int = 0
) -> DataFrame:
    """``__id, __hash, __spans``: stretches of units, in each text, that repeated windows cover."""
    texts = prepared(docs, id_col, text)
    plan = survey(texts, windows, ranges)
    hot = plan.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group, ids, own, base in pieces(batches, windows):
            runs = runs_of(group, windows, hot)
            if runs is None:
                continue
            digest = b"".join(map(xxhash.xxh3_128_digest, runs.strings()))
            two = np.frombuffer(digest, "<i8").reshape(-1, 2)
            place = runs.place + base[runs.doc]
            # Equal runs one after the other, as in text of a short period, are one row. A run is
            # shorter than a window, so what their windows cover has no gaps either.
            first = np.flatnonzero(
                np.concatenate([[True], (runs.doc[1:] != runs.doc[:-1]) | (two[1:] != two[:-1]).any(axis=1)])
            )
            last = np.append(first[1:], len(place)) - 1
            doc = runs.doc[first]
            yield two[first, 0], two[first, 1], ids[doc], own[doc], place[first], place[last]

    ddl = "d1 long, d2 long, __id long, __hash long, place long, last long"
    places = _mapped(texts, ddl, run)
    found = repeated_runs(texts, windows, plan, earlier)
    hits = places.join(found, ["d1", "d2"]).select(
        "__id",
        "__hash",
        "place",
        "last",
        F.explode(F.arrays_zip("begin", "stop", "low")).alias("s"),
    )
    if earlier:
        hits = hits.filter(F.col("s.low") < F.col("__id"))
    span = F.struct(
        (F.col("place") + F.col("s.begin")).alias("begin"),
        (F.col("last") + F.col("s.stop") + F.lit(windows.size - 1)).alias("stop"),
    )
    # Rows that repeat each other give equal spans, which are kept once.
    return hits.groupBy("__id", "__hash").agg(F.collect_set(span).alias("__spans"))


def with_spans(
    docs: DataFrame, found: DataFrame, id_col: str, text: str, ddl: str, compute: Compute
) -> DataFrame:
    """``docs`` with the columns of ``ddl``, worked out from each text and its ``__spans``.

    Both sides meet by id and hash of the text. Texts cross the shuffle compressed.
    """
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.withColumns({"__id": key, "__hash": F.xxhash64(body)})
    keyed = keyed.withColumn("__known", F.col(f"`{text}`").isNotNull())

    def shrink(_: pa.RecordBatch, texts: list[bytes]) -> dict[str, list]:
        compress = zstandard.ZstdCompressor(level=3).compress
        return {"__body": [compress(t) if t else t for t in texts]}

    packed = add_columns(keyed, text, "__body binary", shrink).drop(text)
    joined = packed.join(found, ["__id", "__hash"], "left")

    def results(batch: pa.RecordBatch, texts: list[bytes]) -> dict[str, list]:
        known = batch.column(batch.schema.get_field_index("__known")).to_pylist()
        out = compute(batch, texts)
        out[text] = [t.decode("utf-8", "replace") if k else None for t, k in zip(texts, known)]
        return out

    full = add_columns(joined, "__body", f"`{text}` string, {ddl}", results, packed=True)
    new = [f.name for f in struct(ddl)]
    lowered = {n.lower() for n in new}
    kept = [c for c in docs.columns if c.lower() not in lowered]
    return full.select(*[f"`{c}`" for c in (*kept, *new)])


def union_of(spans_: list | None) -> list[tuple[int, int]]:
    """Disjoint stretches in order."""
    out: list[list[int]] = []
    for s in sorted((s["begin"], s["stop"]) for s in spans_ or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([*s])
    return [(a, b) for a, b in out]
