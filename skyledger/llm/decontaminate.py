"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of letters, digits and bytes beyond ASCII. Documents and test items
meet on seeds, rolling hashes of ``MATCH`` tokens (running Karp-Rabin). For each document and item
with seeds that could cover enough of the item, the longest match of unmarked tokens is marked
again and again, so passages in another order still count. The share of an item's tokens inside
tiles is its coverage; a document is contaminated if any item reaches ``COVERAGE`` by ``EVIDENCE``
tokens or more. A shorter item has to be there whole; one of fewer than ``MATCH`` tokens, such as
a common word, must also make up ``COVERAGE`` of the document. ``short_items`` lists those.

Steps, all of them Spark jobs; neither items nor documents reach the driver:

1. ``item_seeds``: distinct items and their seeds, written down.
2. ``seed_filter``: a bitmap of seed hashes, of 2 ** ``FILTER_BITS`` bits at most, the only thing broadcast.
3. ``text_seeds``: a pass over the documents leaves the seeds that the bitmap knows, with their
   places, once for equal texts. What the bitmap lets through by chance finds no partner later.
4. ``candidates``: a join on seeds. An item asks only for its rarest ones: the others together
   cover too little of it, so a document that covers enough holds a rare one. Seeds that a third of
   all documents share are thus left out wherever they do not decide.
5. ``tiled``: each pair that met is tiled from places and seeds; no text is shuffled.

Null and empty items match nothing; null and empty documents hold nothing. Repeated items and rows
each get rows of their own, though equal texts are tiled once. Very long texts are read whole. Further
columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.frames import add_columns, map_texts, set_aside
from skyledger.llm.words import IS_SPACE, Words, inside_doc, mix, rolled
from skyledger.sources.tables import stage

MATCH = 5
COVERAGE = 0.5
EVIDENCE = 8
#: Bits of the broadcast filter for each seed, as long as all together are 2 ** 26 (8 MB) at most.
FILTER_ROOM = 1024
FILTER_BITS = 26

SEPARATORS = IS_SPACE.copy()
SEPARATORS[:128] = [not chr(i).isalnum() for i in range(128)]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the first of each text."""
    lowered = [t.decode("utf-8", "replace").lower().encode() for t in texts]
    words = Words(lowered, SEPARATORS)
    return words.hashes(), words.first


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Seeds of ``n`` tokens; those of different lengths differ."""
    return mix(rolled(hashes, n) ^ np.uint64(n))


def wanted(size: int, least: float, evidence: int, match: int, length: int = 0) -> float:
    """Tokens of an item that have to be covered.

    Of items of ``match`` tokens or more, ``evidence`` tokens count at least, or all; shorter
    ones count in texts, of ``length`` tokens, of which they are a share of ``least``.
    """
    need = max(least * size, min(size, evidence))
    return max(need, least * length) if size < match else need


def _reach(place: np.ndarray, n: int, size: int) -> int:
    """Tokens of the item inside any seed."""
    edge = np.bincount(place, minlength=size + 1) - np.bincount(place + n, minlength=size + 1)
    return int((np.cumsum(edge[:size]) > 0).sum())


def tile(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Tiles ``(begin in text, begin in item, length)`` of ``n`` tokens or more.

    ``left[i]`` and ``right[i]`` are the starts of equal windows of ``n`` tokens. The longest match
    of unmarked tokens is marked first, the earliest of equally long ones.
    """
    order = np.lexsort((right, left - right))
    left, right = left[order], right[order]
    chain = (np.diff(left) == 1) & (np.diff(right) == 1)
    begin = np.flatnonzero(np.concatenate([[True], ~chain]))
    length = np.diff(np.append(begin, len(left))) + n - 1
    heap = [
        (-k, i, j)
        for k, i, j in zip(length.tolist(), left[begin].tolist(), right[begin].tolist())
    ]
    heapq.heapify(heap)
    marked_l: set[int] = set()
    marked_r: set[int] = set()
    tiles = []
    while heap:
        k, i, j = heapq.heappop(heap)
        free = [i + x not in marked_l and j + x not in marked_r for x in range(-k)]
        if all(free):
            tiles.append((i, j, -k))
            marked_l.update(range(i, i - k))
            marked_r.update(range(j, j - k))
            continue
        at = 0
        for x, ok in enumerate([*free, False]):
            if not ok:
                if x - at >= n:
                    heapq.heappush(heap, (at - x, i + at, j + at))
                at = x + 1
    return tiles


def _key(text: Column) -> Column:
    """What equal texts share."""
    return F.md5(text.cast("binary"))


def by_seed(
    text: np.ndarray, place: np.ndarray, seed: np.ndarray
) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Text and seed of each pair of the two, and its places in order."""
    order = np.lexsort((place, seed, text))
    text, place, seed = text[order], place[order], seed[order].view(np.int64)
    new = (np.diff(text) != 0) | (np.diff(seed) != 0)
    begin = np.flatnonzero(np.concatenate([[True], new])) if len(text) else np.zeros(0, np.int64)
    places = pa.ListArray.from_arrays(
        pa.array(np.append(begin, len(place)), pa.int32()), pa.array(place, pa.int32())
    )
    return text[begin], seed[begin], places


def item_seeds(items: DataFrame, match: int = MATCH) -> DataFrame:
    """Seeds of each distinct text of column ``text`` and the tokens that they begin at, with its
    key, its tokens and the length of its seeds."""

    def compute(batch: pa.RecordBatch, texts: list[bytes]) -> dict[str, list]:
        hashes, first = tokens(texts)
        sizes = np.diff(first)
        own, place, value = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.uint64))
        for i in np.flatnonzero(sizes):
            n = min(int(sizes[i]), match)
            value.append(grams(hashes[first[i] : first[i + 1]], n))
            place.append(np.arange(len(value[-1])))
            own.append(np.full(len(value[-1]), i))
        text, seed, places = by_seed(*(np.concatenate(x) for x in (own, place, value)))
        return {
            "item_key": batch.column("item_key").take(pa.array(text)),
            "item_tokens": sizes[text],
            "n": np.minimum(sizes[text], match),
            "seed": seed,
            "item_places": places,
        }

    texts = items.select(_key(F.col("text")).alias("item_key"), "text").dropDuplicates(["item_key"])
    ddl = "item_key string, item_tokens int, n int, seed long, item_places array<int>"
    return map_texts(texts, "text", ddl, compute)


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bitmap of the seeds' leading bits, 2 ** ``FILTER_BITS`` long at most however many they are."""
    total = max(1, seeds.count())
    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(FILTER_ROOM * total))))
    words = (
        seeds.select(F.shiftrightunsigned("seed", 64 - bits).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask"))
        .toArrow()
    )
    out = np.zeros(1 << bits - 6, np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def text_seeds(texts: DataFrame, known: np.ndarray, lengths: list[int]) -> DataFrame:
    """Seeds of each distinct text that ``known`` holds, and the tokens that they begin at."""
    held = texts.sparkSession.sparkContext.broadcast(known)

    def compute(batch: pa.RecordBatch, bodies: list[bytes]) -> dict[str, list]:
        bitmap = held.value
        unused = np.uint64(64 - 6 - (len(bitmap).bit_length() - 1))
        hashes, first = tokens(bodies)
        places, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for n in lengths:
            if n > len(hashes):
                continue
            begin = np.flatnonzero(inside_doc(first, n, len(hashes)))
            value = grams(hashes, n)[begin]
            slot = value >> unused
            met = bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) > 0
            places.append(begin[met])
            seeds.append(value[met])
        place = np.concatenate(places)
        text = np.searchsorted(first, place, side="right") - 1
        text, seed, places = by_seed(text, place - first[text], np.concatenate(seeds))
        return {
            "key": batch.column("key").take(pa.array(text)),
            "text_tokens": np.diff(first)[text],
            "seed": seed,
            "places": places,
        }

    keyed = texts.select(_key(F.col("text")).alias("key"), "text")
    same = [F.first(c).alias(c) for c in ("text_tokens", "places")]
    found = map_texts(keyed, "text", "key string, text_tokens int, seed long, places array<int>", compute)
    return found.groupBy("key", "seed").agg(*same)


def rarest(
    place: np.ndarray, seed: np.ndarray, docs: np.ndarray, size: int, n: int, need: float
) -> np.ndarray:
    """Seeds of an item of which a text that covers ``need`` of its tokens holds one at least.

    The most frequent seeds are left out as long as all of them together cover less than that.
    ``place`` holds where the seeds that any text has begin, ``docs`` how many texts have each.
    """
    order = np.lexsort((seed, -docs))
    rank = np.empty(len(seed), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], np.diff(seed[order]) != 0]))
    covered = np.full(size, len(seed))  # by the most frequent seed around each token
    for x in range(n):
        np.minimum.at(covered, place + x, rank)
    ranks = np.sort(covered[covered < len(seed)])
    if len(ranks) < need:
        return seed[:0]
    return np.unique(seed[rank >= (ranks[math.ceil(need) - 1] if need > 0 else 0)])


def candidates(
    texts: DataFrame, seeds: DataFrame, least: float, match: int, evidence: int
) -> DataFrame:
    """Keys of texts and items that share one of the item's rarest seeds."""
    held = texts.select("key", "seed")
    counted = seeds.join(held.groupBy("seed").agg(F.count("*").alias("docs")), "seed")

    def rare(rows: pd.DataFrame) -> pd.DataFrame:
        size, n = int(rows["item_tokens"].iloc[0]), int(rows["n"].iloc[0])
        times = rows["item_places"].map(len).to_numpy()
        place = np.concatenate(rows["item_places"].to_list())
        seed, docs = (np.repeat(rows[c].to_numpy(), times) for c in ("seed", "docs"))
        chosen = rarest(place, seed, docs, size, n, wanted(size, least, evidence, match))
        return pd.DataFrame({"item_key": rows["item_key"].iloc[0], "seed": chosen})

    asking = counted.groupBy("item_key").applyInPandas(rare, "item_key string, seed long")
    return held.join(asking, "seed").select("key", "item_key").distinct()


def pair_tiles(
    shared: list[tuple[np.ndarray, np.ndarray]], n: int, size: int, need: float
) -> list[tuple[int, int, int]]:
    """Tiles of a text and an item of ``size`` tokens; none where seeds cover too little.

    ``shared`` has the places in the text and in the item for each seed that both hold.
    """
    if size < need or not shared:
        return []
    if _reach(np.concatenate([item for _, item in shared]), n, size) < need:
        return []
    left = np.concatenate([np.repeat(text, len(item)) for text, item in shared])
    right = np.concatenate([np.tile(item, len(text)) for text, item in shared])
    return tile(left, right, n)


FIGURES = "key string, item_key string, item_tokens long, matched long, tiles long, longest long"


def tiled(
    pairs: DataFrame, texts: DataFrame, seeds: DataFrame, least: float, match: int, evidence: int
) -> DataFrame:
    """``FIGURES`` of the pairs that are covered enough."""
    both = F.collect_list(F.struct("places", "item_places")).alias("shared")
    met = pairs.join(texts, "key").join(seeds, ["item_key", "seed"])
    sized = met.groupBy("key", "item_key", "text_tokens", "item_tokens", "n").agg(both)

    def run(batches):
        for batch in batches:
            rows = []
            for r in (dict(zip(batch.schema.names, row)) for row in zip(*batch.columns)):
                keys = r["key"].as_py(), r["item_key"].as_py()
                n, size, length = (r[c].as_py() for c in ("n", "item_tokens", "text_tokens"))
                need = wanted(size, least, evidence, match, length)
                places = [r["shared"].values.field(c) for c in ("places", "item_places")]
                arrays = [[x.values.to_numpy() for x in p] for p in places]
                sizes = [t[2] for t in pair_tiles(list(zip(*arrays)), n, size, need)]
                if sizes and sum(sizes) >= need:
                    rows.append((*keys, size, sum(sizes), len(sizes), max(sizes)))
            columns = zip(*rows) if rows else [[]] * len(FIGURE_NAMES)
            types = [pa.string()] * 2 + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=FIGURE_NAMES
            )

    return sized.mapInArrow(run, FIGURES)


FIGURE_NAMES = ["key", "item_key", "item_tokens", "matched", "tiles", "longest"]


def contaminated(
    texts: DataFrame,
    items: DataFrame,
    least: float = COVERAGE,
    match: int = MATCH,
    evidence: int = EVIDENCE,
) -> DataFrame:
    """``FIGURES`` for distinct texts and items, each in column ``text``, written down."""
    asked = stage(item_seeds(items.filter("text is not null"), match), "items")
    lengths = sorted(r.n for r in asked.select("n").distinct().collect())  # at most ``match``
    met = stage(text_seeds(texts.filter("text is not null"), seed_filter(asked), lengths), "seeds")
    pairs = candidates(met, asked, least, match, evidence)
    return stage(tiled(pairs, met, asked, least, match, evidence), "tiled")


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.col(f"`{text}`").cast("string").alias("text"))


def _item_ids(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """Ids of the items by key."""
    ids = F.col(f"`{id_col}`").cast("long").alias("item_id")
    return items.select(_key(F.col(f"`{text}`").cast("string")).alias("item_key"), ids)


def with_tilings(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = COVERAGE,
    match: int = MATCH,
    evidence: int = EVIDENCE,
) -> DataFrame:
    """``docs`` with ``tilings``: the items each covers to ``least``, in order of their ids,
    null last."""
    found = contaminated(_texts(docs, text), _texts(items, item_text), least, match, evidence)
    tiling = ["item_id", "item_tokens", "matched", "tiles", "longest"]
    sorted_by = F.struct(F.col("item_id").isNull().alias("last"), *tiling)
    every = F.transform(
        F.array_sort(F.collect_list(sorted_by)), lambda t: F.struct(*[t[c].alias(c) for c in tiling])
    )
    held = (
        found.join(_item_ids(items, item_id, item_text), "item_key")
        .groupBy("key").agg(every.alias("tilings"))
    )
    names = docs.columns
    plain, _ = set_aside(docs, [])
    body = F.col(f"`{plain.columns[names.index(text)]}`").cast("string")
    joined = plain.withColumn("key", _key(body)).join(held, "key", "left")
    kept = [F.col(f"`{p}`").alias(c) for p, c in zip(plain.columns, names) if c.lower() != "tilings"]
    none = F.array().cast(held.schema["tilings"].dataType)
    return joined.select(*kept, F.coalesce("tilings", none).alias("tilings"))


def short_items(
    items: DataFrame, id_col: str = "item_id", text: str = "text", match: int = MATCH
) -> DataFrame:
    """Id and ``item_tokens`` of the items too short to be evidence inside a longer document."""

    def compute(_: pa.RecordBatch, texts: list[bytes]) -> dict[str, list]:
        return {"item_tokens": np.diff(tokens(texts)[1])}

    sized = add_columns(items, text, "item_tokens long", compute)
    return sized.filter(F.col("item_tokens") < match).select(f"`{id_col}`", "item_tokens")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each document and item that it covers enough of."""
    found = contaminated(_texts(docs, "text"), _texts(items, "text"))
    ids = docs.select(F.col(f"`{id_col}`"), _key(F.col("text").cast("string")).alias("key"))
    named = found.join(_item_ids(items, "item_id", "text"), "item_key")
    return ids.join(named, "key").select(
        f"`{id_col}`", "item_id", "item_tokens", "matched", "tiles", "longest"
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that cover no item enough, with the columns they came with."""
    plain, restored = set_aside(docs, [text])
    found = contaminated(_texts(docs, text), _texts(items, "text")).select("key").distinct()
    keyed = plain.withColumn("~key", _key(F.col(f"`{text}`").cast("string")))
    return restored(keyed.join(found, F.col("~key") == F.col("key"), "left_anti"))
