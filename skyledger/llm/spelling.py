"""Spelling variants: words of the whole corpus at one edit from each other, and their main form.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only and
counted over all documents. Two words are near if one inserted, deleted or replaced code point
turns one into the other. A word's form is its near word of largest count (smallest word on ties)
if that is at least ``ratio`` times its own count; its root is where following forms ends.

How near words are found:

1. Two near words of lengths L and L or L + 1 agree outside one half of the shorter one, so each
   word goes to a bucket for either half it may differ in, named by what lies outside. A bucket of
   more than ``BUCKET`` words is cut again: its half is halved, and so on down to one position,
   where the letters of the alphabet bound it (94 words of length L and 94 squared of L + 1). The
   bucket's name is a hash; words that meet by chance are told apart by the scan itself.
2. A bucket is sorted. Each word is compared with those after it by the banded edit matrix, three
   cells a row. Rows of a candidate's prefix are kept, and the next candidate starts from the row
   of the prefix it shares with the one before (adjacent LCP). Where all three cells of a row
   exceed one edit, every candidate that shares this prefix is skipped.
3. A pair counts in one bucket only, that which holds the first place where its words differ.

Defined results: a null text has no words; rows that repeat each other count each; a null id is
written as an empty one where the id matters (``noise``); an empty table has no words. Further
columns do not matter and may have any name. Texts are read whole; a run of any length is a word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skyledger.llm.frames import struct
from skyledger.llm.words import chunks
from skyledger.sources.tables import stage

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
BUCKET = 256
#: Different words a task holds before it hands their counts on.
HELD = 200_000

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
PLACE = ("length", "lo", "hi", "key")


def misspelt(run: bytes, h: int) -> bytes:
    """``run`` without its code point ``h % length``."""
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(
    docs: DataFrame, id_col: str, text: str, min_length: int, noise: int | None
) -> DataFrame:
    """``word, n``: partial counts of each task, for words of ``min_length`` letters or more."""
    arrow = to_arrow_schema(struct("word string, n long"))

    def flushed(held: Counter) -> pa.RecordBatch:
        words = [w for w in held if len(w) - w.count(b"\xc3") >= min_length]
        columns = [[w.decode() for w in words], [held[w] for w in words]]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, arrow)], names=arrow.names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch, texts in chunks(batches, "text"):
            for name, body in zip(batch.column(0).to_pylist(), texts):
                found = Counter(RUN.findall(body.lower()))  # of bytes: A-Z only
                seed = crc32(b"" if name is None else b"%d" % name)
                seed = crc32(b":", seed)
                for word, n in found.items():
                    if noise and not (h := crc32(word, seed)) % noise:
                        word = misspelt(word, h)
                    held[word] += n
                if len(held) > HELD:
                    yield flushed(held)
        yield flushed(held)

    source = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")
    )
    return source.mapInArrow(run, struct("word string, n long"))


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    noise: int | None = None,
) -> DataFrame:
    """``word, n`` of all documents.

    With ``noise`` a letter is dropped from a word in a document wherever the CRC-32 of
    ``<id>:<word>`` is a multiple of it: misspellings that anyone can make again.
    """
    counts = word_counts(docs, id_col, text, min_length, noise)
    total = counts.groupBy("word").agg(F.sum("n").alias("n"))
    return total.filter(F.col("n") >= min_count)


def _halves(lo: Column, hi: Column) -> Column:
    middle = F.floor((lo + hi) / 2).cast("int")
    return F.array(
        F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi"))
    )


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with either half of its stretch, and the hash of what lies outside."""
    halves = rows.select(
        "word", "n", "size", "length", F.inline(_halves(F.col("lo"), F.col("hi")))
    )
    right = F.col("length") - F.col("hi")
    outside = (
        F.col("word").substr(F.lit(1), F.col("lo")),
        F.col("word").substr(F.col("size") - right + 1, right),
    )
    return halves.withColumn("key", F.xxhash64(*outside))


def buckets(words: DataFrame, min_length: int, most: int = BUCKET) -> DataFrame:
    """Buckets of two words or more: ``word, n`` and the place of its bucket.

    ``length`` is that of the shorter word of a pair, ``lo`` to ``hi`` the stretch of it that may
    differ. Every round halves the stretches of buckets that hold more than ``most`` words.
    """
    size = F.char_length("word")
    sized = words.select("word", "n", size.alias("size"))
    whole = sized.withColumn(
        "length", F.explode(F.array(F.col("size"), F.col("size") - 1))
    ).filter(F.col("length") >= max(1, min_length))
    todo = _halved(whole.withColumns({"lo": F.lit(0), "hi": F.col("length")}))
    done: DataFrame | None = None
    while True:
        sizes = todo.groupBy(*PLACE).agg(F.count("*").alias("members"))
        judged = stage(todo.join(sizes.filter("members > 1"), list(PLACE)), "buckets")
        small = (F.col("members") <= most) | (F.col("hi") - F.col("lo") <= 1)
        ready = judged.filter(small).select("word", "n", *PLACE)
        done = ready if done is None else done.unionByName(ready)
        large = judged.filter(~small)
        if large.isEmpty():
            return done
        todo = _halved(large)


def shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def near_pairs(words: Sequence[str]) -> Iterator[tuple[int, int, int]]:
    """All ``i < j`` of a sorted list of different words with one edit between them, and where.

    The third number is the first place at which the two words differ.
    """
    lcp = [0, *map(shared, words[:-1], words[1:])]
    common = shared(words[0], words[-1]) if words else 0
    rows: list[tuple[int, int, int]] = [(2, 0, 1)] * (common + 1)
    for i, query in enumerate(words):
        size = len(query)
        # Row d: edits between the candidate's first d letters and d - 1, d, d + 1 of the query.
        del rows[common + 1 :]
        for d in (0, common):
            rows[d] = (1 if d else 2, 0, 1 if d < size else 2)
        known, dead = common, -1
        for j in range(i + 1, len(words)):
            if j > i + 1 and lcp[j] < known:
                known = max(lcp[j], common)
                del rows[known + 1 :]
            if dead >= 0:
                if lcp[j] >= dead:
                    continue
                dead = -1
            word = words[j]
            a, b, c = rows[known]
            for d in range(known + 1, len(word) + 1):
                x = word[d - 1]
                below = b + 1
                if 2 <= d <= size + 1 and x == query[d - 2] and a < below:
                    below = a
                if d <= size:
                    here = b if x == query[d - 1] else b + 1
                    if c + 1 < here:
                        here = c + 1
                    if below + 1 < here:
                        here = below + 1
                    if d < size:
                        above = c if x == query[d] else c + 1
                        if here + 1 < above:
                            above = here + 1
                    else:
                        above = 2
                else:
                    here = above = 2
                a, b, c = below, here, above
                rows.append((a, b, c))
                known = d
                if a > 1 and b > 1 and c > 1:
                    dead = d
                    break
            else:
                off = size - len(word)
                if -1 <= off <= 1 and (a, b, c)[off + 1] == 1:
                    yield i, j, shared(query, word)


def near_words(placed: DataFrame) -> DataFrame:
    """``word, n_near, best``: near words in each bucket; the commonest as ``-n`` and word."""
    ddl = "word string, n_near long, less long, near string"
    arrow = to_arrow_schema(struct(ddl))

    def settled(place: tuple, words: list[str], counts: list[int]) -> Iterator[tuple]:
        length, lo, hi, _ = place
        best: dict[int, tuple[int, int, str]] = {}
        for i, j, at in near_pairs(words):
            own = min(len(words[i]), len(words[j])) == length
            if own and (lo <= at < hi or at == hi == length):
                for x, y in ((i, j), (j, i)):
                    n, less, name = best.get(x, (0, 1, ""))
                    less, name = min((less, name), (-counts[y], words[y]))
                    best[x] = n + 1, less, name
        for x, found in best.items():
            yield words[x], *found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, words, counts, out = None, [], [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for word, n, *now in zip(*columns):
                if now != place:
                    if place is not None:
                        out += settled(place, words, counts)
                    place, words, counts = now, [], []
                words.append(word)
                counts.append(n)
            if len(out) > 10_000:
                yield from batch_of(out)
                out = []
        if place is not None:
            out += settled(place, words, counts)
        yield from batch_of(out)

    def batch_of(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], names=arrow.names
            )

    dealt = placed.repartition(*PLACE).sortWithinPartitions(*PLACE, "word")
    found = dealt.select("word", "n", *PLACE).mapInArrow(run, struct(ddl))
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words with a form: a form's form takes its place until none has one.

    Counts at least double along a chain, so the rounds are few: each doubles what is followed.
    """
    links = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nearer = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(nearer, "root", "left")
        if moved.filter("next is not null").isEmpty():
            return links
        links = stage(
            moved.select("word", F.coalesce("next", "root").alias("root")), "roots"
        )


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    noise: int | None = None,
    bucket: int = BUCKET,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of the corpus."""
    words = stage(vocabulary(docs, id_col, text, min_length, min_count, noise), "vocabulary")
    near = near_words(buckets(words, min_length, bucket))
    form_n = -F.col("best.less")
    main = form_n >= ratio * F.col("n")
    judged = stage(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(main, F.col("best.near")).alias("form"),
            F.when(main, form_n).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
