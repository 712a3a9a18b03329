"""Periodic runs of words.

A run is a stretch of words with smallest period q, at least two periods long, that
neither neighbour extends. Its first word and the one q later begin the same
substring of length - q words, which cannot be prolonged to the left or right: a
maximal pair at distance q. Conversely a maximal pair of a substring at least as
long as its distance covers a stretch that has this distance as period and ends at
both sides, so it is a run as it stands, and nothing is extended.

Maximal pairs come from the suffixes of a text in order: their common prefixes nest
as intervals, which are visited from the longest prefix to the shortest. Each holds
the list of its positions in text order, every position with the word on its left as
its class; when intervals merge, positions of different parts and different classes
are pairs that differ on both sides. Only neighbours in the list are asked: were
the substring to occur between the first word of a run and the word q later, the
first q words would occur inside their own square and have a smaller period. So every
run appears once, with its smallest period, and the work is n log n.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import slices

LEAST_WORDS = 12
SLICE = 1 << 20  # bytes of text whose suffixes are ordered together
FEW = 16  # a list this many times longer takes the positions of the other one by one

Run = tuple[int, int, int]  # start, length, period


# -- suffixes ---------------------------------------------------------------------

def _ranks(values: np.ndarray) -> np.ndarray:
    """How many values are smaller: equal values share a rank, and a value met once has one of its own."""
    _, number, times = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(times) - times)[number]


def _followed(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks of what begins at each position joined to the ranks ``step`` further on; an end comes before any word."""
    after = np.zeros(len(rank), np.int64)
    after[:len(rank) - step] = rank[step:] + 1
    return _ranks(rank * (len(rank) + 1) + after)


def _refined(rank: np.ndarray, step: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_followed`` for the positions ``shared``, whose ranks are no longer their own; and which of them still are not."""
    after = np.zeros(len(shared), np.int64)
    inside = shared + step < len(rank)
    after[inside] = rank[shared[inside] + step] + 1
    own = rank[shared]
    order = np.lexsort((after, own))
    shared, own, after = shared[order], own[order], after[order]
    group = np.append(True, own[1:] != own[:-1])
    part = group | np.append(True, after[1:] != after[:-1])
    at = np.arange(len(order))
    first, begin = (np.maximum.accumulate(np.where(x, at, 0)) for x in (group, part))
    out = rank.copy()
    out[shared] = own + begin - first
    alone = part & np.append(part[1:], True)
    return out, shared[~alone]


def repeated_suffixes(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``least`` words occur elsewhere too, ordered by their suffixes, and common prefixes.

    The second array tells how many words a suffix shares with the one before it,
    and 0 where that is fewer than ``least``. Substrings are ranked at doubling
    lengths; only positions that still share their rank take part in the next round.
    """
    none = np.zeros(0, np.int64)
    if len(words) <= least:
        return none, none
    levels, width = [(1, _ranks(words))], 1
    while width < least:
        step = min(width, least - width)
        levels.append((width + step, _followed(levels[-1][1], step)))
        width += step
    lowest = len(levels) - 1
    rank = levels[-1][1]
    times = np.bincount(rank, minlength=len(words))
    repeated = shared = np.flatnonzero(times[rank] > 1)
    if not len(repeated):
        return none, none
    while len(shared):
        rank, shared = _refined(rank, width, shared)
        width *= 2
        levels.append((width, rank))
    order = repeated[np.argsort(rank[repeated])]
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(left), np.int64)
    end = len(words)
    for number, (width, rank) in reversed(list(enumerate(levels))):
        same = (left < end) & (right < end)
        same[same] = rank[left[same]] == rank[right[same]]
        if number < lowest:  # finer steps matter only behind ``least`` shared words
            same &= common > 0
        for x in (common, left, right):
            x[same] += width
    return order, np.append(0, common)


# -- intervals --------------------------------------------------------------------

def word_runs(words: np.ndarray, least: int = LEAST_WORDS) -> list[Run]:
    """(start, length, period) of all runs of at least ``least`` words, by start, then period."""
    # Of a run of L words and period q <= L / 2 the repeated substring has L - q >= L / 2 words.
    order, common = repeated_suffixes(words, max(1, (least + 1) // 2))
    positions = order.tolist()
    left_word = dict(zip(positions, np.append(-1, words)[order].tolist(), strict=True))  # -1 before the first word
    periods: dict[tuple[int, int], int] = {}  # by start and length

    def pair(one: int, other: int, shared: int) -> None:
        period, length = other - one, other - one + shared
        if period <= shared and length >= least and left_word[one] != left_word[other]:
            periods[one, length] = min(period, periods.get((one, length), period))

    def merged(one: list[int], other: list[int], shared: int) -> list[int]:
        large, small = (one, other) if len(one) >= len(other) else (other, one)
        if FEW * len(small) < len(large):
            for p in small:
                at = bisect_left(large, p)
                if at:
                    pair(large[at - 1], p, shared)
                if at < len(large):
                    pair(p, large[at], shared)
            for p in small:
                insort(large, p)
            return large
        own, both = set(small), sorted(large + small)
        for p, after in zip(both, both[1:]):
            if (p in own) != (after in own):
                pair(p, after, shared)
        return both

    open_: list[tuple[int, list[int]]] = []  # intervals with the prefix they share with what follows, shortest first
    current: list[int] = []
    for p, shared in zip([*positions, -1], [*common.tolist(), 0], strict=True):
        while open_ and open_[-1][0] >= shared:
            prefix, before = open_.pop()
            current = merged(before, current, prefix)
        if shared:
            open_.append((shared, current))
        current = [p]
    return sorted((start, length, period) for (start, length), period in periods.items())


def runs_of_texts(texts: Sequence[bytes], least: int = LEAST_WORDS) -> list[tuple[list[bytes], list[Run]]]:
    """Words and runs of each text; the suffixes of all are ordered at once, parted by words of their own."""
    known: dict[bytes, int] = {}
    parted = [t.split() for t in texts]  # at 0x20 and 0x09-0x0D only, as the texts are in bytes
    numbers = [[known.setdefault(w, len(known)) for w in own] for own in parted]
    sizes = np.array([len(own) + 1 for own in parted], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    flat = np.array([x for own in numbers for x in (*own, len(known))], np.int64)  # one more word ends each text
    runs: list[list[Run]] = [[] for _ in texts]
    begins = np.cumsum(sizes) - sizes
    for start, length, period in word_runs(owner * (len(known) + 1) + flat, least):
        runs[owner[start]].append((start - int(begins[owner[start]]), length, period))
    return list(zip(parted, runs, strict=True))


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> bytes:
    """The words without those that a run repeats: all but its first ``period`` words."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


# -- documents --------------------------------------------------------------------

def _find(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for a, b in slices(batch.column(1), SLICE):
                found = runs_of_texts([t or b"" for t in texts[a:b].to_pylist()], least)
                flat = np.array([r for _, runs in found for r in runs], np.int64).reshape(-1, 3)
                bounds = pa.array(np.cumsum([0, *[len(runs) for _, runs in found]]), pa.int32())
                parts = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([len(words) for words, _ in found], pa.int64()), pa.ListArray.from_arrays(bounds, parts),
                     pa.array([collapsed(words, runs).decode() for words, runs in found], pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are parted by ASCII white space; ``collapsed`` joins by one space those
    that stay when every run is cut to its first period. Null and empty texts have
    no words, no runs and an empty ``collapsed``; ids pass through, null and
    repeated ones too; other columns are not read; an empty table gives no rows.
    Memory grows with the longest text, about 100 bytes a word for each doubling of
    its longest repetition.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_find(least), f"doc_id {kind}, n_words bigint, "
                           "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text; in one document of ten, chosen by a checksum of its id, the words from some place on repeat.

    Documents without id stay as they are.
    """
    h = f"crc32(cast(cast({doc_id} as string) as binary))"
    planted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.expr(f"{h} div 10").alias("g"),
                          F.expr(rf"if({h} % 10 = 0, regexp_extract_all({text}, r'[^\x20\x09-\x0D]+', 0), null)").alias("w"))
    planted = planted.withColumn("a", F.expr("cast(g % nullif(size(w), 0) as int)"))
    planted = planted.withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)"))
    repeated = "array_join(transform(sequence(0, size(w) - 1), i -> get(w, if(i >= a, a + (i - a) % p, i))), ' ')"
    return planted.select("doc_id", F.expr(f"if(size(w) > 0, {repeated}, text)").alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_planted_runs(spark.read.parquet(f"{folder}/documents.parquet"))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    found = periodic_runs(docs).withColumn("best", longest)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.expr("-best.start").alias("start"), F.col("best.length").alias("length"),
        F.expr("-best.period").alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
