"""Packing token sequences by linear grouping.

Lengths are integers up to the capacity, so documents of one length are interchangeable and the plan is made from the
number of documents of each length: at most ``capacity`` rows, whatever the corpus holds.

1. Lengths above ``SMALL`` are cut into groups of equal cardinality and rounded up to the largest of their group.
2. Over these few sizes the best mix of configurations (which sizes share a sequence) is found by column generation.
3. The actual lengths take the places of their group, longest first, in as many sequences as the mix says; the last place
   of a sequence takes the longest document that the room left by the actual lengths admits.
4. What is left and the small documents go, longest first, to the fullest sequence that still takes them, else to a new one.

Sequences with the same lengths form one pattern, so steps 3 and 4 move whole runs of equal sequences.  The documents
then find their places in parallel: each knows its number among those of its length, and the plan says which numbers
go to which pattern, at which offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.common import chosen, texts_of
from claimloom.llm.tokens import byte_pairs
from claimloom.session import materialize

CAPACITY = 2048
GROUPS = 24
SMALL = 1 / 8


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """(rounded size, members) of groups of equal cardinality, longest first."""
    share = -(-sum(counts.values()) // groups) if counts else 1
    out, size, members = [], 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            size = size if members else length
            taken = min(left, share - members)
            left, members = left - taken, members + taken
            if members == share:
                out.append((size, members))
                members = 0
    return out + [(size, members)] if members else out


def _best_column(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest value (unbounded knapsack over the capacity)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(values > 1e-12)
    column = np.zeros(len(sizes))
    if not len(useful):
        return column
    s, v = sizes[useful], values[useful]
    order = np.argsort(s, kind="stable")
    s, v, useful = s[order], v[order], useful[order]
    for room in range(1, capacity + 1):
        fit = np.searchsorted(s, room, side="right")
        best[room] = best[room - 1]
        if fit:
            gains = best[room - s[:fit]] + v[:fit]
            j = int(np.argmax(gains))
            if gains[j] > best[room] + 1e-12:
                best[room], pick[room] = gains[j], j
    room = capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            column[useful[pick[room]]] += 1
            room -= int(s[pick[room]])
    return column


def configurations(sizes: list[int], demands: list[int], capacity: int, rounds: int = 600, tolerance: float = 2e-4) -> list[tuple[int, list[int]]]:
    """(times, members of each size) of the best mix over few sizes, rounded down: column generation with a simplex basis."""
    s, d = np.array(sizes), np.array(demands, dtype=float)
    basis = np.diag((capacity // s).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x, prices = inverse @ d, np.ones(len(s)) @ inverse
        column = _best_column(s, prices, capacity)
        if prices @ column <= 1 + tolerance:
            break
        step = inverse @ column
        ratios = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratios))] = column
    x = np.linalg.inv(basis) @ d
    return [(int(t + 1e-6), basis[:, j].astype(int).tolist()) for j, t in enumerate(x) if t + 1e-6 >= 1]


class _Plan:
    """Runs of equal sequences; each has the lengths in it, how many there are, and the room left."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, []  # open: sorted by (room, number)
        self.runs: dict[int, tuple[int, list[int]]] = {}

    def add(self, times: int, lengths: list[int]) -> None:
        if times:
            number = len(self.runs)
            self.runs[number] = (times, lengths)
            room = self.capacity - sum(lengths)
            self.open.insert(bisect_left(self.open, (room, number)), (room, number))

    def best_fit(self, length: int, count: int) -> None:
        """Put ``count`` documents of a length where the least room stays."""
        while count:
            at = bisect_left(self.open, (length, -1))
            if at == len(self.open):
                each = min(self.capacity // length, count)
                self.add(count // each, [length] * each)
                count %= each
                continue
            room, number = self.open.pop(at)
            times, lengths = self.runs[number]
            each = room // length
            full = min(times, count // each)
            if full:
                self.runs[number] = (full, lengths + [length] * each)
                left = room - each * length
                self.open.insert(bisect_left(self.open, (left, number)), (left, number))
                self.add(times - full, lengths)
                count -= full * each
            else:  # fewer than one sequence takes
                self.runs[number] = (1, lengths + [length] * count)
                left = room - count * length
                self.open.insert(bisect_left(self.open, (left, number)), (left, number))
                self.add(times - 1, lengths)
                count = 0


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """(number of sequences, lengths in each, in order of offset) that together hold the histogram exactly."""
    state = _Plan(capacity)
    small = int(capacity * SMALL)
    rest = {length: n for length, n in histogram.items() if length <= small}
    grouped = linear_groups({length: n for length, n in histogram.items() if length > small}, groups)
    merged: dict[int, int] = {}
    for size, members in grouped:  # groups of one rounded size are one size
        merged[size] = merged.get(size, 0) + members
    sizes = list(merged)
    left = {length: n for length, n in histogram.items() if length > small and n}
    lengths = sorted(left)

    def longest(limit: int, above: int, taken: list[int]) -> int:
        """The longest length in (above, limit] of which one more is left, else 0."""
        at = bisect_right(lengths, limit) - 1
        while at >= 0 and lengths[at] > above:
            if left[lengths[at]] > taken.count(lengths[at]):
                return lengths[at]
            at -= 1
        return 0

    mix = configurations(sizes, [merged[s] for s in sizes], capacity) if sizes else []
    floors = {size: below for size, below in zip(sizes, [*sizes[1:], small])}
    for times, members in mix:
        planned = [size for size, m in zip(sizes, members) for _ in range(m)]
        while times:
            taken: list[int] = []
            for size in planned[:-1]:
                taken.append(longest(size, floors[size], taken))
            taken.append(longest(capacity - sum(taken), floors[planned[-1]], taken))  # the last one takes the room that the actual lengths leave
            if not all(taken):
                break
            run = min(times, *[left[length] // taken.count(length) for length in set(taken)])
            state.add(run, taken)
            times -= run
            for length in set(taken):
                left[length] -= run * taken.count(length)
                if not left[length]:
                    lengths.remove(length)
    for length in lengths:
        rest[length] = left[length]
    for length in sorted(rest, reverse=True):
        state.best_fit(length, rest[length])
    return list(state.runs.values())


def places(patterns: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """Which numbers of each length go where: (length, first, last, each, sequence, offset), numbers first..last inclusive.

    Number i of the length goes to sequence + (i - first) // each, at offset + ((i - first) % each) * length.
    Rows are bounded by the patterns, which are bounded by the capacity and the groups, not by the corpus.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            first = used.get(length, 0)
            rows.append((length, first, first + times * each - 1, each, sequence, offset))
            used[length] = first + times * each
            offset += each * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "last", "each", "sequence", "at"]).astype("int64")


def token_pieces(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, number): pieces of at most ``capacity`` ids of each text plus ``end_id``.

    Only longer documents are cut; their first piece takes what the full ones leave.  ``number`` counts the pieces of one length
    within the input partition ``part``.  With a ``vocabulary`` its added tokens have their ids inside texts too.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        pairs, part, seen = byte_pairs(rank_file, pattern, vocabulary), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for i, text in enumerate(texts_of(batch.column(1))):
                ids = pairs.encode(text)
                ids.append(end_id)
                packed, n = np.array(ids, dtype="<u4").tobytes(), len(ids)
                piece, start, end = 0, 0, (n - 1) % capacity + 1
                while start < n:
                    number = seen.get(end - start, 0)
                    seen[end - start] = number + 1
                    rows.append((i, piece, start, end - start, zlib.crc32(packed[4 * start:4 * end]), part, number))
                    piece, start, end = piece + 1, end, end + capacity
            index, *columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])]],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"])

    return chosen(docs, doc_id=id_col, text=text_col).mapInArrow(
        work, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, number bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (stored rows with length, part and number) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(histogram, capacity, groups))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(starts, ["length", "part"]).withColumn("number", F.col("number") + F.col("before")).drop("before")
    by_length = {n: g.to_numpy()[:, 1:] for n, g in table.groupby("length")}
    known = spark.sparkContext.broadcast({n: (g[:, 0].copy(), g) for n, g in by_length.items()})

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = np.empty((len(length), 2), dtype=np.int64)
        sizes, numbers = length.to_numpy(), number.to_numpy()
        for size in np.unique(sizes):
            firsts, rows = known.value[int(size)]
            at = np.flatnonzero(sizes == size)
            r = rows[np.searchsorted(firsts, numbers[at], side="right") - 1]
            i = numbers[at] - r[:, 0]
            out[at, 0], out[at, 1] = r[:, 3] + i // r[:, 2], r[:, 4] + (i % r[:, 2]) * size
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    return numbered.withColumn("p", place("length", "number")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("p.sequence_id").alias("sequence_id"), F.col("p.offset").alias("offset"))


def packed(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, groups: int = GROUPS, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end id alone.  Repeated rows are packed each; null ids are carried through; an
    empty table gives an empty result; further columns are ignored.
    """
    return pack(materialize(token_pieces(docs, rank_file, pattern, id_col, text_col, capacity, vocabulary=vocabulary), "pieces"), capacity, groups)
