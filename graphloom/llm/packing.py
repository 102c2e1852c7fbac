"""Best-fit packing of tokenized documents.

A document's ids and one end id are cut into pieces of at most ``capacity`` tokens; only the first
of several pieces may be shorter.  The plan is made over the histogram of piece lengths, whose size
the capacity bounds: best-fit decreasing, a length at a time, over classes of sequences with equal
room.  It says where the r-th piece of each length goes.  Pieces then get their rank within their
length (from counts over hash ranges, so that a hot length is dealt over many tasks) and look up
their place.

Defined results: a null text is an empty one: the end id alone.  Rows with a null or equal id are
documents of their own.  A document of any length is tokenized whole.  An empty table gives an
empty result; other columns do not pass through.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import append_columns, emit, strings
from graphloom.llm.tokens import default_path, encoding
from graphloom.storage import materialize

CAPACITY = 2048
END = 0


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, text_col: str, id_col: str, path: str, capacity: int) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and a number of its own (salt)."""

    def make():
        encode = encoding(path).encode_to_numpy
        salt = itertools.count(TaskContext.get().partitionId() << 33)

        def step(*columns):
            if not columns:
                return
            rows: list[tuple] = []
            for doc, text in zip(columns[0].to_pylist(), strings(columns[1]), strict=True):
                ids = np.append(encode(text or "", disallowed_special=()), END).astype("<u4")
                for i, (start, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, i, start, n, zlib.crc32(ids[start : start + n].tobytes()), next(salt)))
            yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "salt"), zip(*rows), strict=True))

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return emit(docs, [id_col, text_col], f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint", make)


@dataclass
class Plan:
    """Segments ordered by (length, first rank): ranks from ``rank`` fill sequences from
    ``sequence`` on, ``per`` pieces in each, from ``offset`` on."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    sequences: int
    #: pieces of one length never reach this, so length and rank make one key
    _span = 1 << 44

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.length * self._span + self.rank, length * self._span + rank, side="right") - 1
        j = rank - self.rank[at]
        return self.sequence[at] + j // self.per[at], self.offset[at] + j % self.per[at] * length


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts.

    A run is sequences in a row with equal room.  The tightest room that holds a length takes as
    many of them as fit: once in, its sequence is tighter still, so piece by piece best fit would
    go on there as well.
    """
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    segments: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[i]
            else:
                room = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            per = room // length
            if left >= per:
                used = min(n, left // per)
            else:
                per, used = left, 1
            segments.append((length, rank, first, per, capacity - room))
            put(room - per * length, first, used)
            put(room, first + used, n - used)
            left -= per * used
            rank += per * used
    table = np.array(sorted(segments), dtype=np.int64).reshape(-1, 5)
    return Plan(*(table[:, i].copy() for i in range(5)), opened)


def ranks(cut_up: DataFrame) -> DataFrame:
    """Add ``rank`` from 0 within the length.  A length of n pieces is dealt over about sqrt(n)
    hash ranges; ranks within the ranges and prefix sums of their counts make the rank.  The hash is of the
    piece's own number in the written table, so that equal rows spread too."""
    counts = cut_up.groupBy("length").agg(F.ceil(F.sqrt(F.count("*"))).alias("_ranges"))
    key = F.pmod(F.xxhash64("salt"), F.lit(1 << 31))
    dealt = cut_up.withColumn("_key", key).join(F.broadcast(counts), "length")  # at most a row per length up to the capacity
    dealt = dealt.withColumn("_range", F.shiftright(F.col("_key") * F.col("_ranges"), 31)).drop("_ranges")
    sums = dealt.groupBy("length", "_range").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("_range")) - F.col("n")
    inner = F.row_number().over(Window.partitionBy("length", "_range").orderBy("_key", "salt"))
    return (
        dealt.withColumn("_inner", inner)
        .join(sums.select("length", "_range", upto.alias("_before")), ["length", "_range"])
        .withColumn("rank", F.col("_before") + F.col("_inner") - 1)
        .drop("_key", "_range", "_inner", "_before")
    )


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece with its sequence and the place there."""
    spark = docs.sparkSession
    cut_up = materialize(pieces(docs, text_col, id_col, path or default_path(), capacity), "pieces")
    histogram = {r[0]: r[1] for r in cut_up.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(best_fit(histogram, capacity))

    def make():
        def compute(length: pa.Array, rank: pa.Array):
            return plan.value.place(length.to_numpy(), rank.to_numpy())

        return compute

    placed = append_columns(ranks(cut_up), ["length", "rank"], "sequence_id bigint, offset bigint", make)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
