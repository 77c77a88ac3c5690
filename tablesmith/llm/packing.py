"""Packing tokenized documents into sequences by cutting-stock column generation.

A document's ids are cut at every multiple of the sequence length, so that all pieces before the rest fill a sequence,
and a rest longer than half a sequence is cut at the half: no piece is then too long to share a sequence with another.
The histogram of piece lengths, in units of a few tokens, is all that the driver sees: it has at most ``capacity``
bars at any corpus size. A linear program over patterns (which lengths share a sequence) is solved by column
generation, a knapsack dynamic program pricing the columns; the patterns' counts are rounded down, what remains is
packed by best fit, and the pieces, ranked within their length, take the places that the patterns hold for them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encoder
from .common import durable, spans_of, utf8

LENGTH = 1024
#: Tokens in a unit of the histogram: lengths are rounded up to it, which wastes 1.5 tokens a piece on average.
UNIT = 4


def pieces(df: DataFrame, path: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): every document's ids with ``end_id`` behind them, cut at the multiples of ``length`` and, where more than its half is left, half a ``length`` further. Null texts are empty and have the end id alone; repeated rows are cut each, an empty table gives no piece, a very long text is tokenized whole, alone in its step."""

    half = max(1, length // 2)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(path)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            _, starts = utf8(text)
            for i, j in spans_of(starts):
                ids, at = run([t or "" for t in text.slice(i, j - i).to_pylist()])
                raw = memoryview(ids.astype("<u4").tobytes())
                total = np.diff(at) + 1
                full, rest = total // length, total % length
                count = full + (rest > 0) + (rest > half)
                owner = np.repeat(np.arange(j - i), count)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(number <= full[owner], number * length, full[owner] * length + half)
                size = np.where(number < full[owner], length, np.where(number > full[owner], rest[owner] - half, np.minimum(rest[owner], half)))
                last = start + size == total[owner]
                a = at[owner] + start
                crc = [zlib.crc32(tail, c) if z else c for b, e, z in zip(a.tolist(), (a + size - last).tolist(), last.tolist(), strict=True) for c in [zlib.crc32(raw[4 * b : 4 * e])]]
                yield pa.RecordBatch.from_arrays([key.slice(i, j - i).take(pa.array(owner)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(total[owner])], [id_col, "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def best_pattern(size: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack: how often to take each size, repeats allowed, for the most worth within ``capacity``."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(size)
    size_up, worth_up = size[order], worth[order]
    for room in range(1, capacity + 1):
        fits = int(np.searchsorted(size_up, room, side="right"))
        best[room] = best[room - 1]
        if fits:
            value = best[room - size_up[:fits]] + worth_up[:fits]
            k = int(value.argmax())
            if value[k] > best[room]:
                best[room], took[room] = value[k], order[k]
    pattern, room = np.zeros(len(size)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= int(size[took[room]])
    return float(best[capacity]), pattern


def solve(size: np.ndarray, demand: np.ndarray, capacity: int, most_rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns by row, how often to use each): the linear program's basis when no column improves it any more. Stopping at ``most_rounds`` leaves a feasible, looser basis."""
    m = len(size)
    patterns = np.diag(capacity // size).astype(float)
    inverse, use = np.diag(1 / np.diag(patterns)), demand / np.diag(patterns)
    for _ in range(most_rounds):
        worth, column = best_pattern(size, inverse.sum(axis=0), capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        patterns[out] = column
    return patterns[:m], use


def plan(demand: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(units, first rank, end of ranks, copies, first sequence, first slot): rank r of ``units`` goes to sequence first + (r - first rank) // copies."""
    size = np.array(sorted(demand), np.int64)
    left = np.array([demand[s] for s in size.tolist()], np.int64)
    groups: list[tuple[np.ndarray, int]] = []
    if len(size):
        for pattern, use in zip(*solve(size, left.astype(float), capacity), strict=True):
            pattern = pattern.astype(np.int64)
            times = int(min([use + 1e-6, *(left[pattern > 0] // pattern[pattern > 0])]))
            if times > 0:
                groups.append((pattern, times))
                left = left - times * pattern
        while left.any():  # a few pieces for each pattern, whatever the corpus
            pattern, room = np.zeros(len(size), np.int64), capacity
            for k in range(len(size) - 1, -1, -1):
                pattern[k] = min(left[k], room // size[k])
                room -= int(pattern[k] * size[k])
            times = int(min(left[pattern > 0] // pattern[pattern > 0]))
            groups.append((pattern, times))
            left = left - times * pattern
    rows, rank, sequence = [], np.zeros(len(size), np.int64), 0
    for pattern, times in groups:
        slot = 0
        for k in np.flatnonzero(pattern)[::-1].tolist():
            copies = int(pattern[k])
            rows.append((int(size[k]), int(rank[k]), int(rank[k] + copies * times), copies, sequence, slot))
            rank[k] += copies * times
            slot += copies
        sequence += times
    return rows


def pack(df: DataFrame, length: int = LENGTH, unit: int = UNIT, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to rows of :func:`pieces`: every piece in one sequence of at most ``length`` tokens, offsets gapless from 0.

    Ranks come from counts by (length, salt), so a length that a third of the pieces share is spread over the
    partitions. The plan that is broadcast has a few rows for each of the length // unit classes, at any corpus size.
    An empty input gives an empty result; repeated rows each get a place of their own.
    """
    spark = df.sparkSession
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = durable(df.withColumns({"units": F.ceil(F.col("length") / unit).cast("int"), "salt": F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(salts))}), "pieces")
    counts = durable(rows.groupBy("units", "salt").agg(F.count("*").alias("n")), "lengths")
    demand = {r["units"]: r["n"] for r in counts.groupBy("units").agg(F.sum("n").alias("n")).collect()}
    places = spark.createDataFrame(plan(demand, length // unit), "units int, low bigint, high bigint, copies bigint, sequence bigint, slot bigint")
    by = W.partitionBy("units", "salt")
    first = counts.withColumn("before", F.sum("n").over(W.partitionBy("units").orderBy("salt")) - F.col("n")).drop("n")
    ranked = rows.withColumn("rank", F.row_number().over(by.orderBy(id_col, "start", "ids_crc32")) - 1).join(first, ["units", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    at = F.col("rank") - F.col("low")
    placed = ranked.join(F.broadcast(places), "units").where("rank >= low and rank < high")
    placed = placed.withColumns({"sequence_id": F.col("sequence") + F.floor(at / F.col("copies")).cast("bigint"), "slot": F.col("slot") + at % F.col("copies")})
    inside = W.partitionBy("sequence_id").orderBy("slot")
    return placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
