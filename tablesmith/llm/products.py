"""Exact top-k inner products: long vectors first, partial sums over singular directions, bounds on what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, sampled
from .vectors import NUMBERS, SAMPLE_ROWS, main_length

#: Queries that are sent to all tasks at a time, longest rows that give them their first thresholds, and queries looked at together.
ROUND, HEAD, QUERIES = 4096, 2048, 256
#: Shares of the sample's energy that the partial sums cover one after the other.
SHARES = (0.5, 0.75, 0.9)
#: Allowance for rounding in partial sums, relative to the product of lengths.
SLACK = 1e-9
#: Whole numbers of a vector this long or longer could have products beyond a long.
LONGEST = 2.0**31


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def directions(x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Right singular vectors of the sample, strongest first, and how many of them hold each share of its energy."""
    energy, turn = np.linalg.eigh(x.T @ x)  # of the Gram matrix, whose size the sample does not change
    turn, total = turn[:, ::-1], np.cumsum(np.maximum(energy[::-1], 0))
    cuts = [min(int(np.searchsorted(total, s * total[-1])) + 1, x.shape[1]) for s in SHARES] if total[-1] > 0 else []
    return turn, sorted(set(cuts) - {x.shape[1]})


class Searcher:
    """The queries of a round with their best rows so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, cuts: list[int], k: int):
        self.ids, self.x, self.turn, self.cuts, self.k = ids, x, turn, cuts, k
        self.size = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        self.y = x @ turn
        self.rest = [np.sqrt((self.y[:, c:] ** 2).sum(axis=1)) for c in cuts]
        self.floor = np.full(len(ids), -np.inf)
        self.best: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 3]

    def scan(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes in rows. A pair is dropped once the partial sum and the product of the lengths that are left stay below the query's k-th best."""
        size = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-size, kind="stable")
        ids, x, size = ids[order], x[order], size[order]
        y = x @ self.turn
        rest = [np.sqrt((y[:, c:] ** 2).sum(axis=1)) for c in self.cuts]
        alive = np.flatnonzero(self.size * size.max(initial=0.0) * (1 + SLACK) >= self.floor)
        for i in range(0, len(alive), QUERIES):
            self._some(alive[i : i + QUERIES], ids, x, size, y, rest)

    def _some(self, mine: np.ndarray, ids: np.ndarray, x: np.ndarray, size: np.ndarray, y: np.ndarray, rest: list[np.ndarray]) -> None:
        near = int(np.searchsorted(-size, -np.min(self.floor[mine] / np.maximum(self.size[mine], 1e-300)) * (1 - SLACK), side="right"))
        near = len(size) if (self.floor[mine] <= 0).any() else near  # the others are too short for all of these queries
        if not near:
            return
        start = 0
        if self.cuts:
            start = self.cuts[0]
            part = self.y[mine, :start] @ y[:near, :start].T
            high = part + self.rest[0][mine, None] * rest[0][None, :near]
            q, r = np.nonzero((high + SLACK * self.size[mine, None] * size[None, :near] >= self.floor[mine, None]) & (self.ids[mine, None] != ids[None, :near]))
            part = part[q, r]
        else:
            q, r = np.nonzero(self.ids[mine, None] != ids[None, :near])
            part = np.zeros(len(q))
        q = mine[q]
        for level, end in enumerate(self.cuts[1:], 1):
            if len(q) == 0:
                return
            part += np.einsum("ij,ij->i", self.y[q, start:end], y[r, start:end])
            stay = part + self.rest[level][q] * rest[level][r] + SLACK * self.size[q] * size[r] >= self.floor[q]
            q, r, part, start = q[stay], r[stay], part[stay], end
        score = np.concatenate([(self.x[q[i : i + 65536]] * x[r[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0, np.int64)
        good = score >= self.floor[q]
        self.best.append([q[good], ids[r[good]], score[good]])
        if sum(len(b[0]) for b in self.best) > 4 * self.k * len(self.ids) + 65536 or (self.floor[mine] == -np.inf).any():
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keeps the k best of each query, ties to the smaller id, and raises its threshold: (query, row, score)."""
        q, r, s = (np.concatenate(c) for c in zip(*self.best, strict=True))
        order = np.lexsort((r, -s, q))
        q, r, s = q[order], r[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        top = rank < self.k
        self.best = [[q[top], r[top], s[top]]]
        return self.best[0]


def largest_products(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE_ROWS, round_size: int = ROUND, head: int = HEAD) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` marks, the k rows of another id with the largest inner product of whole numbers floor(scale * x), ties to the smaller id.

    Exact: bounds only decide what is not summed to its end. Rows stay where they are, longest first within a written
    partition; queries go to them in broadcasts of about ``round_size`` (less for long vectors: NUMBERS), each with the threshold that the ``head`` longest
    rows of all give it, so most partitions return less than k rows a query. A bounded sample sets the directions, which
    change the work and not the result.

    Null vectors, those that hold null or non-finite components or none at all, rows without an id, and vectors of
    another length than most take no part; neither do those whose whole numbers have a Euclidean length of 2**31 or more,
    since a product might not fit a long. Zero vectors take part. An id that several rows carry asks once, with the least
    of its vectors; as candidates they count each. An empty table gives an empty result; other columns are not looked at.
    """
    spark = df.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LONGEST / scale))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("v", whole_numbers(F.col("v"), scale))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("length", length).where(F.col("length") < LONGEST)
    most = main_length(rows)
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not most:
        return spark.createDataFrame([], empty)
    rows = durable(rows.where(F.size("v") == most).sortWithinPartitions(F.desc("length"), "id"), "whole")
    total, bound = rows.count(), max(1, NUMBERS // most)
    sample, head, round_size = min(sample, bound), min(head, bound), min(round_size, bound)
    few = np.array([r[0] for r in sampled(rows, "id", sample, total).select("v").collect()], float)
    turn, cuts = directions(few)
    longest = rows.orderBy(F.desc("length"), "id").limit(head).select("id", "v").collect()
    top_ids, top = np.array([r[0] for r in longest]), np.array([r[1] for r in longest], np.int64)
    asking = durable(rows.where("asks").groupBy("id").agg(F.min("v").alias("v")), "asking")
    rounds = -(-asking.count() // round_size)
    place = F.pmod(F.xxhash64("id"), F.lit(max(rounds, 1)))
    parts = []
    for turn_no in range(rounds):
        asked = asking.where(place == turn_no).collect()  # about round_size, whatever the table's size
        if not asked:
            continue
        first = Searcher(np.array([r[0] for r in asked]), np.array([r[1] for r in asked], np.int64), turn, cuts, k)
        first.scan(top_ids, top)
        first.settle()
        sent = spark.sparkContext.broadcast((first.ids, first.x, first.floor, turn, cuts))
        found = rows.select("id", "v").mapInArrow(_search(sent, k), "query_id bigint, vec_id bigint, score bigint")
        parts.append(durable(found, "found") if rounds > 1 else found)
    if not parts:
        return spark.createDataFrame([], empty)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(sent, k: int):  # a function of its own: nothing else of the operator travels with it
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, floor, turn, cuts = sent.value
        mine = Searcher(ids, x, turn, cuts, k)
        mine.floor = floor.copy()
        for batch in batches:
            step = max(1, 4_000_000 // max(1, 8 * x.shape[1]))
            for i in range(0, len(batch), step):
                part = batch.slice(i, step)
                mine.scan(part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(len(part), -1))
        q, r, s = mine.settle()
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(r), pa.array(s)], ["query_id", "vec_id", "score"])

    return run
