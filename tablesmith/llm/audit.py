"""Filter interactions: a document-term matrix in CSR shards over a global dictionary, and what filters do in every order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, release, spans_of, utf8

#: Two primes below 2**31: a word's code is its polynomial modulo both, at points that the seed draws.
PRIMES = (2147483647, 2147483629)
#: Codes that a task remembers to have sent to the dictionary; beyond that it forgets them and sends some again.
REMEMBERED = 1_000_000
FILTERS = "ABCDE"
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Characters of filter D.
MARKS = np.zeros(256, bool)
MARKS[list(b"#$%&*|")] = True


@dataclass
class Shard:
    """Rows of the matrix: ``codes`` and ``counts`` of document i lie in [indptr[i], indptr[i + 1]). Words are the bytes [start, end) of one occurrence of each code in ``every``."""

    indptr: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    every: np.ndarray
    start: np.ndarray
    end: np.ndarray
    mixed: bool


@lru_cache(maxsize=4)
def _points(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each prime: the values of bytes, a point and its inverse."""
    rng = np.random.default_rng(seed)
    values = np.stack([rng.integers(1, p, 256) for p in PRIMES])
    points = np.array([int(rng.integers(1 << 20, p)) for p in PRIMES])
    return values, points, np.array([pow(int(r), -1, p) for r, p in zip(points, PRIMES, strict=True)])


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(point: int, prime: int, n: int) -> np.ndarray:
    """1, r, r**2, ... modulo the prime; longer tables than the last are made by doubling."""
    table = _POWERS.get((point, prime), np.ones(1, np.int64))
    while len(table) < n:
        table = np.concatenate([table, table * pow(point, len(table), prime) % prime])
    if len(table) <= 1 << 22:
        _POWERS[point, prime] = table
    return table[:n]


def word_codes(flat: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A code of 62 bits for each word [start, end): equal words, equal codes."""
    values, points, inverse = _points(seed)
    out = []
    for k, prime in enumerate(PRIMES):
        term = values[k][flat] * _powers(int(points[k]), prime, len(flat)) % prime
        total = np.concatenate([[0], np.cumsum(term)])  # below 2**31 times the bytes: fits
        out.append((total[end] - total[start]) % prime * _powers(int(inverse[k]), prime, len(flat) + 1)[start] % prime)
    return out[0] << 31 | out[1]


def csr(flat: np.ndarray, starts: np.ndarray, seed: int = 0) -> Shard:
    """The matrix of some texts, UTF-8 bytes one after the other: words are maximal runs of what is not white space."""
    word = ~SPACE[flat]
    begins = np.zeros(len(flat) + 1, bool)
    begins[starts[:-1]] = True
    begins = begins[:-1]
    ends = np.zeros(len(flat) + 1, bool)
    ends[starts[1:]] = True
    first = word & (begins | np.append(True, ~word[:-1])) if len(flat) else word
    last = word & (ends[1:] | np.append(~word[1:], True)) if len(flat) else word
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    code = word_codes(flat, start, end, seed)
    every, where, inverse = np.unique(code, return_index=True, return_inverse=True)
    doc = np.searchsorted(starts, start, side="right") - 1
    cell, counts = np.unique(doc * max(1, len(every)) + inverse, return_counts=True)
    docs, column = np.divmod(cell, max(1, len(every)))
    indptr = np.searchsorted(docs, np.arange(len(starts)))
    # each occurrence is compared with the one that stands for its code
    size, other = end - start, where[inverse]
    mixed = bool((size != size[other]).any())
    if not mixed and len(size):
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        mixed = bool((flat[np.repeat(start, size) + at] != flat[np.repeat(start[other], size) + at]).any())
    return Shard(indptr, every[column], counts, every, start[where], end[where], mixed)


MATRIX = "ids array<bigint>, indptr array<int>, codes array<bigint>, counts array<int>"


def matrix(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document-term matrix as CSR shards of about a megabyte of text: ids of the rows, indptr, codes and counts.

    ``seed`` comes from :func:`dictionary`, which makes codes mean the same word in all shards. Null and empty texts are empty rows; a longer text has a shard of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = utf8(batch.column(1))
            for i, j in spans_of(starts):
                s = csr(flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i], seed)
                lists = [batch.column(0).slice(i, j - i).to_pylist(), s.indptr.tolist(), s.codes.tolist(), s.counts.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(t)) for v, t in zip(lists, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["ids", "indptr", "codes", "counts"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, MATRIX)


READ = "id bigint, part string, n_words bigint, n_distinct bigint, upper bigint, points bigint, marked boolean, content binary, code bigint, word binary"


def _read(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, np.int64)
        for batch in batches:
            flat, starts = utf8(batch.column(2))
            for i, j in spans_of(starts):
                mine, at = flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
                s = csr(mine, at, seed)
                # row sums and numbers of cells of the matrix
                sums = np.concatenate([[0], np.cumsum(s.counts)])
                within = lambda flags, at=at: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
                raw = mine.tobytes()
                content = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                numbers = [sums[s.indptr[1:]] - sums[s.indptr[:-1]], np.diff(s.indptr), within((mine >= 65) & (mine <= 90)), within((mine & 0xC0) != 0x80)]
                names = [f.split()[0] for f in READ.split(", ")]
                n = j - i
                none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), *(pa.array(x, pa.int64()) for x in numbers), pa.array(within(MARKS[mine]) > 0), pa.array(content, pa.binary()), *none], names)
                place = np.searchsorted(sent, s.every)
                new = np.append(sent, -1)[place] != s.every
                words = [raw[a:b] for a, b in zip(s.start[new].tolist(), s.end[new].tolist(), strict=True)]
                codes = s.every[new]
                sent = np.sort(np.concatenate([sent if len(sent) < REMEMBERED else sent[:0], codes]), kind="stable")
                if s.mixed:  # two words of one code in this shard: said by a pair that no dictionary can hold
                    codes, words = np.append(codes, [-1, -1]), [*words, b"a", b"b"]
                n = len(words)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.array(codes), pa.array(words, pa.binary())], names)

    return run


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, DataFrame, int]:
    """(documents, dictionary, seed): per document what the filters ask, and the one code of every word of the table.

    A word's code is a hash under a seed. The dictionary, grouped by code over the whole table, shows that no two words
    share one; otherwise the next seed is taken and texts are read again. So shards are encoded where the texts lie, no
    occurrence of a word is shuffled, and only words new to a task travel.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    seed = 0
    while True:
        read = durable(rows.mapInArrow(_read(seed), READ), "read")
        words = read.where("word is not null").groupBy("code").agg(F.min("word").alias("word"), F.max("word").alias("other"))
        if not words.where("word <> other").limit(1).count():
            return read, words.select("code", F.decode("word", "UTF-8").alias("word")), seed
        release(read)
        seed += 1


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """((code, word) for every distinct word, seed): one code a word and one word a code."""
    _, words, seed = measured(docs.select(id_col, text_col).withColumn("__part", F.lit("")), id_col, text_col, "__part")
    return words, seed


def failures(read: DataFrame) -> Column:
    """Which of A to D a document fails, as bits 1, 2, 4, 8."""
    # The bounds of the filters.
    tests = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), 100 * F.col("upper") > 3 * F.col("points"), F.col("marked")]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, each of the 120 orders of ABCDE and each step.

    A: under 200 words. B: distinct words are fewer than half. C: over 3 % capitals A-Z. D: one of ``#$%&*|``. E: the text
    of a smaller id. Null texts are empty, and equal to empty ones; a null part is the empty string; a row without an id
    repeats nothing and is repeated by nothing; rows of one id are judged each, none being smaller. A document is good or
    toxic if any label row of its id says so. Very long texts are read alone. An empty table gives no row.

    A and B come from row sums and cell counts of the matrix. Copies are found by the SHA-256 of the text: rows are added
    up by it, id and part first, so a group of any size meets as a few sums. At last there are 128 sums a part, from
    which all orders follow.
    """
    read, _, _ = measured(docs, id_col, text_col, part_col)
    rows = read.where("content is not null").select("id", "part", "content", failures(read).alias("fails"))
    marks = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).where("id is not null")
    marks = marks.groupBy("id").agg(F.coalesce(F.max("q"), F.lit(False)).alias("good"), F.coalesce(F.max("t"), F.lit(False)).alias("toxic"))
    one = ["content", "part", "fails", "good", "toxic"]
    rows = rows.groupBy("id", "content", "part", "fails").agg(F.count("*").alias("n")).join(marks, "id", "left").fillna(False, ["good", "toxic"])
    # of each group: all its rows, its smallest id and that id's rows
    some = rows.groupBy(*one).agg(F.sum("n").alias("n"), F.min("id").alias("low"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("at_low"))
    least = F.min("low").over(W.partitionBy("content"))
    some = some.withColumn("first", F.col("without") + F.when(F.col("low") == least, F.col("at_low")).otherwise(0))
    again = F.explode(F.array(F.struct(F.col("fails").alias("fails"), F.col("first").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("first")).alias("n"))))
    cells = some.select("part", "good", "toxic", again.alias("x")).groupBy("part", "x.fails").agg(F.sum("x.n").alias("n"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(0)).alias("toxic"))
    return in_every_order(cells)


def in_every_order(cells: DataFrame) -> DataFrame:
    """The audit from (part, fails, n, good, toxic): ``fails`` has a bit for each filter, A the lowest."""
    total = factorial(len(FILTERS))
    orders = F.array(*(F.lit("".join(o)) for o in permutations(FILTERS)))
    of = lambda letter: F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("bigint")
    spread = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    spread = spread.withColumn("bit", of(F.substring("filter_order", F.col("step"), F.lit(1))))
    spread = spread.withColumn("earlier", F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda k: k < F.col("step")), F.lit(0).cast("bigint"), lambda a, k: a + of(F.substring("filter_order", k, F.lit(1)))))
    fails = F.col("fails").cast("bigint")
    here, before = fails.bitwiseAND(F.col("bit")) != 0, fails.bitwiseAND(F.col("earlier")) != 0
    added = lambda test, what="n": F.sum(F.when(test, F.col(what)).otherwise(0)).cast("bigint")
    # a filter removes a document in that share of all orders in which it comes before the others that the document fails
    share = F.lit(total) / F.greatest(F.bit_count("fails"), F.lit(1))
    return spread.groupBy("part", "filter_order", "step").agg(
        added(~here & ~before).alias("kept"), added(here & ~before).alias("removed"), added(here & before).alias("redundant"), added(fails == F.col("bit")).alias("unique_fails"),
        added(here & ~before, "good").alias("good_lost"), added(here & ~before, "toxic").alias("toxic_lost"), F.sum(F.when(here, F.col("n") * share).otherwise(0)).cast("bigint").alias("shapley"),
    )
