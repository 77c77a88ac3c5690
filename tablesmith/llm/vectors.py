"""Vectors: near-duplicates by a forest of random-projection trees, and nearest neighbours by rotated one-bit codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import classes, durable, release, sampled, whole_runs

#: Bound of the sample whose projections set the trees' thresholds; every row is indexed. A node of a tree has a threshold of its own while LEAST_ROWS of the sample reach it.
SAMPLE_ROWS, LEAST_ROWS = 20_000, 16
LEAF, SPILL = 256, 0.1
#: Random directions that the nodes of a tree choose from.
BANK = 64
#: Share of pairs at the threshold that one split parts, measured on random vectors, and the share that no tree may find together.
PARTED, MISSED = 0.04, 1e-4
#: Rows of a leaf that are compared with as many at a time.
TILE = 512
#: Coded rows looked at together, queries that are sent to all tasks at a time, queries looked at together, and rows that give them their first limits.
BLOCK, QUERY_BLOCK, QUERIES, SEEDS = 8192, 4096, 16, 2048
#: Numbers that the sample and a round of queries hold at most on the driver, each.
NUMBERS = 4_000_000
CODE_BITS = 128


def usable(vector: Column) -> Column:
    """Not null or empty, every component there and finite, and some of them not zero."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their magnitude: squares of scaled components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def main_length(rows: DataFrame) -> int:
    """The length that most vectors ``v`` have, the smaller of equals; 0 without any."""
    found = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 0


@dataclass
class Tree:
    """A binary tree of random splits in heap order.

    A node's direction is one of a bank, chosen by a hash of its number. ``own``: (threshold, half width of the spill
    zone) of the nodes of the first levels; deeper nodes use ``rest``, the same for each direction over the whole
    sample. Its size is bounded by the sample's, at any depth.
    """

    bank: np.ndarray
    own: np.ndarray
    rest: np.ndarray
    depth: int

    def chosen(self, node: np.ndarray) -> np.ndarray:
        return ((node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % len(self.bank)

    def sides(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = node < len(self.own)
        both = np.where(inner[:, None], self.own[np.where(inner, node, 0)], self.rest[self.chosen(node)])
        return both[:, 0], both[:, 1]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): a row near a threshold goes down both sides."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        value = x @ self.bank.T
        for _ in range(self.depth):
            at = value[row, self.chosen(node)]
            middle, half = self.sides(node)
            low, high = at <= middle + half, at > middle - half
            row = np.concatenate([row[low], row[high]])
            node = np.concatenate([2 * node[low], 2 * node[high] + 1])
        return row, node


def grow(sample: np.ndarray, depth: int, seed: int, spill: float = SPILL) -> Tree:
    """A tree whose nodes split at the median of the sample that reaches them, as long as that is LEAST_ROWS; nodes further down split at the median of the whole sample along their direction."""
    rng = np.random.default_rng(seed)
    bank = rng.normal(size=(BANK, sample.shape[1]))
    bank /= np.linalg.norm(bank, axis=1, keepdims=True)
    value = sample @ bank.T
    rest = np.stack([np.median(value, axis=0), spill * value.std(axis=0)], axis=1)
    levels = min(depth, max(0, int(np.log2(max(len(sample), 1) / LEAST_ROWS))))
    tree = Tree(bank, np.zeros((1 << levels, 2)), rest, depth)
    node = np.ones(len(sample), np.int64)
    for level in range(levels):
        order = np.argsort(node, kind="stable")
        places = np.arange(1 << level, 2 << level)
        ends = np.searchsorted(node[order], np.append(places, 2 << level))
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            way = int(tree.chosen(places[k : k + 1])[0])
            mine = value[order[a:b], way]
            tree.own[places[k]] = (np.median(mine), spill * mine.std()) if len(mine) >= LEAST_ROWS else rest[way]
        node = 2 * node + (value[np.arange(len(node)), tree.chosen(node)] > tree.own[node, 0])
    return tree


def trees_for(depth: int) -> int:
    """How many trees leave MISSED of the pairs at the threshold without a common leaf."""
    return max(1, int(np.ceil(np.log(MISSED) / np.log(max(1 - (1 - PARTED) ** depth, 1e-9)))))


def tile_links(tile: pa.Table, least: float) -> pa.RecordBatch | None:
    """For one tile of a leaf: each row's number of links that no smaller leaf has, and the smallest row that it is joined to within the tile.

    Rows come with their leaves so far. A pair that shares a smaller leaf is counted there; here it only helps to join.
    """
    tile = tile.combine_chunks()
    x = units(matrix(tile["v"].chunk(0)))
    side, leaf = tile["side"].to_numpy(), tile["leaf"][0].as_py()  # side 0: rows of the first block, 1: of the second, 2: a tile of one block
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    linked &= (side != 1)[:, None] & (side != 0)[None, :] | (side != 0)[:, None] & (side != 1)[None, :]
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return None
    held = tile["leaves"].chunk(0).take(pa.array(some))
    owner, every = np.repeat(np.arange(len(some)), held.value_lengths().to_numpy()), held.flatten().to_numpy()
    smaller = every < leaf
    _, code = np.unique(every[smaller], return_inverse=True)
    member = np.zeros((len(some), int(code.max(initial=-1)) + 1), np.float32)
    member[owner[smaller], code] = 1
    linked = linked[np.ix_(some, some)]
    count = (linked & ~(member @ member.T > 0)) @ tile["weight"].to_numpy()[some]
    node = tile["rep"].to_numpy()[some]
    order = np.argsort(node, kind="stable")
    root = np.empty(len(node), np.int64)
    root[order] = np.arange(len(node))
    at = [np.flatnonzero(r) for r in linked]
    moved = True
    while moved:
        near = np.array([min(root[i], root[a].min()) for i, a in enumerate(at)], np.int64)
        near = np.minimum(near, near[order[near]])
        moved = bool((near != root).any())
        root = near
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(count.astype(np.int64)), pa.array(node[order[root]])], ["rep", "n_links", "root"])


def near_duplicates(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", trees: int | None = None, leaf: int = LEAF, sample: int = SAMPLE_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: vectors link when their cosine, in double precision, is ``least`` or more.

    n_links counts the other vectors linked directly, component_id is the smallest id reachable, kept says that it is the
    row's own. Null, zero and non-finite vectors, rows without an id, and vectors of another length than most have link
    with nothing. Equal vectors are collapsed and counted by weight. A leaf of any size is compared whole, in tiles of at
    most TILE by TILE rows, and a pair that shares several leaves counts in the smallest of them, so nothing has to be
    deduplicated by pair. One tree at a time is shuffled. An empty table gives an empty result; other columns are not
    looked at. ``trees``: by default as many as the depth asks for.
    """
    kind = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{kind}>").alias("v"))
    fine = usable(F.col("v")) & F.col("id").isNotNull()
    length = main_length(rows.where(fine))
    fine = fine & (F.size("v") == length)
    reps = durable(rows.where(fine).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "reps")
    total = reps.count()
    if not total:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    few = units(np.array([r[0] for r in sampled(reps, "rep", sample, total).select("v").collect()], float))
    depth = max(0, int(np.ceil(np.log2(total / leaf))))
    forest = [grow(few, depth, t) for t in range(trees or trees_for(depth))]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(matrix(batch.column(1)))
            found = [tree.leaves(x) for tree in forest]
            row = np.concatenate([r for r, _ in found])
            code = np.concatenate([n + (t << 40) for t, (_, n) in enumerate(found)])
            order = np.lexsort((code, row))
            at = np.searchsorted(row[order], np.arange(len(x) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(code[order]))], ["rep", "v", "weight", "leaves"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_runs(batches, "tile"):
            ends = np.flatnonzero(np.diff(some["tile"].to_numpy(), append=np.int64(0), prepend=np.int64(0)))
            cut = np.unique(np.concatenate([[0], ends, [len(some)]])).tolist()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                found = tile_links(some.slice(a, b - a), least) if b - a > 1 else None
                if found is not None:
                    yield found

    indexed = durable(reps.select("rep", "v", "weight").mapInArrow(index, f"rep bigint, v array<{kind}>, weight bigint, leaves array<bigint>"), "indexed")
    parts = []
    for t in range(len(forest)):
        own = indexed.withColumn("leaves", F.filter("leaves", lambda c: c < (t + 1) << 40))
        placed = own.withColumn("leaf", F.explode(F.filter("leaves", lambda c: c >= t << 40)))
        blocks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1")
        dealt = placed.join(blocks, "leaf").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        dealt = dealt.select("rep", "v", "weight", "leaves", "leaf", side.alias("side"), F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other")).alias("tile"))
        found = dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "rep bigint, n_links bigint, root bigint")
        parts.append(durable(found, "found"))
    found = reduce(DataFrame.union, parts)
    roots = durable(classes(found.where("root <> rep").select(F.col("root").alias("a"), F.col("rep").alias("b")), "roots"), "classes")
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("more"))
    named = reps.join(counts, "rep", "left").join(roots, reps.rep == roots.node, "left").select("v", (F.coalesce("more", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    named = durable(named, "named")
    release(indexed, reps, *parts)
    # the vector itself is the key of its copies; a left join keeps what links with nothing
    out = rows.withColumn("key", F.when(fine, F.col("v"))).join(named.withColumnRenamed("v", "key"), "key", "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"))


def rotation(length: int, bits: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix that takes vectors of ``length``, padded with zeros, to ``bits`` numbers."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:length]


def packed(signs: np.ndarray) -> np.ndarray:
    """64 signs in a number."""
    return np.packbits(signs, axis=1).view(np.uint64)


def estimated(codes: np.ndarray, ones: np.ndarray, query: np.ndarray, levels: int = 4) -> np.ndarray:
    """Inner products of each code's signs, as -1 and 1, with each query row, through the query's bit planes: only counts of common bits are needed."""
    low = query.min(axis=1, keepdims=True)
    step = np.maximum((query.max(axis=1, keepdims=True) - low) / ((1 << levels) - 1), 1e-12)
    whole = np.round((query - low) / step).astype(np.uint8)
    hit = np.zeros((len(query), len(codes)))
    for k in range(levels):
        plane = packed((whole >> k) & 1)
        common = np.zeros((len(query), len(codes)), np.int32)
        for w in range(codes.shape[1]):
            common += np.bitwise_count(plane[:, w][:, None] & codes[:, w][None, :])
        hit += (1 << k) * common
    rounded = whole * step + low
    return 2 * (step * hit + low * ones[None, :]) - rounded.sum(axis=1, keepdims=True)


class Nearest:
    """The queries of a round with their nearest rows so far.

    ``limit``: for each query, a distance that its k-th nearest row does not exceed.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, center: np.ndarray, k: int, width: float, limit: np.ndarray | None = None):
        self.ids, self.x, self.k, self.width = ids, x, k, width
        y = (x - center) @ turn
        self.size = np.linalg.norm(y, axis=1)
        self.turned = y / np.maximum(self.size, 1e-300)[:, None]
        self.limit = np.full(len(ids), np.inf) if limit is None else limit.copy()
        self.best: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]

    def measure(self, q: np.ndarray, r: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Takes in pairs by their distance on the original vectors, squares added from the first component to the last."""
        far = np.zeros(len(q))
        for c in range(v.shape[1]):
            far += (self.x[q, c] - v[r, c]) ** 2
        far = np.sqrt(far)
        near = far <= self.limit[q]
        self.best.append([q[near], ids[r[near]], far[near]])

    def scan(self, rows: dict[str, np.ndarray]) -> None:
        """Takes in a block of coded rows.

        The squared distance is estimated from the codes; its error is bounded by ``width`` standard deviations of the
        part of the unit vector that the code misses. Rows whose lower bound lies within the query's limit, and below
        the k-th smallest upper bound of the block, are measured.
        """
        bits = self.turned.shape[1]
        slack = self.width * np.sqrt(np.maximum(1 - rows["fit"] ** 2, 0)) / rows["fit"] / np.sqrt(bits - 1)
        for i in range(0, len(self.ids), QUERIES):
            mine = slice(i, i + QUERIES)
            inner = estimated(rows["code"], rows["ones"], self.turned[mine]) / np.sqrt(bits) / rows["fit"][None, :]
            base = self.size[mine, None] ** 2 + rows["size"][None, :] ** 2
            scale = 2 * self.size[mine, None] * rows["size"][None, :]
            guess, error = base - scale * inner, scale * slack[None, :]
            own = self.ids[mine, None] == rows["id"][None, :]
            near = min(self.k, len(rows["id"])) - 1
            limit = np.minimum(np.partition(np.where(own, np.inf, guess + error), near, axis=1)[:, near], self.limit[mine] ** 2 * (1 + 1e-9))
            q, r = np.nonzero((guess - error <= limit[:, None]) & ~own)
            self.measure(q + i, r, rows["id"], rows["v"])
        self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keeps the k nearest of each query, ties to the smaller id: (query, row's id, distance)."""
        q, r, far = (np.concatenate(c) for c in zip(*self.best, strict=True))
        order = np.lexsort((r, far, q))
        q, r, far = q[order], r[order], far[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.limit[q[last]] = np.minimum(self.limit[q[last]], far[last])
        top = rank < self.k
        self.best = [[q[top], r[top], far[top]]]
        return q[top], r[top], far[top]


def encoded(v: np.ndarray, turn: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, norms, fit): signs of the rotated unit residual, the residual's norm, and the inner product of the code's unit vector with it."""
    y = (v - center) @ turn
    size = np.linalg.norm(y, axis=1)
    unit = y / np.maximum(size, 1e-300)[:, None]
    signs = y > 0
    fit = np.where(np.abs(unit).sum(axis=1) > 0, np.abs(unit).sum(axis=1) / np.sqrt(y.shape[1]), 1.0)
    return packed(signs), size, fit


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = CODE_BITS, width: float = 3.0, sample: int = SAMPLE_ROWS, round_size: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` marks, the k nearest other rows by Euclidean distance in double precision, ties to the smaller id.

    Rows are coded once (bits packed in numbers, a norm and a correction scalar each), written, and stay where they are.
    Queries go to them in broadcasts of about ``round_size`` (less for long vectors: NUMBERS), each with the k-th smallest
    distance to a few rows of the sample as its limit, so a partition returns few rows a query and only these are
    shuffled. Vectors that are null, zero or hold null or non-finite components, rows without an id, and vectors of
    another length than most have take no part. Repeated rows are candidates each, and ask each. An empty table gives an
    empty result; other columns are not looked at. The sample sets the centre and the limits alone.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    length = main_length(rows)
    rows = rows.where(F.size("v") == length)
    largest = F.aggregate(F.transform("v", lambda c: F.abs(c.cast("double"))), F.lit(0.0), lambda a, b: F.greatest(a, b))
    total, asks, most = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)), F.max(largest)).first()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not asks:
        return spark.createDataFrame([], empty)
    # all work is done in this unit, a power of two, so squares stay finite and results are the same to the last bit
    unit = 2.0 ** min(1023, math.ceil(math.log2(most)))
    bound = max(1, NUMBERS // length)
    few = sampled(rows, "id", min(sample, bound), total).select("id", "v").collect()
    few_ids, few_v = np.array([r[0] for r in few]), np.array([r[1] for r in few], float) / unit
    center = few_v.mean(axis=0)
    bits = max(bits, -(-length // 64) * 64)
    turn = rotation(length, bits)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed_, size, fit = encoded(matrix(batch.column(1)) / unit, turn, center)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in packed_], pa.binary()), pa.array(size), pa.array(fit)], ["id", "v", "code", "size", "fit"])

    kind = df.schema[vector_col].dataType.simpleString()
    coded = durable(rows.select("id", "v").mapInArrow(code, f"id bigint, v {kind}, code binary, size double, fit double"), "codes")
    asking = durable(rows.where("asks").groupBy("id", "v").agg(F.count("*").alias("times")), "asking")
    rounds = max(1, -(-asking.count() // min(round_size, bound)))
    place = F.pmod(F.xxhash64("id", "v"), F.lit(rounds))
    parts = []
    for number in range(rounds):
        asked = asking.where(place == number).collect()  # about round_size, whatever the table's size
        if not asked:
            continue
        first = Nearest(np.array([r[0] for r in asked]), np.array([r[1] for r in asked], float) / unit, turn, center, k, width)
        for i in range(0, len(asked), QUERIES):  # against a few rows of the sample, whole
            q, r = np.nonzero(first.ids[i : i + QUERIES, None] != few_ids[None, :SEEDS])
            first.measure(q + i, r, few_ids, few_v)
        first.settle()
        sent = spark.sparkContext.broadcast((first.ids, first.x, np.array([r[2] for r in asked]), first.limit, turn, center, unit, k, width))
        found = coded.mapInArrow(_near(sent), "query_id bigint, vec_id bigint, score double")
        parts.append(durable(found, "found") if rounds > 1 else found)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return reduce(DataFrame.union, parts).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _near(sent):  # a function of its own: nothing else of the operator travels with it
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, times, limit, turn, center, unit, k, width = sent.value
        mine = Nearest(ids, x, turn, center, k, width, limit)
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                some = batch.slice(i, BLOCK)
                codes = np.frombuffer(b"".join(some.column(2).to_pylist()), np.uint64).reshape(len(some), -1)
                mine.scan({"id": some.column(0).to_numpy(), "v": matrix(some.column(1)) / unit, "code": codes, "ones": np.bitwise_count(codes).sum(axis=1).astype(float), "size": some.column(3).to_numpy(), "fit": some.column(4).to_numpy()})
        q, r, far = mine.settle()
        again = np.minimum(times, k)[q]  # rows of one id and vector ask each
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[q], again)), pa.array(np.repeat(r, again)), pa.array(np.repeat(far * unit, again))], ["query_id", "vec_id", "score"])

    return run
