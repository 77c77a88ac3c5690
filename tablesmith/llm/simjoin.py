"""Set-similarity join of documents on word n-grams, by parity sketches.

Every n-gram flips one bit of a document's sketch, so the Hamming distance of two sketches is at most the size of the
sets' symmetric difference. Within a band of set sizes that difference is at most d for linked documents. The sketch is
cut into d + 1 + e chunks: at least e + 1 of them are then equal for a linked pair. A chunk travels as a hash that is
linear over its bits (the exclusive or of a random number for each bit set), and documents that share enough chunks of
the same band are candidates, which are verified on the whole sets.

Chance and hot keys are kept down without losing a link. Empty chunks are skipped by documents that have at most e of
them: a pair still shares e + 1 - (empty chunks of either) others. A document may therefore forget so many of its chunks
less one, those that most documents share, the same order for all: the first chunk of a pair in that order stays with
both. n-grams that are frequent in a sample do not enter the sketch at all, which only makes the symmetric difference
smaller; documents made up of little else use the full sketch as well, by the same rules.

Pairs are not enumerated within a group of alike documents: a bucket's documents are compared with its first one. Only
where a bucket is then still in several classes are sketches compared across its classes, in tiles, and what comes out of
a tile are pairs whose sketches are near enough to link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import classes, durable, release, sampled, spans_of, utf8, whole_runs
from .pretokens import ODD, mixed, range_hashes, word_ranges

#: Documents sampled to find frequent n-grams, the share of them from which on an n-gram is frequent, and how many of these are left out. They change the work, never the result.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 3000, 0.004, 200_000
BITS = 24  # of a chunk
#: Parts of the key space that are shuffled one after the other, so that only one of them is on disk at a time.
PARTS = 4
#: Rows of a bucket in a block, and bits of the sketches that blocks are compared by.
TILE, TILE_BITS = 512, 1024
#: Least open keys of a row that travel with it: a close pair is given in the least key that both have, as far as these tell.
LOW_KEYS = 16
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 0x20
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def shingle_sets(flat: np.ndarray, starts: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's distinct n-grams as sorted 64-bit hashes; with fewer words than n the whole sequence is one, without words there is none."""
    begin, end, text = word_ranges(BLANK[flat], starts)
    texts = len(starts) - 1
    if not len(begin):
        return [np.zeros(0, np.uint64)] * texts
    word = range_hashes(LOWERED[flat], begin, end)
    count = np.bincount(text, minlength=texts)
    first = np.cumsum(count) - count
    rolled = np.zeros(len(word), np.uint64)
    for k in range(n):
        rolled[: len(word) - k] += word[k:] * np.uint64(pow(ODD, k, 1 << 64))
    rolled = mixed(rolled + np.uint64(n))
    out = []
    for a, m in zip(first.tolist(), count.tolist(), strict=True):
        if m >= n:
            out.append(np.unique(rolled[a : a + m - n + 1]))
        elif m:
            with np.errstate(over="ignore"):
                whole = (word[a : a + m] * np.array([pow(ODD, k, 1 << 64) for k in range(m)], np.uint64)).sum(dtype=np.uint64)
            out.append(mixed(np.array([whole], np.uint64) + np.uint64(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Bands:
    """Size bands for a threshold of ``percent``: their upper ends grow by 1 / threshold squared, so a document's partners lie in its own band or the next."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tops = [1]
        while self.tops[-1] < 1 << 40:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 10_000 // percent**2))

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.tops, size))

    def probed(self, size: int) -> range:
        """The bands of all sizes from ``size`` to the largest that can be linked with it; a pair meets in the larger one's band."""
        return range(self.of(size), self.of(size * 100 // self.percent) + 1)

    def cut(self, band: int) -> tuple[int, int]:
        """(chunks, spare chunks) of a band."""
        difference = 2 * self.tops[band] * (100 - self.percent) // (100 + self.percent)
        spare = difference // 4 + 2 if difference else 0
        return difference + 1 + spare, spare


def chunk_keys(grams: np.ndarray, band: int, chunks: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, whether any bit is set) of every chunk; a key's last two bits are its group's number."""
    chunk = ((grams >> np.uint64(32)) * np.uint64(chunks) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(chunk, kind="stable")
    bit = mixed((grams[order] & np.uint64((1 << BITS) - 1)) + np.uint64(ODD))
    count = np.bincount(chunk, minlength=chunks)
    value = np.zeros(chunks, np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        value[full] = np.bitwise_xor.reduceat(bit, (np.cumsum(count) - count)[full])
    name = np.uint64((group << 56) + (band << 40)) + np.arange(chunks, dtype=np.uint64)
    return mixed(value ^ mixed(name)) & ~np.uint64(3) | np.uint64(group), value != 0


def sketch_keys(grams: np.ndarray, bands: Bands, frequent: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(group, how many keys a linked document shares at least, keys): what a document is to be met under, over all bands that it probes. A group is one band and one kind of sketch."""
    out = []
    rare = grams[~np.isin(grams, frequent, assume_unique=True)] if len(frequent) else grams
    for band in bands.probed(len(grams)):
        chunks, spare = bands.cut(band)
        key, filled = chunk_keys(rare, band, chunks, band & 1)
        empty = chunks - int(filled.sum())
        out.append((band & 1, max(1, spare + 1 - empty), key[filled]))
        if empty > spare:  # a partner like this one meets it under the full sketch
            key, filled = chunk_keys(grams, band, chunks, 2 + (band & 1))
            empty = chunks - int(filled.sum())
            out.append((2 + (band & 1), 1, key) if empty > spare else (2 + (band & 1), spare + 1 - empty, key[filled]))
    return out


def bit_sketch(grams: np.ndarray, width: int = 0) -> bytes:
    """The parity of the n-grams by bit, in a power of two of bits, at least twice as many as n-grams: half the bits are the exclusive or of both halves."""
    width = width or max(64, 1 << int(2 * len(grams) - 1).bit_length())
    bits = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def narrowed(bits: bytes, width: int) -> np.ndarray:
    """The sketch at ``width`` bytes, halves folded onto each other; a narrower one as it is."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def distance(x: bytes, y: bytes) -> int:
    """The Hamming distance of two sketches, the wider one folded to the width of the other."""
    width = min(len(x), len(y))
    return int(np.bitwise_count(narrowed(x, width) ^ narrowed(y, width)).sum())


def near_across(tile: np.ndarray, side: np.ndarray, root: np.ndarray, size: np.ndarray, bits: np.ndarray, percent: int, most: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) that lie in one tile, on different sides and in different classes, and whose sizes and sketches let them link; about ``most`` pairs are looked at together. side 0: first block, 1: second, 2: both."""
    begin = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    end = np.append(begin[1:], len(tile))
    past = np.repeat(end, end - begin)
    count = past - np.arange(len(tile)) - 1  # partners of a row: those behind it in its tile
    ahead = np.concatenate([[0], np.cumsum(count)])
    a = 0
    while a < len(tile):
        b = max(a + 1, int(np.searchsorted(ahead, ahead[a] + most, side="right")) - 1)
        i = np.repeat(np.arange(a, b), count[a:b])
        j = np.arange(len(i)) - np.repeat(ahead[a:b] - ahead[a], count[a:b]) + i + 1
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        fits = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] == 2)) & (100 * low >= percent * high)
        i, j, both = i[fits], j[fits], (low + high)[fits]
        near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) * (100 + percent) <= (100 - percent) * both
        if near.any():
            yield i[near], j[near]
        a = b


def least_common(a: pa.ListArray, b: pa.ListArray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the least key of both rows, or may be: lists hold a row's LOW_KEYS least keys in order.

    A key in both lists is the least common one if it is the least such: all smaller keys of both rows are in the lists.
    Without one the least common key is not known, and the pair is given in each bucket that it shares.
    """
    beyond = np.iinfo(np.int64).max
    wide = []
    for some in (a, b):
        out = np.full((len(some), LOW_KEYS), beyond, np.int64)
        count = some.value_lengths().to_numpy()
        out[np.repeat(np.arange(len(some)), count), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)] = some.flatten().to_numpy()
        wide.append(out)
    both = (wide[0][:, :, None] == wide[1][:, None, :]).any(axis=2) & (wide[0] != beyond)
    least = np.where(both, wide[0], beyond).min(axis=1)
    return (least == beyond) | (least == key)


def similar(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> DataFrame:
    """(id, n_shingles, component_id) for every row: documents link when 100 * intersection >= percent * union of their sets of word n-grams.

    component_id is the smallest id reachable by links, itself included. Null and texts without words have the empty set
    and link with nothing. Rows that share an id are one node; a row without an id has no class of its own (its id
    stands for it: null) unless another row has the same set. Copies of a set are collapsed before anything is joined;
    no link between different sets is lost. An empty table gives an empty result. Other columns are not looked at.
    A text is held whole by its task, with about 40 bytes a character.
    """
    bands = Bands(percent)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def of_sets(make: Callable[[pa.Array, list[np.ndarray]], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """A step over batches of (id, text): ``make`` gets ids and their texts' n-grams."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, starts = utf8(batch.column(1))
                for i, j in spans_of(starts):
                    yield make(batch.column(0).slice(i, j - i), shingle_sets(flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i], n))

        return run

    def stamp(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        marks = [np.array([int(np.bitwise_xor.reduce(mixed(s + np.uint64(k)))) if len(s) else 0 for s in sets], np.uint64).view(np.int64) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, sets)), pa.int64()), *map(pa.array, marks)], ["id", "n", "m1", "m2"])

    stamps = durable(docs.mapInArrow(of_sets(stamp), f"id {kind}, n bigint, m1 bigint, m2 bigint"), "stamps")
    reps = durable(stamps.where("n > 0 and id is not null").groupBy("n", "m1", "m2").agg(F.min("id").alias("rep")), "reps")
    some = sampled(docs.where("text is not null"), "id", sample, total=stamps.count())
    grams = of_sets(lambda ids, sets: pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["gram"]))
    often = some.mapInArrow(grams, "gram bigint").groupBy("gram").count().where(F.col("count") >= max(10, int(FREQUENT * sample)))
    often = often.orderBy(F.desc("count"), "gram").limit(MOST_FREQUENT).select("gram").toPandas()["gram"]
    frequent = np.sort(often.to_numpy(np.int64).view(np.uint64))
    parts = [f"part{r}" for r in range(PARTS)]

    def sketch(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        rows = [(i, *x) for i, s in enumerate(sets) if len(s) for x in sketch_keys(s, bands, frequent)]
        keys = np.concatenate([r[3] for r in rows] or [np.zeros(0, np.uint64)])
        owner, part = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows]), (keys >> np.uint64(32)).astype(np.int64) % PARTS
        lists = []
        for r in range(PARTS):
            at = np.concatenate([[0], np.cumsum(np.bincount(owner[part == r], minlength=len(rows)))]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(keys[part == r].view(np.int64))))
        own = [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))]
        return pa.RecordBatch.from_arrays([ids.take(own[0]), *own[1:], *lists], ["id", "group", "need", *parts])

    keyed = docs.mapInArrow(of_sets(sketch), f"id {kind}, group int, need int, {', '.join(f'{p} array<bigint>' for p in parts)}")
    keyed = durable(keyed.join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "keyed")
    tables: list[DataFrame] = []
    for part in parts:
        rows = keyed.select(F.explode(part).alias("key"), "id")
        tables.append(durable(rows.join(rows.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "key").select("key", "id", "many"), "shared"))
    # what most documents share is forgotten first, as far as a linked pair can spare it
    shared = reduce(DataFrame.union, tables).withColumn("group", F.col("key").bitwiseAND(3).cast("int"))
    popular = F.row_number().over(W.partitionBy("id", "group").orderBy(F.desc("many"), "key"))
    kept = shared.withColumn("place", popular).join(keyed.select("id", "group", "need"), ["id", "group"]).where("place >= need").select("key", "id")
    kept = durable(kept, "kept")
    release(keyed, *tables)
    buckets = kept.groupBy("key").agg(F.count("*").alias("many"), F.min("id").alias("lead")).where("many > 1")
    members = durable(kept.join(buckets, "key"), "members")
    pairs = durable(members.where("id <> lead").groupBy("id", "lead").agg(F.count("*").alias("times")), "pairs")
    wanted = pairs.select("id").union(pairs.select(F.col("lead").alias("id"))).distinct()

    def whole(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        bits = [bit_sketch(s) for s in sets]
        return pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, sets)), pa.int64()), pa.array(bits, pa.binary()), pa.array([bit_sketch(s, TILE_BITS) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "size", "bits", "fold", "grams"])

    sets = durable(docs.join(wanted, "id", "left_semi").mapInArrow(of_sets(whole), f"id {kind}, size bigint, bits binary, fold binary, grams binary").where("size > 0"), "sets")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            keep = [distance(x, y) * (100 + percent) <= (100 - percent) * (m + n) for m, n, x, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(left, right, strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                a, b = (a, b) if len(a) <= len(b) else (b, a)
                common = 0
                if 100 * len(a) >= percent * len(b):
                    at = np.searchsorted(b, a)
                    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def beside(some: DataFrame, *columns: str) -> DataFrame:
        """The pairs (a, b) with these columns of both their sets."""
        left, right = (sets.select(F.col("id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in columns)) for c in ("a", "b"))
        return some.join(left, "a").join(right, "b").select("a", "b", *(f"{c}_{x}" for x in columns for c in ("a", "b")))

    def linked(some: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link: by size, by the distance of their sketches, then by their whole sets."""
        sized = beside(some, "size", "bits").where(f"100 * least(a_size, b_size) >= {percent} * greatest(a_size, b_size)")
        close = durable(sized.mapInArrow(near, f"a {kind}, b {kind}").distinct(), "close")
        return beside(close, "grams").mapInArrow(verify, f"a {kind}, b {kind}").distinct()

    # each document with the leader that it shares most chunks with, then with its other leaders unless they are in one class by then
    best = pairs.groupBy("id").agg(F.max_by("lead", F.struct("times", F.xxhash64("lead"))).alias("lead"))
    links = durable(linked(best.select(F.col("lead").alias("a"), F.col("id").alias("b"))), "links")
    roots = classes(links, "roots")
    rest = pairs.join(best, ["id", "lead"], "left_anti").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    links = links.union(durable(linked(durable(apart(rest, roots), "rest")), "links"))
    roots = classes(links, "roots")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "tile"):
            bits = np.frombuffer(b"".join(rows["fold"].to_pylist()), np.uint64).reshape(len(rows), -1)
            root = rows["root"].combine_chunks().dictionary_encode().indices.to_numpy()
            ids, key, low = rows["id"].combine_chunks(), rows["key"].to_numpy(), rows["low"].combine_chunks()
            for i, j in near_across(rows["tile"].to_numpy(), rows["side"].to_numpy(), root, rows["size"].to_numpy(), bits, percent):
                first = least_common(low.take(pa.array(i)), low.take(pa.array(j)), key[i])
                if first.any():
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[first])), ids.take(pa.array(j[first]))], ["a", "b"])

    # buckets of three and more that still hold several classes; of two, the pair has been tried
    named = members.where("many > 2").join(roots, members.id == roots.node, "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed_ = named.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("key")
    open_ = durable(named.join(mixed_, "key"), "open")
    place = F.row_number().over(W.partitionBy("id").orderBy("key"))
    low = open_.select("id", "key", place.alias("place")).where(F.col("place") <= LOW_KEYS).groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("low"))
    tiles = tiled(open_, TILE).join(sets.select("id", "size", "fold").join(low, "id"), "id")
    more = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, f"a {kind}, b {kind}")
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.union(durable(linked(durable(more, "more")), "links"))
    roots = durable(classes(links, "roots").withColumnRenamed("node", "rep"), "classes")
    release(kept, members, pairs, sets)
    named = reps.join(roots, "rep", "left").select("n", "m1", "m2", F.coalesce("root", "rep").alias("root"))
    nodes = stamps.where("n > 0").select(F.col("id").alias("rep"), "n", "m1", "m2")
    out = stamps.where("n = 0").select("id", "n", F.col("id").alias("root")).union(nodes.join(named, ["n", "m1", "m2"], "left").select("rep", "n", F.coalesce("root", "rep")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one class."""
    left, right = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
    return pairs.join(left, "a", "left").join(right, "b", "left").where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")


def tiled(open_: DataFrame, tile: int) -> DataFrame:
    """(id, root, key, tile, side): the buckets' rows dealt into blocks of about ``tile``, and blocks into tiles, so that all pairs across classes meet.

    The largest class of a bucket is not compared with itself: its rows meet the others' blocks only, so a bucket of one
    large class and a few other documents takes rows in proportion.
    """
    sizes = open_.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", F.xxhash64("root"))).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"))
    rows = open_.join(sizes.select("key", "main", F.ceil(F.col("most") / tile).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("most")) / tile).cast("int").alias("others")), "key")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("root") == F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("own", own)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    main = rows.where("root = main").select("id", "root", "key", F.lit(0).alias("kind"), F.col("own").alias("i"), upto("others").alias("j"), F.lit(0).alias("side"))
    beside = rows.where("root <> main").select("id", "root", "key", F.lit(0).alias("kind"), upto("mains").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    other = rows.where("root <> main").withColumn("other", upto("others"))
    other = other.select("id", "root", "key", F.lit(1).alias("kind"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))
    return main.union(beside).union(other).select("id", "root", "key", F.xxhash64("key", "kind", "i", "j").alias("tile"), "side")
