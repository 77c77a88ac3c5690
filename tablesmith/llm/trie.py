"""A trie over the turns of conversations: balanced parentheses per shard of sorted paths, spines merged between shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, release, whole_runs

#: Turns that a shard holds about, and bytes of the digest that a turn is known by.
SHARD_TURNS, DIGEST = 200_000, 16
#: Parentheses in a block of the excess tree.
BLOCK = 256
#: Ids that a piece of a list holds where the list reaches beyond a shard.
PIECE = 4096
NOTHING = hashlib.sha256(b"").hexdigest()
#: Rows that come out of a shard: nodes that begin and end in it; its part of nodes begun in earlier shards; nodes that it begins and does not end; ids that end at such nodes.
WHOLE, CARRIED, OPENED, ENDS = 0, 1, 2, 3
COUNTS = "n_convs bigint, conv_id bigint, n_leaves bigint, n_children bigint, saved_tokens bigint"
SHARD_ROWS = f"shard bigint, kind int, depth bigint, {COUNTS}, parent_kind int, parent_conv_id bigint, ends_sha256 string, part int, ids string"


def digest(role: Column, text: Column) -> Column:
    """The first 16 bytes of the SHA-256 of a turn: its role's length, its role, its text."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, DIGEST)


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, items): for every conversation its turns in order, each a digest and its text's code points.

    Order is by turn, null first; turns of equal number stand in the order of their digests, so that repeated rows stay
    turns of their own. Null role and text are empty; rows without an id belong to no conversation. Texts are not
    shuffled; one conversation's digests (20 bytes a turn) stand in one row.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    item = F.struct(F.col(f"`{turn_col}`").alias("turn"), digest(role, text).alias("digest"), F.length(text).alias("size"))
    rows = turns.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("conv_id"), item.alias("item"))
    inner = F.transform(F.sort_array(F.collect_list("item")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    return rows.groupBy("conv_id").agg(inner.alias("items"))


def closing(excess: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For every opening parenthesis its closing one: the first later place whose excess is one less.

    ``excess`` is that after each place of a balanced sequence. A tree of block minima leads to the block, whose places are looked at in turn.
    """
    n = len(excess)
    blocks = -(-n // BLOCK)
    padded = np.concatenate([excess, np.full(blocks * BLOCK - n, np.iinfo(np.int64).max)]).reshape(blocks, BLOCK)
    levels = [padded.min(axis=1)]
    while len(levels[-1]) > 1:
        low = levels[-1]
        low = np.concatenate([low, np.full(len(low) % 2, np.iinfo(np.int64).max)])
        levels.append(low.reshape(-1, 2).min(axis=1))
    goal, found = excess[opens] - 1, np.full(len(opens), -1)

    def scan(which: np.ndarray, block: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Looks through one block for each of ``which``, from ``first`` on; those not found."""
        for some in np.array_split(np.arange(len(which)), max(1, len(which) // 4096)):
            hit = (padded[block[some]] <= goal[which[some], None]) & (np.arange(BLOCK)[None, :] >= first[some, None])
            there = hit.any(axis=1)
            found[which[some[there]]] = block[some[there]] * BLOCK + hit[there].argmax(axis=1)
        return which[found[which] < 0]

    rest = scan(np.arange(len(opens)), opens // BLOCK, opens % BLOCK + 1)
    at, level = opens[rest] // BLOCK, np.zeros(len(rest), np.int64)
    rising = np.ones(len(rest), bool)
    while rising.any():  # up to the first subtree to the right that goes as low
        for k in np.unique(level[rising]):
            mine = np.flatnonzero(rising & (level == k))
            right = at[mine] + 1
            inside = (at[mine] % 2 == 0) & (right < len(levels[k]))
            good = np.zeros(len(mine), bool)
            good[inside] = levels[k][right[inside]] <= goal[rest[mine[inside]]]
            at[mine] = np.where(good, right, at[mine] // 2)
            level[mine] += ~good
            rising[mine[good]] = False
    while (level > 0).any():  # and down to its first such block
        for k in np.unique(level[level > 0]):
            mine = np.flatnonzero(level == k)
            left = at[mine] * 2
            at[mine] = left + (levels[k - 1][left] > goal[rest[mine]])
            level[mine] -= 1
    scan(rest, at, np.zeros(len(rest), np.int64))
    return found


def range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last], ends included, of each range."""
    rows = [values]
    while 2 << len(rows) - 1 <= len(values):
        half = 1 << len(rows) - 1
        rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
    level = np.log2(last - first + 1).astype(np.int64)
    out = np.empty(len(first), values.dtype)
    for k in np.unique(level):
        mine = level == k
        out[mine] = np.minimum(rows[k][first[mine]], rows[k][last[mine] - (1 << k) + 1])
    return out


def common_turns(turns: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many first turns each path shares with the one before it; 0 for the first."""
    sizes = np.diff(starts)
    most = np.minimum(sizes[1:], sizes[:-1])
    ends = np.cumsum(most)
    inner = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - most, most)
    differ = (turns[np.repeat(starts[1:-1], most) + inner] != turns[np.repeat(starts[:-2], most) + inner]).any(axis=1)
    out = most.copy()
    some = np.flatnonzero(most)
    if len(some):
        out[some] = np.minimum(most[some], np.minimum.reduceat(np.where(differ, inner, np.iinfo(np.int64).max), (ends - most)[some]))
    return np.concatenate([[0], out]).astype(np.int64)


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each count."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def shard_rows(shard: int, ids: np.ndarray, turns: np.ndarray, sizes: np.ndarray, starts: np.ndarray, before: int, after: int) -> Iterator[pa.RecordBatch]:
    """What one shard knows of its nodes, from its paths in order.

    ``before`` is how many turns its first path shares with the last of the shard before, -1 without one; ``after`` the
    same for its last path and the next shard. Nodes open in earlier shards are opened once more in front, nodes that
    stay open are closed at the end, so the sequence is balanced.
    """
    rows, length = len(ids), np.diff(starts)
    shared = common_turns(turns, starts)
    shared[0] = before
    following = np.append(shared[1:], after)
    opens, closes = length - shared, length - following
    carried, left = before + 1, after + 1
    total = carried + int(opens.sum() + closes.sum()) + left
    per_row = opens + closes
    row_end = carried + np.cumsum(per_row)
    row_start = row_end - per_row
    bits = np.zeros(total, bool)
    bits[:carried] = True
    owner = np.repeat(np.arange(rows), opens)
    bits[row_start[owner] + _ragged(opens)] = True
    excess = np.cumsum(np.where(bits, 1, -1))
    place = np.flatnonzero(bits)
    close = closing(excess, place)
    depth = excess[place] - 1
    count = len(place)
    real = np.arange(count) >= carried
    first = np.concatenate([np.zeros(carried, np.int64), owner])
    shut = close < total - left  # in this shard
    last = np.where(shut, np.searchsorted(row_end, close, side="right"), rows - 1)
    n = last - first + 1
    # pairs of an opening parenthesis and the closing one that follows it, which are the leaves
    pair = np.zeros(total + 1, np.int64)
    pair[1:] = np.cumsum(bits & np.append(~bits[1:], False) & (np.arange(total) + 1 < total - left))
    leaves = pair[close + 1] - pair[place]
    within = np.concatenate([[0], np.cumsum(sizes)])
    own = np.zeros(count, np.int64)
    inner = real & (depth > 0)
    own[inner] = sizes[starts[first[inner]] + depth[inner] - 1]
    opened = np.concatenate([[0], np.cumsum(np.where(real, own, 0))])
    rank = np.concatenate([[0], np.cumsum(bits)])
    end = rank[close]  # of the nodes within
    path = np.concatenate([[0], np.cumsum(within[starts[1:]] - within[starts[:-1]])])
    above = np.where(depth > 0, within[starts[first] + np.maximum(depth - 1, 0)] - within[starts[first]], 0)
    saved = path[last + 1] - path[first] - n * above - (opened[end] - opened[np.arange(count)])
    lo = range_least(ids, first, last)
    # a node's parent is the last one before it that lies one level higher
    key = depth * (count + 1) + np.arange(count)
    order = np.argsort(key, kind="stable")
    child = np.flatnonzero(real & (depth > 0))
    parent = np.full(count, -1)
    parent[child] = order[np.searchsorted(key[order], (depth[child] - 1) * (count + 1) + child) - 1]
    children = np.bincount(parent[child], minlength=count)
    kind = np.where(~real, CARRIED, np.where(shut, WHOLE, OPENED))
    known = (parent >= 0) & (kind[parent] == WHOLE)
    # the paths that end at a node are the first of those that run through it
    fresh = np.append(True, (length[1:] != length[:-1]) | (shared[1:] != length[1:]))
    run = np.cumsum(fresh) - 1
    run_end = np.append(np.flatnonzero(fresh)[1:], rows)
    ends = np.where(length[first] == depth, run_end[run[first]] - first, 0)
    hashes, pieces = np.full(count, NOTHING, object), []
    for k in np.flatnonzero(ends).tolist():
        mine = ids[first[k] : first[k] + ends[k]]
        if kind[k] == WHOLE:
            hashes[k] = hashlib.sha256(",".join(map(str, mine.tolist())).encode()).hexdigest()
        else:
            pieces += [(k, i // PIECE, ",".join(map(str, mine[i : i + PIECE].tolist()))) for i in range(0, len(mine), PIECE)]
    missing = pa.nulls(count, pa.int64())
    parent_kind = np.where(parent >= 0, kind[parent], -1)
    yield _batch(shard, kind, depth, [n, lo, leaves, children, saved], pa.array(parent_kind.astype(np.int32), mask=(parent < 0) | known), pc.if_else(pa.array(known), pa.array(lo[parent] if count else lo), missing), pa.array(hashes, pa.string()), None, None)
    if pieces:
        at = np.array([p[0] for p in pieces])
        zero, void = np.zeros(len(at), np.int64), pa.nulls(len(at), pa.int64())
        # the kind of the node stands where its parent's would
        yield _batch(shard, np.full(len(at), ENDS), depth[at], [zero] * 5, pa.array(kind[at].astype(np.int32)), void, pa.nulls(len(at), pa.string()), pa.array([p[1] for p in pieces], pa.int32()), pa.array([p[2] for p in pieces], pa.string()))


def _batch(shard: int, kind: np.ndarray, depth: np.ndarray, counts: list[np.ndarray], parent_kind: pa.Array, parent: pa.Array, hashes: pa.Array, part: pa.Array | None, ids: pa.Array | None) -> pa.RecordBatch:
    n = len(kind)
    columns = [pa.array(np.full(n, shard, np.int64)), pa.array(kind.astype(np.int32)), pa.array(depth.astype(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts), parent_kind, parent, hashes, pa.nulls(n, pa.int32()) if part is None else part, pa.nulls(n, pa.string()) if ids is None else ids]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SHARD_ROWS.split(", ")])


def _paths(some: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(turns, sizes, starts): two numbers for each turn's digest, its code points, and where each path begins."""
    path = some["path"].combine_chunks().cast(pa.large_binary())
    chunk = path if isinstance(path, pa.Array) else path.chunk(0)
    _, places, data = chunk.buffers()
    starts = np.frombuffer(places, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
    flat = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    turns = np.ascontiguousarray(flat).view(np.uint64).reshape(-1, 2)
    sizes = some["sizes"].combine_chunks()
    sizes = sizes if isinstance(sizes, pa.Array) else sizes.chunk(0)
    return turns, sizes.flatten().to_numpy().astype(np.int64), (starts - starts[0]) // DIGEST


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards come whole; side -1 is the path before a shard, 1 the one after it."""
    for some in whole_runs(batches, "shard"):
        shard = some["shard"].to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            mine = some.slice(a, b - a).combine_chunks()
            side = mine["side"].to_numpy()
            turns, sizes, starts = _paths(mine)
            shared = common_turns(turns, starts)
            first, end = int((side == -1).sum()), int((side < 1).sum())
            yield from shard_rows(int(shard[a]), mine["conv_id"].to_numpy()[first:end], turns[starts[first] : starts[end]], sizes[starts[first] : starts[end]], starts[first : end + 1] - starts[first], int(shared[first]) if first else -1, int(shared[end]) if end < len(side) else -1)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each node (depth, spine), over its pieces in order; only the running hash is held."""
    node, state = None, None
    for batch in batches:
        out = []
        for depth, spine, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if node != (depth, spine):
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, spine), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield _hashes(out)
    if node is not None:
        yield _hashes([(*node, state.hexdigest())])


def _hashes(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    depth, spine, ends = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(spine, pa.int64()), pa.array(ends, pa.string())], ["depth", "spine", "ends_sha256"])


def prefix_trie(sequenced: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of all ``sequenced`` conversations (conv_id, items as :func:`sequences` gives them).

    Returns for each distinct sequence of first turns, the empty one included: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree, (n_convs - 1) times the code points of
    each node's last text) and ends_sha256 (of the ids that end there, ascending, comma-joined).

    Paths, as digests, are sorted by range into shards of about ``shard_turns`` turns; equal paths are ordered by id, so a
    large group of copies is cut like any other. A shard knows the paths next to it, so each node is opened in one shard
    alone; what lies between its opening and closing parenthesis adds up over shards: paths, leaf pairs, lengths of
    paths and of nodes. Nodes that reach beyond a shard (its spines) are grouped by depth and by the number of openings
    at that depth so far. Ids that end at such a node are hashed in order, in pieces; only the running hash is kept.
    A conversation without turns ends at the root. An empty table has no node, not even the root. Repeated ids are
    members each.
    """
    spark = sequenced.sparkSession
    path = F.coalesce(F.array_join(F.transform("items", lambda t: F.hex(t["digest"])), ""), F.lit(""))
    packed = sequenced.select("conv_id", F.unhex(path).alias("path"), F.transform("items", lambda t: t["size"]).alias("sizes"))
    packed = durable(packed, "paths")
    turns, convs = packed.agg(F.coalesce(F.sum(F.size("sizes").cast("bigint")), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-(turns + convs) // shard_turns))
    dealt = packed.repartitionByRange(shards, "path", "conv_id").withColumn("shard", F.spark_partition_id().cast("bigint"))
    dealt = durable(dealt, "shards")
    ends = dealt.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    along = W.orderBy("shard")  # one row for each shard
    beside = ends.select("shard", F.lag("high").over(along).alias("earlier"), F.lead("low").over(along).alias("later"))
    beside = beside.select("shard", F.explode(F.array(F.struct(F.lit(-1).alias("side"), F.col("earlier").alias("path")), F.struct(F.lit(1).alias("side"), F.col("later").alias("path")))).alias("x"))
    beside = beside.where("x.path is not null").select("shard", "x.side", "x.path", F.lit(0).cast("bigint").alias("conv_id"), F.array_repeat(F.lit(0), (F.length("x.path") / DIGEST).cast("int")).alias("sizes"))
    inputs = dealt.select("shard", F.lit(0).alias("side"), "path", "conv_id", "sizes").union(beside)
    found = inputs.repartition(shards, "shard").sortWithinPartitions("shard", "side", "path", "conv_id").mapInArrow(_build, SHARD_ROWS)
    found = durable(found, "nodes")
    release(packed, dealt)
    pieces = found.where(F.col("kind").isin(CARRIED, OPENED))
    opened = F.sum((F.col("kind") == OPENED).cast("bigint")).over(W.partitionBy("depth").orderBy("shard", "kind").rowsBetween(W.unboundedPreceding, 0))
    pieces = pieces.withColumn("spine", opened)
    fresh = F.col("kind") == OPENED
    merged = pieces.groupBy("depth", "spine").agg(
        *(F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "n_children", "saved_tokens")), F.min("conv_id").alias("conv_id"),
        F.max(F.when(fresh, F.col("shard"))).alias("shard"), F.max(F.when(fresh, F.col("parent_kind"))).alias("parent_kind"),
    )
    lists = found.where(F.col("kind") == ENDS).select("shard", "depth", F.col("parent_kind").alias("kind"), "part", "ids")
    lists = lists.join(pieces.select("shard", "depth", "kind", "spine"), ["shard", "depth", "kind"])
    lists = lists.repartition("depth", "spine").sortWithinPartitions("depth", "spine", "shard", "part").select("depth", "spine", "ids")
    merged = merged.join(lists.mapInArrow(_hashed, "depth bigint, spine bigint, ends_sha256 string"), ["depth", "spine"], "left")
    merged = durable(merged, "spines")
    names = pieces.select("shard", "depth", "kind", "spine").join(merged.select("depth", "spine", "conv_id"), ["depth", "spine"])
    names = names.select("shard", (F.col("depth") + 1).alias("depth"), F.col("kind").alias("parent_kind"), F.col("conv_id").alias("above_id"))
    columns = ["shard", "depth", "parent_kind", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inside = found.where(F.col("kind") == WHOLE)
    tops = merged.select(*columns).union(inside.where("parent_kind is not null").select(*columns))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    tops = tops.join(names, ["shard", "depth", "parent_kind"], "left").withColumn("parent_conv_id", F.col("above_id"))
    rest = inside.where("parent_kind is null")
    return tops.select(*out, F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")).union(rest.select(*out, "ends_sha256"))
