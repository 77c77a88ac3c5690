"""Byte-level BPE: encoding and decoding whole texts by a file of ranks."""

from __future__ import annotations

import base64
import heapq
import json
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import spans_of, utf8
from .pretokens import Encoder

NONE = np.iinfo(np.int32).max
#: Upper ends of the length buckets; longer pieces go through a heap, whose work grows as n log n.
BUCKETS = (4, 8, 16, 32, 64, 128, 256)


class Ranks:
    """A vocabulary by ranks: all pairs of tokens that make up a token, in an open-addressing hash table of numpy arrays."""

    def __init__(self, rank: dict[bytes, int], added: dict[str, int] | None = None):
        """added: literals that are one id wherever they stand; no merge makes or breaks them."""
        self.rank, self.added = rank, added or {}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        key, value = [], []
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    key.append(left << 32 | right)
                    value.append(rank)
        key, value = np.array(key, np.int64), np.array(value, np.int32)
        self.bits = max(4, int(len(key) * 4).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.key[slot[todo]] == -1
            self.key[slot[todo[free]]] = key[todo[free]]
            placed = self.key[slot[todo]] == key[todo]
            self.value[slot[todo[placed]]] = value[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        order = sorted(({i: token for token, i in self.rank.items()} | {i: text.encode() for text, i in self.added.items()}).items())
        size = np.zeros(order[-1][0] + 1, np.int64)
        for i, token in order:
            size[i] = len(token)
        self.size, self.place = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(token for _, token in order), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's token, NONE without one."""
        shape = left.shape
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out, todo = np.full(len(key), NONE, np.int32), np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        slot = self._slot(key[todo])
        while len(todo):
            there = self.key[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.value[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece."""
        raw = [p.encode() for p in pieces]
        out: list[list[int]] = [[]] * len(raw)
        rest: list[list[int]] = [[] for _ in BUCKETS]
        for i, piece in enumerate(raw):
            if (whole := self.rank.get(piece)) is not None:
                out[i] = [whole]
            elif len(piece) > BUCKETS[-1]:
                out[i] = self._by_heap(piece)
            else:
                rest[bisect_left(BUCKETS, len(piece))].append(i)
        for width, rows in zip(BUCKETS, rest, strict=True):
            step = max(1, 1_000_000 // width)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                for i, ids in zip(some, self._by_matrix([raw[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _by_matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """A row for each piece, -1 beyond its end. Each round merges every row's leftmost pair of least rank, closes the gap, and drops the rows that have none."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        grid = np.full((len(pieces), width), -1, np.int32)
        grid[np.arange(width) < length[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.merged(grid[:, :-1], grid[:, 1:])
        row, out = np.arange(len(pieces)), [[]] * len(pieces)
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            for r, ids in zip(row[done].tolist(), grid[done].tolist(), strict=True):
                out[r] = ids[: ids.index(-1)] if ids[-1] == -1 else ids
            row, grid, rank, at, best = row[~done], grid[~done], rank[~done], at[~done], best[~done]
            if not len(row):
                break
            each, w = np.arange(len(row)), grid.shape[1]
            grid[each, at] = best
            grid = grid[np.arange(w) != (at + 1)[:, None]].reshape(len(row), w - 1)
            rank = rank[np.arange(w - 1) != at[:, None]].reshape(len(row), w - 2)
            left, right = each[at > 0], each[at < w - 2]
            rank[left, at[left] - 1] = self.merged(grid[left, at[left] - 1], grid[left, at[left]])
            rank[right, at[right]] = self.merged(grid[right, at[right]], grid[right, at[right] + 1])
        return out

    def _by_heap(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a linked list of parts and a heap of (rank, place)."""
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or self.rank.get(piece[i : end[end[i]]]) != r:
                continue
            gone = end[i]
            alive[gone], end[i] = False, end[gone]
            if end[i] < n:
                before[end[i]] = i
                if (x := self.rank.get(piece[i : end[end[i]]])) is not None:
                    heapq.heappush(heap, (x, i))
            if (p := before[i]) >= 0 and (x := self.rank.get(piece[p : end[i]])) is not None:
                heapq.heappush(heap, (x, p))
        return [self.rank[piece[i : end[i]]] for i in range(n) if alive[i]]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for."""
        size = self.size[ids]
        total = np.cumsum(size) - size
        return self.bytes[np.repeat(self.place[ids] - total, size) + np.arange(int(size.sum()))]


def from_tiktoken(path: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def from_tokenizers(path: str) -> dict[bytes, int]:
    """The ranks of a byte-level BPE in the tokenizers library's format, whose ids must follow the order of its merges."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    plain = {token: id for token, id in model["vocab"].items() if all(c in byte for c in token)}
    made = [plain["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError(f"{path}: ids do not follow the order of the merges")
    known = {i for i in made} | {plain[c] for c in byte}
    return {bytes(byte[c] for c in token): id for token, id in plain.items() if id in known}


def added_tokens(path: str) -> dict[str, int]:
    """The literals that a file in the tokenizers library's format maps to one id each, special or not."""
    held = json.loads(Path(path).read_text(encoding="utf-8")).get("added_tokens") or []
    for token in held:
        if any(token.get(k) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added token {token['content']!r} depends on what stands around it")
    return {token["content"]: token["id"] for token in held if token["content"]}


@cache
def ranks(path: str) -> Ranks:
    return Ranks(from_tokenizers(path), added_tokens(path)) if path.endswith(".json") else Ranks(from_tiktoken(path))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(ranks(path).encode_pieces, added=ranks(path).added)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, ids, n_tokens), with ``decode`` also decoded: the ids of each whole text and the bytes they decode to.

    ids holds little-endian unsigned 32-bit numbers. path: ranks in tiktoken's format, or a .json of the tokenizers library; every executor reads it.
    Each match of the public pattern is encoded separately; no special tokens are put in. The added tokens of a .json are
    cut out first, one id each, as that library does; ranks in tiktoken's format have none. Null and empty texts have no ids
    (ids is empty, never null); repeated rows come out as often as they come in; other columns are not looked at.
    An empty table gives an empty one; a very long text is encoded whole, alone in its step.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids binary, n_tokens bigint" + ", decoded binary" * decode

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, table = encoder(path), ranks(path)
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            _, starts = utf8(text)
            for i, j in spans_of(starts):
                ids, at = run([t or "" for t in text.slice(i, j - i).to_pylist()])
                raw = ids.astype("<u4").tobytes()
                out = [key.slice(i, j - i), pa.array([raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()), pa.array(np.diff(at), pa.int64())]
                if decode:
                    size = np.concatenate([[0], np.cumsum(table.size[ids])])[at].tolist()
                    flat = table.decode(ids).tobytes()
                    out.append(pa.array([flat[a:b] for a, b in zip(size[:-1], size[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, [id_col, "ids", "n_tokens", "decoded"][: len(out)])

    return df.select(id_col, text_col).mapInArrow(work, schema)
