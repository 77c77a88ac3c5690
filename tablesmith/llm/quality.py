"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, utf8, with_text
from .pretokens import range_hashes, word_ranges

#: Bounds of the sample that the model is fitted on: labelled documents, and lines of one of them (longer ones are left out of the sample, never out of scoring).
SAMPLE_DOCS, SAMPLE_LINES = 2000, 100
BLANKS = b" \t\n\r\x0b\x0c"
GROUPS = (range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100), range(0x30, 0x3A), BLANKS, b".,;:'-()\"?", b"!", b"|", b"#$%&*@^~<>{}[]\\/_=+`")


def lines(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of every line; an empty text has one empty line."""
    breaks = np.flatnonzero(flat == 0x0A) + 1
    owner = np.searchsorted(starts, breaks - 1, side="right") - 1
    begin = np.concatenate([starts[:-1], breaks])
    text = np.concatenate([np.arange(len(starts) - 1), owner])
    order = np.lexsort((begin, text))
    begin, text = begin[order], text[order]
    last = np.append(text[1:] != text[:-1], True)
    end = np.where(last, starts[text + 1], np.append(begin[1:], 0) - 1)
    return begin, end, text


def features(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features with those of both neighbouring lines, bytes, text) of every line."""
    begin, end, text = lines(flat, starts)
    size = np.maximum(end - begin, 1).astype(np.float32)

    def counted(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return (total[end] - total[begin]).astype(np.float32)

    kind = np.zeros(256, np.uint8)
    for k, group in enumerate(GROUPS, 1):
        kind[list(group)] = k
    kind = kind[flat]
    upper, lower, high, digit, blank, mark, shout, bar, sign = (counted(kind == k) for k in range(1, len(GROUPS) + 1))
    spaces = kind == GROUPS.index(BLANKS) + 1
    # words, and words that repeat the one before them in the line
    first, past, owner = word_ranges(spaces, starts)
    word = range_hashes(flat, first, past) if len(first) else np.zeros(0, np.uint64)
    begins = np.zeros(len(flat), np.int32)
    begins[first] = 1
    again = np.zeros(len(flat), np.int32)
    if len(first) > 1:
        near = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        again[first[1:][near]] = 1
    words = np.maximum(counted(begins), 1)
    whole = range_hashes(flat, begin, end) if len(flat) else np.zeros(len(begin), np.uint64)
    same = np.zeros(len(begin), np.float32)
    order = np.lexsort((whole, text))
    twin = (text[order][1:] == text[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    same[order[1:][twin]] = 1
    same[order[:-1][twin]] = 1
    letters = np.maximum(upper + lower + high, 1)
    own = np.stack([upper / letters, high / size, digit / size, blank / size, mark / words, shout / words, bar / words, sign / words, counted(again) / words, same, np.log1p(size) / 5, np.minimum(letters / words, 20) / 10, (end == begin)], axis=1).astype(np.float32)
    own = np.concatenate([own, np.ones((len(own), 1), np.float32)], axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = text[1:] == text[:-1]
    before[1:][joined], after[:-1][joined] = own[:-1][joined], own[1:][joined]
    return np.concatenate([own, before, after], axis=1), size, text


def grid(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts sorted by falling number of lines, number of lines of each) for lines given by their text."""
    count = np.bincount(text)
    return np.argsort(-count, kind="stable"), count


def marginals(unary: np.ndarray, step: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginal of each line's two states, expected transitions by pair of states, log normalizer) by scaled forward-backward over all texts at once."""
    order, count = grid(text)
    count = count[order]
    place = np.cumsum(np.bincount(text)) - np.bincount(text)
    place = place[order]
    most = int(count[0])
    potential = np.exp(unary - unary.max(axis=1, keepdims=True))
    log = float(unary.max(axis=1).sum())
    jump = np.exp(step)
    active = np.searchsorted(-count, -np.arange(1, most + 1), side="right")
    forward = np.zeros_like(potential)
    state = np.ones((len(order), 2)) / 1.0
    for t in range(most):
        n = active[t]
        at = place[:n] + t
        state = (state[:n] @ jump if t else state[:n]) * potential[at]
        scale = state.sum(axis=1, keepdims=True)
        log += float(np.log(scale).sum())
        state = state / scale
        forward[at] = state
    out, pairs = np.zeros_like(potential), np.zeros((2, 2))
    back = np.ones((len(order), 2))
    for t in range(most - 1, -1, -1):
        n = active[t]
        at = place[:n] + t
        if t + 1 < most:
            m = active[t + 1]
            ahead = potential[at[:m] + 1] * back[:m]
            joint = forward[at[:m]][:, :, None] * jump[None] * ahead[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            ahead = ahead @ jump.T
            back[:m] = ahead / ahead.sum(axis=1, keepdims=True)
        both = forward[at] * back[:n]
        out[at] = both / both.sum(axis=1, keepdims=True)
    return out, pairs, log


@dataclass
class QualityModel:
    """State 1 is good. ``prior`` is the score of all texts when there was nothing, or only one label, to learn from."""

    weights: np.ndarray | None
    steps: np.ndarray | None
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def raw(self, x: np.ndarray, size: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The share of each text's bytes that stand in good lines, by the marginals."""
        good = marginals(np.stack([np.zeros(len(x)), x @ self.weights], axis=1), self.steps, text)[0][:, 1]
        return np.bincount(text, good * size) / np.bincount(text, size)

    def scores(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(starts) - 1, self.prior)
        share = np.clip(self.raw(*features(flat, starts)), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(share / (1 - share)) + self.shift)))


def train(x: np.ndarray, size: np.ndarray, text: np.ndarray, good: np.ndarray, rounds: int = 200, rate: float = 0.3, ridge: float = 1e-5) -> QualityModel:
    """Maximum likelihood by Adam over all sampled texts; a line is labelled as its document is. Then a logistic curve over document shares calibrates the score."""
    y = good[text].astype(float)
    weights, steps = np.zeros(x.shape[1]), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    joined = text[1:] == text[:-1]
    np.add.at(seen, (y[:-1][joined].astype(int), y[1:][joined].astype(int)), 1)
    first = second = np.zeros(len(weights) + 4)
    for t in range(1, rounds + 1):
        p, pairs, _ = marginals(np.stack([np.zeros(len(x)), x @ weights.astype(x.dtype)], axis=1), steps, text)
        slope = np.concatenate([x.T @ (p[:, 1] - y).astype(x.dtype), (pairs - seen).ravel()]) / len(x) + ridge * np.concatenate([weights, steps.ravel()])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        weights, steps = weights - move[:-4], steps - move[-4:].reshape(2, 2)
    model = QualityModel(weights, steps)
    share = np.clip(model.raw(x, size, text), 1e-6, 1 - 1e-6)
    z, a, b = np.log(share / (1 - share)), 1.0, 0.0
    for _ in range(300):
        e = 1 / (1 + np.exp(-(a * z + b))) - good
        a, b = a - 0.05 * ((e * z).mean() + 0.01 * (a - 1)), b - 0.05 * (e.mean() + 0.01 * b)
    model.slope, model.shift = max(a, 0.1), b
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> QualityModel:
    """Learns from at most ``sample_docs`` labels, those of least hashed id, and their documents of at most ``sample_lines`` lines, which bounds what the driver holds.

    Labels other than 0 and 1, null labels and ids without a document are left out. With no label, or only one, the
    model gives every text the smoothed share of good ones.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).cast("int").alias("__good"))
    known = F.broadcast(sampled(known, id_col, sample_docs))  # bounded, so texts need no shuffle
    breaks = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    some = docs.join(known, id_col).where(F.coalesce(breaks, F.lit(0)) < sample_lines).select("__good", text_col)

    def work(text: pa.Array) -> list[pa.Array]:
        x, size, owner = features(*utf8(text))
        at = np.searchsorted(owner, np.arange(len(text) + 1))
        return [pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([size[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())]

    rows = with_text(some, [pa.field("__x", pa.binary()), pa.field("__size", pa.binary())], work, text_col, ["__good"]).collect()
    rows = sorted(rows, key=lambda r: (r[1], r[0]))  # tasks may return them in any order
    good = np.array([r[0] for r in rows], float)
    if len(set(good)) < 2:
        return QualityModel(None, None, prior=float((good.sum() + 1) / (len(good) + 2)))
    size = [np.frombuffer(r[2], np.float32) for r in rows]
    text = np.repeat(np.arange(len(rows)), [len(s) for s in size])
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(len(text), -1)
    size = np.concatenate(size)
    del rows
    return train(x, size, text, good)


def score(df: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Adds score (0 to 1, higher is better) and predicted (1 from 0.5 on) for every row's whole text. Null and empty texts count as one empty line; repeated rows are scored each, an empty table gives an empty one, a very long text is scored whole, alone in its step; columns of these names, ``prefix`` before them, are replaced."""

    def work(text: pa.Array) -> list[pa.Array]:
        found = model.scores(*utf8(text))
        return [pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32), pa.int32())]

    return with_text(df, [pa.field(f"{prefix}score", pa.float64()), pa.field(f"{prefix}predicted", pa.int32())], work, text_col, keep)
