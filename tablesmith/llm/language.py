"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import utf8, with_text

#: Bound of the sample that the model is fitted on: documents of each language, those of least hashed id.
SAMPLE_PER_LANG = 300
#: Default bound of the languages that a model tells apart, the most frequent ones, and of the rows of all of them that the driver holds (16 KB each): with more than 40 languages each teaches with fewer.
MOST_LANGS, SAMPLE_ROWS = 200, 12_000
BITS, DIM = 13, 16
#: Calibrated chance of being right that a text must reach, unless right answers held back from training had less.
SURE = 0.6
LETTER = regex.compile(r"\p{L}")


def plain_bytes() -> np.ndarray:
    """ASCII letters in lower case, bytes of other characters as they are, all else a blank."""
    out = np.full(256, 0x20, np.uint8)
    out[0x80:] = np.arange(0x80, 0x100)
    for c in range(0x61, 0x7B):
        out[c] = out[c - 0x20] = c
    return out


def subwords(flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of the subword at each byte, where each text begins) for 3 and for 4 bytes, with blanks around every text. Bucket 2**BITS stands for none."""
    v = np.insert(plain_bytes()[flat], np.concatenate([starts[:-1], starts[1:]]), 0x20).astype(np.uint32) if len(flat) else np.full(2 * (len(starts) - 1), 0x20, np.uint32)
    begin = starts[:-1] + 2 * np.arange(len(starts) - 1)
    text = np.zeros(len(v), bool)
    text[begin[1:]] = True
    longer = np.concatenate([v, np.full(3, 0x20, np.uint32)])
    ahead = [longer[k : k + len(v)] for k in range(4)]
    blank = (ahead[0] == 0x20) & (ahead[1] == 0x20) | (ahead[1] == 0x20) & (ahead[2] == 0x20)
    out = np.zeros(len(v) + 4, bool)
    out[:-4] = text
    for n, odd in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        key = ahead[0] | ahead[1] << np.uint32(8) | ahead[2] << np.uint32(16)
        if n == 4:
            key = key | ahead[3] << np.uint32(24)
        none = blank.copy()
        for k in range(1, n):  # it would reach into the next text
            none |= out[k : k + len(v)]
        none[max(0, len(v) - n + 1) :] = True
        bucket = (((key ^ (key >> np.uint32(15))) * np.uint32(odd)) >> np.uint32(32 - BITS)).astype(np.int32)
        bucket[none] = 1 << BITS
        yield bucket, begin


def counts(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each text has each bucket."""
    out = np.zeros((len(starts) - 1, (1 << BITS) + 1), np.float32)
    for bucket, begin in subwords(flat, starts):
        edge = np.append(begin, len(bucket))
        for i in range(len(out)):
            out[i] += np.bincount(bucket[edge[i] : edge[i + 1]], minlength=out.shape[1])
    return out[:, :-1]


@dataclass
class LanguageModel:
    """``table`` holds each bucket's share of the logits (embedding times softmax weights) and 1 for counting. Texts whose best probability is below ``least`` are rejected."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    least: float

    def probabilities(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        total = 0
        for bucket, begin in subwords(flat, starts):
            total = total + np.add.reduceat(self.table[bucket], begin, axis=0)
        z = total[:, :-1] / np.maximum(total[:, -1:], 1) + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 12, rate: float = 2.0, seed: int = 0) -> LanguageModel:
    """Stochastic gradient descent over embeddings and softmax; a fifth of the sample sets the temperature and the rejection threshold."""
    rng = np.random.default_rng(seed)
    many = x.sum(axis=1, keepdims=True)
    x /= np.maximum(many, 1)
    test = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    embed, out, bias = rng.normal(0, 0.1, (x.shape[1], DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    rows = np.flatnonzero(~test)
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        for some in np.array_split(rng.permutation(rows), max(1, len(rows) // 32)):
            # embeddings of rare subwords move little in an average over a text, hence their faster pace
            hidden = x[some] @ embed
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = p @ out.T
            out -= pace * hidden.T @ p
            bias -= 0.1 * pace * p.sum(axis=0)
            embed -= 50 * pace * (x[some].T @ back)
    check = np.flatnonzero(test) if test.any() else rows
    z = x[check] @ embed @ out + bias

    def loss(t: float) -> float:
        p = z * t
        p = p - np.log(np.exp(p - p.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - p.max(axis=1, keepdims=True)
        return -float(p[np.arange(len(check)), y[check]].mean())

    heat = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0), key=loss)
    p = np.exp(heat * (z - z.max(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    right = p.argmax(axis=1) == y[check]
    # no right answer of those held back falls below it, whatever SURE asks for
    least = min(SURE, float(p[right].max(axis=1).min())) if right.any() else 0.0
    table = np.concatenate([embed @ out * heat, np.ones((len(embed), 1))], axis=1)
    return LanguageModel(langs, np.concatenate([table, np.zeros((1, table.shape[1]))]).astype(np.float32), bias * heat, least)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG, most_langs: int = MOST_LANGS, sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Learns from at most ``per_lang`` documents of each of the ``most_langs`` most frequent languages, and about ``sample_rows`` in all.

    Texts in any other language are judged, but as one of those learned or as rejected: raise ``most_langs`` for more. Rows
    without a language or a letter teach nothing; without any row, as in an empty table, there is no model (None). Repeated
    rows teach each; a very long text is counted whole by its task.
    """
    known = docs.where(F.col(lang_col).isNotNull())
    # before anything is ranked, hashes alone let go of all but about twice the bound of each language
    order, cut = F.xxhash64(id_col), F.lit(False)
    spoken = known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most_langs).collect()
    per_lang = max(1, min(per_lang, sample_rows // max(1, len(spoken))))
    for row in spoken:
        share = (2 * per_lang + 200) / row["count"]
        cut = cut | (F.col(lang_col) == row[0]) & (F.lit(True) if share >= 1 else order < int(-(2**63) + 2**64 * share))
    known = known.where(cut).where(F.col(text_col).rlike(r"\p{L}"))
    few = known.select(lang_col, text_col, F.row_number().over(W.partitionBy(lang_col).orderBy(F.xxhash64(id_col))).alias("__rank")).where(F.col("__rank") <= per_lang)

    def work(text: pa.Array) -> list[pa.Array]:
        return [pa.array([row.astype(np.uint16).tobytes() for row in np.minimum(counts(*utf8(text)), 65535)], pa.binary())]

    rows = with_text(few.select(F.col(lang_col).alias("__lang"), text_col, "__rank"), [pa.field("__x", pa.binary())], work, text_col, ["__lang", "__rank"]).collect()
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    langs = sorted({r[0] for r in rows})
    y = np.array([langs.index(r[0]) for r in rows])
    x = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(len(rows), -1).astype(np.float32)
    del rows
    return train(x, y, langs)


def identify(df: DataFrame, model: LanguageModel | None, text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Adds lang_pred, score and rejected for every row's whole text.

    A text that is null or has no letter is ``und`` with score 0; so is every text without a model. Ties go to the
    language that sorts first. Repeated rows are judged each, an empty table gives an empty one, a very long text is
    read whole, alone in its step. Columns of these names, ``prefix`` before them, are replaced.
    """

    def work(text: pa.Array) -> list[pa.Array]:
        flat, starts = utf8(text)
        ascii_letter = np.zeros(256, bool)
        ascii_letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        total = np.concatenate([[0], np.cumsum(ascii_letter[flat])])
        letter = total[starts[1:]] > total[starts[:-1]]
        for i in np.flatnonzero(~letter).tolist():
            letter[i] = bool(LETTER.search(text[i].as_py() or ""))
        if model is None or not len(text):
            return [pa.array(["und"] * len(text), pa.string()), pa.array(np.zeros(len(text))), pa.array(np.ones(len(text), bool))]
        p = model.probabilities(flat, starts)
        best, score = p.argmax(axis=1), np.where(letter, p.max(axis=1), 0.0)
        lang = pc.if_else(pa.array(letter), pa.array(model.langs, pa.string()).take(pa.array(best)), pa.scalar("und"))
        return [lang, pa.array(score, pa.float64()), pa.array(~letter | (score < model.least))]

    return with_text(df, [pa.field(f"{prefix}lang_pred", pa.string()), pa.field(f"{prefix}score", pa.float64()), pa.field(f"{prefix}rejected", pa.bool_())], work, text_col, keep)
