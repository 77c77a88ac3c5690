"""Personal data in text: four fixed forms, and what a character-level bidirectional LSTM with CRF transitions adds.

Every span of the four kinds holds a digit or an at sign: its rule asks for digits, or for the sign. What lies further
than REACH from any such character can be part of no span, so the network reads the stretches of text around them, in
windows that overlap by half. The windows' emissions are summed with more weight near a window's middle, and one pass of
the CRF's decoder over each whole stretch reconciles them: no window decides alone, and no span ends where a window does.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, utf8, with_text

KINDS = ("email", "ip", "card", "phone")
# The base forms. A digit run is tried from its beginning only, which finds the same matches in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")

#: Bounds of the training sample: documents, and characters of one of them (longer ones are left out of the sample, never out of the search).
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
WINDOW, REACH = 64, 24
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
EMBED, HIDDEN = 12, 24


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign: back over the local part, no further than the last match, and on over the domain."""
    past, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > past and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            past = domain.end()
            yield begin, past
        at = text.find("@", at + 1)


def plausible(kind: str, found: str) -> bool:
    digits = DIGIT.findall(found)
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in re.findall(r"[0-9]+", found)]
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn("".join(digits))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return "@" in found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    for kind, form in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, m.start(), m.end()) for m in form.finditer(text) if plausible(kind, m.group())]
    return out


def codes(points: np.ndarray) -> np.ndarray:
    """Character classes: printable ASCII each for itself, line breaks and tabs, other letters, all else. 0 is padding."""
    table = np.full(0x300, 97, np.int64)
    table[:0x20] = 96
    table[0x20:0x7F] = np.arange(1, 96)
    return np.where(points < 0x300, table[np.minimum(points, 0x2FF)], 98)


CODES = 99


@dataclass
class Tagger:
    """The network. Its arrays are small (some ten thousand numbers) at any corpus size."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 0) -> Tagger:
        rng = np.random.default_rng(seed)

        def some(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        p = {"embed": some(CODES, EMBED) * 3, "out": some(2 * HIDDEN, TAGS), "out_bias": np.zeros(TAGS, np.float32), "steps": np.zeros((TAGS, TAGS), np.float32)}
        for way in ("f", "b"):
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            p |= {f"{way}x": some(EMBED, 4 * HIDDEN), f"{way}h": some(HIDDEN, 4 * HIDDEN), f"{way}bias": bias}
        return Tagger(p)

    def _run(self, way: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states of one direction over x [batch, time, EMBED], in reading order, and what the backward pass needs."""
        p, n = self.p, HIDDEN
        h = c = np.zeros((len(x), n), np.float32)
        ahead = x @ p[way + "x"] + p[way + "bias"]
        out, kept = np.empty((*x.shape[:2], n), np.float32), []
        for t in range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1):
            z = ahead[:, t] + h @ p[way + "h"]
            gate = 1 / (1 + np.exp(-z[:, : 3 * n]))
            g = np.tanh(z[:, 3 * n :])
            before, c = (h, c), gate[:, n : 2 * n] * c + gate[:, :n] * g
            u = np.tanh(c)
            h = gate[:, 2 * n :] * u
            out[:, t] = h
            kept.append((t, *before, gate, g, u))
        return out, kept

    def _back(self, way: str, x: np.ndarray, kept: list, d_out: np.ndarray, grad: dict[str, np.ndarray]) -> np.ndarray:
        p, n = self.p, HIDDEN
        dh = dc = np.zeros((len(x), n), np.float32)
        dz_all = np.empty((*x.shape[:2], 4 * n), np.float32)
        grad[way + "h"] = np.zeros_like(p[way + "h"])
        for t, h0, c0, gate, g, u in reversed(kept):
            dh = dh + d_out[:, t]
            i, f, o = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :]
            dc = dc + dh * o * (1 - u**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * u * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dz_all[:, t] = dz
            grad[way + "h"] += h0.T @ dz
            dh, dc = dz @ p[way + "h"].T, dc * f
        grad[way + "x"] = np.tensordot(x, dz_all, ([0, 1], [0, 1]))
        grad[way + "bias"] = dz_all.sum(axis=(0, 1))
        return dz_all @ p[way + "x"].T

    def emissions(self, code: np.ndarray) -> np.ndarray:
        x = self.p["embed"][code]
        return np.concatenate([self._run("f", x)[0], self._run("b", x)[0]], axis=2) @ self.p["out"] + self.p["out_bias"]

    def gradient(self, code: np.ndarray, tag: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag paths, and its gradient."""
        p, (many, length) = self.p, code.shape
        x = p["embed"][code]
        (hf, kf), (hb, kb) = self._run("f", x), self._run("b", x)
        h = np.concatenate([hf, hb], axis=2)
        e = h @ p["out"] + p["out_bias"]
        forward, backward = np.empty_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, length):
            forward[:, t] = e[:, t] + log_sum(forward[:, t - 1][:, :, None] + p["steps"], 1)
        for t in range(length - 2, -1, -1):
            backward[:, t] = log_sum(p["steps"] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        norm = log_sum(forward[:, -1], 1)
        d_e = np.exp(forward + backward - norm[:, None, None])
        pair = np.exp(forward[:, :-1, :, None] + p["steps"] + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - norm[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(pair, (tag[:, :-1].ravel(), tag[:, 1:].ravel()), 1)
        rows, at = np.arange(many)[:, None], np.arange(length)
        gold = e[rows, at, tag].sum(axis=1) + p["steps"][tag[:, :-1], tag[:, 1:]].sum(axis=1)
        d_e[rows, at, tag] -= 1
        d_e /= many
        grad = {"steps": pair / many, "out": np.tensordot(h, d_e, ([0, 1], [0, 1])), "out_bias": d_e.sum(axis=(0, 1))}
        d_h = d_e @ p["out"].T
        d_x = self._back("f", x, kf, d_h[:, :, :HIDDEN], grad) + self._back("b", x, kb, d_h[:, :, HIDDEN:], grad)
        grad["embed"] = np.zeros_like(p["embed"])
        np.add.at(grad["embed"], code.ravel(), d_x.reshape(-1, EMBED))
        return float((norm - gold).mean()), grad

    def best_paths(self, e: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The best tag path of each row of emissions, up to the row's length; what follows is 0."""
        steps = self.p["steps"]
        score, came = e[:, 0], np.zeros(e.shape, np.int8)
        for t in range(1, e.shape[1]):
            both = score[:, :, None] + steps
            came[:, t] = both.argmax(axis=1)
            # past its end a row keeps its score, so that its last tag is the one chosen at its end
            score = np.where((t < length)[:, None], both.max(axis=1) + e[:, t], score)
        path, rows = np.zeros(e.shape[:2], np.int64), np.arange(len(e))
        tag = score.argmax(axis=1)
        for t in range(e.shape[1] - 1, -1, -1):
            live = t < length
            path[live, t] = tag[live]
            tag = np.where(live, came[rows, t, tag], tag)
        return path


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def stretches(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of what lies within REACH of a digit or an at sign."""
    anchor = np.flatnonzero((points >= 0x30) & (points <= 0x39) | (points == 0x40))
    if not len(anchor):
        return (np.zeros(0, np.int64),) * 2
    cut = np.flatnonzero(np.diff(anchor) > 2 * REACH)
    begin = np.maximum(anchor[np.concatenate([[0], cut + 1])] - REACH, 0)
    return begin, np.minimum(anchor[np.concatenate([cut, [len(anchor) - 1]])] + REACH + 1, len(points))


def windows(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stretch) of the windows of WINDOW characters, half a window apart, that cover each stretch."""
    begin, end = stretches(points)
    half = WINDOW // 2
    count = np.maximum(1, -(-(end - begin - WINDOW) // half) + 1)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(begin, count) + k * half, np.repeat(np.arange(len(begin)), count)


def read_windows(points: np.ndarray, start: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < len(points), codes(points[np.minimum(at, len(points) - 1)]), 0)


def tagged(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a tag sequence: a begin tag or a change of kind starts one."""
    kind = np.where(tags > 0, (tags + 1) // 2, 0)
    begins = (kind > 0) & ((tags % 2 == 1) | (np.concatenate([[0], kind[:-1]]) != kind))
    ends = (kind > 0) & np.concatenate([(kind[1:] != kind[:-1]) | begins[1:], [True]])
    return [(KINDS[kind[b] - 1], int(b), int(e) + 1) for b, e in zip(np.flatnonzero(begins), np.flatnonzero(ends), strict=True)]


def invented(rng: random.Random, kind: str) -> str:
    """Personal data in forms that people write, those of the base patterns and others."""
    def number(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    if kind == "email":
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
        return f"{word}{rng.choice(['', '.x', '_', '-', '+a'])}{rng.choice(['', number(2)])}@{word[::-1]}{rng.choice(['', number(1)])}.{rng.choice(['com', 'org', 'net', 'example.com', 'co.uk', 'de'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = number(rng.choice([15, 15, 14, 12]))
        full = next(body + c for c in "0123456789" if luhn(body + c))
        gap = rng.choice(["", "", " ", "-", "."])
        return gap.join(full[i : i + 4] for i in range(0, len(full), 4))
    return rng.choice(["+1 ({a}) {b}-{c}", "+{d} {a} {b} {c}", "({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "+{d}{a}{b}{c}", "+{d}-{a}-{b}-{c}", "00{d} {a} {b}{c}", "{a} {b} {c}"]).format(a=number(3), b=number(3), c=number(4), d=rng.randint(1, 99))


def harmless(rng: random.Random) -> str:
    """Digits and at signs that are nobody's data."""
    def text(n: int, of: str) -> str:
        return "".join(rng.choice(of) for _ in range(n))

    return rng.choice([
        lambda: f"{rng.randint(0, 12)}.{rng.randint(0, 20)}", lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", lambda: str(rng.randint(0, 99999)), lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 31):02}", lambda: f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1900, 2099)}", lambda: f"{rng.randint(0, 23)}:{rng.randint(0, 59):02}",
        lambda: f"${rng.randint(1, 999)}.{rng.randint(0, 99):02}", lambda: text(rng.choice([8, 18, 32, 40]), "0123456789abcdef"), lambda: "AKIA" + text(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), lambda: f"v{rng.randint(0, 9)}", lambda: f"@{text(6, 'abcdefghijklmnop')}", lambda: f"{rng.randint(1, 999)},{rng.randint(0, 999):03}", lambda: text(rng.randint(20, 30), "0123456789"), lambda: f"{rng.randint(1, 100)}%", lambda: f"ISBN 978-{text(10, '0123456789')}",
        lambda: f"{rng.randint(1, 200)} {rng.randint(1, 200)} {rng.randint(1, 200)} {rng.randint(1, 200)}",
    ])()


def examples(texts: list[str], many: int = 3000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(codes, tags) of training windows: those of the sampled texts with the base spans as labels, and passages of these texts with invented spans or harmless ones set in."""
    rng = random.Random(seed)
    code, tag = [], []

    def add(text: str, spans: list[tuple[str, int, int]]) -> None:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        tags = np.zeros(len(points) + WINDOW, np.int64)
        for kind, a, b in spans:
            tags[a:b] = 2 + 2 * KINDS.index(kind)
            tags[a] -= 1
        start = windows(points)[0]
        if len(start):
            start = start[rng.sample(range(len(start)), min(4, len(start)))]
            code.append(read_windows(points, start))
            tag.append(tags[start[:, None] + np.arange(WINDOW)])

    prose = [t for t in texts if len(t) > 40] or ["The quick brown fox went to the market, and then it came home. " * 2]
    for t in texts[: many // 4]:
        spans: list[tuple[str, int, int]] = []
        for s in base_spans(t):  # kinds may overlap; the first as listed labels the place
            if all(s[2] <= a or b <= s[1] for _, a, b in spans):
                spans.append(s)
        add(t, spans)
    for _ in range(many):
        out, spans = "", []
        for _ in range(rng.randint(1, 3)):
            t = rng.choice(prose)
            at = rng.randrange(len(t))
            out += re.sub(r"[0-9@+]", "a", t[at : at + rng.randint(3, 40)]) + rng.choice([" ", " ", " ", "\n", ": ", ", ", " (", '"'])
            if rng.random() < 0.55:
                kind = rng.choice(KINDS)
                new = invented(rng, kind)
                spans.append((kind, len(out), len(out) + len(new)))
            else:
                new = harmless(rng)
            out += new + rng.choice([" ", " ", ".", ",", ")", "\n"])
        add(out, spans)
    return np.concatenate(code), np.concatenate(tag)


def train(code: np.ndarray, tag: np.ndarray, epochs: int = 4, batch: int = 48, rate: float = 0.01, seed: int = 0) -> Tagger:
    """Adam over shuffled batches with a falling rate."""
    rng, net = np.random.default_rng(seed), Tagger.fresh(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    t, total = 0, epochs * -(-len(code) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(code))
        for at in range(0, len(order), batch):
            t += 1
            some = order[at : at + batch]
            grad = net.gradient(code[some], tag[some])[1]
            size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1, 5 / max(size, 1e-9))
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g**2
                net.p[k] = (net.p[k] - rate * (1 - t / (total + 1)) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> Tagger:
    """Trains on at most ``sample`` documents with a digit or an at sign and at most SAMPLE_CHARS characters, those of least hashed id; without any, on invented passages alone."""
    some = docs.select(id_col, text_col).where(F.col(text_col).rlike("[0-9@]") & (F.length(text_col) <= SAMPLE_CHARS))
    return train(*examples([r[1] for r in sampled(some, id_col, sample).collect()]))


#: A window's say in the middle and at its edges.
SAY = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1.0).astype(np.float32)


def summed(e: np.ndarray, start: np.ndarray, stretch: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The emissions of every character of all stretches, one after the other: the weighted mean over its windows."""
    first = np.concatenate([[0], np.cumsum(end - begin)])
    at = (start - begin[stretch])[:, None] + np.arange(WINDOW)
    inside = at < (end - begin)[stretch][:, None]
    place = (first[stretch][:, None] + at)[inside]
    weight = np.broadcast_to(SAY, at.shape)[inside]
    total = np.bincount(place, weight, first[-1])
    return np.stack([np.bincount(place, e[:, :, k][inside] * weight, first[-1]) for k in range(TAGS)], axis=1) / total[:, None]


def network_spans(net: Tagger, texts: list[str], most: int = 2048, long: int = 1 << 18) -> list[list[tuple[str, int, int]]]:
    """The network's spans in each text: emissions of ``most`` windows at a time, decoded by stretch."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    codes_, starts, of, begins, ends, owner = [], [], [], [], [], []
    for i, text in enumerate(texts):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin, end = stretches(points)
        if len(begin):
            start, stretch = windows(points)
            codes_.append(read_windows(points, start))
            starts.append(start)
            of.append(stretch + len(owner))
            begins.append(begin)
            ends.append(end)
            owner += [i] * len(begin)
    if not owner:
        return out
    code = np.concatenate(codes_)
    e = np.concatenate([net.emissions(code[k : k + most]) for k in range(0, len(code), most)])
    begin, end = np.concatenate(begins), np.concatenate(ends)
    rows = summed(e, np.concatenate(starts), np.concatenate(of), begin, end).astype(np.float32)
    length = end - begin
    first = np.concatenate([[0], np.cumsum(length)])
    order = np.argsort(length, kind="stable")
    a = 0
    while a < len(order):  # stretches of like length are decoded together
        b = a + 1
        while b < len(order) and (b - a + 1) * length[order[b]] <= long and b - a < most:
            b += 1
        some = order[a:b]
        wide = int(length[some].max())
        at = first[some][:, None] + np.minimum(np.arange(wide), (length[some] - 1)[:, None])
        for k, tags in zip(some.tolist(), net.best_paths(rows[at], length[some]), strict=True):
            out[owner[k]] += [(kind, int(begin[k]) + x, int(begin[k]) + y) for kind, x, y in tagged(tags[: length[k]])]
        a = b
    return [sorted(x, key=lambda s: s[1]) for x in out]


def all_spans(net: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans), each by kind, then start: the network adds plausible spans that touch no base span and cut no run of digits."""
    out = []
    for text, more in zip(texts, network_spans(net, texts), strict=True):
        base = base_spans(text)
        new = []
        for kind, a, b in more:
            while b > a and text[b - 1] in " .,-(\n":
                b -= 1
            while a < b and text[a] in " .,-)\n":
                a += 1
            whole = not (text[a - 1 : a].isdigit() and text[a].isdigit() or text[b - 1].isdigit() and text[b : b + 1].isdigit()) if a < b else False
            if whole and plausible(kind, text[a:b]) and all(b <= x or y <= a for _, x, y in base):
                new.append((kind, a, b))
        out.append((base, sorted(base + new, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch that spans cover replaced by [KIND] of the span that begins it."""
    out, past = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= past:
            out += [text[past:a], f"[{kind.upper()}]"]
        past = max(past, b)
    return "".join([*out, text[past:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(df: DataFrame, net: Tagger, text_col: str = "text", keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """Adds base and spans, arrays of (kind, start, end) by kind, then start, for every row's whole text; with ``redact`` also redacted, the text with its spans masked.

    Places count code points, ends are exclusive. Null texts are empty (redacted stays null). Columns of these names are
    replaced, all others stay; repeated rows are read each, an empty table gives an empty one. A text is held whole by
    its task, with some 2000 bytes for each character that the network reads.
    """

    def work(column: pa.Array) -> list[pa.Array]:
        flat, starts = utf8(column)
        anchor = np.concatenate([[0], np.cumsum((flat >= 0x30) & (flat <= 0x39) | (flat == 0x40))])
        some = np.flatnonzero(anchor[starts[1:]] > anchor[starts[:-1]])
        texts = [column[i].as_py() for i in some.tolist()]
        base, spans = [[] for _ in range(len(column))], [[] for _ in range(len(column))]
        for i, (b, s) in zip(some.tolist(), all_spans(net, texts), strict=True):
            base[i], spans[i] = b, s
        as_rows = lambda found: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in found], SPANS)
        out = [as_rows(base), as_rows(spans)]
        if redact:
            whole = column.to_pylist()
            for i, t in zip(some.tolist(), texts, strict=True):
                whole[i] = redacted(t, spans[i])
            out.append(pa.array(whole, pa.string()))
        return out

    return with_text(df, [pa.field("base", SPANS), pa.field("spans", SPANS)] + [pa.field("redacted", pa.string())] * redact, work, text_col, keep)
