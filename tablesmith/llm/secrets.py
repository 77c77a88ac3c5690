"""Secrets in text, by DataFrame functions alone: three fixed forms, and candidate strings of high sliding-window entropy."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import free_prefix

# The three base forms.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short cannot hold a longer one, so the least length stands in the pattern; runs are tried from their beginning only.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "entropy")
#: Matches that are placed by one fold.
RUN = 256

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
WINDOW = 20
#: For each character class, the first that the judged runs belong to wholly: bits per character that their best window must reach. A window of 20 has 4.32 at most.
CLASSES = {"hex": (r"[0-9a-f]+|[0-9A-F]+", 2.75), "capitals": (r"(?=.*[0-9])[A-Z0-9]+", 3.3), "letters": (r"(?=.*[A-Z])(?=.*[a-z])[A-Za-z]+", 4.05), "digits": (r"(?=.*[0-9])[A-Za-z0-9+/_=-]+", 3.6), "signs": (r"[A-Za-z+/_=-]+", 4.2)}
#: A candidate is read run by run between these signs. Runs that look like words, identifiers, versions or numbers are
#: allow-listed: digits or letters of one case alone; or words (three letters and more, or a small one between capitals)
#: that make up WORDY of the letters, with at most GROUPS groups of digits in no more than half of the run. Runs of up to SHORT
#: characters count with the others around them. What is left is judged if it fills a window.
BETWEEN, WORDS = r"[+/_=-]+", r"[A-Z][a-z]{2,}|[a-z]{3,}|[A-Z]{3,}(?![a-z])|(?<=[a-z])(?:To|Of|By|In|On|Id|At|Is|As|Or)(?=[A-Z0-9]|$)"
SHORT, WORDY, GROUPS = 4, 0.85, 2
#: Candidates that are never secrets as a whole: UUIDs, numbers and dates.
ALLOW = (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"[0-9+/_=-]*")
#: What shows a placeholder when it stands in the best window itself.
PLACEHOLDER = r"(?i)(example|placeholder|sample|dummy|xxxx|0000|1234567)"
#: Five bits hold a count of up to 31: this many fit in a number.
PACKED = 12


def found(text: Column, pattern: str, possible: Column | None = None) -> Column:
    """All matches in order; none where ``possible`` is false, which saves the search."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return hits if possible is None else F.when(possible, hits).otherwise(F.array().cast("array<string>"))


def placed(text: Column, pattern: str, hits: Column) -> Column:
    """array<struct<start, end, hit>> of the matches, in code points: what stands between them gives the places.

    Folds run over RUN matches at a time, then over the runs, so the work stays near the number of matches.
    """
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(done: Column, pair: Column) -> Column:
        begin = done["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("hit")))).alias("out"))

    def whole(pairs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda k: F.slice(pairs, k * RUN + 1, F.lit(RUN)))
        own = F.transform(runs, lambda run: F.aggregate(run, F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        return let(own, shifted)

    def shifted(own: Column) -> Column:
        before = F.aggregate(own, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, r: F.struct((s["at"] + r["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return F.flatten(F.zip_with(own, before, lambda r, far: F.transform(r["out"], lambda s: F.struct((s["start"] + far).alias("start"), (s["end"] + far).alias("end"), s["hit"].alias("hit")))))

    return F.when(F.size(hits) > 0, let(pairs, whole)).otherwise(none)


def best_window(text: Column, window: int = WINDOW) -> Column:
    """struct<bits, back>: the greatest Shannon entropy, in bits, of any ``window`` characters in a row of ``text`` (over ALPHABET), and minus the place of the first such window's last character.

    One pass with counts that change by one: they lie packed in a few numbers, from which a character that comes adds
    and one that goes takes its unit; the sum of n log n follows from the two counts that changed.
    """
    words = -(-len(ALPHABET) // PACKED)
    weight = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    unit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), (c % PACKED * 5).cast("int"))

    def count(s: Column, c: Column) -> Column:
        held = F.get(F.array(*(s[f"w{k}"] for k in range(words))), F.floor(c / PACKED).cast("int"))
        return F.call_function("shiftright", held, (c % PACKED * 5).cast("int")).bitwiseAND(31).cast("int")

    def step(s: Column, x: Column) -> Column:
        come, gone = x["come"], x["gone"]
        n_out = F.when(gone >= 0, count(s, F.greatest(gone, F.lit(0)))).otherwise(F.lit(0))
        n_in = count(s, come) - F.when(gone == come, 1).otherwise(0)
        total = s["sum"] - weight(n_out) + weight(F.greatest(n_out - 1, F.lit(0))) - weight(n_in) + weight(n_in + 1)
        here = lambda c, k: F.floor(c / PACKED) == k
        packed = [(s[f"w{k}"] + F.when(here(come, k), unit(come)).otherwise(F.lit(0).cast("bigint")) - F.when((gone >= 0) & here(gone, k), unit(F.greatest(gone, F.lit(0)))).otherwise(F.lit(0).cast("bigint"))).alias(f"w{k}") for k in range(words)]
        bits = F.when(x["at"] >= window, math.log2(window) - total / window).otherwise(F.lit(0.0))
        best = F.greatest(s["best"], F.struct(bits.alias("bits"), (-x["at"]).alias("back")))
        return F.struct(*packed, total.alias("sum"), best.alias("best"))

    def scanned(index: Column) -> Column:
        moves = F.transform(index, lambda c, k: F.struct(c.alias("come"), F.when(k >= window, F.get(index, k - window)).otherwise(F.lit(-1)).alias("gone"), (k + 1).alias("at")))
        zero = F.struct(*(F.lit(0).cast("bigint").alias(f"w{k}") for k in range(words)), F.lit(0.0).alias("sum"), F.struct(F.lit(0.0).alias("bits"), F.lit(0).alias("back")).alias("best"))
        return F.aggregate(moves, zero, step, lambda s: s["best"])

    return let(F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), scanned)


def best_entropy(text: Column, window: int = WINDOW) -> Column:
    """The bits of :func:`best_window`."""
    return best_window(text, window)["bits"]


def strange_runs(candidate: Column) -> Column:
    """The candidate's runs that no allow-listed shape takes, one after the other; the short ones too where most of the candidate is strange."""

    def strange(run: Column) -> Column:
        letters = F.length(F.regexp_replace(run, "[0-9]", ""))
        other = F.length(F.regexp_replace(F.regexp_replace(run, WORDS, ""), "[0-9]", ""))
        wordy = (other <= (1 - WORDY) * letters) & (2 * (F.length(run) - letters) <= F.length(run)) & (F.regexp_count(run, F.lit("[0-9]+")) <= GROUPS)
        return (F.length(run) > SHORT) & ~(run.rlike("^([0-9]+|[a-z]+|[A-Z]+)$") | wordy)

    def kept(runs: Column) -> Column:
        odd = F.filter(runs, strange)
        mostly = 2 * F.length(F.array_join(odd, "")) >= F.length(F.array_join(runs, ""))
        return F.array_join(F.when(mostly, F.filter(runs, lambda r: (F.length(r) <= SHORT) | strange(r))).otherwise(odd), "")

    return let(F.split(candidate, BETWEEN, -1), kept)


def secret_like(candidate: Column, window: int = WINDOW) -> Column:
    """Whether the best window of the candidate's strange runs reaches the bits of their character class and holds no placeholder, and no allow pattern is the whole candidate."""
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | candidate.rlike(f"^({pattern})$")

    def judged(rest: Column) -> Column:
        least = F.lit(99.0)
        for pattern, bits in reversed(CLASSES.values()):
            least = F.when(rest.rlike(f"^({pattern})$"), F.lit(bits)).otherwise(least)
        inside = lambda best: F.substring(rest, -best["back"] - window + 1, F.lit(window))
        return F.when(F.length(rest) < window, F.lit(False)).otherwise(let(best_window(rest, window), lambda best: (best["bits"] >= least) & ~inside(best).rlike(PLACEHOLDER)))

    return F.when(allowed, F.lit(False)).otherwise(let(strange_runs(candidate), judged))


def _span(k: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end"), F.lit(KINDS[k]).alias("kind"))


def scan(df: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Adds ``out``: array<struct<start, rank, end, kind>> by start, then kind, for every row's whole text; places count code points, ends are exclusive.

    rank is the kind's place in KINDS. Spans of kind entropy lie within no base span. Null and empty texts have none;
    repeated rows are scanned each; an empty table gives an empty one; all other columns stay, whatever their names,
    one named ``out`` is replaced. Nothing shuffles. A text is one value of its task, with its matches.
    """
    mine = free_prefix(df)
    at = lambda name: F.col(f"`{mine}{name}`")
    text = at("text")
    work = df.withColumn(f"{mine}text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    sign = text.contains(":") | text.contains("=")
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    work = work.withColumns({f"{mine}{k}": found(text, p, possible) for k, (p, possible) in enumerate(zip(patterns, (sign, text.contains("AKIA"), None, None), strict=True))})
    work = work.withColumns({f"{mine}{k}": placed(text, p, at(k)) for k, p in enumerate(patterns)})
    work = work.withColumn(f"{mine}0", F.filter(at(0), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6))
    base = F.concat(*(F.transform(at(k), _span(k)) for k in range(3)))
    work = work.withColumn(f"{mine}base", F.array_sort(base))
    free = F.filter(at(3), lambda s: ~F.exists(at("base"), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    work = work.withColumn(f"{mine}3", F.when(F.size(at(3)) > 0, free).otherwise(at(3)))
    more = F.transform(F.filter(at(3), lambda s: secret_like(s["hit"])), _span(3))
    work = work.withColumn(out, F.when(F.size(at(3)) > 0, F.array_sort(F.concat(at("base"), more))).otherwise(at("base")))
    return work.drop(*(f"{mine}{name}" for name in ("text", "base", 0, 1, 2, 3)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: Column, kind: str) -> Column:
    """How many of the spans are of ``kind``."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
