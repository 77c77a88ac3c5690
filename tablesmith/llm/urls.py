"""URL filtering by host rules and, where none fits, by gradient-boosted trees on lexical features; DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, free_prefix, sampled

#: Bound of the sample that trees are fitted on: labelled URLs, those of least hashed text.
SAMPLE_URLS = 20_000
BINS, DEPTH, ROUNDS, RATE, RIDGE = 16, 3, 12, 0.4, 1.0
#: The chance that labels without any pattern give a model one split; a gain is about chi-squared then.
BY_CHANCE = 0.05
#: URLs of each action that a suffix needs in the sample to have a rate of its own: fewer than SAMPLE_URLS / LEAST suffixes have one.
LEAST = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its action) of the longest rule that fits, null without one. A rule is host and path in one, like ``example.net/en/``; it fits its host and all subdomains when the path begins as the rule's does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(F.length(c) > 0, n - F.length(F.replace(text, c, F.lit("")))).otherwise(0))
    return F.when(n > 0, F.log2(n.cast("double")) - F.aggregate(counts, F.lit(0.0), lambda s, k: s + F.when(k > 1, k * F.log2(k.cast("double"))).otherwise(0.0)) / n).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need no statistics; a null url counts as an empty one."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {
        "length": F.length(text).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "digits": F.length(F.regexp_replace(text, r"[^0-9]+", "")) / F.greatest(F.length(text), F.lit(1)).cast("double"),
        "hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
        "entropy": entropy(host),
        "params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
    }


def suffix_of(host: Column) -> Column:
    """The last label of the host."""
    return F.substring_index(host, ".", -1)


@dataclass
class UrlModel:
    """trees: nested (feature, cut, low, high) or leaves, added to the log odds of the suffix's rate; rates: the share of blocked URLs of the suffixes that have LEAST labels of each action, ``prior`` for all others; without labels ``base`` is None and all is allowed."""

    base: float | None = None
    trees: list = field(default_factory=list)
    rates: dict[str, float] = field(default_factory=dict)
    prior: float = 0.5

    def suffix_rate(self, host: Column) -> Column:
        if not self.rates:
            return F.lit(self.prior)
        table = F.create_map(*(F.lit(x) for pair in sorted(self.rates.items()) for x in pair))
        return F.coalesce(F.try_element_at(table, suffix_of(host)), F.lit(self.prior))

    def start(self, host: Column) -> Column:
        """Log odds of blocking by the suffix alone."""
        rate = self.suffix_rate(host)
        return F.log(rate / (1 - rate))

    def margin(self, value: dict[str, Column]) -> Column:
        """Log odds of blocking; value: the features, and :meth:`start` as ``start``."""

        def branch(tree: object) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            name, cut, low, high = tree
            return F.when(value[name] <= cut, branch(low)).otherwise(branch(high))

        total = value["start"]
        for tree in self.trees:
            total = total + branch(tree)
        return total


def fit(urls: DataFrame, url_col: str = "url", action_col: str = "action", sample: int = SAMPLE_URLS) -> UrlModel:
    """Boosted trees for blocking, from rows whose action is block or allow.

    Labels that are all of one action within their suffix tell which rule there is, not what its other URLs are like: a
    suffix with fewer than LEAST labels of either action gets the prior, and its labels count for the prior only. The
    trees start from the suffix's rate and learn what differs within a suffix, so a rule does not leak through features that
    tell suffixes apart. Splits that labels without a pattern would give too are not made. Suffixes with fewer than LEAST labels in all are taken together as one.

    Only the sample is gone through again and again: it is written once, and each level of a tree is one aggregation of
    gradient histograms over it. What reaches the driver are the histograms and the cut points.
    """
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    # copies of a URL are one example, so a hot one does not fill the sample; conflicting labels of a URL are one each
    known = urls.where(F.col(action_col).isin("block", "allow")).select(url, (F.col(action_col) == "block").cast("double").alias("y")).distinct()
    few = durable(sampled(known, url_col, sample).select("y", host.alias("host"), *(c.alias(k) for k, c in lexical(url, host, path).items())), "urls").coalesce(1)
    total = few.agg(F.count("*").alias("n"), F.sum("y").alias("s")).first()
    if not total["n"]:
        return UrlModel()
    prior = (total["s"] + 1) / (total["n"] + 2)
    model = UrlModel(base=math.log(prior / (1 - prior)), prior=prior)
    suffix = suffix_of(F.col("host"))
    by_suffix = few.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()
    both = lambda n, s: min(s, n - s) >= LEAST
    model.rates = {r["suffix"]: (r["s"] + 10 * prior) / (r["n"] + 10) for r in by_suffix if both(r["n"], r["s"])}
    rare = [r for r in by_suffix if r["n"] < LEAST]
    teaches = suffix.isin(list(model.rates))
    if both(sum(r["n"] for r in rare), sum(r["s"] for r in rare)):
        teaches |= ~suffix.isin([r["suffix"] for r in by_suffix if r["n"] >= LEAST])
    elif not model.rates:
        return model
    names = [c for c in few.columns if c not in ("y", "host")]
    few = few.where(teaches).withColumn("start", model.start(F.col("host")))
    marks = [k / BINS for k in range(1, BINS)]
    found = few.agg(*(F.percentile_approx(n, marks, 10_000).alias(n) for n in names)).first()
    cuts = {n: sorted(set(found[n])) for n in names}
    binned = few.select("y", "start", *(sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)).alias(n) for n in names))
    binned = durable(binned.groupBy("start", *names).agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("s")), "bins").coalesce(1)
    places = {n: F.col(n) for n in ["start", *names]}
    tried = max(1, sum(map(len, cuts.values()))) * (2**DEPTH - 1) * ROUNDS
    least = NormalDist().inv_cdf(1 - BY_CHANCE / tried / 2) ** 2
    for _ in range(ROUNDS):
        shown = UrlModel(trees=[_binned(t, cuts) for t in model.trees])
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-shown.margin(places)))
        graded = binned.withColumns({"g": F.col("n") * chance - F.col("s"), "h": F.col("n") * chance * (1 - chance)})
        tree: object = 0.0
        for level in range(DEPTH + 1):
            leaf = _leaf_id(_binned(tree, cuts), places)
            sums = graded.select(leaf.alias("leaf"), "g", "h", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in names))).alias("x"))
            rows = sums.groupBy("leaf", "x.feature", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            splits = {k: _best(k, rows, cuts, names, least, last=level == DEPTH) for k in {r["leaf"] for r in rows}}
            tree = _grown(tree, splits)
            if all(isinstance(s, float) for s in splits.values()):
                break
        model.trees.append(tree)
    return model


def _binned(tree: object, cuts: dict[str, list[float]]) -> object:
    """The same tree over bin numbers."""
    if isinstance(tree, float):
        return tree
    name, cut, low, high = tree
    return (name, cuts[name].index(cut), _binned(low, cuts), _binned(high, cuts))


def _leaf_id(tree: object, value: dict[str, Column], at: int = 1) -> Column:
    if isinstance(tree, float):
        return F.lit(at)
    name, cut, low, high = tree
    return F.when(value[name] <= cut, _leaf_id(low, value, 2 * at)).otherwise(_leaf_id(high, value, 2 * at + 1))


def _grown(tree: object, splits: dict[int, object], at: int = 1) -> object:
    """The tree with its leaves replaced."""
    if isinstance(tree, float):
        return splits.get(at, tree)
    name, cut, low, high = tree
    return (name, cut, _grown(low, splits, 2 * at), _grown(high, splits, 2 * at + 1))


def _best(leaf: int, rows: list, cuts: dict[str, list[float]], names: list[str], least: float, last: bool) -> object:
    """The split of most gain as (feature, cut, value, value), or the leaf's value when none gains more than ``least``."""
    bins = {n: [(0.0, 0.0)] * (len(cuts[n]) + 1) for n in names}
    for r in rows:
        if r["leaf"] == leaf:
            bins[r["feature"]][r["bin"]] = (r["g"], r["h"])
    g, h = (sum(x[k] for x in bins[names[0]]) for k in (0, 1))
    value = lambda a, b: -RATE * a / (b + RIDGE)
    best: tuple[float, object] = (least, value(g, h))
    for n in names if not last else []:
        left_g = left_h = 0.0
        for cut, (a, b) in zip(cuts[n], bins[n], strict=False):
            left_g, left_h = left_g + a, left_h + b
            gain = left_g**2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - g**2 / (h + RIDGE)
            if gain > best[0] and min(left_h, h - left_h) > 1e-3:
                best = (gain, (n, cut, value(left_g, left_h), value(g - left_g, h - left_h)))
    return best[1]


def judge(df: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", sample: int = SAMPLE_URLS) -> DataFrame:
    """Adds host, path, rule, score (chance of blocking by the trees) and verdict to every row.

    The URLs that a rule decides are the labelled ones that the trees learn from. Null and empty URLs have empty host and
    path and get the trees' verdict; repeated rows stay; an empty table gives an empty one; a very long url is read whole; without a labelled URL all else is allowed. Columns of these
    names are replaced. Scoring is one projection: no shuffle, no join.
    """
    url = F.col(f"`{url_col}`")
    rule, action = rule_for(host_of(url), path_of(url), rules)
    model = fit(df.select(url.alias("url"), action.alias("action")), sample=sample)
    mine = free_prefix(df)
    out = df.withColumns({f"{mine}host": host_of(url), f"{mine}path": path_of(url)})
    host, path = F.col(f"{mine}host"), F.col(f"{mine}path")
    rule, action = rule_for(host, path, rules)
    value = lexical(url, host, path) | {"start": model.start(host)}
    used = {f"{mine}_{k}": c for k, c in value.items()}
    out = out.withColumns({**used, f"{mine}rule": rule, f"{mine}action": action})
    margin = model.margin({k: F.col(f"{mine}_{k}") for k in value})
    score = (1 / (1 + F.exp(-margin))) if model.base is not None else F.lit(0.0)
    out = out.withColumn(f"{mine}score", score)
    verdict = F.coalesce(f"{mine}action", F.when(F.col(f"{mine}score") > 0.5, "block").otherwise("allow"))
    out = out.withColumns({"host": host, "path": path, "rule": F.col(f"{mine}rule"), "score": F.col(f"{mine}score"), "verdict": verdict})
    return out.drop(*used, *(f"{mine}{k}" for k in ("host", "path", "rule", "action", "score")))
