"""The trees of the URL filter on labels with a pattern: against a booster over plain arrays, and on URLs they never saw."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.llm import urls


def planted(many, seed):
    """URLs whose action depends on digits and parameters within one suffix; one in twenty is labelled at random."""
    rnd = random.Random(seed)
    out = []
    for k in range(many):
        digits, params, depth = rnd.choice([0, 6, 14]), rnd.randint(0, 4), rnd.randint(0, 5)
        path = "/".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9))) for _ in range(depth))
        query = "&".join(f"{rnd.choice('pqrs')}=x" for _ in range(params))
        url = f"http://{rnd.choice('abcdef')}{rnd.choice(['site', 'casino-win', 'shop'])}{k % 7}.net/{path}{''.join(rnd.choice('0123456789') for _ in range(digits))}" + (f"?{query}" if query else "")
        block = digits == 14 and params >= 2 or digits == 6 and depth <= 1
        out.append((url, "block" if (block if rnd.random() > 0.05 else rnd.random() < 0.5) else "allow", block))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    train, test = (spark.createDataFrame(planted(n, s), "url string, action string, truth boolean") for n, s in ((4000, 1), (1000, 2)))
    return train, test, urls.fit(train)


def valued(df, model):
    """Features and margins by Spark, one row a URL."""
    url = F.col("url")
    host, path = urls.host_of(url), urls.path_of(url)
    value = urls.lexical(url, host, path)
    rows = df.select("truth", (F.col("action") == "block").cast("double").alias("y"), *(c.alias(k) for k, c in value.items()), model.start(host).alias("start"))
    return rows.withColumn("margin", model.margin({k: F.col(k) for k in [*value, "start"]})).toPandas(), list(value)


def test_trees_decide_where_labels_have_a_pattern(tables):
    _, test, model = tables
    rows, _ = valued(test, model)
    assert any(not isinstance(t, float) for t in model.trees) and rows["margin"].round(6).nunique() > 5
    right = ((rows["margin"] > 0) == rows["truth"]).mean()
    always = max(rows["truth"].mean(), 1 - rows["truth"].mean())
    chance = 1 / (1 + np.exp(-rows["margin"]))
    loss = -np.where(rows["y"] == 1, np.log(chance), np.log(1 - chance)).mean()
    prior = -np.where(rows["y"] == 1, math.log(model.prior), math.log(1 - model.prior)).mean()
    assert right > 0.97 > always and loss < 0.6 * prior


def test_trees_are_those_of_a_plain_booster(tables):
    train, _, model = tables
    rows, names = valued(train.dropDuplicates(["url", "action"]), model)
    marks = [k / urls.BINS for k in range(1, urls.BINS)]
    found = train.dropDuplicates(["url", "action"]).select(*(c.alias(k) for k, c in urls.lexical(F.col("url"), urls.host_of(F.col("url")), urls.path_of(F.col("url"))).items())).agg(*(F.percentile_approx(n, marks, 10_000).alias(n) for n in names)).first()
    cuts = {n: sorted(set(found[n])) for n in names}
    x, y, margin = {n: rows[n].to_numpy() for n in names}, rows["y"].to_numpy(), rows["start"].to_numpy().copy()
    tried = max(1, sum(map(len, cuts.values()))) * (2**urls.DEPTH - 1) * urls.ROUNDS
    least = NormalDist().inv_cdf(1 - urls.BY_CHANCE / tried / 2) ** 2

    def grow(mine, g, h, depth):
        a, b = g[mine].sum(), h[mine].sum()
        best = (least, None)
        for n in names if depth < urls.DEPTH else []:
            for cut in cuts[n]:
                low = mine & (x[n] <= cut)
                la, lb = g[low].sum(), h[low].sum()
                gain = la**2 / (lb + urls.RIDGE) + (a - la) ** 2 / (b - lb + urls.RIDGE) - a**2 / (b + urls.RIDGE)
                if gain > best[0] + 1e-9 and min(lb, b - lb) > 1e-3:
                    best = (gain, (n, cut))
        if best[1] is None:
            margin[mine] += -urls.RATE * a / (b + urls.RIDGE)
            return
        n, cut = best[1]
        grow(mine & (x[n] <= cut), g, h, depth + 1)
        grow(mine & (x[n] > cut), g, h, depth + 1)

    for _ in range(urls.ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        grow(np.ones(len(y), bool), p - y, p * (1 - p), 0)
    assert np.abs(margin - rows["margin"].to_numpy()).max() < 1e-6
