"""Inner products, filter audit and prefix trie against brute force, with nulls, ties, copies, empty tables and hot groups."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.llm import audit, products, queries, trie

CONVS = "conv_id long, turn long, role string, text string"


def brute_trie(paths):
    """{prefix: [conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends]} of {conv: [(role, text)]}."""
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    kids = {k: [j for j in nodes if len(j) == len(k) + 1 and j[: len(k)] == k] for k in nodes}
    out = []
    for k, members in nodes.items():
        below = [j for j in nodes if j[: len(k)] == k]
        saved = sum((len(nodes[j]) - 1) * len(j[-1][1]) for j in below if j)
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(k))))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(members), len(k), parent, len(members), len(kids[k]), sum(not kids[j] for j in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def conversations(spark, paths):
    rows = [(c, k, r, t) for c, p in paths.items() for k, (r, t) in enumerate(p)]
    return spark.createDataFrame(rows, CONVS)


def random_paths(seed, many, words=3, depth=6):
    rng = random.Random(seed)
    return {c: [("u", rng.choice("ab" * 1 + "c")[:words] * rng.choice([1, 2])) for _ in range(rng.randint(1, depth))] for c in rng.sample(range(-50, 10 * many), many)}


@pytest.mark.parametrize("shard_turns", [7, 40, 100000])
def test_trie_whatever_the_shards(spark, shard_turns):
    paths = random_paths(shard_turns, 120)
    paths |= {1000 + i: [("u", "same"), ("a", "same too")] for i in range(90)}  # a group that reaches over several shards
    paths[5000] = [("u", "x")] * 60
    paths[5001] = [("u", "x")] * 61
    mine = trie.prefix_trie(trie.sequences(conversations(spark, paths)), shard_turns)
    assert nodes_of(mine) == brute_trie(paths)


def test_trie_with_lists_in_pieces(spark, monkeypatch):
    paths = {i: [("u", "same")] for i in range(200)}
    monkeypatch.setattr(trie, "PIECE", 7)
    assert nodes_of(trie.prefix_trie(trie.sequences(conversations(spark, paths)), 50)) == brute_trie(paths)


def test_trie_order_nulls_repeats_and_empty(spark):
    rows = [(1, None, "u", "first"), (1, 2, None, None), (1, 1, "u", "b"), (2, 0, "u", "first"), (2, 1, "u", "b"), (2, 1, "u", "b"), (None, 0, "u", "lost"), (3, 0, "", ""), (4, 0, "u", "é" * 2_000_000)]
    df = spark.createDataFrame(rows, CONVS).withColumn("path", F.lit(1)).withColumn("side", F.lit(2)).withColumn("shard", F.lit(3))
    paths = {1: [("u", "first"), ("u", "b"), ("", "")], 2: [("u", "first"), ("u", "b"), ("u", "b")], 3: [("", "")], 4: [("u", "é" * 2_000_000)]}
    assert nodes_of(trie.prefix_trie(trie.sequences(df))) == brute_trie(paths)
    assert trie.prefix_trie(trie.sequences(df.limit(0))).count() == 0


def test_rebuilt_conversations(spark):
    rng = random.Random(5)
    paths = {c: [("u", rng.choice("ab")) for _ in range(rng.randint(1, 7))] for c in [*range(95, 130), 200, 201, 202, 305, 306, -3, -250]}
    whole = {}
    for c, p in paths.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole[c] = paths.get(base, [])[:h] + p[h:]
    assert any(not p for p in whole.values())  # some are left without a turn
    assert nodes_of(trie.prefix_trie(queries.rebuilt(trie.sequences(conversations(spark, paths))), 20)) == brute_trie(whole)


def brute_products(rows, asks, k, scale=256):
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            kept.setdefault(i, []).append([int(np.floor(np.float64(scale) * x)) for x in v])
    out = []
    for q in sorted(i for i in kept if asks(i)):
        x = min(kept[q])
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, ys in kept.items() for y in ys if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("kind", ["units", "skewed", "ties", "few"])
def test_products_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6 if kind == "few" else 700, 24))
    if kind == "units":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "skewed":
        x *= rng.exponential(size=(700, 1)) ** 2 * np.linspace(3, 0, 24)
    if kind == "ties":
        x = rng.integers(-1, 2, size=(700, 24)) / 4.0
        x[:300] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(10_000, None), (10_010, [float("nan")] * 24), (10_020, [None] * 24), (10_030, [float("inf")] * 24), (10_040, []), (10_050, [0.0] * 24), (10_051, [-0.0] * 24), (None, rows[0][1]), (0, rows[1][1]), (20, rows[2][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("length", F.lit("x"))
    found = products.largest_products(df, F.col("vec_id") % 10 == 0, k=5, round_size=30, head=50)
    assert sorted(tuple(r) for r in found.collect()) == brute_products(rows, lambda i: i % 10 == 0, 5)
    assert products.largest_products(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert products.largest_products(df, F.col("vec_id") < -5).count() == 0


def test_products_of_huge_and_ragged_vectors(spark):
    rows = [(0, [1e30, 1.0]), (1, [1.0, 2.0]), (2, [8e6, 0.0]), (3, [-8e6, 1.0]), (4, [1.0, 2.0, 3.0]), (50, [8e6, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in products.largest_products(df, F.col("vec_id") % 50 == 0).collect())
    big = 256 * 8_000_000
    assert found == [(50, 1, 2, big * big), (50, 2, 1, big * 256 + 256 * 512), (50, 3, 3, -big * big + 256 * 256)]


DOCS = "doc_id long, text string, lang string"


def brute_audit(docs, labels):
    low = {}
    for i, t, _ in docs:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    judged = []
    for i, t, lang in docs:
        t = t or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = "".join(f for f, bad in zip("ABCDE", [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > low[t]], strict=True) if bad)
        judged.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        orders = ["".join(o) for o in permutations("ABCDE")]
        gone = {o: [next((f for f in o if f in j[1]), "") for j in mine] for o in orders}
        shapley = {f: sum(g == f for o in orders for g in gone[o]) for f in "ABCDE"}
        for o in orders:
            for k, f in enumerate(o):
                here = [g == f for g in gone[o]]
                kept = sum(not set(o[: k + 1]) & set(j[1]) for j in mine)
                out.append((part, o, k + 1, kept, sum(here), sum(f in j[1] and not h for j, h in zip(mine, here, strict=True)), sum(j[1] == f for j in mine), sum(h and j[2] for j, h in zip(mine, here, strict=True)), sum(h and j[3] for j, h in zip(mine, here, strict=True)), shapley[f]))
    return sorted(out)


def test_audit_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}é" for k in range(150)] + ["ÄÖ", "CAPS", "a|b", "x y", "1"]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 155])]) for _ in range(rng.choice([5, 199, 200, 260]))) for _ in range(60)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in rng.sample(range(1000), 150)]
    docs += [(2000 + i, texts[0], "en") for i in range(80)] + [(7, None, "en"), (8, "", "fr"), (None, texts[0], "fr"), (None, "only here", "fr"), (2000, texts[0], "en"), (2000, texts[0], "de"), (9, "A b\x0bc\x1fd" + "Wort " * 300_000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.sample(range(1000), 400)] + [(2000, 1, 0), (2000, 0, 1), (None, 1, 1), (9, 1, 1)]
    df = spark.createDataFrame(docs, DOCS).withColumn("n", F.lit(1)).withColumn("id", F.lit("x")).withColumn("good", F.lit(1)).withColumn("part", F.lit("y"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.interactions(df, marks)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in found.select(*columns).collect()) == brute_audit(docs, labels)
    assert audit.interactions(df.limit(0), marks).count() == 0


def test_matrix_has_every_word_once(spark):
    from collections import Counter

    texts = ["b a b", None, "", " \t", "c  a\nÜ", "a" * 3_000_000 + " a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words, seed = audit.dictionary(df)
    names = {r["code"]: r["word"] for r in words.collect()}
    assert len(names) == len(set(names.values())) == 5
    found = {}
    for r in audit.matrix(df, seed).collect():
        for k, i in enumerate(r["ids"]):
            a, b = r["indptr"][k], r["indptr"][k + 1]
            found[i] = {names[c]: n for c, n in zip(r["codes"][a:b], r["counts"][a:b], strict=True)}
    assert found == {i: dict(Counter((t or "").split())) for i, t in enumerate(texts)}


def test_a_code_shared_by_two_words_leads_to_another_seed(spark, monkeypatch):
    real = audit.word_codes
    monkeypatch.setattr(audit, "word_codes", lambda flat, start, end, seed: real(flat, start, end, seed) if seed else real(flat, start, end, seed) * 0 + 5)
    flat = np.frombuffer(b"aa bb aa", np.uint8)
    bad, good = (audit.csr(flat, np.array([0, 8]), seed) for seed in (0, 1))
    assert bad.mixed and not good.mixed and good.counts.tolist() in ([1, 2], [2, 1])
    sent = [b for b in audit._read(0)(iter([audit.pa.RecordBatch.from_arrays([audit.pa.array([1]), audit.pa.array([""]), audit.pa.array(["aa bb aa"])], ["id", "part", "text"])]))]
    assert sent[-1].column("code").to_pylist()[-2:] == [-1, -1] and len(set(sent[-1].column("word").to_pylist()[-2:])) == 2
