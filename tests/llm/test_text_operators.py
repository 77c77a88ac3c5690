"""Operators on text against the libraries, plain references and held-out labels, with nulls, empties, repeats and long texts."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablesmith.llm import bpe, language, packing, pii, quality, secrets, simjoin, urls
from tablesmith.llm.common import classes, utf8
from tablesmith.llm.pretokens import Encoder

P = pytest.importorskip("public_tokenizers")
HARD = ["", None, "it's we're I'll  'tis 's 'll\n\n  x\t\ty  ", "a" * 3000, " " * 300, "你好" * 400, "　 a\x1c\x85c", "12³½ ''s don't 'S", "é \U0001f600!!'s"]


def random_texts(many, letters="ab 's\n\t'rel1²!é　中", seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(many)]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_byte_bpe_agrees_with_tiktoken_and_decodes(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    texts = HARD + random_texts(500)
    rows = bpe.encode(documents(spark, texts), path, decode=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == theirs.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    assert bpe.encode(documents(spark, ["x"]).limit(0), path).count() == 0


def test_json_ranks_agree_with_tokenizers():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    theirs, run = Tokenizer.from_file(path), Encoder(bpe.ranks(path).encode_pieces)
    texts = [t or "" for t in HARD + random_texts(300)]
    ids, at = run(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_agree_with_tokenizers(spark):
    from tokenizers import Tokenizer

    path, end = P.path("byte_bpe_50k.json"), "<|endoftext|>"
    theirs, rnd = Tokenizer.from_file(path), random.Random(5)
    texts = ["no literal", f"a {end} b", end, "", f"{end}{end}  x \n {end}", f"it{end}'s <|endoftext |> <|endoftext", None, f"  {end}é", *("".join(rnd.choice([end, "a", " ", "\n", "'s", "é"]) for _ in range(20)) for _ in range(200)), "<|endof", "text|>"]
    want = [theirs.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[1] == [64, 220, 50256, 275]
    ids, at = bpe.encoder(path)([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    for r in bpe.encode(documents(spark, texts), path, decode=True).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]]
        assert bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode()
    for r in packing.pieces(documents(spark, texts), path).collect():
        whole = np.array([*want[r["doc_id"]], 0], "<u4")
        assert (r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]) == (0, len(whole), len(whole), zlib.crc32(whole.tobytes()))


def test_packing_covers_every_id_once(spark):
    texts = [None, "", "word " * 5000, *("some text here " * (n % 90) for n in range(400))]
    rows = packing.pack(packing.pieces(documents(spark, texts), P.path("byte_bpe_50k.json"))).collect()
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    assert set(of) == set(range(len(texts)))
    for pieces in of.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == pieces[0]["doc_tokens"]
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by) <= 1.1 * sum(r["length"] for r in rows) / 1024 + 2


def test_column_generation_finds_the_halves():
    patterns, use = packing.solve(np.array([100, 156]), np.array([50.0, 50.0]), 256)
    assert use.sum() == pytest.approx(50)
    assert packing.plan({}, 256) == []


GOOD = "The day was long and the road went on. They came home in the evening."
BAD = ["a | b | c | d | e | f", "buy### now$$$ it%%% is&&& great***", "same same same same same same same same", "LOUD!! WORDS!! ALL!! OVER!!"]


def test_quality_learns_lines(spark):
    rnd = random.Random(0)
    texts, marks = [], []
    for i in range(240):
        good = i % 4 > 0
        words = GOOD.split()
        texts.append("\n".join(" ".join(rnd.sample(words, 8)) if good else rnd.choice(BAD) for _ in range(rnd.randint(1, 6))))
        marks.append(int(good))
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(0, marks[0]), (999, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(documents(spark, texts[:160]), labels)
    rows = quality.score(documents(spark, texts[160:] + [None, "", "\n\n"]), model).collect()
    assert np.mean([r["predicted"] == m for r, m in zip(sorted(rows, key=lambda r: r["doc_id"])[:80], marks[160:])]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    nothing = quality.fit(documents(spark, texts).limit(0), labels)
    assert quality.score(documents(spark, ["x"]), nothing).first()["score"] == 0.5


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    unary, step = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    p, _, log = quality.marginals(unary, step, np.zeros(4, np.int64))
    weights = {path: math.exp(sum(unary[t, s] for t, s in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:]))) for path in np.ndindex(2, 2, 2, 2)}
    total = sum(weights.values())
    assert log == pytest.approx(math.log(total))
    assert p[2, 1] == pytest.approx(sum(w for path, w in weights.items() if path[2] == 1) / total)


def test_language_by_subwords(spark):
    words = {"en": "the and with that from this have".split(), "de": "der und mit das nicht auch eine".split(), "fr": "le et avec que dans une pour".split()}
    rnd = random.Random(0)
    rows = [(i, " ".join(rnd.choices(words[lang], k=rnd.randint(3, 30))), lang) for i, lang in enumerate(rnd.choices(sorted(words), k=300))]
    docs = spark.createDataFrame([*rows, (900, "no language", None), (901, None, "en")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert np.mean([found[i]["lang_pred"] == lang for i, _, lang in rows]) > 0.98
    odd = language.identify(spark.createDataFrame([(0, None), (1, ""), (2, "123 !"), (3, "é")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in odd] == [True, True, True, False]
    assert language.fit(docs.limit(0)) is None


def test_a_language_not_learned_is_mostly_rejected():
    rnd = random.Random(4)
    letters = {lang: rnd.sample("abcdefghijklmnopqrstuvwxyz", 14) for lang in "abcx"}
    words = {lang: ["".join(rnd.choices(some, k=rnd.randint(2, 8))) for _ in range(150)] for lang, some in letters.items()}
    make = lambda lang, many: [" ".join(rnd.choices(words[lang], k=rnd.randint(8, 40))) for _ in range(many)]
    bytes_of = lambda texts: utf8(pa.array(texts))
    texts = [(t, k) for k, lang in enumerate("abc") for t in make(lang, 120)]
    rnd.shuffle(texts)
    model = language.train(language.counts(*bytes_of([t for t, _ in texts])), np.array([k for _, k in texts]), list("abc"))
    known, other = (model.probabilities(*bytes_of([t for lang in some for t in make(lang, 200)])).max(axis=1) for some in ("abc", "x"))
    assert (known < model.least).mean() < 0.01
    assert (other < model.least).mean() > 0.7


def plain_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(digits)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_pii_base_and_network(spark):
    texts = random_texts(4000, "ab1290..@@-- +()%5\n", 3)
    assert [pii.base_spans(t) for t in texts] == [plain_base(t) for t in texts]
    net = pii.train(*pii.examples(["some plain words that go on and on " * 4], many=500), epochs=3)
    rows = pii.find(documents(spark, [None, "", "mail a.b@c.org now", "clean words"]), net, redact=True).orderBy("doc_id").collect()
    assert [r["redacted"] for r in rows] == [None, "", "mail [EMAIL] now", "clean words"]


def test_tagger_gradient():
    net = pii.Tagger.fresh()
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    code, tag = pii.examples(["x y z " * 20], many=3)
    code, tag = code[:3], tag[:3]
    grad = net.gradient(code, tag)[1]
    for k in ("steps", "out", "fh", "bx", "embed"):
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        value, ends = net.p[k][at], []
        for d in (1e-4, -1e-4):
            net.p[k][at] = value + d
            ends.append(net.gradient(code, tag)[0])
        net.p[k][at] = value
        assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(grad[k][at], rel=1e-2)


def best_window(s, w=20):
    return max((sum(-c / w * math.log2(c / w) for c in (s[i : i + w].count(x) for x in set(s[i : i + w]))) for i in range(len(s) - w + 1)), default=0.0)


def test_secrets(spark):
    from pyspark.sql import functions as F

    token = "Zk3LpQ9xWv7TbN2mRs8Yd5Hc"
    texts = [None, "", 'api_key: "abcdef" AKIA' + "B" * 16, "token=ab secret = token: abcdefgh", "é " + "0123456789abcdef" * 2, f"key {token} end", "123e4567-e89b-12d3-a456-426614174000", "x" * 5000]
    rows = secrets.scan(documents(spark, texts)).select("doc_id", secrets.listed(F.col("secrets")).alias("s")).orderBy("doc_id").collect()
    assert [r["s"] for r in rows] == ["", "", "assign:0:16,access:18:38", "", "hex:2:34", "entropy:4:28", "", ""]
    found = spark.createDataFrame([(token,), ("a" * 30,)], "s string").select(secrets.best_entropy(F.col("s")).alias("h")).collect()
    assert [r["h"] for r in found] == pytest.approx([best_window(token), 0.0])


def test_urls(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow")]
    given = [None, "", "x", "http://A.Example.NET/en/1?q#f", "https://b.example.net/de", "https://net?x", "http://c.org/fr/", "http://c.org/de/", *(f"http://s{i}.net/p{i}" for i in range(60)), *(f"http://s{i}.org/fr/{i}" for i in range(60))]
    rows = urls.judge(spark.createDataFrame(list(enumerate(given)), "page_id long, url string"), rules).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in rows[:8]] == [("", "", None)] * 3 + [("a.example.net", "/en/1", "example.net/en/"), ("b.example.net", "/de", "net/"), ("net", "", None), ("c.org", "/fr/", "org/fr/"), ("c.org", "/de/", None)]
    assert rows[7]["verdict"] == "allow" and rows[4]["verdict"] == "block"
    assert urls.judge(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), []).first()["verdict"] == "allow"


def test_a_rule_does_not_leak_through_its_suffix(spark):
    rules = [("one.com/de/", "block"), ("some.org/fr/", "allow"), ("net/", "block"), ("good.net/", "allow")]
    clean, odd = (lambda host, i: f"https://{host}/en/page/{i}"), (lambda host, i: f"http://win-big-{i}.{host}/?a={i}&b=2&c=3")
    labels = [f"https://a{i}.one.com/de/page/{i}" for i in range(60)] + [f"https://a{i}.some.org/fr/page/{i}" for i in range(60)]
    labels += [clean(f"a{i}.good.net", i) for i in range(60)] + [odd("bad.net", i) for i in range(40)]
    open_ = [(make(host, i), want) for host in ("one.com", "some.org") for make, want in ((clean, "allow"), (odd, "block")) for i in range(20)]
    given = spark.createDataFrame([(u,) for u in labels + [u for u, _ in open_]], "url string")
    found = {r["url"]: r for r in urls.judge(given, rules).collect()}
    assert [found[u]["rule"] for u, _ in open_] == [None] * len(open_)
    assert [found[u]["verdict"] for u, _ in open_] == [want for _, want in open_]
    alone = [u for u in labels if "good.net" not in u and "bad.net" not in u][20:] + ["https://b.one.com/en/1"]
    last = {r["url"]: r for r in urls.judge(spark.createDataFrame([(u,) for u in alone], "url string"), rules).collect()}
    assert last["https://b.one.com/en/1"]["verdict"] == "allow"


def exact_classes(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_similarity_join_is_exact(spark, n, percent):
    rnd = random.Random(n)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rnd.choices(words, k=12))
    texts = [None, "", " \n", "one", "One", "one two", *("copy of a short text here now" for _ in range(5))]
    for _ in range(25):
        base = rnd.choices(words, k=rnd.choice([6, 12, 30, 80, 300]))
        for _ in range(4):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(" ".join(w) + (f" {shared}" if rnd.random() < 0.4 else ""))
    size, root = exact_classes(texts, n, percent)
    rows = simjoin.similar(documents(spark, texts), n, percent, sample=50).orderBy("doc_id").collect()
    assert [r["n_shingles"] for r in rows] == size
    assert [r["component_id"] for r in rows] == root


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        a = np.unique(np.concatenate([a, b[: len(b) // 2]]))
        assert simjoin.distance(simjoin.bit_sketch(a), simjoin.bit_sketch(b)) <= len(np.setxor1d(a, b))


def test_classes_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in classes(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_utf8_of_slices():
    flat, starts = utf8(pa.array(["é", None, "", "ab"]).slice(1))
    assert flat.tobytes() == b"ab" and starts.tolist() == [0, 0, 0, 2]
    assert hashlib.sha256(flat.tobytes()).hexdigest()
