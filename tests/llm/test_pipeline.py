"""Every stage of the corpus pipeline on a small table with nulls, empties, repeats and odd columns, and the whole of it."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = {"en": "the and with that from this have road day evening house river".split(), "de": "der und mit das nicht auch eine strasse tag abend haus fluss".split()}
BAD = ["a | b | c | d | e | f", "buy### now$$$ it%%% is&&& great***", "same same same same same same same same", "LOUD!! WORDS!! ALL!! OVER!!"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rnd = random.Random(0)
    out = []
    for i in range(240):
        lang = ("en", "de")[i % 2]
        good = i % 4 > 0
        text = "\n".join(" ".join(rnd.choices(WORDS[lang], k=9)) if good else rnd.choice(BAD) for _ in range(rnd.randint(2, 6)))
        out.append((i, text, lang, "hot" if i % 3 else "cold", len(text)))
    return out


ROWS = texts()
LABELS = [(i, int(i % 4 > 0)) for i in range(0, 240, 2)] + [(1, 1), (3, 1), (None, 1), (9999, 0)]
#: A null text, an empty one, repeated rows, an id that two texts share, no id.
ODD = [(300, None, None, None, None), (301, "", "en", "hot", 0), ROWS[1], ROWS[1], (302, ROWS[2][1], "de", None, 7), (None, ROWS[3][1], "de", "x", 1)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(ROWS + ODD, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


def test_quality_keeps_good_documents(spark, sf, docs):
    out = corpus_pipeline.keep_good(spark, docs, sf)
    assert out.columns == docs.columns
    kept = set(ids(out))
    assert np.mean([(i in kept) == (i % 4 > 0) for i in range(240)]) > 0.97
    assert [r for r in out.collect() if r["doc_id"] == 1].__len__() == 3 * (1 in kept)


def test_language_drops_what_it_rejects(spark, sf, docs):
    odd = spark.createDataFrame([(400, "1234 5678 !!", "en", "x", 12), (401, "你好世界今天天气很好" * 9, None, "x", 90)], SCHEMA)
    kept = set(ids(corpus_pipeline.keep_known_language(spark, docs.where("text not like '%$$%'").union(odd), sf)))
    assert {300, 301, 400} & kept == set()
    plain = [i for i, t, *_ in ROWS if i % 4 > 0]
    assert np.mean([i in kept for i in plain]) > 0.97


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset({tuple(w)} if w else ())


def test_one_of_each_group_stays(spark, sf, docs):
    near = [(500 + k, ROWS[5][1] + f" {k} extra", "de", "x", 1) for k in range(3)]
    rows = [tuple(r) for r in docs.union(spark.createDataFrame(near, SCHEMA)).collect()]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    groups = {}
    for r, key in zip(rows, root):
        groups.setdefault(key if shingles(r[1]) else ("none", r), []).append(r)
    want = sorted(min((r[0] for r in g if r[0] is not None), default=None) if any(r[0] is not None for r in g) else -1 for g in groups.values())
    got = sorted(r["doc_id"] for r in kept if r["doc_id"] is not None)
    assert got == [w for w in want if w is not None and w >= 0]


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, sf):
    rows = [(1, " ".join(f"a{i}" for i in range(30)), "en", "x", 1), (1, " ".join(f"b{i}" for i in range(30)), "en", "x", 1), (2, " ".join(f"b{i}" for i in range(30)), "en", "x", 1)]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()
    assert len({r["text"] for r in kept}) == 2 and len(kept) == 2


def test_personal_data_is_masked(spark, sf, docs):
    some = docs.withColumn("text", F.when(F.col("doc_id") == 5, F.concat("text", F.lit(" mail a.b@c.org or 10.1.2.3"))).otherwise(F.col("text")))
    out = {r["doc_id"]: r for r in corpus_pipeline.mask_personal_data(spark, some, sf).collect()}
    assert out[5]["text"] == ROWS[5][1] + " mail [EMAIL] or [IP]" and out[5]["n_chars"] == len(out[5]["text"])
    assert out[300]["text"] is None and out[300]["n_chars"] is None and out[301]["text"] == ""
    assert out[6]["text"] == ROWS[6][1]


def test_packing_holds_every_token(spark, sf, docs):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    theirs = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = corpus_pipeline.pack_tokens(spark, some, sf).collect()
    whole = {r["doc_id"]: [*theirs.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in some.collect()}
    assert {r["doc_id"] for r in rows} == set(whole)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(whole[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        assert r["doc_tokens"] == len(whole[r["doc_id"]])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table_and_odd_columns(spark, sf, docs, stage):
    assert stage(spark, docs.limit(0), sf).count() == 0
    names = ("__score", "__predicted", "__rejected", "__text", "__0", "base", "spans", "redacted", "score", "id", "n", "key", "root")
    wide = docs.where("doc_id < 40").select("*", *(F.col("doc_id").alias(c) for c in names))
    out = stage(spark, wide, sf)
    if stage is not corpus_pipeline.pack_tokens:
        assert out.columns == wide.columns
        assert all(r[c] == r["doc_id"] for r in out.collect() for c in names)
    else:
        assert out.count() >= 40


def test_the_whole_pipeline(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {r["doc_id"] for r in rows}
    assert kept <= {r[0] for r in ROWS + ODD} and not {300, 301} & kept
    assert np.mean([(i in kept) == (i % 4 > 0) for i in range(240) if i != 302]) > 0.95
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    assert all(sum(r["length"] for r in p) % p[0]["doc_tokens"] == 0 for p in of.values())
