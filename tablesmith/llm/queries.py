"""The registered queries of this subpackage: thin uses of its operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, language, packing, pii, products, quality, secrets, simjoin, trie, urls, vectors
from .common import durable, held_out, read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit(docs.where(~held_out("doc_id")), read(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out("doc_id")))
    return quality.score(docs, model, keep=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


# The rules of op2.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    out = pii.find(docs, pii.fit(docs), keep=["doc_id"])
    counts = [F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.similar(read(spark, sf_dir, "documents", "doc_id", "text"), n=4, percent=85)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_multi_50k.tiktoken"), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), 0.95)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json")))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    counts = {f"n_{k}": secrets.number(F.col("secrets"), k) for k in secrets.KINDS}
    base = secrets.listed(F.filter("secrets", lambda s: s["kind"] != "entropy"))
    return out.select("doc_id", *(c.alias(k) for k, c in counts.items()), F.sha2(base, 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out("doc_id")))
    return language.identify(docs, model, keep=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op11_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.largest_products(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


#: Conversations that share first turns come in blocks of this many ids; a conversation takes fewer than so many.
SHARED_IDS, SHARED_TURNS = 100, 6


def rebuilt(sequenced: DataFrame) -> DataFrame:
    """Every conversation with first turns of the block's first one in place of its own."""
    base = F.col("conv_id") - F.col("conv_id") % SHARED_IDS
    heads = sequenced.where(F.col("conv_id") % SHARED_IDS == 0).select(F.col("conv_id").alias("base"), F.slice("items", 1, SHARED_TURNS - 1).alias("heads"))
    both = sequenced.withColumn("base", base).join(heads, "base", "left")
    taken = (F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS).cast("int")
    own = F.slice("items", taken + 1, F.size("items"))
    return both.select("conv_id", F.when(F.col("heads").isNull(), own).otherwise(F.concat(F.slice("heads", 1, taken), own)).alias("items"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return trie.prefix_trie(rebuilt(durable(trie.sequences(turns), "sequences")))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 says of host, path and rule, and the verdict where a rule decides."""
    found = op2_urls(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("decided"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op3."""
    return op3_pii(spark, sf_dir).drop("spans")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op9."""
    return op9_secrets(spark, sf_dir).drop("spans", "n_entropy")


QUERIES = (op1_quality, op2_urls, op3_pii, op4_parity_join, op5_byte_bpe, op6_vector_dedup, op7_packing, op8_nearest, op9_secrets, op10_language, op11_products, op12_filter_audit, op13_prefix_trie, url_rules, pii_base, secrets_base)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def _classes_sql(nodes: str, links: str) -> str:
    """(id, component_id): the smallest node reachable over links (a, b), both ways."""
    return f"""SELECT n.id, least(n.id, coalesce(min(r.b), n.id)) AS component_id FROM ({nodes}) n LEFT JOIN reached r ON r.a = n.id GROUP BY n.id"""


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
REACHED = "reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)"
OP4 = f"""
WITH RECURSIVE words AS (SELECT doc_id AS id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams FROM words),
flat AS (SELECT id, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (SELECT x.id AS a, y.id AS b FROM flat x JOIN flat y ON x.gram = y.gram AND x.id <> y.id GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
{REACHED}
SELECT s.id AS doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, c.component_id FROM sets s JOIN ({_classes_sql('SELECT id FROM sets', 'links')}) c ON c.id = s.id
"""
#: Sums run from the first component to the last, as Spark's do, so that doubles agree to the last bit.
_SUM = "list_reduce(list_transform(range(1, len(x.v) + 1), lambda i: {}), lambda p, q: p + q)"
_VECTORS = """vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0)"""
OP6 = f"""
WITH RECURSIVE {_VECTORS},
scaled AS (SELECT id, list_transform(v, lambda c: c / sqrt(list_sum(list_transform(v, lambda d: d * d)))) AS v FROM vectors),
links AS (SELECT x.id AS a, y.id AS b FROM scaled x JOIN scaled y ON x.id <> y.id AND list_dot_product(x.v, y.v) >= 0.95),
{REACHED}
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, c.component_id = e.vec_id AS kept FROM embeddings e JOIN ({_classes_sql('SELECT vec_id AS id FROM embeddings', 'links')}) c ON c.id = e.vec_id
"""
OP8 = f"""
WITH {_VECTORS}
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS place FROM (SELECT x.id AS query_id, y.id AS vec_id, sqrt({_SUM.format('(y.v[i] - x.v[i]) * (y.v[i] - x.v[i])')}) AS score FROM vectors x JOIN vectors y ON x.id <> y.id AND x.id % 100 = 0)) WHERE place <= 10
"""

OP11 = """
WITH fine AS (SELECT vec_id AS id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
asks AS (SELECT id, min(v) AS v FROM fine WHERE id % 50 = 0 GROUP BY id)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (SELECT x.id AS query_id, y.id AS vec_id, list_sum(list_transform(list_zip(x.v, y.v), lambda p: p[1] * p[2])) AS score FROM asks x JOIN fine y ON x.id <> y.id)) WHERE place <= 5
"""
OP12 = """
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
least AS (SELECT t, min(doc_id) AS low FROM texts GROUP BY t),
words AS (SELECT x.*, l.low, regexp_extract_all(x.t, '[^\x20\x09-\x0D]+') AS w FROM texts x JOIN least l ON l.t = x.t),
marks AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(words.doc_id > low, false)} AS f FROM words LEFT JOIN marks ON marks.doc_id = words.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders AS (SELECT letter AS o FROM letters UNION ALL SELECT o || letter FROM orders JOIN letters ON NOT contains(o, letter)),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders WHERE length(o) = 5),
sets AS (SELECT part, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END) || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS s, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
judged AS (SELECT part, o, step, s, n, good, toxic, contains(s, substr(o, step, 1)) AS here, length(translate(s, substr(o, 1, step - 1), '')) < length(s) AS gone FROM sets, steps),
counted AS (SELECT part, o, step, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND length(s) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM judged GROUP BY part, o, step)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, substr(o, step, 1)) AS BIGINT) AS shapley FROM counted
"""
#: CRC-32 of the id's digits, bit by bit.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
OP13 = f"""
WITH turns AS (SELECT conv_id AS c, turn, length(coalesce(text, '')) AS n, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, {_CRC} % 6 AS h, list(g ORDER BY turn NULLS FIRST, g) AS g, list(n ORDER BY turn NULLS FIRST, g) AS n FROM turns GROUP BY c),
rebuilt AS (SELECT o.c, list_concat(coalesce(b.g, [])[1:o.h], o.g[o.h + 1:]) AS g, list_concat(coalesce(b.n, [])[1:o.h], o.n[o.h + 1:]) AS n FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 100),
paths AS (SELECT c, d, len(g) AS whole, array_to_string(g[1:d], '') AS k, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(g) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE whole = d), '')) AS ends_sha256 FROM paths GROUP BY d, k),
children AS (SELECT d - 1 AS d, substr(k, 1, 64 * (d - 1)) AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
marked AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.k = n.k),
under AS (SELECT up AS d, substr(k, 1, 64 * up) AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM marked) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256 FROM marked m JOIN under u ON u.d = m.d AND u.k = m.k LEFT JOIN nodes p ON p.d = m.d - 1 AND p.k = substr(m.k, 1, 64 * (m.d - 1))
"""


def _rules_sql() -> str:
    """The longest rule wins: rules are tried from the longest on."""
    cases = []
    for text, action in sorted(URL_RULES, key=lambda r: (-len(r[0]), r[0])):
        host, slash, rest = text.partition("/")
        cases.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + rest}')", text, action))
    case = lambda k: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[k]}'" for c in cases) + " END"
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = f"coalesce(regexp_extract({rest}, '^[^/?#]*'), '')"
    parts = f"SELECT page_id, {fold.format(host)} AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages"
    return f"SELECT page_id, host, path, {case(1)} AS rule, {case(2)} AS decided FROM ({parts})"


def _placed_sql(kind: str, pattern: str, rank: int, keep: str) -> str:
    """(doc_id, rank, kind, a, b, hit): the kept leftmost matches with their places, from the lengths of what stands between them."""
    hits = f"regexp_extract_all(t, '{pattern}')"
    cut = f"string_split_regex(t, '{pattern}')"
    lengths = f"SELECT doc_id, {hits} AS h, list_transform({cut}, lambda g: length(g)) AS g FROM texts WHERE regexp_matches(t, '{pattern}')"
    rows = f"SELECT doc_id, h[i] AS hit, CAST(list_sum(g[1:i]) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM ({lengths}))"
    return f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, a, a + length(hit) AS b, hit FROM ({rows}) WHERE {keep}"


def _base_sql(parts: list[tuple[str, str, str]], order: str) -> str:
    found = " UNION ALL ".join(_placed_sql(kind, pattern, k, keep) for k, (kind, pattern, keep) in enumerate(parts))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind, _, _ in parts)
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({found})
SELECT t.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY {order}), '')) AS base_sha256 FROM texts t LEFT JOIN found f ON f.doc_id = t.doc_id GROUP BY t.doc_id"""


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CAST(substr(reverse({_DIGITS}), k, 1) AS INTEGER) * (2 - k % 2) - CASE WHEN k % 2 = 0 AND CAST(substr(reverse({_DIGITS}), k, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END)) % 10 = 0"
PII_BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(hit, '.'), lambda p: CAST(p AS DOUBLE) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
]
ASSIGN = r'''(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?'''
SECRETS_BASE = [
    ("assign", ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(hit, '{ASSIGN}([A-Za-z0-9+/_.=-]+)', 1)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(hit) >= 20"),
    ("hex", "[0-9a-f]+", "length(hit) >= 24"),
]


def oracle_sql() -> dict[str, str]:
    """Whole results of op4, op6, op8, op11, op12 and op13, and the parts of op2, op3 and op9 that no model decides."""
    return {"op4_parity_join": OP4, "op6_vector_dedup": OP6, "op8_nearest": OP8, "op11_products": OP11, "op12_filter_audit": OP12, "op13_prefix_trie": OP13, "url_rules": _rules_sql(), "pii_base": _base_sql(PII_BASE, "rank, a"), "secrets_base": _base_sql(SECRETS_BASE, "a, rank")}
