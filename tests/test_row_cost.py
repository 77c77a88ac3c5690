"""What is done for each row or table: cheaper forms give the same, and nothing is computed twice."""

import random

from pyspark.sql import functions as F

from tablesmith.functions import text
from tablesmith.operators import blocks, headers, records
from tablesmith.plans import queries


def said(column) -> str:
    return column._jc.toString()


def test_strip_takes_unicode_blanks_without_a_search(spark):
    cells = [f"{chr(n)}a{chr(n)}b{chr(n)}" for n in range(1, 0xD800)] + [chr(0x1F600) + " ", " \n\t", "", None]
    old = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    wrong = rows.where(~text.strip("c").eqNullSafe(F.regexp_replace("c", old, ""))).count()
    assert wrong == 0
    assert "regexp" not in said(text.strip("c"))


def test_a_key_is_told_without_building_it(spark):
    cells = ["alternative", " Alter-native!", "ALTERNATIVE 1", "alternativ", "xalternative", "No.", "n o", "number", "NUM BER:", "nor", "", None, "K", "nİo"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    for keys in (("alternative",), ("no", "number")):
        got = rows.select(text.key_is("c", *keys).alias("a"), text.match_key("c").isin(*keys).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]


def test_records_are_projected_once(spark):
    assert said(records.merged(F.col("given_records"), F.lit("x"))).count("given_records") == 1


def test_blocks_read_their_texts_once(spark):
    head = lambda n: [[f"Alternative {k}", ""] if k % 3 == 0 else ["Designation: x" if k % 3 == 1 else "Rating: 5 V, EN 1", "CE"] for k in range(n)]
    rows = spark.createDataFrame([(head(30),)], "grid array<array<string>>")
    got = rows.select(F.explode(blocks.block_records(F.col("grid"))).alias("r")).select("r.row", "r.f").collect()
    assert [r.row for r in got] == list(range(0, 30, 3)) and got[1].f[2] == "x CE"
    assert said(blocks.block_records(F.col("grid"))).count("balternative") <= 2


def plain_ordered(rows):
    def tests(n):
        return ["object" in n and "part" in n and ("no" in n or "number" in n), "manufacture" in n and "trademark" in n, "type" in n and "model" in n, "technical" in n and "data" in n, "standard" in n, "mark" in n and "conform" in n]

    rows = rows[:12]
    for i in range(len(rows)):
        both = [(i + 1, rows[i])] + ([(i + 2, [a + b for a, b in zip(rows[i], rows[i + 1])])] if i + 1 < len(rows) else [])
        for start, cells in both:
            at = []
            for k, n in enumerate(cells):
                if len(at) < 6 and tests(n)[len(at)]:
                    at.append(k)
            if len(at) == 6 and at[5] - at[0] <= 9:
                return start, at


def plain_greedy(cells, hints):
    out = [-1] * len(hints)
    for at, n in enumerate(cells):
        k = next((k for k, h in enumerate(hints) if out[k] == -1 and any(x in n for x in h)), None)
        if k is not None:
            out[k] = at
    return out


def plain_strict(rows):
    rows, best = rows[:10], None
    for i in range(len(rows)):
        both = [(2 * i, i + 1, rows[i])] + ([(2 * i + 1, i + 2, [a + b for a, b in zip(rows[i], rows[i + 1])])] if i + 1 < len(rows) else [])
        for order, start, cells in both:
            m = plain_greedy(cells, headers.STRICT)
            n = sum(c >= 0 for c in m)
            if best is None or (n, -order) > best[:2]:
                best = (n, -order, start, m)
    return (best[2], best[3]) if best and best[0] >= 5 and best[3][0] >= 0 else None


def plain_loose(rows):
    best = None
    for i, cells in enumerate(rows[:6]):
        m = plain_greedy(cells, headers.LOOSE)
        n = sum(c >= 0 for c in m)
        if best is None or n > best[0]:
            best = (n, i + 1, m)
    return (best[1], best[2]) if best and best[0] >= 4 else None


def test_header_searches_that_skip_tables_find_what_a_plain_search_finds(spark):
    rng = random.Random(7)
    words = ["objectpartno", "manufacturertrademark", "typemodel", "technicaldata", "standard", "marksofconformity"]
    cases = []
    for _ in range(300):
        head = list(words)
        for _ in range(rng.choice([0, 0, 1, 2])):
            head[rng.randrange(6)] = rng.choice(["", "x", "mark", "objectpart", "type"])
        if rng.random() < 0.2:
            rng.shuffle(head)
        cut = [rng.choice([0, 0, rng.randrange(len(h) + 1)]) for h in head]  # a hint may be cut between two rows
        rows = [["x"] * 6 for _ in range(rng.choice([0, 1, 5, 9, 11]))]
        rows += [[h[:c] for h, c in zip(head, cut)], [h[c:] for h, c in zip(head, cut)]] if rng.random() < 0.6 else [head]
        if rng.random() < 0.3:
            rows.append(list(words))
        cases.append(rows + [["y"] * 6])
    frame = spark.createDataFrame(list(enumerate(cases)), "k int, n array<array<string>>")
    found = {"ordered": (headers.ordered_header, plain_ordered), "strict": (headers.strict_header, plain_strict), "loose": (headers.loose_header, plain_loose)}
    got = frame.select("k", *(f(F.col("n")).alias(name) for name, (f, _) in found.items())).collect()
    for r in got:
        for name, (_, plain) in found.items():
            want = plain(cases[r.k])
            assert (None if r[name] is None else (r[name].start_row, list(r[name].mapping))) == want, (name, cases[r.k])
    assert len([r for r in got if r.strict]) > 50 and len([r for r in got if r.ordered]) > 50
    # the first hit ends the search: the mapping is folded in one place, not gathered for all rows first
    assert "array_sort" not in said(headers.ordered_header(F.col("n"))) and "array_sort" not in said(headers.strict_header(F.col("n")))


def test_a_small_file_is_dealt_to_all_tasks(spark, tmp_path):
    spark.range(200).selectExpr("id as p_partkey", "'b' as p_brand", "'n' as p_name", "int(id % 50) as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("alternative_blocks", "header_limits"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 1 and got.count() == 200


def test_only_tables_that_need_normalization_pass_by_python(spark):
    from tablesmith.operators import headers as h

    plain, other = [["ＡＢ 證書", "Part No."], ["x", None]], [["mm²", "ﬁ"], ["é", "K"]]
    rows = spark.createDataFrame([("a", plain), ("b", other)], "doc_id string, grid array<array<string>>")
    got = {r.doc_id: r.compacts for r in h.written_candidates(rows, searched=False).collect()}
    want = {r.doc_id: r.compacts for r in h.describe(rows, searched=False).collect()}
    assert got == want == {"a": [["ab證書", "partno"], ["x", ""]], "b": [["mm2", "fi"], ["", "k"]]}
    plan = h.written_candidates(rows.where("doc_id = 'a'"), searched=False)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_extraction_without_such_tables_starts_no_python_worker(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from tablesmith.operators import phases, templates  # noqa: F401
    from tablesmith.operators import headers as h

    plans, real = [], h.written

    def watched(df: DataFrame, name: str) -> DataFrame:
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(h, "written", watched)
    grid = [["Object / part No.", "Manufacturer / trademark", "Type / model", "Technical data", "Standard", "Mark(s) of conformity"], ["Part 1", "S", "A-1", "5 mm2", "EN 60335-1", "CE"]]
    tables = spark.createDataFrame([("d", "pdfplumber_lines", 1, 1, 1, grid)], "doc_id string, engine string, page int, table_index int, arrival_seq long, grid array<array<string>>")
    assert phases.extract(tables).count() == 1
    assert plans and not any("ArrowEvalPython" in p for p in plans)


def test_a_models_table_is_read_once(spark):
    import itertools
    import re

    from tablesmith.operators import models

    assert said(models.table_matches(F.col("some_grid"))).count("some_grid") == 1
    table = [["Model", "Brand name"], ["A-1", "b"], ["Models:", "K-1"], ["", "b"], ["A-3", "b"]]
    rows = spark.createDataFrame([(table,)], "grid array<array<string>>")
    got = [m.raw for m in rows.select(models.table_matches(F.col("grid")).alias("m")).collect()[0].m]
    assert got == ["A-1\nModels:", "K-1"]

    cells = ["".join(p) for k in range(4) for p in itertools.product(" \na\t\r，　", repeat=k)]
    frame = spark.createDataFrame([(c,) for c in cells], "c string")
    for r in frame.select("c", text.loose_text("c").alias("n")).collect():
        lines = r.c.replace("\r\n", "\n").replace("\r", "\n").replace("，", ",").split("\n")
        assert r.n == "\n".join(re.sub("[ \t　]+", " ", line).strip() for line in lines).strip(), repr(r.c)


def test_tokens_are_found_as_by_the_plain_patterns(spark):
    plain = {text.STANDARDS: r"(?iU)\b(IEC|EN|UL|ASTM|ISO|DIN|JIS|GB)\b", text.MARKS: r"(?iU)\b(UL|VDE|TUV|CSA|CQC|CE|ENEC|E\d{2,})\b"}
    ends = ["EC 1", "SO", "N", "B", "IS", "L-", "E", "12", "DE", "IN", "STM", " EN", "xEN"]
    rows = spark.createDataFrame([(chr(n) + e,) for n in range(1, 0xD800) for e in ends[: 13 if n < 0x250 or n > 0x2100 and n < 0x2200 else 1]], "c string")
    for new, old in plain.items():
        assert new != old and rows.where(F.col("c").rlike(new) != F.col("c").rlike(old)).count() == 0


def plain_window(row):
    import re

    best = None
    for s in range(len(row) - 5):
        c = row[s : s + 6]
        n = sum(bool(x) for x in c)
        has = lambda x, p: x is not None and re.search(p, x, re.I)
        p = 2 * n - (6 if n < 4 else 0) + (2 if has(c[0], "alternative|varistor|object|part") else 0) + (1 if has(c[3], "[:\n]") else 0) + (3 if has(c[4], r"\b(IEC|EN|UL)\b") else 0) + (4 if has(c[5], r"\b(UL|CE)\b") else 0)
        if p >= 6 and (best is None or p > best[0]):
            best = (p, s)
    return best and best[1]


def test_windows_of_exploded_rows_are_those_of_whole_tables(spark):
    from tablesmith.operators import records as r

    rng = random.Random(3)
    cells = ["", "", "x", "Part 1", "5 A: 2", "a\nb", "EN 1", "CE", "UL", "y"]
    tables = [[[rng.choice([*cells, None] if k % 5 == 0 else cells) for _ in range(wide)] for _ in range(3)] for k in range(300) for wide in [rng.choice([3, 6, 7, 8, 13, 14, 20])]]
    tables += [[["x", "Part 1", "m", "t", "5 mm2", "EN 1", "CE", "y"]]]
    frame = spark.createDataFrame(list(enumerate(tables)), "doc_id int, grid array<array<string>>")
    at = frame.select("doc_id", F.transform("grid", headers.six_window).alias("a"), F.posexplode("grid").alias("row", "cells")).select("doc_id", "row", F.get("a", "row").alias("a"), headers.six_window_flat(F.col("cells")).alias("b")).collect()
    for x in at:
        assert x.a == x.b == plain_window(tables[x.doc_id][x.row]), tables[x.doc_id][x.row]
    whole = frame.select("doc_id", F.explode(r.window_records(F.col("grid"))).alias("r")).select("doc_id", "r.row", "r.f").collect()
    assert sorted(map(str, r.window_rows(frame, "doc_id").collect())) == sorted(map(str, whole)) and len(whole) > 50
    assert whole[-1].f == ["Part 1", "m", "t", "5 mm²", "EN 1", "CE"]


def test_tables_are_scored_by_one_search_as_cell_by_cell(spark):
    import math
    import re

    from tablesmith.operators import grid

    assert "exists" not in said(text.even_cells(F.col("c")))
    rng = random.Random(5)
    cells = ["a", "7", "²", "-", "--\x1f-", "a\x1f-", "-\x1fa", "a\nb", "é" * 25, "x" * 24, " pad ", "", "", None, "①"]
    pools = [cells, ["a", "7"], ["a", ""], ["-", "a"], ["a\x1f-", "b"], [""]]
    tables = [[[rng.choice(pool) for _ in range(rng.choice([wide, wide, wide - 1]))] for _ in range(rng.randrange(5))] for _ in range(300) for pool in [rng.choice(pools)] for wide in [rng.randrange(1, 5)]]
    frame = spark.createDataFrame(list(enumerate(tables)), "doc_id int, grid array<array<string>>")
    for x in grid.score(grid.clean(frame)).collect():
        wide = max(map(len, tables[x.doc_id]), default=0)
        rows = [[plain_cell(c) for c in [*row, *[None] * (wide - len(row))]] for row in tables[x.doc_id]]
        rows = [row for row in rows if any(row)]
        kept = [k for k in range(wide) if any(row[k] for row in rows)]
        rows = [[row[k] for k in kept] for row in rows]
        assert (x.grid, x.n_rows, x.n_cols) == (rows, len(rows), len(kept) if rows else 0)
        flat, n = [c for row in rows for c in row if c], len(rows) * len(kept)
        if n:
            full = [sum(map(bool, row)) for row in rows]
            spread = math.sqrt(sum((f - sum(full) / len(rows)) ** 2 for f in full) / len(rows))
            textual = sum(bool(re.search("[^\\W_]|[²①]", c)) for c in flat)
            want = (35 * len(flat) + 20 * textual + 8 * sum(len(c) >= 25 for c in flat) + 7 * sum("\n" in c for c in flat)) / n + 15 / (1 + spread) + 3 * math.log1p(n) - 20 * (len(rows) < 2 or len(kept) < 2)
            assert abs(x.score - want) < 1e-9, tables[x.doc_id]


def plain_cell(c):
    return "\n".join(line.strip() for line in (c or "").split("\n")).strip()


def test_tables_without_a_headers_letters_are_not_searched(spark):
    head = ["Object / part No.", "Manufacturer / trademark", "Type / model", "Technical data", "Standard", "Mark(s) of conformity"]
    cut = [[h[: k + 2] for k, h in enumerate(head)], [h[k + 2 :] for k, h in enumerate(head)]]
    plain = [["Part 1", "Supplier 2", "R-1", "5 mm²", "EN 1", "CE"]]
    marks = ["TABLE : x", "LIST-OF com\npressor", "Critical componentſ information", "Critical components inFORMation", "Compressor  list", "table", "tab le:", "İTABLE:"]
    tables = [[head, *plain], [*cut, *plain], plain, [["OB", "ject part no"]], [[""]], *([[m, *[""] * 5], *rows] for m in marks for rows in ([head, *plain], plain))]
    frame = spark.createDataFrame(list(enumerate(tables)), "k int, grid array<array<string>>")
    for broad in (True, False):
        found = headers.describe(frame, templates=False, broad=broad)
        norms = F.transform(F.slice("grid", 1, 12), lambda r: F.transform(r, text.match_key))
        whole = F.array_join(F.flatten("grid"), " ")
        ordered, strict = headers.ordered_header(F.col("n")), headers.strict_header(F.col("n"))
        want = frame.withColumn("n", norms).select("k", F.coalesce(ordered, strict).alias("best"), headers.kind_of(text.match_key(whole)).alias("kind"), (text.match_key(whole).contains("table") & whole.rlike(r"(?iU)\btable\s*:")).alias("has_marker"))
        got = found.select("k", "best", "kind", "has_marker")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert got.where("best is not null").count() == 2 + len(marks) and got.where("kind is not null").count() >= 6
        assert "Contains(__low" in found._jdf.queryExecution().optimizedPlan().toString()


def test_rows_without_blanks_pass_the_tests_of_titles_and_rests_at_once(spark):
    from tablesmith.operators import records as r

    cells = ["", " ", "　", "x", " x", "é", "Relay:", " Relay: ", "alternative", " Remark a", "remark b ", "No.", "Object part no", None]
    rows = spark.createDataFrame([([a, b, c],) for a in cells for b in cells for c in ("", "y")], "c array<string>")
    some = F.filter(F.transform("c", text.strip), lambda c: c != "")
    one = rows.select("c", some.alias("s"), r.section_title(F.col("c")).alias("t"), r.wrapped(F.col("c")).alias("w"), r.noise(F.concat("c", F.array(*[F.lit("")] * 3))).alias("n"), (text.strip(F.get("c", F.lit(0))) == "").alias("blank")).collect()
    for x in one:
        assert x.t is None or len(x.s) == 1 and x.t == x.s[0]
        if len(x.s) == 1 and x.s[0] == "Relay:":
            assert x.t == "Relay:"
        rest = (x.c[0] or "").lower() == "alternative" and sum(c is not None and c != "" for c in x.c[1:]) <= 1
        assert x.w == (None if x.c[0] is None and not rest else x.blank or rest), x.c
        if None not in x.c:
            assert x.n == (x.c[0].strip().lower().startswith("remark") or x.c[0] == "Object part no" or x.c[0] == "No." and not any(c.strip() for c in x.c[1:])), x.c
    assert said(r.wrapped(F.col("c"))).count("<") > 1
