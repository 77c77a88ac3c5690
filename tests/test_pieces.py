"""Models, splitting, cards, payloads, files and sheets."""

import pytest
from pyspark.sql import functions as F

from tablesmith.functions import numbers, text
from tablesmith.operators import cards, models, payload, split
from tablesmith.sinks import sheets
from tablesmith.sources import files, requests


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("word", "number"), [("十", 10), ("二十", 20), ("一百零五", 105), ("两", 2), ("二三", 3), ("12", 12), ("x", None)])
def test_numerals(spark, word, number):
    assert one(spark, word, numbers.numeral) == number


def test_normalize_cell_is_idempotent_and_keeps_inner_lines(spark):
    raw = " a \t\tb\r\n\r\n c  d　"
    assert one(spark, raw, text.normalize_cell) == "a b\n\nc d"
    assert one(spark, raw, lambda c: text.normalize_cell(text.normalize_cell(c))) == "a b\n\nc d"
    assert one(spark, raw, lambda c: text.normalize_cell(c, flatten=True)) == "a b c d"
    assert one(spark, None, text.normalize_cell) == ""


@pytest.mark.parametrize(("cell", "pairs"), [("KFR-35GW样机 十二台, W19-AB1 3台", [("KFR-35GW", 12), ("W19-AB1", 3)]), ("X1-2 and AB-9", [("X1-2", None), ("AB-9", None)]), ("无", [("无", None)]), (" ", [])])
def test_details(spark, cell, pairs):
    assert [(r["model"], r["cnt"]) for r in one(spark, cell, split.details)] == pairs


def test_model_rules_and_status(spark):
    pages = spark.createDataFrame([("a", "a.pdf", "/a.pdf", 1, "Model / Type reference .....: QX-12A, QX-\n14B; rating 5\nRatings: 220V"), ("a", "a.pdf", "/a.pdf", 2, "Models: QX-1"), ("b", "b.pdf", "/b.pdf", 1, "none")], "doc_id string, file_name string, path string, page int, text string")
    rows = models.models(pages).orderBy("doc_id", "ord").collect()
    assert [(r["file_name"], r["model"], r["status"]) for r in rows] == [("a.pdf", "QX-12A", models.FOUND), ("a.pdf", "QX-14B", models.FOUND), ("b.pdf", None, models.NOT_FOUND)]


def test_model_list_stops_at_the_blank(spark):
    table = spark.createDataFrame([([["Model", "Brand name", "Rating"], ["AB-1", "Z", "5 A"], ["AB-2", "Z", "5 A"], ["", "", ""], ["AB-3", "Z", "5 A"]],)], "g array<array<string>>")
    assert [m["raw"] for m in table.select(models.table_matches(F.col("g")).alias("m")).first()["m"]] == ["AB-1\nAB-2"]


CARD = '<article class="Box-row"><h2><a href="/own/card">own / card</a></h2><p class="color-fg-muted">Reads tables with AI.{}</p><span itemprop="programmingLanguage">Python</span><a href="/own/card/stargazers">2,004,001</a><a href="/own/card/forks">5,700</a><span class="float-sm-right">9 stars today</span></article>'


def test_card(spark):
    pages = spark.createDataFrame([(CARD.format(""),), (CARD.format("<br>"),), (None,)], "html string")
    rows = cards.assessed(cards.cards(pages)).collect()
    assert [(r["name"], r["language"], r["stars"], r["forks"], r["stars_today"]) for r in rows] == [("own/card", "Python", 2004001, 5700, 9)] * 2
    assert rows[0]["scenario"] == cards.AI and rows[0]["usability"] == cards.TIERS[0][2] and rows[0]["learnable"]
    assert cards.cards(pages, strict=True).count() == 1


def test_payload(spark):
    assert one(spark, "p", lambda c: payload.request_json(c, F.lit("m"), F.lit(""), F.lit(None).cast("string"))) == '{"model":"m","prompt":"p"}'
    assert bytes(one(spark, '{"data":[{"b64_json":"ZmFrZS1pbWFnZQ=="}]}', payload.image_bytes)) == b"fake-image"
    assert one(spark, '{"data":[{"b64_json":"@@@@"}]}', payload.image_bytes) is None
    assert one(spark, "{}", payload.image_status) == payload.BAD


def test_page_ranges():
    assert files.page_ranges("all") is None and files.page_ranges("1,3-5") == [(1, 1), (3, 5)]
    with pytest.raises(ValueError):
        files.page_ranges("x")


def test_workbook_round_trip_and_sheet_split(spark, tmp_path):
    rows = [["no", split.DETAIL], ["1", "AB-1 2台, AB-2 十台"], ["2", ""], ["", ""]]
    (tmp_path / "a.xlsx").write_bytes(sheets.workbook({"s": [["title"], *rows]}))
    read = files.read_workbooks(spark, str(tmp_path))
    out = split.split_sheet(read).orderBy("row_index", "at").collect()
    assert [(r["values"][0], r["model"], r["cnt"]) for r in out] == [("1", "AB-1", 2), ("1", "AB-2", 10), ("2", "", None)]
    made = sheets.workbooks(spark.createDataFrame([("d", 1, "x"), ("d", 2, None)], "doc_id string, n int, v string")).first()
    assert [v for *_, v in files.sheet_rows(bytes(made["content"]))] == [["n", "v"], ["1", "x"], ["2", ""]]


def test_prompt(spark):
    assert one(spark, "﻿from file ", lambda c: files.prompt("literal" and F.lit("literal"), c)) == "from file"
    with pytest.raises(Exception, match="prompt must not be empty"):
        one(spark, " ", lambda c: files.prompt(c))


def test_sheets_stand_where_the_relations_say_and_a_broken_file_gives_an_error_row(spark, tmp_path):
    import zipfile

    book = sheets.workbook({"first": [["a"]], "second": [["b"]]})
    (tmp_path / "plain.xlsx").write_bytes(book)
    with zipfile.ZipFile(tmp_path / "plain.xlsx") as old, zipfile.ZipFile(tmp_path / "moved.xlsx", "w") as new:
        for name in old.namelist():
            content = old.read(name)
            if name.endswith("workbook.xml.rels"):
                content = content.replace(b"sheet1.xml", b"x.xml").replace(b"sheet2.xml", b"sheet1.xml").replace(b"x.xml", b"sheet2.xml")
            new.writestr(name, content)
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    rows = {(r["path"].rsplit("/", 1)[1], r["sheet"]): r["values"] for r in files.read_workbooks(spark, str(tmp_path)).collect()}
    assert rows["plain.xlsx", "first"] == ["a"] and rows["moved.xlsx", "first"] == ["b"] and rows["moved.xlsx", "second"] == ["a"]
    assert "BadZipFile" in rows["broken.xlsx", "error"][0]


def test_the_first_of_a_repeated_setting_counts(spark):
    lines = spark.createDataFrame([(1, "A = '1'"), (2, "# A=0"), (3, "A=2"), (4, "no setting"), (5, "B=x=y")], "n int, value string")
    assert {r["key"]: r["value"] for r in files.settings(lines.repartition(3), order="n").collect()} == {"A": "1", "B": "x=y"}


@pytest.fixture
def stub():
    """A server that counts the payloads it is sent and refuses those that say so."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body["prompt"]))
            good = not body["prompt"].startswith("bad")
            self.send_response(200 if good else 400)
            self.end_headers()
            self.wfile.write(b'{"data":[{"b64_json":"ZmFrZQ=="}]}' if good else b"refused")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/", seen
    server.shutdown()


def test_requests_are_sent_once(spark, tmp_path, stub):
    url, seen = stub
    ask = lambda *prompts: spark.createDataFrame([(k, None if p is None else f'{{"prompt":"{p}"}}', "x") for k, p in enumerate(prompts)], "id int, payload string, body string")
    folder = str(tmp_path / "ledger")
    first = ask("one", "bad two", "one", None, "three")
    found = requests.answered(first, folder, url, "key", 5).withColumn("image", payload.image_bytes("body")).orderBy("id").collect()
    assert [bytes(r["image"]) if r["image"] else None for r in found] == [b"fake", None, b"fake", None, b"fake"]
    assert [r["error"] for r in found] == [None, "HTTP 400: refused", None, "no payload", None]
    assert sorted(s[2] for s in seen) == ["bad two", "one", "three"] and seen[0][:2] == ("/v1/images/generations", "Bearer key")
    requests.answered(ask("one", "bad two", "four"), folder, url, "key", 5).collect()
    assert sorted(s[2] for s in seen) == ["bad two", "bad two", "four", "one", "three"]  # what was refused is asked again
    assert requests.answered(first.limit(0), folder, url, "key", 5).count() == 0


def test_a_task_that_fails_halfway_repeats_nothing(spark, tmp_path, stub):
    url, seen = stub
    asked = spark.createDataFrame([(f'{{"prompt":"p{k}"}}',) for k in range(12)], "payload string")
    names = sorted(r[0] for r in asked.select(requests.request_id(url, F.col("payload"))).collect())
    folder = tmp_path / "ledger"
    folder.mkdir()
    (folder / names[7][:2]).write_text("in the way")  # the eighth cannot be claimed: its task fails there
    with pytest.raises(Exception, match="ledger"):
        requests.answered(asked, str(folder), url, "key", 5, parallel=1)
    before = len(seen)
    assert 0 < before < 12
    (folder / names[7][:2]).unlink()
    found = requests.answered(asked, str(folder), url, "key", 5, parallel=3).collect()
    assert len(seen) == 12 == len({s[2] for s in seen}) and all(r["body"] for r in found)
    # a claim without an answer: the request may have been served
    path = folder / names[3][:2] / names[3]
    path.with_suffix(".json").unlink()
    again = {r["request"]: r["error"] for r in requests.answered(asked, str(folder), url, "key", 5).collect()}
    assert again[names[3]] == "unknown outcome" and len(seen) == 12
    requests.answered(asked, str(folder), url, "key", 5, repeat_unknown=True).collect()
    assert len(seen) == 13 and requests.answered(asked, str(folder), url, "key", 5).where("body is null").count() == 0


def test_cards_read_entities_quotes_and_nesting(spark):
    page = "<article class='x Box-row y'><h2 class=h><a class='l' href='/o/r-1'><b>o</b> / r</a></h2><p class='a color-fg-muted'>A &amp; B <i>it</i>&#39;s</p></article><article class='Box-rows'><h2><a href='/no/no'>x</a></h2></article><article class=\"Box-row\"><h2>no link</h2></article><article class=\"Box-row\"><h2><a href=\"/not/closed\">x</a></h2>"
    rows = cards.cards(spark.createDataFrame([(page,)], "html string")).collect()
    assert [(r["name"], r["url"], r["description"], r["language"], r["stars"]) for r in rows] == [("o/r-1", "https://github.com/o/r-1", "A & B it's", cards.UNKNOWN, 0)]


def test_cards_as_intervals(spark):
    named = "<h2><a href='/a/b'>t</a></h2>"
    pages = [
        # an article within the card belongs to it, whatever its class; what follows still counts
        ("nested", f"<article class=Box-row>{named}<article class=x><p>no</p></article><a href=/a/b/stargazers>1,204 stars</a></article>"),
        # a card within a card takes its place
        ("inner", f"<article class='Box-row'>{named}<article class='Box-row'><h2><a href='/c/d'>t</a></h2></article><p class='color-fg-muted'>lost</p></article>"),
        ("entities", f"<article class='Box-row'>{named}<p class='color-fg-muted'>A &mdash; b&#8217;s &#x1F600; &notin; &notit; &amp;lt; &#150; R&D &nope; &CounterClockwiseContourIntegral;</p></article>"),
        # of an element within another one that a selector finds, the inner counts; the outer then has none
        ("overlap", f"<article class='Box-row'>{named}<p class='color-fg-muted'>out <span itemprop='programmingLanguage'>Rust</span> after</p><span class='d float-sm-right'><b>7</b> today</span></article>"),
        # links beyond the heading are no names, comments and scripts hold no tags
        ("beyond", f"<!-- <article class='Box-row'> --><article class='Box-row'>{named}<a href='/x/y'>x</a><script>if (a</article>b) </script><a href='/z/forks'>3</a></article>"),
        ("void", f"<article class='Box-row'>{named}<p class='color-fg-muted'>one<br>two<img src='a>b'/></p></article>"),
        ("none", None),
        ("empty", ""),
        ("twice", f"<article class='Box-row'>{named}</article><article class='Box-row'><h2><a href='/e/f'>t</a></h2></article>"),
    ]
    df = spark.createDataFrame(pages, "page string, html string").repartition(3)
    found = {}
    for r in cards.cards(df, keep=("page",)).orderBy("page", "at").collect():
        found.setdefault(r["page"], []).append((r["name"], r["description"], r["language"], r["stars"], r["forks"], r["stars_today"]))
    bare = ("a/b", "", cards.UNKNOWN, 0, 0, 0)
    assert found == {
        "nested": [("a/b", "", cards.UNKNOWN, 1204, 0, 0)], "inner": [("c/d", "", cards.UNKNOWN, 0, 0, 0)],
        "entities": [("a/b", "A — b’s \U0001f600 ∉ ¬it; &lt; – R&D &nope; ∳", cards.UNKNOWN, 0, 0, 0)], "overlap": [("a/b", "", "Rust", 0, 0, 7)],
        "beyond": [("a/b", "", cards.UNKNOWN, 0, 3, 0)], "void": [("a/b", "onetwo", cards.UNKNOWN, 0, 0, 0)], "twice": [bare, ("e/f", *bare[1:])],
    }
    assert {r["page"] for r in cards.cards(df, strict=True, keep=("page",)).collect()} == set(found) - {"void"}
    assert cards.cards(df.limit(0)).count() == 0 and cards.cards(df).columns == ["at", *cards.FIELDS]


def test_every_character_reference_is_read(spark):
    import html
    from html.entities import html5

    texts = [f"x&{n}y &{n}" for n in html5] + [f"&#{n};&#x{n:x}z" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**9, 10**30]] + ["&", "&&", "&#;", "&#x;", "a & b", "&#0000000000000000000065;", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    mine = {r["n"]: r["u"] for r in df.select("n", cards.unescaped(F.col("t")).alias("u")).collect()}
    assert [(texts[n], mine[n]) for n in mine if mine[n] != html.unescape(texts[n])] == []


def test_pages_are_fetched_and_failures_are_rows(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Stub(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()
            self.wfile.write(b"<p>caf\xc3\xa9 \xff</p>")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = files.fetch(spark.createDataFrame([(1, f"{base}/ok"), (2, f"{base}/no"), (3, None), (4, "no url")], "id int, url string"), timeout=5).orderBy("id").collect()
    server.shutdown()
    assert (rows[0]["html"], rows[0]["error"]) == ("<p>café \ufffd</p>", None)
    assert rows[1]["html"] is None and rows[1]["error"] == "HTTP 404"
    assert all(r["html"] is None and r["error"].startswith("request failed") for r in rows[2:])


def test_case_folding_is_that_of_the_standard_library(spark):
    rows = [(n, f"x{chr(n)}Y") for n in [*range(0x3000), *range(0xA640, 0xAC00), *range(0xFB00, 0xFB20), *range(0xFF00, 0xFF60), *range(0x10400, 0x10440), *range(0x1E900, 0x1E930)]]
    mine = {r["n"]: r["f"] for r in spark.createDataFrame(rows, "n int, t string").select("n", text.casefold("t").alias("f")).collect()}
    assert [t for n, t in rows if mine[n] != t.casefold()] == []
    pages = spark.createDataFrame([("d", "f", "p", 1, "Model/Type reference: STRASSE-1, straße-1, Straße-2")], "doc_id string, file_name string, path string, page int, text string")
    assert [r["model"] for r in models.models(pages).orderBy("ord").collect()] == ["STRASSE-1", "Straße-2"]
