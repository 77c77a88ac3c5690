"""Text functions: Column in, Column out, inside code generation. Patterns carry (?U) wherever Unicode classes are meant, so results do not depend on the JDK."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Private-use glyphs of symbol fonts, and what they stand for.
SYMBOLS = ("", "µ°")
#: The letters that a token may begin with are looked for first: a word boundary in Unicode's sense costs more.
STANDARDS = r"(?iU)(?=[IEUAJDG])\b(IEC|EN|UL|ASTM|ISO|DIN|JIS|GB)\b"
MARKS = r"(?iU)(?=[UVTCE])\b(UL|VDE|TUV|CSA|CQC|CE|ENEC|E\d{2,})\b"
UNITS_ANY = r"(?iU)\b(mm|cm|dm|m|km|in|ft|yd)\s*(?:\^|\*\*)?\s*{}\b"
UNITS_AREA = r"(?U)(?<![A-Za-z])(mm|cm|dm|m|km)\s*(?:\^|\*\*)?\s*2\b"
#: White space in Unicode's sense, and the four separators below the blank.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: What a cell has that normalize_cell may change: most cells have none of it and pass by one search, which looks closer only at blanks, line ends and what is not ASCII. The second one lets inner line ends pass.
UNEVEN, UNEVEN_LINES = r"(?![!-~])(?:[^ -~]|^ | (?: |\z))", r"(?![!-~])(?:[^ -~\n]|^[ \n]|\n(?: |\z)| (?:[ \n]|\z))"
#: The same for cells joined by ``|``.
UNEVEN_CELLS, UNEVEN_LINES_CELLS = r"(?![!-{])(?:[^ -~]|^ | (?:[ |]|\z)|\| )", r"(?![!-{])(?:[^ -~\n]|^[ \n]|[ \n]\z| [ \n|]|\n[ |]|\|[ \n])"
#: Characters that stand alone under NFKC: ASCII, ideographs, Hangul syllables, and full-width forms with what they stand for.
WIDE = "\u3000" + "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = " " + "".join(map(chr, range(0x21, 0x7F)))
UNSTABLE = r"[^\x00-\x7F㐀-鿿가-힣\x{3000}\x{FF01}-\x{FF5E}]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column | str) -> Column:
    """The same value under a condition that always holds but does not count as deterministic: the optimizer then computes it in one place instead of repeating it wherever it is used or filtered on."""
    return F.when(F.spark_partition_id() >= 0, col(x))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.aggregate(F.array().cast("array<int>"), x, lambda held, _: held, f)


def strip(x: Column | str) -> Column:
    """Without white space, in Unicode's sense, at both ends."""
    return F.btrim(col(x), F.lit(BLANKS))


def casefold(x: Column | str) -> Column:
    """The text folded for comparison without regard to case, ß as ss: character by character, by the standard library's table as one literal. Plain ASCII is lowered."""
    import json
    import sys

    folds = {chr(n): f for n in range(128, sys.maxunicode + 1) if not 0xD800 <= n <= 0xDFFF and (f := chr(n).casefold()) != chr(n)}
    table = F.from_json(F.lit(json.dumps(folds)), "map<string,string>")
    ascii_lower = "".join(map(chr, range(97, 123)))
    each = F.transform(F.split(col(x), ""), lambda c: F.when(c.rlike("[^\\x00-\\x7F]"), F.coalesce(F.try_element_at(table, c), c)).otherwise(F.translate(c, ascii_lower.upper(), ascii_lower)))
    return F.when(col(x).rlike("[^\\x00-\\x7F]"), F.array_join(each, "")).otherwise(F.translate(col(x), ascii_lower.upper(), ascii_lower))


def normalize_cell(x: Column | str, flatten: bool = False, superscript: bool = False) -> Column:
    """Null is empty; symbol glyphs mapped; line ends unified; blanks collapsed and stripped in each line. ``flatten`` joins non-empty lines by a blank, else inner empty lines stay."""
    given = F.coalesce(col(x), F.lit(""))
    text = F.regexp_replace(F.translate(given, *SYMBOLS), "\r\n?", "\n")
    lines = F.transform(F.split(text, "\n", -1), lambda line: strip(F.regexp_replace(line, "[ \t]{2,}", " ")))
    out = F.array_join(F.filter(lines, lambda line: line != ""), " ") if flatten else F.array_join(lines, "\n")
    out = F.when(given.rlike(UNEVEN if flatten else UNEVEN_LINES), strip(out)).otherwise(given)
    return superscript_units(out) if superscript else out


def even_cells(cells: Column, flatten: bool = False) -> Column:
    """Whether normalize_cell leaves every one of the cells as it is, told by one search over all of them. Null stands as a tab, which the search finds."""
    return ~F.array_join(cells, "|", "\t").rlike(UNEVEN_CELLS if flatten else UNEVEN_LINES_CELLS)


def match_key(x: Column | str) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "")


def key_is(x: Column | str, *keys: str) -> Column:
    """Whether match_key gives one of the keys: one search that ends at the first other letter."""
    other = "[^a-z0-9]*+"
    return F.lower(col(x)).rlike(rf"\A{other}(?:{'|'.join(''.join(c + other for c in key) for key in keys)})\z")


def superscript_units(x: Column | str) -> Column:
    """Plain 2 and 3 after a unit become ² and ³."""
    out = col(x)
    for digit, power in (("2", "²"), ("3", "³")):
        out = F.regexp_replace(out, UNITS_ANY.replace("{}", digit), "$1" + power)
    return out


def technical_units(x: Column | str) -> Column:
    """Plain 2 after a metric unit becomes ²; case matters."""
    return F.when(col(x).contains("2"), F.regexp_replace(col(x), UNITS_AREA, "$1²")).otherwise(col(x))


def label(x: Column | str) -> Column:
    """What stands before the first colon, in lower case; everything without one."""
    return F.lower(strip(F.split(normalize_cell(x), ":", 2)[0]))


def label_value(x: Column | str) -> Column:
    """What stands behind the first colon."""
    return strip(F.coalesce(F.get(F.split(normalize_cell(x), ":", 2), F.lit(1)), F.lit("")))


def tokens(x: Column | str, pattern: str) -> Column:
    """The distinct upper-case tokens in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(x), F.lit(pattern), F.lit(1)), F.upper))


def marks(x: Column | str) -> Column:
    return F.array_join(tokens(x, MARKS), ", ")


def standards(x: Column | str) -> Column:
    return F.array_join(tokens(x, STANDARDS), ", ")


def join_distinct(*values: Column) -> Column:
    """The distinct non-empty values, joined by a full-width semicolon."""
    return F.array_join(F.array_distinct(F.filter(F.array(*(strip(v) for v in values)), lambda v: v != "")), "；")


def loose_text(x: Column | str) -> Column:
    """Soft hyphens dropped, full-width comma and semicolon made plain, blanks collapsed and stripped in each line."""
    given = F.coalesce(col(x), F.lit(""))
    text = F.translate(F.regexp_replace(given, "\r\n?", "\n"), "，；­", ",;")
    lines = F.transform(F.split(text, "\n", -1), lambda line: strip(F.regexp_replace(line, "[ \t　]+", " ")))
    return F.when(given.rlike(UNEVEN), strip(F.array_join(lines, "\n"))).otherwise(given)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _normalized_grid(grids: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Every cell in NFKC, lower case, with only digits, a-z, CJK and Hangul left. Spark has no normalization function; each distinct cell of a batch is done once."""
    import re
    import unicodedata

    other = re.compile("[^0-9a-z㐀-鿿가-힣]+")
    for grid in grids:
        seen: dict[str, str] = {}

        def compact(cell: str, seen: dict[str, str] = seen) -> str:
            if cell not in seen:
                seen[cell] = other.sub("", unicodedata.normalize("NFKC", cell or "").lower())
            return seen[cell]

        yield grid.map(lambda rows: None if rows is None else [[compact(c) for c in row] for row in rows])


def stable_grid(grid: Column | str) -> Column:
    """Whether the cells are of ASCII, ideographs, Hangul syllables and full-width forms, which need no normalization beyond a table."""
    ascii = lambda c: F.length(c) == F.octet_length(c)
    return F.forall(col(grid), lambda row: let(F.array_join(row, ""), lambda joined: ascii(joined) | ~joined.rlike(UNSTABLE)))


def compact_stable(grid: Column | str) -> Column:
    """``compact_grid`` for a stable grid, inside the JVM."""
    ascii = lambda c: F.length(c) == F.octet_length(c)
    compact = lambda c: F.when(ascii(c), F.regexp_replace(F.lower(c), "[^0-9a-z]+", "")).otherwise(F.regexp_replace(F.lower(F.translate(c, WIDE, NARROW)), "[^0-9a-z㐀-鿿가-힣]+", ""))
    return F.transform(col(grid), lambda row: F.transform(row, lambda c: compact(F.coalesce(c, F.lit("")))))


def compact_any(grid: Column | str) -> Column:
    """``compact_grid`` for any grid, each in Python."""
    return _normalized_grid(col(grid))


def compact_grid(grid: Column | str) -> Column:
    """Every cell in NFKC, lower case, with only digits, a-z, CJK and Hangul left. Stable tables are not handed to Python, but a query with this column passes every row by a Python worker: where tables are written anyway, ``headers.written_candidates`` keeps stable ones from it."""
    plain = stable_grid(grid)
    return F.when(plain, compact_stable(grid)).otherwise(_normalized_grid(F.when(~plain, col(grid))))
