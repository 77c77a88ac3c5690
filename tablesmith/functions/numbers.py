"""Numbers written in words or with separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Digits and units of the numerals.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100}


def numeral(x: Column | str) -> Column:
    """The integer of a run of digits, or of numerals: a digit is held until a unit multiplies it (1 without one). Other text is null."""
    text = col(x)
    digit, unit = (F.create_map(*(F.lit(v) for pair in table.items() for v in pair)) for table in (DIGITS, UNITS))

    def step(s: Column, c: Column) -> Column:
        times = F.try_element_at(unit, c)
        held = F.when(s["held"] == 0, 1).otherwise(s["held"])
        return F.struct((s["total"] + F.coalesce(held * times, F.lit(0))).alias("total"), F.coalesce(F.try_element_at(digit, c), F.lit(0)).alias("held"))

    total = F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("total"), F.lit(0).alias("held")), step, lambda s: s["total"] + s["held"])
    words = "^[" + "".join((*DIGITS, *UNITS)) + "]+$"
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).when(text.rlike(words), total)


def grouped_number(x: Column | str) -> Column:
    """The first run of digits and commas, without the commas; else 0."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(col(x), "[0-9,]+", 0), ",", "").try_cast("bigint"), F.lit(0).cast("bigint"))
