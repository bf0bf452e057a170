"""Column expressions that clean raw names, dates, tickers and packed values. Bad values become null, never errors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date formats that are understood, besides whatever Spark reads as a timestamp.
DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "M/d/yyyy", "yyyy/M/d")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (`trim` takes spaces only). No pattern: one costs microseconds a value."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def normalize_name(c: Column) -> Column:
    """Lower case, each run of other characters than a-z and 0-9 one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalized(name: str) -> str:
    """`normalize_name` for a column's name."""
    return re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def clean_ticker(c: Column) -> Column:
    """Upper case, the first word's first run of letters, digits and `.-/` that begins with a letter or digit; else null."""
    word = F.element_at(F.split(strip(F.upper(c)), r"\s+"), 1)
    found = F.regexp_extract(word, r"([A-Z0-9][A-Z0-9.\-/]*)", 1)
    return F.when(found != "", found)


def simple_ticker(c: Column) -> Column:
    return strip(F.upper(c))


def coerce_date(c: Column) -> Column:
    """A date from a string, date or timestamp; the time of day goes, what can't be read is null."""
    text = strip(c.cast("string"))
    return F.coalesce(*[F.try_to_date(text, f) for f in DATE_FORMATS], F.to_date(F.try_to_timestamp(text)))


def number(c: Column) -> Column:
    """A finite double, else null: NaN never enters, so that null alone means missing."""
    x = strip(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def packed_ratio(c: Column, prefer: tuple[str, ...] = ("1Y", "3M")) -> Column:
    """Of `key:number;key:number`, the number of the first preferred key that has one; a later equal key wins."""
    pairs = F.filter(F.split(c, ";"), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(pairs, lambda p: F.struct(strip(F.regexp_extract(p, "^([^:]*):", 1)).alias("k"), number(F.regexp_extract(p, "(?s)^[^:]*:(.*)$", 1)).alias("v")))
    pairs = F.filter(pairs, lambda p: p["v"].isNotNull())

    def of(key: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"]

    return F.coalesce(*map(of, prefer))
