"""Units and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefolio.functions.periods import has_any
from tracefolio.functions.text import strip

# The first rule with a token in the unit (lower case, no blanks) holds. Known quirks of the rules: 百万 without 元 falls
# through to 万; any 元 that no earlier rule takes, so also 欧元 and 日元, is CNY.
CURRENCIES = (
    ("HKD", ("hkd", "hk$", "港元", "港币", "港幣")),
    ("USD", ("usd", "us$", "美元")),
    ("CNY", ("rmb", "cny", "人民币", "人民幣", "元", "äººæ°‘", "äººæ°‘å¹£")),
)
SCALES = (
    (1_000_000.0, ("百万元", "百萬", "million", "ç™¾ä¸‡")),
    (1_000.0, ("千元", "thousand", "åƒ")),
    (100_000_000.0, ("亿元", "億元", "亿", "億", "äº¿")),
    (10_000.0, ("万元", "萬元", "万", "萬", "ä¸‡")),
    (1.0, ("元", "rmb", "cny", "hkd", "usd")),
)


def unit_key(unit: Column) -> Column:
    return F.replace(F.lower(strip(F.coalesce(unit, F.lit("")))), F.lit(" "), F.lit(""))


def ladder(key: Column, rules, kind: str) -> Column:
    out = None
    for value, tokens in rules:
        test = has_any(key, tokens)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(None).cast(kind))


def currency(unit: Column) -> Column:
    return ladder(unit_key(unit), CURRENCIES, "string")


def scale(unit: Column) -> Column:
    return ladder(unit_key(unit), SCALES, "double")


def normalized_unit(unit: Column) -> Column:
    """The currency, where the scale is known too."""
    return F.when(scale(unit).isNotNull(), currency(unit))


def parse_number(c: Column) -> Column:
    """A string to a number: edges stripped, commas out. (Underscores in digits make it null.)"""
    return F.replace(strip(c), F.lit(","), F.lit("")).try_cast("double")


def chinese_year(c: Column) -> Column:
    """Four Chinese digits to a year from 1900 to 2100; else null."""
    digits = F.translate(c, "零〇○一二兩两三四五六七八九", "00012223456789").try_cast("int")
    return F.when((F.length(c) == 4) & digits.between(1900, 2100), digits)


def spellings(value: Column) -> Column:
    """How a number may be written: plain, grouped, with two decimals; each once."""
    whole = value.cast("decimal(38,0)").cast("string")
    two = F.format_number(value, 2)
    out = F.array(F.when(value == F.floor(value), whole), F.when(value == F.floor(value), F.format_number(value, 0)), F.replace(two, F.lit(","), F.lit("")), two)
    return F.array_distinct(F.array_compact(out))


def rounded(value: Column, digits: int) -> Column:
    """Scaled, rounded half away from zero, scaled back, all in doubles, as SQL engines round one. (``F.round`` goes by the shortest spelling: it takes 64.085 up although that double times 100 lies below 6408.5.)"""
    return F.round(value * 10.0**digits) / 10.0**digits


def display_amount(value: Column, unit: Column) -> Column:
    """CNY in hundred millions with two decimals, other units whole and grouped; N/A without a value."""
    return F.when(value.isNull(), F.lit("N/A")).when(unit == "CNY", F.concat(F.replace(F.format_number(value / 1e8, 2), F.lit(","), F.lit("")), F.lit(" 亿元"))).otherwise(F.concat_ws(" ", F.format_number(value, 0), unit))
