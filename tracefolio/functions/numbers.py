"""Numbers and years in lines of tables."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

CHANGES = ("下降", "上升", "减少", "增加", "decrease", "increase")
TOKEN = re.compile(r"\(?-?\d[\d,]*(?:\.\d+)?\)?")
DIGITS = str.maketrans("零〇○一二兩两三四五六七八九", "00012223456789")


def values(line: str | None) -> list[float]:
    """Numbers of a line up to a word of change. Footnotes and parts of dates are none; parentheses make a number negative."""
    text = unicodedata.normalize("NFKC", line or "").strip()
    for word in CHANGES:
        at = text.lower().find(word)
        if at >= 0:
            text = text[:at]
            break
    if re.fullmatch(r"\(?\d{1,2}\)?", text.strip()):
        return []
    dated = any(c in text for c in "年月-")
    solid = "".join(text.split())
    out = []
    for m in TOKEN.finditer(text):
        token = m.group()
        bare = token.strip("()").replace(",", "").replace(".", "").replace("-", "")
        if dated and (re.search(rf"{re.escape(token.strip('()'))}[年月日]", solid) or "-" in text and re.fullmatch(r"\d{1,2}", token)):
            continue
        if not bare:
            continue
        number = float(token.strip("()").replace(",", ""))
        out.append(-number if token.startswith("(") and token.endswith(")") else number)
    return out


def years(line: str | None) -> list[int]:
    """Years of a heading, in figures first, then in Chinese digits."""
    text = unicodedata.normalize("NFKC", line or "")
    out = [int(y) for y in re.findall(r"20\d{2}", text)]
    for spelled in re.findall(r"([零〇○一二兩两三四五六七八九]{4})年", text):
        year = int(spelled.translate(DIGITS))
        if 1900 <= year <= 2100:
            out.append(year)
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def line_values(s: pd.Series) -> pd.Series:
    return s.map(values)


@F.pandas_udf(ArrayType(IntegerType()))
def line_years(s: pd.Series) -> pd.Series:
    return s.map(years)
