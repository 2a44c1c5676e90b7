"""Answers made fit to be shown: internal references out, periods spelled, amounts in millions given in hundred millions too.

A text is read once, token by token: groups in brackets, words, amounts, everything else. A group's inside is read in the same way, and a group of which nothing
but separators is left goes. Lines are laid out afterwards.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Units of a million, how they are shown, and the unit of a hundred millions.
MILLIONS = {"人民币": ("百万元", "亿元"), "人民幣": ("百万元", "亿元"), "港币": ("港币百万元", "亿港元"), "港幣": ("港币百万元", "亿港元"), "港元": ("港币百万元", "亿港元"), "美元": ("美元百万元", "亿美元"), "rmb": ("RMB million", "亿元"), "hkd": ("HKD million", "亿港元"), "usd": ("USD million", "亿美元")}
SAID_ALREADY = "即"
# What a place in a document is described by; how periods are spelled.
PLACE_WORDS = ("period", "期间", "財務摘要表", "财务摘要表", "table row", "metric tags")
PERIODS = {"fy": "{}年", "q3": "{}年前三季度累计", "h1": "{}年上半年"}
# A number that strays into answers before these words.
STRAY = {"16": ("日均", "余额", "占比", "平均余额", "平均成本率", "利息支出")}
SEPARATORS = "、,，;；:：|/- \t\n"

_CHINESE = "|".join(k for k in MILLIONS if not k.isascii())
_LATIN = "|".join(k for k in MILLIONS if k.isascii())
_UNIT = rf"(?:(?P<zh>{_CHINESE})百[万萬]元|(?P<en>{_LATIN})\s*million|million\s*(?P<ne>{_LATIN}))"
_TOKEN = re.compile(
    rf"(?P<amount>-?\d+(?:,\d{{3}})*(?:\.\d+)?)\s*(?:{_UNIT}|[（(]\s*(?:[单單]位)?\s*[:：]?\s*{_UNIT.replace('?P<', '?P<in_')}\s*[）)])"
    r"|(?P<group>[（(\[][^（）()\[\]]*[）)\]])"
    r"|(?P<word>\b[A-Za-z][A-Za-z0-9_]*(?:\s*=\s*[-+]?[\w.-]*\w)?)"
    r"|(?P<stray>(?<!\d)\s*(?:" + "|".join(STRAY) + r")\s*(?=(?:" + "|".join(w for ws in STRAY.values() for w in ws) + r")))"
    r"|\d+|.",
    re.I | re.S,
)
_PERIOD = re.compile(r"(?:(fy)(20\d\d)|(q3)_(20\d\d)_ytd|(h1)_(20\d\d))", re.I)


def is_place(inside: str) -> bool:
    """Does a group say where in a document something stands, and of which kind it is?"""
    page = re.match(r"\s*(?:第\s*)?\d+\s*页", inside) or re.search(r"page\s*\d+", inside, re.I)
    rest = inside[page.end() :].lower() if page else ""
    return "\n" not in inside and (any(w in rest for w in PLACE_WORDS) or bool(re.search(r"fy20\d\d", rest)))


def shown_group(group: str) -> str:
    inside = group[1:-1]
    if re.match(r"chunk\s.", inside, re.I | re.S) and group[0] != "（" or group[0] in "（(" and is_place(inside):
        return ""
    inside = "".join(shown_tokens(inside))
    return "" if group[0] in "（(" and not inside.strip(SEPARATORS) else group[0] + inside + group[-1]


def shown_word(word: str) -> str:
    """Nothing for a reference or a search's own remark; a period as it is spelled."""
    if re.fullmatch(r"(?:DOC|WEB)_\d+", word) or re.fullmatch(r"(?:source\s*=\s*[\w-]+|score\s*=\s*[-+]?\d*\.?\d+)", word, re.I):
        return ""
    if m := _PERIOD.fullmatch(word):
        kind, year = (g for g in m.groups() if g)
        return PERIODS[kind.lower()].format(year)
    if "=" in word:  # some other word before the sign
        name, rest = re.match(r"(\w+)(.*)", word, re.S).groups()
        return shown_word(name) + "".join(shown_tokens(rest))
    return word


def shown_amount(m: re.Match) -> str:
    """An amount, followed by the same one in hundred millions, unless the text says that itself."""
    if SAID_ALREADY in m.string[m.end() : m.end() + 16]:
        return m.group()
    unit, large = MILLIONS[next(m[g] for g in ("zh", "en", "ne", "in_zh", "in_en", "in_ne") if m[g]).lower()]
    value = (Decimal(m["amount"].replace(",", "")) / 100).quantize(Decimal("0.01"), ROUND_HALF_UP)
    return f"{m['amount']} {unit}，{SAID_ALREADY} {f'{value:,.2f}'.rstrip('0').rstrip('.')} {large}"


def shown_tokens(text: str):
    for m in _TOKEN.finditer(text):
        if m["amount"]:
            yield shown_amount(m)
        elif m["group"]:
            yield shown_group(m["group"])
        elif m["word"]:
            yield shown_word(m["word"])
        elif not m["stray"]:
            yield m.group()


def without_empty_groups(text: str) -> str:
    while (left := re.sub(rf"[（(][{re.escape(SEPARATORS)}]*[）)]", "", text)) != text:
        text = left
    return text


#: A point of a list behind these begins a line; no blank stands before those.
BEFORE_POINTS, CLOSING = ("。", "；", "：", ":"), "，。；：！？、,.!?;:"


def laid_out(text: str) -> str:
    """Points of a list on lines of their own, single blanks, none before punctuation, one blank line at most."""
    words = re.split(r"(\s+)", without_empty_groups(text))  # a word, white space, a word ...
    for k in range(1, len(words) - 2, 2):
        if words[k + 1] in ("-", "*") and words[k - 1].endswith(BEFORE_POINTS):
            words[k] = "\n"
    lines: list[str] = []
    for line in "".join(words).split("\n"):
        shown = " ".join(filter(None, line.replace("\t", " ").split(" "))).strip(" |")
        if shown or not lines or lines[-1]:
            lines.append(shown)
    text = without_empty_groups("\n".join(lines))
    for mark in CLOSING:
        while f" {mark}" in text:
            text = text.replace(f" {mark}", mark)
    return text.strip(" \n\t|")


def sanitize(text: str) -> str:
    return laid_out("".join(shown_tokens(re.sub("\r\n?", "\n", text))))


@F.pandas_udf(StringType())
def sanitized(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else sanitize(t))
