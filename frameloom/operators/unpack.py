"""Several values packed in one field: one value per row with its position.

A parsing expression grammar reads the field. Its choices are ordered and the
first alternative that matches wins; an alternative that fails (a quote that is
never closed before a delimiter) gives its input back and the next one is
tried, ending with the bare item, which always matches.

    list   <- json / item (delim item)* end
    json   <- '[' string (',' string)* ']' end        (a JSON array)
    item   <- blank* (quoted / bare) blank*
    quoted <- open (escape / doubled / other)* close &(blank* (delim / end))
    bare   <- (remark / bracket / other)*  up to a delimiter
    remark <- '(' (remark / other)* ')'
    delim  <- [,;|·\\t\\r\\n]  /  blank '/' (blank / end)

A slash without blanks is part of its name (`Bk 208/1`), as is a delimiter in
parentheses. Each terminal is one compiled pattern over the rest of the field,
nothing recurses, and what was looked for in vain isn't looked for again, so
long fields are read in linear time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Opening quotation marks and what closes them.
QUOTES = {
    '"': '"', "'": "'", "“": "”", "„": "“”", "”": "”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", "‹": "›", "`": "`",
}

_DELIM = r"(?:[,;|·\t\r\n]|(?:(?<=\s)|^)/(?=\s|$))"
_SPACES = "[ \\u00a0\\u2000-\\u200a\\u202f\\u3000]*"
_BLANK = re.compile(_SPACES)
_AT_END = re.compile(rf"{_SPACES}(?:{_DELIM}|$)")
_ONE_DELIM = re.compile(_DELIM)
_BARE = re.compile(r"[^,;|·\t\r\n/(\[]+")


def _closers() -> dict[str, re.Pattern]:
    out = {}
    for opening, closing in QUOTES.items():
        c = re.escape(closing)
        twice = "|".join(re.escape(x) * 2 for x in closing)
        # Up to a closing mark that no backslash escapes and that isn't doubled.
        out[opening] = re.compile(rf"(?:[^\\{c}]|\\.|{twice})*", re.DOTALL)
    return out


_INSIDE = _closers()


def _unescape(text: str, closing: str) -> str:
    for mark in {*closing, '"'}:
        text = text.replace("\\" + mark, mark)
    for mark in closing:
        text = text.replace(mark * 2, mark)
    return text.replace("\\\\", "\\")


def _quoted(s: str, i: int, dead: set[str]) -> tuple[int, str] | None:
    """quoted: position behind it and its value, or None to let the next alternative try.

    `dead` remembers marks that nothing closes up to the end, so that each is
    looked for once.
    """
    opening = s[i] if i < len(s) else ""
    if opening not in QUOTES or not opening or opening in dead:
        return None
    closing, start = QUOTES[opening], i + 1
    at = start
    while True:
        end = _INSIDE[opening].match(s, at).end()
        if end >= len(s):
            dead.add(opening)
            return None
        if s[end] in closing and _AT_END.match(s, end + 1):
            return end + 1, _unescape(s[start:end], closing)
        # A mark inside the name (an apostrophe): go on behind it.
        at = end + 1


def _partners(s: str) -> dict[int, int]:
    """remark, bracket: position behind the closing mark of each opening one that has one."""
    out: dict[int, int] = {}
    for pair in ("()", "[]"):
        if pair[0] in s:
            stack: list[int] = []
            for m in re.finditer("[" + re.escape(pair) + "]", s):
                if m.group() == pair[0]:
                    stack.append(m.start())
                elif stack:
                    out[stack.pop()] = m.end()
    return out


def _bare(s: str, i: int, partners: dict[int, int]) -> tuple[int, bool]:
    """bare: position of the delimiter or end, and whether a parenthesis stayed open."""
    broken = False
    while i < len(s):
        m = _BARE.match(s, i)
        if m:
            i = m.end()
            continue
        if s[i] in "([":
            broken = broken or i not in partners
            i = partners.get(i, i + 1)
        elif _ONE_DELIM.match(s, i):
            break
        else:
            i += 1
    return i, broken


def _json_list(s: str) -> list[str] | None:
    t = s.strip()
    if not (t.startswith("[") and t.endswith("]")):
        return None
    try:
        items = json.loads(t)
    except (ValueError, RecursionError):
        return None
    if not isinstance(items, list) or any(isinstance(x, (list, dict)) for x in items):
        return None
    return ["" if x is None else x if isinstance(x, str) else json.dumps(x) for x in items]


def parse_packed(text: str | None) -> list[tuple[int, str, str]]:
    """(position from 1, value, flag) of each value that isn't empty.

    flag is `quoted`, `bare`, `json`, `bad_quote` (an opening mark that nothing
    closes: the item was read as bare) or `bad_bracket`. Null, empty and blank
    texts give no values.
    """
    if text is None:
        return []
    items = _json_list(text)
    if items is not None:
        found = [(x.strip(), "json") for x in items]
    else:
        found, i, n = [], 0, len(text)
        dead, partners = set(), _partners(text)
        while i <= n:
            i = _BLANK.match(text, i).end()
            hit = _quoted(text, i, dead)
            if hit:
                i, value, flag = hit[0], hit[1], "quoted"
            else:
                end, broken = _bare(text, i, partners)
                opened = i < n and text[i] in QUOTES and text[i] not in "'`’"
                i, value, flag = end, text[i:end], "bad_bracket" if broken else "bad_quote" if opened else "bare"
            found.append((value.strip(), flag))
            i = _BLANK.match(text, i).end()
            m = _ONE_DELIM.match(text, i)
            if not m:
                break
            i = m.end()
    kept = [(v, f) for v, f in found if v]
    return [(k, v, f) for k, (v, f) in enumerate(kept, 1)]


def _parse_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([[{"pos": p, "value": v, "flag": f} for p, v, f in parse_packed(t)] for t in texts], dtype=object)


def unpack(df: DataFrame, key: str, packed: str | Column, value: str = "value") -> DataFrame:
    """One row per value packed in a field: key, pos (from 1), value, flag.

    Rows without values give no rows; repeated rows repeat theirs. Parsing needs
    no shuffle; it runs in Arrow batches where the rows are.
    """
    col = F.col(packed) if isinstance(packed, str) else packed
    parse = F.pandas_udf(_parse_batches, "array<struct<pos:int,value:string,flag:string>>", F.PandasUDFType.SCALAR_ITER)
    items = df.select(key, col.alias("__packed")).where(F.trim("__packed") != "")
    return items.select(key, F.explode(parse("__packed")).alias("__i")).select(
        key, F.col("__i.pos").alias("pos"), F.col("__i.value").alias(value), F.col("__i.flag").alias("flag")
    )
