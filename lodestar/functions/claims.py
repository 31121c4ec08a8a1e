"""Sentences, claim lists and patent mentions in legal prose.

Sentences are a column expression: every token is told to end a sentence or not by its own form and the next token's.
Claim lists are read by a scanner that cuts text into numbers, joints and other words, and takes what follows the word
"claim" as long as numbers and joints alternate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.types import INTS, STRING, struct

#: Abbreviations that end no sentence, company forms written in capitals, and the widest range of claims.
ABBREVIATIONS = (
    "no nos inv fed cir inc co corp ltd llc id e.g i.e v vs reg pat app ex exs dkt mr ms mrs dr jr sr al op tr br supp sec secs art fig figs p pp ch cl cls para paras ser "
    "comm'n comm admin u.s.c c.f.r f f.2d f.3d f.4th st ave approx etc jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
NAME_FORMS = "sp inc co corp ltd llc plc gmbh bv nv sa srl spa ag kk".split()
WIDEST = 150

_BREAK = "\ue000"


def sentences(text: Column) -> Column:
    """The sentences, one space between words."""
    tokens = F.split(F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?U)\s+", " ")), " ")

    def ends(token: Column, following: Column) -> Column:
        word = F.regexp_replace(F.regexp_replace(token, "[\"'”’)\\]]+$", ""), "^[(\"'“‘\\[]+", "")
        bare = F.regexp_replace(word, r"\.+$", "")
        low = F.lower(bare)
        initials = bare.rlike("^[A-Z]$") | word.rlike(r"^(?:[A-Z]\.)+[A-Z]?$")
        acronym = bare.rlike(r"^[^a-z.]*[A-Z][^a-z.]*$") & (F.length(bare) > 1)
        names_on = initials | low.isin(NAME_FORMS) | (~acronym & low.isin(ABBREVIATIONS))
        closes = token.rlike("[!?][\"'”’)\\]]*$") | (token.rlike("[.][\"'”’)\\]]*$") & ((bare == "") | ~names_on))
        return closes & following.rlike("^[\"'“‘(\\[]?[A-Z0-9]")

    nexts = F.concat(F.slice(tokens, F.lit(2), F.size(tokens)), F.array(F.lit("")))
    marked = F.zip_with(tokens, nexts, lambda t, n: F.concat(t, F.when(ends(t, n), _BREAK).otherwise(" ")))
    return F.filter(F.transform(F.split(F.array_join(marked, ""), _BREAK), lambda s: F.trim(s)), lambda s: s != "")


# ---- claim lists

_LEX = re.compile(r"(?P<number>\d+)|(?P<range>[-–—]|\b(?:through|to)\b)|(?P<joint>,|&|\b(?:and|or)\b)|(?P<claim>\bclaims?\b)|(?P<space>\s+)|(?P<other>\w+|.)", re.I | re.S)
Lex = tuple[str, str, int, int]


def _scan(text: str) -> list[Lex]:
    """(kind, text, start, end) of the text's tokens; white space is left out."""
    return [(m.lastgroup, m[0], m.start(), m.end()) for m in _LEX.finditer(text) if m.lastgroup != "space"]


def _list_at(tokens: list[Lex], at: int) -> tuple[list[tuple[int, int]], int]:
    """(low, high) of each item of the list that begins at a token, and the token after the list."""
    items, end = [], at
    while at < len(tokens) and tokens[at][0] == "number":
        low = high = int(tokens[at][1])
        at += 1
        if at + 1 < len(tokens) and tokens[at][0] == "range" and tokens[at + 1][0] == "number":
            high, at = int(tokens[at + 1][1]), at + 2
        items.append((low, high))
        end = at
        joints = at
        while at < len(tokens) and tokens[at][0] == "joint":
            at += 1
        if at == joints:
            break
    return items, end


def references(sentence: str) -> list[tuple[str, int, int]]:
    """(claim list as written, start, end) of each list after the word claim or claims."""
    tokens, out, at = _scan(sentence), [], 0
    while at < len(tokens):
        items, end = _list_at(tokens, at + 1) if tokens[at][0] == "claim" else ([], at + 1)
        if items:
            out.append((sentence[tokens[at + 1][2] : tokens[end - 1][3]], tokens[at][2], tokens[end - 1][3]))
        at = max(end, at + 1)
    return out


def names_claims(text: Column) -> Column:
    """Whether the text holds the word claim or claims before a number."""
    return text.rlike(r"(?i)\bclaims?\s+\d")


def expand_claims(written: object) -> list[int]:
    """The numbers of a claim list; ValueError for what is none, runs backward, or is too wide."""
    tokens = _scan("" if written is None else str(written).strip())
    tokens = tokens[1:] if tokens and tokens[0][0] == "claim" else tokens
    items, end = _list_at(tokens, 0)
    rest = [t for t in tokens[end:] if t[0] != "joint"]
    if rest:
        raise ValueError(f"not a claim list: {written!r}")
    if not items:
        raise ValueError(f"no claims in {written!r}")
    for low, high in items:
        if low < 1 or high < low or high - low >= WIDEST:
            raise ValueError(f"not a range of claims: {low}-{high}")
    return sorted({n for low, high in items for n in range(low, high + 1)})


def ranges(claims: list[int]) -> str:
    """claims 1-3, 5"""
    numbers = sorted(set(claims))
    firsts = [n for n in numbers if n - 1 not in numbers]
    lasts = [n for n in numbers if n + 1 not in numbers]
    listed = ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in zip(firsts, lasts))
    return f"claim{'s' if len(numbers) > 1 else ''} {listed}" if numbers else ""


def patent_digits(number: object) -> str:
    return re.sub(r"[^0-9A-Za-z]", "", "" if number is None else str(number))


def mentions(sentence: str, patents: list[str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, patent) of each mention, in full or by its last three digits ('294 patent)."""
    for patent in patents:
        digits = patent_digits(patent)
        grouped = r"[,.]?".join(x for x in (digits[:-6], digits[-6:-3], digits[-3:]) if x)
        for m in re.finditer(rf"(?<!\d){grouped}(?!\d)|['’‘]{digits[-3:]}\b", sentence):
            yield m.start(), m.end(), patent


def patent_for(reference: tuple[str, int, int], sentence: str, patents: list[str]) -> str | None:
    """The patent a claim list belongs to: the next one named before another list, else the last named before it."""
    _, start, end = reference
    limit = min((r[1] for r in references(sentence) if r[1] >= end), default=len(sentence))
    named = list(mentions(sentence, patents))
    after = min((m for m in named if end <= m[0] < limit), default=None)
    before = max((m for m in named if m[1] <= start), default=None)
    return (after or before or (0, 0, None))[2]


@F.pandas_udf(struct(claims=INTS, error=STRING))
def expand_udf(s: pd.Series) -> pd.DataFrame:
    rows = []
    for x in s:
        try:
            rows.append((expand_claims(x), None))
        except ValueError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["claims", "error"])
