"""Public-register notices: JSON search behind a fetcher, cached texts, and which notice institutes a case."""

from __future__ import annotations

import difflib
import html
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

PREFIX, ALIKE = 25, 0.6  # fixed values: equal beginnings of a subject, or a ratio from which subjects are one


def search(get: Callable[[str], str], number: str) -> list[dict]:
    """Notices of a number: id, title, date, url."""
    found = json.loads(get(number)).get("results") or []
    return [{"id": str(r["document_number"]), "title": r.get("title") or "", "date": r.get("publication_date"), "url": r.get("raw_text_url")} for r in found if r.get("document_number")]


def plain_text(raw: str) -> str:
    return html.unescape(re.sub(r"<[^>]+>", " ", raw))


def texts(notices: DataFrame, cache: DataFrame, get: Callable[[str], str]) -> DataFrame:
    """id, text: cached texts, and fetched ones for notices (id, url) the cache lacks."""
    left = notices.select("id", "url").distinct().join(cache.select("id"), "id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch.id, "text": [plain_text(get(u)) for u in batch.url]})

    return cache.select("id", "text").unionByName(left.mapInPandas(run, "id string, text string"))


def subject(title: str) -> str:
    """What a notice is about: its title without the standing words."""
    bare = re.sub(r"(?i)^certain\s+|;.*$|,?\s*(components|products)\s+(thereof|containing).*$|notice of institution.*$", "", title or "")
    return re.sub(r"[^a-z0-9]+", " ", bare.lower()).strip()


def institutes(text: str, title: str, number: str, case_title: str) -> bool:
    """Whether a notice institutes this case: its number stands in the text, and the subjects agree."""
    serial = re.sub(r"^.*-", "", number)
    if not re.search(rf"337-TA-{serial}\b", text or ""):
        return False
    a, b = subject(title), subject(case_title)
    return bool(a and b) and (a[:PREFIX] == b[:PREFIX] or difflib.SequenceMatcher(None, a, b).ratio() >= ALIKE)

