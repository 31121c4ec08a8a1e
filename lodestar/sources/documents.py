"""Texts of filed documents: page text through a pluggable reader, page selection, and caches as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHORT = 100  # fixed value: fewer characters on a page send it to OCR, where one is given


def pdf_pages(content: bytes) -> list[str]:
    """The text layer of a PDF's pages; needs the optional reader library."""
    import io

    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, att_id, name, path, content of files named doc_att_name; content is read only where it is used."""
    parts = F.split(F.regexp_extract("path", "[^/]+$", 0), "_", 3)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(parts[0].alias("doc_id"), F.get(parts, 1).alias("att_id"), F.get(parts, 2).alias("name"), "path", "content")


def page_texts(found: DataFrame, read: Callable[[bytes], list[str]] = pdf_pages, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """doc_id, path, page, text: every page, a short one by OCR if one is given. Unreadable files have no pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, path, content in zip(batch.doc_id, batch.path, batch.content):
                try:
                    texts = read(content)
                except Exception:  # a reader may raise anything on a broken file
                    continue
                texts = [ocr(content, i) if ocr and len(t.strip()) < SHORT else t for i, t in enumerate(texts)]
                yield pd.DataFrame({"doc_id": d, "path": path, "page": range(1, len(texts) + 1), "text": texts})

    return found.select("doc_id", "path", "content").mapInPandas(run, "doc_id string, path string, page int, text string")


def uncached(found: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose pages the cache lacks."""
    return found.join(cache.select("path").distinct(), "path", "left_anti")


def wanted_pages(total: Column, first: int, last: int) -> Column:
    """Numbers of the first and last pages of so many."""
    head = F.when(F.least(total, F.lit(first)) > 0, F.sequence(F.lit(1), F.least(total, F.lit(first)))).otherwise(F.array().cast("array<int>"))
    tail = F.when(total > F.greatest(total - last, F.lit(0)), F.sequence(F.greatest(total - last, F.lit(0)) + 1, total)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_union(head, tail))


def as_prompt(pages: DataFrame) -> DataFrame:
    """doc_id, text: pages in order, with a mark where some are left out."""
    from pyspark.sql import Window

    gap = F.col("page") > F.lag("page", 1, 0).over(Window.partitionBy("doc_id").orderBy("page")) + 1
    marked = pages.withColumn("t", F.concat(F.when(gap, F.lit("[...]\n")).otherwise(F.lit("")), F.lit("[page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text")))
    return marked.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def main_file(pages_of: DataFrame, body: Column, tries: int = 3) -> DataFrame:
    """doc_id, att: of a document's files (doc_id, att, ord, pages, text) the first of the first three whose text passes,
    else the longest."""
    passed = F.min_by("att", "ord").alias("passed")
    good = pages_of.filter((F.col("ord") < tries) & body).groupBy("doc_id").agg(passed)
    long = pages_of.groupBy("doc_id").agg(F.max_by("att", F.struct("pages", -F.col("ord"))).alias("longest"))
    return long.join(good, "doc_id", "left").select("doc_id", F.coalesce("passed", "longest").alias("att"))
