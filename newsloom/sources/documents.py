"""Official documents and summaries as pages."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES, MOST_PAGES, LEAST, MOST = 8 * 1024 * 1024, 20, 50, 200_000


def bounded(files: DataFrame) -> DataFrame:
    """Rows of the binaryFile source that are PDF and small enough."""
    return files.where((F.col("length") <= MOST_BYTES) & (F.substring("content", 1, 5) == F.lit(b"%PDF-")))


@F.pandas_udf(T.StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    """The text of a PDF of at most MOST_PAGES pages that isn't encrypted; null without the reading library, or if the text is too short or too long."""
    try:
        import io

        from pypdf import PdfReader
    except ImportError:
        return pd.Series([None] * len(content), dtype=object)

    def one(data: bytes) -> str | None:
        try:
            reader = PdfReader(io.BytesIO(data))
            if reader.is_encrypted or len(reader.pages) > MOST_PAGES:
                return None
            text = "\n".join(p.extract_text() or "" for p in reader.pages).strip()
        except Exception:  # a broken file has no text
            return None
        return text if LEAST <= len(text) <= MOST else None

    return content.map(one)


def _escaped(c: Column) -> Column:
    for char in "&<>\"":
        c = F.replace(c, F.lit(char), F.lit(html.escape(char)))
    return c


def summary_page(title: Column, summary: Column) -> Column:
    """A page made of a feed entry's own summary; null without a title or outside 50 to 20,000 characters."""
    page = F.concat(F.lit("<html><head><title>"), _escaped(title), F.lit("</title></head><body><article><h1>"), _escaped(title), F.lit("</h1><p>"), _escaped(summary), F.lit("</p></article></body></html>"))
    return F.when((F.trim(title) != "") & F.length(F.trim(summary)).between(50, 20_000), page)
