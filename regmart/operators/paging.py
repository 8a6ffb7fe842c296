"""Paged and filtered views."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def public_page(rows: DataFrame, order: list[Column], page: int = 1, size: int = 25) -> DataFrame:
    """No clamp past the end."""
    page, size = max(1, page), min(200, max(1, size))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def with_total(page: DataFrame, rows: DataFrame) -> DataFrame:
    """The page with the number of all rows; a page past the end has none."""
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # the count is one row


def admin_page(rows: DataFrame, order: list[Column], page: int = 1, size: int = 10) -> tuple[DataFrame, int, int]:
    """Rows, the page shown (clamped to the last) and the number of pages."""
    size = min(100, max(1, size))
    pages = max(1, math.ceil(rows.count() / size))
    page = min(max(1, page), pages)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size), page, pages


def search(rows: DataFrame, name: str, text: str) -> DataFrame:
    wanted = text.strip().lower()
    return rows.filter(F.lower(name).contains(wanted)) if wanted else rows
