"""Configuration and registries: small driver-side maps, and the tables they become."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.rules import truthy
from lectern.functions.text import strip


def deep_merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """The overlay wins; only where both are maps the merge goes on below; lists are replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else copy.deepcopy(v)
    return out


def read_yaml(spark: SparkSession, path: str) -> dict[str, Any]:
    """A YAML map, read by Spark so that any of its file systems will do."""
    import yaml

    rows = spark.read.text(path, wholetext=True).collect()
    got = yaml.safe_load(rows[0]["value"]) if rows else None
    if not isinstance(got, dict):
        raise ValueError(f"{path}: a map is expected")
    return got


@dataclass(frozen=True)
class Book:
    code: str
    ord: int
    pdf: str
    toc_csv: str | None = None
    toc_columns: int = 2
    extractors_drop: tuple[str, ...] = ()
    toc_content_width_han: int | None = None
    patch: dict[str, Any] = field(default_factory=dict)


def registry(raw: dict[str, Any]) -> list[Book]:
    """Books in file order; a plain string is the path of the book."""
    out = []
    for n, (code, row) in enumerate(raw.get("book_code", raw).items()):
        row = {"pdf": row} if isinstance(row, str) else row
        if not isinstance(row, dict) or not row.get("pdf"):
            raise ValueError(f"{code}: a path or a map with pdf is expected")
        drop = row.get("extractors_drop") or []
        if not isinstance(drop, list):
            raise ValueError(f"{code}: extractors_drop must be a list")
        out.append(Book(str(code), n, str(row["pdf"]), row.get("toc_csv"), int(row.get("toc_columns") or 2), tuple(map(str, drop)), row.get("toc_content_width_han"), row.get("extractors_patch") or {}))
    return out


def book(books: list[Book], code: str) -> Book:
    for b in books:
        if b.code == code:
            return b
    raise KeyError(code)


def effective(defaults: dict[str, Any], b: Book, overlay: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults, then the overlay, then the book's patch, columns, width and dropped extractors."""
    out = deep_merge(defaults, overlay or {})
    extractors = deep_merge(out.get("extractors") or {}, b.patch)
    toc = extractors.get("目录")
    if isinstance(toc, dict):
        if b.toc_columns == 1:
            toc.pop("column_number", None)
        else:
            toc["column_number"] = 2
        if b.toc_content_width_han is not None:
            toc["toc_content_width_han"] = b.toc_content_width_han
    out["extractors"] = {k: v for k, v in extractors.items() if k not in b.extractors_drop}
    return out | {"book_code": b.code, "pdf": b.pdf, "toc_csv": b.toc_csv}


def registry_table(spark: SparkSession, books: list[Book]) -> DataFrame:
    rows = [(b.code, b.ord, b.pdf, b.toc_csv, b.toc_columns, list(b.extractors_drop), b.toc_content_width_han) for b in books]
    return spark.createDataFrame(rows, "code string, ord int, pdf string, toc_csv string, toc_columns int, extractors_drop array<string>, toc_content_width_han int")


def without_dropped(books: DataFrame, extractor: str) -> DataFrame:
    return books.filter(~F.array_contains("extractors_drop", extractor))


def contents_csv(spark: SparkSession, path: str) -> DataFrame:
    """A contents CSV (a byte-order mark is fine): trimmed headers, without rows of a blank first column."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*[c.replace("﻿", "").strip() for c in rows.columns])
    first = rows.columns[0]
    return rows.withColumn(first, strip(F.col(first))).filter(F.coalesce(F.col(first), F.lit("")) != "")


def units_of(rows: DataFrame, column: str) -> DataFrame:
    """Units whose flag column is set."""
    if column not in rows.columns:
        raise KeyError(column)
    return rows.filter(truthy(F.col(column))).select(rows.columns[0])
