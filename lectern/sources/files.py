"""Files in and out: layout text, contents JSON, Parquet marts, JSON and Markdown reports."""

from __future__ import annotations

import shutil
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import html_escape, preview


def layout_texts(spark: SparkSession, path: str) -> DataFrame:
    """book_code (the file's name up to the first ``_`` or ``.``), path, text of every layout text."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return rows.select(F.regexp_extract("name", "^([^_.]+)", 1).alias("book_code"), "path", "text")


def convert_pdfs(spark: SparkSession, path: str, enc: str = "UTF-8", extra: list[str] | None = None) -> DataFrame:
    """path, text of PDF files by an installed ``pdftotext -layout``; a missing tool fails here, on the driver."""
    tool = shutil.which("pdftotext")
    if tool is None:
        raise FileNotFoundError("pdftotext is not installed")
    args = [tool, "-enc", enc, "-layout", *(extra or []), "-", "-"]

    def run(batches):
        for pdf in batches:
            pdf["text"] = [subprocess.run(args, input=bytes(b), capture_output=True, check=True).stdout.decode(enc) for b in pdf["content"]]
            yield pdf[["path", "text"]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def contents_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of contents files: one row each, with the place in its file."""
    rows = spark.read.option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    if "entries" not in rows.columns:
        return rows.select("path").limit(0)
    return rows.select("path", F.posexplode("entries").alias("toc_index", "entry")).filter("entry is not null")


def book_codes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct codes of the files under a glob."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return names.select(F.regexp_extract("name", "^([^_]+)_", 1).alias("code")).filter("code <> ''").distinct().orderBy("code")


def to_json(df: DataFrame) -> DataFrame:
    """Each row as JSON text with its nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_mart(df: DataFrame, path: str, by: str = "book_code") -> None:
    """A mart table, one folder a book, so that later reads are pruned."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def script_payload(payload_json: str, name: str = "TEXTBOOK_WEB_DATA") -> str:
    return f"window.{name} = {payload_json};\n"


def entry_line(e: Column) -> Column:
    """A contents entry as a Markdown list line; unknown pages and titles show as question marks."""
    page = F.concat(F.lit(" p."), F.coalesce(e["page"].cast("string"), F.lit("???")))
    title = F.coalesce(F.when(e["title"] != "", e["title"]), F.lit("???"))
    star = F.when(F.coalesce(e["optional_reading"], F.lit(False)), "*").otherwise("")
    body = (
        F.when(e["kind"] == "section", F.concat(F.lit("**"), F.coalesce(e["label"], F.lit("???")), F.lit("**")))
        .when(e["kind"] == "lesson", F.concat(F.coalesce(e["number"], F.lit("?")), star, F.lit(" "), title, page))
        .when(e["kind"] == "garden", F.concat(F.coalesce(e["label"], F.lit("???")), page))
        .when(e["kind"] == "reading_club", F.concat(F.lit("快乐读书吧"), F.coalesce(F.concat(F.lit("："), e["subtitle"]), F.lit("")), page))
        .when(e["kind"] == "block_activity", F.concat(F.coalesce(e["block"], F.lit("???")), F.lit("："), title, page))
        .when(e["kind"] == "toc_belt", F.concat_ws("：", e["label"], e["title"]))
        .otherwise(F.concat(title, page))
    )
    return F.concat(F.when(e["kind"] == "sublesson", "  - ").otherwise("- "), body)


def contents_markdown(entries: DataFrame, part: list[str], order: str, entry: str = "entry") -> DataFrame:
    """part, markdown: the entries of each book as one list."""
    rows = entries.select(*part, order, entry_line(F.col(entry)).alias("line"))
    return rows.groupBy(*part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def table_markdown(rows: DataFrame, part: list[str], order: str, label: Column, body: Column) -> DataFrame:
    """part, markdown: a heading and an escaped, shortened body for each row."""
    line = F.concat(F.lit("### "), html_escape(label), F.lit("\n\n"), html_escape(preview(body, 120)))
    return rows.select(*part, order, line.alias("line")).groupBy(*part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n\n").alias("markdown"))


def fenced(body: Column) -> Column:
    """The text in a code fence longer than any run of back quotes in it."""
    longest = F.array_max(F.concat(F.array(F.lit(2)), F.transform(F.regexp_extract_all(body, F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))))
    fence = F.repeat(F.lit("`"), longest + 1)
    return F.concat(fence, F.lit("\n"), body, F.lit("\n"), fence)


def chunks_markdown(chunks: DataFrame, part: list[str], order: str, label: Column, body: Column, ok: Column) -> DataFrame:
    """part, markdown: each chunk's text in a fence, or a mark where its title was not found."""
    line = F.concat(F.lit("## "), label, F.lit("\n\n"), F.when(ok, fenced(body)).otherwise("【未命中】"))
    return table_lines(chunks.select(*part, order, line.alias("line")), part, order)


def table_lines(rows: DataFrame, part: list[str], order: str) -> DataFrame:
    return rows.groupBy(*part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n\n").alias("markdown"))
