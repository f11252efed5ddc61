"""Command line: ``python -m lectern.cli extract|extract-all|toc-chunk --input GLOB --output DIR``.

With ``--registry`` (and ``--defaults``) each book is read with its own options, without the extractions that it drops;
an error of one book is a row of ``status`` and stops no other."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import contents, lines, screens
from lectern.sources import config, files

STATUS = "book string, extractor string, ran boolean, error string"


def run_books(spark: SparkSession, ln: DataFrame, books: list[config.Book], defaults: dict, names: list[str], write) -> DataFrame:
    """``write(rows, book, extractor)`` for each book and extraction that it does not drop; status rows."""
    status = []
    for book in books:
        blocks = config.effective(defaults, book)["extractors"]
        own = ln.filter(F.col("book_code") == book.code)
        for name in names:
            if name in book.extractors_drop:
                status.append((book.code, name, False, None))
                continue
            try:
                toc = contents.extract_contents(own, ["book_code"], **contents.options_of("目录", blocks.get("目录") or {"column_number": 2}))
                rows = toc if name == "目录" else contents.EXTRACTORS[name](own, ["book_code"], entries=toc, **contents.options_of(name, blocks.get(name) or {}))
                write(rows, book.code, name)
                status.append((book.code, name, True, None))
            except Exception as error:  # goes to the status table
                status.append((book.code, name, False, str(error)[:500]))
    return spark.createDataFrame(status, STATUS)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lectern")
    parser.add_argument("command", choices=["extract", "extract-all", "toc-chunk"])
    parser.add_argument("--input", required=True, help="layout texts (a glob that Spark reads)")
    parser.add_argument("--output", required=True)
    parser.add_argument("--extractor", choices=sorted(contents.EXTRACTORS))
    parser.add_argument("--book", action="append", help="only these books of the registry")
    parser.add_argument("--registry", help="YAML of books")
    parser.add_argument("--defaults", help="YAML of the extractions' options")
    parser.add_argument("--body-start-line", type=int)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ln = lines.explode_lines(files.layout_texts(spark, args.input).select("book_code", "text"))
    names = [args.extractor] if args.extractor else list(contents.EXTRACTORS)
    if args.registry and args.command != "toc-chunk":
        books = [b for b in config.registry(config.read_yaml(spark, args.registry)) if not args.book or b.code in args.book]
        defaults = config.read_yaml(spark, args.defaults) if args.defaults else {}
        status = run_books(spark, ln, books, defaults, names, lambda rows, book, name: files.write_mart(rows, f"{args.output}/{name}/book_code={book}"))
        files.write_mart(status, f"{args.output}/status")
        return screens.batch_outcome(status).first()["exit_code"]
    entries = contents.extract_contents(ln, ["book_code"])
    if args.command == "toc-chunk":
        files.write_mart(contents.extract_chunks(ln, ["book_code"], entries, args.body_start_line), f"{args.output}/chunks")
        return 0
    for name in names:
        rows = entries if name == "目录" else contents.EXTRACTORS[name](ln, ["book_code"], entries=entries)
        files.write_mart(rows, f"{args.output}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
