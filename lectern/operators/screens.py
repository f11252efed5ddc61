"""The reading screens: text check, word formation, lookup, browsing, and the guards before them.

Tables (columns that are used): ``books`` (book, book_ord), ``toc`` (book, toc_id, toc_ord, label), ``chars`` (book, table,
row_no, label, toc_id, chars), ``words`` (book, row_no, label, toc_id, words), ``chunks`` (book, row_no, toc_id, ok, tokens).
A lesson range is the two ends in either order; a range that lacks an end is no range, and gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import graphemes, strip
from lectern.operators import lookup

#: Order of the tables among hits; where books and tables that are not known come.
TABLE_ORDER, NO_BOOK, NO_TABLE = {"识字表": 0, "写字表": 1}, 999, 9
BLANK = "□"


def places(books: DataFrame, toc: DataFrame) -> DataFrame:
    """book, toc_id, place (book and entry, which compare in order), label; the first of entries with one id."""
    rows = toc.join(books.select("book", "book_ord"), "book")
    place = F.struct(F.col("book_ord").cast("long").alias("bi"), F.col("toc_ord").cast("long").alias("ti"))
    return rows.groupBy("book", "toc_id").agg(F.min(place).alias("place"), F.min_by("label", place).alias("label"))


def lesson_range(place: DataFrame, start: tuple[str, str], end: tuple[str, str]) -> DataFrame:
    """One row lo, hi, end_place; none unless both ends are entries."""
    here = lambda x: (F.col("book") == x[0]) & (F.col("toc_id") == x[1])
    ends = place.agg(F.min(F.when(here(start), F.col("place"))).alias("a"), F.min(F.when(here(end), F.col("place"))).alias("b")).filter("a is not null and b is not null")
    return ends.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("b").alias("end_place"))


def within(rows: DataFrame, place: DataFrame, span: DataFrame) -> DataFrame:
    """``rows`` (book, toc_id) whose entry lies in the range, with place, lo, hi and end_place. The range is one row."""
    placed = rows.join(place.select("book", "toc_id", "place"), ["book", "toc_id"])
    return placed.join(F.broadcast(span), F.col("place").between(F.col("lo"), F.col("hi")))


def first_han(s: Column) -> Column:
    """The first Han character of an input, empty if none."""
    return F.coalesce(F.get(F.filter(graphemes(strip(s)), lambda g: g.rlike(r"\p{IsHan}")), F.lit(0)), F.lit(""))


def unique_han(s: Column) -> Column:
    """The distinct Han characters of an input, in the order in which they first come."""
    return F.array_distinct(F.filter(graphemes(s), lambda g: g.rlike(r"\p{IsHan}")))


def by_kind_of_table(rows: DataFrame, tables: tuple[str, ...]) -> DataFrame:
    return rows.filter(F.col("table").isin(*tables)) if tables else rows.filter(F.lit(False))


def text_check(texts: DataFrame, books: DataFrame, toc: DataFrame, chars: DataFrame, words: DataFrame, start: tuple[str, str], end: tuple[str, str], tables: tuple[str, ...] = ("识字表", "写字表"), with_words: bool = False, template: str = BLANK, mode: str = "replace-known", is_marked: str = r"^\p{IsHan}$") -> DataFrame:
    """``texts`` with marked, han (characters of the marked kind), replaced, known (characters of the sources in the range).

    At least one source is needed; an empty template is the blank; without a range there are no rows. The known
    characters and words of a syllabus are a small dimension, and become one pattern."""
    if not tables and not with_words:
        raise ValueError("choose at least one source")
    template = template or BLANK
    place = places(books, toc)
    span = lesson_range(place, start, end)
    if not span.take(1):
        return texts.limit(0).select("*", F.lit("").alias("marked"), F.lit(0).alias("han"), F.lit(0).alias("replaced"), F.lit(0).alias("known"))
    known = [r["item"] for r in within(by_kind_of_table(chars, tables), place, span).select(F.explode("chars").alias("item")).filter("item <> ''").distinct().collect()]
    listed = [r["item"] for r in within(words, place, span).select(F.explode("words").alias("w")).select(F.trim("w").alias("item")).filter("item <> ''").distinct().collect()] if with_words else []
    marked = lookup.mark_words(F.col("text"), listed, known, template, mode, is_marked)
    numbers = lookup.mark_statistics(F.col("text"), known, mode, is_marked, listed)
    out = texts.withColumn("marked", marked).withColumn("numbers", numbers)
    return out.select(*texts.columns, "marked", F.col("numbers.marked").alias("han"), F.col("numbers.replaced").alias("replaced"), F.lit(len(set(known))).alias("known"))


def same_lengths(chunks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Books whose chunks and token lists are as many: book."""
    a = chunks.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    b = tokens.groupBy("book").agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, "book").filter("n = m").select("book")


def formation_hits(needle: str, books: DataFrame, toc: DataFrame, chunks: DataFrame, words: DataFrame, start: tuple[str, str], end: tuple[str, str], only_ok: bool = False, with_table: bool = True) -> DataFrame:
    """source (body or table), bucket, word, book, row_no: the words in the range that hold the needle, once a row."""
    place = places(books, toc)
    span = lesson_range(place, start, end)
    body = chunks.filter(F.col("ok")) if only_ok else chunks
    parts = [(body, "tokens", "body")] + ([(words, "words", "table")] if with_table else [])
    out = None
    for rows, items, source in parts:
        hits = rows.filter(F.exists(items, lambda t: t.contains(needle)))  # before anything is joined or exploded
        found = F.array_distinct(F.filter(F.transform(items, lambda t: F.trim(t)), lambda t: t.contains(needle)))
        hits = within(hits.select("book", "toc_id", "row_no", found.alias("found")), place, span).withColumn("word", F.explode("found"))
        end_rank = F.struct(F.col("end_place"))
        hits = hits.select(F.lit(source).alias("source"), "word", "book", "row_no", "place", end_rank["end_place"].alias("end_place"))
        out = hits if out is None else out.unionByName(hits)
    # The two entries just before the end in the order of all books.
    near = place.join(F.broadcast(span), F.col("place") < F.col("end_place")).orderBy(F.desc("place")).limit(2).select(F.col("place").alias("near"))
    bucketed = out.join(F.broadcast(near), F.col("place") == F.col("near"), "left")
    bucket = F.when(F.col("place") == F.col("end_place"), "last").when(F.col("near").isNotNull(), "near").otherwise("other")
    return bucketed.select("source", bucket.alias("bucket"), "word", "book", "row_no")


def formation(hits: DataFrame, freq: DataFrame, collation: str | None = "zh") -> DataFrame:
    """source, bucket, word, place: the distinct words of the 2 x 3 fields, by falling frequency, then by reading."""
    return lookup.ranked_words(hits.select("source", "bucket", "word").distinct(), freq, ["source", "bucket"], collation)


def formation_status(hits: DataFrame) -> DataFrame:
    """source, hits, words: the counts under the fields."""
    return hits.groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("word").alias("words"))


def scanned_tokens(books: DataFrame, toc: DataFrame, chunks: DataFrame, start: tuple[str, str], end: tuple[str, str], only_ok: bool = False) -> DataFrame:
    """One row: how many tokens of the chunks in the range were looked through."""
    place = places(books, toc)
    rows = within(chunks.filter(F.col("ok")) if only_ok else chunks, place, lesson_range(place, start, end))
    return rows.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("scanned"))


def hit_order(hits: DataFrame, books: DataFrame) -> DataFrame:
    """Add hit_no: hits of one item by book, table and row; unknown books and tables come last."""
    from pyspark.sql import Window

    table = F.lit(NO_TABLE)
    if "table" in hits.columns:
        for name, n in TABLE_ORDER.items():
            table = F.when(F.col("table") == name, n).otherwise(table)
    rows = hits.join(F.broadcast(books.select("book", "book_ord")), "book", "left").withColumn("table_ord", table).withColumn("book_ord", F.coalesce("book_ord", F.lit(NO_BOOK)))
    w = Window.partitionBy("item").orderBy("book_ord", "table_ord", "row_no")
    return rows.withColumn("hit_no", F.row_number().over(w)).drop("book_ord", "table_ord")


def look_up(wanted: DataFrame, rows: DataFrame, items: str, books: DataFrame) -> DataFrame:
    """item_no, item, hit_no, book, table, row_no, label of each wanted item (item_no, item); an item that no row holds keeps
    one row without a book."""
    keep = [c for c in ("book", "table", "row_no", "label") if c in rows.columns]
    found = lookup.holders(wanted.select("item").distinct(), rows, "item", items, keep)
    return wanted.join(hit_order(found, books), "item", "left")


def browse(rows: DataFrame, book: str, kind: str, items: str) -> DataFrame:
    """row_no, title, item_no, item, pinyin of one table of a book; ``items`` are structs (char or word, pinyin)."""
    name = "word" if items == "word_items" else "char"
    of = rows.filter(F.col("book") == book)
    of = of.filter(F.col("table") == kind) if "table" in rows.columns else of
    title = F.when(F.coalesce(F.col("label"), F.lit("")) != "", F.col("label")).otherwise(F.concat(F.lit("行 "), F.col("row_no") + 1))
    each = of.select("row_no", title.alias("title"), F.posexplode(items).alias("item_no", "x"))
    return each.select("row_no", "title", "item_no", F.col(f"x.{name}").alias("item"), F.coalesce(F.trim("x.pinyin"), F.lit("")).alias("pinyin"))


def choices(books: DataFrame, toc: DataFrame) -> DataFrame:
    """Per book in order: book, title, its first and last entry, and how many it has."""
    order = F.col("toc_ord")
    ends = toc.groupBy("book").agg(F.min_by("toc_id", order).alias("first_id"), F.max_by("toc_id", order).alias("last_id"), F.count(F.lit(1)).alias("entries"))
    return books.join(ends, "book", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))


def default_range(books: DataFrame, toc: DataFrame) -> DataFrame:
    """One row: the first book, with its first and last entry as the ends of a range."""
    first = books.orderBy("book_ord").limit(1).select("book")
    return choices(books, toc).join(F.broadcast(first), "book").select("book", F.col("first_id").alias("start_id"), F.col("last_id").alias("end_id"))


def guards(books: DataFrame, toc: DataFrame, chunks: DataFrame, tokens: DataFrame, freq: DataFrame) -> DataFrame:
    """check, ok: whether what the screens need is there."""
    some = lambda df: df.agg((F.count(F.lit(1)) > 0).alias("ok"))
    per = chunks.groupBy("book").agg(F.count(F.lit(1)).alias("n")).join(tokens.groupBy("book").agg(F.count(F.lit(1)).alias("m")), "book", "full")
    equal = per.agg((F.coalesce(F.count_if(F.coalesce("n", F.lit(0)) != F.coalesce("m", F.lit(0))), F.lit(0)) == 0).alias("ok"))
    out = None
    for name, df in (("books", some(books)), ("contents", some(toc)), ("tokens", equal), ("frequencies", some(freq))):
        row = df.select(F.lit(name).alias("check"), "ok")
        out = row if out is None else out.unionByName(row)
    return out


def by_id(rows: DataFrame, entries: DataFrame, order: str) -> DataFrame:
    """``rows`` (book, toc_id) with the entry of that id; of entries with one id the last counts."""
    last = entries.groupBy("book", "toc_id").agg(F.max_by(F.struct(*[c for c in entries.columns if c not in ("book", "toc_id")]), order).alias("entry"))
    return rows.join(last, ["book", "toc_id"], "left")


def matched_counts(chunks: DataFrame) -> DataFrame:
    """Per book: matched, unmatched and total chunks."""
    return chunks.groupBy("book").agg(F.count_if("ok").alias("matched"), F.count_if(~F.col("ok")).alias("unmatched"), F.count(F.lit(1)).alias("total"))


def all_words(rows: DataFrame) -> DataFrame:
    """Per book: its words in the order of the rows, repeats kept. A book's word table is small."""
    packed = F.array_sort(F.collect_list(F.struct("row_no", "words")))
    return rows.groupBy("book").agg(F.flatten(F.transform(packed, lambda x: x["words"])).alias("all_words"))


def batch_outcome(status: DataFrame) -> DataFrame:
    """One row of a run over books (book, ran, error): failed, any_ran, exit_code. An error of one book stops no other."""
    failed = F.count_if(F.col("error").isNotNull())
    ran = F.coalesce(F.max(F.col("ran")), F.lit(False))
    return status.agg(failed.alias("failed"), ran.alias("any_ran")).withColumn("exit_code", F.when((F.col("failed") > 0) | ~F.col("any_ran"), 1).otherwise(0))
