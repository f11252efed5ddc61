"""Documents to numbered lines and pages, and slices of them. Order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.rules import full_match, is_appendix_head, is_pinyin_body, is_unit_title
from lectern.functions.text import LINE_END, OTHER_LINE_END, compact, let, normalise_spaces


def line_array(text: Column) -> Column:
    """The lines of a text; the empty piece after a final line end is none. A text is split once, and without a pattern
    where line feeds are its only line ends."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.when(text.rlike(OTHER_LINE_END), F.split(text, LINE_END, -1)).otherwise(F.split(text, "\n", -1))
    return let(pieces, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def explode_lines(docs: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """``keys``, line_no (from 0), raw, compact, norm."""
    keys = keys or [c for c in docs.columns if c != text]
    rows = docs.select(*keys, F.posexplode(line_array(F.col(text))).alias("line_no", "raw"))
    return rows.withColumn("compact", compact(F.col("raw"))).withColumn("norm", normalise_spaces(F.col("raw")))


def pages(lines: DataFrame, part: list[str], is_break: Column, order: str = "line_no") -> DataFrame:
    """Add page_no: the number of page breaks up to the line; the breaks themselves and blank pages go."""
    w = Window.partitionBy(*part).orderBy(order)
    rows = lines.withColumn("is_break", is_break).withColumn("page_no", F.sum(F.col("is_break").cast("int")).over(w))
    page = Window.partitionBy(*part, "page_no")
    filled = F.max(F.when(~F.col("is_break") & (F.col("compact") != ""), 1).otherwise(0)).over(page)
    return rows.withColumn("filled", filled).filter("filled = 1 and not is_break").drop("filled", "is_break")


def region(lines: DataFrame, part: list[str], start: Column, end: Column, order: str = "line_no") -> DataFrame:
    """Rows strictly between the first start and the first end after it; parts that lack either have none.

    Two minima over the part, no self join; a start line is never an end."""
    w = Window.partitionBy(*part)
    rows = lines.withColumn("region_start", F.min(F.when(start, F.col(order))).over(w))
    rows = rows.withColumn("region_end", F.min(F.when(end & (F.col(order) > F.col("region_start")), F.col(order))).over(w))
    return rows.filter((F.col(order) > F.col("region_start")) & (F.col(order) < F.col("region_end")))


def region_status(lines: DataFrame, part: list[str], start: Column, end: Column, order: str = "line_no") -> DataFrame:
    """Per part: start and end (null if not found) and a status, where the row form of ``region`` is silent."""
    first = lines.groupBy(*part).agg(F.min(F.when(start, F.col(order))).alias("start"))
    later = lines.join(first, part).groupBy(*part).agg(F.first("start").alias("start"), F.min(F.when(end & (F.col(order) > F.col("start")), F.col(order))).alias("end"))
    return later.withColumn("status", F.when(F.col("start").isNull(), "no start").when(F.col("end").isNull(), "no end").otherwise("ok"))


def full_match_region(lines: DataFrame, part: list[str], start: list[str], end: list[str]) -> DataFrame:
    return region(lines, part, full_match(F.col("compact"), start), full_match(F.col("compact"), end))


def marker_region(lines: DataFrame, part: list[str], start: list[str], end: list[str]) -> DataFrame:
    """The older form: a line that contains one of the markers."""

    def any_of(markers: list[str]) -> Column:
        out = F.lit(False)
        for m in markers:
            out = out | F.col("raw").contains(m)
        return out

    return region(lines, part, any_of(start), any_of(end))


def follows_within(flag: Column, part: list[str], order: str, rows: int) -> Column:
    """Whether the flag holds in one of the next ``rows`` rows."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(1, rows)
    return F.coalesce(F.max(flag.cast("int")).over(w), F.lit(0)) == 1


def contents_region(lines: DataFrame, part: list[str], start: list[str], ends: list[str], least: int = 20, appendix_within: int = 250, unit_within: int = 20) -> DataFrame:
    """Rows of a table of contents: after the start line up to the first stop at least ``least`` lines on.

    A stop that is an appendix line counts only within ``appendix_within`` lines, and not where the title
    of a unit follows within ``unit_within`` lines. A line of layout pinyin, which only a body has, stops too.
    A part without a start or without a stop is an error."""
    c = F.col("compact")
    w = Window.partitionBy(*part)
    rows = lines.withColumn("toc_start", F.min(F.when(full_match(c, start), F.col("line_no"))).over(w))
    rows = rows.withColumn("unit_ahead", follows_within(c.rlike("^第[一二三四五六七八九十百千万]+单元"), part, "line_no", unit_within))
    depth = F.col("line_no") - F.col("toc_start")
    appendix = [p for p in ends if p.startswith(("识字表", "写字表"))]
    other = [p for p in ends if p not in appendix]
    stop = (depth >= least) & (full_match(c, other) | (full_match(c, appendix) & (depth <= appendix_within) & ~F.col("unit_ahead")) | is_pinyin_body(F.col("raw")))
    rows = rows.withColumn("toc_end", F.min(F.when(stop, F.col("line_no"))).over(w))
    name = F.concat_ws(" ", *[F.col(p).cast("string") for p in part])
    # In the bounds themselves, so that the filter below cannot be taken before it.
    lacks = F.when(F.col("toc_start").isNull(), F.raise_error(F.concat(F.lit("no start of the contents: "), name))).when(F.col("toc_end").isNull(), F.raise_error(F.concat(F.lit("no end of the contents: "), name)))
    rows = rows.withColumn("toc_end", F.coalesce(lacks.cast("int"), F.col("toc_end")))
    return rows.filter((F.col("line_no") < F.col("toc_end")) & (F.col("line_no") > F.col("toc_start")))


def body_bounds(lines: DataFrame, part: list[str], scan: int = 500, override: int | None = None, is_start: Column | None = None, is_end: Column | None = None) -> DataFrame:
    """Per part: body_start (first unit title among the first lines, else 0; or the override, clamped), body_end
    (first appendix head from there, else the number of lines), n_lines.

    One pass: heads among the lines that a start can be in are kept by number, of later ones only the first."""
    start_flag = is_unit_title(F.col("compact")) if is_start is None else is_start
    end_flag = is_appendix_head(F.col("compact")) if is_end is None else is_end
    most = max(scan if override is None else override, 0)
    no, early = F.col("line_no"), F.col("line_no") < most
    flags = lines.select(*part, "line_no", F.when(no < scan, start_flag).alias("is_start"), end_flag.alias("is_end"))
    first = flags.groupBy(*part).agg(
        F.min(F.when(F.col("is_start"), no)).alias("found"),
        F.collect_list(F.when(F.col("is_end") & early, no)).alias("heads"),
        F.min(F.when(F.col("is_end") & ~early, no)).alias("later"),
        (F.max("line_no") + 1).alias("n_lines"),
    )
    start = F.coalesce("found", F.lit(0)) if override is None else F.greatest(F.lit(0), F.least(F.lit(override), F.col("n_lines") - 1))
    first = first.withColumn("body_start", start)
    head = F.array_min(F.filter("heads", lambda n: n >= F.col("body_start")))
    return first.select(*part, "body_start", F.coalesce(head, F.col("later"), F.col("n_lines")).alias("body_end"), "n_lines")


def cut_text(lines: DataFrame, spans: DataFrame, part: list[str], keys: list[str]) -> DataFrame:
    """``spans`` (part, keys, start_line, end_line) with the text of their lines; empty where out of bounds.

    Lines find their span by equality on the part and a range on the line; spans of a part do not overlap, so
    that each line has at most one."""
    hit = lines.join(spans.select(*part, *keys, "start_line", "end_line"), part).filter("line_no >= start_line and line_no < end_line")
    text = hit.groupBy(*part, *keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n").alias("text"))
    return spans.join(text, [*part, *keys], "left").withColumn("text", F.coalesce("text", F.lit("")))
