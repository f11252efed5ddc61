"""Character and word tables: lines to rows, rows to units of the contents.

Continuation lines, runs of pinyin and carried sections are window functions over a book's lines. ``part``
names the columns that tell books apart; lines come with line_no, raw, compact, norm (``lines.explode_lines``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.rules import GARDEN, full_match, hanzi_line, is_anchor, is_pinyin, noise, section_word, strand_fits, word_line
from lectern.functions.text import cjk_words, compact, normalise_spaces, strip, strip_tabs, with_pinyin
from lectern.operators.sequences import carry_forward, greedy_align

# --- Fixed values: the default patterns of the tables ---------------------------------------------------
UNIT_HEADS = [r"\d{1,2}", "语文园地[一二三四五六七八九十]?"]
DISCARDED = ["仅供个人.*", "识字表中.*", "识字", "阅读", "汉语拼音"]
DISCARDED_OF = {"识字表": DISCARDED, "写字表": ["仅供个人.*", "识字", "阅读", "汉语拼音"]}
CHAR_TOTAL, WORD_TOTAL = r"(\(|（)共\d+个生?字(\)|）)", r"(\(|（)共\d+个词(\)|）)"
# --------------------------------------------------------------------------------------------------------


def _joined(value: str, order: str = "line_no", sep: str = " ") -> Column:
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return F.array_join(F.filter(items, lambda x: x != ""), sep)


def classified(region: DataFrame, part: list[str], discard: list[str], total: str | None) -> DataFrame:
    """Add what a line is: dropped (by a pattern, the total or as noise), its section word, its reject text."""
    raw = strip_tabs(F.col("raw"))
    rows = region.withColumn("raw", raw).withColumn("compact", compact(raw)).withColumn("norm", normalise_spaces(raw))
    by_pattern = full_match(F.col("compact"), discard)
    by_total = full_match(F.col("compact"), [total]) if total else F.lit(False)
    rows = rows.withColumn("by_pattern", by_pattern).withColumn("dropped", by_pattern | by_total | noise(F.col("raw")).isNotNull())
    return rows.withColumn("section_mark", F.when(F.col("by_pattern"), section_word(F.col("compact"))))


def char_rows(region: DataFrame, part: list[str], unit_heads: list[str] | None = None, discard: list[str] | None = None, total: str | None = CHAR_TOTAL) -> DataFrame:
    """Rows of a character table: part, i, section, lesson, garden, chars, pinyin_line, hanzi_line, toc_anchor.

    A run of pinyin lines belongs to the line right after it, whatever that is. If that is a bare garden
    title the run waits for the next parsed line; if it is nothing, the run goes to the row before."""
    heads = UNIT_HEADS if unit_heads is None else unit_heads
    w = Window.partitionBy(*part).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = classified(region, part, DISCARDED if discard is None else discard, total).withColumn("p", is_pinyin(F.col("raw")))
    rows = rows.withColumn("before_p", F.coalesce(F.lag("p").over(w), F.lit(False)))
    rows = rows.withColumn("consumed", F.col("before_p") & ~F.col("p")).withColumn("run", F.sum((F.col("p") & ~F.col("before_p")).cast("int")).over(upto))
    mark = F.when(~F.col("consumed"), F.col("section_mark"))
    rows = rows.withColumn("section", F.last(mark, ignorenulls=True).over(upto))
    rows = rows.withColumn("parsed", F.when(~F.col("p") & (F.col("consumed") | ~F.col("dropped")), hanzi_line(F.col("raw"))))
    rows = rows.withColumn("bare", (F.col("norm") == GARDEN) & (F.size("parsed.chars") == 0))

    parsed = rows.filter("parsed is not null")
    waiting = F.col("consumed") & F.col("bare")
    parsed = parsed.withColumn("takes", F.first(F.when(~waiting, F.col("line_no")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    parsed = parsed.withColumn("target", F.when(waiting, F.col("takes")).otherwise(F.col("line_no")))
    tail = F.col("compact").startswith(GARDEN) & (F.length("compact") > len(GARDEN)) & (F.size("parsed.chars") > 0) & F.coalesce(F.lag("bare").over(w), F.lit(False))
    first = F.row_number().over(w) == 1
    parsed = parsed.withColumn("begins", (is_anchor(F.col("compact"), heads) | first | waiting) & ~tail).withColumn("i", F.sum(F.col("begins").cast("int")).over(upto))

    blocks = rows.filter("p").groupBy(*part, "run").agg(_joined("norm").alias("block"), F.max("line_no").alias("last"))
    met = parsed.filter("consumed").select(*part, "run", "target", F.lit(True).alias("met"))
    blocks = blocks.join(met, [*part, "run"], "left")
    of_line = blocks.filter("target is not null").groupBy(*part, F.col("target").alias("line_no")).agg(_joined("block", "run").alias("pinyin"))
    parsed = parsed.join(of_line, [*part, "line_no"], "left").withColumn("pinyin", F.coalesce("pinyin", F.lit("")))
    lost = blocks.filter("met is null").select(*part, F.col("last").alias("line_no"), F.col("block").alias("pinyin"))
    late = parsed.select(*part, "line_no", "i", "pinyin").unionByName(lost.withColumn("i", F.lit(None).cast("long")))
    late = late.withColumn("i", F.coalesce("i", F.last("i", ignorenulls=True).over(upto))).filter("i is not null")
    lines_of = late.groupBy(*part, "i").agg(_joined("pinyin").alias("pinyin_line"))

    each = parsed.withColumn("marked", with_pinyin(F.col("parsed.chars"), F.col("pinyin")))
    head = lambda c: F.min_by(c, "line_no")
    out = each.groupBy(*part, "i").agg(
        head("section").alias("section"), head("parsed.lesson").alias("lesson"), head("parsed.garden").alias("garden"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "marked"))), lambda x: x["marked"])).alias("chars"),
        _joined("raw", sep="\n").alias("hanzi_line"),
        (head(is_anchor(F.col("compact"), heads)) | (F.col("i") == 1)).alias("toc_anchor"),
    )
    out = out.join(lines_of, [*part, "i"], "left")
    return carry_lesson(out, part)


def carry_lesson(rows: DataFrame, part: list[str]) -> DataFrame:
    """Lesson and garden together from the row before, where a row has neither."""
    pair = F.when(F.col("lesson").isNotNull() | F.col("garden").isNotNull(), F.struct("lesson", "garden"))
    rows = rows.withColumn("pair", carry_forward(pair, part, ["i"]))
    return rows.withColumn("lesson", F.col("pair.lesson")).withColumn("garden", F.col("pair.garden")).drop("pair")


def word_rows(region: DataFrame, part: list[str], discard: list[str] | None = None, total: str | None = WORD_TOTAL) -> DataFrame:
    """Rows of a word table: part, i, section, lesson, words, lines. Lines before the first row are rejects."""
    w = Window.partitionBy(*part).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = classified(region, part, ["仅供个人.*", "识字", "阅读"] if discard is None else discard, total)
    rows = rows.withColumn("section", F.last("section_mark", ignorenulls=True).over(w)).filter("not dropped")
    rows = rows.withColumn("head", word_line(F.col("raw"))).withColumn("i", F.sum(F.col("head").isNotNull().cast("int")).over(w))
    rows = rows.withColumn("w", F.coalesce(F.col("head.words"), cjk_words(F.col("raw")))).filter("i > 0 and (head is not null or size(w) > 0)")
    return rows.groupBy(*part, "i").agg(
        F.min_by("section", "line_no").alias("section"), F.min_by("head.lesson", "line_no").alias("lesson"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "w"))), lambda x: x["w"])).alias("words"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]).alias("lines"),
    )


def char_row_rejects(region: DataFrame, part: list[str], discard: list[str] | None = None, total: str | None = CHAR_TOTAL) -> DataFrame:
    """Lines of the region that make no row and no pinyin, trimmed, without blank ones: the reject log."""
    w = Window.partitionBy(*part).orderBy("line_no")
    rows = classified(region, part, DISCARDED if discard is None else discard, total).withColumn("p", is_pinyin(F.col("raw")))
    consumed = F.coalesce(F.lag("p").over(w), F.lit(False)) & ~F.col("p")
    rows = rows.withColumn("kept", F.col("p") | ((consumed | ~F.col("dropped")) & hanzi_line(F.col("raw")).isNotNull()))
    return rows.filter("not kept and compact <> ''").select(*part, "line_no", strip(F.col("raw")).alias("raw"))


def _strand(entry: Column) -> Column:
    label = F.coalesce(entry["group_label"], F.lit(""))
    out = F.when(entry["unit_subtype"].isin("识字", "阅读", "汉语拼音"), entry["unit_subtype"])
    for s in ("汉语拼音", "识字", "阅读"):
        out = out.when(label.contains("·" + s) | label.endswith(s), F.lit(s))
    return out


def assign_units(rows: DataFrame, entries: DataFrame, part: list[str], words: bool = False) -> DataFrame:
    """Bind rows to contents entries (part, toc_index, entry struct) by greedy monotone alignment.

    Only anchor rows look for an entry; the rows between inherit the unit of the anchor before them, and
    nothing after an anchor that found none."""
    anchor = F.lit(True) if words else F.col("toc_anchor")
    anchors = rows.filter(anchor).select(*part, "i", "section", "lesson", *([] if words else ["garden"]))
    e, strand = F.col("entry"), _strand(F.col("entry"))
    label = compact(F.coalesce(e["label"], F.lit("")))
    fits = strand_fits(F.col("section"), strand)
    lesson = (e["kind"] == "lesson") & (strip(F.col("lesson")) == strip(e["number"]))
    if words:
        match = F.when(F.col("lesson") == GARDEN, e["kind"] == "garden").otherwise(lesson)
    else:
        garden = (e["kind"] == "garden") & F.when(F.col("garden") == "", label.startswith(GARDEN)).otherwise(label == F.concat(F.lit(GARDEN), F.col("garden")))
        match = F.when(F.col("garden").isNotNull(), garden).otherwise(lesson)
    usable = entries.filter("entry.kind <> 'section'")
    taken = greedy_align(anchors, usable, F.coalesce(match & fits, F.lit(False)), part, "i", "toc_index")
    bound = taken.join(usable, [*part, "toc_index"], "left").select(*part, "i", F.struct("toc_index", "entry").alias("unit"))
    out = rows.join(bound, [*part, "i"], "left").withColumn("is_anchor", anchor)
    seen = carry_forward(F.when(F.col("is_anchor"), F.struct(F.when(F.col("unit.toc_index").isNotNull(), F.col("unit")).alias("u"))), part, ["i"])
    return out.withColumn("unit", seen["u"]).drop("is_anchor")


def table_totals(rows: DataFrame, part: list[str], items: str, stated: DataFrame | None = None) -> DataFrame:
    """Per part: computed number of items, and whether it equals the stated one (column stated) if given."""
    counts = rows.groupBy(*part).agg(F.sum(F.size(items)).alias("computed"))
    return counts if stated is None else counts.join(stated, part, "left").withColumn("ok", F.col("computed") == F.col("stated"))
