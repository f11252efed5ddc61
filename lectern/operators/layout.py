"""Geometry of two-column contents pages: splitting lines, parsing cells, grouping entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.rules import NUMERALS, SKIPPED_PREFIXES, UNIT_NUMERALS, unit_type
from lectern.functions.text import SPACE, clean_title, compact, display_width, leading_width, let, strip, strip_zero_width

_S = f"[{SPACE}]"


def right_only(line: Column, han: int) -> Column:
    """Whether the leading blank is wide enough for a line of the right column alone (the looser bound rules)."""
    return leading_width(line) * 3 >= (2 * han * 2) // 3


def narrow_left(line: Column, han: int, gap: int = 5) -> Column:
    return (display_width(line) <= han) & ~strip(line).rlike(f"{_S}{{{gap},}}")


def longest_gap_start(line: Column, gap: int) -> Column:
    """Place (from 1) of the first of the longest inner runs of white space of at least ``gap``; 0 if none."""

    def place(body: Column) -> Column:
        runs = F.filter(F.regexp_extract_all(body, F.lit(f"({_S}{{{gap},}})"), F.lit(1)), lambda r: F.length(r) > 0)
        longest = F.aggregate(runs, F.lit(""), lambda a, r: F.when(F.length(r) > F.length(a), r).otherwise(a))
        return let(longest, lambda g: F.when(g == "", 0).otherwise(F.length(line) - F.length(body) + F.position(g, body)))

    return let(F.regexp_replace(line, f"^{_S}+", ""), place)


def split_columns(line: Column, han: int | None = 36, dots: int = 3, gap: int = 5) -> Column:
    """(left, right) of a line: blank, right only, narrow left only, cut after dots and page, cut at the
    longest gap, all left; the first that holds. What several of these use is computed once a line."""
    return let(F.regexp_replace(line, f"{_S}+$", ""), lambda raw: _columns_of(raw, han, dots, gap))


def _columns_of(raw: Column, han: int | None, dots: int, gap: int) -> Column:

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("left"), b.alias("right"))

    none = F.lit("")
    page = rf"(?:\.{_S}*){{{dots},}}{_S}*\p{{Nd}}+"

    def at_gap(at: Column) -> Column:
        right = strip(F.substring(raw, at, F.length(raw)))  # the gap itself is blank
        return F.when(at > 0, pair(F.regexp_replace(F.substring(raw, F.lit(1), at - 1), f"{_S}+$", ""), right)).otherwise(pair(raw, none))

    def after_page(pages: Column) -> Column:
        def cut(head: Column) -> Column:
            tail = strip(F.substring(raw, F.length(head) + 1, F.length(raw)))
            return let(tail, lambda t: F.when((pages >= 2) | (t != ""), pair(strip(head), t)))

        return F.when(pages > 0, let(F.regexp_extract(raw, f"^([\\s\\S]*?{page})", 1), cut))

    pages = F.when(raw.contains("."), F.regexp_count(raw, F.lit(page))).otherwise(0)
    out = F.when(strip(raw) == "", pair(none, none))
    if han:
        out = out.when(right_only(raw, han), pair(none, strip(raw))).when(narrow_left(raw, han, gap), pair(raw, none))
    return out.otherwise(let(let(pages, after_page), lambda p: F.when(p.isNotNull(), p).otherwise(let(longest_gap_start(raw, gap), at_gap))))


def split_wide_gap(line: Column, gap: int = 10) -> Column:
    """The older split: at runs of spaces, the first two filled pieces."""
    pieces = F.transform(F.split(F.regexp_replace(line, f"{_S}+$", ""), f" {{{gap},}}"), strip)
    return F.slice(F.filter(pieces, lambda p: p != ""), 1, 2)


_U = f"第[{UNIT_NUMERALS}]+单元"
_HEAD, _COLON = r"^(?:[◎○]\s*)?", r"\s*[:：]?\s*"
_DOTS, _PAGE = r"\s*(?:(?:\.|．)\s*){2,}\s*(\p{Nd}+)\s*$", r"\s{1,}(\p{Nd}{1,4})\s*$"
_FIELDS = ("kind", "number", "title", "label", "block", "subtitle", "sublesson_title", "page", "optional_reading")


def _entry(kind: str, **fields: Column) -> Column:
    types = {"page": "int", "optional_reading": "boolean"}
    values = {"kind": F.lit(kind), **fields}
    return F.struct(*[(values[f].cast(types.get(f, "string")) if f in values else F.lit(None).cast(types.get(f, "string"))).alias(f) for f in _FIELDS])


def parse_cell(cell: Column) -> Column:
    """A contents cell as a tagged record (null: nothing). The order of the rules is part of the meaning."""
    raw = strip_zero_width(F.regexp_replace(cell, r"[\r\n]+$", ""))
    return let(raw, lambda r: let(strip(r), lambda s: let(compact(r), lambda c: _parsed(r, s, c))))


def _parsed(raw: Column, s: Column, c: Column) -> Column:

    def part(pattern: str, k: int, of: Column = s) -> Column:
        return F.regexp_extract(of, pattern, k)

    def number(pattern: str, k: int, of: Column = s) -> Column:
        return F.expr("cast(null as int)") if k == 0 else F.when(part(pattern, k, of) != "", part(pattern, k, of)).cast("int")

    garden, garden_gap = rf"^[◎○]?\s*(语文园地[{NUMERALS}]*)(?:\s*\.{{2,}}\s*(\p{{Nd}}+))?\s*$", rf"^[◎○]?\s*(语文园地[{NUMERALS}]*)(?:\s{{2,}}(\p{{Nd}}{{1,4}}))?\s*$"
    reading, reading_gap, reading_dots = rf"^[◎○]?\s*快乐读书吧{_COLON}$", rf"^[◎○]?\s*快乐读书吧{_COLON}(.+?)\s{{2,}}(\p{{Nd}}{{1,4}})\s*$", rf"^[◎○]?\s*快乐读书吧{_COLON}(.+?)\s*\.{{2,}}\s*(\p{{Nd}}+)\s*$"
    belt = r"^(?:[◎○])?(口语交际|习作例文|习作|综合性学习)[:：]?$"
    lesson, lesson_gap, lesson_bare = r"^(\p{Nd}{1,2})([*＊]?)\s+(.+?)\s*\.{2,}\s*(\p{Nd}+)\s*$", r"^(\p{Nd}{1,2})([*＊]?)\s+(.+?)\s{2,}(\p{Nd}{1,4})\s*$", r"^(\p{Nd}{1,2})([*＊]?)\s+(.+)$"
    sub, sub_gap = r"^\s{4,}(.+?)\s*\.{2,}\s*(\p{Nd}+)\s*$", r"^\s{4,}(.+?)\s{2,}(\p{Nd}{1,4})\s*$"
    orphan, orphan_gap = r"^(.+?)\s*\.{2,}\s*(\p{Nd}+)\s*$", r"^(.+?)\s{2,}(\p{Nd}{1,4})\s*$"

    def lesson_of(p: str, paged: bool) -> Column:
        fields = {"number": part(p, 1), "title": clean_title(part(p, 3)), "optional_reading": part(p, 2) != ""}
        return _entry("lesson", **(fields | ({"page": part(p, 4)} if paged else {})))

    out = F.when(is_skipped(c), F.lit(None))
    out = out.when(c.rlike(f"^{_U}·(阅读|识字|汉语拼音)$") | (c == "我上学了"), _entry("section", label=c))
    out = out.when(c.isin("古诗词诵读", "古诗诵读"), _entry("section", label=F.lit("古诗词诵读")))
    out = out.when(c.rlike(rf"^{_U}(?:\.+\p{{Nd}}+)?$"), _entry("section", label=F.regexp_extract(c, f"^({_U})", 1)))
    out = out.when(c.rlike(belt), _entry("toc_belt", label=F.regexp_extract(c, belt, 1)))
    for p in (garden, garden_gap):
        out = out.when(s.rlike(p), _entry("garden", label=part(p, 1), page=number(p, 2)))
    out = out.when(s.rlike(reading), _entry("reading_club", title=F.lit("快乐读书吧")))
    for p in (reading_gap, reading_dots):
        out = out.when(s.rlike(p), _entry("reading_club", title=F.lit("快乐读书吧"), subtitle=clean_title(part(p, 1)), page=part(p, 2)))
    for words, name in (("(口语交际|习作例文|习作)", None), ("专题学习活动", "专题学习活动"), ("综合性学习", "综合性学习")):
        for end in (_DOTS, _PAGE):
            p, k = f"{_HEAD}{words}{_COLON}(.+?){end}", 0 if name else 1
            out = out.when(s.rlike(p), _entry("block_activity", block=F.lit(name) if name else part(p, 1), title=clean_title(part(p, 1 + k)), page=part(p, 2 + k)))
    for p in (lesson, lesson_gap):
        out = out.when(s.rlike(p), lesson_of(p, True))
    bare = ~s.rlike(r"\.{2,}") & ~s.rlike(r"\s{2,}\p{Nd}{1,4}\s*$") & s.rlike(lesson_bare) & (clean_title(part(lesson_bare, 3)) != "")
    out = out.when(bare, lesson_of(lesson_bare, False))
    out = out.when(raw.rlike(sub), _entry("sublesson", title=clean_title(part(sub, 1, raw)), page=part(sub, 2, raw)))
    out = out.when(raw.rlike(sub_gap), F.when(clean_title(part(sub_gap, 1, raw)) != "", _entry("sublesson", title=clean_title(part(sub_gap, 1, raw)), page=part(sub_gap, 2, raw))))

    def bad(t: Column, tc: Column, wide: bool) -> Column:
        no = (t == "") | t.startswith("语文园地") | t.contains("单元·") | t.contains("快乐读书吧") | tc.rlike(f"^{_U}$") | tc.rlike(r"^[◎○]?(?:口语交际|习作例文|习作|综合性学习|专题学习活动)")
        return no | tc.rlike(f"^{_U}·(阅读|识字|汉语拼音)$") | (tc == "我上学了") if wide else no

    for p, wide in ((orphan, False), (orphan_gap, True)):
        title = clean_title(part(p, 1))
        out = out.when(s.rlike(p) & ~strip(part(p, 1)).rlike(r"^\p{Nd}"), let(title, lambda t: let(compact(t), lambda tc: F.when(~bad(t, tc, wide), _entry("sublesson", title=t, page=part(p, 2))))))
    return out


_LESSONS = rf"(?<!\p{{Nd}})(?:\p{{Nd}}{{1,2}}[*＊]?{_S}+.+?\.{{2,}}{_S}*\p{{Nd}}+)|(?<!\p{{Nd}})(?:\p{{Nd}}{{1,2}}[*＊]?{_S}+.+?{_S}{{2,}}\p{{Nd}}+)"


def lesson_pieces(cell: Column) -> Column:
    """The lessons of a cell (lesson) and what is between them, in order; a cell without lessons as it is."""
    return let(strip(cell), lambda s: F.when(s.rlike(_LESSONS), _between_lessons(s)).otherwise(F.array(F.struct(F.lit(True).alias("lesson"), cell.alias("cell")))))


def _between_lessons(s: Column) -> Column:
    pieces = F.split(F.regexp_replace(s, f"({_LESSONS})", "\u0001L$1\u0001"), "\u0001", -1)
    each = F.transform(pieces, lambda p: F.struct(p.startswith("L").alias("lesson"), F.when(p.startswith("L"), F.substring(p, F.lit(2), F.length(p))).otherwise(strip(p)).alias("cell")))
    c = lambda p: compact(p["cell"])
    skipped = lambda p: (c(p) == "") | (~p["lesson"] & ((c(p) == "阅读") | c(p).rlike("^(?:" + "|".join(SKIPPED_PREFIXES) + ")")))
    return F.filter(each, lambda p: ~skipped(p))


def wide_gap_pair(line: Column, gap: int = 10) -> Column:
    """The older split as (left, right)."""
    pieces = split_wide_gap(line, gap)
    return F.struct(F.coalesce(F.get(pieces, F.lit(0)), F.lit("")).alias("left"), F.coalesce(F.get(pieces, F.lit(1)), F.lit("")).alias("right"))


def is_whole_line(raw: Column, entry: Column) -> Column:
    """Whether a line (with its ``parse_cell``) is one entry as it is, so that it is not split: any that the rules name, but
    for a lesson without a page and a title that dots alone lead to its page."""
    bare = (entry["kind"] == "lesson") & entry["page"].isNull()
    dotted = (entry["kind"] == "sublesson") & ~raw.rlike(f"^{_S}{{4,}}") & raw.rlike(rf"\.{{2,}}{_S}*\p{{Nd}}+{_S}*$")
    return F.coalesce(entry.isNotNull() & ~bare & ~dotted, F.lit(False))


def narrow_pair(raw: Column) -> Column:
    """(left, right) of a line without a wide gap that holds two lessons, or a lesson and a garden; else null."""
    s = strip(raw)
    found = F.regexp_extract_all(s, F.lit(f"({_LESSONS})"), F.lit(1))
    first, second = strip(F.get(found, F.lit(0))), strip(F.get(found, F.lit(1)))
    tail = strip(F.substring(s, F.position(F.get(found, F.lit(0)), s) + F.length(F.get(found, F.lit(0))), F.length(s)))
    between = F.length(tail) > 0
    two = (F.size(found) == 2) & s.rlike(rf"(?:{_LESSONS}){_S}{{1,12}}(?:{_LESSONS})")
    garden = (F.size(found) == 1) & between & tail.rlike(rf"^[◎○]?{_S}*语文园地[{NUMERALS}]*(?:{_S}*\.{{2,}}{_S}*\p{{Nd}}+|{_S}{{2,}}\p{{Nd}}{{1,4}})?{_S}*$")
    pair = lambda a, b: F.struct(a.alias("left"), b.alias("right"))
    return F.when(two, pair(first, second)).when(F.coalesce(garden, F.lit(False)), pair(first, tail))


def lone_cell(raw: Column) -> Column:
    """(left, right) of a line that may be one side of two columns: a lesson far to the right, or a lesson alone."""
    none = F.lit("")
    right = rf"^{_S}{{12,}}(\p{{Nd}}{{1,2}}[*＊]?{_S}+.+)$"
    trimmed = F.regexp_replace(raw, f"{_S}+$", "")
    alone = strip(raw).rlike(f"^(?:(?!{_LESSONS}).)*(?:{_LESSONS})$") & (F.size(F.regexp_extract_all(strip(raw), F.lit(f"({_LESSONS})"), F.lit(1))) == 1)
    pair = lambda a, b: F.struct(a.alias("left"), b.alias("right"))
    return F.when(trimmed.rlike(right), pair(none, strip(F.regexp_extract(trimmed, right, 1)))).when(alone, pair(strip(raw), none))


def single_column_cells(rows: DataFrame, part: list[str], gap: int = 10) -> DataFrame:
    """part, block, line_no, side, cell, done: the cells of a contents that is mostly of one column, in reading order of
    (block, side, line_no). ``rows``: line_no, raw, cut (whether a block ends at this blank line).

    Lines that are an entry as they are stand by themselves (done). Lines of two columns gather in a block, read column
    by column, until a line that stands by itself. A lone cell joins the block if that has two lines at least: two
    such lines in a row, and nothing since that ended it."""
    w = Window.partitionBy(*part).orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cuts", F.sum(F.col("cut").cast("int")).over(so_far)).filter(strip(F.col("raw")) != "")
    wide = F.when(F.size(split_wide_gap(F.col("raw"), gap)) == 2, wide_gap_pair(F.col("raw"), gap))
    rows = rows.withColumn("first_entry", parse_cell(F.col("raw"))).withColumn("whole", is_whole_line(F.col("raw"), F.col("first_entry")))
    rows = rows.withColumn("two", F.when(~F.col("whole"), F.coalesce(wide, narrow_pair(F.col("raw")))))
    rows = rows.withColumn("lone", F.when(~F.col("whole") & F.col("two").isNull(), lone_cell(F.col("raw"))))
    ends = F.col("two").isNull() & F.col("lone").isNull()
    rows = rows.withColumn("ends", ends).withColumn("stretch", F.sum(F.col("ends").cast("int")).over(so_far) + F.col("cuts"))
    again = F.col("two").isNotNull() & F.coalesce(F.lag(F.col("two").isNotNull()).over(w) & (F.lag("stretch").over(w) == F.col("stretch")), F.lit(False))
    rows = rows.withColumn("again", again)
    before = Window.partitionBy(*part, "stretch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.max("again").over(before), F.lit(False))
    rows = rows.withColumn("joins", F.col("two").isNotNull() | (F.col("lone").isNotNull() & open_))
    alone = (~F.col("joins")).cast("int")
    rows = rows.withColumn("block", 2 * (F.sum(alone).over(so_far) - alone + F.col("cuts")) + alone)
    sides = F.when(F.col("joins"), F.coalesce("two", "lone")).otherwise(F.struct(F.col("raw").alias("left"), F.lit("").alias("right")))
    rows = rows.withColumn("sides", sides)
    out = rows.select(*part, "block", "line_no", F.col("whole").alias("done"), F.posexplode(F.array("sides.left", "sides.right")).alias("side", "cell"))
    return out.filter(strip(F.col("cell")) != "")


def scan_cells(rows: DataFrame, cell: str, han: int | None = 36, levels: int = 2, halves=None) -> DataFrame:
    """One row for each piece of a cell, with scan (its place in the cell) and the piece as ``cell``.

    A cell is split into columns once more, each is scanned for lessons, and what is between lessons goes the
    same way again, split twice; that has no lesson, so that two levels are all. ``halves`` is another way to split a
    cell. Cells that are marked done are left as they are."""
    rows = rows.withColumn("scan", F.array().cast("array<int>"))
    rows = rows if "done" in rows.columns else rows.withColumn("done", F.lit(False))
    halves = halves or (lambda c: split_columns(c, han))

    def split(rows: DataFrame) -> DataFrame:
        sides = F.when(F.col("done"), F.array(F.col(cell))).otherwise(F.array("split.left", "split.right"))
        rows = rows.withColumn("split", halves(F.col(cell)))
        rows = rows.select(*[x for x in rows.columns if x not in (cell, "split")], F.posexplode(sides).alias("at", cell)).filter(strip(F.col(cell)) != "")
        return rows.withColumn("scan", F.concat("scan", F.array("at"))).drop("at")

    for level in range(levels):
        rows = split(split(rows) if level else rows)
        pieces = F.when(F.col("done"), F.array(F.struct(F.lit(True).alias("lesson"), F.col(cell).alias("cell")))).otherwise(lesson_pieces(F.col(cell)))
        rows = rows.select(*[x for x in rows.columns if x not in (cell, "done")], F.posexplode(pieces).alias("at", "piece"))
        rows = rows.withColumn("scan", F.concat("scan", F.array("at"))).withColumn("done", F.col("piece.lesson")).withColumn(cell, F.col("piece.cell")).drop("at", "piece")
    return rows.drop("done")


def is_skipped(c: Column) -> Column:
    """Whether a compacted cell is none of the contents: blank, a bare column head, or the head of an appendix."""
    out = (c == "") | (c == "阅读")
    for p in SKIPPED_PREFIXES:
        out = out | c.startswith(p)
    return out


def group_tree(entries: DataFrame, part: list[str], order: str, is_section: Column, label: Column) -> DataFrame:
    """Add group_id (dense from 1; rows before the first section have a group of their own) and group_label."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = entries.withColumn("is_section", is_section)
    rows = rows.withColumn("sections", F.sum(F.col("is_section").cast("int")).over(w))
    rows = rows.withColumn("group_label", F.last(F.when(F.col("is_section"), label), ignorenulls=True).over(w))
    leading = F.max((F.col("sections") == 0).cast("int")).over(Window.partitionBy(*part))
    return rows.withColumn("group_id", F.col("sections") + leading).drop("sections")


def typed(entries: DataFrame, title: Column) -> DataFrame:
    """Add unit_type and unit_subtype by the keyword rules."""
    return entries.withColumn("u", unit_type(title)).select("*", "u.unit_type", "u.unit_subtype").drop("u")
