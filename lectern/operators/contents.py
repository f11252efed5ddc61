"""From layout lines to the entries of a table of contents, and the four public extractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import labels
from lectern.functions.rules import starts_section, unit_type
from lectern.functions.text import compact, strip, synthetic_id
from lectern.operators import chunks, layout, lines, tables
from lectern.operators.sequences import carry_with_reset, collapse_entries, next_value, reposition_first

# --- Fixed values: the default patterns of the contents region ------------------------------------------
START, ENDS = ["目录"], [r"识字表.*\d+", r"写字表.*\d+", "第一单元.*"]
CHAR_TABLES = {"识字表": r"(\(|（)共\d+个生字(\)|）)", "写字表": r"(\(|（)共\d+个字(\)|）)"}
WORD_TABLE, WORD_ENDS = "词语表", [r"(\(|（)共\d+个词(\)|）)", "后记"]
MOVE_BEFORE, MOVE_BLOCKS = "第六单元", ("口语交际",)
# --------------------------------------------------------------------------------------------------------


def extract_contents(ln: DataFrame, part: list[str], han: int | None = 36, start=None, ends=None, move_before: str | None = MOVE_BEFORE, move_blocks: tuple[str, ...] = MOVE_BLOCKS, columns: int | None = 2, gap: int = 10) -> DataFrame:
    """part, toc_index, id, group_id, group_label, unit_type, unit_subtype, entry of every contents entry.

    Lines are split into columns, cells come in column-major order within blocks (a blank line before a new
    section begins a block), equal neighbours are dropped, cells are scanned for lessons and parsed, the first
    activity of ``move_blocks`` after the section ``move_before`` that stood alone on the right of its line goes
    before that section; then ``finish_entries``. With ``columns`` other than 2, lines are read by
    ``single_column_cells``."""
    rows = lines.contents_region(ln, part, start or START, ends or ENDS)
    w = Window.partitionBy(*part).orderBy("line_no")
    follows = next_value(F.when(F.col("compact") != "", F.col("raw")), part, ["line_no"])
    rows = rows.withColumn("cut", (F.col("compact") == "") & F.coalesce(starts_section(follows), F.lit(False)))
    rows = rows.withColumn("block", F.sum(F.col("cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if columns != 2:
        each = layout.single_column_cells(rows.select(*part, "line_no", "raw", "cut"), part, gap).withColumn("right_only", F.lit(False))
        each = layout.scan_cells(each, "cell", halves=lambda c: layout.wide_gap_pair(c, gap))
        return _read(each, part, None, ())
    cells = rows.filter("compact <> ''").withColumn("s", layout.split_columns(F.col("raw"), han))
    before = F.lag("s").over(Window.partitionBy(*part, "block").orderBy("line_no"))
    cells = cells.withColumn("again", F.coalesce(before == F.col("s"), F.lit(False))).filter("not again")
    each = cells.select(*part, "block", "line_no", (strip(F.col("s.left")) == "").alias("right_only"), F.posexplode(F.array("s.left", "s.right")).alias("side", "cell"))
    return _read(layout.scan_cells(each, "cell", han), part, move_before, move_blocks)


def _read(each: DataFrame, part: list[str], move_before: str | None, move_blocks: tuple[str, ...]) -> DataFrame:
    """The entries of cells (block, side, line_no, scan, cell, right_only) in reading order."""
    parsed = each.withColumn("entry", layout.parse_cell(F.col("cell"))).filter("entry is not null")
    order = Window.partitionBy(*part).orderBy("block", "side", "line_no", "scan")
    parsed = parsed.withColumn("read_no", F.row_number().over(order))
    movable = (F.col("entry.kind") == "block_activity") & F.coalesce(F.col("entry.block").isin(*move_blocks), F.lit(False)) & F.col("right_only") & (F.col("side") == 1)
    target = F.lit(False) if move_before is None else (F.col("entry.kind") == "section") & (F.col("entry.label") == move_before)
    parsed = reposition_first(parsed, movable, target, part, "read_no").withColumnRenamed("new_no", "place")
    entries = finish_entries(parsed, part, "place")
    return entries.select(*part, "toc_index", "id", "group_id", "group_label", "unit_type", "unit_subtype", "entry")


#: Kinds that end what a belt covers.
_STRAND_ENDS = ("section", "garden", "reading_club", "block_activity")


def finish_entries(parsed: DataFrame, part: list[str], order: str) -> DataFrame:
    """Groups, unit types, merged children, numbers and ids of parsed entries (a column entry) in their order."""
    kind = F.col("entry.kind")
    grouped = layout.group_tree(parsed, part, order, kind == "section", F.col("entry.label"))
    strand = carry_with_reset(F.when(kind == "toc_belt", F.coalesce("entry.label", F.lit(""))), kind.isin(*_STRAND_ENDS), part, [order])
    fields = [f.name for f in grouped.schema["entry"].dataType.fields]
    grouped = grouped.withColumn("strand", strand)
    base = labels.default_unit_type(F.col("entry"), F.col("group_label"), F.col("strand"), fields)
    rule = unit_type(labels.rule_line(F.col("entry"), fields))
    typed = grouped.withColumn("base", base).withColumn("rule", rule)
    typed = typed.withColumn("unit_type", F.coalesce("rule.unit_type", "base.unit_type")).withColumn("unit_subtype", F.coalesce("rule.unit_subtype", "base.unit_subtype"))
    marked = collapse_entries(typed, kind, part, [order])
    child = F.lead("entry").over(Window.partitionBy(*part).orderBy(order))
    marked = marked.withColumn("child", F.when(F.col("takes"), child)).filter("not taken")
    own, other = compact(F.col("entry.title")), compact(F.col("child.title"))
    second = F.when((own != "") & (other != "") & (own != other), strip(F.col("child.title")))
    merged = F.struct(*[(F.coalesce(F.col(f"entry.{f}"), second, F.col(f"child.{f}")) if f == "sublesson_title" else F.coalesce(F.col(f"entry.{f}"), F.col(f"child.{f}"))).alias(f) for f in fields])
    marked = marked.withColumn("entry", merged)
    numbered = marked.withColumn("toc_index", F.row_number().over(Window.partitionBy(*part).orderBy(order)) - 1)
    numbered = numbered.withColumn("id", synthetic_id(F.col(part[0]).cast("string"), F.col("toc_index") + 1))
    return numbered.withColumn("entry", F.col("entry").withField("group_label", F.col("group_label")).withField("unit_subtype", F.col("unit_subtype")).withField("id", F.col("id")))


def rejected_cells(ln: DataFrame, part: list[str], han: int | None = 36, start=None, ends=None) -> DataFrame:
    """part, line_no, raw of the lines of the contents of which no cell is an entry and that are no skipped heads."""
    rows = lines.contents_region(ln, part, start or START, ends or ENDS).filter("compact <> ''").withColumn("s", layout.split_columns(F.col("raw"), han))
    each = layout.scan_cells(rows.select(*part, "line_no", "raw", "compact", F.explode(F.array("s.left", "s.right")).alias("cell")), "cell", han)
    known = each.withColumn("hit", layout.parse_cell(F.col("cell")).isNotNull()).groupBy(*part, "line_no").agg(F.max("hit").alias("hit"))
    out = rows.join(known, [*part, "line_no"], "left").filter(~F.coalesce("hit", F.lit(False)) & ~layout.is_skipped(F.col("compact")))
    return out.select(*part, "line_no", "raw")


def extract_char_table(ln: DataFrame, part: list[str], name: str = "识字表", entries: DataFrame | None = None, start=None, end=None, discard=None, unit_heads=None) -> DataFrame:
    """Rows of a character table, bound to the contents where they are given. Each table has its own discards."""
    end = end or CHAR_TABLES[name]
    discard = tables.DISCARDED_OF[name] if discard is None else discard
    rows = tables.char_rows(lines.full_match_region(ln, part, start or [name], [end]), part, unit_heads, discard, total=end)
    return rows if entries is None else tables.assign_units(rows, entries, part)


def extract_word_table(ln: DataFrame, part: list[str], entries: DataFrame | None = None, start=None, ends=None, discard=None) -> DataFrame:
    ends = ends or WORD_ENDS
    rows = tables.word_rows(lines.full_match_region(ln, part, start or [WORD_TABLE], ends), part, discard, total=ends[0])
    return rows if entries is None else tables.assign_units(rows, entries, part, words=True)


def extract_chunks(ln: DataFrame, part: list[str], entries: DataFrame, body_start: int | None = None) -> DataFrame:
    """Spans of the contents' titles in the body, with their text."""
    bounds = lines.body_bounds(ln, part, override=body_start)
    spans = chunks.propose_spans(ln, entries.withColumnRenamed("toc_index", "ord"), bounds, part)
    return lines.cut_text(ln, spans, part, ["ord"])


#: The registry of extractions: name -> function of (lines, part).
EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    "目录": extract_contents,
    "识字表": lambda ln, part, **k: extract_char_table(ln, part, "识字表", **k),
    "写字表": lambda ln, part, **k: extract_char_table(ln, part, "写字表", **k),
    "词语表": extract_word_table,
}


def _listed(value) -> list[str] | None:
    return None if value is None else [value] if isinstance(value, str) else list(value)


def options_of(name: str, block: dict) -> dict:
    """The arguments of an extraction from its block of the configuration (``options`` in it win over its other keys)."""
    o = {k: v for k, v in block.items() if k != "options"} | (block.get("options") or {})
    start, ends, discard = (_listed(o.get(k)) for k in ("start_line_pattern", "end_line_patterns", "discard_line_patterns"))
    ends = ends or _listed(o.get("end_line_pattern"))
    if name == "目录":
        out = {"start": start, "ends": ends, "columns": o.get("column_number"), "han": o.get("toc_content_width_han", 36), "gap": max(4, int(o.get("min_column_gap") or 10))}
        before = "toc_dual_right_only_move_before_section"
        return out | ({"move_before": o[before] or None} if before in o else {})
    if name == WORD_TABLE:
        return {"start": start, "ends": ends, "discard": discard}
    return {"start": start, "end": ends[0] if ends else o.get("total_pattern"), "discard": discard, "unit_heads": _listed(o.get("unit_head_pattern"))}


def title_groups(entries: DataFrame, part: list[str]) -> DataFrame:
    """part, group_id, group_label, titles: the two-level tree of the contents."""
    rows = entries.filter("entry.kind <> 'section'").select(*part, "group_id", "group_label", "toc_index", compact(F.coalesce("entry.title", "entry.label")).alias("t"))
    return rows.groupBy(*part, "group_id", "group_label").agg(F.transform(F.array_sort(F.collect_list(F.struct("toc_index", "t"))), lambda x: x["t"]).alias("titles"))
