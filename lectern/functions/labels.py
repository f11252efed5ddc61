"""How entries of the contents and rows of tables are named, typed and shown.

An entry is a struct with id, kind, number, title, label, block, subtitle, sublesson_title, optional_reading,
group_label; fields that it lacks count as null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.rules import GARDEN, UNIT_NUMERALS
from lectern.functions.text import compact, strip

# --- Fixed values: names that results hold --------------------------------------------------------------
CLUB, BELTS = "快乐读书吧", ("口语交际", "习作", "综合性学习")
ENROLMENT, POETRY, POETRY_HEADS = "我上学了", "古诗词诵读", ("古诗词诵读", "古诗诵读")
READING_MODES = ("识字", "阅读", "汉语拼音")
# --------------------------------------------------------------------------------------------------------
FIELDS = ("id", "kind", "number", "title", "label", "block", "subtitle", "sublesson_title", "optional_reading", "group_label")


def reader(entry: Column, fields: tuple[str, ...] | list[str] = FIELDS) -> Callable[[str], Column]:
    """A function from a field's name to its text: stripped, empty for null or where the entry has no such field."""
    return lambda f: F.coalesce(strip(entry[f].cast("string")), F.lit("")) if f in fields else F.lit("")


def _by_kind(kind: Column, cases: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for name, value in cases.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return otherwise if out is None else out.otherwise(otherwise)


def _first(*values: Column) -> Column:
    """The first that is not empty, else empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))


def _both(a: Column, b: Column, sep: str) -> Column:
    """Both joined by ``sep``, or the one that is there."""
    return F.array_join(F.filter(F.array(a, b), lambda x: x != ""), sep)


def _in_brackets(x: Column) -> Column:
    return F.when(x == "", "").otherwise(F.concat(F.lit("（"), x, F.lit("）")))


def _starred(entry: Column, fields) -> Column:
    return F.when(F.coalesce(entry["optional_reading"], F.lit(False)), "*").otherwise("") if "optional_reading" in fields else F.lit("")


def chunk_label(entry: Column, fields=FIELDS) -> Column:
    """The label of a chunk of the body."""
    t = reader(entry, fields)
    lesson = F.when(t("title") == "", t("number")).otherwise(strip(F.concat(t("number"), _starred(entry, fields), F.lit(" "), t("title"))))
    cases = {
        "section": _first(t("label"), t("group_label"), t("id")),
        "lesson": lesson,
        "sublesson": t("title"),
        "garden": t("label"),
        "reading_club": F.concat(F.lit(CLUB), _in_brackets(t("subtitle"))),
        "block_activity": _both(t("block"), t("title"), " "),
        "toc_belt": _both(t("label"), t("title"), " "),
    }
    return _by_kind(t("kind"), cases, _first(t("id"), t("kind")))


def web_label(entry: Column, fields=FIELDS) -> Column:
    """The label of an entry in a list of choices."""
    t = reader(entry, fields)
    cases = {
        "lesson": _first(_both(t("number"), t("title"), " "), t("id")),
        "sublesson": _first(t("title"), t("id")),
        "garden": _first(t("label"), t("id")),
        "section": _first(t("label"), t("id")),
        "block_activity": _first(_both(t("block"), t("title"), " · "), t("id")),
        "reading_club": _first(_both(t("title"), t("subtitle"), " · "), t("id")),
    }
    return _by_kind(t("kind"), cases, _first(t("label"), t("title"), t("id")))


def flat_line(entry: Column, fields=FIELDS) -> Column:
    """The entry as one line of a flat contents; null for sections and kinds that have none."""
    t = reader(entry, fields)
    cases = {
        "lesson": F.concat(t("number"), _starred(entry, fields), F.lit(" "), t("title"), _in_brackets(t("sublesson_title"))),
        "garden": t("label"),
        "reading_club": _both(F.lit(CLUB), _first(t("subtitle"), t("sublesson_title")), " "),
        "toc_belt": F.concat(t("label"), t("title")),
        "block_activity": F.concat_ws(" ", t("block"), t("title")),
        "sublesson": t("title"),
        "reading_pick": t("title"),
    }
    return _by_kind(t("kind"), cases, F.lit(None).cast("string"))


def rule_line(entry: Column, fields=FIELDS) -> Column:
    """The compacted line that the rules of unit types are held against; empty for kinds without one."""
    t = reader(entry, fields)
    cases = {
        "lesson": F.concat(t("number"), _starred(entry, fields), t("title"), _in_brackets(t("sublesson_title"))),
        "reading_club": F.concat(F.lit(CLUB), _first(t("subtitle"), t("sublesson_title"))),
        "block_activity": F.concat(t("block"), t("title")),
        "sublesson": t("title"),
        "toc_belt": F.concat(t("label"), t("title")),
        "garden": t("label"),
        "section": t("label"),
    }
    return compact(_by_kind(t("kind"), cases, F.lit("")))


def reading_mode(group_label: Column) -> Column:
    """What a group of lessons teaches by its head, or null."""
    c = compact(F.coalesce(group_label, F.lit("")))
    out = F.when(c.contains(f"单元·{READING_MODES[0]}"), READING_MODES[0])
    for mode in READING_MODES[1:]:
        out = out.when(c.contains(f"单元·{mode}"), mode)
    return out.when(c.rlike(f"^第[{UNIT_NUMERALS}]+单元$"), "阅读")


def is_enrolment(group_label: Column) -> Column:
    return F.coalesce(compact(group_label) == ENROLMENT, F.lit(False))


def is_poetry(group_label: Column) -> Column:
    return F.coalesce(compact(group_label).isin(*POETRY_HEADS), F.lit(False))


def default_unit_type(entry: Column, group_label: Column, strand: Column, fields=FIELDS) -> Column:
    """(unit_type, unit_subtype) by the kind of an entry, its group and the belt that it is under."""
    t = reader(entry, fields)

    def pair(kind: str, sub: Column | str | None = None) -> Column:
        return F.struct(F.lit(kind).alias("unit_type"), (sub if isinstance(sub, Column) else F.lit(sub).cast("string")).alias("unit_subtype"))

    def activity(name: Column, more: tuple[str, ...] = ()) -> Column:
        out = F.when(name == "习作例文", pair("习作", "习作例文"))
        for x in (*BELTS, *more):
            out = out.when(name == x, pair(x))
        return out.otherwise(pair("未分类"))

    lesson = F.lit(None)
    for x in BELTS:
        lesson = F.when(strand == x, pair(x)) if x == BELTS[0] else lesson.when(strand == x, pair(x))
    lesson = lesson.when(is_enrolment(group_label), pair("入学教育")).when(is_poetry(group_label), pair(POETRY)).otherwise(pair("课文", reading_mode(group_label)))
    section = F.when(is_enrolment(t("label")), pair("分组", "入学教育")).when(compact(t("label")) == POETRY, pair(POETRY)).otherwise(pair("分组"))
    cases = {
        "toc_belt": activity(t("label")),
        "block_activity": activity(t("block"), ("专题学习活动",)),
        "garden": pair(GARDEN),
        "reading_club": pair(CLUB),
        "lesson": lesson,
        "sublesson": lesson,
        "section": section,
    }
    return _by_kind(t("kind"), cases, pair("未分类"))


def unit_of(entry: Column, seq: Column, fields=FIELDS) -> Column:
    """The unit that a table row is bound to: toc_id, toc_kind, toc_index, unit_type, lesson, garden_cn, title, label."""
    t = reader(entry, fields)
    filled = lambda x: F.when(x != "", x)
    tail = _first(t("subtitle"), t("sublesson_title"))
    kinds = {"block_activity": F.lit("block"), "toc_belt": F.lit("belt")}
    label = {
        "lesson": _first(F.concat(_both(t("number"), t("title"), " "), _in_brackets(t("sublesson_title"))), t("id")),
        "garden": t("label"),
        "reading_club": _both(F.lit(CLUB), tail, " "),
        "block_activity": _both(t("block"), t("title"), " "),
        "toc_belt": F.concat(t("label"), t("title")),
        "sublesson": t("title"),
    }
    titled = t("kind").isin("lesson", "block_activity", "toc_belt", "sublesson")
    garden = F.when(compact(t("label")).startswith(GARDEN), F.substring(compact(t("label")), len(GARDEN) + 1, 64))
    return F.struct(
        filled(t("id")).alias("toc_id"),
        filled(t("kind")).alias("toc_kind"),
        seq.cast("int").alias("toc_index"),
        _by_kind(t("kind"), kinds, _first(t("kind"), F.lit("unknown"))).alias("unit_type"),
        F.when(t("kind") == "lesson", filled(t("number"))).alias("lesson"),
        F.when(t("kind") == "garden", filled(garden)).alias("garden_cn"),
        F.when(titled, filled(t("title"))).when(t("kind") == "reading_club", filled(tail)).alias("title"),
        _by_kind(t("kind"), label, _first(t("id"), t("kind"))).alias("label"),
    )


def row_label(unit_label: Column, unit_title: Column, lesson: Column, garden: Column) -> Column:
    """The label of a table row: its unit's label or title, else its garden or lesson, else empty."""
    filled = lambda x: F.when(x != "", x)
    return F.coalesce(filled(unit_label), filled(unit_title), F.concat(F.lit("园地"), filled(garden)), F.concat(F.lit("课"), lesson), F.lit(""))


def row_chars(items: Column, chars: Column) -> Column:
    """The characters of a row: of its items where it has any, else its plain list."""
    own = F.filter(F.transform(items, lambda x: x["char"]), lambda c: c.isNotNull() & (c != ""))
    return F.when(F.size(F.coalesce(items, F.array().cast("array<struct<char:string,pinyin:string>>"))) > 0, own).otherwise(F.coalesce(chars, F.array().cast("array<string>")))
