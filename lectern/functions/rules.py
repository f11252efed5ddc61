"""Predicates and decision lists over lines: first match wins, as one CASE expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import CIRCLED, CJK, cjk_chars, cjk_words, compact, normalise_spaces, strip, strip_tabs

# --- Fixed values: words and patterns that results depend on ------------------------------------------
NUMERALS = "一二三四五六七八九十"
UNIT_NUMERALS = "一二三四五六七八九十百千万"
GARDEN = "语文园地"
COLUMN_HEADS = ("阅读", "识字", "写字", "汉语拼音", "口语交际", "习作", "语文园地", "快乐读书吧", "日积月累", "词句段运用", "书写提示", "我的发现", "交流平台")
APPENDIX_HEADS = ("识字表", "写字表", "词语表")
SKIPPED_PREFIXES = ("识字表", "写字表", "词语表", "笔画名称表", "常用偏旁名称表")
SECTION_WORDS = ("识字", "阅读", "写字")
UNIT_TYPES = (
    ("汉语拼音", "汉语拼音", None),
    ("口语交际", "口语交际", None),
    ("习作例文", "习作", "习作例文"),
    ("习作", "习作", None),
    ("快乐读书吧", "快乐读书吧", None),
    ("语文园地", "语文园地", None),
    ("古诗词诵读", "古诗词诵读", None),
    ("综合性学习", "综合性学习", None),
    ("综合实践", "综合活动", None),
    ("综合活动", "综合活动", None),
    ("专题学习活动", "专题学习活动", None),
)
TRUTHY = ("1", "y", "yes", "true", "x", "是", "√", "✓", "*")
# -------------------------------------------------------------------------------------------------------


def full_match(c: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches the whole of a compacted line; patterns are checked here."""
    for p in patterns:
        re.compile(p)
    return c.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$") if patterns else F.lit(False)


def is_anchor(c: Column, unit_heads: list[str] | None) -> Column:
    """Whether a line begins a block of its own; without patterns every line does."""
    return c.rlike("^(?:" + "|".join(f"(?:{p})" for p in unit_heads) + ")") if unit_heads else F.lit(True)


def noise(line: Column) -> Column:
    """The kind of noise a stripped line is, or null."""
    s = strip(line)
    return (
        F.when(s == "", "空行")
        .when(s.contains("仅供个人"), "版权声明")
        .when(s.startswith("①") & s.contains("识字表"), "脚注①")
        .when(s.rlike(r"^\p{Nd}{1,3}$"), "页码")
        .when(s == "①", "单独圆圈①")
    )


def is_pinyin(line: Column) -> Column:
    return normalise_spaces(strip_tabs(line)).rlike("^[a-zA-ZüÜ]+( [a-zA-ZüÜ]+)*$") & normalise_spaces(strip_tabs(line)).rlike("[a-zA-Z]")


def section_word(c: Column) -> Column:
    return F.when(c.isin(*SECTION_WORDS), c)


def hanzi_line(line: Column) -> Column:
    """A character-table line as (lesson, garden, chars), or null: garden with a numeral, garden with a
    tail, lesson, bare garden title, loose characters, in this order."""
    s = normalise_spaces(line)

    def row(lesson: Column, garden: Column, tail: Column | None) -> Column:
        return F.struct(lesson.alias("lesson"), garden.alias("garden"), (cjk_chars(tail) if tail is not None else F.array().cast("array<string>")).alias("chars"))

    none = F.lit(None).cast("string")
    numbered, plain, lesson = f"^{GARDEN}([{NUMERALS}]+) *(.*)$", f"^{GARDEN} *(.+)$", r"^(\p{Nd}+) +(.+)$"
    return (
        F.when(~s.rlike(f"[{CJK}]") | s.isin(*SECTION_WORDS), None)
        .when(s.rlike(numbered), row(none, F.regexp_extract(s, numbered, 1), F.regexp_extract(s, numbered, 2)))
        .when(s.rlike(plain), row(none, F.lit(""), F.regexp_extract(s, plain, 1)))
        .when(s.rlike(lesson), row(F.regexp_extract(s, lesson, 1), none, F.regexp_extract(s, lesson, 2)))
        .when(s == GARDEN, row(none, F.lit(""), None))
        .otherwise(row(none, none, s))
    )


WORD_LESSON, WORD_GARDEN = r"^(\p{Nd}{1,2}) +(.+)$", f"^{GARDEN} +(.+)$"


def word_line(line: Column) -> Column:
    """A word-table line as (lesson, words), or null if it begins no row."""
    s = normalise_spaces(line)

    def row(lesson: Column, tail: Column) -> Column:
        return F.struct(lesson.alias("lesson"), cjk_words(tail).alias("words"))

    return F.when(s.rlike(WORD_LESSON), row(F.regexp_extract(s, WORD_LESSON, 1), F.regexp_extract(s, WORD_LESSON, 2))).when(s.rlike(WORD_GARDEN), row(F.lit(GARDEN), F.regexp_extract(s, WORD_GARDEN, 1)))


def is_page_number(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}{1,3}$")


def is_column_head(c: Column) -> Column:
    return c.isin(*COLUMN_HEADS)


def is_appendix_head(c: Column) -> Column:
    return c.isin(*APPENDIX_HEADS)


def is_short(c: Column, most: int = 2) -> Column:
    return F.length(c) <= most


def is_footnote(c: Column) -> Column:
    return (c != "") & (c.rlike(f"^[{CIRCLED}]") | ((c.contains("本文作者") | c.contains("选作课文") | c.contains("选自")) & (F.length(c) < 40)))


def is_unit_title(c: Column) -> Column:
    return c.rlike(f"^第[{UNIT_NUMERALS}]+单元$")


def starts_section(line: Column) -> Column:
    c = compact(line)
    return c.rlike(f"^第[{UNIT_NUMERALS}]+单元(?:·(?:阅读|识字|汉语拼音)|(?:\\.+\\p{{Nd}}+)?$)") | c.isin("我上学了", "古诗词诵读", "古诗诵读")


def is_pinyin_body(line: Column) -> Column:
    """A long line that holds a run of mixed-case layout pinyin."""
    s = strip(line)
    return (F.length(s) >= 12) & s.rlike("[a-z][A-Za-z]*[A-Z][a-z]")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*TRUTHY), F.lit(False))


def unit_type(title: Column, rules=UNIT_TYPES) -> Column:
    """(unit_type, unit_subtype) by the first keyword that begins the compacted title, or null."""
    c, out = compact(title), None
    for keyword, kind, sub in rules:
        hit = F.struct(F.lit(kind).alias("unit_type"), F.lit(sub).cast("string").alias("unit_subtype"))
        pattern = f"^[◎○]?{keyword}[:：]?"
        out = F.when(c.rlike(pattern), hit) if out is None else out.when(c.rlike(pattern), hit)
    return out if out is not None else F.lit(None)


def decide(rules: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """A decision list: the value of the first condition that holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    out = out if out is not None else F.lit(None)
    return out if otherwise is None else out.otherwise(otherwise)


def strand_fits(section: Column, strand: Column) -> Column:
    """Whether a table's section takes entries of a strand; an unknown strand fits everywhere."""
    return section.isNull() | strand.isNull() | (strand == section) | ((section == "识字") & (strand == "汉语拼音")) | ~section.isin("识字", "阅读")

