"""Column functions over lines of text. Character classes are explicit, as engines differ in what they call
white space, digits or words. Each class has a spelling for Java and one for RE2 (``*_RE2``)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: classes, maps and lists that results depend on -------------------------------------
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_RE2 = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
OTHER_LINE_END = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LINE_END_RE2 = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
CJK = r"一-鿿·"
TONE_FROM, TONE_TO = "QWASTYGHERDFUIJKOPLMNBVC", "āáǎàōóǒòēéěèīíǐìūúǔùǖǘǚǜ"
OTHER_CAPITALS, OTHER_SMALL = "XZÜ", "xzü"
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("「", "」"), ("『", "』"))
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u200e\u200f"
COMMON_WIDE = r"\u3400-\u4dbf\u4e00-\u9fff"
ZERO_WIDTH_LEADING = "\u200b\u200c\u200d\ufeff\u2060\u2061\u2062\u2063"
DIGITS = r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
# -------------------------------------------------------------------------------------------------------

# Java tries the members of a class one by one: those that are rare stand behind one range.
_FAST = SPACE.replace(r"\u1680", r"[\u1680-\u3000&&[\u1680", 1) + "]]"
_S = f"[{_FAST}]"
_FOLDED = f"[{_FAST}\\u200b\\ufeff]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_tabs(s: Column) -> Column:
    return F.translate(s, "\t", "")


def compact(s: Column) -> Column:
    """Without any white space; zero-width characters stay. Plain spaces, nearly all there is, go without a pattern."""
    return F.regexp_replace(F.replace(s, F.lit(" "), F.lit("")), _S + "+", "")


def strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^{_S}+|{_S}+$", "")


def normalise_spaces(s: Column) -> Column:
    """Runs of white space, zero-width space and byte-order mark as one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(s, _FOLDED + "+", " "), "^ +| +$", "")


def strip_circled(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{CIRCLED}]+", "")


def strip_zero_width(s: Column) -> Column:
    return F.translate(s, ZERO_WIDTH, "")


def clean_title(s: Column) -> Column:
    """Without trailing dots and outer white space."""
    return strip(F.regexp_replace(strip(s), r"\.+$", ""))


def tone_marked(s: Column) -> Column:
    """A layout-coded syllable with its tone mark: capitals stand for a vowel with a tone."""
    return F.translate(s, TONE_FROM + OTHER_CAPITALS, TONE_TO + OTHER_SMALL)


def transcribe(line: Column) -> Column:
    """``tone_marked`` of all but what lies between a pair of quotes."""
    quoted = "|".join(f"{a}[^{b}]*{b}" for a, b in QUOTES)
    parts = F.regexp_extract_all(line, F.lit(f"((?:{quoted})|[\\s\\S])"), F.lit(1))
    return F.array_join(F.transform(parts, lambda t: F.when(F.length(t) > 1, t).otherwise(_letters_marked(t))), "")


def _letters_marked(t: Column) -> Column:
    return F.when(t.rlike("^[A-Za-züÜ]$"), tone_marked(t)).otherwise(t)


def code_points(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def graphemes(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"(\X)"), F.lit(1))


def han_only(chars: Column) -> Column:
    return F.filter(chars, lambda c: c.rlike(r"\p{IsHan}"))


def cjk_chars(s: Column) -> Column:
    """The characters of the range in order, repeats kept."""
    return F.regexp_extract_all(s, F.lit(f"([{CJK}])"), F.lit(1))


def cjk_words(s: Column) -> Column:
    """Space-separated tokens that hold a character of the range."""
    return F.filter(F.split(normalise_spaces(s), " "), lambda t: t.rlike(f"[{CJK}]"))


def with_pinyin(chars: Column, pinyin: Column) -> Column:
    """Characters zipped with the syllables at their place; null where there is none."""
    marks = F.filter(F.split(normalise_spaces(pinyin), " "), lambda t: t != "")
    return F.transform(chars, lambda c, i: F.struct(c.alias("char"), tone_marked(F.get(marks, i)).alias("pinyin"), F.lit(False).alias("polyphone")))


def wide_class() -> str:
    """The wide and full-width characters of the Basic Multilingual Plane as a Java class body."""
    runs: list[list[int]] = []
    for i in range(0x1100, 0x10000):
        if unicodedata.east_asian_width(chr(i)) in "FW" or i in (0x3000, 0x2001, 0x2003):
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def display_width(s: Column, tab: int = 4) -> Column:
    """Columns that a line takes: 2 for wide characters, ``tab`` for a tab, else 1.

    No character under U+1100 is wide: one range tells whether the class is to be tried at all, and then keeps most
    other characters from it; runs of the commonest wide ones are one range, too."""
    low = "[\\u1100-\\uffff]"
    rest = F.regexp_replace(F.regexp_replace(s, f"[{COMMON_WIDE}]+", ""), f"[\\u1100-\\uffff&&[{wide_class()}]]+", "")
    wide = F.when(s.rlike(low), F.length(s) - F.length(rest)).otherwise(F.when(s.isNotNull(), 0))
    return F.length(s) + wide + (tab - 1) * (F.length(s) - F.length(F.replace(s, F.lit("\t"), F.lit(""))))


def leading_blank(s: Column) -> Column:
    return F.regexp_extract(s, f"^[{SPACE}{ZERO_WIDTH_LEADING}]*", 0)


def leading_width(s: Column, tab: int = 4) -> Column:
    return display_width(F.translate(leading_blank(s), ZERO_WIDTH_LEADING, ""), tab)


def preview(s: Column, most: int = 200) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def synthetic_id(prefix: Column, number: Column) -> Column:
    return F.format_string("%s-toc-%04d", prefix, number)


def replace_template(template: str, char: Column) -> Column:
    """``$1`` in the template becomes the character; a template without it is taken whole."""
    return F.replace(F.lit(template), F.lit("$1"), char) if "$1" in template else F.lit(template)


def title_score(c: Column) -> Column:
    han = F.size(F.regexp_extract_all(c, F.lit(r"([一-鿿])"), F.lit(1)))
    return F.when(c == "", 0).otherwise(10 * han + F.least(F.length(c), F.lit(40)))


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def keep_token(t: Column, ascii_letters: bool = True, digits: bool = True, punctuation: bool = True) -> Column:
    """Not empty, and none of: pure ASCII letters, pure digits, pure punctuation. Each test can be left out."""
    drop = t == ""
    for on, pattern in ((ascii_letters, "^[A-Za-z]+$"), (digits, f"^[{DIGITS}]+$"), (punctuation, r"^\p{P}+$")):
        if on:
            drop = drop | t.rlike(pattern)
    return ~drop
