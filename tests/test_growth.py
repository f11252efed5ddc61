"""What a line costs: steps that were computed several times, or once for each word or length there is."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import chunks, layout, lines, lookup


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _docs(spark, rows):
    return lines.explode_lines(spark.createDataFrame(rows, "doc_id int, text string"))


def test_lines_are_split_once(spark):
    odd = [(1, "a\r\nb\x0bc\x85d e\n"), (2, "x\ny"), (3, ""), (4, "\n"), (5, "\r"), (6, None), (7, "p\n\n"), (8, "\n\r")]
    got = {}
    for r in _docs(spark, odd).select("doc_id", "line_no", "raw").collect():
        got.setdefault(r[0], []).append(r[2])
    assert got == {1: ["a", "b", "c", "d", "e"], 2: ["x", "y"], 4: [""], 5: [""], 7: ["p", ""], 8: ["", ""]}
    assert _plan(_docs(spark, odd)).count("split(") == 2  # one with a pattern, one without, of which one runs


def test_body_bounds_reads_lines_once(spark):
    ln = _docs(spark, [(1, "E\nS\nx\nE\nE"), (2, "x\ny"), (3, "x\n" * 600 + "E"), (4, "S\n" + "x\n" * 600 + "E")])
    out = lines.body_bounds(ln, ["doc_id"], is_start=F.col("compact") == "S", is_end=F.col("compact") == "E")
    assert sorted(map(tuple, out.collect())) == [(1, 1, 3, 5), (2, 0, 2, 2), (3, 0, 600, 601), (4, 0, 601, 602)]
    assert _plan(out).count("Generate") == 1
    moved = lines.body_bounds(ln, ["doc_id"], override=4, is_end=F.col("compact") == "E")
    assert sorted(map(tuple, moved.collect())) == [(1, 4, 4, 5), (2, 1, 2, 2), (3, 4, 600, 601), (4, 4, 601, 602)]


def test_width_tries_the_wide_class_behind_a_range(spark):
    odd = ["", "abc\td", "中文ab", "é́ñ", "ｆｕｌｌ", "ᄀᅟᅠ", "한글", "😀a", "　 x", "、。〈〉", "〿⌚⏰", None]
    df = spark.createDataFrame([(s,) for s in odd], "s string").select("s", text.display_width(F.col("s")).alias("w"))
    wide = lambda c: ord(c) < 0x10000 and ord(c) >= 0x1100 and (unicodedata.east_asian_width(c) in "FW" or ord(c) in (0x3000, 0x2001, 0x2003))
    for s, w in df.collect():
        assert w == (None if s is None else sum(4 if c == "\t" else 2 if wide(c) else 1 for c in s))
    assert "[^" not in _plan(df)  # a negated class takes every plain character for a match of its own


def test_ends_are_numbers_not_texts(spark):
    rng = random.Random(3)
    made = [[(d, i, "".join(rng.choice("ab") for _ in range(rng.choice((0, 1, 2, 5, 14, 17, 30, 33))))) for i in range(12)] for d in range(12)]
    flat = [x for d in made for x in d]
    ln = spark.createDataFrame(flat, "doc_id int, line_no int, compact string")
    pool = sorted({c for _, _, c in flat if len(c) >= 2} | {(a[2] + b[2])[k:] for d in made for a, b in zip(d, d[1:]) for k in (0, 3, 12, 13)} - {""})
    keys = spark.createDataFrame([(k, k) for k in pool], "key string, item_id string")
    out = chunks.pair_hits(ln, keys, ["doc_id"])
    want = {(d, i, k) for rows in made for (d, i, a), (_, _, b) in zip(rows, rows[1:]) for k in pool if (a + b).endswith(k) and len(a + b) <= len(k) + 12}
    assert {(r.doc_id, r.start_line, r.item_id) for r in out.collect()} == want and want
    plan = _plan(out)
    joined = plan[plan.index("Join Inner") :].split("\n")[1]
    assert "merged" not in joined and "collect_set" not in plan


def test_compact_is_computed_once_for_single_hits(spark):
    ln = _docs(spark, [(1, "a b\nc"), (2, "ab\n\n c ")])
    keys = spark.createDataFrame([("ab", 1), ("zz", 2)], "key string, item_id int")
    out = chunks.single_hits(ln, keys.filter(F.length("key") >= 2), ["doc_id"])
    assert sorted((r.doc_id, r.line_no, r.item_id) for r in out.collect()) == [(1, 0, 1), (2, 0, 1)]
    assert _plan(out).count("regexp_replace") == 1


def test_words_share_their_beginnings():
    rng = random.Random(1)
    letters = "ab-]^&[́e\n"
    for t in range(300):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))]
        words = ["a" * k for k in range(1, 300, 7)] if t % 20 == 0 else words
        old, new = "|".join(re.escape(w) for w in lookup.longest_first(words)), lookup.any_word(words)
        s = "".join(rng.choice(letters) for _ in range(60)) + "a" * 120
        assert re.findall(f"(?s)({old}|.)", s) == re.findall(f"(?s)({new}|.)", s)
    many = lookup.any_word([f"supplier#{k:09d}" for k in range(20000)])
    assert len(many) < 60_000 and re.fullmatch(many, "supplier#000012345") and not re.fullmatch(many, "supplier#000020000")
    assert lookup.any_word([]) == "(?!)"


def test_many_words_are_not_an_array_of_the_plan(spark):
    df = spark.createDataFrame([("the supplier#000000007 q",)], "text string")
    words = [f"supplier#{k:09d}" for k in range(300)]
    out = df.select(lookup.mark_words(F.col("text"), words, ["q"], "□", is_marked="^[A-Za-z]$").alias("m"))
    assert out.first().m == "the □ □"
    assert _plan(out).count("supplier") < 5


def test_columns_and_cells_are_parsed_once(spark):
    odd = ["", "   ", "a      b        c  ", "   a     b", "x ... 3     y", "x ... 3  y ... 4", "x ... 3", "     ", "p", None]
    df = spark.createDataFrame([(s,) for s in odd], "s string")
    out = df.select("s", layout.split_columns(F.col("s"), None).alias("c"))
    got = {r.s: tuple(r.c) for r in out.collect()}
    assert got == {"": ("", ""), "   ": ("", ""), "a      b        c  ": ("a      b", "c"), "   a     b": ("   a", "b"), "x ... 3     y": ("x ... 3", "y"), "x ... 3  y ... 4": ("x ... 3", "y ... 4"), "x ... 3": ("x ... 3", ""), "     ": ("", ""), "p": ("p", ""), None: (None, "")}
    assert _plan(out).count("regexp") < 15
    assert _plan(df.select(layout.parse_cell(F.col("s")).alias("e"))).count("translate(") == 1
