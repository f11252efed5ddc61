"""Small invented texts with results traced by hand from the rules (FIXTURES.md, section 3)."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import rules, text
from lectern.operators import chunks, contents, layout, lines, lookup, sequences, tables

X1 = "识字表\n识字\n     tiQn  dK  rRn\n1   天 地 人\n     kGu Dr\n语文园地一   口 耳\n（共5个生字）\n"


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def _region(spark, body, end="（共\\d+个生字）"):
    docs = spark.createDataFrame([("b", body)], "book string, text string")
    return lines.full_match_region(lines.explode_lines(docs), ["book"], ["识字表"], [end])


def test_char_table(spark):
    rows = tables.char_rows(_region(spark, X1), ["book"]).orderBy("i").collect()
    assert [(r["section"], r["lesson"], r["garden"]) for r in rows] == [("识字", "1", None), ("识字", None, "一")]
    assert [[(c["char"], c["pinyin"]) for c in r["chars"]] for r in rows] == [[("天", "tiān"), ("地", "dì"), ("人", "rén")], [("口", "kǒu"), ("耳", "ěr")]]
    assert [r["raw"] for r in tables.char_row_rejects(_region(spark, X1), ["book"]).collect()] == ["识字"]


def test_char_table_pinyin_before_a_blank_line(spark):
    rows = tables.char_rows(_region(spark, X1.replace("     kGu Dr\n", "     kGu Dr\n\n")), ["book"]).orderBy("i").collect()
    assert rows[0]["pinyin_line"] == "tiQn dK rRn kGu Dr"
    assert [c["pinyin"] for c in rows[1]["chars"]] == [None, None]


def test_word_table(spark):
    docs = spark.createDataFrame([("b", "词语表\n1   小船 月儿\n弯弯\n语文园地  白云\n（共4个词）")], "book string, text string")
    region = lines.full_match_region(lines.explode_lines(docs), ["book"], ["词语表"], ["（共\\d+个词）"])
    rows = tables.word_rows(region, ["book"]).orderBy("i")
    assert [(r["lesson"], r["words"]) for r in rows.collect()] == [("1", ["小船", "月儿", "弯弯"]), ("语文园地", ["白云"])]
    assert tables.table_totals(rows, ["book"], "words").first()["computed"] == 4


@pytest.mark.parametrize(
    ("cell", "wanted"),
    [
        ("1 白鹭 ........ 2", {"kind": "lesson", "number": "1", "title": "白鹭", "page": 2, "optional_reading": False}),
        ("4* 桂花雨........12", {"kind": "lesson", "number": "4", "title": "桂花雨", "page": 12, "optional_reading": True}),
        ("语文园地....15", {"kind": "garden", "label": "语文园地", "page": 15}),
        ("◎ 口语交际：安慰 .... 30", {"kind": "block_activity", "block": "口语交际", "title": "安慰", "page": 30}),
        ("口语交际：", {"kind": "toc_belt", "label": "口语交际"}),
        ("第一单元....1", {"kind": "section", "label": "第一单元"}),
        ("识字表....99", None),
    ],
)
def test_cells(spark, cell, wanted):
    got = _one(spark, layout.parse_cell(F.col("c")), c=cell)
    assert (got is None) if wanted is None else {k: v for k, v in got.asDict().items() if v is not None} == wanted


@pytest.mark.parametrize(
    ("line", "wanted"),
    [(" " * 16 + "口语交际", ("", "口语交际")), (" " * 12 + "白鹭", (" " * 12 + "白鹭", "")), ("1 白鹭........2      5 搭石.......20", ("1 白鹭........2", "5 搭石.......20")), ("   ", ("", ""))],
)
def test_two_columns(spark, line, wanted):
    assert tuple(_one(spark, layout.split_columns(F.col("l"), 36), l=line)) == wanted


def test_spans(spark):
    docs = spark.createDataFrame([("b", "第一单元\n阅 读\n1\n小船\n正文甲\n语文园地\n词语表")], "book string, text string")
    ln = lines.explode_lines(docs)
    names = "kind string, number string, title string, label string, block string, subtitle string, optional_reading boolean"
    entry = lambda kind, number=None, title=None, label=None: (kind, number, title, label, None, None, False)
    entries = spark.createDataFrame([("b", 0, entry("section", label="第一单元")), ("b", 1, entry("lesson", "1", "小船")), ("b", 2, entry("garden", label="语文园地"))], f"book string, ord int, entry struct<{names.replace(' string', ':string').replace(' boolean', ':boolean')}>")
    bounds = lines.body_bounds(ln, ["book"])
    assert tuple(bounds.first()) == ("b", 0, 6, 7)
    spans = chunks.propose_spans(ln, entries, bounds, ["book"]).orderBy("ord").collect()
    assert [(r["ord"], r["start_line"], r["end_line"], r["match_mode"]) for r in spans] == [(1, 3, 5, "single"), (2, 5, 6, "window")]


def test_greedy_alignment(spark):
    rows = spark.createDataFrame([("b", i, n) for i, n in enumerate(["1", "3", "9", "2", "5"])], "book string, i int, lesson string")
    entries = spark.createDataFrame([("b", i, str(i + 1)) for i in range(5)], "book string, toc_index int, number string")
    got = sequences.greedy_align(rows, entries, F.col("lesson") == F.col("number"), ["book"], "i", "toc_index").orderBy("i").collect()
    assert [r["toc_index"] for r in got] == [0, 2, None, None, 4]


def test_units(spark):
    names = "kind:string,number:string,title:string,label:string,group_label:string,unit_subtype:string"
    entries = spark.createDataFrame([("b", 0, ("section", None, None, "第一单元", None, None)), ("b", 1, ("lesson", "1", "天地人", None, "第一单元·识字", None)), ("b", 2, ("garden", None, None, "语文园地一", None, None))], f"book string, toc_index int, entry struct<{names}>")
    rows = tables.assign_units(tables.char_rows(_region(spark, X1), ["book"]), entries, ["book"]).orderBy("i").collect()
    assert [r["unit"]["toc_index"] for r in rows] == [1, 2]


def test_marking(spark):
    t = "小船和月儿"
    mark = lambda *a, **k: _one(spark, lookup.mark_words(F.col("t"), *a, **k), t=t)
    assert mark(["小船"], ["月"], "□") == "□和□儿"
    assert mark(["小船"], ["月"], "□", "replace-unknown") == "小船□月□"
    assert mark(["小船"], ["月"], "[$1]") == "[小][船]和[月]儿"
    assert _one(spark, lookup.mark_known(F.col("t"), ["月"], "□"), t=t) == "小船和□儿"
    assert tuple(_one(spark, lookup.mark_statistics(F.col("t"), ["月"]), t=t)) == (5, 1)


def test_frequency(spark):
    sets = spark.createDataFrame([(["小船", "月儿"],), (["小船"],)], "tokens array<string>")
    words = spark.createDataFrame([(["小船", "小船"],)], "words array<string>")
    assert {r["word"]: r["freq"] for r in lookup.word_frequency(sets, words).collect()} == {"小船": 4, "月儿": 1}


def test_buckets(spark):
    rows = spark.range(6).select(lookup.bucket(F.col("id"), F.lit(4)).alias("b")).collect()
    assert [r["b"] for r in rows] == ["other", "other", "near", "near", "last", "other"]


def test_transcription(spark):
    assert _one(spark, text.transcribe(F.col("t")), t='xiAo "ABC" mQ') == 'xiǎo "ABC" mā'


def test_token_filter(spark):
    tokens = ["小船", "abc", "12", "３４", "①", "，。", "a1", ""]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").filter(text.keep_token(F.col("t"))).collect()
    assert [r["t"] for r in rows] == ["小船", "a1"]


def test_splitlines(spark):
    samples = ["", "\n", "a\r\nb\rc\fd\x0be\x1cf\x85g h\n", "a\n\nb", "\f\f"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").select("i", lines.line_array(F.col("s")).alias("l")).orderBy("i").collect()
    assert [r["l"] for r in rows] == [s.splitlines() for s in samples]


def test_rules(spark):
    kind = lambda s: _one(spark, rules.noise(F.col("s")), s=s)
    assert [kind(s) for s in ("  ", "12", "①", "仅供个人学习", "① 识字表中", "天")] == ["空行", "页码", "单独圆圈①", "版权声明", "脚注①", None]
    assert _one(spark, rules.unit_type(F.col("s")), s="◎习作例文：春") == ("习作", "习作例文")
    assert _one(spark, text.display_width(F.col("s")), s="a白\t") == 7


def _contents(spark, body, stop="识字表....99", **options):
    fill = "\n" * 22
    docs = spark.createDataFrame([("b", f"目录\n{body}{fill}{stop}\n")], "book string, text string")
    rows = contents.extract_contents(lines.explode_lines(docs), ["book"], **options).orderBy("toc_index").collect()
    return [(r["entry"]["number"], r["entry"]["title"] or r["entry"]["label"], r["entry"]["page"]) for r in rows]


def test_several_lessons_in_one_cell(spark):
    assert _contents(spark, "1 A...2 2 B...4") == [("1", "A", 2), ("2", "B", 4)]
    assert _contents(spark, "1 A...2   语文园地   2 B...4") == [("1", "A", 2), (None, "语文园地", None), ("2", "B", 4)]
    assert _contents(spark, "1 A...2") == [("1", "A", 2)]


def test_activity_alone_on_the_right_goes_before_its_section(spark):
    body = "第五单元\n1 白鹭........2\n第六单元\n2 搭石........9\n" + " " * 40 + "口语交际：安慰........7"
    moved = [(None, "第五单元", None), ("1", "白鹭", 2), (None, "安慰", 7), (None, "第六单元", None), ("2", "搭石", 9)]
    assert _contents(spark, body) == moved
    assert _contents(spark, body, move_before=None) == moved[:2] + moved[3:] + [moved[2]]
    assert _contents(spark, body.replace("口语交际", "习作")) == moved[:2] + moved[3:] + [moved[2]]


def test_contents_stop_at_pinyin_and_need_a_stop(spark):
    assert _contents(spark, "1 A...2", stop="qiU tiQn de xiAo chuAn\n2 B...4\n识字表....99") == [("1", "A", 2)]
    assert [_one(spark, rules.is_pinyin_body(F.col("s")), s=s) for s in ("qiU tiQn de xiAo", "xiAo", "kE kE kE kE kE kE", "1 abc ABC ...... 12")] == [True, False, False, False]
    with pytest.raises(Exception, match="no end of the contents: b"):
        _contents(spark, "1 A...2", stop="2 B...4")


def _rows(spark, body, **options):
    docs = spark.createDataFrame([("b", "目录\n" + body + "\n" * 25 + "识字表....99")], "book string, text string")
    return contents.extract_contents(lines.explode_lines(docs), ["book"], **options).orderBy("toc_index").collect()


def test_children_merge_into_their_parents(spark):
    """X12: a single sublesson and an activity after a belt are taken; two sublessons and those of a taken activity are not."""
    body = "1 古诗....2\n    山行 .... 3\n2 古诗....4\n    甲 .... 5\n    乙 .... 6\n习作：\n◎ 习作：春天 .... 7\n    丙 .... 8"
    got = [(r["entry"]["kind"], r["entry"]["title"], r["entry"]["sublesson_title"], r["entry"]["page"]) for r in _rows(spark, body)]
    assert got == [
        ("lesson", "古诗", "山行", 2),
        ("lesson", "古诗", None, 4),
        ("sublesson", "甲", None, 5),
        ("sublesson", "乙", None, 6),
        ("toc_belt", "春天", None, 7),
        ("sublesson", "丙", None, 8),
    ]


def test_unit_types_by_kind_group_and_belt(spark):
    body = "我上学了\n1 甲....1\n第一单元·识字\n2 乙....2\n口语交际：\n3 丙....3\n习作例文：\n4 丁....4\n古诗词诵读\n5 戊....5"
    got = {r["entry"]["title"]: (r["unit_type"], r["unit_subtype"]) for r in _rows(spark, body) if r["entry"]["kind"] == "lesson"}
    assert got == {"甲": ("入学教育", None), "乙": ("课文", "识字"), "丙": ("口语交际", None), "丁": ("课文", "识字"), "戊": ("古诗词诵读", None)}


def test_contents_of_one_column(spark):
    """Whole lines stand by themselves; lines of two lessons are read column by column until one that does."""
    body = "第一单元\n1 甲甲      2\n2 乙乙\n3 a          4 b\n5 c          6 d\n              7 e\n8 f....8\n9 g....9    10 h....10\n语文园地....9"
    got = [(r["entry"]["number"], r["entry"]["title"] or r["entry"]["label"]) for r in _rows(spark, body, columns=1)]
    assert got == [(None, "第一单元"), ("1", "甲甲"), ("2", "乙乙"), ("3", "a"), ("5", "c"), ("4", "b"), ("6", "d"), ("7", "e"), ("8", "f"), ("9", "g....9    10 h"), (None, "语文园地")]


def test_lines_that_are_no_entries_are_rejected(spark):
    docs = spark.createDataFrame([("b", "目录\n1 甲....1\n随便说说\n识字表说明\n" + "\n" * 25 + "识字表....99")], "book string, text string")
    assert [r["raw"] for r in contents.rejected_cells(lines.explode_lines(docs), ["book"]).collect()] == ["随便说说"]
