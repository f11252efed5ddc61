from pyspark.sql import functions as F

from lectern.operators import contents, lines
from lectern.sources import config, files

BOOK = "封面\n目录\n" + "第一单元·阅读........1\n".replace("·阅读", "") + "1 白鹭........2      2 搭石.......20\n  语文园地....15\n" + "\n".join(f"{n} 课{n}{'.' * 6}{n}" for n in range(3, 24)) + "\n识字表....99\n第一单元\n1\n白鹭\n正文\n搭石\n正文二\n词语表\n1 小船 月儿\n（共2个词）\n"


def test_merge_and_registry():
    assert config.deep_merge({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"c": [2]}, "d": {"e": 2}}) == {"a": {"b": 1, "c": [2]}, "d": {"e": 2}}
    books = config.registry({"book_code": {"b1": "x.pdf", "b2": {"pdf": "y.pdf", "toc_columns": 1, "extractors_drop": ["词语表"]}}})
    assert [b.code for b in books] == ["b1", "b2"]
    got = config.effective({"extractors": {"目录": {"column_number": 2}, "词语表": {}}}, config.book(books, "b2"))
    assert got["extractors"] == {"目录": {}}


def test_files(spark, tmp_path):
    (tmp_path / "b1_layout.txt").write_text(BOOK, encoding="utf-8")
    (tmp_path / "toc.csv").write_text("﻿unit, flag\n第一课,√\n,1\n第二课,no\n", encoding="utf-8")
    rows = files.layout_texts(spark, f"file://{tmp_path}/b1_layout.txt")
    assert [tuple(r) for r in rows.select("book_code", "text").collect()] == [("b1", BOOK)]
    assert [r[0] for r in config.units_of(config.contents_csv(spark, f"file://{tmp_path}/toc.csv"), "flag").collect()] == ["第一课"]
    assert [r[0] for r in files.book_codes(spark, f"file://{tmp_path}/*.txt").collect()] == ["b1"]


def test_extraction(spark):
    ln = lines.explode_lines(spark.createDataFrame([("b1", BOOK)], "book_code string, text string"))
    got = contents.extract_contents(ln, ["book_code"]).orderBy("toc_index").collect()
    assert [(r["entry"]["kind"], r["entry"]["title"] or r["entry"]["label"]) for r in got[:4]] == [("section", "第一单元"), ("lesson", "白鹭"), ("garden", "语文园地"), ("lesson", "课3")]
    assert got[-1]["entry"]["title"] == "搭石" and got[0]["id"] == "b1-toc-0001" and got[1]["unit_type"] == "课文"
    words = contents.extract_word_table(ln, ["book_code"]).collect()
    assert [r["words"] for r in words] == [["小船", "月儿"]]


def test_markdown(spark):
    df = spark.createDataFrame([("a```b",)], "t string").select(files.fenced(F.col("t")).alias("m"))
    assert df.first()["m"] == "````\na```b\n````"
    assert files.to_json(spark.createDataFrame([(None, 1)], "a string, b int")).first()["value"] == '{"a":null,"b":1}'


def test_options_reach_the_extractions():
    from lectern.operators.contents import options_of
    from lectern.sources import config

    defaults = {"extractors": {"目录": {"column_number": 2, "toc_content_width_han": 30, "start_line_pattern": "目录"}, "识字表": {"total_pattern": "共.*", "discard_line_patterns": ["x"]}}}
    one, two = (config.Book("b", 0, "b.pdf", toc_columns=n) for n in (1, 3))
    assert options_of("目录", config.effective(defaults, one)["extractors"]["目录"]) == {"start": ["目录"], "ends": None, "columns": None, "han": 30, "gap": 10}
    assert options_of("目录", config.effective(defaults, two)["extractors"]["目录"])["columns"] == 2
    assert options_of("目录", {"column_number": 2, "options": {"column_number": 1, "min_column_gap": 2, "toc_dual_right_only_move_before_section": ""}}) == {"start": None, "ends": None, "columns": 1, "han": 36, "gap": 4, "move_before": None}
    assert options_of("识字表", defaults["extractors"]["识字表"]) == {"start": None, "end": "共.*", "discard": ["x"], "unit_heads": None}


def test_an_error_of_one_book_stops_no_other(spark):
    from lectern import cli
    from lectern.operators import lines, screens
    from lectern.sources import config

    good = "目录\n1 甲....1\n" + "\n" * 25 + "识字表....99"
    ln = lines.explode_lines(spark.createDataFrame([("a", good), ("b", "目录\n1 甲....1")], "book_code string, text string"))
    books = [config.Book(c, k, f"{c}.pdf", extractors_drop=("词语表",)) for k, c in enumerate("ab")]
    written = {}
    status = cli.run_books(spark, ln, books, {}, ["目录", "词语表"], lambda rows, book, name: written.update({(book, name): rows.count()}))
    assert written == {("a", "目录"): 1}
    assert {(r["book"], r["extractor"], r["ran"], r["error"] is None) for r in status.collect()} == {("a", "目录", True, True), ("a", "词语表", False, True), ("b", "目录", False, False), ("b", "词语表", False, True)}
    assert tuple(screens.batch_outcome(status).first()) == (1, True, 1)
