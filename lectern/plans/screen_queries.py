"""Registered queries of the labels and the reading screens, and their SQL.

Regions stand in for books, nations for their contents, suppliers for the rows of word tables, customers for those of
character tables and for chunks. Entries of all kinds are made from ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import labels
from lectern.operators import lookup, screens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- entries -----------------------------------------------------------------------------------------------

_COLUMNS = {
    "id": "concat(source, '-', doc_id)",
    "kind": "CASE doc_id % 9 WHEN 0 THEN 'section' WHEN 1 THEN 'lesson' WHEN 2 THEN 'sublesson' WHEN 3 THEN 'garden' WHEN 4 THEN 'reading_club' WHEN 5 THEN 'block_activity' WHEN 6 THEN 'toc_belt' WHEN 7 THEN 'lesson' ELSE 'other' END",
    "number": "CASE WHEN doc_id % 4 <> 0 THEN concat('', doc_id % 90) END",
    "title": "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat(' ', lang, ' ') ELSE concat(lang, doc_id % 7) END",
    "label": "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '口语交际' WHEN 2 THEN '习作例文' WHEN 3 THEN '习作' WHEN 4 THEN '语文园地三' WHEN 5 THEN '我上学了' ELSE '古诗词诵读' END",
    "block": "CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN '口语交际' WHEN 2 THEN '习作例文' WHEN 3 THEN '习作' WHEN 4 THEN '综合性学习' WHEN 5 THEN '专题学习活动' ELSE 'x' END",
    "subtitle": "CASE WHEN doc_id % 2 = 0 THEN lang END",
    "sublesson_title": "CASE WHEN doc_id % 11 < 4 THEN '山行' END",
    "optional_reading": "doc_id % 3 = 1",
    "group_label": "CASE doc_id % 10 WHEN 0 THEN '第一单元·识字' WHEN 1 THEN '第二单元' WHEN 2 THEN '我上学了' WHEN 3 THEN '古诗诵读' WHEN 4 THEN '第三单元·汉语拼音' WHEN 5 THEN '第四单元·阅读' WHEN 6 THEN '别的' END",
    "strand": "CASE doc_id % 12 WHEN 0 THEN '口语交际' WHEN 1 THEN '习作' WHEN 2 THEN '综合性学习' WHEN 3 THEN '习作例文' END",
}
_ENTRIES = "e AS (SELECT doc_id, " + ", ".join(f"{sql} AS {name}" for name, sql in _COLUMNS.items()) + " FROM documents)"
# The same fields, without nulls and outer blanks.
_TRIMMED = _ENTRIES + ", t AS (SELECT doc_id, id, kind, coalesce(number, '') AS n, trim(title) AS ti, label AS lb, block AS bl, coalesce(subtitle, '') AS su, coalesce(sublesson_title, '') AS sl, CASE WHEN optional_reading THEN '*' ELSE '' END AS star, coalesce(group_label, '') AS g, strand FROM e)"


def _entries(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", *[F.expr(sql).alias(name) for name, sql in _COLUMNS.items()])
    return rows.select("doc_id", F.struct(*labels.FIELDS).alias("entry"), "group_label", "strand")


@query(f"""WITH {_TRIMMED} SELECT doc_id, CASE kind WHEN 'section' THEN coalesce(nullif(lb, ''), nullif(g, ''), id) WHEN 'lesson' THEN CASE WHEN ti = '' THEN n ELSE trim(n || star || ' ' || ti) END
WHEN 'sublesson' THEN ti WHEN 'garden' THEN lb WHEN 'reading_club' THEN '快乐读书吧' || CASE WHEN su = '' THEN '' ELSE '（' || su || '）' END
WHEN 'block_activity' THEN trim(bl || ' ' || ti) WHEN 'toc_belt' THEN trim(lb || ' ' || ti) ELSE id END AS label FROM t""")
def entry_chunk_label(spark, d):
    return _entries(spark, d).select("doc_id", labels.chunk_label(F.col("entry")).alias("label"))


@query(f"""WITH {_TRIMMED}, s AS (SELECT *, CASE kind WHEN 'lesson' THEN trim(n || ' ' || ti) WHEN 'sublesson' THEN ti WHEN 'garden' THEN lb WHEN 'section' THEN lb
WHEN 'block_activity' THEN bl || CASE WHEN bl <> '' AND ti <> '' THEN ' · ' ELSE '' END || ti WHEN 'reading_club' THEN ti || CASE WHEN ti <> '' AND su <> '' THEN ' · ' ELSE '' END || su
ELSE coalesce(nullif(lb, ''), ti) END AS s FROM t) SELECT doc_id, id, CASE WHEN s = '' THEN id ELSE s END AS label, kind FROM s""")
def entry_web_rows(spark, d):
    return _entries(spark, d).select("doc_id", "entry.id", labels.web_label(F.col("entry")).alias("label"), "entry.kind")


@query(f"""WITH {_TRIMMED} SELECT doc_id, CASE kind WHEN 'lesson' THEN n || star || ' ' || ti || CASE WHEN sl = '' THEN '' ELSE '（' || sl || '）' END WHEN 'garden' THEN lb
WHEN 'reading_club' THEN '快乐读书吧' || CASE WHEN su <> '' THEN ' ' || su WHEN sl <> '' THEN ' ' || sl ELSE '' END WHEN 'toc_belt' THEN lb || ti WHEN 'block_activity' THEN bl || ' ' || ti WHEN 'sublesson' THEN ti END AS line
FROM t WHERE kind NOT IN ('section', 'other')""")
def flat_contents(spark, d):
    return _entries(spark, d).select("doc_id", labels.flat_line(F.col("entry")).alias("line")).filter("line is not null")


@query(f"""WITH {_TRIMMED} SELECT doc_id, replace(CASE kind WHEN 'lesson' THEN n || star || ti || CASE WHEN sl = '' THEN '' ELSE '（' || sl || '）' END WHEN 'garden' THEN lb WHEN 'section' THEN lb
WHEN 'reading_club' THEN '快乐读书吧' || CASE WHEN su <> '' THEN su ELSE sl END WHEN 'toc_belt' THEN lb || ti WHEN 'block_activity' THEN bl || ti WHEN 'sublesson' THEN ti ELSE '' END, ' ', '') AS line FROM t""")
def catalogue_line(spark, d):
    return _entries(spark, d).select("doc_id", labels.rule_line(F.col("entry")).alias("line"))


_MODE = "CASE WHEN g LIKE '%单元·识字%' THEN '识字' WHEN g LIKE '%单元·阅读%' THEN '阅读' WHEN g LIKE '%单元·汉语拼音%' THEN '汉语拼音' WHEN g = '第二单元' THEN '阅读' END"


@query(f"""WITH {_TRIMMED}, k AS (SELECT *, CASE kind WHEN 'toc_belt' THEN lb WHEN 'block_activity' THEN bl END AS name, CASE WHEN strand = '习作例文' THEN NULL ELSE strand END AS s FROM t)
SELECT doc_id, CASE WHEN name IS NOT NULL THEN CASE WHEN name = '习作例文' THEN '习作' WHEN name IN ('口语交际', '习作', '综合性学习') OR kind = 'block_activity' AND name = '专题学习活动' THEN name ELSE '未分类' END
WHEN kind = 'garden' THEN '语文园地' WHEN kind = 'reading_club' THEN '快乐读书吧' WHEN kind IN ('lesson', 'sublesson') THEN CASE WHEN s IS NOT NULL THEN s WHEN g = '我上学了' THEN '入学教育' WHEN g = '古诗诵读' THEN '古诗词诵读' ELSE '课文' END
WHEN kind = 'section' THEN CASE WHEN lb = '古诗词诵读' THEN lb ELSE '分组' END ELSE '未分类' END AS unit_type,
CASE WHEN name = '习作例文' THEN name WHEN kind IN ('lesson', 'sublesson') AND s IS NULL AND g NOT IN ('我上学了', '古诗诵读') THEN {_MODE} WHEN kind = 'section' AND lb = '我上学了' THEN '入学教育' END AS unit_subtype FROM k""")
def default_unit_types(spark, d):
    rows = _entries(spark, d)
    return rows.select("doc_id", labels.default_unit_type(F.col("entry"), F.col("group_label"), F.col("strand")).alias("u")).select("doc_id", "u.*")


@query(f"""WITH {_TRIMMED}, u AS (SELECT *, CASE WHEN su <> '' THEN su ELSE sl END AS tail FROM t)
SELECT doc_id, id AS toc_id, kind AS toc_kind, CAST(doc_id % 100 AS INTEGER) AS toc_index, CASE kind WHEN 'block_activity' THEN 'block' WHEN 'toc_belt' THEN 'belt' ELSE kind END AS unit_type,
CASE WHEN kind = 'lesson' THEN nullif(n, '') END AS lesson, CASE WHEN kind = 'garden' AND lb = '语文园地三' THEN '三' END AS garden_cn,
CASE WHEN kind IN ('lesson', 'block_activity', 'toc_belt', 'sublesson') THEN nullif(ti, '') WHEN kind = 'reading_club' THEN nullif(tail, '') END AS title,
CASE kind WHEN 'lesson' THEN coalesce(nullif(trim(n || ' ' || ti) || CASE WHEN sl = '' THEN '' ELSE '（' || sl || '）' END, ''), id) WHEN 'garden' THEN lb WHEN 'reading_club' THEN trim('快乐读书吧 ' || tail)
WHEN 'block_activity' THEN trim(bl || ' ' || ti) WHEN 'toc_belt' THEN lb || ti WHEN 'sublesson' THEN ti ELSE id END AS label FROM u""")
def entry_units(spark, d):
    return _entries(spark, d).select("doc_id", labels.unit_of(F.col("entry"), F.col("doc_id") % 100).alias("u")).select("doc_id", "u.*")


@query(f"""WITH {_TRIMMED} SELECT doc_id, CASE WHEN lb <> '' THEN lb WHEN ti <> '' THEN ti WHEN bl <> '' AND doc_id % 2 = 0 THEN '园地' || bl WHEN doc_id % 4 <> 0 THEN '课' || n ELSE '' END AS label FROM t""")
def table_row_label(spark, d):
    e = F.col("entry")
    garden = F.when(F.col("doc_id") % 2 == 0, e["block"])
    return _entries(spark, d).select("doc_id", labels.row_label(e["label"], F.trim(e["title"]), e["number"], garden).alias("label"))


# --- screens -----------------------------------------------------------------------------------------------

_START, _END, _NEEDLE = ("AMERICA", "NATION_6"), ("EUROPE", "NATION_18"), "u"
_BASE = """books AS (SELECT r_name AS book, r_regionkey AS book_ord, concat('title ', r_name) AS title FROM region),
toc AS (SELECT r_name AS book, n_name AS toc_id, n_nationkey AS toc_ord, concat('label ', n_name) AS label FROM nation JOIN region ON n_regionkey = r_regionkey),
chars AS (SELECT book, toc_id, CASE WHEN c_custkey % 2 = 0 THEN '识字表' ELSE '写字表' END AS "table", c_custkey AS row_no, concat('row ', c_custkey) AS label, string_split(lower(c_mktsegment), '') AS chars FROM customer JOIN toc ON toc_ord = c_nationkey),
words AS (SELECT book, toc_id, s_suppkey AS row_no, concat('row ', s_suppkey) AS label, [CASE s_nationkey % 4 WHEN 0 THEN 'the' WHEN 1 THEN 'an' WHEN 2 THEN 'tion' ELSE 'unter' END, lower(s_name), 'an'] AS words FROM supplier JOIN toc ON toc_ord = s_nationkey),
chunks AS (SELECT book, toc_id, c_custkey AS row_no, c_acctbal > 0 AS ok, [lower(c_mktsegment), lower(c_name), 'unter'] AS tokens FROM customer JOIN toc ON toc_ord = c_nationkey)"""
_RANGE = f"""places AS (SELECT toc.book, toc_id, (book_ord, toc_ord) AS place, row_number() OVER (ORDER BY book_ord, toc_ord) AS pos FROM toc JOIN books USING (book)),
span AS (SELECT (SELECT pos FROM places WHERE (book, toc_id) = {_START}) AS a, (SELECT pos FROM places WHERE (book, toc_id) = {_END}) AS b),
inside AS (SELECT book, toc_id, pos, b FROM places, span WHERE pos BETWEEN least(a, b) AND greatest(a, b))"""


def _tables(spark, d) -> dict[str, DataFrame]:
    books = _t(spark, d, "region").select(F.col("r_name").alias("book"), F.col("r_regionkey").alias("book_ord"), F.concat(F.lit("title "), F.col("r_name")).alias("title"))
    nation = _t(spark, d, "nation").join(books, F.col("n_regionkey") == F.col("book_ord"))
    toc = nation.select("book", F.col("n_name").alias("toc_id"), F.col("n_nationkey").alias("toc_ord"), F.concat(F.lit("label "), F.col("n_name")).alias("label"))
    at = toc.select("book", "toc_id", "toc_ord")
    customer = _t(spark, d, "customer").join(at, F.col("c_nationkey") == F.col("toc_ord")).withColumn("row_no", F.col("c_custkey"))
    supplier = _t(spark, d, "supplier").join(at, F.col("s_nationkey") == F.col("toc_ord")).withColumn("row_no", F.col("s_suppkey"))
    first = F.expr("CASE s_nationkey % 4 WHEN 0 THEN 'the' WHEN 1 THEN 'an' WHEN 2 THEN 'tion' ELSE 'unter' END")
    label = F.concat(F.lit("row "), F.col("row_no")).alias("label")
    chars = F.filter(F.split(F.lower("c_mktsegment"), ""), lambda c: c != "").alias("chars")
    return {
        "books": books,
        "toc": toc,
        "chars": customer.select("book", "toc_id", F.when(F.col("c_custkey") % 2 == 0, "识字表").otherwise("写字表").alias("table"), "row_no", label, chars),
        "words": supplier.select("book", "toc_id", "row_no", label, F.array(first, F.lower("s_name"), F.lit("an")).alias("words")),
        "chunks": customer.select("book", "toc_id", "row_no", (F.col("c_acctbal") > 0).alias("ok"), F.array(F.lower("c_mktsegment"), F.lower("c_name"), F.lit("unter")).alias("tokens")),
    }


def _freq(t):
    return lookup.word_frequency(t["chunks"], t["words"])


_FREQ = "freq AS (SELECT w AS word, count(*) AS freq FROM (SELECT unnest(tokens) AS w FROM chunks UNION ALL SELECT unnest(words) FROM words) GROUP BY w)"
_HITS = f"""hits AS (SELECT source, CASE WHEN pos = b THEN 'last' WHEN b - pos IN (1, 2) THEN 'near' ELSE 'other' END AS bucket, word, book, row_no
FROM (SELECT 'body' AS source, book, toc_id, row_no, unnest(list_distinct(tokens)) AS word FROM chunks WHERE ok UNION ALL SELECT 'table', book, toc_id, row_no, unnest(list_distinct(words)) FROM words) JOIN inside USING (book, toc_id) WHERE contains(word, '{_NEEDLE}'))"""


def _hits(t):
    return screens.formation_hits(_NEEDLE, t["books"], t["toc"], t["chunks"], t["words"], _START, _END, only_ok=True)


@query(f"""WITH {_BASE}, {_RANGE}, {_FREQ}, {_HITS} SELECT source, bucket, word, coalesce(freq, 0) AS freq, CAST(row_number() OVER (PARTITION BY source, bucket ORDER BY coalesce(freq, 0) DESC, word) AS INTEGER) AS place
FROM (SELECT DISTINCT source, bucket, word FROM hits) LEFT JOIN freq USING (word)""")
def word_formation(spark, d):
    t = _tables(spark, d)
    return screens.formation(_hits(t), _freq(t), collation=None)


@query(f"""WITH {_BASE}, {_RANGE}, {_HITS}, s AS (SELECT CAST(coalesce(sum(len(tokens)), 0) AS BIGINT) AS scanned FROM chunks JOIN inside USING (book, toc_id) WHERE ok)
SELECT source, count(*) AS hits, count(DISTINCT word) AS words, any_value(scanned) AS scanned FROM hits, s GROUP BY source""")
def word_formation_status(spark, d):
    t = _tables(spark, d)
    scanned = screens.scanned_tokens(t["books"], t["toc"], t["chunks"], _START, _END, only_ok=True)
    return screens.formation_status(_hits(t)).join(F.broadcast(scanned))


@query(f"""WITH {_BASE}, {_RANGE}, k AS (SELECT DISTINCT unnest(chars) AS c FROM chars JOIN inside USING (book, toc_id) WHERE "table" = '识字表'), known AS (SELECT list(c) AS l, count(*) AS n FROM k),
p AS (SELECT conv_id, turn, string_split(text, '') AS cs FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(cs, lambda c: CASE WHEN list_contains(l, c) THEN '<' || c || '>' ELSE c END), '') AS marked, CAST(len(list_filter(cs, lambda c: regexp_full_match(c, '[A-Za-z]'))) AS INTEGER) AS han,
CAST(len(list_filter(cs, lambda c: list_contains(l, c))) AS INTEGER) AS replaced, CAST(n AS INTEGER) AS known FROM p, known""")
def text_check_characters(spark, d):
    t = _tables(spark, d)
    texts = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    return screens.text_check(texts, t["books"], t["toc"], t["chars"], t["words"], _END, _START, ("识字表",), False, "<$1>", "replace-known", "^[A-Za-z]$").drop("text")


@query(f"""WITH {_BASE}, {_RANGE}, k AS (SELECT DISTINCT unnest(chars) AS c FROM chars JOIN inside USING (book, toc_id) WHERE "table" = '写字表'), known AS (SELECT list(c) AS l, count(*) AS n FROM k),
w AS (SELECT string_agg(w, '|' ORDER BY length(w) DESC, w) AS w FROM (SELECT DISTINCT unnest(words) AS w FROM words JOIN inside USING (book, toc_id))),
p AS (SELECT conv_id, turn, regexp_extract_all(text, '(?s)' || w || '|.') AS ps, string_split(w, '|') AS ws FROM conversations, w)
SELECT conv_id, turn, array_to_string(list_transform(ps, lambda c: CASE WHEN list_contains(ws, c) OR list_contains(l, c) THEN '□' ELSE c END), '') AS marked,
CAST(list_sum(list_transform(ps, lambda c: length(regexp_replace(c, '[^A-Za-z]', '', 'g')))) AS INTEGER) AS han,
CAST(list_sum(list_transform(ps, lambda c: CASE WHEN list_contains(ws, c) OR list_contains(l, c) THEN length(regexp_replace(c, '[^A-Za-z]', '', 'g')) ELSE 0 END)) AS INTEGER) AS replaced, CAST(n AS INTEGER) AS known FROM p, known""")
def text_check_words(spark, d):
    t = _tables(spark, d)
    texts = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    return screens.text_check(texts, t["books"], t["toc"], t["chars"], t["words"], _START, _END, ("写字表",), True, "", "replace-known", "^[A-Za-z]$").drop("text")


@query(f"""WITH {_BASE}, w AS (SELECT unnest(range(4)) AS item_no, unnest(['f', 'q', 'z', 'e']) AS item), h AS (SELECT DISTINCT item, book, "table", row_no, label FROM (SELECT unnest(chars) AS item, * FROM chars) WHERE item IN ('f', 'q', 'z', 'e')),
n AS (SELECT h.*, CAST(row_number() OVER (PARTITION BY item ORDER BY book_ord, CASE "table" WHEN '识字表' THEN 0 ELSE 1 END, row_no) AS INTEGER) AS hit_no FROM h JOIN books USING (book))
SELECT w.item, item_no, hit_no, book, "table", row_no, label FROM w LEFT JOIN n USING (item)""")
def character_hits(spark, d):
    t = _tables(spark, d)
    wanted = spark.createDataFrame([(k, c) for k, c in enumerate("fqze")], "item_no long, item string")
    return screens.look_up(wanted, t["chars"], "chars", t["books"])


@query(f"""WITH {_BASE}, w AS (SELECT unnest(range(3)) AS item_no, unnest(['an', 'unter', 'nowhere']) AS item), h AS (SELECT DISTINCT item, book, row_no, label FROM (SELECT unnest(words) AS item, * FROM words)),
n AS (SELECT h.*, CAST(row_number() OVER (PARTITION BY item ORDER BY book_ord, row_no) AS INTEGER) AS hit_no FROM h JOIN books USING (book))
SELECT w.item, item_no, hit_no, book, row_no, label FROM w LEFT JOIN n USING (item)""")
def word_hits(spark, d):
    t = _tables(spark, d)
    wanted = spark.createDataFrame([(k, w) for k, w in enumerate(("an", "unter", "nowhere"))], "item_no long, item string")
    return screens.look_up(wanted, t["words"], "words", t["books"])


@query(f"""WITH {_BASE}, c AS (SELECT row_no, CASE WHEN row_no % 3 = 0 THEN '行 ' || (row_no + 1) ELSE label END AS title, chars FROM chars WHERE book = 'ASIA' AND "table" = '写字表')
SELECT row_no, title, CAST(unnest(range(len(chars))) AS INTEGER) AS item_no, unnest(chars) AS item, '' AS pinyin FROM c""")
def lexicon_browse(spark, d):
    rows = _tables(spark, d)["chars"].withColumn("label", F.when(F.col("row_no") % 3 != 0, F.col("label")))
    rows = rows.withColumn("char_items", F.transform("chars", lambda c: F.struct(c.alias("char"), F.lit(None).cast("string").alias("pinyin"))))
    return screens.browse(rows, "ASIA", "写字表", "char_items")


@query(f"""WITH {_BASE} SELECT book, book_ord, title, arg_min(toc_id, toc_ord) AS first_id, arg_max(toc_id, toc_ord) AS last_id, count(toc_id) AS entries FROM books LEFT JOIN toc USING (book) GROUP BY ALL""")
def book_choices(spark, d):
    t = _tables(spark, d)
    return screens.choices(t["books"], t["toc"])


@query(f"""WITH {_BASE}, f AS (SELECT arg_min(book, book_ord) AS book FROM books) SELECT book, arg_min(toc_id, toc_ord) AS start_id, arg_max(toc_id, toc_ord) AS end_id FROM f JOIN toc USING (book) GROUP BY book""")
def default_range(spark, d):
    t = _tables(spark, d)
    return screens.default_range(t["books"], t["toc"])


@query(f"""WITH {_BASE}, n AS (SELECT book, count(*) AS n, count(*) FILTER (WHERE row_no % 100 <> 7) AS m FROM chunks GROUP BY book) SELECT unnest(['books', 'contents', 'tokens', 'frequencies']) AS "check",
unnest([(SELECT count(*) > 0 FROM books), (SELECT count(*) > 0 FROM toc), (SELECT count(*) = 0 FROM n WHERE n <> m), (SELECT count(*) > 0 FROM chunks)]) AS ok""")
def payload_guards(spark, d):
    t = _tables(spark, d)
    return screens.guards(t["books"], t["toc"], t["chunks"], t["chunks"].filter("row_no % 100 <> 7"), _freq(t))


@query(f"""WITH {_BASE}, o AS (SELECT book, toc_id, count(*) AS n, count(*) FILTER (WHERE ok) AS k, arg_max(tokens[2], row_no) AS last_one FROM chunks GROUP BY book, toc_id)
SELECT book, toc_id, coalesce(last_one, '') AS last_token FROM toc LEFT JOIN o USING (book, toc_id)""")
def entry_by_id(spark, d):
    t = _tables(spark, d)
    found = screens.by_id(t["toc"].select("book", "toc_id"), t["chunks"], "row_no")
    return found.select("book", "toc_id", F.coalesce(F.col("entry.tokens")[1], F.lit("")).alias("last_token"))


@query(f"""WITH {_BASE} SELECT book, count(*) FILTER (WHERE ok) AS matched, count(*) FILTER (WHERE NOT ok) AS unmatched, count(*) AS total FROM chunks GROUP BY book""")
def matched_counts(spark, d):
    return screens.matched_counts(_tables(spark, d)["chunks"])


@query(f"""WITH {_BASE} SELECT book, string_agg(array_to_string(words, ' '), ' ' ORDER BY row_no) AS all_words FROM words GROUP BY book""")
def all_words(spark, d):
    return screens.all_words(_tables(spark, d)["words"]).select("book", F.array_join("all_words", " ").alias("all_words"))


@query(f"""WITH {_BASE}, s AS (SELECT book, bool_or(ok) AS ran, max(CASE WHEN row_no = 2 THEN 'no end' END) AS error FROM chunks GROUP BY book)
SELECT count(error) AS failed, bool_or(ran) AS any_ran, CAST(CASE WHEN count(error) > 0 OR NOT bool_or(ran) THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM s""")
def batch_outcome(spark, d):
    rows = _tables(spark, d)["chunks"].groupBy("book").agg(F.bool_or("ok").alias("ran"), F.max(F.when(F.col("row_no") == 2, "no end")).alias("error"))
    return screens.batch_outcome(rows)


# --- contents ----------------------------------------------------------------------------------------------

_PAGE = ["目录", "第一单元....1", "1 {lang} ........ 2", "    山行 .... 3", "2 {source} ........ 4", "    甲 .... 5", "    乙 .... 6", "习作：", "◎ 习作：春天 .... 9", "语文园地....15", "第二单元....16", "口语交际：", "3* {lang}x ........ 17", *[""] * 10, "识字表....99"]
_ROWS = """(0, 1, '第一单元', '分组', NULL, 'section', NULL, NULL, '第一单元', NULL, NULL, NULL), (1, 1, '第一单元', '课文', '阅读', 'lesson', '1', lang, NULL, NULL, '山行', 2),
(2, 1, '第一单元', '课文', '阅读', 'lesson', '2', source, NULL, NULL, NULL, 4), (3, 1, '第一单元', '课文', '阅读', 'sublesson', NULL, '甲', NULL, NULL, NULL, 5), (4, 1, '第一单元', '课文', '阅读', 'sublesson', NULL, '乙', NULL, NULL, NULL, 6),
(5, 1, '第一单元', '习作', NULL, 'toc_belt', NULL, '春天', '习作', '习作', NULL, 9), (6, 1, '第一单元', '语文园地', NULL, 'garden', NULL, NULL, '语文园地', NULL, NULL, 15), (7, 2, '第二单元', '分组', NULL, 'section', NULL, NULL, '第二单元', NULL, NULL, NULL),
(8, 2, '第二单元', '口语交际', NULL, 'toc_belt', NULL, NULL, '口语交际', NULL, NULL, NULL), (9, 2, '第二单元', '口语交际', NULL, 'lesson', '3', lang || 'x', NULL, NULL, NULL, 17)"""


@query(f"""SELECT doc_id, CAST(r.i AS INTEGER) AS toc_index, doc_id || '-toc-000' || (r.i + 1) AS id, CAST(r.g AS BIGINT) AS group_id, r.gl AS group_label, r.t AS unit_type, r.st AS unit_subtype, r.kind, r.number, r.title, r.label, r.block, r.sub AS sublesson_title, CAST(r.page AS INTEGER) AS page
FROM documents, LATERAL (SELECT * FROM (VALUES {_ROWS}) AS v(i, g, gl, t, st, kind, number, title, label, block, sub, page)) AS r WHERE r.i < 9
UNION ALL SELECT doc_id, 9, doc_id || '-toc-0010', 2, '第二单元', '口语交际', NULL, 'lesson', '3', lang || 'x', NULL, NULL, NULL, 17 FROM documents""")
def contents_of_layout_text(spark, d):
    from lectern.operators import contents, lines

    pieces = []
    for line in _PAGE:
        a, brace, rest = line.partition("{")
        name, _, b = rest.partition("}")
        pieces.append(F.concat(F.lit(a), F.col(name), F.lit(b)) if brace else F.lit(line))
    docs = _t(spark, d, "documents").select("doc_id", F.concat_ws("\n", *pieces).alias("text"))
    rows = contents.extract_contents(lines.explode_lines(docs), ["doc_id"])
    return rows.select("doc_id", "toc_index", "id", "group_id", "group_label", "unit_type", "unit_subtype", *[F.col(f"entry.{f}") for f in ("kind", "number", "title", "label", "block", "sublesson_title", "page")])
