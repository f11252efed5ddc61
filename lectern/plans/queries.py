"""The registered queries of the library's own operators and their SQL.

The driver's tables stand in for books: a document is a chunk, its source the book, its lines the layout lines;
``benchmark`` is the word table; a user's events in the order of (ts, event_id) are an ordered sequence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import rules, text
from lectern.operators import chunks, layout, lines, lookup, sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.explode_lines(_t(spark, d, "documents").select("doc_id", "text"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("rn", F.row_number().over(w))


def _words(df: DataFrame, column: str = "text") -> Column:
    return F.filter(F.split(F.col(column), r"[\x20\x09-\x0d]+"), lambda t: t != "")


_S = text.SPACE_RE2
_LINES = f"""lines AS (SELECT doc_id, unnest(l) AS raw, CAST(unnest(range(len(l))) AS INTEGER) AS line_no FROM (
  SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{text.LINE_END_RE2}') AS l FROM documents))),
c AS (SELECT *, regexp_replace(raw, '[{_S}]+', '', 'g') AS compact FROM lines)"""
_EVENTS = "e AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS rn FROM events)"
_WORDS = r"list_filter(string_split_regex(text, '[\x20\x09-\x0d]+'), lambda t: t <> '')"


# --- lines, regions, pages -------------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, line_no, CAST(length(raw) AS INTEGER) AS n_raw, compact FROM c")
def lines_explode(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", F.length("raw").alias("n_raw"), "compact")


@query(f"WITH {_LINES} SELECT doc_id, line_no, trim(regexp_replace(raw, '[{_S}\\x{{200b}}\\x{{feff}}]+', ' ', 'g'), ' ') AS norm FROM lines")
def space_normalise(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", "norm")


@query(f"""WITH {_LINES}, n AS (SELECT CASE WHEN s = '' THEN '空行' WHEN contains(s, '仅供个人') THEN '版权声明' WHEN starts_with(s, '①') AND contains(s, '识字表') THEN '脚注①'
  WHEN regexp_full_match(s, '\\p{{Nd}}{{1,3}}') THEN '页码' WHEN s = '①' THEN '单独圆圈①' ELSE 'text' END AS kind
  FROM (SELECT regexp_replace(raw, '^[{_S}]+|[{_S}]+$', '', 'g') AS s FROM lines)) SELECT kind, count(*) AS n FROM n GROUP BY kind""")
def noise_classify(spark, d):
    return _lines(spark, d).groupBy(F.coalesce(rules.noise(F.col("raw")), F.lit("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS a FROM conversations),
r AS (SELECT *, min(CASE WHEN role = 'assistant' AND turn > a + 1 THEN turn END) OVER (PARTITION BY conv_id) AS b FROM s)
SELECT conv_id, turn FROM r WHERE turn > a AND turn < b""")
def region_slice(spark, d):
    end = (F.col("role") == "assistant") & (F.col("turn") > F.col("region_start") + 1)
    return lines.region(_t(spark, d, "conversations"), ["conv_id"], F.col("role") == "user", end, "turn").select("conv_id", "turn")


@query(f"""WITH {_LINES}, s AS (SELECT *, min(CASE WHEN contains(raw, 'and') THEN line_no END) OVER (PARTITION BY doc_id) AS a FROM lines),
r AS (SELECT *, min(CASE WHEN (contains(raw, 'ing') OR contains(raw, 'eau')) AND line_no > a THEN line_no END) OVER (PARTITION BY doc_id) AS b FROM s)
SELECT doc_id, line_no FROM r WHERE line_no > a AND line_no < b""")
def region_slice_legacy(spark, d):
    return lines.marker_region(_lines(spark, d), ["doc_id"], ["and"], ["ing", "eau"]).select("doc_id", "line_no")


@query(f"""WITH {_LINES}, f AS (SELECT doc_id, min(CASE WHEN regexp_matches(compact, '^[A-Z].{{0,30}}$') THEN line_no END) AS a FROM c GROUP BY doc_id)
SELECT f.doc_id, CAST(a AS INTEGER) AS start, CAST(min(CASE WHEN regexp_matches(compact, '!!$') AND line_no > a THEN line_no END) AS INTEGER) AS "end",
CASE WHEN a IS NULL THEN 'no start' WHEN min(CASE WHEN regexp_matches(compact, '!!$') AND line_no > a THEN line_no END) IS NULL THEN 'no end' ELSE 'ok' END AS status
FROM f JOIN c USING (doc_id) GROUP BY f.doc_id, a""")
def region_status(spark, d):
    return lines.region_status(_lines(spark, d), ["doc_id"], F.col("compact").rlike("^[A-Z].{0,30}$"), F.col("compact").rlike("!!$"))


@query(f"""WITH {_EVENTS}, a AS (SELECT *, coalesce(max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), 0) AS ahead FROM e)
SELECT user_id, min(CASE WHEN event_type = 'error' AND ahead = 0 THEN rn END) AS stop FROM a GROUP BY user_id""")
def toc_stop_lookahead(spark, d):
    rows = _events(spark, d).withColumn("ahead", lines.follows_within(F.col("event_type") == "signup", ["user_id"], "rn", 20))
    return rows.groupBy("user_id").agg(F.min(F.when((F.col("event_type") == "error") & ~F.col("ahead"), F.col("rn"))).alias("stop"))


@query(f"""WITH {_LINES}, b AS (SELECT *, length(compact) < 12 AS is_break FROM c), p AS (SELECT *, sum(CAST(is_break AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS page_no FROM b)
SELECT doc_id, line_no, CAST(page_no AS BIGINT) AS page_no FROM p WHERE NOT is_break""")
def page_split(spark, d):
    return lines.pages(_lines(spark, d), ["doc_id"], F.length("compact") < 12).select("doc_id", "line_no", "page_no")


_BOUNDS = f"""{_LINES}, n AS (SELECT doc_id, coalesce(min(CASE WHEN length(compact) < 20 AND line_no < 500 THEN line_no END), 0) AS s, max(line_no) + 1 AS n_lines FROM c GROUP BY doc_id),
b AS (SELECT n.doc_id, CAST(s AS INTEGER) AS body_start, CAST(coalesce(min(CASE WHEN length(compact) > 400 AND line_no >= s THEN line_no END), n_lines) AS INTEGER) AS body_end, CAST(n_lines AS INTEGER) AS n_lines
FROM n JOIN c USING (doc_id) GROUP BY n.doc_id, s, n_lines)"""


def _bounds(spark, d):
    return lines.body_bounds(_lines(spark, d), ["doc_id"], is_start=F.length("compact") < 20, is_end=F.length("compact") > 400)


@query(f"WITH {_BOUNDS} SELECT * FROM b")
def body_bounds(spark, d):
    return _bounds(spark, d)


@query(f"WITH {_BOUNDS} SELECT b.doc_id, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE line_no >= body_start AND line_no < body_end), '') AS text FROM b JOIN c USING (doc_id) GROUP BY b.doc_id")
def chunk_text_cut(spark, d):
    spans = _bounds(spark, d).select("doc_id", F.lit(0).alias("k"), F.col("body_start").alias("start_line"), F.col("body_end").alias("end_line"))
    return lines.cut_text(_lines(spark, d), spans, ["doc_id"], ["k"]).select("doc_id", "text")


# --- layout ----------------------------------------------------------------------------------------------

_GAPPED = "replace(replace(p_name, 'a', '      '), 'o', '        ')"


def _gapped(spark, d):
    gapped = F.replace(F.replace(F.col("p_name"), F.lit("a"), F.lit("      ")), F.lit("o"), F.lit("        "))
    return _t(spark, d, "part").select("p_partkey", gapped.alias("line"))


@query(f"""WITH l AS (SELECT p_partkey, rtrim({_GAPPED}) AS raw FROM part), g AS (SELECT *, ltrim(raw) AS body, length(raw) - length(ltrim(raw)) AS lead FROM l),
r AS (SELECT *, (SELECT x FROM (SELECT unnest(regexp_extract_all(body, ' {{5,}}')) AS x, unnest(range(len(regexp_extract_all(body, ' {{5,}}')))) AS k) ORDER BY length(x) DESC, k LIMIT 1) AS gap FROM g)
SELECT p_partkey, CASE WHEN trim(raw) = '' THEN '' WHEN gap IS NULL THEN raw ELSE rtrim(left(raw, lead + strpos(body, gap) - 1)) END AS "left",
CASE WHEN gap IS NULL THEN '' ELSE trim(substr(raw, lead + strpos(body, gap) + length(gap))) END AS "right" FROM r""")
def two_column_split(spark, d):
    return _gapped(spark, d).select("p_partkey", layout.split_columns(F.col("line"), None).alias("s")).select("p_partkey", "s.left", "s.right")


@query(f"""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(rtrim({_GAPPED}), ' {{7,}}'), lambda x: trim(x)), lambda x: x <> '')[1:2], '|') AS cells FROM part""")
def wide_gap_split(spark, d):
    return _gapped(spark, d).select("p_partkey", F.array_join(layout.split_wide_gap(F.col("line"), 7), "|").alias("cells"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, CAST(length(raw) + length(regexp_replace(raw, '[^\\x{{1100}}-\\x{{115f}}\\x{{2e80}}-\\x{{a4cf}}\\x{{ac00}}-\\x{{d7a3}}\\x{{ff01}}-\\x{{ff60}}]', '', 'g')) + 3 * (length(raw) - length(replace(raw, chr(9), ''))) AS INTEGER) AS width FROM lines")
def display_width(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", text.display_width(F.col("raw")).alias("width"))


_CELLS = """CASE doc_id % 6 WHEN 0 THEN (doc_id % 90 + 1) || ' ' || lang || ' ........ ' || n_chars % 1000 WHEN 1 THEN '语文园地一....' || n_chars % 1000
 WHEN 2 THEN '◎ 口语交际：' || lang || source || ' .... ' || n_chars % 1000 WHEN 3 THEN '第一单元....' || n_chars % 1000 WHEN 4 THEN '识字表....9' ELSE '      ' || source || ' .... ' || n_chars % 1000 END"""


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'lesson' WHEN 1 THEN 'garden' WHEN 2 THEN 'block_activity' WHEN 3 THEN 'section' WHEN 5 THEN 'sublesson' END AS kind,
CASE WHEN doc_id % 6 = 0 THEN CAST(doc_id % 90 + 1 AS VARCHAR) END AS number, CASE doc_id % 6 WHEN 0 THEN lang WHEN 2 THEN lang || source WHEN 5 THEN source END AS title,
CASE doc_id % 6 WHEN 1 THEN '语文园地一' WHEN 3 THEN '第一单元' END AS label, CASE WHEN doc_id % 6 = 2 THEN '口语交际' END AS block,
CASE WHEN doc_id % 6 IN (0, 1, 2, 5) THEN CAST(n_chars % 1000 AS INTEGER) END AS page FROM documents""")
def parse_cells(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", layout.parse_cell(F.expr(_CELLS)).alias("e"))
    return rows.select("doc_id", *[F.col(f"e.{f}") for f in ("kind", "number", "title", "label", "block", "page")])


_TITLES = "concat(CASE doc_id % 6 WHEN 0 THEN '◎ 习作例文：' WHEN 1 THEN '习作' WHEN 2 THEN '○快乐读书吧 ' WHEN 3 THEN '语文园地' WHEN 4 THEN '综合实践' ELSE '' END, lang)"


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '习作' WHEN 1 THEN '习作' WHEN 2 THEN '快乐读书吧' WHEN 3 THEN '语文园地' WHEN 4 THEN '综合活动' END AS unit_type,
CASE WHEN doc_id % 6 = 0 THEN '习作例文' END AS unit_subtype FROM documents""")
def unit_type_rules(spark, d):
    return layout.typed(_t(spark, d, "documents").select("doc_id", F.expr(_TITLES).alias("title")), F.col("title")).select("doc_id", "unit_type", "unit_subtype")


# --- sequences -------------------------------------------------------------------------------------------


@query(f"WITH {_EVENTS} SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY (rn - 1) // 50, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END, rn) AS INTEGER) AS read_no FROM e")
def column_major_reorder(spark, d):
    rows = _events(spark, d).withColumn("block", F.floor((F.col("rn") - 1) / 50)).withColumn("side", F.when(F.col("event_type").isin("click", "view"), 0).otherwise(1))
    return sequences.column_major(rows, ["user_id"], ["block"], "side", ["rn"]).select("event_id", "read_no")


@query(f"WITH {_EVENTS} SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY rn) AS b FROM e) WHERE b IS NULL OR b <> event_type")
def adjacent_dedup(spark, d):
    return sequences.drop_adjacent(_events(spark, d), F.col("event_type"), ["user_id"], ["rn"]).select("event_id")


@query(f"""WITH {_EVENTS}, t AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN rn END) OVER (PARTITION BY user_id) AS t FROM e),
m AS (SELECT *, min(CASE WHEN event_type = 'purchase' AND rn > t THEN rn END) OVER (PARTITION BY user_id) AS m FROM t)
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN rn = m THEN t - 0.5 ELSE rn END) AS INTEGER) AS new_no FROM m""")
def reposition_first(spark, d):
    return sequences.reposition_first(_events(spark, d), F.col("event_type") == "purchase", F.col("event_type") == "signup", ["user_id"], "rn").select("event_id", "new_no")


_TEMPLATE = ("view", "click", "signup", "view", "purchase", "error", "click", "view", "purchase")


@query(f"""WITH RECURSIVE {_EVENTS}, p AS (SELECT CAST(unnest(range(9)) AS INTEGER) AS entry_no, unnest({list(_TEMPLATE)}) AS kind),
f AS (SELECT user_id, rn, event_id, (SELECT min(entry_no) FROM p WHERE kind = event_type) AS taken, coalesce((SELECT min(entry_no) FROM p WHERE kind = event_type), -1) AS cursor FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.rn, e.event_id, (SELECT min(entry_no) FROM p WHERE kind = e.event_type AND entry_no > f.cursor), coalesce((SELECT min(entry_no) FROM p WHERE kind = e.event_type AND entry_no > f.cursor), f.cursor)
FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT event_id, taken AS entry_no FROM f""")
def greedy_align(spark, d):
    entries = spark.createDataFrame([(k, kind) for k, kind in enumerate(_TEMPLATE)], "entry_no int, kind string")
    rows = _events(spark, d).select("user_id", "rn", "event_type", "event_id")
    taken = sequences.greedy_align(rows, entries, [("event_type", "kind")], ["user_id"], "rn", "entry_no")
    return rows.join(taken, ["user_id", "rn"]).select("event_id", "entry_no")


@query(f"""WITH {_EVENTS}, k AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS k FROM e)
SELECT event_id, n_name FROM k LEFT JOIN nation ON n_nationkey = k - 1""")
def positional_align(spark, d):
    entries = _t(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("entry_no"), "n_name")
    return sequences.positional_align(_events(spark, d), entries, F.col("event_type") == "signup", ["user_id"], ["rn"], "entry_no", ["n_name"]).select("event_id", "n_name")


@query(f"WITH {_EVENTS} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS purchase FROM e")
def carry_forward(spark, d):
    return _events(spark, d).select("event_id", sequences.carry_forward(F.when(F.col("event_type") == "purchase", F.col("event_id")), ["user_id"], ["rn"]).alias("purchase"))


@query(f"""WITH {_EVENTS}, m AS (SELECT *, CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS m FROM e)
SELECT event_id, nullif(last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS strand FROM m""")
def belt_strand_carry(spark, d):
    kind = F.col("event_type")
    return _events(spark, d).select("event_id", sequences.carry_with_reset(F.when(kind == "purchase", F.col("event_id")), kind == "error", ["user_id"], ["rn"]).alias("strand"))


@query(f"""WITH {_EVENTS}, i AS (SELECT *, sum(CASE WHEN rn = 1 OR event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS island FROM e)
SELECT user_id, CAST(island AS BIGINT) AS island, arg_min(event_id, rn) AS first_event, string_agg(event_type, ',' ORDER BY rn) AS kinds FROM i GROUP BY user_id, island""")
def island_merge(spark, d):
    merged = sequences.merge_islands(_events(spark, d), F.col("event_type") == "signup", ["user_id"], ["rn"], ["event_id"], ["event_type"])
    return merged.select("user_id", "island", F.col("event_id").alias("first_event"), F.array_join("event_type", ",").alias("kinds"))


@query(f"""WITH {_EVENTS}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY rn) AS b FROM e),
r AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS run FROM l)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS kind, count(*) AS n FROM r GROUP BY user_id, run""")
def run_attach(spark, d):
    rows = _events(spark, d).withColumn("run", sequences.runs(F.col("event_type"), ["user_id"], ["rn"]))
    return rows.groupBy("user_id", "run").agg(F.min("event_type").alias("kind"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations),
c AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, run) AS n, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, run) AS h FROM r)
SELECT conv_id, turn, h = 1 AND n = 1 AND role = 'user' AS single, h = 1 AND n = 1 AND role = 'assistant' AS swallowed FROM c""")
def collapse_single_child(spark, d):
    rows = sequences.collapse_single(_t(spark, d, "conversations"), F.col("role") == "assistant", F.col("role") == "user", ["conv_id"], ["turn"])
    return rows.select("conv_id", "turn", "single", "swallowed")


@query(f"""WITH {_EVENTS}, g AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS s,
last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM e)
SELECT event_id, CAST(s + max(CASE WHEN s = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS BIGINT) AS group_id, CAST(l AS VARCHAR) AS group_label, user_id || '-toc-' || lpad(CAST(rn AS VARCHAR), CAST(greatest(4, length(CAST(rn AS VARCHAR))) AS INTEGER), '0') AS id FROM g""")
def group_tree(spark, d):
    rows = layout.group_tree(_events(spark, d), ["user_id"], "rn", F.col("event_type") == "signup", F.col("event_id").cast("string"))
    return rows.select("event_id", "group_id", "group_label", text.synthetic_id(F.col("user_id").cast("string"), F.col("rn")).alias("id"))


# --- anchors and chunks ----------------------------------------------------------------------------------

_ANCHORS = f"""{_LINES}, k AS (SELECT compact AS key, compact AS item_id FROM c WHERE length(compact) >= 2 GROUP BY compact HAVING count(DISTINCT doc_id) > 1)"""


def _keys(spark, d):
    """Lines that several documents have stand in for the titles of a contents table."""
    rows = chunks.once(_lines(spark, d), "compact", "key", ["doc_id"]).filter(F.length("key") >= 2).groupBy("key")
    return rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("key", F.col("key").alias("item_id"))


@query(f"WITH {_ANCHORS} SELECT doc_id, item_id, min(line_no) AS line_no FROM c JOIN k ON compact = key GROUP BY doc_id, item_id")
def anchor_single(spark, d):
    return chunks.single_hits(_lines(spark, d), _keys(spark, d), ["doc_id"]).groupBy("doc_id", "item_id").agg(F.min("line_no").alias("line_no"))


@query(f"""WITH {_ANCHORS}, w AS (SELECT doc_id, line_no, compact AS a, lead(compact) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM c)
SELECT DISTINCT doc_id, item_id, line_no AS start_line, line_no + 1 AS hit_line FROM w JOIN k ON a || b = key OR (ends_with(a || b, key) AND length(a || b) <= length(key) + 12) WHERE b IS NOT NULL""")
def anchor_window(spark, d):
    return chunks.pair_hits(_lines(spark, d), _keys(spark, d), ["doc_id"]).select("doc_id", "item_id", "start_line", "hit_line")


_FOLD = f"""{_ANCHORS}, h AS (SELECT DISTINCT doc_id, item_id, line_no FROM c JOIN k ON compact = key),
o AS (SELECT doc_id, item_id, list(line_no ORDER BY line_no) AS may, row_number() OVER (PARTITION BY doc_id ORDER BY item_id) AS n FROM h GROUP BY doc_id, item_id),
f AS (SELECT doc_id, item_id, n, may[1] AS start_line, may[1] AS cursor FROM o WHERE n = 1
UNION ALL SELECT o.doc_id, o.item_id, o.n, list_min(list_filter(o.may, lambda x: x > f.cursor)), coalesce(list_min(list_filter(o.may, lambda x: x > f.cursor)), f.cursor) FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1)"""


def _fold(spark, d):
    return chunks.fold_hits(chunks.single_hits(_lines(spark, d), _keys(spark, d), ["doc_id"]), ["doc_id"], "item_id")


@query(f"WITH RECURSIVE {_FOLD} SELECT doc_id, item_id, start_line FROM f")
def anchor_fold(spark, d):
    return _fold(spark, d).select("doc_id", "item_id", "start_line")


@query(f"""WITH RECURSIVE {_FOLD}, n AS (SELECT doc_id, CAST(max(line_no) + 1 AS INTEGER) AS n_lines FROM lines GROUP BY doc_id)
SELECT doc_id, item_id, start_line, CASE WHEN start_line IS NOT NULL THEN coalesce(first_value(start_line IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY item_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n_lines) END AS end_line FROM f JOIN n USING (doc_id)""")
def chunk_ends(spark, d):
    n = _lines(spark, d).groupBy("doc_id").agg((F.max("line_no") + 1).alias("n_lines"))
    return sequences.chunk_ends(_fold(spark, d).join(n, "doc_id"), ["doc_id"], ["item_id"], "start_line", F.col("n_lines")).select("doc_id", "item_id", "start_line", "end_line")


# --- vocabulary ------------------------------------------------------------------------------------------

_KEPT = r"list_filter(" + _WORDS + r", lambda t: NOT regexp_full_match(t, '[\p{Nd}]+') AND NOT regexp_full_match(t, '\p{P}+'))"


@query(rf"""SELECT count(*) AS tokens, count(*) FILTER (WHERE NOT regexp_full_match(t, '[A-Za-z]+') AND NOT regexp_full_match(t, '[\p{{Nd}}]+') AND NOT regexp_full_match(t, '\p{{P}}+')) AS kept,
count(*) FILTER (WHERE NOT regexp_full_match(t, '\p{{P}}+')) AS without_punctuation FROM (SELECT unnest({_WORDS}) AS t FROM documents)""")
def token_keep_filter(spark, d):
    rows = _t(spark, d, "documents").select(F.explode(_words(None)).alias("t"))
    only = text.keep_token(F.col("t"), ascii_letters=False, digits=False)
    return rows.agg(F.count(F.lit(1)).alias("tokens"), F.count_if(text.keep_token(F.col("t"))).alias("kept"), F.count_if(only).alias("without_punctuation"))


def _sets(spark, d):
    return lookup.token_sets(_t(spark, d, "documents").select("doc_id", "source", "text"), _words(None), ascii_letters=False)


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({_KEPT})), ' ') AS tokens FROM documents")
def chunk_token_sets(spark, d):
    return _sets(spark, d).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


_FREQ = f"freq AS (SELECT t AS word, count(*) AS freq FROM (SELECT unnest(list_distinct({_KEPT})) AS t FROM documents UNION ALL SELECT unnest({_WORDS}) FROM benchmark) GROUP BY t)"


def _freq(spark, d):
    counted = lookup.chunk_words(_t(spark, d, "documents"), _words(None), ascii_letters=False)
    return lookup.total_frequency(counted, _t(spark, d, "benchmark").select(_words(None).alias("words")))


@query(f"WITH {_FREQ} SELECT * FROM freq")
def word_freq(spark, d):
    return _freq(spark, d)


@query(f"""WITH {_FREQ} SELECT word, freq, CAST(row_number() OVER (ORDER BY freq DESC, word) AS INTEGER) AS place FROM freq QUALIFY place <= 50""")
def top_words(spark, d):
    w = Window.orderBy(F.desc("freq"), "word")
    return _freq(spark, d).orderBy(F.desc("freq"), "word").limit(50).withColumn("place", F.row_number().over(w))


_POS = "pos AS (SELECT *, row_number() OVER (ORDER BY source, doc_id) - 1 AS pos FROM documents), ends AS (SELECT count(*) // 5 AS a, count(*) // 2 AS b FROM documents)"


_ORDER = ["source", "doc_id"]


def _ends() -> tuple[Column, Column]:
    """The places of the range's ends."""
    return F.floor(F.col("total") / 5), F.floor(F.col("total") / 2)


def _bucket():
    """Ranges of a source's documents that one task can number."""
    return {"source": F.col("source"), "range": F.floor(F.col("doc_id") / 65536)}


def _ranged(spark, d):
    """The documents of the range, found by its two ends."""
    docs = _t(spark, d, "documents").select("source", "doc_id", "text")
    return lookup.between_places(docs, docs, _ORDER, *_ends(), _bucket())


@query(f"WITH {_POS} SELECT DISTINCT c AS item FROM (SELECT unnest(string_split(text, '')) AS c FROM pos, ends WHERE pos BETWEEN a AND b) WHERE regexp_full_match(c, '[\\p{{L}}]')")
def known_set_range(spark, d):
    each = _ranged(spark, d).select(F.explode(F.array_distinct(text.code_points(F.col("text")))).alias("item")).distinct()
    return each.filter(F.col("item").rlike(r"^\p{L}$"))


@query(f"WITH {_POS} SELECT DISTINCT unnest({_KEPT}) AS item FROM pos, ends WHERE pos BETWEEN a AND b")
def known_words_range(spark, d):
    return lookup.chunk_words(_ranged(spark, d), _words(None), ascii_letters=False).select(F.col("word").alias("item"))


_VOWELS = ["a", "e", "i", "o", "u"]
_MARK = r"regexp_full_match(c, '[A-Za-z]')"


def _marked(template: str, mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        marked = lookup.mark_known(F.col("text"), _VOWELS, template, mode, "^[A-Za-z]$")
        return _t(spark, d, "conversations").select("conv_id", "turn", marked.alias("text"))

    return run


def _mark_sql(hit: str, value: str) -> str:
    return f"SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN {_MARK} AND {hit} THEN {value} ELSE c END), '') AS text FROM conversations"


for _name, _template, _mode, _hit, _value in (
    ("replace_known", "□", "replace-known", f"c IN {tuple(_VOWELS)}", "'□'"),
    ("replace_unknown", "□", "replace-unknown", f"c NOT IN {tuple(_VOWELS)}", "'□'"),
    ("replace_template", "[$1]", "replace-known", f"c IN {tuple(_VOWELS)}", "'[' || c || ']'"),
):
    QUERIES[_name], SQL[_name] = _marked(_template, _mode), _mark_sql(_hit, _value)


@query(f"""SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '(?s)tion|the|an|.'), lambda c: CASE WHEN c IN ('tion', 'the', 'an') THEN '□' WHEN {_MARK} AND c IN {tuple(_VOWELS)} THEN '□' ELSE c END), '') AS text FROM conversations""")
def replace_word_first(spark, d):
    marked = lookup.mark_words(F.col("text"), ["an", "the", "tion"], _VOWELS, "□", "replace-known", "^[A-Za-z]$")
    return _t(spark, d, "conversations").select("conv_id", "turn", marked.alias("text"))


@query(f"""SELECT conv_id, turn, CAST(len(list_filter(string_split(text, ''), lambda c: {_MARK})) AS INTEGER) AS marked, CAST(len(list_filter(string_split(text, ''), lambda c: c IN {tuple(_VOWELS)})) AS INTEGER) AS replaced FROM conversations""")
def mark_statistics(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", lookup.mark_statistics(F.col("text"), _VOWELS, is_marked="^[A-Za-z]$").alias("s")).select("conv_id", "turn", "s.marked", "s.replaced")


def _hits(rows, keys):
    """Tokens that hold the needle, found before the patterns of ``keep_token`` are tried."""
    found = lookup.token_hits(rows.select(*keys, _words(None).alias("tokens")), keys, "tokens", "ed")
    return found.filter(text.keep_token(F.col("token"), ascii_letters=False))


@query(f"WITH {_POS} SELECT doc_id, token FROM (SELECT doc_id, unnest(list_distinct({_KEPT})) AS token FROM pos, ends WHERE pos BETWEEN a AND b) WHERE contains(token, 'ed')")
def chunk_token_hits(spark, d):
    rows = _ranged(spark, d).filter(F.col("text").contains("ed"))
    return _hits(rows, ["doc_id"])


@query(f"SELECT item_id, token FROM (SELECT item_id, unnest(list_distinct({_WORDS})) AS token FROM benchmark) WHERE contains(token, 'ed')")
def table_hits(spark, d):
    rows = _t(spark, d, "benchmark").select("item_id", _words(None).alias("words"))
    return lookup.token_hits(rows, ["item_id"], "words", "ed")


@query(f"""WITH {_POS}, {_FREQ}, h AS (SELECT DISTINCT CASE WHEN b - pos = 0 THEN 'last' WHEN b - pos IN (1, 2) THEN 'near' ELSE 'other' END AS bucket, word FROM (SELECT pos, b, unnest({_KEPT}) AS word FROM pos, ends WHERE pos BETWEEN a AND b) WHERE contains(word, 'ed'))
SELECT bucket, string_agg(word, ' ' ORDER BY coalesce(freq, 0) DESC, word) AS words FROM h LEFT JOIN freq USING (word) GROUP BY bucket""")
def word_buckets(spark, d):
    hits = _hits(_ranged(spark, d).filter(F.col("text").contains("ed")), ["doc_id"])
    pos = lookup.positions(_t(spark, d, "documents").select("source", "doc_id"), _ORDER, _bucket())
    hits = hits.join(pos, "doc_id").withColumn("bucket", lookup.bucket(F.col("pos"), _ends()[1]))
    return lookup.bucket_words(hits, _freq(spark, d)).select("bucket", F.array_join("words", " ").alias("words"))


@query("""WITH w AS (SELECT unnest(['q', 'z', 'é', '中', '#']) AS item), i AS (SELECT DISTINCT item_id, unnest(string_split(text, '')) AS item FROM benchmark)
SELECT w.item, item_id, item_id IS NOT NULL AS found FROM w LEFT JOIN i USING (item)""")
def char_lookup(spark, d):
    wanted = spark.createDataFrame([(c,) for c in "qzé中#"], "item string")
    return lookup.look_up(wanted, _t(spark, d, "benchmark").select("item_id", text.code_points(F.col("text")).alias("chars")), "item", "chars", ["item_id"])


@query(f"""WITH w AS (SELECT unnest(['the', 'of', 'que', 'nowhere']) AS item), i AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS item FROM documents)
SELECT w.item, doc_id, doc_id IS NOT NULL AS found FROM w LEFT JOIN i USING (item)""")
def word_lookup(spark, d):
    wanted = spark.createDataFrame([(c,) for c in ("the", "of", "que", "nowhere")], "item string")
    return lookup.look_up(wanted, _t(spark, d, "documents").select("doc_id", _words(None).alias("words")), "item", "words", ["doc_id"])


# --- reports, sources ------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched_report(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left_anti")


@query("""SELECT source, count(*) AS anchors, count(l.doc_id) AS assigned, count(*) > 0 AND count(*) = count(l.doc_id) AS ok FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""")
def alignment_report(spark, d):
    labels = _t(spark, d, "labels").select("doc_id", F.lit(True).alias("assigned"))
    return chunks.alignment_report(_t(spark, d, "documents").join(labels.distinct(), "doc_id", "left"), ["source"], F.lit(True), F.col("assigned"))


@query("SELECT doc_id, n_chars AS stated, CAST(length(text) AS BIGINT) AS computed, n_chars = length(text) AS ok FROM documents")
def total_check(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.col("n_chars").alias("stated"), F.length("text").cast("long").alias("computed")).withColumn("ok", F.col("stated") == F.col("computed"))


@query("""SELECT item_id, array_to_string(list_transform(regexp_extract_all(t, '"[^"]*"|(?s:.)'), lambda x: CASE WHEN length(x) > 1 THEN x ELSE translate(x, 'QWASTYGHERDFUIJKOPLMNBVCXZÜ', 'āáǎàōóǒòēéěèīíǐìūúǔùǖǘǚǜxzü') END), '') AS marked
FROM (SELECT item_id, regexp_replace(replace(text, chr(39), ''), ' (T[a-z]+) ', ' "\\1" ', 'g') AS t FROM benchmark)""")
def tone_transcribe(spark, d):
    quoted = F.regexp_replace(F.replace(F.col("text"), F.lit("'"), F.lit("")), " (T[a-z]+) ", ' "$1" ')
    return _t(spark, d, "benchmark").select("item_id", text.transcribe(quoted).alias("marked"))


@query("SELECT doc_id FROM labels WHERE toxic = 1")
def csv_flag_filter(spark, d):
    return _t(spark, d, "labels").filter(rules.truthy(F.col("toxic").cast("string"))).select("doc_id")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'overlay' AS v, event_type AS t FROM events""")
def deep_merge_json(spark, d):
    base = F.create_map(F.lit("k"), F.lit("none"), F.lit("v"), F.lit("base"))
    own = F.map_filter(F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("v"), F.lit("overlay"), F.lit("t"), F.col("event_type")), lambda _, v: v.isNotNull())
    merged = chunks.overlay(base, own)
    return _t(spark, d, "events").select("event_id", merged["k"].alias("k"), merged["v"].alias("v"), merged["t"].alias("t"))


def _register_screens() -> None:
    from lectern.plans import screen_queries

    QUERIES.update(screen_queries.QUERIES)
    SQL.update(screen_queries.SQL)


_register_screens()
