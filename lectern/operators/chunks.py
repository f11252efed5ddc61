"""Title anchors in the body of a book, and the chunks they bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.rules import is_appendix_head, is_column_head, is_footnote, is_page_number, is_short
from lectern.functions.text import compact, strip, strip_circled
from lectern.operators.sequences import chunk_ends

#: The kinds of entries that are looked for in the body.
ANCHORED = ("lesson", "sublesson", "garden", "reading_club", "block_activity", "toc_belt")
WINDOW_SLACK = 12
#: Fixed value: ends share the hash of their last characters, so many or a multiple of it.
BLOCK = 16


def title_keys(entry: Column) -> Column:
    """Compacted titles to look for, in order, without repeats or single characters. ``entry`` is a struct
    with kind, number, title, label, block, subtitle, optional_reading."""
    e = lambda f: entry[f]
    none = F.array().cast("array<string>")
    joined = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.array(F.concat(a, b))).when(b.isNotNull(), F.array(b)).otherwise(none)
    number, title = strip(e("number")), strip(e("title"))
    numbered = F.when(e("number").isNull(), none).otherwise(F.array(F.concat(number, title)))
    starred = F.when(e("number").isNotNull() & F.coalesce(e("optional_reading"), F.lit(False)), F.array(F.concat(number, F.lit("*"), title), F.concat(number, F.lit("＊"), title))).otherwise(none)
    keys = (
        F.when(e("kind") == "lesson", F.when(e("title").isNull(), none).otherwise(F.concat(F.array(e("title")), numbered, starred)))
        .when(e("kind") == "sublesson", F.array(e("title")))
        .when(e("kind") == "garden", F.array(e("label")))
        .when(e("kind") == "reading_club", F.array(F.lit("快乐读书吧"), e("subtitle")))
        .when(e("kind") == "block_activity", joined(e("block"), e("title")))
        .when(e("kind") == "toc_belt", F.when(e("title").isNotNull(), joined(e("label"), e("title"))).otherwise(none))
        .otherwise(none)
    )
    made = F.transform(F.filter(keys, lambda k: k.isNotNull()), lambda k: strip_circled(compact(k)))
    return F.array_distinct(F.filter(made, lambda k: F.length(k) >= 2))


def once(rows: DataFrame, value: str, name: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``value`` as ``name``. A condition on the name is not pushed below this, where it would compute the
    value a second time."""
    return rows.select(*keep, F.explode(F.array(value)).alias(name))


def single_hits(lines: DataFrame, keys: DataFrame, part: list[str]) -> DataFrame:
    """Lines that equal a key: ``part``, the columns of ``keys``, line_no, compact. An equi-join."""
    own = [c for c in part if c in keys.columns]
    return once(lines, "compact", "key", [*part, "line_no"]).join(keys, [*own, "key"])


def _ends(rows: DataFrame, merged: str, keys: DataFrame, part: list[str], slack: int) -> DataFrame:
    """``rows`` with the key that ends ``merged``, at most ``slack`` characters shorter.

    An equi-join on the length and 128 bits of the end, not a nested loop: a row makes at most ``slack`` + 1 ends, and
    what is shuffled for each is numbers, without any text of the row. An end is hashed as its last characters, a multiple
    of ``BLOCK``, and the few before these, so that the ends of a row share the hash of what is long."""
    hashes = lambda s: (F.xxhash64(s), F.xxhash64(F.lit(1), s))
    others = [c for c in rows.columns if c != merged]
    blocks = range(slack // BLOCK + 2)
    sized = rows.withColumn("n_", F.length(merged)).filter("n_ > 0")
    tails = []
    for j in blocks:
        long = F.greatest(F.lit(0), (F.floor(F.col("n_") / BLOCK).cast("int") - j) * BLOCK)
        tails += [h.alias(f"t{k}_{j}") for k, h in enumerate(hashes(F.substring(F.col(merged), F.col("n_") - long + 1, long)))]
    cut = sized.select(*others, "n_", F.substring(merged, 1, slack + BLOCK).alias("head_"), *tails)
    cut = cut.withColumn("k", F.explode(F.sequence(F.greatest(F.col("n_") - slack, F.lit(1)), F.col("n_"))))
    at = F.floor(F.col("n_") / BLOCK) - F.floor(F.col("k") / BLOCK)
    tail = [F.coalesce(*[F.when(at == j, F.col(f"t{k}_{j}")) for j in blocks]) for k in range(2)]
    bits = lambda head, t: [F.xxhash64(head, t[0]).alias("h1"), F.xxhash64(F.lit(1), head, t[1]).alias("h2")]
    cut = cut.select(*others, "k", *bits(F.substring(F.col("head_"), F.col("n_") - F.col("k") + 1, F.col("k") % BLOCK), tail))
    own = [c for c in part if c in keys.columns]
    key, size = F.col("key"), F.length("key")
    of_key = bits(F.substring(key, F.lit(1), size % BLOCK), hashes(F.substring(key, size % BLOCK + 1, size)))
    return cut.join(keys.select("*", size.alias("k"), *of_key), [*own, "k", "h1", "h2"]).drop("k", "h1", "h2")


def pair_hits(lines: DataFrame, keys: DataFrame, part: list[str], slack: int = WINDOW_SLACK) -> DataFrame:
    """Two lines in a row that together end with a key: start_line and hit_line (the last of the two)."""
    w = Window.partitionBy(*part).orderBy("line_no")
    rows = lines.select(*part, F.col("line_no").alias("start_line"), F.concat("compact", F.lead("compact").over(w)).alias("merged"), F.lead("line_no").over(w).alias("hit_line")).filter("merged is not null and merged <> ''")
    return _ends(rows, "merged", keys, part, slack).distinct()


def fold_hits(hits: DataFrame, part: list[str], entry: str, start: int = 0) -> DataFrame:
    """In the order of the entries, each takes its first hit after the line of the last one: start_line.

    A part's hits are folded as small arrays of integers."""
    per = hits.groupBy(*part, entry).agg(F.array_sort(F.collect_set(F.col("line_no").cast("int"))).alias("may"))
    rows = per.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(F.col(entry).alias("e"), F.col("may")))).alias("rows"))
    zero = F.struct(F.lit(start - 1).cast("int").alias("cursor"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        take = F.get(F.filter(x["may"], lambda n: n > acc["cursor"]), F.lit(0))
        return F.struct(F.coalesce(take, acc["cursor"]).alias("cursor"), F.concat(acc["out"], F.array(take)).alias("out"))

    taken = rows.select(*part, "rows", F.aggregate("rows", zero, step)["out"].alias("out"))
    zipped = taken.select(*part, F.explode(F.arrays_zip("rows", "out")).alias("z"))
    return zipped.select(*part, F.col("z.rows.e").alias(entry), F.col("z.out").alias("start_line"))


def propose_spans(lines: DataFrame, entries: DataFrame, bounds: DataFrame, part: list[str]) -> DataFrame:
    """Spans of all anchored entries: part, ord, keys, start_line, end_line, match_mode, ok.

    Candidates come from two joins (a line alone; up to three lines together); the cursor is a fold over
    each book's candidates that tries lines alone first, then windows, from the cursor on."""
    c = strip_circled(F.col("compact"))
    body = lines.join(bounds.select(*part, "body_start", "body_end"), part).filter("line_no >= body_start and line_no < body_end")
    body = body.select(*part, "line_no", c.alias("c"), "body_start", "body_end")
    wanted = entries.filter(F.col("entry.kind").isin(*ANCHORED)).withColumn("keys", title_keys(F.col("entry"))).filter("size(keys) > 0")
    keys = wanted.select(*part, "ord", F.explode("keys").alias("key"))
    # A line alone stops at the first appendix head that circled digits hide from the body's end.
    stop = F.min(F.when(is_appendix_head(F.col("c")), F.col("line_no"))).over(Window.partitionBy(*part).orderBy("line_no").rowsBetween(0, Window.unboundedFollowing))
    body = body.withColumn("stop", F.coalesce(stop, F.col("body_end")))
    plain = ~is_page_number(F.col("c")) & ~is_column_head(F.col("c")) & ~is_footnote(F.col("c")) & ~is_short(F.col("c"), 1)
    alone = body.filter(plain).select(*part, F.col("c").alias("key"), "line_no", "stop").join(keys, [*part, "key"])
    alone = alone.groupBy(*part, "ord").agg(F.array_sort(F.collect_set(F.struct(F.col("line_no").alias("s"), F.col("line_no").alias("h")))).alias("alone"))
    w = Window.partitionBy(*part).orderBy("line_no")
    three = F.array(*[F.when(F.lead("line_no", k).over(w).isNotNull() | F.lit(k == 0), F.struct(F.coalesce(F.lead("c", k).over(w), F.lit("")).alias("c"), (F.col("line_no") + k).alias("n"))) for k in range(3)])
    state = F.struct(F.lit("").alias("m"), F.lit(0).alias("n"), F.lit(False).alias("off"), F.array().cast("array<struct<m:string,n:int>>").alias("out"))

    def join_line(a: Column, x: Column) -> Column:
        head = is_appendix_head(x["c"])
        skip = x["c"].isNull() | (x["c"] == "") | ((a["m"] == "") & (is_page_number(x["c"]) | is_column_head(x["c"])))
        off = a["off"] | F.coalesce(head, F.lit(False))
        m = F.when(off | skip, a["m"]).otherwise(F.concat(a["m"], x["c"]))
        out = F.when(off | skip, a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(m.alias("m"), x["n"].alias("n")))))
        return F.struct(m.alias("m"), a["n"].alias("n"), off.alias("off"), out.alias("out"))

    windows = body.withColumn("three", three).select(*part, "line_no", "stop", F.explode(F.aggregate(F.filter("three", lambda x: x.isNotNull()), state, join_line)["out"]).alias("o")).select(*part, "line_no", "stop", "o.m", "o.n")
    together = _ends(windows.filter("m <> ''").select(*part, "line_no", "n", "m"), "m", keys, part, WINDOW_SLACK).groupBy(*part, "ord").agg(F.array_sort(F.collect_set(F.struct(F.col("line_no").alias("s"), F.col("n").alias("h")))).alias("together"))
    empty = F.array().cast("array<struct<s:int,h:int>>")
    rows = wanted.select(*part, "ord", "keys").join(alone, [*part, "ord"], "left").join(together, [*part, "ord"], "left")
    rows = rows.select(*part, F.struct("ord", "keys", F.coalesce("alone", empty).alias("alone"), F.coalesce("together", empty).alias("together")).alias("r"))
    stops = body.groupBy(*part).agg(F.array_sort(F.collect_set(F.when(is_appendix_head(F.col("c")), F.col("line_no")))).alias("stops"))
    folded = rows.groupBy(*part).agg(F.array_sort(F.collect_list("r"), lambda a, b: (a["ord"] - b["ord"]).cast("int")).alias("rows")).join(bounds.select(*part, "body_start", "body_end"), part).join(stops, part, "left")
    zero = F.struct(F.col("body_start").cast("int").alias("cursor"), F.array().cast("array<struct<s:int,mode:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        stop_at = F.coalesce(F.get(F.filter("stops", lambda n: n >= acc["cursor"]), F.lit(0)), F.col("body_end"))
        a = F.get(F.filter(x["alone"], lambda p: (p["s"] >= acc["cursor"]) & (p["s"] < stop_at)), F.lit(0))
        b = F.get(F.filter(x["together"], lambda p: (p["s"] >= acc["cursor"]) & (p["s"] < stop_at)), F.lit(0))
        line = F.coalesce(a["h"], b["h"]).cast("int")
        mode = F.when(a.isNotNull(), "single").when(b.isNotNull(), "window")
        return F.struct(F.coalesce(line + 1, acc["cursor"]).cast("int").alias("cursor"), F.concat(acc["out"], F.array(F.struct(line.alias("s"), mode.alias("mode")))).alias("out"))

    done = folded.withColumn("out", F.aggregate("rows", zero, step)["out"])
    flat = done.select(*part, "body_end", F.explode(F.arrays_zip("rows", "out")).alias("z"))
    flat = flat.select(*part, "body_end", F.col("z.rows.ord").alias("ord"), F.col("z.rows.keys").alias("keys"), F.col("z.out.s").alias("start_line"), F.col("z.out.mode").alias("match_mode"))
    return chunk_ends(flat, part, ["ord"], "start_line", F.col("body_end")).withColumn("ok", F.col("start_line").isNotNull()).drop("body_end")


def alignment_report(rows: DataFrame, part: list[str], anchor: Column, assigned: Column) -> DataFrame:
    """Per part: anchors, how many are assigned, and whether all are (and there are some)."""
    counts = rows.groupBy(*part).agg(F.count_if(anchor).alias("anchors"), F.count_if(anchor & F.coalesce(assigned, F.lit(False))).alias("assigned"))
    return counts.withColumn("ok", (F.col("anchors") > 0) & (F.col("anchors") == F.col("assigned")))


def overlay(base: Column, over: Column) -> Column:
    """One level of a deep merge of maps: the overlay wins, keys of either stay."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)
