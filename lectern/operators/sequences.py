"""Order-sensitive operators: carry forward, islands, chunk ends, collapsing, aligning.

Each takes the columns that part the rows and the column that orders them. All are window functions over the
part, but ``greedy_align``: a sequential cursor is a fold over the part's (small) array of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(part: list[str], order: list[str]):
    return Window.partitionBy(*part).orderBy(*order)


def carry_forward(value: Column, part: list[str], order: list[str]) -> Column:
    """The last value that is not null, up to this row."""
    return F.last(value, ignorenulls=True).over(_w(part, order).rowsBetween(Window.unboundedPreceding, 0))


def carry_with_reset(value: Column, reset: Column, part: list[str], order: list[str]) -> Column:
    """As ``carry_forward``, but a reset row clears what was carried."""
    marked = F.when(reset, F.struct(F.lit(None).cast("string").alias("v"))).when(value.isNotNull(), F.struct(value.cast("string").alias("v")))
    return carry_forward(marked, part, order)["v"]


def islands(anchor: Column, part: list[str], order: list[str]) -> Column:
    """Number of the island a row is in: every anchor begins one, and so does a part's first row."""
    first = F.row_number().over(_w(part, order)) == 1
    return F.sum((first | anchor).cast("int")).over(_w(part, order).rowsBetween(Window.unboundedPreceding, 0))


def runs(flag: Column, part: list[str], order: list[str]) -> Column:
    """Number of the maximal run of equal values a row is in."""
    w = _w(part, order)
    changed = (F.lag(flag).over(w) != flag) | F.lag(flag).over(w).isNull()
    return F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def merge_islands(rows: DataFrame, anchor: Column, part: list[str], order: list[str], first: list[str], lists: list[str]) -> DataFrame:
    """One row an island: the columns ``first`` of its first row, the values of ``lists`` gathered in order."""
    ord_ = F.struct(*order)
    rows = rows.withColumn("island", islands(anchor, part, order))
    gathered = [F.transform(F.array_sort(F.collect_list(F.struct(ord_.alias("o"), F.col(c).alias("v")))), lambda x: x["v"]).alias(c) for c in lists]
    return rows.groupBy(*part, "island").agg(*[F.min_by(c, ord_).alias(c) for c in first], *gathered)


def next_value(value: Column, part: list[str], order: list[str]) -> Column:
    """The next value that is not null, after this row."""
    return F.first(value, ignorenulls=True).over(_w(part, order).rowsBetween(1, Window.unboundedFollowing))


def chunk_ends(spans: DataFrame, part: list[str], order: list[str], start: str, last: Column) -> DataFrame:
    """Add end_line: the next matched start of the part, else its end."""
    end = F.coalesce(next_value(F.col(start), part, order), last)
    return spans.withColumn("end_line", F.when(F.col(start).isNotNull(), end))


def drop_adjacent(rows: DataFrame, value: Column, part: list[str], order: list[str]) -> DataFrame:
    """Without rows whose value equals that of the row before."""
    return rows.withColumn("before", F.lag(value).over(_w(part, order))).filter(F.col("before").isNull() | (F.col("before") != value)).drop("before")


def column_major(rows: DataFrame, part: list[str], block: list[str], side: str, order: list[str]) -> DataFrame:
    """Add read_no: reading order that takes a block's left side before its right side."""
    return rows.withColumn("read_no", F.row_number().over(_w(part, [*block, side, *order])))


def reposition_first(rows: DataFrame, movable: Column, target: Column, part: list[str], order: str) -> DataFrame:
    """Give the first movable row after the first target a place just before it; adds new_no (from 1)."""
    w = Window.partitionBy(*part)
    rows = rows.withColumn("t", F.min(F.when(target, F.col(order))).over(w))
    rows = rows.withColumn("m", F.min(F.when(movable & (F.col(order) > F.col("t")), F.col(order))).over(w))
    place = F.when(F.col(order) == F.col("m"), F.col("t") - F.lit(0.5)).otherwise(F.col(order).cast("double"))
    return rows.withColumn("place", place).withColumn("new_no", F.row_number().over(_w(part, ["place"]))).drop("t", "m", "place")


def collapse_single(rows: DataFrame, is_child: Column, is_parent: Column, part: list[str], order: list[str]) -> DataFrame:
    """Mark parents that have exactly one child run member (single) and the child it swallows (swallowed)."""
    w = _w(part, order)
    rows = rows.withColumn("is_child", is_child).withColumn("is_parent", is_parent)
    rows = rows.withColumn("run", F.sum((~F.col("is_child")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = Window.partitionBy(*part, "run")
    rows = rows.withColumn("children", F.sum(F.col("is_child").cast("int")).over(per)).withColumn("headed", F.max(F.col("is_parent").cast("int")).over(per) == 1)
    one = F.col("headed") & (F.col("children") == 1)
    return rows.withColumn("single", one & F.col("is_parent")).withColumn("swallowed", one & F.col("is_child")).drop("is_child", "is_parent", "children", "headed")


def collapse_entries(rows: DataFrame, kind: Column, part: list[str], order: list[str]) -> DataFrame:
    """Mark entries that take the next one into themselves (takes) and those that are taken (taken).

    An entry other than a section with exactly one sublesson takes it. A belt without sublessons takes an activity
    that follows at once; the sublessons of an activity that was taken stay on their own."""
    w = _w(part, order)
    rows = rows.withColumn("own_kind", kind)
    rows = rows.withColumn("before", F.lag("own_kind").over(w)).withColumn("after", F.lead("own_kind").over(w))
    child = F.col("own_kind") == "sublesson"
    consumed = (F.col("own_kind") == "block_activity") & F.coalesce(F.col("before") == "toc_belt", F.lit(False))
    rows = rows.withColumn("consumed", consumed).withColumn("run", F.sum((~child).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = Window.partitionBy(*part, "run")
    one = (F.sum(child.cast("int")).over(per) == 1) & F.coalesce(F.max((~child & (F.col("own_kind") != "section") & ~F.col("consumed"))).over(per), F.lit(False))
    belt = (F.col("own_kind") == "toc_belt") & F.coalesce(F.col("after") == "block_activity", F.lit(False))
    rows = rows.withColumn("one", one)
    rows = rows.withColumn("takes", ~child & ~F.col("consumed") & (F.col("one") | belt)).withColumn("taken", F.col("consumed") | (child & F.col("one")))
    return rows.drop("own_kind", "before", "after", "consumed", "one", "run")


def positional_align(rows: DataFrame, entries: DataFrame, anchor: Column, part: list[str], order: list[str], entry_no: str, keep: list[str]) -> DataFrame:
    """The k-th anchor meets the k-th entry; rows between anchors inherit; none where entries run out."""
    k = F.sum(anchor.cast("int")).over(_w(part, order).rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("k", k)
    keys = [c for c in part if c in entries.columns]
    return numbered.join(entries.select(*keys, F.col(entry_no).alias("k"), *keep), [*keys, "k"], "left")


def greedy_align(rows: DataFrame, entries: DataFrame, matches: Column | list[tuple[str, str]], part: list[str], row_no: str, entry_no: str) -> DataFrame:
    """Monotone matching: in order, each row takes the first entry after the cursor that it matches; a row
    without one leaves the cursor where it is. ``part``, row_no, entry_no (null: unmatched).

    ``matches`` are pairs of columns that are equal (of the rows, of the entries), or any condition where the parts have
    entries of their own. The join only yields, for each row, the numbers of the entries it could take; the fold over
    a part's rows then handles integers only. Parts are books: small, and independent of each other."""
    keys = [c for c in part if c in entries.columns]
    if isinstance(matches, list):
        on = [rows[a] == entries[b] for a, b in matches] + [rows[c] == entries[c] for c in keys]
        pairs = rows.join(entries, on).select(*[rows[c] for c in (*part, row_no)], entries[entry_no])
    elif keys:
        pairs = rows.join(entries, keys).filter(matches)
    else:
        raise ValueError("entries without a part of their own are matched by equal columns")
    found = pairs.groupBy(*part, row_no).agg(F.array_sort(F.collect_set(F.col(entry_no).cast("int"))).alias("may"))
    all_ = rows.select(*part, F.col(row_no)).join(found, [*part, row_no], "left")
    may = F.coalesce("may", F.array().cast("array<int>"))
    folded = all_.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(F.col(row_no).alias("r"), may.alias("may")))).alias("rows"))
    start = F.struct(F.lit(-1).cast("int").alias("cursor"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        take = F.get(F.filter(x["may"], lambda e: e > acc["cursor"]), F.lit(0))
        return F.struct(F.coalesce(take, acc["cursor"]).alias("cursor"), F.concat(acc["out"], F.array(take)).alias("out"))

    taken = folded.select(*part, "rows", F.aggregate("rows", start, step)["out"].alias("out"))
    zipped = taken.select(*part, F.explode(F.arrays_zip("rows", "out")).alias("z"))
    return zipped.select(*part, F.col("z.rows.r").alias(row_no), F.col("z.out").alias(entry_no))
