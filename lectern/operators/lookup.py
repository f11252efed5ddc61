"""Vocabulary operators: token sets, frequency, known sets over ranges, marking, hits and buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import graphemes, keep_token, replace_template


def token_sets(rows: DataFrame, tokens: Column, **kept: bool) -> DataFrame:
    """Add tokens: distinct, kept by ``keep_token``, in order of code points. Repeats go before the patterns are tried."""
    return rows.withColumn("tokens", F.array_sort(F.filter(F.array_distinct(tokens), lambda t: keep_token(t, **kept))))


def chunk_words(rows: DataFrame, tokens: Column, **kept: bool) -> DataFrame:
    """word, n: how many rows have a word that ``keep_token`` keeps. Words are counted first, then tested once each."""
    each = rows.select(F.explode(F.array_distinct(tokens)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return each.filter(keep_token(F.col("word"), **kept))


def total_frequency(chunk_counts: DataFrame, word_rows: DataFrame, words: str = "words") -> DataFrame:
    """word, freq: chunks that have the word (word, n), plus its occurrences in word rows."""
    listed = word_rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    each = chunk_counts.unionByName(listed).select(F.trim("word").alias("word"), "n").filter("word <> ''")
    return each.groupBy("word").agg(F.sum("n").alias("freq"))


def word_frequency(chunk_tokens: DataFrame, word_rows: DataFrame, tokens: str = "tokens", words: str = "words") -> DataFrame:
    """word, freq: chunks that have the word, plus its occurrences in word rows."""
    counted = chunk_tokens.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return total_frequency(counted, word_rows, words)


def positions(entries: DataFrame, order: list[str], bucket: dict[str, Column] | None = None) -> DataFrame:
    """Add pos, the place of an entry in the order of all parts, from 0, and total, the number of entries.

    ``bucket`` are columns that never fall along the order, such as the book and a range of its entries. Buckets
    are counted, the counts (a row a bucket) are summed up along the order, and entries are numbered in their
    bucket, so that the whole table is never in one task and nothing runs before the plan does."""
    bucket = bucket or {order[0]: F.col(order[0])}
    names = [f"bucket_{k}" for k in range(len(bucket))]
    rows = entries.withColumns(dict(zip(names, bucket.values(), strict=True)))
    counts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("in_bucket"))
    along = Window.orderBy(*names)
    sums = counts.withColumn("before", F.sum("in_bucket").over(along) - F.col("in_bucket")).withColumn("total", F.sum("in_bucket").over(Window.partitionBy()))
    own = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    numbered = rows.withColumn("own", own)
    same = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    joined = numbered.alias("a").join(sums.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}") for c in entries.columns], (F.col("a.own") - 1 + F.col("b.before")).alias("pos"), F.col("b.total").alias("total"))


def between_places(rows: DataFrame, entries: DataFrame, order: list[str], a: Column, b: Column, bucket: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` whose ``order`` lies between the entries at the places ``a`` and ``b`` (from pos and total, in either order).

    Only the two ends are looked up; rows are then compared with them where they are read, without a shuffle."""
    at = positions(entries.select(*order), order, bucket).filter((F.col("pos") == a) | (F.col("pos") == b))
    key = F.struct(*[F.col(c) for c in order])
    ends = at.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    return rows.join(F.broadcast(ends), key.between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def in_range(pos: Column, a: Column, b: Column) -> Column:
    """Between two ends in either order; null ends or positions are outside."""
    return F.coalesce(pos.between(F.least(a, b), F.greatest(a, b)), F.lit(False))


def known_set(rows: DataFrame, items: Column, pos: Column, a: Column, b: Column) -> DataFrame:
    """Distinct items (column item) of the rows within the range; the range is tested before the explode."""
    return rows.filter(in_range(pos, a, b)).select(F.explode(items).alias("item")).filter("item <> ''").distinct()


def _characters(known: list[str], inner: str, mode: str) -> str:
    """A pattern for one character of the marked kind that is known (or, in the other mode, unknown)."""
    one = "".join(f"\\x{{{ord(c):x}}}" for c in sorted({k for k in known if len(k) == 1}))
    if mode == "replace-known":
        return f"(?=[{one}]){inner}" if one else "(?!)"
    return f"(?![{one}]){inner}" if one else inner


def _inner(is_marked: str) -> str:
    return "(?:" + is_marked.removeprefix("^").removesuffix("$") + ")"


def _replacement(template: str) -> str:
    """The template as a replacement of what was matched."""
    quoted = template.replace("\\", "\\\\").replace("$", "\\$")
    return quoted.replace("\\$1", "$0")


def mark_known(text: Column, known: list[str], template: str, mode: str = "replace-known", is_marked: str = r"^\p{IsHan}$") -> Column:
    """Each character of the marked kind that is known (or, in the other mode, unknown) becomes the template: one pass
    of one pattern, whatever the number of known characters."""
    return F.regexp_replace(text, _characters(known, _inner(is_marked), mode), _replacement(template))


def mark_statistics(text: Column, known: list[str], mode: str = "replace-known", is_marked: str = r"^\p{IsHan}$", words: list[str] | None = None) -> Column:
    """(marked, replaced): how many characters are of the marked kind, and how many of these were replaced. Those in a
    matched word all count as replaced in replace-known, and none in replace-unknown."""
    kind = _inner(is_marked)
    hit = _characters(known, kind, mode)
    marked = F.regexp_count(text, F.lit(kind))
    order = longest_first(words or [])
    if not order:
        return F.struct(marked.alias("marked"), F.regexp_count(text, F.lit(hit)).alias("replaced"))
    rest = F.regexp_replace(text, any_word(order), "\u0000")  # what is left between the words, left to right
    own = F.regexp_count(rest, F.lit(hit))
    in_words = marked - F.regexp_count(rest, F.lit(kind)) if mode == "replace-known" else F.lit(0)
    return F.struct(marked.alias("marked"), (own + in_words).alias("replaced"))


def longest_first(words: list[str]) -> list[str]:
    """Words by falling number of graphemes; words as long as each other never match at one place alike."""
    return sorted({w for w in words if w}, key=lambda w: (-_graphemes(w), w))


def _graphemes(word: str) -> int:
    import regex

    return len(word) if word.isascii() and "\r" not in word else len(regex.findall(r"\X", word))


#: Fixed value: how deep the groups of a pattern go before what is left of the words is listed.
DEEPEST = 100


def any_word(words: list[str]) -> str:
    """A pattern that matches, at a place, the word that comes first in ``longest_first``: what words have in common at
    their beginning is tried once, so that the cost of a place does not grow with the number of words."""
    if not words:
        return "(?!)"
    tree: dict = {}
    for w in sorted(set(words), key=lambda w: (_graphemes(w), w)):
        node, length = tree, _graphemes(w)
        for i, c in enumerate(w):
            # A word that begins with another of as many graphemes comes after it, so that it never matches.
            if i and "" in node and node[""] == length:
                break
            node = node.setdefault(c, {})
        else:
            node[""] = length

    def rest(node: dict) -> list[str]:
        out, todo = [], [("", node)]
        while todo:
            head, n = todo.pop()
            out += [head] if "" in n else []
            todo += [(head + c, m) for c, m in n.items() if c]
        return sorted(out, key=lambda w: (-len(w), w))

    def pattern(node: dict, depth: int) -> str:
        if depth > DEEPEST:
            return "(?:" + "|".join(re.escape(w) for w in rest(node)) + ")"
        each, leaves = [], []
        for c, child in sorted((c, m) for c, m in node.items() if c):
            head = re.escape(c)
            while "" not in child and len(child) == 1:
                ((c, child),) = child.items()
                head += re.escape(c)
            if len(child) == 1 and "" in child and len(head.removeprefix("\\")) == 1:
                leaves.append(head)
            else:
                each.append(head if len(child) == 1 and "" in child else head + pattern(child, depth + 1))
        if leaves:
            each.append("[" + "".join(leaves) + "]" if len(leaves) > 1 else leaves[0])
        return "(?:" + "|".join(each) + ")" + ("?" if "" in node else "")

    return pattern(tree, 0)


def mark_words(text: Column, words: list[str], known: list[str], template: str, mode: str = "replace-known", is_marked: str = r"^\p{IsHan}$") -> Column:
    """Longest words first, then single characters; one pass of one pattern (``any_word``).

    A matched word is kept in replace-unknown; in replace-known it becomes the template once, or the
    template of each of its characters where that has ``$1``."""
    order = longest_first(words)
    if not order:
        return mark_known(text, known, template, mode, is_marked)
    listed = any_word(order)
    pattern = f"({listed}|\\X)"
    whole = f"\\A{listed}\\z"
    wanted = F.array(*map(F.lit, sorted(known))) if known else F.array().cast("array<string>")

    def one(t: Column) -> Column:
        if mode == "replace-unknown":
            word = t
        elif "$1" in template:
            word = F.array_join(F.transform(graphemes(t), lambda c: replace_template(template, c)), "")
        else:
            word = F.lit(template)
        hit = F.array_contains(wanted, t) if mode == "replace-known" else ~F.array_contains(wanted, t)
        return F.when(t.rlike(whole), word).when(t.rlike(is_marked) & hit, replace_template(template, t)).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), one), "")


def token_hits(chunks: DataFrame, keys: list[str], tokens: str, needle: str, keep: Column | None = None) -> DataFrame:
    """``keys``, token: distinct tokens of each chunk that contain the needle. Filters come before the explode."""
    rows = chunks if keep is None else chunks.filter(keep)
    rows = rows.filter(F.exists(tokens, lambda t: t.contains(needle)))
    return rows.select(*keys, F.explode(F.array_distinct(F.filter(tokens, lambda t: t.contains(needle)))).alias("token"))


def bucket(pos: Column, end: Column) -> Column:
    """last (the end itself), near (one or two before), other."""
    return F.when(pos == end, "last").when((end - pos).isin(1, 2), "near").otherwise("other")


def by_reading(word: str = "word", collation: str | None = "zh") -> Column:
    """Words in the order of a collation, by default that of Chinese readings."""
    return F.expr(f"{word} COLLATE {collation}") if collation else F.col(word)


def ranked_words(words: DataFrame, freq: DataFrame, part: list[str], collation: str | None = "zh") -> DataFrame:
    """``words`` (part, word) with freq and place: by falling frequency, then by the word. Rows, however many they are."""
    rows = words.join(freq, "word", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    order = Window.partitionBy(*part).orderBy(F.desc("freq"), by_reading("word", collation))
    return rows.withColumn("place", F.row_number().over(order))


def bucket_words(hits: DataFrame, freq: DataFrame, word: str = "token") -> DataFrame:
    """bucket, words: each bucket's distinct words, by falling frequency, then by the word, packed for a screen."""
    rows = hits.select("bucket", F.col(word).alias("word")).distinct().join(freq, "word", "left")
    packed = F.array_sort(F.collect_list(F.struct((-F.coalesce("freq", F.lit(0))).alias("f"), F.col("word"))))
    return rows.groupBy("bucket").agg(F.transform(packed, lambda x: x["word"]).alias("words"))


def by_frequency(words: DataFrame, freq: DataFrame, word: str = "word", collation: str | None = "zh") -> DataFrame:
    """Words by falling frequency, ties in the collation of Chinese readings."""
    return words.join(freq, word, "left").orderBy(F.desc(F.coalesce("freq", F.lit(0))), by_reading(word, collation))


def holders(wanted: DataFrame, rows: DataFrame, item: str, items: str, keep: list[str]) -> DataFrame:
    """item, ``keep``: the rows that hold a wanted item, once each. The wanted ones are few: they go to the rows, so that
    only hits are shuffled."""
    return rows.select(*keep, F.explode(F.array_distinct(F.col(items))).alias(item)).join(wanted.select(item).distinct(), item)


def look_up(wanted: DataFrame, rows: DataFrame, item: str, items: str, keep: list[str]) -> DataFrame:
    """Each wanted item with the rows that hold it (once each); items that nothing holds keep a row of nulls."""
    return wanted.join(holders(wanted, rows, item, items, keep), item, "left").withColumn("found", F.col(keep[0]).isNotNull())
