"""Removal of repeated passages by fixed-block anchors.

A window of WINDOW = 35 words is repeated when its word sequence also starts anywhere else, in the same or
another document. Every word that a repeated window covers is removed.

1. Anchors. Non-overlapping reference blocks of BLOCK = 18 words (at word 0, 18, 36, ...) of every document
   are indexed and probed with every rolling window of 18 words of every document. A window of 35 words
   always holds a whole reference block, and where the window is repeated, that block's words come again.
   Index and probes are dealt out by ranges of their hash and matched there; a hit is a block that comes
   anywhere else. Hits are kept as a bitmap of bounded size (a false bit costs work, not results).
2. Extension. Each hit is extended to the left and right, over all windows of 35 words around it; these windows
   are dealt out and counted, and those that come twice or more may be repeats (again a bounded bitmap).
   A hit is not extended against each other place of its block by itself: a passage of k copies has k * k such
   pairs. Windows, which all copies share, say the same with k rows.
3. Maximal repeats. The windows that are left are grouped by 128 bits of hash over all documents, and joined
   back to their documents where they come twice or more, which is exact whatever the bitmaps let through.
   Consecutive ones merge to maximal repeats, and what they cover goes.

All counts are over all documents. Nothing is collected per hash: a hash that is everywhere is summed per
task first, and the join back is an inner join that splits skewed keys.

Defined results: words are runs without the six ASCII white-space bytes, unchanged; a null text has none;
texts under 35 words keep all their words; repeated rows (also with equal ids) are documents of their own,
so that all words of an exact copy of 35 words or more go. Every row gives a row; null ids are kept. Other
columns are never read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Dealer, bits_for, discard, gather, gathered, grouped, leading, map_arrow, materialise, parts_for, pieces, rolling, slice_of, table, texts, whole, word_hashes

WINDOW, BLOCK = 35, 18


def anchors(docs: DataFrame, window: int, block: int, bits: int) -> np.ndarray:
    """The bitmap of reference blocks that come anywhere else."""
    parts = parts_for(docs, bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(parts)
        for batch in pieces(batches):
            for group in grouped(texts(batch.column(0))):
                words, edges = word_hashes(group)
                probes, kind = rolling(words, block), np.full(max(0, len(words) - block + 1), 2, np.int8)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if b - a >= window:
                        kind[a : b - block + 1] = 0
                        kind[a : b - block + 1 : block] = 1
                dealer.add(probes[kind == 1], 1)
                if dealer.add(probes[kind == 0], 0):
                    yield from dealer.rows()
        yield from dealer.rows()

    def match(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        hashes, times, indexed = gathered(group)
        return pa.table({"part": pa.array([part], pa.int32()), "hits": pa.array([slice_of(hashes[indexed & (times > 1)], part, parts, bits)], pa.binary())})

    rows = gather(docs.select("text").mapInArrow(deal, Dealer.SCHEMA).groupBy("part").applyInArrow(match, "part int, hits binary"))
    return whole({r["part"]: bytes(r["hits"]) for r in rows}, parts, bits)


class Around:
    """The windows around hits, group of texts by group of texts."""

    def __init__(self, hits: np.ndarray, bits: int, window: int, block: int) -> None:
        self.hits, self.bits, self.window, self.block = hits, bits, window, block

    def of(self, group: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text with any: its number, starts in the text, their hashes, and its words' hashes."""
        words, edges = word_hashes(group)
        blocks, windows = rolling(words, self.block), None
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            n = b - a - self.window + 1
            if n <= 0:
                continue
            live = leading(self.hits, blocks[a : b - self.block + 1 : self.block], self.bits)
            if not live.any():
                continue
            at = np.flatnonzero(np.repeat(live, self.block)[self.block - 1 :][:n])  # by a window's first whole block
            if len(at):
                windows = rolling(words, self.window, 1) if windows is None else windows
                yield k, at, windows[a + at], words[a:b]


def repeats(docs: DataFrame, hits: np.ndarray, window: int, block: int, bits: int) -> np.ndarray:
    """The bitmap of the windows around hits that come twice or more."""
    parts = parts_for(docs, bits)
    shared = docs.sparkSession.sparkContext.broadcast(hits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, around = Dealer(parts), Around(shared.value, bits, window, block)
        for batch in pieces(batches):
            for group in grouped(texts(batch.column(0))):
                for _, _, found, _ in around.of(group):
                    if dealer.add(found):
                        yield from dealer.rows()
        yield from dealer.rows()

    def count(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        hashes, times, _ = gathered(group)
        return pa.table({"part": pa.array([part], pa.int32()), "again": pa.array([slice_of(hashes[times > 1], part, parts, bits)], pa.binary())})

    rows = gather(docs.select("text").mapInArrow(deal, Dealer.SCHEMA).groupBy("part").applyInArrow(count, "part int, again binary"))
    return whole({r["part"]: bytes(r["again"]) for r in rows}, parts, bits)


_PLACES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32()), ("at", pa.int32())])


def places(docs: DataFrame, hits: np.ndarray, again: np.ndarray, window: int, block: int, bits: int) -> DataFrame:
    """Where windows that may be repeated start: two hashes, key of the text, place.

    Equal texts have equal places: a task gives those of a text twice at most, which is enough to see that they
    come again."""
    shared = docs.sparkSession.sparkContext.broadcast((hits, again))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[int, int], int] = {}  # emptied when large
        around = Around(shared.value[0], bits, window, block)
        for batch in pieces(batches):
            keys, data, fresh = [], [], zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for key, text in zip(fresh, texts(batch.column(0)), strict=True):
                if done.get(key, 0) < 2:
                    if len(done) > 200_000:
                        done.clear()
                    done[key] = done.get(key, 0) + 1
                    keys.append(key)
                    data.append(text)
            first = 0
            for group in grouped(data):
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for k, at, h, words in around.of(group):
                    some = leading(shared.value[1], h, bits)
                    if not some.any():
                        continue
                    key, at, n = keys[first + k], at[some], int(some.sum())
                    other = rolling(words, window, 2)[at]
                    for column, x in zip(out, (h[some].view(np.int64), other.view(np.int64), np.full(n, key[0], np.int64), np.full(n, key[1], np.int32), at.astype(np.int32)), strict=True):
                        column.append(x)
                first += len(group)
                if out[0]:
                    yield table(dict(zip(_PLACES.names, map(np.concatenate, out), strict=True)), _PLACES)

    return docs.select("text", "k1", "k2").mapInArrow(run, "h1 long, h2 long, k1 long, k2 int, at int")


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the places."""
    edges = np.zeros(n + 1, np.int64)
    starts = np.unique(starts)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + window, n), -1)
    return np.cumsum(edges)[:n] > 0


def with_repeats(docs: DataFrame, window: int = WINDOW, bits: int | None = None) -> DataFrame:
    """``docs`` (with a column text) and, in a column starts, where the repeated windows of each text start."""
    block = (window + 1) // 2
    keyed = docs.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.hash("text"))
    bits = bits or bits_for(docs)
    hits = anchors(keyed, window, block, bits)
    found = materialise(places(keyed, hits, repeats(keyed, hits, window, block, bits), window, block, bits), "places")
    # Written by itself, so that what is shuffled for the counts is gone before the join.
    several = materialise(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "several")
    exact = found.join(several, ["h1", "h2"])
    starts = materialise(exact.groupBy("k1", "k2").agg(F.collect_set("at").alias("starts")), "starts")
    discard(found, several)
    return keyed.join(starts, ["k1", "k2"], "left").drop("k1", "k2")


def _removal(window: int, make: Callable[[bytes, list[bytes], np.ndarray], dict[str, object]], names: list[str], fields: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = texts(batch.column("text"))
            rows = []
            for t, starts in zip(text, batch.column("starts"), strict=True):
                words = t.split()
                gone = covered(len(words), starts.values.to_numpy() if starts.is_valid else np.zeros(0, np.int64), window)
                rows.append(make(t, words, gone))
            columns = {n: batch.column(n) for n in names} | {n: [r[n] for r in rows] for n in (rows[0] if rows else {}) if n in fields.names}
            if rows:
                yield table(columns, fields)

    return run


def removal_counts(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def make(_: bytes, words: list[bytes], gone: np.ndarray) -> dict[str, object]:
        kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
        return {"n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}

    rows = with_repeats(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), window)
    return map_arrow(rows, _removal(window, make, ["doc_id"], fields), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9_substring(spark, sf_dir: str) -> DataFrame:
    return removal_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL_OP9 = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35
), g AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM s
), d AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1
), c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM g JOIN d USING (h)
), n AS (SELECT r, list(k) AS gone FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, k: NOT list_contains(coalesce(gone, []), k)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN n USING (r)
"""
