"""Quartile bucket digests of whole documents.

Method: byte triplets of a sliding five-byte window are hashed into 256 buckets and counted; the digest
holds, for each bucket, which quartile of all bucket counts its count lies in (two bits), and in a header
the length on a logarithmic scale, two ratios of the quartiles and a check byte. Two digests are compared
by a bounded difference score, the likeness is 1 - score / bound.

Neighbours in ascending id order meet in one range shuffle of the texts. Only the first and last row of
each range go through a second, small step (two rows a partition).

Defined results: a null text counts as the empty text, which has a digest of its own (all buckets 0);
texts under three bytes have no triplets and differ by length and check byte only. Rows with equal ids
follow each other in the order of their text; null ids come last. A table of one row is its own
neighbour. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise, table

BUCKETS = 256
#: Offsets of the triplets in the five-byte window, and odd multipliers for the three bytes and the result.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
FACTORS = ((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), (0x27D4EB2F, 0x165667B1, 0xD3A2646D), (0xFD7046C5, 0xB55A4F09, 0x2C1B3C6D))
#: The difference score is cut off here: about what unrelated texts reach.
BOUND = 480


def digest(data: bytes) -> str:
    """The digest of a text's bytes: 8 hex digits of header, 128 of bucket codes."""
    n = len(data)
    counts = np.zeros(BUCKETS, np.int64)
    if n >= 3:
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        for (i, j, k), (x, y, z) in zip(TRIPLETS, FACTORS, strict=True):
            if n > k:
                m = n - k
                h = b[i : i + m] * np.uint32(x) + b[j : j + m] * np.uint32(y) + b[k : k + m] * np.uint32(z)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2545F491)
                counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    order = np.sort(counts)
    q1, q2, q3 = order[BUCKETS // 4 - 1], order[BUCKETS // 2 - 1], order[3 * BUCKETS // 4 - 1]
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8)
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    length = 0 if not n else min(255, 1 + int(8 * np.log2(n)))
    ratio = 0 if not q3 else int(q1 * 15 // q3) << 4 | int(q2 * 15 // q3)
    check = zlib.crc32(data)
    return bytes([length, ratio, check & 255, check >> 8 & 255]).hex() + packed.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """The bounded difference score of two digests, 0 (equal) to BOUND."""
    if a == b:
        return 0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8).astype(np.int64), np.frombuffer(bytes.fromhex(b), np.uint8).astype(np.int64)
    off = abs(int(x[0] - y[0]))
    score = off if off <= 2 else 6 * off
    for shift in (0, 4):
        r = abs(int(x[1] >> shift & 15) - int(y[1] >> shift & 15))
        score += r if r <= 1 else 4 * r
    score += int((x[2:4] != y[2:4]).any())
    for shift in (0, 2, 4, 6):
        d = np.abs((x[4:] >> shift & 3) - (y[4:] >> shift & 3))
        score += int(d.sum()) + 3 * int((d == 3).sum())  # opposite quartiles count double
    return min(score, BOUND)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
OUTPUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGES = pa.schema([*FIELDS, ("edge", pa.string()), ("part", pa.int64()), ("text", pa.string())])


def _row(doc_id: int | None, text: str, mark: str, following: str, following_mark: str) -> tuple:
    changed = edited(text, following).encode()
    changed_mark = digest(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), mark, changed_mark, likeness(mark, changed_mark), likeness(mark, following_mark)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows in order: each but the last with its successor; the first and the last text as edges."""
    part, last, none = TaskContext.get().partitionId(), None, (None,) * 7
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            mark = digest(text.encode())
            if last is None:
                rows.append((doc_id, *none[1:], "first", part, text))
            else:
                rows.append((*_row(*last, text, mark), None, None, None))
            last = (doc_id, text, mark)
        if rows:
            yield table(dict(zip(_EDGES.names, zip(*rows, strict=True), strict=True)), _EDGES)
    if last is not None:
        yield table(dict(zip(_EDGES.names, ([x] for x in (last[0], *none[1:], "last", part, last[1])), strict=True)), _EDGES)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(i, t, digest(t.encode()), u, digest(u.encode())) for i, t, u in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
        yield table(dict(zip(FIELDS.names, zip(*rows, strict=True) if rows else [[]] * 7, strict=True)), FIELDS)


def fingerprint_with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A digest of each whole text, one of its edited text, and the likeness to that and to the next document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = F.col("doc_id").asc_nulls_last()
    dealt = rows.repartitionByRange(key).sortWithinPartitions(key, F.col("text").asc_nulls_first())
    done = materialise(dealt.mapInArrow(_along, OUTPUT + ", edge string, part long, text string"), "fingerprints")
    # Two rows a partition remain: the last text of each meets the first of the next that has rows.
    parts = sorted(r[0] for r in done.filter("edge = 'first'").select("part").collect())
    following = spark.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part long, next long")
    last = done.filter("edge = 'last'").select("doc_id", F.col("text").alias("a"), "part")
    first = done.filter("edge = 'first'").select(F.col("text").alias("b"), F.col("part").alias("next"))
    edges = last.join(following, "part").join(first, "next").select("doc_id", "a", "b").mapInArrow(_across, OUTPUT)
    return done.filter("edge is null").select(*FIELDS.names).unionByName(edges)


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
