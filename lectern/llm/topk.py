"""Exact top-k inner-product search by Fagin's threshold algorithm.

Method: the vectors lie in blocks of BLOCK rows; each block keeps one sorted list per dimension. For a
query, sorted access goes down all lists in step, from the large end where the query's component is
positive and from the small end where it is negative; every vector met is scored by random access. The
bound is the score of a vector that had the component at the present depth of every list; a block is left
when that bound is below the kth score so far, or when all its rows were met. Ties need the strict
comparison: a vector that only equals the kth score may have the smaller id.

The kth score so far is known before any block is opened: SEEDS vectors (those of the least hash of their id, a
documented bound) are scored against each query first, and their kth score, the query's floor, goes along to all
blocks. A floor is only ever too low, so that results are exact whatever the seeds.

How soon a block is left depends on the data: where components are independent and dimensions many, a vector of
average score is met in some list long before the bound falls, and nearly all rows are scored, even with the true
kth score for a floor. ``with_scored`` reports how many were.

Queries lie in blocks too, and each pair of a block of vectors and a block of queries is one row of work
(the stated query set against all rows, in blocks). The lists of a block are sorted once for the blocks of queries
that follow each other in a task. Per-query results are cut to k in every task before they are shuffled.

Components become floor(1024 * x), x as double. Scores are exact: in float64 while every partial sum stays
below 2**53, else in Python integers; a score outside the range of a long is an error.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, neither do
rows without an id; vectors of different lengths never meet; repeated rows are candidates of their own,
but none of the query's own id is one. Two different vectors of one id are one query (of the lesser vector) and two
candidates. Very long vectors are rows like any other. Other columns are never read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import table

SCALE, K = 1024, 10
BLOCK, QUERIES, SEEDS = 8192, 512, 4096
FIRST_DEPTH, GROWTH = 16, 2

_BLOCKS = pa.schema([("dims", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("scored", pa.int64())])
_FLOORS = pa.schema([("dims", pa.int32()), ("q_n", pa.int32()), ("q_ids", pa.binary()), ("q_vectors", pa.binary()), ("floors", pa.binary())])


def _packer(size: int):
    """Rows to blocks of up to ``size`` rows, one kind for each vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dims: int, rows: list) -> pa.RecordBatch:
            ids = np.array([i for i, _ in rows], "<i8").tobytes()
            vectors = np.floor(SCALE * np.array([v for _, v in rows], "<f8").reshape(len(rows), dims)).astype("<f8").tobytes()
            return table({"dims": [dims], "n": [len(rows)], "ids": [ids], "vectors": [vectors]}, _BLOCKS)

        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), 0
            for i, n in zip(ids, lists.value_lengths().to_pylist(), strict=True):
                held.setdefault(n, []).append((i, flat[at : at + n]))
                at += n
                if len(held[n]) == size:
                    yield block(n, held.pop(n))
        for n, rows in held.items():
            yield block(n, rows)

    return run


class Lists:
    """A block of vectors with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")  # so that a stable choice prefers the smaller id
        self.ids, self.vectors = ids[by_id], np.ascontiguousarray(vectors[by_id])
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)
        self.largest = float(np.abs(self.vectors).max(initial=0.0))


def scores(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return vectors @ query
    q = [int(x) for x in query]
    return np.array([sum(int(x) * y for x, y in zip(v, q, strict=True)) for v in vectors], dtype=object)


def best(ids: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(found) > 4 * k and found.dtype != object:
        kth = np.partition(found, len(found) - k)[len(found) - k]
        keep = found >= kth
        ids, found = ids[keep], found[keep]
    order = sorted(range(len(found)), key=lambda r: (-found[r], ids[r]))[:k]
    return ids[order], found[order]


def exactly(largest: float, query: np.ndarray) -> bool:
    """Whether every partial sum of an inner product stays exact in float64."""
    return largest * float(np.abs(query).max(initial=0.0)) * max(len(query), 1) < 2.0**53


def threshold(lists: Lists, query_id: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """Fagin's threshold algorithm over one block: ids and scores of its k best that reach ``floor``, and how many
    rows were scored."""
    n, dims = lists.vectors.shape
    up, used = query > 0, query != 0
    exact = exactly(lists.largest, query)
    met = np.zeros(n, bool)
    ids, found = np.zeros(0, np.int64), np.zeros(0)
    depth, before = FIRST_DEPTH, 0
    own = lists.ids == query_id
    while before < n:
        depth = min(depth, n)
        now = np.zeros(n, bool)
        if depth == n:
            now[:] = True
        else:
            now[lists.order[n - depth : n - before, up & used].ravel()] = True
            now[lists.order[before:depth, ~up & used].ravel()] = True
            if not used.any():  # every list is as good as any other
                now[before:depth] = True
        new = np.flatnonzero(now & ~met)
        met |= now
        rows = new[~own[new]]
        s = scores(lists.vectors[rows], query, exact)
        ids, found = best(np.concatenate([ids, lists.ids[rows]]), np.concatenate([found, s]), k)
        if depth == n or met.all():
            break
        edge = np.where(up, lists.sorted[n - depth], lists.sorted[depth - 1])
        bound = float(edge @ query) if exact else sum(int(x) * int(y) for x, y in zip(edge, query, strict=True))
        if bound < floor or len(found) == k and bound < found[-1]:
            break
        before, depth = depth, depth * GROWTH
    high = np.array([x >= floor for x in found], bool)
    return ids[high], found[high], int(met.sum())


def _block(row: dict, ids: str = "ids", vectors: str = "vectors") -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(row[ids], "<i8")
    return own, np.frombuffer(row[vectors], "<f8").reshape(len(own), row["dims"])


def _floors(k: int):
    """Each query's kth score among the seeds of its length; minus infinity where these are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, queries = _block(row, "q_ids", "q_vectors")
                floors = np.full(len(q_ids), -np.inf)
                if row["ids"] is not None:
                    ids, vectors = _block(row)
                    for j, (i, q) in enumerate(zip(q_ids, queries, strict=True)):
                        if exactly(float(np.abs(vectors).max(initial=0.0)), q):  # else the floor would not be exact
                            s = (vectors @ q)[ids != i]
                            floors[j] = np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else -np.inf
                yield table({c: [row[c]] for c in _FLOORS.names[:-1]} | {"floors": [floors.astype("<f8").tobytes()]}, _FLOORS)

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, Lists] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if last is None or last[0] != row["ids"]:
                    last = (row["ids"], Lists(*_block(row)))
                q_ids, queries = _block(row, "q_ids", "q_vectors")
                out: tuple[list, list, list, list] = ([], [], [], [])
                for q_id, q, floor in zip(q_ids, queries, np.frombuffer(row["floors"], "<f8"), strict=True):
                    ids, found, scored = threshold(last[1], int(q_id), q, k, float(floor))
                    # A row without an id says how many were scored where no vector reaches the floor.
                    out[0].extend([int(q_id)] * (len(ids) + 1))
                    out[1].extend([None, *map(int, ids)])
                    out[2].extend([None, *map(int, found)])
                    out[3].extend([scored] + [0] * len(ids))
                yield table(dict(zip(_HITS.names, out, strict=True)), _HITS)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", with_scored: bool = False) -> DataFrame:
    """Each query's k best among ``vectors``, itself (its id) excepted: query_id, rank, vec_id, score.

    ``with_scored`` gives a row a query instead: query_id, scored (how many vectors were scored for it)."""

    def clean(df: DataFrame) -> DataFrame:
        x = F.col(vector_col).cast("array<double>")
        bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return df.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)

    schema = "dims int, n int, ids binary, vectors binary"
    rows = clean(vectors)
    q = clean(queries).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(_packer(QUERIES), schema)
    q = q.select("dims", *(F.col(c).alias(f"q_{c}") for c in ("n", "ids", "vectors")))
    # One block of at most SEEDS vectors for each length among the seeds: proven small.
    seeds = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SEEDS).coalesce(1).mapInArrow(_packer(SEEDS), schema)
    q = q.join(F.broadcast(seeds), "dims", "left").mapInArrow(_floors(k), "dims int, q_n int, q_ids binary, q_vectors binary, floors binary")
    blocks = rows.mapInArrow(_packer(BLOCK), schema)
    # Work is dealt out by a salt: each share of the blocks meets all blocks of queries.
    shares = max(8, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = blocks.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)))
    q = q.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<long>")))
    hits = blocks.join(q.hint("shuffle_hash"), ["dims", "share"]).mapInArrow(_search(k), "query_id long, vec_id long, score long, scored long")
    if with_scored:
        return hits.groupBy("query_id").agg(F.sum("scored").alias("scored"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.filter("vec_id is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.filter("vec_id % 100 = 0"))


SQL_OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND NOT list_has_any(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), [true])
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
