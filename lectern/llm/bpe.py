"""Byte-level BPE encoding and decoding with DuckDB recursive queries in every partition.

Method: a text is cut by the tokenizer's pattern into words; a task's words that it has not met yet go to
DuckDB as lists of byte tokens. A recursive query unnests the words into token-position rows, joins
neighbouring tokens with the merge table, takes each word's leftmost pair of least rank, contracts it, and
goes on until no word has a pair left. A word of n bytes takes n steps over n rows at worst, so that words of
over LONG bytes contract several places of the least pair in one step: from the left, those that do not overlap,
which are the ones that one step after the other would take, as long as the merged token is ``steady``: it is part
of no token of lesser rank, so that no contraction makes a pair that would come before the others. Of other tokens
the leftmost place alone is contracted, so that the result is the same whatever the vocabulary.
Decoding joins the ids with the vocabulary and aggregates the bytes in order.

The merge table has a row (left, right, merged) for every way to cut a token of the vocabulary into two
tokens of it; a token's id is its rank. It is broadcast: its size is the vocabulary's, not the data's.

Defined results: a null text counts as the empty text, which has no tokens. Every row gives a row, null
and repeated ids are kept. Other columns are never read. An empty table gives no rows. Byte sequences are
decoded as they are; ids outside the vocabulary make ``decode`` fail.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Kept, Recent, by_size, table

LONG = 256
#: Entries of each generation of a worker's cache of words; there are two generations.
CACHE = 400_000
#: Bytes of texts that a worker cuts and encodes together (one text at least).
TOGETHER = 1 << 23

#: Any white space. A lone space between two characters that are no space starts a new segment; no word goes across.
_SPACE = "[ \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_UNUSUAL = f"^ | $|{_SPACE}{_SPACE}"

_STEP = """
WITH RECURSIVE steps(w, step, ids) AS (
  SELECT w, 0, ids FROM words
  UNION ALL
  SELECT s.w, s.step + 1, s.ids[:b.pos - 1] || [b.merged] || s.ids[b.pos + 2:]
  FROM steps s JOIN (
    SELECT w, min(m.merged * 4294967296::BIGINT + p.pos) & 4294967295 AS pos, CAST(min(m.merged * 4294967296::BIGINT + p.pos) >> 32 AS INTEGER) AS merged
    FROM (SELECT w, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, unnest(range(1, len(ids))) AS pos FROM steps) p
    JOIN merges m ON m.l = p.l AND m.r = p.r GROUP BY w
  ) b ON s.w = b.w
)
SELECT w, arg_max(ids, step) AS ids FROM steps GROUP BY w
"""

_STEP_LONG = """
WITH RECURSIVE steps(w, step, ids) AS (
  SELECT w, 0, ids FROM words
  UNION ALL
  (WITH p AS (SELECT w, step, unnest(ids) AS l, unnest(ids[2:] || [NULL]) AS r, unnest(range(1, len(ids) + 1)) AS pos FROM steps),
  j AS (SELECT p.w, p.pos, m.merged, m.steady, min(m.merged) OVER (PARTITION BY p.w) AS least FROM p JOIN merges m ON m.l = p.l AND m.r = p.r),
  f AS (SELECT w, pos, merged, steady, row_number() OVER (PARTITION BY w ORDER BY pos) AS number FROM j WHERE merged = least),
  k AS (SELECT w, pos, merged FROM f QUALIFY number = 1 OR steady AND row_number() OVER (PARTITION BY w, pos - number ORDER BY pos) % 2 = 1)
  SELECT p.w, any_value(p.step) + 1, list(coalesce(k.merged, p.l) ORDER BY p.pos)
  FROM p LEFT JOIN k ON p.w = k.w AND p.pos = k.pos LEFT JOIN k AS before ON p.w = before.w AND p.pos = before.pos + 1
  WHERE before.w IS NULL AND p.w IN (SELECT w FROM k) GROUP BY p.w)
)
SELECT w, arg_max(ids, step) AS ids FROM steps GROUP BY w
"""

_DECODE = """
SELECT w, array_to_string(ids, ',') AS csv, back FROM encoded JOIN (
  SELECT w, unhex(string_agg(v.hex, '' ORDER BY pos)) AS back
  FROM (SELECT w, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM encoded) e JOIN vocabulary v USING (id) GROUP BY w
) USING (w) ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a .tiktoken file: bytes -> rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Coder:
    """One worker's DuckDB connection with the merge table, and its caches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        rows = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = (pa.array(x, pa.int32()) for x in zip(*rows, strict=True))
        early = {part for *parts, r in rows for part in parts if r < part}
        steady = pa.array([r not in early for *_, r in rows])
        given = pa.table({"l": left, "r": right, "merged": merged, "steady": steady})  # noqa: F841  DuckDB reads it by name
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        named = pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM named")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        #: Of each word: its ids as decimals, each with a comma behind it, and the bytes they decode to.
        self.words = Recent(CACHE)

    def solved(self, query: str, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Of each word: its ids, found by the recursive query, as decimals; and the bytes they decode to."""
        offsets = np.zeros(len(words) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, words), np.int32, len(words)), out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.single[np.frombuffer(b"".join(words), np.uint8)]))
        self.db.register("words", pa.table({"w": pa.array(np.arange(len(words), dtype=np.int32)), "ids": ids}))
        self.db.register("encoded", self.db.sql(query).to_arrow_table())
        found = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("words")
        self.db.unregister("encoded")
        return list(zip(found.column("csv").cast(pa.binary()).to_pylist(), found.column("back").to_pylist(), strict=True))

    def learn(self, words: set[str]) -> None:
        """Put words that have not been met yet into the cache."""
        coded = [(w, w.encode()) for w in self.words.missing(words)]
        for query, some in ((_STEP, [x for x in coded if len(x[1]) <= LONG]), (_STEP_LONG, [x for x in coded if len(x[1]) > LONG])):
            for at in range(0, len(some), 65_536):
                part = some[at : at + 65_536]
                self.words.update(zip([x[0] for x in part], [(ids + b",", back) for ids, back in self.solved(query, [x[1] for x in part])], strict=True))

    def segments(self, usual: list[str], whole: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all segments, a space before each of the usual ones, and where segments begin, with the end as the last."""
        words = self.find("".join([" " + s for s in usual]))
        places = pa.array(words, pa.string())
        begins = np.flatnonzero(pc.starts_with(places, " ").to_numpy(zero_copy_only=False))
        # Words that leave nothing out and begin where segments do, as the public pattern's.
        at = np.concatenate([[0], np.cumsum(pc.utf8_length(places).to_numpy())])
        if not np.array_equal(at[begins], np.cumsum([0, *(len(s) + 1 for s in usual)])[:-1]):
            cut = [self.find(" " + s) for s in usual]
            words = [w for x in cut for w in x]
            begins = np.cumsum([0, *map(len, cut)])[:-1]
        rest = list(map(self.find, whole))
        ends = len(words) + np.cumsum([0, *map(len, rest)])
        words += [w for x in rest for w in x]
        return words, np.concatenate([begins, ends]).astype(np.int64)

    def documents(self, texts: list[str] | pa.Array) -> list[tuple[int, bytes, bytes]]:
        """Per text: number of ids, decimal ids joined by commas, decoded bytes. Equal segments of the texts are cut and looked up once."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        unusual = pc.match_substring_regex(column, _UNUSUAL)
        lists = pc.split_pattern(pc.if_else(unusual, "", column), " ")
        flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        first = np.zeros(len(flat), bool)
        first[at[:-1]] = True
        coded = flat.filter(pa.array(~first)).dictionary_encode()
        # The first segment has no space before it; an unusual text is one segment.
        alone = pc.if_else(unusual, column, flat.take(pa.array(at[:-1])))
        words, begins = self.segments(coded.dictionary.to_pylist(), alone.to_pylist())
        which = np.empty(len(flat), np.int64)
        which[~first] = coded.indices.to_numpy()
        which[first] = len(coded.dictionary) + np.arange(len(column))
        known = pa.array(words, pa.string()).dictionary_encode()
        distinct = known.dictionary.to_pylist()
        self.learn(set(distinct))
        found = list(map(self.words.__getitem__, distinct))
        ids, back = (_joined(_joined([f[k] for f in found], known.indices, begins), which, at) for k in (0, 1))
        return [(i.count(b","), i[:-1], b) for i, b in zip(ids.to_pylist(), back.to_pylist(), strict=True)]


def _joined(some: list[bytes] | pa.LargeBinaryArray, which: pa.Array | np.ndarray, edges: np.ndarray) -> pa.LargeBinaryArray:
    """What the places ``which`` name, one after the other, as one value from each edge to the next."""
    taken = (pa.array(some, pa.large_binary()) if isinstance(some, list) else some).take(pa.array(which))
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[edges])), data or pa.py_buffer(b"")])


def coder(ranks: dict[bytes, int], pattern: str) -> Coder:
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    return Kept.get("bpe", key, lambda: Coder(ranks, pattern))  # type: ignore[return-value]


FIELDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text; ``with_ids`` adds the ids and the decoded text's bytes."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    fields = pa.schema([*FIELDS, ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]) if with_ids else FIELDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(*shared.value)
        for batch in batches:
            for some in by_size(batch, 1, TOGETHER):
                done = own.documents(some.column(1))
                columns = {"doc_id": some.column(0), "n_tokens": [d[0] for d in done], "ids_sha256": [hashlib.sha256(d[1]).hexdigest() for d in done], "decoded_sha256": [hashlib.sha256(d[2]).hexdigest() for d in done]}
                if with_ids:
                    columns |= {"ids": [[int(x) for x in d[1].split(b",")] if d[1] else [] for d in done], "decoded": [d[2] for d in done]}
                yield table(columns, fields)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def public_vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_vocabulary())
