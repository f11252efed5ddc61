"""What the operators of this subpackage share: hashing of words, a shared folder, bounded filters."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode alone a local one if unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions within go when these end: their results are on the driver or written."""
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def gather(df: DataFrame) -> list:
    """``collect`` of a bounded result; what was shuffled for it goes (which is settled when a frame is made)."""
    with releasing(df.sparkSession):
        return df.select("*").collect()


def number(df: DataFrame) -> int:
    return gather(df.agg(F.count(F.lit(1))))[0][0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    The folder goes with ``discard``, else when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}/{name}"
    with releasing(spark):
        df.write.parquet(path)
    folder, files = _folder(spark, path.rpartition("/")[0])
    files.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path  # type: ignore[attr-defined]
    return out


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*written: DataFrame | None) -> None:
    """Delete the files of what ``materialise`` returned and nothing reads any more."""
    for df in written:
        if df is not None:
            folder, files = _folder(df.sparkSession, df.written_to.rpartition("/")[0])  # type: ignore[attr-defined]
            files.delete(folder, True)


class Kept:
    """What a Python worker keeps for the next task: things of one operator at a time.

    A worker outlives its tasks and serves all operators of a session. Taking a thing under another owner lets
    go of all that was kept before, and gives the freed memory back to the system."""

    owner, things = "", {}  # type: ignore[var-annotated]

    @classmethod
    def get(cls, owner: str, key: object, make: Callable[[], object]):
        if cls.owner != owner:
            cls.release()
            cls.owner = owner
        if key not in cls.things:
            cls.things = {}  # one vocabulary or tokenizer is enough
            cls.things[key] = make()
        return cls.things[key]

    @classmethod
    def release(cls) -> None:
        if cls.things:
            cls.owner, cls.things = "", {}
            trim()


class Recent(dict):
    """The entries of this generation; those of the one before are taken over when they are met again."""

    def __init__(self, most: int) -> None:
        self.most, self.before = most, {}

    def missing(self, keys: set[str]) -> set[str]:
        """Which of the keys are in neither generation; the others are in this one from now on."""
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()
        new = keys.difference(self)
        old = new.intersection(self.before)
        self.update(zip(old, map(self.before.__getitem__, old), strict=True))
        return new - old


def trim() -> None:
    """Give free memory of this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


#: Rows that a worker turns into Python objects at once.
AT_ONCE = 512


def pieces(batches: Iterator[pa.RecordBatch], rows: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that what is made of them stays small."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)
    pa.default_memory_pool().release_unused()


def by_size(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of a column of texts."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(lambda batches: fn(pieces(batches)), schema)


def table(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from numpy arrays or lists, in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


#: Bytes of texts whose words are hashed at once.
BYTES_AT_ONCE = 1 << 18


def grouped(some: list[bytes], most: int = BYTES_AT_ONCE) -> Iterator[list[bytes]]:
    """The texts in groups of about ``most`` bytes."""
    group: list[bytes] = []
    held = 0
    for text in some:
        group.append(text)
        held += len(text)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def word_hashes(some: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """A 64-bit hash of every word (runs without the six ASCII white-space bytes) of the texts, one text after the
    other, and the places where texts begin, with the end as the last."""
    words = [t.split() for t in some]
    edges = [0, *accumulate(map(len, words))]
    flat = words[0] if len(words) == 1 else [w for x in words for w in x]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat)), edges


def rolling(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes; empty if there are fewer words.

    Runs of twice the length are hashed from two runs of the length before, so that no sum or product of word
    hashes can cancel out. Another salt gives an independent hash of the same words."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    add = U64((1 + salt) * int(_ODD) % (1 << 64))
    runs, have = words, 1
    while have < width:
        step = min(have, width - have)
        runs = mix(runs[: len(runs) - step] * _M2 + (runs[step:] ^ add))
        have += step
    return mix(runs + U64((width + 1000 * salt) * int(_ODD) % (1 << 64)))


#: Bits of the largest bitmap that is broadcast (64 MB): its size is bounded whatever the data.
MOST_BITS = 29


def bits_for(df: DataFrame, least: int = 22) -> int:
    """The size of a bitmap of hashes, in powers of two: a bit for every eight bytes of input, MOST_BITS at most.

    A fuller bitmap lets more through to the exact step that follows; it never changes a result."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = min(size, split * df.rdd.getNumPartitions())  # the former is unknown for what is no file
    return max(least, min(MOST_BITS, round(math.log2(max(size, 1))) - 3))


def parts_for(df: DataFrame, bits: int, per_input: int = 4, least: int = 16) -> int:
    """A power of two in proportion to the number of input partitions; each part has whole bytes of a bitmap."""
    wanted = max(least, per_input * df.rdd.getNumPartitions())
    return min(1 << (bits - 3), 1 << (wanted - 1).bit_length())


def bitmap(df: DataFrame, long_col: str, bits: int) -> np.ndarray:
    """A bounded filter: the bits ``pmod(value, 2**bits)`` of a column of hashes, as 2**(bits-3) bytes.

    Its size does not depend on the data. A set bit may stand for several values, so that
    it only ever lets more through."""
    cell = F.pmod(F.col(long_col), F.lit(1 << bits))
    rows = df.select(cell.alias("cell")).groupBy(F.expr("bitmap_bucket_number(cell)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("m"))
    out = np.zeros(max(1 << (bits - 3), 4096) + 4096, np.uint8)
    for b, m in gather(rows):  # bucket 1 holds values 1..32768, and bucket 0 holds 0
        at = (int(b) - 1) * 4096
        if at < 0:
            at = len(out) - 4096
        out[at : at + len(m)] |= np.frombuffer(bytes(m), np.uint8)
    return out


def in_bitmap(bitmap_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    cell = (hashes & U64((1 << bits) - 1)).astype(np.int64)
    at = np.where(cell == 0, len(bitmap_) - 4096, (cell - 1) >> 3)
    bit = np.where(cell == 0, 0, (cell - 1) & 7)
    return (bitmap_[at] >> bit.astype(np.uint8)) & 1 > 0


#: Hashes that a task gathers before it sends them off, sorted and with repeats counted.
FLUSH = 2_000_000


class Dealer:
    """Deals hashes out by their leading bits, ``flags`` telling two kinds of them apart.

    Repeats within a task's gathering are summed first, so that a hash that is everywhere comes at most
    once from each: no part grows with the frequency of one hash. A row is (part, once0, once1, more0,
    more1, counts0, counts1): sorted hashes of the two kinds met once, more often, and how often."""

    SCHEMA = "part int, once0 binary, once1 binary, more0 binary, more1 binary, counts0 binary, counts1 binary"
    FIELDS = pa.schema([("part", pa.int32()), *((f"{k}{j}", pa.binary()) for k in ("once", "more", "counts") for j in (0, 1))])

    def __init__(self, parts: int) -> None:
        self.shift, self.held, self.n = U64(64 - (parts.bit_length() - 1)), ([], []), 0

    def add(self, hashes: np.ndarray, kind: int = 0) -> bool:
        self.held[kind].append(hashes)
        self.n += len(hashes)
        return self.n >= FLUSH

    def rows(self) -> Iterator[pa.RecordBatch]:
        cut: dict[int, dict[str, bytes]] = {}
        for kind in (0, 1):
            if not self.held[kind]:
                continue
            all_ = np.sort(np.concatenate(self.held[kind]))
            self.held[kind].clear()
            first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]])) if len(all_) else np.zeros(0, np.int64)
            times, hashes = np.diff(np.append(first, len(all_))), all_[first]
            for name, some in (("once", times == 1), ("more", times > 1)):
                h, t = hashes[some], np.minimum(times[some], (1 << 32) - 1).astype("<u4")
                part = (h >> self.shift).astype(np.int64)
                edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    row = cut.setdefault(int(part[a]), {})
                    row[f"{name}{kind}"] = h[a:b].tobytes()
                    if name == "more":
                        row[f"counts{kind}"] = t[a:b].tobytes()
        self.n = 0
        names = self.FIELDS.names[1:]
        parts = list(cut)
        for k in range(0, len(parts), 1024):
            some = parts[k : k + 1024]
            yield table({"part": some} | {n: [cut[p].get(n, b"") for p in some] for n in names}, self.FIELDS)


def gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a part's rows: the distinct hashes, how often each came, and whether one was of kind 1."""

    def joined(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)

    once, more = [joined(f"once{k}", "<u8") for k in (0, 1)], [joined(f"more{k}", "<u8") for k in (0, 1)]
    all_ = np.sort(np.concatenate([*once, *more]))
    first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]])) if len(all_) else np.zeros(0, np.int64)
    hashes, times = all_[first], np.diff(np.append(first, len(all_))).astype(np.int64)
    marked = np.zeros(len(hashes), bool)
    for k in (0, 1):
        np.add.at(times, np.searchsorted(hashes, more[k]), joined(f"counts{k}", "<u4").astype(np.int64) - 1)
    for h in (once[1], more[1]):
        marked[np.searchsorted(hashes, h)] = True
    return hashes, times, marked


def slice_of(hashes: np.ndarray, part: int, parts: int, bits: int) -> bytes:
    """A part's share of the bitmap of 2**bits bits that the leading bits of a hash point into."""
    width = 1 << (bits - (parts.bit_length() - 1))
    at = (hashes >> U64(64 - bits)).astype(np.int64) - part * width
    flags = np.zeros(width, np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def whole(slices: dict[int, bytes], parts: int, bits: int) -> np.ndarray:
    width = 1 << (bits - 3 - (parts.bit_length() - 1))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for part, x in slices.items():
        out[part * width : (part + 1) * width] = np.frombuffer(x, np.uint8)
    return out


def leading(bits_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes point at a set bit."""
    at = (hashes >> U64(64 - bits)).astype(np.int64)
    return (bits_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
