"""Language identification by rank-order profiles.

Method: a text is lower-cased, runs of anything but letters become one space, and its 1- to 3-grams of
characters are counted and ranked. A language's profile holds its LENGTH most frequent n-grams. A
document's LENGTH most frequent n-grams are compared to each profile by the out-of-place distance: the sum
of rank differences, with LENGTH for an n-gram that the profile lacks. The nearest profile wins.

Profiles are learned from at most PER_LANGUAGE documents of each language (those of the least hash of
their text and id, so that the choice does not depend on the partitioning); the prediction reads every
whole text. An n-gram is three 21-bit code points in one long, so that no two collide.

Score: 1 for a distance of 0, 0 where nothing of the document is in the profile at all.

Defined results: texts that are null or without any letter get ``und`` and score 0; so does every text where
nothing can be learned. Ties go to the more frequent n-gram, then the smaller code; between languages to
the smaller name. Rows with null ids are predicted but neither learned from nor held out. Empty tables give
no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import table

LENGTH = 300
PER_LANGUAGE = 400
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of other characters than letters as one space, padded."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[0][codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of others
    keep[0] = letter[0]
    out = codes[keep]
    return np.concatenate([[32], out, [32] if out[-1] != 32 else []]).astype(np.int64)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (packed code points) and their counts."""
    c = letter_codes(text)
    if not len(c):
        return c, c
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    return np.unique(np.concatenate([c[c != 32], two, three]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams in order; ties to the smaller code."""
    if len(grams) > 4 * length:
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")[:length]]


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], length: int = LENGTH) -> None:
        self.languages, self.length = sorted(profiles), length
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)])).astype(np.int64)
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), -1, np.int64)
        for k, lang in enumerate(self.languages):
            self.ranks[k, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(*ngrams(text), self.length)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[:, at]
        distance = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.length * len(own))


def learn(rows: DataFrame, per_language: int = PER_LANGUAGE, length: int = LENGTH) -> Profiles:
    """Profiles from rows (doc_id, text, lang); counts of the chosen documents are summed in Spark."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = F.xxhash64("doc_id", F.lit(6))
    first = Window.partitionBy("lang").orderBy("order", "doc_id")
    chosen = rows.select("doc_id", "lang", order.alias("order")).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language)
    limit = chosen.groupBy("lang").agg(F.max("order").alias("most"))  # one row a language
    limits = {r["lang"]: r["most"] for r in limit.collect()}
    if not limits:
        return Profiles({}, length)
    bound = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    chosen = rows.filter(F.xxhash64("doc_id", F.lit(6)) <= bound[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(ngrams(text))
        for lang, some in held.items():
            grams, where = np.unique(np.concatenate([g for g, _ in some]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([c for _, c in some]), minlength=len(grams)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams, pa.int64()), "n": pa.array(counts, pa.int64())})

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= length).select("lang", "gram", "k").collect()
    found: dict[str, list] = {}
    for lang, gram, k in sorted(top, key=lambda r: (r["lang"], r["k"])):
        found.setdefault(lang, []).append(gram)
    return Profiles({lang: np.array(g, np.int64) for lang, g in found.items()}, length)


def predict(docs: DataFrame, profiles: Profiles, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select(*keep, F.col(text_col).alias("lid_text"))
    types = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [shared.value.predict(t) for t in batch.column("lid_text").to_pylist()]
            columns = [batch.column(k) for k in range(len(keep))]
            names = [*batch.schema.names[: len(keep)], "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.float64())], names=names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types.fields[: len(keep)])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")


def held_out() -> Column:
    """One document in five, by the CRC of its id's decimal digits."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    profiles = learn(rows.filter(~held_out()))
    out = predict(rows, profiles, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_language(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
