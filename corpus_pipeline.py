"""A corpus pipeline of five stages over ``documents``: quality, language, near duplicates, repeats, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A stage learns from the rows it is given. Rows with a null or blank text go in the first stage;
null and repeated ids, nulls elsewhere and extra columns, whatever their names, are kept as they are; very long
texts are read whole; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import jaccard, language, packing, quality, substring
from lectern.llm.common import map_arrow, materialise

#: A text is of no learned language under this likeness to its nearest profile.
LEAST_LANGUAGE_SCORE = 0.3


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with the extra columns of ``docs`` under names that clash with none of its own, and back."""

    @wraps(stage)
    def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        held = docs.toDF(*(c if c in OWN else f"extra_column_{k}" for k, c in enumerate(names)))
        return stage(spark, held, sf_dir).toDF(*names)

    return apart


def _key() -> list:
    return [F.col("doc_id").cast("long"), F.xxhash64("text")]


@_apart
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return quality.judge(docs, *quality.fit(rows), keep=docs.columns).filter("keep").select(*docs.columns)


@_apart
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, and near enough to a language that was learned; none go where none was."""
    profiles = language.learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(~language.held_out()))
    if not profiles.languages:
        return docs
    judged = language.predict(docs, profiles, keep=docs.columns)
    return judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


@_apart
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one with the smallest id.

    Rows equal in id and text count as one; documents without words stay."""
    found = jaccard.jaccard_components(docs)
    linked = found.filter("n_shingles > 0 and component_id is not null")
    first = linked.groupBy("label").agg(F.min(F.struct("doc_id", "row_key")).alias("k")).select("k.*")
    rest = found.filter("n_shingles = 0 or component_id is null").select("doc_id", "row_key")
    stay = first.unionByName(rest).distinct()
    keyed = docs.withColumn("stay_id", _key()[0]).withColumn("stay_key", _key()[1])
    on = F.col("stay_id").eqNullSafe(F.col("s.doc_id")) & (F.col("stay_key") == F.col("s.row_key"))
    kept = keyed.alias("d").join(stay.alias("s"), on, "left_semi").dropDuplicates(["stay_id", "stay_key"])
    return kept.select(*docs.columns)


@_apart
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeated windows cover; n_chars is set anew. Documents left empty go.

    A document that loses nothing keeps its text as it is; else the kept words are joined by one space."""
    columns = docs.columns
    rows = substring.with_repeats(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, starts in zip(batch.column("text").to_pylist(), batch.column("starts"), strict=True):
                if t is not None and starts.is_valid:
                    words = t.encode().split()
                    gone = substring.covered(len(words), starts.values.to_numpy(), substring.WINDOW)
                    t = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode()
                    t = t or None
                texts.append(t)
            arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    cut = map_arrow(rows.select(*columns, "starts"), run, kinds).filter("text is not null")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, packing.tokenizer_source())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("language", known_language),
    ("near duplicates", one_of_each_group),
    ("repeated passages", without_repeats),
    ("packing", packed),
]

#: SQL expresses neither the trained stages nor the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
