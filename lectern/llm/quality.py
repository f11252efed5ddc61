"""Quality classifier from weak labels: labelling rules, their accuracies by EM, a hashed linear scorer.

1. Labellers. LABELLERS are overlapping heuristics on counts of a whole text; each votes good, bad or
   abstains. Each share is drawn towards a value on which its labeller abstains, as if PRIOR more words had been
   seen that say nothing: the fewer the words, the more they must say, at every size by the same formula.
2. Label model. Votes are counted per vote pattern over all documents (at most 3**len(LABELLERS) patterns,
   whatever the number of documents). Expectation-maximisation with two classes and independent
   labellers estimates each labeller's accuracy and how often it abstains, and the share of good
   documents; each pattern gets a posterior.
3. Scorer. Words are reduced to shapes, shapes and pairs of shapes are hashed into DIMENSIONS buckets, and
   a logistic regression on the square roots of their shares is trained on the posteriors of at most
   SAMPLE documents (those of the least hash of their id and text). The scorer alone judges every document; a
   document is rejected when its score is under CUT.

Gold labels are never read.

Defined results: null, empty and blank texts have nothing to judge and are rejected with score 0 and
posterior 0. A very long text is counted whole, by one worker. Every row gives a row; null and repeated ids are kept. Other columns are never read. An empty
table gives no rows; where there is nothing to learn from, the scorer says 0.5 and keeps.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Kept, map_arrow, table

#: The cut is under one half: a document in doubt stays.
DIMENSIONS, SAMPLE, CUT = 4096, 4000, 0.35
#: (name, statistic, bad from, good up to, neutral): votes bad at or over the first, good at or under the second;
#: without any words a share is the third.
LABELLERS = (
    ("symbols", "symbol_share", 0.08, 0.045, 0.02),
    ("odd_words", "odd_share", 0.3, -1, 0.1),
    ("capitals", "upper_share", 0.3, -1, 0.1),
    ("long_words", "long_share", 0.5, -1, 0.25),
    ("few_function_words", "few_short", 0.85, 0.7, 0.5),
    ("repeated_words", "repeat_share", 0.2, -1, 0.05),
    ("runs_of_a_word", "longest_run", 4, -1, 0),
    ("little_variety", "sameness", 0.55, -1, 0.2),
    ("one_word_rules", "top_share", 0.3, -1, 0.1),
)
#: Words (of LETTERS letters) that say nothing; words that are counted for variety together.
PRIOR, LETTERS, CHUNK = 6, 5, 64
_ODD_ENDS = ("$", "%", "&", "#", "*", "|", "!!")
# Classes of bytes: ASCII capitals, letters (a lead byte of a longer sequence counts as one), symbols.
_UPPER, _LETTER, _SYMBOL = (np.array([f(b) for b in range(256)], np.int64) for f in (lambda b: 65 <= b <= 90, lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0, lambda b: 33 <= b < 127 and not chr(b).isalnum()))
_NEUTRAL = {k: x for _, k, _, _, x in LABELLERS}


def statistics(text: str, words: list[str]) -> dict[str, float]:
    """The shares that the labellers judge, of a text with words."""
    n = len(words)
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    letters, symbols = int(counts @ _LETTER), int(counts @ _SYMBOL)
    size = np.fromiter(map(len, words), np.int64, n)
    same = np.fromiter(map(str.__eq__, words, words[1:]), bool, n - 1)
    breaks = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    distinct = sum(len(set(words[k : k + CHUNK])) for k in range(0, n, CHUNK))
    found = {
        "symbol_share": (symbols, letters + symbols, LETTERS),
        "odd_share": (sum(w.endswith(_ODD_ENDS) for w in words), n, 1),
        "upper_share": (int(counts @ _UPPER), letters, LETTERS),
        "long_share": (int((size > 7).sum()), n, 1),
        "few_short": (n - int((size <= 3).sum()), n, 1),
        "repeat_share": (int(same.sum()), n - 1, 1),
        "sameness": (n - distinct, n, 1),
        "top_share": (max(Counter(words).values()), n, 1),
    }
    out = {k: (x + PRIOR * each * _NEUTRAL[k]) / (of + PRIOR * each) for k, (x, of, each) in found.items()}
    return out | {"longest_run": int(np.diff(breaks).max())}


def votes(text: str, words: list[str] | None = None) -> str:
    """One letter for each labeller: g, b or -."""
    words = text.split() if words is None else words
    if not words:
        return "-" * len(LABELLERS)
    s = statistics(text, words)
    return "".join("b" if s[k] >= bad else "g" if s[k] <= good else "-" for _, k, bad, good, _ in LABELLERS)


class LabelModel:
    """Accuracies of the labellers by EM over counted vote patterns."""

    def __init__(self, patterns: dict[str, int], rounds: int = 60) -> None:
        m = len(LABELLERS)
        keys = sorted(patterns)
        self.prior = 0.85
        # P(vote | class) for votes b, g, -; labellers start out as right more often than not.
        self.table = np.array([[[0.5, 0.1, 0.4], [0.01, 0.5, 0.49]]] * m)
        if not keys:
            return
        code = np.array([["bg-".index(c) for c in p] for p in keys])
        weight = np.array([patterns[p] for p in keys], float)
        for _ in range(rounds):
            good = self._posterior(code)
            self.prior = float(np.clip((good @ weight) / weight.sum(), 0.02, 0.98))
            for j in range(m):
                for c, p in ((0, 1 - good), (1, good)):
                    mass = np.array([(p * weight)[code[:, j] == v].sum() for v in range(3)]) + np.array([2.0, 0.5, 1.0] if c == 0 else [0.5, 2.0, 1.0])
                    self.table[j, c] = mass / mass.sum()

    def _posterior(self, code: np.ndarray) -> np.ndarray:
        j = np.arange(code.shape[1])
        bad = np.log(1 - self.prior) + np.log(self.table[j, 0, code]).sum(axis=1)
        good = np.log(self.prior) + np.log(self.table[j, 1, code]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def posterior(self, pattern: str) -> float:
        return float(self._posterior(np.array([["bg-".index(c) for c in pattern]]))[0])

    def accuracies(self) -> dict[str, float]:
        """Of each labeller: how often a vote is right."""
        out = {}
        for j, (name, *_) in enumerate(LABELLERS):
            right = (1 - self.prior) * self.table[j, 0, 0] + self.prior * self.table[j, 1, 1]
            wrong = (1 - self.prior) * self.table[j, 0, 1] + self.prior * self.table[j, 1, 0]
            out[name] = float(right / (right + wrong))
        return out


#: Shapes of words that a worker keeps; they are dropped beyond that. Longer words are not worth keeping.
SHAPES, LONG_WORD = 200_000, 64


def _shape(word: str) -> int:
    kind = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    runs: list[str] = []
    for c in kind:
        if len(runs) < 2 or runs[-1] != c or runs[-2] != c:  # runs are two long at most
            runs.append(c)
    size = "s" if len(word) <= 3 else "m" if len(word) <= 7 else "l"
    return zlib.crc32(f"{size}{''.join(runs)}".encode())


def features(text: str, words: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: buckets and values."""
    words = text.split() if words is None else words
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    known: dict[str, int] = Kept.get("quality", "shapes", dict)
    if len(known) > SHAPES:
        known.clear()
    new = {w: _shape(w) for w in set(words).difference(known)}
    known.update((w, x) for w, x in new.items() if len(w) <= LONG_WORD)
    get = (new | known if any(len(w) > LONG_WORD for w in new) else known).__getitem__
    shape = np.fromiter(map(get, words), np.uint64, len(words))
    same = np.fromiter(map(str.__eq__, words, words[1:]), np.uint64, len(words) - 1)
    pair = (shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + same * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)
    repeated = np.full(int(same.sum()), 7, np.uint64)
    bucket = (np.concatenate([shape, pair, repeated]) % np.uint64(DIMENSIONS)).astype(np.int64)
    at, n = np.unique(bucket, return_counts=True)
    return at, np.sqrt(n / len(words))


class Scorer:
    """Logistic regression on hashed features, trained on soft labels by mini-batch gradient steps."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 400, rate: float = 0.5, l2: float = 1e-4) -> None:
        self.weights, self.bias = np.zeros(DIMENSIONS), 0.0
        if not rows:
            return
        at = np.concatenate([r[0] for r in rows])
        value = np.concatenate([r[1] for r in rows])
        row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        y = np.array([r[2] for r in rows])
        good = max(y.sum(), 1.0)
        weight = np.where(y >= 0.5, 1.0, min(4.0, good / max(len(y) - good, 1.0)))
        weight /= weight.sum()
        speed, speed0 = np.full(DIMENSIONS, 1e-8), 1e-8
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, self.weights[at] * value, len(rows)) + self.bias, -30, 30)))
            error = (p - y) * weight
            slope = np.bincount(at, error[row] * value, DIMENSIONS) + l2 * self.weights
            speed += slope**2
            speed0 += error.sum() ** 2
            self.weights -= rate * slope / np.sqrt(speed)
            self.bias -= rate * error.sum() / np.sqrt(speed0)

    def score(self, text: str, words: list[str] | None = None) -> float:
        at, value = features(text, words)
        if not len(at):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ value + self.bias, -30, 30))))


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, Scorer]:
    """The label model from all documents, the scorer from a bounded sample. ``docs``: doc_id, text."""
    fields = pa.schema([("order", pa.int64()), ("votes", pa.string())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield table({"order": batch.column(0), "votes": [votes(t or "") for t in batch.column(1).to_pylist()]}, fields)

    order = F.xxhash64("doc_id", "text")
    voted = map_arrow(docs.select(order.alias("order"), "text"), vote, "order long, votes string")
    counts = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("first")).collect()
    model = LabelModel({r["votes"]: r["n"] for r in counts})
    total = sum(r["n"] for r in counts)
    # A hash cut that lets about 1.2 samples through, then the least hashes of these.
    cut = (1 << 63) - 1 if total <= 1.2 * sample else min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * 1.2 * sample / total))
    rows_schema = pa.schema([("order", pa.int64()), ("votes", pa.string()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [t or "" for t in batch.column(1).to_pylist()]
            found = [features(t) for t in text]
            yield table({"order": batch.column(0), "votes": [votes(t) for t in text], "at": [a for a, _ in found], "value": [v for _, v in found]}, rows_schema)

    chosen = docs.select(order.alias("order"), "text").filter(F.col("order") <= F.lit(cut))
    described = map_arrow(chosen, describe, "order long, votes string, at array<int>, value array<double>")
    rows = described.orderBy("order").limit(sample).collect()
    sure = [(np.array(r["at"], np.int64), np.array(r["value"]), model.posterior(r["votes"])) for r in rows if r["at"]]
    return model, Scorer(sure)


def judge(docs: DataFrame, model: LabelModel, scorer: Scorer, keep: list[str], cut: float = CUT) -> DataFrame:
    """The columns ``keep`` with posterior, score and keep of each whole text (column text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model, scorer))
    rows = docs.select(*keep, F.col("text").alias("q_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, line = shared.value
        posteriors: dict[str, float] = {}
        for batch in batches:
            text = [t or "" for t in batch.column("q_text").to_pylist()]
            words = [t.split() for t in text]
            score = [line.score(t, w) for t, w in zip(text, words, strict=True)]
            seen = [votes(t, w) for t, w in zip(text, words, strict=True)]
            for v in set(seen).difference(posteriors):
                posteriors[v] = label.posterior(v)
            blank = [not w for w in words]
            kept_ = [not b and s >= cut for s, b in zip(score, blank, strict=True)]
            columns = [*(batch.column(k) for k in range(len(keep))), pa.array([0.0 if b else posteriors[v] for v, b in zip(seen, blank, strict=True)], pa.float64()), pa.array(score, pa.float64()), pa.array(kept_, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: len(keep)], "posterior", "score", "keep"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return map_arrow(rows, run, f"{kept}, posterior double, score double, keep boolean")


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, posterior (label model), score (scorer), keep."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judge(rows, *fit(rows), keep=["doc_id"])


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
