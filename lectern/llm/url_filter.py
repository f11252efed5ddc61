"""URL verdicts: host and path rules first, else gradient-boosted trees on lexical features.

Only DataFrame functions touch the rows. Training reads at most SAMPLE labelled URLs (those of the least
hash; a bounded, documented sample): their features are computed by the same expressions, and the trees are
grown from them on the driver. The model then becomes one SQL expression, so that scoring needs no shuffle.

Features of a URL: length, host length, number of host labels, longest label, path depth, digit ratio,
hyphens and entropy of the host, number of parameters, and the statistic of its suffix (smoothed log odds of
the host's last label among the labelled URLs, for the SUFFIXES most frequent ones).

Labels: ``train`` takes any table (url, label), and ``held_out`` says how well trees from four fifths of its hosts
judge the URLs of the other hosts. No table at hand has labelled URLs: the registered query labels the URLs of its own
table by the words of SPAM_WORDS in the host; the words themselves are no feature.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule, and is judged
by the trees as an empty string. Every row gives a row; null and repeated ids are kept. Without any labelled
URL, or where all labels are equal, the trees say the label that is there (allow if none). Other columns are
never read. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, SUFFIXES = 5000, 64
TREES, DEPTH, RATE, BINS, LEAST = 16, 3, 0.3, 32, 5
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Fixed words that mark a labelled URL's host as unwanted.
SPAM_WORDS = ("adult", "ads", "bets", "casino", "pills", "poker", "porn", "spam", "track", "viagra", "xxx")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a URL; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for decision, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the last wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


FEATURES = ("length", "host_length", "labels", "longest_label", "depth", "digits", "hyphens", "entropy", "parameters")


def lexical(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """Add the columns FEATURES and ``suffix``."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    n = F.length(h)

    def times(text: Column, characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("double")

    def less(total: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(h, c, F.lit("")))) / n
        return total - share * F.log2(share)

    entropy = F.when(n == 0, 0.0).otherwise(F.aggregate(F.array_distinct(F.filter(F.split(h, ""), lambda c: c != "")), F.lit(0.0), less))
    return df.withColumns(
        {
            "length": F.length(u).cast("double"),
            "host_length": n.cast("double"),
            "labels": times(h, ".") + 1,
            "longest_label": F.array_max(F.transform(F.split(h, r"\."), lambda x: F.length(x))).cast("double"),
            "depth": times(p, "/"),
            "digits": F.when(F.length(u) == 0, 0.0).otherwise(times(u, "0123456789") / F.length(u)),
            "hyphens": times(h, "-"),
            "entropy": entropy,
            "parameters": F.when(F.instr(u, "?") == 0, 0.0).otherwise(times(u, "=")),
            "suffix": F.substring_index(h, ".", -1),
        }
    )


class Trees:
    """Boosted regression trees for the logistic loss, and their SQL expression."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.trees: list = []
        mean = float(y.mean()) if len(y) else 0.0
        self.base = math.log((mean + 1e-3) / (1 - mean + 1e-3))
        if mean in (0.0, 1.0):
            return
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        raw = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, DEPTH)
            self.trees.append(tree)
            raw += np.array([self._at(tree, row) for row in x])

    def _grow(self, x, g, h, rows, cuts, depth):
        def gain(a, b):
            return a * a / (b + 1.0)

        best, total = (1e-6, None, None), gain(g[rows].sum(), h[rows].sum())
        for j in range(x.shape[1]) if depth else ():
            v = x[rows, j]
            for c in cuts[j]:
                left = v <= c
                if left.sum() < LEAST or (~left).sum() < LEAST:
                    continue
                a, b = rows[left], rows[~left]
                value = gain(g[a].sum(), h[a].sum()) + gain(g[b].sum(), h[b].sum()) - total
                if value > best[0]:
                    best = (value, j, float(c))
        _, j, c = best
        if j is None:
            return RATE * float(g[rows].sum() / (h[rows].sum() + 1.0))
        left = x[rows, j] <= c
        return j, c, self._grow(x, g, h, rows[left], cuts, depth - 1), self._grow(x, g, h, rows[~left], cuts, depth - 1)

    def _at(self, tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def raw(self, row) -> float:
        return self.base + sum(self._at(t, row) for t in self.trees)

    def expression(self, features: list[Column]) -> Column:
        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            j, c, a, b = tree
            return F.when(features[j] <= F.lit(c), of(a)).otherwise(of(b))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + of(t)
        return total


class UrlModel:
    """The trees and the suffix statistic they use."""

    def __init__(self, rows: list, sample: int = SAMPLE) -> None:
        count: dict[str, list[float]] = {}
        for r in rows:
            c = count.setdefault(r["suffix"], [0.0, 0.0])
            c[0] += r["label"]
            c[1] += 1
        mean = sum(r["label"] for r in rows) / len(rows) if rows else 0.0
        kept = sorted(count, key=lambda s: (-count[s][1], s))[:SUFFIXES]
        # Smoothed by 20 pseudo-counts, so that rare suffixes say little.
        self.suffixes = {s: round(math.log((count[s][0] + 20 * mean + 0.5) / (count[s][1] - count[s][0] + 20 * (1 - mean) + 0.5)), 6) for s in kept}
        self.unknown = round(math.log((mean + 0.01) / (1 - mean + 0.01)), 6)
        x = np.array([[r[f] for f in FEATURES] + [self.suffixes.get(r["suffix"], self.unknown)] for r in rows], float).reshape(len(rows), len(FEATURES) + 1)
        self.trees = Trees(x, np.array([r["label"] for r in rows], float))

    def raw(self) -> Column:
        """Log odds of block, over the columns of ``lexical``."""
        suffix = F.lit(self.unknown)
        for s, v in self.suffixes.items():
            suffix = F.when(F.col("suffix") == s, F.lit(v)).otherwise(suffix)
        return self.trees.expression([*map(F.col, FEATURES), F.col("suffix_statistic")]), suffix


def train(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """Trees from a table (url, label 0/1); at most ``sample`` rows are read, of the least hash."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label"), F.xxhash64("url").alias("order"))
    rows = rows.orderBy("order", "url", "label").limit(sample).select("url", "label", host.alias("host"), path.alias("path"))
    return UrlModel(lexical(rows, "url", "host", "path").drop("url", "host", "path").collect())


def held_out(labelled: DataFrame, sample: int = SAMPLE, folds: int = 5) -> dict[str, float]:
    """Trees from all hosts but one in ``folds``, over the URLs of that part of the hosts: rows, log_loss, accuracy, and
    the log loss and accuracy of the share of labels alone."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter("url is not null and label is not null").withColumn("apart", F.pmod(F.xxhash64(host), F.lit(folds)) == 0)
    model = train(rows.filter("not apart"), sample)
    raw, suffix = model.raw()
    seen = rows.filter("apart").select("url", F.col("label").cast("double").alias("label"), host.alias("host"), path.alias("path"))
    p = 1 / (1 + F.exp(-F.col("raw")))
    judged = lexical(seen, "url", "host", "path").withColumn("suffix_statistic", suffix).withColumn("raw", raw).select("label", p.alias("p"))
    loss = -F.col("label") * F.log("p") - (1 - F.col("label")) * F.log(1 - F.col("p"))
    n, lost, right, share = judged.agg(F.count(F.lit(1)), F.avg(loss), F.avg(((F.col("p") > 0.5).cast("int") == F.col("label")).cast("int")), F.avg("label")).first()
    if not n:
        return {"rows": 0}
    alone = -sum(x * math.log(x) for x in (share, 1 - share) if x > 0)
    return {"rows": n, "log_loss": lost, "accuracy": right, "log_loss_of_share": alone, "accuracy_of_share": max(share, 1 - share)}


def word_labels(pages: DataFrame, words=SPAM_WORDS) -> DataFrame:
    """Labelled URLs: 1 where the host has one of the words between its separators."""
    host, _ = host_and_path(F.col("url"))
    return pages.select("url", host.rlike(r"(^|[.\-])(" + "|".join(words) + r")($|[.\-])").cast("int").alias("label")).filter("url is not null")


def judge(pages: DataFrame, model: UrlModel, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' score (probability of block)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    raw, suffix = model.raw()
    rows = lexical(rows, "url", "host", "path").withColumn("suffix_statistic", suffix).withColumn("raw", raw)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("raw") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), (1 / (1 + F.exp(-F.col("raw")))).alias("score"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train(word_labels(pages)))
