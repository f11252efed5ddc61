"""Exact n-gram Jaccard join of documents by vertical partitioning, and its connected components.

A document's set is its distinct WIDTH-word shingles (64-bit hashes; lower-cased A-Z; a text of fewer words
is one shingle). Documents link when 100 * intersection >= 75 * union.

1. Frequencies. All shingles of all documents are dealt out by ranges of their hash and counted. What stays
   are a few bitmaps of bounded size: one for each frequency class. They define the global n-gram order:
   by class, then hash. A bit shared by two n-grams only moves one of them to a later class, for all
   documents alike, so that the order stays one and the same and no link is lost.
2. Candidates. By the prefix principle two linked documents share an n-gram among the first
   n - ceil(0.75 n) + 1 of each, in that order. N-grams that no other document has come first and are
   not even sent on. Documents with equal sets (by 128 bits) are one class from here on. A class that can
   link with none of the sizes that hold an n-gram is no holder of it.
3. Overlaps. The n-gram sets of classes with candidates are cut vertically, by hash ranges, into
   FRAGMENTS fragments. Each fragment counts a pair's partial overlap by itself; partial counts are summed
   per pair, and the sum is held against the threshold: exact.
4. Groups of near copies. Not all pairs of a group are formed. A first round pairs the holders of an
   n-gram with one hub of theirs, which is linear in the holders. The hub is the holder with the fewest n-grams
   of its own: what its copies have changed, it has not, so that a copy that links with any of the group
   most often links with it. The links found make components. Later
   rounds take other hubs, HUBS times as many each time (64 in the last), only where an n-gram's holders still are of
   different components. When a round finds no link any more, all remaining pairs of different components that can still link by their places in
   the global order (and only these) are counted, so that the components are exact whatever the hubs were.

Defined results: null, empty and blank texts have an empty set, n_shingles 0, and are their own component. A
very long text is one set like any other, held whole by one worker. Every row gives a row; rows with equal ids
are separate documents (component ids are the smallest id of a component's rows; null ids never become one
unless all its rows have null ids). Other columns are never read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import U64, Dealer, bitmap, bits_for, discard, gather, gathered, grouped, in_bitmap, leading, materialise, mix, number, parts_for, pieces, rolling, slice_of, table, texts, whole, word_hashes
from lectern.llm.components import components

WIDTH, PERCENT = 5, 75
FRAGMENTS = 4
#: Frequency classes: an n-gram with at least so many holders is of the class; and how many bits fewer, in powers
#: of two, its bitmap has (fewer n-grams are that frequent).
CLASSES = ((2, 0), (8, 2), (64, 2), (1024, 2))
#: Hub rounds (1, HUBS, HUBS ** 2 ... hubs an n-gram) go on while they find links, and while pairs that share an n-gram
#: and are of different components are over RESIDUE times the holders.
RESIDUE, HUBS, ROUNDS = 0.5, 4, 4


def shingle_sets(some: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for group in grouped(some):
        words, edges = word_hashes([t.lower() for t in group])
        grams = rolling(words, width)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield np.unique(grams[a : b - width + 1]) if b - a >= width else rolling(words[a:b], b - a) if b > a else words[:0]


def set_hash(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits for a set of n-grams."""
    size = np.array([len(tokens)], np.uint64)
    return tuple(int(mix(mix(tokens ^ U64(salt)).sum(dtype=np.uint64, keepdims=True) + size).view(np.int64)[0]) for salt in (0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B))


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def frequency_bitmaps(docs: DataFrame, width: int) -> list[np.ndarray]:
    bits_of = [bits_for(docs) - less for _, less in CLASSES]
    parts = parts_for(docs, min(bits_of))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(parts)
        for batch in pieces(batches):
            for tokens in shingle_sets(texts(batch.column(0)), width):
                if dealer.add(tokens):
                    yield from dealer.rows()
        yield from dealer.rows()

    names = [f"c{least}" for least, _ in CLASSES]
    fields = pa.schema([("part", pa.int32()), *((n, pa.binary()) for n in names)])

    def count(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        hashes, times, _ = gathered(group)
        out = {n: [slice_of(hashes[times >= least], part, parts, bits)] for n, (least, _), bits in zip(names, CLASSES, bits_of, strict=True)}
        return pa.Table.from_batches([table({"part": [part]} | out, fields)])

    rows = gather(docs.select("text").mapInArrow(deal, Dealer.SCHEMA).groupBy("part").applyInArrow(count, "part int, " + ", ".join(f"{n} binary" for n in names)))
    return [whole({r["part"]: bytes(r[n]) for r in rows}, parts, bits) for n, bits in zip(names, bits_of, strict=True)]


_PREFIX = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("alone", pa.int32()), ("prefix", pa.list_(pa.int64()))])


def prefixes(docs: DataFrame, width: int, percent: int, bitmaps: list[np.ndarray]) -> DataFrame:
    """Per row: set size, class of equal sets, and those of its prefix that other rows may have too (once a task for
    each class, else null)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_of = [len(b).bit_length() + 2 for b in shared.value]
        done: set[tuple[int, int]] = set()  # emptied when large
        for batch in pieces(batches):
            out: dict[str, list] = {k: [] for k in ("n", "c1", "c2", "alone", "prefix")}
            for tokens in shingle_sets(texts(batch.column(2)), width):
                key = set_hash(tokens) if len(tokens) else (None, None)
                alone, prefix = 0, None
                if key not in done and len(tokens):
                    if len(done) > 200_000:
                        done.clear()
                    done.add(key)
                    kind = np.zeros(len(tokens), np.int64)
                    for k, bits in enumerate(bits_of):
                        kind[leading(shared.value[k], tokens, bits)] = k + 1
                    alone = int((kind == 0).sum())
                    room = len(tokens) - needed(len(tokens), percent) + 1 - alone
                    live = np.flatnonzero(kind)
                    live = live[np.argsort(kind[live], kind="stable")]  # tokens are in order of their hash
                    prefix = tokens[live[: max(room, 0)]].view(np.int64)
                for k, x in zip(out, (len(tokens), *key, alone, prefix), strict=True):
                    out[k].append(x)
            yield table({"doc_id": batch.column(0), "row_key": batch.column(1)} | out, _PREFIX)

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, "doc_id long, row_key long, n int, c1 long, c2 long, alone int, prefix array<long>")


_SEGMENT = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("fragment", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def segments(docs: DataFrame, width: int, active: np.ndarray) -> DataFrame:
    """The sets of the classes in ``active``, cut into fragments: c1, c2, fragment, tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(active)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()  # one of equal sets is enough; emptied when large
        bits = (len(shared.value) - 4096).bit_length() + 2
        for batch in pieces(batches):
            rows: list[tuple] = []
            for tokens in shingle_sets(texts(batch.column(0)), width):
                if not len(tokens) or (c := set_hash(tokens)) in done or not in_bitmap(shared.value, np.array(c[:1], np.int64).view(np.uint64), bits)[0]:
                    continue
                if len(done) > 200_000:
                    done.clear()
                done.add(c)
                where = (tokens >> U64(62)).astype(np.int64) * FRAGMENTS // 4
                edges = np.searchsorted(where, np.arange(FRAGMENTS + 1))
                rows += [(*c, f, tokens[edges[f] : edges[f + 1]].view(np.int64)) for f in range(FRAGMENTS) if edges[f] < edges[f + 1]]
            if rows:
                yield table(dict(zip(_SEGMENT.names, zip(*rows, strict=True), strict=True)), _SEGMENT)

    return docs.select("text").mapInArrow(run, "c1 long, c2 long, fragment int, tokens array<long>").groupBy("c1", "c2", "fragment").agg(F.first("tokens").alias("tokens"))


def counted(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, na, nb) that link: partial overlaps by fragment, summed per pair."""
    a = segs.select(F.col("cls").alias("a"), "fragment", F.col("tokens").alias("ta"))
    b = segs.select(F.col("cls").alias("b"), "fragment", F.col("tokens").alias("tb"))
    partial = pairs.join(a, "a").join(b, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("part"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
    return total.filter(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def _pairs(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of holders of one n-gram that are of different components and may link.

    ``rest`` is how many of a holder's n-grams come at or after this one in the global order. At the first
    n-gram that two documents share, their overlap is at most the smaller rest. A pair that links passes
    this test there, so that failing it elsewhere loses nothing."""
    r = right.select("token", F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("rest").alias("rest2"), F.col("label").alias("label2"))
    fit = (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & ((100 + percent) * F.least("rest", "rest2") >= percent * (F.col("n") + F.col("n2")))
    swap = F.col("cls") > F.col("cls2")
    ends = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(z) for x, y, z in (("cls", "cls2", "a"), ("cls2", "cls", "b"), ("n", "n2", "na"), ("n2", "n", "nb"))]
    return left.join(r, "token").filter((F.col("label") != F.col("label2")) & fit).select(*ends).distinct()


def _holders(classes: DataFrame, percent: int) -> DataFrame:
    """token, cls, c1, c2, n, alone, rest of the n-grams that several classes hold and can link by."""
    held = classes.select(F.posexplode("prefix").alias("at", "token"), "cls", "c1", "c2", "n", "alone")
    held = held.select("token", "cls", "c1", "c2", "n", "alone", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))
    held = materialise(held, "holders")
    several = held.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least_n")).filter("k > 1").drop("k")
    # The overlap of a pair that links by its first n-gram is at most the smaller rest; no partner is smaller than least_n.
    fit = (100 + percent) * F.col("rest") >= percent * (F.col("n") + F.col("least_n"))
    out = materialise(held.join(several, "token").filter(fit).drop("least_n"), "shared")
    discard(held)
    return out


def link_classes(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """cls, label: components of the classes of equal sets, for the classes that have links."""
    held = _holders(classes, percent)
    keys = held.select("cls", "c1", "c2").distinct()
    active = bitmap(keys, "c1", bits_for(docs) - 2)
    if not active.any():
        return None
    segs = segments(docs, width, active).join(keys, ["c1", "c2"]).select("cls", "fragment", "tokens")
    segs, shared, held = materialise(segs, "segments"), held, held.drop("c1", "c2")
    total = number(held)
    links, labels, new = None, None, 1
    for round_ in range(ROUNDS + 1):
        now = held.withColumn("label", F.col("cls")) if labels is None else materialise(held.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")), f"labelled{round_}")
        per = now.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
        per = per.groupBy("token").agg(F.sum("m").alias("k"), F.sum(F.col("m") * F.col("m")).alias("same"), F.max_by("label", "m").alias("most"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
        left = gather(per.agg(F.sum((F.col("k") * F.col("k") - F.col("same")) / 2)))[0][0]
        if not left:
            break
        last = left <= RESIDUE * total or not new or round_ == ROUNDS
        mixed = now.join(per.select("token", "most"), "token")
        if last:
            pairs = _pairs(mixed.filter("label != most"), now, percent)
        else:
            slot = F.pmod(F.xxhash64("cls", "token", F.lit(round_)), F.lit(HUBS**round_)).alias("slot")
            hub = mixed.groupBy("token", slot).agg(F.min_by(F.struct("cls", "n", "rest", "label"), F.struct("alone", -F.col("n"), "cls")).alias("hub")).select("token", "hub.*")
            pairs = _pairs(mixed, hub, percent)
        pairs = materialise(pairs, f"pairs{round_}")
        found = materialise(counted(pairs, segs, percent), f"links{round_}")
        new = number(found)
        discard(pairs, now if labels is not None else None)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        if last:
            break
    discard(segs, shared)
    return labels


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, row_key (a hash of the text that tells equal ids apart), and label
    (a class of the component, null without shingles), which tells apart components of equal ids."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text"))
    rows = materialise(prefixes(docs, width, percent, frequency_bitmaps(docs, width)), "prefixes")
    of_class = [F.max("n").alias("n"), F.min("doc_id").alias("least"), F.max("alone").alias("alone"), F.first("prefix", ignorenulls=True).alias("prefix")]
    classes = rows.filter("n > 0").groupBy("c1", "c2").agg(*of_class).withColumn("cls", F.monotonically_increasing_id())
    classes = materialise(classes, "classes")
    labels = link_classes(docs, classes, width, percent)
    least = classes.select("c1", "c2", "cls", "least")
    if labels is not None:
        root = least.join(labels, "cls", "left")
        linked = root.filter("label is not null")
        by_root = linked.groupBy("label").agg(F.min("least").alias("component_id"))
        alone = root.filter("label is null").select("c1", "c2", F.col("cls").alias("label"), F.col("least").alias("component_id"))
        least = linked.join(by_root, "label").select("c1", "c2", "label", "component_id").unionByName(alone)
    else:
        least = least.select("c1", "c2", F.col("cls").alias("label"), F.col("least").alias("component_id"))
    out = rows.select("doc_id", "n", "c1", "c2", "row_key").join(least, ["c1", "c2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), "row_key", "label")


def op1_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key", "label")


SQL_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = s.doc_id) AS component_id FROM s
"""
