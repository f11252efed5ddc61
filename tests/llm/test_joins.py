"""Jaccard join, substring removal and top-k search against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from lectern.llm.jaccard import jaccard_components
from lectern.llm.substring import removal_counts
from lectern.llm.topk import top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets, root = [shingle_set(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    members = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            members[find(k)].append(r[0])
    return Counter((r[0], len(sets[k]), min(members[find(k)], default=None) if sets[k] else r[0]) for k, r in enumerate(rows))


def brute_removal(rows, window=35):
    all_words = [WORD.findall(t or "") for _, t, *_ in rows]
    times = Counter(tuple(w[k : k + window]) for w in all_words for k in range(len(w) - window + 1))
    out = Counter()
    for (i, *_), w in zip(rows, all_words, strict=True):
        gone = {j for k in range(len(w) - window + 1) if times[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_jaccard_odd_rows(make_docs, odd_rows):
    assert got(jaccard_components(make_docs(odd_rows)), "doc_id", "n_shingles", "component_id") == brute_components(odd_rows)


def test_jaccard_large_group_of_near_copies(make_docs):
    base, rows = [f"b{k}" for k in range(60)], []
    for i in range(90):  # each changes one more word: neighbours link, far ones need not
        w = list(base)
        for k in range(i % 9):
            w[(7 * k + i) % 60] = f"e{i}x{k}"
        rows.append((i, " ".join(w), "en"))
    assert got(jaccard_components(make_docs(rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_jaccard_threshold_is_inclusive(make_docs):
    a = [f"t{k}" for k in range(11)]  # 7 shingles; 6 of 8 shared links, 5 of 9 does not
    rows = [(5, " ".join(a), None), (6, " ".join([*a[:-1], "z"]), None), (7, " ".join([*a[:-2], "y", "x"]), None)]
    assert got(jaccard_components(make_docs(rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_removal_odd_rows(make_docs, odd_rows):
    assert got(removal_counts(make_docs(odd_rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_removal(odd_rows)


def test_removal_at_the_edges_of_a_window(make_docs):
    p = [f"p{k}" for k in range(36)]
    rows = [(1, " ".join(["a", *p[:34]]), None), (2, " ".join([*p[:34], "b"]), None), (3, " ".join(["c"] * 5 + p[1:36]), None), (4, " ".join([*p[1:36], "d"]), None), (5, " ".join(p[1:36]), None)]
    assert got(removal_counts(make_docs(rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_removal(rows)


def test_joins_of_empty_tables(make_docs):
    assert jaccard_components(make_docs([])).count() == 0
    assert removal_counts(make_docs([])).count() == 0


def test_top_k_ties_nulls_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [((k * 7) % 5 - 2) / 3, ((k * 11) % 7 - 3) / 4, -0.25], 1.0) for k in range(400)]
    rows += [(400, None, 1.0), (500, [1.0, None, 2.0], 1.0), (600, [nan, 1.0, 1.0], 1.0), (700, [1.0, inf, 1.0], 1.0), (800, [0.0, 0.0, 0.0], 1.0), (None, [1.0, 1.0, 1.0], 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    import numpy as np

    clean = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in clean if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(clean[q], v, strict=True)), i) for i, v in clean.items() if i != q)[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in top_k(df, df.filter("vec_id % 100 = 0")).collect()} == want
    none = df.limit(0)
    assert top_k(none, none).count() == 0


def thue_morse(n, a="a", b="b"):
    """Two words of which sums of powers modulo 2**64 are equal."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_different_words_stay_different(make_docs):
    long = [w for n in (512, 1024, 2048) for w in thue_morse(n)]
    rows = []
    for k, w in enumerate(long):
        rows.append((2 * k, " ".join([*(f"p{k // 2}x{j}" for j in range(20)), w, *(f"q{k // 2}x{j}" for j in range(20))]), "en"))
        rows.append((2 * k + 1, " ".join([*(f"s{k // 2}x{j}" for j in range(5)), w, *(f"t{k // 2}x{j}" for j in range(5))]), "en"))
    x, y = thue_morse(64, "u ", "v ")  # the same pattern in words
    rows += [(100, "e f g h " + x, "en"), (101, "i j k l " + y, "en")]
    assert got(removal_counts(make_docs(rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_removal(rows)
    assert got(jaccard_components(make_docs(rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_a_group_whose_members_mostly_do_not_link(make_docs):
    import random

    random.seed(5)
    base, rows = [f"b{k}" for k in range(100)], []
    for i in range(120):  # 0 to 9 changed words of 100: some link with the base, some with few, some with none
        w = list(base)
        for k in random.sample(range(100), i % 10):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w), "en"))
    rows += [(1000 + i, t + " tail of its own", "en") for i, t, _ in rows[::7]]
    assert got(jaccard_components(make_docs(rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_removal_of_copies_in_one_and_several_tasks(make_docs):
    text = " ".join(f"c{k}" for k in range(50))
    for n in (1, 2, 3, 7):
        rows = [(k, text, "en") for k in range(n)] + [(90, " ".join(f"c{k}" for k in range(16, 70)), "en")]
        assert got(removal_counts(make_docs(rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_removal(rows)


def test_top_k_of_repeated_rows_and_ids(spark):
    rows = [(k % 150, [float(k % 7), float(k % 5) - 2, float(k % 3)]) for k in range(300)] + [(0, [0.0, -2.0, 0.0])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = set()
    for q in (0, 100):
        own = min(v for i, v in rows if i == q)
        best = sorted((-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(own, v, strict=True)), i) for i, v in rows if i != q)[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got_ = [tuple(r) for r in top_k(df, df.filter("vec_id % 100 = 0")).collect()]
    assert set(got_) == want and len(got_) == 20


def test_top_k_stops_early_where_the_bound_allows(spark):
    """One component rules: a few rows are scored. Scores over the exact range of a double, and none over a long's."""
    import random

    random.seed(1)
    rows = [(k, [float(k), random.random() / 1000, random.random() / 1000]) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    scored = {r["query_id"]: r["scored"] for r in top_k(df, df.filter("vec_id % 1000 = 0"), with_scored=True).collect()}
    assert max(n for i, n in scored.items() if i) < 1000
    wide = spark.createDataFrame([(k, [2.0**21 + k, 3.0 - k]) for k in range(30)], "vec_id long, embedding array<double>")
    for q, _, i, s in (tuple(r) for r in top_k(wide, wide.filter("vec_id % 100 = 0")).collect()):
        a, b = ([math.floor(1024 * (2.0**21 + k)), math.floor(1024 * (3.0 - k))] for k in (q, i))
        assert s == a[0] * b[0] + a[1] * b[1]
