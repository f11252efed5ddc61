"""BPE, packing, fingerprints, language, quality, licences and URLs: round trips, held-out accuracy, odd rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, fingerprint, language, licences, packing, quality, url_filter

SF = "/root/testdata/sf0.001"


def test_bpe_as_the_library(make_docs, odd_rows):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = bpe.public_vocabulary()
    library = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [*odd_rows, (20, "x" * 3000 + "ab" * 700, None), (21, "  two  spaces \n\n\tend ", None)]
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(make_docs(rows), ranks, pattern).collect()}
    want = set()
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bpe.encode(make_docs([]), ranks, pattern).count() == 0


def test_packing_covers_every_id_once(make_docs, odd_rows):
    tokenizers = pytest.importorskip("tokenizers")
    import numpy as np
    import public_tokenizers

    own = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(odd_rows)]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(make_docs(rows), packing.tokenizer_source()).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {i for i, _, _ in rows}
    for i, t, _ in rows:
        ids, at = [*own.encode(t or "", add_special_tokens=False).ids, 1], 0
        for start, length, crc, total in sorted(pieces[i]):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert 0 < at <= 2048
    assert packing.pack(make_docs([]), packing.tokenizer_source()).count() == 0


def test_fingerprints(spark, tmp_path):
    texts = {1: "first text of the table " * 30, 2: "first text of the table " * 30, 3: None, 5: "", 9: "quite another matter, 12345! " * 25}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in fingerprint.op4_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(texts)
    for k, i in enumerate(order):
        own, other = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        r = rows[i]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == own:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] and rows[3]["fingerprint"] == rows[5]["fingerprint"]
    assert rows[1]["near_next"] == 1 and rows[1]["near_next"] > rows[9]["near_next"]


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = language.op6_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95


def test_language_of_odd_rows(make_docs, odd_rows):
    rows = {(r["doc_id"], r["lang_pred"]) for r in language.identify(make_docs(odd_rows)).collect()}
    assert {(3, "und"), (4, "und"), (5, "und")} <= rows and len(rows) == len(odd_rows) - 1
    assert language.identify(make_docs([])).count() == 0


def test_quality_against_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    right = quality.op2_quality(spark, SF).join(labels, "doc_id").agg(F.avg((F.col("keep").cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.85


def test_quality_of_odd_rows(make_docs, odd_rows):
    rows = quality.classify(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    assert all(not r["keep"] and r["score"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert quality.classify(make_docs([])).count() == 0


def test_quality_of_tables_just_over_the_sample(make_docs):
    rows = [(k, f"Some plain words of document number {k} that say little.", "en") for k in range(12)]
    for n in (10, 11, 12):  # the hash cut of 11 and 12 rows would be over the largest long
        docs = make_docs(rows[:n]).select("doc_id", "text")
        assert quality.judge(docs, *quality.fit(docs, sample=10), keep=["doc_id"]).count() == n


def test_shape_reads_whole_words():
    assert len({quality._shape("a" * 64 + end) for end in ("a" * 6, "0" * 6, "A" * 6, "a" * 5000 + "$")}) == 4


def brute_licences(rows, model):
    """(doc_id, paragraph) -> family, confirmed: every unit of every text judged by itself."""
    import re

    word, end = re.compile("[a-z0-9]+"), re.compile(licences._END)
    out = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        words = [word.findall(x.lower()) for x in lines]
        units = [[k] for k in range(len(lines)) if words[k]]
        for k in range(len(lines)):
            unit, n = [k], 0
            while words[k] and n < licences.LONGEST and unit[-1] + 1 < len(lines) and words[unit[-1] + 1] and not end.search(lines[unit[-1]]):
                unit.append(unit[-1] + 1)
                n += len(words[unit[-1]])
            if len(unit) > 1:
                units.append(unit)
        judged = []
        for unit in units:
            own = licences.grams(" ".join(w for k in unit for w in words[k]))
            if own & model.vocabulary.keys():
                family, _ = model.predict(own)
                near = max((len(p & own) / len(p) for f, _, p in licences.template_pairs() if f == family and p), default=0.0)
                judged.append((family != licences.UNKNOWN and near >= licences.CONFIRM, near, -len(unit), unit, family))
        alone = {u[0] for sure, _, n, u, _ in judged if sure and n == -1}
        for k in range(len(lines)):
            fit = [j for j in judged if k in j[3] and j[4] != licences.UNKNOWN and (j[2] == -1 or j[0] and not alone & set(j[3]))]
            if fit:
                best = max(fit, key=lambda j: (j[0], j[1], j[2], j[3][0]))
                out[(i, k)] = best[4], best[0]
    return out


def scanned(docs):
    model = licences.train(docs.filter("text <> ''").selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) key", "text"))
    return model, {(r["doc_id"], r["paragraph"]): (r["family"], r["confirmed"]) for r in licences.scan(docs, model).collect()}


def test_licences_find_notices_and_leave_others(make_docs):
    rows = [(i, f"Some words.\n{ts[0]}\nMore words.", "en") for i, ts in enumerate(licences.TEMPLATES.values())]
    rows += [(90, "He showed his license at the gate of the town.", "en"), (91, None, None), (92, "", None), (0, rows[0][1], "en")]
    model, found = scanned(make_docs(rows))
    assert {(i, f) for (i, _), (f, sure) in found.items() if sure} == set(enumerate(licences.TEMPLATES))
    assert found == brute_licences(rows, model)
    assert scanned(make_docs([]))[1] == {}


def test_licences_in_wordings_of_no_template(make_docs):
    """Without any word that a list would have to name, and the model's own figures on templates that it has not seen."""
    wordings = {
        "mit": ["Distributed under the MIT licence.", "Published under MIT terms, see the MIT License"],
        "cc": ["Content licensed CC BY-NC-ND 3.0", "Images are under a Creative Commons licence"],
        "mpl": ["Subject to the Mozilla Public License Version 1.1"],
        "bsd": ["Provided under the BSD 3-Clause License"],
        "apache": ["Apache License, second version, applies"],
        "gpl": ["Covered by the GNU Affero terms, a General Public License"],
    }
    rows = [(k, w, "en") for k, (_, w) in enumerate((f, w) for f, ws in wordings.items() for w in ws)]
    want = {k: f for k, f in enumerate(f for f, ws in wordings.items() for _ in ws)}
    rows += [(100 + k, t, "en") for k, t in enumerate(("She walked to the office and saw the notice", "The first version of the book was published in the spring.", "plain words"))]
    model, found = scanned(make_docs(rows))
    assert {i: f for (i, _), (f, _) in found.items()} == want
    assert found == brute_licences(rows, model)
    assert model.held_out["notices"] >= 0.5 and model.held_out["others"] >= 0.95


def test_licences_find_wrapped_notices(make_docs):
    import textwrap

    notices = {"bsd": licences.TEMPLATES["bsd"][1], "mit": licences.TEMPLATES["mit"][2], "gpl": licences.TEMPLATES["gpl"][1]}
    rows, want = [], set()
    for k, (family, notice) in enumerate(sorted(notices.items())):
        for j, width in enumerate((30, 50, 72)):
            lines = textwrap.wrap(notice, width)
            assert len(lines) > 1
            for m, (before, after) in enumerate((("Some words.\n\n", "\n\nMore words."), ("Some words.\n", "\nMore words."), ("A heading\n * ", "\n"), ("a line of a list\n" * 200, "\na line of a list" * 200))):
                rows.append((100 * k + 10 * j + m, before + "\n".join(lines) + after, "en"))
                want.add((rows[-1][0], family))
    rows += [(900, "He showed his license at the gate\nReleased under the MIT License", "en"), (902, "Released under the MIT License\nReleased under the BSD License", "en"), (901, "He showed his license\nat the gate of the town", "en")]
    model, found = scanned(make_docs(rows))
    assert {(i, f) for (i, _), (f, sure) in found.items() if sure} == want | {(900, "mit"), (902, "mit"), (902, "bsd")}
    assert found == brute_licences(rows, model)


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = [(len(h + p), h + p, d) for d, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_url_rules(spark):
    urls = ["http://A.NET/x", "http://example.net/en/a", "https://www.example.com/de/?q=1", "http://example.com", "http://x.org/fr/y#z", "http://notnet/", "http://net?x=/", "plain", "", None, "http://é.NET/ü", "a://b://c/", "http://example.net/en"]
    df = spark.createDataFrame([(i, u, 1.0, "h") for i, u in enumerate(urls)], "page_id long, url string, score double, host string")
    model = url_filter.train(url_filter.word_labels(df))
    judged = url_filter.judge(df, model)
    assert "Python" not in judged._jdf.queryExecution().toString() and "Arrow" not in judged._jdf.queryExecution().toString()
    rows = {r["page_id"]: r for r in judged.collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule)
        assert rows[i]["verdict"] == verdict if verdict else rows[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0), model).count() == 0


def test_url_trees_as_their_expression(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    pages = pages.unionByName(pages.limit(5))  # repeated rows
    model = url_filter.train(url_filter.word_labels(pages))
    judged = url_filter.judge(pages, model).join(pages.distinct(), "page_id")
    host, path = url_filter.host_and_path(F.col("url"))
    features = url_filter.lexical(judged.select("score", "verdict", "rule", "url", host.alias("host"), path.alias("path")), "url", "host", "path").collect()
    assert len(features) == pages.count()
    import math

    for r in features:  # trees walked by hand over the same features
        raw = model.trees.raw([*(r[f] for f in url_filter.FEATURES), model.suffixes.get(r["suffix"], model.unknown)])
        assert abs(r["score"] - 1 / (1 + math.exp(-raw))) < 1e-9
        assert r["rule"] is not None or r["verdict"] == ("block" if raw > 0 else "allow")


def test_url_trees_on_hosts_that_they_have_not_seen(spark):
    figures = url_filter.held_out(url_filter.word_labels(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")))
    assert figures["rows"] > 100 and figures["log_loss"] < figures["log_loss_of_share"] + 0.02
    assert figures["accuracy"] >= figures["accuracy_of_share"] - 0.02


# --- brute force of what has no SQL ------------------------------------------------------------------------


def brute_digest(data):
    counts = [0] * 256
    for start in range(len(data)):
        for offsets, factors in zip(fingerprint.TRIPLETS, fingerprint.FACTORS, strict=True):
            if start + offsets[-1] < len(data):
                h = sum(data[start + o] * f for o, f in zip(offsets, factors, strict=True)) & 0xFFFFFFFF
                h ^= h >> 15
                counts[(h * 0x2545F491 & 0xFFFFFFFF) >> 24] += 1
    q = [sorted(counts)[k] for k in (63, 127, 191)]
    import math

    length = 0 if not data else min(255, 1 + int(8 * math.log2(len(data))))
    ratio = (q[0] * 15 // q[2] << 4 | q[1] * 15 // q[2]) if q[2] else 0
    check = zlib.crc32(data) & 0xFFFF
    codes = [sum(c > x for x in q) for c in counts]
    return length, ratio, check, codes


def brute_likeness(a, b):
    if a == b:
        return 1.0
    off = abs(a[0] - b[0])
    score = (off if off <= 2 else 6 * off) + (a[2] != b[2])
    for shift in (0, 4):
        r = abs((a[1] >> shift & 15) - (b[1] >> shift & 15))
        score += r if r <= 1 else 4 * r
    score += sum(6 if abs(x - y) == 3 else abs(x - y) for x, y in zip(a[3], b[3], strict=True))
    return 1 - min(score, fingerprint.BOUND) / fingerprint.BOUND


def test_fingerprints_of_odd_rows_by_brute_force(make_docs, odd_rows):
    order = sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for k, (i, t, _) in enumerate(order):
        own, other = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        a, b, c = (brute_digest(x.encode()) for x in (own, edited, other))
        want.append((str(i), len(own), hashlib.sha256(edited.encode()).hexdigest(), round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)))
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprint.fingerprint_with_neighbours(make_docs(odd_rows)).collect()]
    assert sorted(got) == sorted(want)
    assert fingerprint.fingerprint_with_neighbours(make_docs([])).count() == 0
    one = fingerprint.fingerprint_with_neighbours(make_docs([(5, "its own neighbour", "en")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def brute_grams(text):
    from collections import Counter

    spaced = "".join(c if c.isalpha() else " " for c in text.lower())
    spaced = f" {' '.join(spaced.split())} "
    found = Counter(spaced[k : k + n] for n in (1, 2, 3) for k in range(len(spaced) - n + 1))
    del found[" "]
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], sum(ord(c) << 21 * (len(x[0]) - 1 - k) for k, c in enumerate(x[0]))))], found


def brute_language(rows, length):
    from collections import Counter

    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    counts = defaultdict(Counter)
    for i, t, lang in rows:
        if not held[i] and lang is not None and t is not None:
            counts[lang].update(brute_grams(t)[1])
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    ranks = {lang: {g: k for k, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:length])} for lang, c in counts.items()}
    out = {}
    for i, t, _ in rows:
        own = brute_grams(t or "")[0][:length]
        if not own:
            out[i] = (held[i], "und", 0.0)
            continue
        far, lang = min((sum(abs(r[g] - k) if g in r else length for k, g in enumerate(own)), lang) for lang, r in ranks.items())
        out[i] = (held[i], lang, round(1 - far / (length * len(own)), 9))
    return out


def test_language_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in language.op6_language(spark, SF).collect()}
    assert got == brute_language(rows, language.LENGTH)


def test_quality_by_brute_force(spark):
    """The label model from counted patterns, the scorer on all texts (fewer than the sample): one document at a time."""
    import math
    from collections import Counter

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    seen = {i: quality.votes(t or "") for i, t in rows}
    prior, right = 0.85, [[[0.5, 0.1, 0.4], [0.01, 0.5, 0.49]] for _ in quality.LABELLERS]
    patterns = Counter(seen.values())

    def posterior(p):
        bad, good = math.log(1 - prior), math.log(prior)
        for j, v in enumerate(p):
            bad, good = bad + math.log(right[j][0]["bg-".index(v)]), good + math.log(right[j][1]["bg-".index(v)])
        return 1 / (1 + math.exp(max(-500, min(500, bad - good))))

    for _ in range(60):
        post = {p: posterior(p) for p in patterns}
        prior = min(0.98, max(0.02, sum(post[p] * n for p, n in patterns.items()) / sum(patterns.values())))
        for j in range(len(quality.LABELLERS)):
            for c in (0, 1):
                mass = [[2.0, 0.5, 1.0], [0.5, 2.0, 1.0]][c][:]
                for p, n in patterns.items():
                    mass["bg-".index(p[j])] += n * (post[p] if c else 1 - post[p])
                right[j][c] = [x / sum(mass) for x in mass]
    found = {r["doc_id"]: r for r in quality.op2_quality(spark, SF).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        want = posterior(seen[i]) if (t or "").split() else 0.0
        assert abs(found[i]["posterior"] - want) < 1e-6
    sure = [(*quality.features(t), posterior(seen[i])) for i, t in rows if (t or "").split()]
    scorer = quality.Scorer(sure)
    for i, t in rows:
        assert abs(found[i]["score"] - scorer.score(t or "")) < 1e-3
        assert found[i]["keep"] == bool((t or "").split() and found[i]["score"] >= quality.CUT)


def test_quality_judges_short_texts_as_others(make_docs):
    good = [(k, " ".join(["the plain words of a text", f"number {k}", "go on and on to the end of it"] * 4) + ".", "en") for k in range(40)]
    bad = [(100 + k, " ".join([f"##{k}$$", "!!&&", "BUY%%", "@@@"] * 12), "en") for k in range(8)]
    short = [(200, "A few words.", "en"), (201, "$$$ ###!! %%", "en")]
    kept = {r["doc_id"]: r["keep"] for r in quality.classify(make_docs(good + bad + short)).collect()}
    assert all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in bad)
    assert kept[200] and not kept[201]


def test_bpe_of_very_long_words_and_of_any_vocabulary(make_docs):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = bpe.public_vocabulary()
    library = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "ab" * 6000, None), (2, "the" * 300 + "x" * 255 + " " + "é" * 200, None), (3, "a" * 257, None)]
    got = {r["doc_id"]: r for r in bpe.encode(make_docs(rows), ranks, pattern, with_ids=True).collect()}
    back = {r: b for b, r in ranks.items()}
    for i, t, _ in rows:
        assert got[i]["ids"] == library.encode_ordinary(t)
        assert b"".join(back[k] for k in got[i]["ids"]) == t.encode() == bytes(got[i]["decoded"])  # from the document's own ids
    toy = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 301, b"bc": 302, b"abcab": 303, b"cab": 304, b"ba": 305, b"baba": 299}

    def one_by_one(word):
        t = [bytes([b]) for b in word]
        while pairs := [(toy[t[k] + t[k + 1]], k) for k in range(len(t) - 1) if t[k] + t[k + 1] in toy]:
            k = min(pairs)[1]
            t[k : k + 2] = [t[k] + t[k + 1]]
        return [toy[x] for x in t]

    import random

    random.seed(2)
    rows = [(k, "".join(random.choice("abc") for _ in range(n)), None) for k, n in enumerate((5, 60, 256, 257, 300, 500) * 3)]
    for r in bpe.encode(make_docs(rows), toy, "[a-z]+", with_ids=True).collect():
        assert r["ids"] == one_by_one(dict((i, t) for i, t, _ in rows)[r["doc_id"]].encode())


def test_packing_has_the_tokenizers_own_tokens(make_docs):
    import numpy as np
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    own = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = [(k, t, None) for k, t in enumerate(("a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>", "<|endoftext|>", "<|end oftext|>"))]
    for r in packing.pack(make_docs(rows), packing.tokenizer_source()).collect():
        ids = [*own.encode(rows[r["doc_id"]][1], add_special_tokens=False).ids, 1]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_packing_goes_to_the_cheapest_sequence_with_room():
    import random

    random.seed(4)
    lengths = [random.choice((1, 7, 60, 300, 1500, 2048, 5000)) for _ in range(120)]
    got = packing.assign(lengths)
    full, rest = divmod(sum(lengths), 2048)
    room = [2048] * full + [1 << k for k in range(11, -1, -1) if rest >> k & 1]
    used, spent, want, taken = [0] * len(room), [0.0] * len(room), [], 0
    for d, n in enumerate(lengths):
        for at in range(0, n - 2047, 2048):
            want.append((d, at, 2048, taken, 0))
            used[taken], taken = 2048, taken + 1
    for n, d in sorted(((n % 2048, d) for d, n in enumerate(lengths) if n % 2048), key=lambda x: (-x[0], x[1])):
        at = lengths[d] - n
        while n:
            fit = [s for s in range(taken, len(room)) if room[s] - used[s] >= n] or [s for s in range(taken, len(room)) if room[s] > used[s]]
            s = min(fit, key=lambda s: (spent[s], s))
            m = min(n, room[s] - used[s])
            want.append((d, at, m, s, used[s]))
            used[s], spent[s], at, n = used[s] + m, spent[s] + m + m * m / 1024, at + m, n - m
    assert got == want and used == room


def test_packing_asks_the_tokenizer_for_many_words_at_once():
    import random

    ids = packing.Ids(packing.tokenizer_source())
    own, asked = ids.tokenizer, []

    class Counting:
        def encode_batch_fast(self, some, **options):
            asked.extend(some)
            return own.encode_batch_fast(some, **options)

        def encode(self, text, **options):
            return own.encode(text, **options)

    ids.tokenizer = Counting()
    plain = [" ".join(f"Wörd{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + j)}x{k % 10}, end." for k in range(600)) for j in range(5)]
    assert [x.tolist() for x in ids.encode(plain)] == [own.encode(t, add_special_tokens=False).ids for t in plain]
    assert len(asked) < 20  # 3000 words and more
    # Any characters, with a cache that is too small for the words of one call.
    ids.words = packing.Recent(50)
    random.seed(3)
    odd = ["".join(random.choice("abcXéÜß 09'!?.,<|>\n\t́中кЖΣς 　\x0b\x00\U0001f600½") for _ in range(random.randint(0, 50))) for _ in range(500)]
    odd += ["", " \t", "a<|endoftext|>b", " ", "x" * 3000 + "!" * 300]
    for _ in range(2):
        assert [x.tolist() for x in ids.encode(odd)] == [own.encode(t, add_special_tokens=False).ids for t in odd]


def test_licences_words_of_a_template_are_no_notice(make_docs):
    """Lines of which a model knows one word alone, whatever background the corpus gives."""
    from random import Random

    random = Random(5)
    own = ["".join(random.choice("aeiourstlnmdc") for _ in range(random.randint(3, 9))) for _ in range(3000)]
    rows = [(k, " ".join(random.sample(own, 6) + [random.choice(("no", "any", "by", "mit", "all"))] + random.sample(own, 6)), "es") for k in range(400)]
    rows += [(1000 + k, ts[0], "en") for k, ts in enumerate(licences.TEMPLATES.values())]
    model, found = scanned(make_docs(rows))
    assert {(i, f) for (i, _), (f, _) in found.items()} == {(1000 + k, f) for k, f in enumerate(licences.TEMPLATES)}
    first = licences.LicenceModel([])
    assert all(first.predict(licences.grams(t))[0] == licences.UNKNOWN for i, t, _ in rows if i < 1000)


def test_licences_find_notices_in_long_lines(make_docs):
    other = " ".join(licences.EVERYDAY[::-1] + licences.EVERYDAY)
    notices = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts if len(licences._WORD.findall(t.lower())) > 3]
    rows = [(k, f"{other} {t} {other}", "en") for k, (_, t) in enumerate(notices)]
    broken = licences.TEMPLATES["mpl"][0].split()
    rows += [(100, f"{other} {' '.join(broken[:8])}\n{' '.join(broken[8:])} {other}", "en"), (101, other, "en")]
    found = scanned(make_docs(rows))[1]
    assert {i: f for (i, _), (f, sure) in found.items() if sure} == {k: f for k, (f, _) in enumerate(notices)} | {100: "mpl"}
    assert (100, 0) in found and (100, 1) in found


def test_bpe_cuts_equal_segments_once():
    from random import Random

    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = bpe.public_vocabulary()
    library = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own, calls = bpe.Coder(ranks, pattern), []
    find = own.find
    own.find = lambda text: calls.append(text) or find(text)
    random = Random(6)
    texts = [" ".join(f"wörd{random.randint(0, 3000)}, it's" for _ in range(400)) for _ in range(20)]
    ids = [library.encode_ordinary(t) for t in texts]
    assert own.documents(texts) == [(len(i), ",".join(map(str, i)).encode(), t.encode()) for i, t in zip(ids, texts, strict=True)]
    assert len(calls) < 50  # of more than 2000 segments
    # Any white space at any place, with a cache that is too small for the words of one call.
    own.words.most = 20
    odd = ["".join(random.choice("abé0 '.\n\t\x1c\x85 　中\x00\U0001f600") for _ in range(random.randint(0, 40))) for _ in range(600)]
    for some in (odd, odd[:100], ["", " ", "a\n"], []):
        ids = [library.encode_ordinary(t) for t in some]
        assert own.documents(some) == [(len(i), ",".join(map(str, i)).encode(), t.encode()) for i, t in zip(ids, some, strict=True)]
