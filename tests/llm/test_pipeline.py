"""The pipeline's stages over odd rows, and each deduplicating stage against brute force."""

import re
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from test_joins import WORD, brute_components  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_take_odd_rows_and_keep_columns(spark, make_docs, odd_rows):
    for rows in (odd_rows, []):
        docs = make_docs(rows)
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.dtypes == docs.dtypes, name
            assert all(r["keep"] == "kept" and r["k1"] == 3 for r in out.select("keep", "k1").collect()), name


def test_one_of_each_group(spark, make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    kept = Counter(r["doc_id"] for r in pipeline.one_of_each_group(spark, make_docs(rows), SF).select("doc_id").collect())
    assert kept == Counter({c: 1 for _, _, c in brute_components(rows)})


def test_unrelated_texts_of_one_id_both_stay(spark, make_docs):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(2, a, "en"), (2, b, "en"), (3, a + " more", "en"), (2, a, "en")]
    kept = [tuple(r) for r in pipeline.one_of_each_group(spark, make_docs(rows), SF).select("doc_id", "text").collect()]
    assert sorted(kept) == [(2, a), (2, b)]


def test_texts_without_repeats(spark, make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    all_words = [WORD.findall(t or "") for _, t, _ in rows]
    times = Counter(tuple(w[k : k + 35]) for w in all_words for k in range(len(w) - 34))
    want = Counter()
    for (i, t, _), w in zip(rows, all_words, strict=True):
        gone = {j for k in range(len(w) - 34) if times[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        text = t if not gone else " ".join(x for j, x in enumerate(w) if j not in gone)
        if text is not None and (text or not gone):
            want[(i, text, len(text))] += 1
    got = Counter(tuple(r) for r in pipeline.without_repeats(spark, make_docs(rows), SF).select("doc_id", "text", "n_chars").collect())
    assert got == want


def test_quality_and_language_stages_by_brute_force(spark):
    """Each document by itself, with the models that the stage's own input gives."""
    from lectern.llm import language, quality
    from test_texts import brute_language

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, scorer = quality.fit(docs.select("doc_id", "text"))
    rows = docs.collect()
    want = {r["doc_id"] for r in rows if (r["text"] or "").split() and scorer.score(r["text"]) >= quality.CUT}
    kept = pipeline.good_quality(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == want
    judged = brute_language([(r["doc_id"], r["text"], r["lang"]) for r in rows], language.LENGTH)
    want = {i for i, (_, lang, score) in judged.items() if lang != language.UNKNOWN and score >= pipeline.LEAST_LANGUAGE_SCORE}
    assert {r["doc_id"] for r in pipeline.known_language(spark, docs, SF).collect()} == want


def test_packing_stage_of_odd_rows(spark, make_docs, odd_rows):
    import tokenizers
    import public_tokenizers

    own = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    total = Counter()
    for r in pipeline.packed(spark, make_docs(odd_rows), SF).collect():
        total[r["doc_id"]] += r["length"]
    want = Counter()
    for i, t, _ in odd_rows:
        want[i] += len(own.encode(t or "", add_special_tokens=False).ids) + 1
    assert total == want
    assert pipeline.packed(spark, make_docs([]), SF).count() == 0


def test_run(spark):
    rows = pipeline.run(spark, SF).collect()
    total = {(r["doc_id"], r["doc_tokens"]) for r in rows}
    assert len(total) == len({r["doc_id"] for r in rows})
    assert sum(r["length"] for r in rows) == sum(n for _, n in total)


def test_names_and_order():
    assert [name for name, _ in pipeline.STAGES] == ["quality", "language", "near duplicates", "repeated passages", "packing"]
    assert re.search("Each stage", pipeline.__doc__)
