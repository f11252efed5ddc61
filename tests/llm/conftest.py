import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, label long, starts string, k1 long, cls long, part int, key string"
#: Extra columns have names that operators use for their own.
EXTRA = (9.5, "kept", 7, "s", 3, 4, 5, "k")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang, "src", None if t is None else len(t), *EXTRA) for i, t, lang in rows], DOCS).repartition(3)

    return make


def words(n, salt=0):
    return [f"w{salt}x{k}" for k in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, repeated rows and ids, near copies, shared passages, a long text."""
    base, shared = words(120), words(60, 9)
    near = base[:60] + ["other"] + base[61:]
    return [
        (1, " ".join(base), "en"),
        (2, " ".join(near).upper(), "en"),
        (2, " ".join(near).upper(), "en"),
        (3, None, None),
        (None, "a few words only here", "en"),
        (4, "", "de"),
        (5, " \t\n ", "de"),
        (6, "a few words", None),
        (7, "A FEW\u00a0words", "fr"),
        (8, "a few words", "en"),
        (9, " ".join(words(40, 1) + shared + words(30, 2)), "en"),
        (10, "\n".join(words(35, 3) + shared + words(20, 4)), "en"),
        (11, " ".join(["same"] * 90), "es"),
        (12, " ".join(words(6000, 5) + base[:50]), "en"),
        (13, "Ünïcödé \U0001f600 text — 12345 don't", "de"),
    ]
