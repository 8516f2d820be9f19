import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab=300):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows, copies and near copies."""
    rng = random.Random(3)
    long = words(rng, 8000)
    base = words(rng, 300)
    near = base.split()
    near[150] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(near), "en", "a"), (4, None, "fr", "a"), (5, "", None, None), (None, base, "en", None), (None, words(rng, 60), None, "c"),
        (6, long, "de", "a"), (7, long, "de", "a"), (7, long, "de", "a"), (8, " \n\t ", "fr", "b"), (9, "\U0001f600 ümlaut Straße", "de", "b"), (10, "12345 ###", "en", "a"),
    ]
    rows += [(20 + k, words(rng, 40 + 10 * k), "en fr de".split()[k % 3], "abc"[k % 3]) for k in range(30)]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """With columns whose names clash with those that the operators use."""
    df = spark.createDataFrame(odd_rows, DOCS)
    for name in ("size", "key", "h", "fp", "root", "row_", "owner_", "group", "bucket", "block", "score", "target", "doc", "mask", "value"):
        df = df.withColumn(name, df["lang"])
    return df.cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")
