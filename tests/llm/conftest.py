import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word(rng):
    return "".join(rng.choice(["th", "er", "an", "ou", "ing", "é", "st", "ha"]) for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="session")
def texts():
    """Plain, copied, nearly copied, odd, empty, missing and long texts."""
    rng = random.Random(4)
    base = [" ".join(word(rng) for _ in range(rng.randint(1, 160))) for _ in range(60)]
    passage = " ".join(word(rng) for _ in range(60))
    out = list(base)
    out += [base[3], base[3], base[3] + " more", base[4].upper(), base[5].replace(" ", "\n\t ")]
    out += [passage, f"one {passage} two", f"{base[7]} {passage}", f"{passage} {passage}"]
    out += ["", None, "   \t\n", " ", "a", "a b", "x" * 5000, " ".join(["same"] * 400), "日本 語 🙂 \x00 z", base[8] + " " + base[9]]
    out += [" ".join(word(rng) for _ in range(30_000))]
    return out


@pytest.fixture(scope="session")
def rows(texts):
    sources = ["web", "book", None, "code"]
    out = [(i, t, "en", sources[i % 4] if i % 3 else "web", len(t or "")) for i, t in enumerate(texts)]
    return out + [out[10], (None, "no id at all here", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def crowded(docs):
    """The same rows with further columns, named like those the operators make."""
    from pyspark.sql import functions as F

    names = ("score", "spans", "fp", "key", "n", "row", "size", "target", "copies", "component_id", "chunk", "bucket", "html", "label", "id", "n_words", "n_tokens", "root", "of", "kind")
    return docs.select("*", *[F.lit("odd").alias(c) for c in names])
