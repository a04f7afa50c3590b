import random

import pytest

from tests.conftest import SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


#: Columns that clash with names the operators use inside.
CLASHING = "key long, n long, part int, score double, fp long, label string, shard int, keep_id long, _row int, text_sha256 string, lang_pred string, component string, _leaked string, _kept_id string, _text string, shard_region int, shard_rack int, kinds int, part_ string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(5)
    words = ["alpha", "beta,", "Gamma", "delta.", "Élan", "über", "naïve", "x1", "password=abcdef12", "AKIA" + "Q" * 20, "0123456789abcdef01234567"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [
        (1, "same text here", "en", "a"), (2, "same text here", "en", None), (2, "same text here", "en", None), (3, None, None, "a"), (4, "", "en", "a"), (5, " \n\t ", "fr", "a"),
        (6, "123 !!! ???", "en", "a"), (7, long, "en", "a"), (8, long + " end", "en", "a"), (9, "é", "fr", "b"), (10, "tok  two   spaces \n x <|endoftext|> y", "en", "b"),
        (None, "no number", "en", "b"), (-5, "negative number", "de", "b"), (11, "Emoji 😀 token: 'abc😀def' secret = \"s3cr3t-value\"", "de", "b"),
    ]
    filler = (None, 7, 1, 0.5, 3, "l", 2, 9, 4, "z", "qq", "c", "d", "e", "f", 5, 6, 8, "g")
    return spark.createDataFrame([(*r, *filler) for r in rows], "doc_id long, text string, lang string, source string, " + CLASHING).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
