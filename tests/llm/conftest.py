import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, key string, part int, copies int, text_hash long, pivot int"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strong coffee near old stone bridges"


def rows():
    """Nulls everywhere, empty and blank and long texts, repeated rows and ids, clashing column names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    texts = [None, "", " \n\t ", "one", WORDS, WORDS, WORDS.replace("lazy", "idle"), long, "a\n\nb\na", "mail x@y.com now", "ünïcödé ßtraße 中文 😀 é", "A" * 5000]
    out = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None, 1, 2, "k", 3, 4, 5, 6) for i, t in enumerate(texts)]
    out += [(None, WORDS, "en", "src1", 5, 1, 2, None, 3, 4, 5, 6), (4, WORDS, None, "src1", 5, 1, 2, "k", 3, 4, 5, 6), (4, WORDS, None, "src1", 5, 1, 2, "k", 3, 4, 5, 6), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SHAPE).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)
