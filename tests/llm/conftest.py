import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, blob string, size long, key long, rank long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text, lang, source), with extra columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "x", -1, -1, -1) for i, t, g, s in rows], SCHEMA)

    return make


WORDS = "the of and to river stone light night water under over small green house walk talk run sing bring thing about later never".split()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    import random

    r = random.Random(4)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n)) + "."
    long = "\n".join(say(30) for _ in range(2000))
    same = "\n".join(say(25) for _ in range(4))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, long, "en", "a"), (5, same, "en", "b"), (6, same, "en", "b"), (6, same, "en", "b"), (None, same, "en", "b"), (None, None, None, None)]
    rows += [(None, None, None, None), (7, "word", "fr", None), (8, "😀 é ñ" * 3, "fr", "c"), (9, "1234 5678", "de", "c")]
    rows += [(100 + i, "\n".join(say(12) for _ in range(6)), ("en", "fr", None)[i % 3], ("a", "b", "c", None)[i % 4]) for i in range(60)]
    return rows
