import pytest

SCHEMA = "doc_id long, text string, lang string, key long, _id string, length int, size long"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) rows, with columns whose names the operators use inside."""

    def make(*rows):
        return spark.createDataFrame([(i, t, "en", 1, "x", 2, 3) for i, t in rows], SCHEMA)

    return make


#: Null, empty and blank texts, repeated rows, ties and a null id.
ODD = [(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (4, "one"), (5, "Ünïcode  line\n\nline two\n"), (None, "no id here at all today"), (6, "a b c d e f g"), (7, "A B c d e f G")]


@pytest.fixture
def odd():
    return list(ODD)
