import pytest

#: Extra columns whose names clash with those that operators make.
CLASH = "n_words long, sequence_id long, offset long, weight double, row long, kept boolean, word string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text, lang, source, n_chars) plus clashing columns, in several partitions."""

    def make(texts, parts=3):
        rows = [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 2}" if (i or 0) % 5 else None, None if t is None else len(t),
                 1, 2, 3, 0.5, 4, False, "w") for i, t in texts]
        df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
        return df.repartition(parts)

    return make


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "no id here"), (6, "é ß 世界 " * 40),
        (7, "very long " * 30_000), (8, "a b c\n" * 60), (9, "<|endoftext|> and   more\n\n text")]


@pytest.fixture(scope="session")
def edge(docs_of):
    return docs_of(EDGE)
