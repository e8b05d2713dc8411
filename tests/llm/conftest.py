import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, ids string, decoded string, n_bytes string, n_tokens string, lang_pred string, score string, tails string, grade string, fingerprint string, component_id string, mix_pass string, key string, payload string, media string, feature string"


def edge_rows():
    long = "word " * 60_000 + "é" * 30_000
    return [
        (1, "plain words that say something plain", "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, "   \n\t ", "fr", "b", 6),
        (5, long, "en", "a", len(long)), (6, "x" * 120_000, None, "b", 120_000), (7, "plain words that say something plain", "en", "a", 1),
        (8, "1234 !!! 5678", "en", "a", 13), (9, "日本語 текст <|endoftext|> 🙂", None, "c", 5), (10, "un deux trois quatre cinq", "fr", "b", 9),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, equal texts and repeated rows."""
    rows = edge_rows()
    return spark.createDataFrame([*rows, rows[0], rows[9]], SCHEMA)


@pytest.fixture(scope="session")
def clash(spark, edge):
    """The same with clashing extra columns."""
    extra = [c.split()[0] for c in CLASH.split(", ")][5:]
    from pyspark.sql import functions as F

    return edge.select("*", *[F.lit("own").alias(c) for c in extra])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
