import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


#: null and empty texts, ties, repeated rows, a clashing extra column, a null id
@pytest.fixture(scope="session")
def odd_documents(spark):
    rows = [
        (1, None, "en", "a", 0, "x"),
        (2, "", None, "a", 0, "x"),
        (3, "   \n\t ", "en", None, 5, "x"),
        (4, "one", "en", "a", 3, None),
        (5, "two words", "fr", "a", 9, "x"),
        (6, "the same short text again", "en", "a", 25, "x"),
        (7, "the same short text again", "en", "a", 25, "x"),
        (7, "the same short text again", "en", "a", 25, "x"),
        (None, "the same short text again", "en", "a", 25, "x"),
        (9, "long " * 30_000, "en", "a", 150_000, "x"),
        (10, "\x00 odd ▁ signs \U0001f600 éあ a@b.c +1 234 567 890 1.2.3.4", "de", "b", None, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
