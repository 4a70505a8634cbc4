import pytest
from pyspark.sql import SparkSession

from postlake.ship import ship


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty columns, a long text, ties and a repeated row.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 3),
    (4, "plain words in a row " * 3, "en", None, 60),
    (5, "plain words in a row " * 3, "en", "a", 60),
    (5, "plain words in a row " * 3, "en", "a", 60),
    (None, "no id here", "en", "b", 10),
    (6, "word " * 60_000, "en", "b", 300_000),
    (7, "𝒜 emoji 😀 and ﬁ ligature İ", None, "b", 20),
    (8, "x" * 100_000, "en", "c", 100_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("copy", "shuffle_key", "fp", "drawn", "drawn_cdf", "node", "score", "predicted", "Key", "length", "_text", "v", "bucket", "spans")
    return odd.withColumns({n: F.lit("own") for n in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
