import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, digest string, kept string, row string"

PASSAGE = " ".join(f"word{i}" for i in range(60))


def rows():
    """Nulls, empty and blank texts, ties, rows repeated in full, one id with two texts, near copies, long texts, odd characters."""
    base = "\n".join(f"the line number {i} of a document with its own words {i * i}" for i in range(12))
    texts = [
        (1, base), (2, base), (3, base.replace(" ", "  ")), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "x" * 300 + PASSAGE),
        (9, PASSAGE + " and its own end"), (10, base + "\nmore"), (11, "ÀÉß中文🙂 " * 80), (12, "ÀÉß中文🙂 " * 80 + "z"), (13, "idiot <|endoftext|> a  b   c\t\td" + "\n" * 4),
        (14, base.upper()), (15, " ".join(f"w{i % 7}" for i in range(9000))), (None, base), (None, None), (7, "one two"), (16, "one two"), (7, "other text of the same id"),
    ]
    return [(i, t, "en" if i != 5 else None, f"s{(i or 0) % 3}" if i != 4 else None, len(t or ""), "n", "d", "k", "r") for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.range(1, 17).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
