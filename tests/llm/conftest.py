import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def messy_rows():
    long_text = " ".join(f"word{i % 977} tail{i % 31}." for i in range(60_000))
    same = "The same line stands here, and here it stands again.\n" * 3
    return [
        (1, "One plain document. It has two sentences.", "en", "a", 41),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \t\n \x0b\x0c\r ", "en", "b", 8),
        (5, same, "en", "b", len(same)),
        (5, same, "en", "b", len(same)),
        (5, "Another text under an id that is taken.", "en", "a", 39),
        (None, "A text without an id.", "en", None, 21),
        (None, "A text without an id.", "en", "c", 21),
        (6, long_text, "en", "c", len(long_text)),
        (7, "Ünïcödé wörds, 漢字 and 🙂 emoji\u00a0here.\n\nA new section.", "de", "a", 49),
        (8, "x", "en", "b", 1),
        (-9, "x", "en", "b", 1),
    ]


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with NULLs, empty and long texts, ties and repeats, and further columns with names in use elsewhere."""
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    docs = spark.createDataFrame(messy_rows(), SCHEMA)
    extra = ("id", "row", "fp", "key", "kept", "head", "bucket", "clean", "size", "rule", "words", "copies", "nth", "f", "start", "partner")
    return docs.select("*", *[F.lit(k).alias(name) for k, name in enumerate(extra)])


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
