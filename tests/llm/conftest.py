import pytest

# Nulls, empty and long texts, ties, repeated rows, and columns that clash with names used inside.
EDGES = [
    (0, "One two three four five six seven eight nine ten.\nAll rights reserved.", "en", "a"),
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, "   \n\t ", "fr", None),
    (4, "One two three four five six seven eight nine ten.\nAll rights reserved.", "en", "b"),
    (4, "One two three four five six seven eight nine ten.\nAll rights reserved.", "en", "b"),
    (4, "another text under the same id", "en", "b"),
    (None, "a row without an id", "en", "b"),
    (None, None, None, None),
    (7, "x" * 30_000, "de", "c"),
    (8, ("la plume de ma tante est sur le bureau " * 2_000).strip(), "fr", "c"),
    (9, "漢字かな交じり文 𝔘𝔫𝔦   é", "ja", "c"),
    (5000, "die Katze sitzt auf der Matte und schläft den ganzen Tag", "de", "a"),
    (9000, "la plume de ma tante est sur le bureau", "fr", "a"),
    (-5, "12345 67890 !!!", "es", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
CLASHES = ["_row", "words", "_words", "_fp", "fingerprint", "component_id", "sketch", "block", "position", "copy",
           "ids", "lang_pred", "line", "class_id", "_hash", "a", "b", "n"]


@pytest.fixture(scope="session")
def edges(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame(EDGES, SCHEMA)
    return docs.select("*", *[F.lit(k).alias(name) for k, name in enumerate(CLASHES)]).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
