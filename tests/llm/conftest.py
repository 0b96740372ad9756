import pytest
from pyspark.sql import functions as F

#: Texts with what operators meet at the edges: null, empty, blanks, no letter, repeats, a special
#: token, other scripts, one long run without blanks, one very long text.
EDGES = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a"),
    (3, "THE QUICK brown fox jumps over the lazy dog and runs away.", None, "b"),
    (4, None, "en", None),
    (5, "", None, "b"),
    (6, "  \n\t ", "fr", "b"),
    (7, "12345 67890 !!! ???", "fr", "a"),
    (8, "le renard brun saute par dessus le chien paresseux et s'en va", "fr", "a"),
    (9, "a<|endoftext|>b it's 漢字 𠮷 é\r\n\r\n  x　y ▁z", "fr", "b"),
    (10, "xyz" * 3000, "en", "b"),
    (11, " ".join(f"word{i % 977}" for i in range(30000)), "en", "a"),
    (None, "no key here at all", "en", "a"),
    (12, "one two", "en", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string"
#: Columns whose names operators use themselves, for results or inside.
CLASHES = ["row", "k", "t", "sha", "kept", "n", "place", "shard", "score", "n_tokens", "file", "bucket", "path", "p"]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, COLUMNS)


@pytest.fixture(scope="session")
def clashing(edges):
    return edges.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
