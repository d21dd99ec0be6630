import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])

EN = "the cat and the dog were in the house with a bird and they would not go out that day because of rain"
DE = "der hund und die katze waren nicht im haus weil das wetter schlecht war und sie wollten schnell hinein"

#: Nulls in every column, empty and odd texts, repeated rows, a very long text.
EDGE_ROWS = [
    (1, EN + " token = \"aB3dE9fGh2KlMn0PqRsT\" and joe.7@mail.example.com", "en", "s", 5),
    (2, None, "en", None, None),
    (3, "", None, "s", 0),
    (None, DE, "de", "s", 3),
    (None, None, None, None, None),
    (4, "ééé \U0001F600 中文 + 1 2 3 \n\n\t ", "de", "s", 9),
    (5, "*** --- 123 !!!", "en", "s", 9),
    (6, EN, "en", "s", 1),
    (6, EN, "en", "s", 1),
    (7, EN, "en", "t", 1),
    (8, (EN + "\n") * 20000, "en", "s", 1),
    (9, "x" * 300000 + " 1" + "7" * 100000, "en", "s", 1),
    (10, "A.", "en", "s", 2),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(EDGE_ROWS, DOCUMENTS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small_docs(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


@pytest.fixture(scope="session")
def exact_encoding():
    import base64

    import public_tokenizers as P
    import tiktoken
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
