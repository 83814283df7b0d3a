import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (doc_id, text, source) rows."""
    def make(rows, parts=3):
        out = []
        for i, r in enumerate(rows):
            doc_id, text, source = r if isinstance(r, tuple) else (i, r, f"s{i % 3}")
            out.append((doc_id, text, "en" if source else None, source, None if text is None else len(text)))
        return spark.createDataFrame(out, DOCS).repartition(parts)
    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: null, empty, blank, long, repeated, odd white space and scripts
EDGE_TEXTS = [None, "", " ", "\n\t ", "a", "word", "Hello hello  HELLO\nworld", " lead", "trail ", "x y z w",
              "<|endoftext|> mid <|endoftext|>end", "it's we'll  can't\r\n\r\nstop", "日本語 テキスト です", "՘ ẞ \U0001f600 ok",
              "a" * 5000, "lorem ipsum dolor " * 3000, "same text here again", "same text here again"]


@pytest.fixture(scope="session")
def edge_docs(spark, make_docs):
    from pyspark.sql import functions as F
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "same text here again", "s1"), (5, "word", None), (5, "word", None)]
    df = make_docs(rows)
    for c in ("n_tokens", "fp", "size", "key", "kept", "score", "spans", "value", "node"):
        df = df.withColumn(c, F.lit("clash"))
    return df
