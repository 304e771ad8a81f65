import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """documents with extra columns whose names clash with each other and with names that operators use."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)
        if clash:
            df = df.selectExpr("*", "1 AS TEXT", "2 AS shard", "3 AS score", "4 AS lang_pred", "5 AS n", "6 AS component_id", "7 AS pos", "8 AS shard")
        return df

    return make


#: Null, empty, blank, repeated and very long texts; a null doc_id.
EDGES = [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (4, "one"), (5, "one"), (None, "a b c d e f"), (7, "word " * 30000), (8, "x" * 200000), (9, "line\n" * 5000), (10, "1234 !!"), (11, "É  ß 漢字 \U0001f600")]
