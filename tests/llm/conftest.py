import os

import pytest

from llm.edge import edge_rows, prose


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The edge rows with extra columns whose names clash with added ones."""
    rows = [(i, t, "en", "s", 0, 7.5, "old") for i, t in edge_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "score double, kept string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory, edge_docs):
    """A folder of tables as the queries read them, from the edge rows."""
    at = str(tmp_path_factory.mktemp("edge"))
    plain = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.coalesce(2).write.parquet(os.path.join(at, "documents.parquet"))
    spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(1, 15)] + [(None, 1, 0), (3, None, None)],
                          "doc_id long, quality int, toxic int").write.parquet(os.path.join(at, "labels.parquet"))
    spark.createDataFrame([(0, prose(80, 1)), (1, None), (2, "one two"), (3, ""), (None, prose(40, 2)), (0, prose(80, 1))],
                          "item_id long, text string").write.parquet(os.path.join(at, "benchmark.parquet"))
    return at
