"""The registered queries and the pipeline on the smallest driver tables."""

from pathlib import Path

import pytest

import corpus_pipeline
from plumbline.llm import queries
from workload.compare import difference, oracle_connection

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, name):
    connection = oracle_connection(FOLDER)
    sql = queries.ORACLES[name]
    assert difference(spark, connection, FOLDER, queries.QUERIES[name], sql) is None


def test_stages_keep_columns_and_shrink_or_mix(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        path = corpus_pipeline.shared_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0.7 * sizes[0]
    assert corpus_pipeline.STAGES[4][1](spark, docs, FOLDER).count() == sizes[4]
