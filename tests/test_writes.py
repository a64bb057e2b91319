"""Queries that change one file, against their SQL, where there is no such file."""

import duckdb
import pytest
from pyspark.sql import functions as F

from arbor.plans import registry
from arbor.sources.adapter import _TABLES
from tests.test_queries import D, plain

ON_ONE_FILE = ["apply_chmod", "apply_link_unlink", "apply_edit", "apply_rename", "apply_setattr", "apply_write"]


@pytest.fixture(scope="module")
def without(spark, tmp_path_factory):
    """A folder whose documents lack the one that the queries change."""
    folder = tmp_path_factory.mktemp("without")
    spark.read.parquet(f"{D}/documents.parquet").where(F.col("doc_id") != 1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ON_ONE_FILE)
def test_a_file_that_is_not_there_is_not_changed(spark, without, name):
    con = duckdb.connect()
    for t in _TABLES:
        con.execute(f"create view {t} as select * from '{f'{without}/{t}.parquet/*.parquet' if t == 'documents' else f'{D}/{t}.parquet'}'")
    df = registry.queries()[name](spark, str(without))
    found = con.execute(registry.oracle_sql()[name]).df()[df.columns]
    assert sorted(str([plain(x) for x in r]) for r in df.collect()) == sorted(str([plain(None if x != x else x) for x in r]) for r in found.astype(object).itertuples(index=False))
    assert not df.where(F.col("path").endswith("/doc-1.txt")).count()
