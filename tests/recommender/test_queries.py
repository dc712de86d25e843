"""Registered queries against their SQL on the smallest tables, and the streams against batches."""

import os

import duckdb
import pytest

import __spark_entry__
from tidewalk import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
CHECKED = ["interactions_view", "project_states", "long_term_profile", "popularity_candidates", "similar_projects", "session_confidence", "eval_metrics", "stream_popularity", "stream_sessions", "run_detail", "recommendation_context", "catalog_problems", "onboarding_upsert", "stream_session_service", "unseen_content", "rolling_signals", "catalog_changes", "settings_upsert", "item_similarity", "eval_split_fingerprint"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    df = queries.queries()[name](spark, FOLDER)
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want and want


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.text and r.primary for r in rows) and len({(r.user_id, r.final_rank) for r in rows}) == len(rows)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["stream_session_service", "stream_sessions", "stream_popularity", "stream_impressions"])
def test_streams_over_a_folder_of_parts(spark, tmp_path, name):
    """Tables of several files, in no order of time, give what single files give."""
    for table in ("events", "part"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = [sorted(map(repr, queries.queries()[name](spark, folder).collect())) for folder in (FOLDER, str(tmp_path))]
    assert rows[0] == rows[1] and rows[0]
