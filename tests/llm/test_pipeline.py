"""The corpus pipeline on a small corpus with planted cases, and the registered queries against their SQL."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from tidewalk.llm import queries

FOLDER = "/root/testdata/sf0.001"


EXTRA = "_id string, _th long, lang_pred string, score double, hits string, n_lines long, own map<string,int>"


def _corpus(spark, folder):
    r = random.Random(4)
    vocabulary = {"en": ["the", "river", "stone", "light", "walk", "house", "green", "bird"], "de": ["der", "fluss", "stein", "licht", "gehen", "haus", "grün", "vogel"]}
    text = lambda lang, lines=8: "\n".join(" ".join(r.choice(vocabulary[lang]) + str(r.randrange(50)) * r.randrange(2) for _ in range(12)) for _ in range(lines))
    passage, base, near = text("en", 2), text("en", 12), text("en", 2)
    rows = [(i, text(lang), lang, f"s{i % 4}") for i in range(40) for lang in [r.choice(["en", "de"])]]
    rows += [(100, base, "en", "s1"), (101, base.replace("\n", " \n").replace("river", "rivers", 1), "en", "s2"), (102, passage + "\n" + text("en", 2), "en", "s0"), (103, "12 34 !!", None, "s0"), (104, None, None, None), (105, "", "en", "s1")]
    rows += [(110, base, "en", "s3"), (110, base, "en", "s3"), (111, near, "en", "s0"), (111, near, "en", None), (112, near, "en", "s0"), (112, near + " more", "en", "s0"), (None, near, "en", "s2"), (None, rows[5][1], "en", "s2")]
    rows += [(120, " ".join(r.choice(vocabulary["de"]) for _ in range(60_000)), "de", "s1")]
    rows = [(*x, len(x[1] or ""), "x", 1, None, 0.1, "h", 3, {"k": 1}) for x in rows]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    _corpus(spark, folder)
    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns, everything = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut(stage(spark, docs, folder), name)
        ids.append(sorted(-1 if r.doc_id is None else r.doc_id for r in docs.select("doc_id").collect()))
        assert k == 4 or docs.columns == columns
        if k < 4:
            assert {(r["_id"], r["_th"], r.lang_pred, r.score, r.hits, r.n_lines, r.own["k"], len(r.text)) for r in docs.collect()} == {("x", 1, None, 0.1, "h", 3, 1, r.n_chars) for r in docs.collect()}
    languages = [*range(40), 100, 101, 102, 110, 110, 111, 111, 112, 112, 120, -1, -1]
    assert ids[0] == sorted(languages)
    # null ids come first among lines, so the copy of document 5 without id keeps its lines; copies of 100 lose all of theirs
    lines = [*(i for i in range(40) if i != 5), 100, 101, 102, 111, 111, 112, 112, 120, -1, -1]
    assert ids[1] == sorted(lines)
    near = [*(i for i in range(40) if i != 5), 100, 102, 111, 120, -1]
    assert ids[2] == sorted(near)
    assert ids[3] == sorted(set(near) - {102}) and ids[4] == ids[3]
    assert docs.filter("taken > 0").count() > 30
    assert {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()} == {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, everything.filter("false"), folder).count() == 0, name


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
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
