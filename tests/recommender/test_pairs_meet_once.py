"""Merging and the frame of signals deal the pairs of users and items once."""

from tidewalk.operators import ranking, retrieval


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_merging_deals_rows_once(spark):
    rows = {"content": [(1, 1, 0.5), (1, 1, 0.75), (1, 2, float("nan"))], "collaborative": [(1, 1, 0.25)], "popular": [(2, 1, 1.0)], "exploration": [(1, 2, 0.1)]}
    merged = ranking.merge_candidates({k: spark.createDataFrame(v, "user_id long, project_id long, signal double") for k, v in rows.items()})
    assert _exchanges(merged) == 1
    got = {(r.user_id, r.project_id): (r.sources, r.signals) for r in merged.collect()}
    assert got == {(1, 1): (["content", "collaborative"], {"content": 0.75, "collaborative": 0.25}), (2, 1): (["popular"], {"popular": 1.0}), (1, 2): (["exploration"], {"exploration": 0.1})}


def test_the_frame_deals_scores_once(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    users, catalog = frame([(1, 0.5), (2, 0.5)], "user_id long, e double"), frame([(1, "a", 0.1), (2, "b", 0.2), (3, "c", 0.3)], "project_id long, slug string, prior double")
    popularity = frame([(1, 0.9), (2, 0.5), (3, 0.1)], "project_id long, popularity double")
    affinities = frame([(1, 1, 0.4), (2, 1, -0.2)], "user_id long, project_id long, affinity double")
    collaborative, popular = frame([(1, 2, 0.7)], "user_id long, project_id long, collaborative double"), frame([(1, 3), (2, 1)], "user_id long, project_id long")
    gone = frame([], "user_id long, project_id long")
    out = retrieval.item_signals(users, catalog, popularity, affinities, collaborative, popular, gone)
    got = {(r.user_id, r.project_id): (r.affinity, r.collaborative) for r in out.collect()}
    assert got == {(1, 1): (0.4, None), (1, 2): (0.0, 0.7), (1, 3): (0.0, None), (2, 1): (-0.2, None)}
    # scores of pairs are not joined back to the pairs they came from
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3


def test_candidates_are_rows_of_the_frame(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    users, catalog = frame([(1, 0.5)], "user_id long, e double"), frame([(k, f"{k:03}", 0.1) for k in range(60)], "project_id long, slug string, prior double")
    popularity = frame([(k, 0.5) for k in range(60)], "project_id long, popularity double")
    affinities = frame([(1, k, 1 - k / 100) for k in range(60)], "user_id long, project_id long, affinity double")
    collaborative, popular = frame([(1, 2, 0.7), (1, 3, 0.9)], "user_id long, project_id long, collaborative double"), frame([(1, 59)], "user_id long, project_id long")
    gone, session = frame([(1, 0), (1, 99)], "user_id long, project_id long"), frame([(1, 5, 0.25)], "user_id long, project_id long, session double")
    rows = retrieval.item_signals(users, catalog, popularity, affinities, collaborative, popular, gone, gone, session)
    out = retrieval.with_places(rows)
    got = {r.project_id: r for r in out.collect()}
    assert len(got) == 60 and got[0].excluded and got[0].saved and got[0].content_place is None and got[5].session == 0.25 and got[59].popular
    assert [k for k in got if got[k].content_place] == [k for k in got if 1 <= k <= 50] and got[1].content_place == 1
    assert {k: got[k].collaborative_place for k in (2, 3, 4)} == {2: 2, 3: 1, 4: None}
    listed = {r.project_id: r["rank"] for r in retrieval.exploration_candidates(rows, gone).collect()}
    assert listed == {k: r.exploration_place for k, r in got.items() if r.exploration_place} and len(listed) == 12
    # places cost no join
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(out) == joins(rows)
