"""Operators on small frames with numbers worked out by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewalk.config import CONFIG
from tidewalk.functions import scalar
from tidewalk.operators import evaluation, profiles, ranking, retrieval, saved, sessions, states

T0 = dt.datetime(2024, 1, 1)
EVENTS = "id long, user_id long, project_id long, created_at timestamp_ntz, type string"


def _events(spark, rows):
    """rows: (user, project, type, minute)."""
    df = spark.createDataFrame([(k, u, p, T0 + dt.timedelta(minutes=m), t) for k, (u, p, t, m) in enumerate(rows)], EVENTS)
    return df.withColumn("weight", scalar.interaction_weight(F.col("type")))


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def _catalog(spark, rows):
    """rows: (id, tags, hours, prior)."""
    return spark.createDataFrame([(i, f"{i:06d}", f"T{i}", tags, ["go"], "BEGINNER", h, p) for i, tags, h, p in rows], "project_id long, slug string, title string, tag_slugs array<string>, language_slugs array<string>, difficulty string, estimated_hours int, prior double")


def test_states_follow_the_last_event(spark):
    rows = {(r.user_id, r.project_id): r for r in states.project_states(_events(spark, [
        (1, 1, "SAVE", 0), (1, 1, "UNSAVE", 1), (1, 2, "DISLIKE", 0), (1, 2, "SAVE", 1), (1, 3, "SAVE", 0), (1, 3, "DISLIKE", 1), (1, 4, "DISLIKE", 0), (1, 4, "UNSAVE", 1), (1, 5, "IMPRESSION", 0), (1, 5, "BUILD", 2),
    ])).collect()}
    flags = lambda p: (rows[1, p].saved, rows[1, p].disliked, rows[1, p].excluded)
    assert flags(1) == (False, False, False) and rows[1, 1].saved_at is None
    assert flags(2) == (True, False, True) and rows[1, 2].saved_at == T0 + dt.timedelta(minutes=1)
    assert flags(3) == (False, True, True) and flags(4) == (False, True, True)
    assert rows[1, 5].built and rows[1, 5].interaction_count == 2


def test_ties_in_time_go_by_id(spark):
    row = states.project_states(_events(spark, [(1, 1, "SAVE", 0), (1, 1, "UNSAVE", 0)])).first()
    assert not row.saved


@pytest.mark.parametrize("age, want", [(0, 1), (-3, 1), (30, 0.5), (60, 0.25), (float("inf"), 1), (float("nan"), 1)])
def test_decay(spark, age, want):
    assert _one(spark, scalar.time_decay(F.lit(float(age)))) == pytest.approx(want)


def test_decay_needs_a_half_life():
    with pytest.raises(ValueError):
        scalar.time_decay(F.lit(1.0), 0)


@pytest.mark.parametrize("hours, want", [(2, "UNDER_2_HOURS"), (3, "ONE_EVENING"), (5, "ONE_EVENING"), (20, "WEEKEND"), (81, "ONE_TO_TWO_WEEKS")])
def test_buckets(spark, hours, want):
    assert _one(spark, scalar.duration_bucket(F.lit(hours))) == want


def test_clamps_stop_what_is_not_finite(spark):
    for x in (float("nan"), float("inf"), None):
        assert _one(spark, scalar.clamp01(F.lit(x).cast("double"))) == 0
    assert _one(spark, scalar.clamp01(F.lit(2.0))) == 1 and _one(spark, scalar.safe_div(F.lit(1.0), F.lit(0.0))) == 0


def test_fnv1a(spark):
    assert _one(spark, scalar.fnv1a(F.lit("abc"))) == 440920331 and _one(spark, scalar.fnv1a(F.lit(""))) == 2166136261


def test_prose(spark):
    assert _one(spark, scalar.prose_label(F.lit("Machine Learning WebGL"))) == "machine learning WebGL"
    words = lambda *w: F.array(*map(F.lit, w))
    assert _one(spark, scalar.join_natural(words("a", "b", "c"))) == "a, b and c" and _one(spark, scalar.join_natural(words("a", "b"))) == "a and b" and _one(spark, scalar.join_natural(words("a"))) == "a"
    assert _one(spark, scalar.split_paragraphs(F.lit(" a \n\n\n b\nc \n \n"))) == ["a", "b\nc"]
    assert _one(spark, scalar.format_duration(F.lit(8))) == "Weekend · ~8h"


def test_features(spark):
    rows = {r.feature: r.value for r in profiles.item_features(_catalog(spark, [(1, ["a", "b", "a"], 3, 0.5)])).collect()}
    assert rows == {"tag:a": 1.0, "tag:b": 1.0, "lang:go": 0.5, "difficulty:BEGINNER": 0.35, "duration:ONE_EVENING": 0.35}


def test_profile_keeps_signs(spark):
    signals = spark.createDataFrame([(1, "tag:a", 3.0), (1, "tag:b", -4.0), (1, "tag:c", 1e-13)], "user_id long, feature string, signal double")
    rows = {r.feature: r for r in profiles.normalize(signals).collect()}
    assert set(rows) == {"tag:a", "tag:b"} and rows["tag:b"].vector == pytest.approx(-0.8) and rows["tag:a"].strength == pytest.approx(0.75)
    ranked = profiles.rank_features(profiles.normalize(signals), 5).collect()
    assert [(r.feature, r.family_strength) for r in ranked] == [("tag:a", 0.75)]


def test_shrunk_cosine(spark):
    for n, want in ((1, 1 / 3), (2, 1 / 2), (5, 5 / 7)):
        signals = spark.createDataFrame([(u, p, 2.0) for u in range(n) for p in (1, 2)], "user_id long, project_id long, signal double")
        assert retrieval.item_similarity(retrieval.item_pairs(signals)).first().similarity == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("users,items,touched,chunk", [(12, 11, 5, 64), (30, 70, 25, 3)])
def test_leaving_a_user_out_equals_a_model_without_the_user(spark, users, items, touched, chunk, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK", chunk)
    kinds = ["SAVE", "BUILD", "OPEN", "SHARE", "COMPLETE"]
    events = _events(spark, [(u, (u * 7 + k * 3 + u * k % 5) % items, kinds[(u + k) % 5], u * 20 + k) for u in range(users) for k in range(touched)])
    signals = retrieval.collaborative_signals(states.project_states(events))
    nothing = spark.createDataFrame([], "user_id long, project_id long")
    got = {(r.user_id, r.project_id): r.collaborative for r in retrieval.collaborative_scores(signals, retrieval.item_pairs(signals), nothing).collect()}
    own = {}
    for r in signals.collect():
        own.setdefault(r.user_id, {})[r.project_id] = r.signal
    want = {}
    for u, seeds in own.items():
        items = {}
        for v, s in own.items():
            if v != u:
                for p, x in s.items():
                    items.setdefault(p, {})[v] = x
        def sim(i, j):
            a, b = items.get(i, {}), items.get(j, {})
            both = a.keys() & b.keys()
            if not both:
                return 0
            c = sum(a[x] * b[x] for x in both) / math.sqrt(sum(x * x for x in a.values())) / math.sqrt(sum(x * x for x in b.values()))
            return round(c * len(both) / (len(both) + 2), 8)
        raw = {}
        for i, w in seeds.items():
            near = sorted(((-sim(i, j), j) for j in items if j != i and sim(i, j) > 0))[:20]
            for s, j in near:
                if j not in seeds:
                    raw[j] = raw.get(j, 0) - s * w
        top = max(raw.values(), default=0)
        for j, x in raw.items():
            score = x / top * min(1, sum(seeds.values()) / 6)
            if round(score, 9) >= 0.02:
                want[u, j] = score
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want) and len(want) > 20


def test_popularity(spark):
    catalog = _catalog(spark, [(1, ["a"], 3, 0.5), (2, ["a"], 3, 0.0), (3, ["b"], 3, 1.0)])
    evidence = spark.createDataFrame([(1, 20.0), (2, 5.0)], "project_id long, evidence double")
    rows = {r.project_id: r.popularity for r in retrieval.popularity_scores(catalog, evidence).collect()}
    assert rows[1] == pytest.approx(0.8) and rows[2] == pytest.approx(0.6 * math.log1p(5) / math.log1p(20)) and rows[3] == pytest.approx(0.4)
    users, gone = spark.createDataFrame([(7,)], "user_id long"), spark.createDataFrame([(7, 1)], "user_id long, project_id long")
    found = retrieval.popularity_candidates(retrieval.popularity_scores(catalog, evidence), users, gone, 1).collect()
    assert [(r.project_id, r.rank) for r in found] == [(3, 1)]


def test_weights(spark):
    users = spark.createDataFrame([(1, 0.0, False, None, True, True, False), (2, 0.0, True, None, True, False, False), (3, 0.0, False, 0.95, True, False, True)], "user_id long, e double, cold_start boolean, confidence double, has_profile boolean, has_collaborative boolean, has_session boolean")
    rows = {r.user_id: r for r in ranking.ranking_weights(users).collect()}
    assert rows[1].w_content == pytest.approx(0.45 / 0.85) and rows[1].w_session is None
    assert rows[2].w_popularity == pytest.approx(0.3 / 0.8) and rows[2].w_collaborative is None
    assert rows[3].w_session == pytest.approx(0.095 / 0.695, abs=1e-8)


def test_ranking_keeps_absent_signals_apart_from_zero(spark):
    schema = "user_id long, project_id long, slug string, prior double, saved boolean, content double, collaborative double, session double, novelty double, popularity double, w_content double, w_collaborative double, w_session double, w_novelty double, w_popularity double"
    rows = spark.createDataFrame([(1, 1, "a", 0.5, False, 1.0, None, None, 0.5, 0.5, 0.6, 0.2, None, 0.1, 0.1), (1, 2, "b", 0.5, True, 1.0, None, None, 0.5, 0.5, 0.6, 0.2, None, 0.1, 0.1), (1, 3, "c", 0.5, False, float("nan"), 0.0, None, 0.0, 9.0, 0.6, 0.2, None, 0.1, 0.1)], schema)
    out = {r.project_id: r for r in ranking.rank_candidates(rows).collect()}
    assert out[1].score == pytest.approx(0.7) and out[2].score == pytest.approx(0.42) and out[3].score == pytest.approx(0.1)
    assert [out[k]["rank"] for k in (1, 2, 3)] == [1, 2, 3]
    parts = {r.project_id: r for r in ranking.contributions(rows.withColumn("rank", F.lit(1))).collect()}
    assert parts[1].collaborative_part is None and parts[3].collaborative_part == 0


def test_merge_and_filter(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "user_id long, project_id long, signal double")
    merged = ranking.merge_candidates({"content": frame((1, 1, 0.5), (1, 1, 0.7), (1, 9, float("nan"))), "collaborative": frame((1, 2, 0.4)), "popular": frame((1, 1, 0.9)), "exploration": frame((1, 2, 0.1), (1, 3, 0.2))})
    rows = {r.project_id: r for r in merged.collect()}
    assert set(rows) == {1, 2, 3} and rows[1].sources == ["content", "popular"] and rows[1].signals == {"content": 0.7, "popular": 0.9} and rows[2].sources == ["collaborative", "exploration"]
    known = _catalog(spark, [(1, ["a"], 3, 0.5), (3, ["a"], 3, 0.5)])
    gone = spark.createDataFrame([(1, 3), (1, 2)], "user_id long, project_id long")
    assert {r.project_id: r.reason for r in ranking.filter_candidates(merged, known, gone).collect()} == {1: None, 2: "unknown_project", 3: "excluded_state"}


def test_diversified_list(spark):
    rows = [(1, i, s, r, 0.0) for r, (i, s) in enumerate([(1, 0.9), (2, 0.88), (3, 0.86), (4, 0.84), (5, 0.8), (6, 0.78)], 1)]
    ranked = spark.createDataFrame(rows, "user_id long, project_id long, score double, rank int, e double")
    features = spark.createDataFrame([(i, f, 1.0) for i, tags in ((1, "ab"), (2, "ab"), (3, "ac"), (4, "ad"), (5, "xy"), (6, "z")) for f in [f"tag:{t}" for t in tags]], "project_id long, feature string, value double")
    out = ranking.diversify(ranked, features, 4).orderBy("final_rank").collect()
    assert [r.project_id for r in out[:3]] == [1, 3, 5] and len(out) == 4 and all(r.applied for r in out) and out[1].mmr == pytest.approx(0.724)
    assert {r.score for r in out} <= {x[2] for x in rows}
    short = ranking.diversify(ranked.filter("rank <= 2"), features, 4).orderBy("final_rank").collect()
    assert [r.project_id for r in short] == [1, 2] and not short[0].applied and short[0].mmr == pytest.approx(0.81)
    assert _one(spark, scalar.diversification_lambda(F.lit(0.35))) == pytest.approx(0.83)
    assert [_one(spark, scalar.max_items_per_tag(n, F.lit(e))) for n, e in ((10, 0.0), (10, 1.0), (3, 1.0))] == [5, 3, 2]


def test_sessions(spark):
    events = _events(spark, [(1, 1, "OPEN", 0), (1, 1, "OPEN", 30), (1, 2, "SAVE", 61), (2, 1, "OPEN", 0)])
    cut = sessions.sessionize(events, 30)
    assert [r.session_no for r in cut.filter("user_id = 1").orderBy("id").collect()] == [1, 1, 2]
    active = sessions.active_sessions(sessions.sessions(cut), "2024-01-01 01:31:00", 30).collect()
    assert [(r.user_id, r.session_no) for r in active] == [(1, 2)] and active[0].expires_at == T0 + dt.timedelta(minutes=91)
    forced = sessions.sessionize(events.withColumn("new", F.col("id") == 1), 30, "new")
    assert [r.session_no for r in forced.filter("user_id = 1").orderBy("id").collect()] == [1, 2, 3]


def test_session_evidence_counts_repeats_once(spark):
    rows = _events(spark, [(1, 1, "OPEN", k) for k in range(5)] + [(1, 1, "IMPRESSION", 9), (1, 2, "DISLIKE", 10)])
    r = sessions.session_evidence(rows).first()
    assert (r.meaningful, r.evidence) == (6, 3.5)
    profile = spark.createDataFrame([(1, f"tag:{c}", s) for c, s in zip("abcd", (4.0, -3.0, 2.0, 1.0))] + [(1, "lang:x", 50.0)], "user_id long, feature string, signal double")
    assert sessions.coherence(profile).first().coherence == pytest.approx(0.9)
    c = sessions.session_confidence(spark.createDataFrame([(1, 7, 24.0)], "user_id long, meaningful long, evidence double"), profile).first()
    assert c.evidence_confidence == pytest.approx(24 / 28) and c.confidence == pytest.approx(24 / 28 * 0.95) and c.blend_weight == pytest.approx(0.45 * c.confidence)


def test_blend(spark):
    profile = lambda *rows: spark.createDataFrame(list(rows), "user_id long, feature string, vector double")
    weight = spark.createDataFrame([(1, 0.45), (2, 0.3)], "user_id long, blend_weight double")
    rows = {(r.user_id, r.feature): r.vector for r in sessions.blend(profile((1, "tag:a", 1.0), (3, "tag:c", 1.0)), profile((1, "tag:b", 1.0), (2, "tag:b", 1.0)), weight).collect()}
    assert rows[1, "tag:a"] == pytest.approx(0.55 / math.hypot(0.55, 0.45)) and rows[2, "tag:b"] == 1 and rows[3, "tag:c"] == 1


def test_split_holds_out_the_latest(spark):
    events = _events(spark, [(1, p, "SAVE", p * 10) for p in range(1, 16)] + [(1, 1, "OPEN", 999), (2, 1, "SAVE", 0), (3, 1, "OPEN", 5)])
    case = evaluation.split(events).collect()
    assert [(r.user_id, r.held_out, r.cutoff, r.training_positives) for r in case] == [(1, [13, 14, 15], T0 + dt.timedelta(minutes=130), 12)]
    training = evaluation.target_training(events, evaluation.split(events))
    assert training.agg(F.max("created_at")).first()[0] < case[0].cutoff and {r.project_id for r in evaluation.exclusions(training).collect()} == set(range(1, 13))


def test_metrics(spark):
    cases = spark.createDataFrame([(1, [2, 5]), (2, [7])], "user_id long, held_out array<long>")
    recommended = spark.createDataFrame([("x", 1, p, r) for r, p in enumerate([1, 2, 3, 4, 5], 1)], "algorithm string, user_id long, project_id long, rank int")
    m = evaluation.metrics(recommended, cases).first()
    ndcg = (1 / math.log2(3) + 1 / math.log2(6)) / (1 + 1 / math.log2(3))
    assert m.cases == 2 and m.precision_5 == pytest.approx(0.2) and m.recall_5 == 0.5 and m.hit_10 == 0.5 and m.ndcg_10 == pytest.approx(ndcg / 2, abs=1e-8)
    features = spark.createDataFrame([(p, f"tag:{p % 2}", 1.0) for p in range(1, 6)], "project_id long, feature string, value double")
    assert evaluation.diversity(recommended, features).first().diversity == pytest.approx(6 / 10)
    assert evaluation.format_report([{"algorithm": "x", "ndcg": 0.5}]).splitlines()[1].split() == ["x", "0.500"]


def test_as_of_evidence_stops_before_the_cutoff(spark):
    events = _events(spark, [(1, 1, "SAVE", 0), (2, 1, "BUILD", 10), (3, 1, "OPEN", 10), (2, 1, "DISLIKE", 1)])
    items = spark.createDataFrame([(9, 1, T0 + dt.timedelta(minutes=m)) for m in (0, 10, 11)], "user_id long, project_id long, cutoff timestamp_ntz")
    assert [(r.evidence, r.n_strong) for r in evaluation.evidence_before(items, events).orderBy("cutoff").collect()] == [(0.0, 0), (2.0, 1), (6.5, 2)]


def test_saved_orders_and_filters(spark):
    rows = spark.createDataFrame([(1, 1, "a", T0, 0.2, 0.9, 8, "ADVANCED", ["x"], ["go"]), (1, 2, "b", T0 + dt.timedelta(1), 0.9, 0.1, 2, "BEGINNER", ["x", "y"], ["c"]), (1, 3, "c", T0 + dt.timedelta(1), 0.2, 0.9, 8, "ADVANCED", ["y"], ["go"])],
        "user_id long, project_id long, slug string, saved_at timestamp_ntz, match_score double, novelty_score double, estimated_hours int, difficulty string, tag_slugs array<string>, language_slugs array<string>")
    order = lambda sort: [r.project_id for r in saved.sort_saved(rows, sort).orderBy("place").collect()]
    assert order("recent") == [2, 3, 1] and order("match") == [2, 3, 1] and order("shortest") == [2, 3, 1] and order("adventurous") == [3, 1, 2] and order("difficulty") == [2, 3, 1]
    with pytest.raises(ValueError):
        saved.sort_saved(rows, "best")
    assert [r.project_id for r in saved.apply_filters(rows, tag="y", language="go", duration="WEEKEND").collect()] == [3]
    assert saved.facets(rows).filter("kind = 'tag' and value = 'x'").first().n == 2


def test_explanations(spark):
    base = dict(user_id=1, project_id=1, content=0.6, collaborative=None, session=None, novelty=0.1, popularity=0.1, adjacency=0.9, underexposure=0.2, e=0.0, confidence=None, cold=False, sources=["content"], w_content=0.5, w_collaborative=0.2, w_novelty=0.1,
        taste_tags=[("web", 2.0), ("data", 3.0), ("x", -1.0)], session_tags=[], languages=[], difficulty_signal=None, duration_signal=None, difficulty="BEGINNER", duration="WEEKEND", seeds=[])
    schema = "user_id long, project_id long, content double, collaborative double, session double, novelty double, popularity double, adjacency double, underexposure double, e double, confidence double, cold boolean, sources array<string>, w_content double, w_collaborative double, w_novelty double, taste_tags array<struct<key:string,signal:double>>, session_tags array<struct<key:string,signal:double>>, languages array<struct<key:string,signal:double>>, difficulty_signal double, duration_signal double, difficulty string, duration string, seeds array<struct<title:string,state:string>>"
    def say(**changes):
        r = ranking.explain(spark.createDataFrame([tuple((base | changes).values())], schema), "Acme").first()
        return r.primary, r.text
    assert say() == ("taste", "Because you like data and web projects.")
    assert say(cold=True) == ("onboarding", "Based on the interests you selected during onboarding: data and web.")
    assert say(taste_tags=[], content=0.0) == ("catalog", "From the Acme catalog.")
    assert say(taste_tags=[], content=0.1, duration_signal=1.0, languages=[("go", 1.0)]) == ("fit", "Fits your preference for weekend-sized go projects.")
    assert say(taste_tags=[], content=0.0, popularity=0.7, sources=["popular"]) == ("popularity", "Popular with Acme users — a good place to start.")
    assert say(collaborative=0.9, w_collaborative=0.9, sources=["collaborative"], seeds=[("Redis", "saved")]) == ("collaborative", "People who liked “Redis”, which you saved, also liked this. Your interest in data and web speaks for it too.")
    assert say(session=0.7, confidence=0.5, session_tags=[("gfx", 1.0)]) == ("session", "Your current session has shifted towards gfx, while this still matches your broader data and web interests.")
    assert say(novelty=0.9, w_novelty=0.9, e=0.7, sources=["exploration"])[1].startswith("You're in a more adventurous discovery mode, so Acme is showing a less familiar project related to data.")
    assert say(collaborative=0.9, w_collaborative=0.9, sources=["collaborative"], taste_tags=[], seeds=[("Redis", "saved"), ("DNS", "built")])[1] == "People who liked “Redis” (which you saved) and “DNS” (which you are building) also liked this."
    assert CONFIG.explain_features == 2


def test_snapshots_keep_null_apart_from_zero(spark):
    from tidewalk.operators import views

    rows = spark.createDataFrame([(1, 1, 1, 0.0, None, float("inf"), float("nan"), 0.5)], "user_id long, project_id long, rank int, content double, collaborative double, session double, novelty double, popularity double")
    stored = views.to_snapshot(rows)
    assert stored.first().raw_signals == '{"content":0.0,"collaborative":null,"session":null,"novelty":null,"popularity":0.5}'
    assert stored.select(views.parse_signals(F.col("raw_signals")).alias("m")).first().m == {"content": 0.0, "popularity": 0.5}
    for broken in ("{", "[1]", None, '{"content": "x"}'):
        assert not (_one(spark, views.parse_signals(F.lit(broken).cast("string"))) or {}).get("content")


def test_catalog_and_onboarding_problems(spark):
    from tidewalk.operators import onboarding, views

    catalog = _catalog(spark, [(1, ["a"], 3, 0.5), (2, [], 0, 1.5), (3, ["a"] * 6, 201, 0.5), (4, ["z"], 200, 1.0)]).withColumn("title", F.when(F.col("project_id") == 3, " abc ").otherwise("Enough"))
    more = [(1, "s" * 30, "d" * 300, ["a", "b", "c"], "https://x"), (2, " " * 40, None, [], None), (3, "s" * 29, "d" * 299, ["a", "b"], "ftp://x"), (4, "s" * 30, "d" * 300, ["a", "b", "c"], None)]
    catalog = catalog.join(spark.createDataFrame(more, "project_id long, summary string, description string, concepts array<string>, source_url string"), "project_id")
    tags = spark.createDataFrame([("a",), ("a",), ("b",)], "slug string")
    languages = catalog.select(F.explode("language_slugs").alias("slug")).distinct()
    found = sorted(((r.project_id or 0, r.problem) for r in views.catalog_problems(catalog, tags, languages).collect()))
    assert found == [(0, "duplicate tag a"), (0, "unused tag b"), (2, "description too short"), (2, "hours are no integer from 1 to 200"), (2, "needs 1 to 5 tags"), (2, "needs 3 concepts"), (2, "prior out of range"), (2, "summary too short"),
        (3, "description too short"), (3, "hours are no integer from 1 to 200"), (3, "needs 1 to 5 tags"), (3, "needs 3 concepts"), (3, "source is no web address"), (3, "summary too short"), (3, "tags repeat"), (3, "title too short"), (4, "unknown tag z")]
    broken = spark.createDataFrame([(1, "Not-Kebab", ["x", "x"]), (2, "ok", ["y"]), (3, "ok", ["y"])], "project_id long, slug string, language_slugs array<string>")
    assert sorted((r.project_id, r.problem) for r in views.catalog_problems(broken).collect()) == [(1, "languages repeat"), (1, "slug has a bad form"), (2, "duplicate slug"), (3, "duplicate slug")]
    assert [r.project_id for r in views.items_by_slug(catalog, spark.createDataFrame([("s4",), (catalog.first().slug,), ("nothing",)], "slug string")).collect()] and views.item_by_slug(catalog, "nothing").count() == 0
    answers = spark.createDataFrame([(1, ["a", "b", "c"], 1, 2), (2, ["a", "a"], 1, 1), (3, None, 1, 2)], "user_id long, topics array<string>, chosen long, rejected long")
    assert sorted((r.user_id, r.problem) for r in views.onboarding_problems(answers).collect()) == [(2, "chose the rejected item"), (2, "too few topics"), (2, "topics repeat"), (3, "too few topics")]
    old, new = (spark.createDataFrame(x, "user_id long, e double") for x in ([(1, 0.1), (2, 0.2)], [(2, 0.9), (3, 0.3)]))
    assert sorted(map(tuple, onboarding.upsert(old, new, "user_id").collect())) == [(1, 0.1), (2, 0.9), (3, 0.3)]


def test_bpr_learns_and_agrees_with_itself(spark):
    from tidewalk.operators import bpr

    catalog = _catalog(spark, [(i, ["a"], 3, 0.5) for i in range(12)])
    data = spark.createDataFrame([(u, i, "positive") for u in range(8) for i in range(12) if i % 2 == u % 2 and (u + i) % 3] + [(0, 1, "negative")], "user_id long, project_id long, label string")
    users, items = bpr.train(data, catalog, rounds=6)
    frame = data.filter("label = 'positive'").select("user_id", "project_id", F.lit(1).alias("good"))
    scored = users.join(items).join(frame, ["user_id", "project_id"], "left").withColumn("s", bpr.score(F.col("p"), F.col("q")))
    means = {r.good: r.m for r in scored.groupBy("good").agg(F.avg("s").alias("m")).collect()}
    assert means[1] > means[None]
    again = bpr.train(data.repartition(3), catalog, rounds=1)[0].orderBy("user_id").collect()
    first = bpr.train(data, catalog, rounds=1)[0].orderBy("user_id").collect()
    assert all(a.p == pytest.approx(b.p) for a, b in zip(again, first))


def test_bpr_trains_all_epochs_and_pairs_without_untouched_items(spark):
    from tidewalk.operators import bpr

    catalog = _catalog(spark, [(i, ["a"], 3, 0.5) for i in range(40)])
    data = [(u, i, "positive") for u in range(8) for i in range(40) if i % 2 == u % 2 and i != 4]
    # all touched, one disliked: the disliked item is all that can be drawn; 9 has nothing to draw
    data += [(8, i, "negative" if i == 4 else "positive" if i < 3 else "neutral") for i in range(40)] + [(9, i, "positive" if i < 3 else "neutral") for i in range(40)]
    data = spark.createDataFrame(data, "user_id long, project_id long, label string")
    # all in one block by the constants, and blocks that meet after each of fewer, larger steps
    for given in ({}, {"block": 60, "rounds": 8, "rate": 0.5}):
        users, items = bpr.train(data, catalog, **given)
        p, q = ({r[0]: np.array(r[1]) for r in x.collect()} for x in (users, items.select("project_id", "q")))
        assert set(p) == set(range(10)) and set(q) == set(range(40))
        good = [p[u] @ q[i] - p[u] @ q[j] for u in range(8) for i in range(40) for j in range(40) if i % 2 == u % 2 != j % 2 and i != 4]
        assert np.log1p(np.exp(-np.array(good))).mean() < 0.1
        assert all(p[8] @ q[i] > p[8] @ q[4] + 1 for i in range(3))
        assert np.abs(p[9]).max() <= CONFIG.bpr["init"]


def test_bpr_draws_evenly_from_untouched_and_disliked_items():
    import pyarrow as pa

    from tidewalk.operators import bpr

    table = pa.table({"user_id": [1, 2, 3, 4], "liked": [[0, 3], [0], [1], [2]], "disliked": [[], [1], [0, 2], []], "touched": [[0, 3, 4], [0, 1, 5], [0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 4, 5]]}, pa.schema([("user_id", pa.int64()), *[(x, pa.list_(pa.int32())) for x in ("liked", "disliked", "touched")]]))
    block, seen = bpr._Block(table, 6), {}
    for t in range(6000):
        for u, i, j in zip(*block.draw(bpr._rng(1, t, 0))):
            seen[u, i, j] = seen.get((u, i, j), 0) + 1 / 6000
    want = {(0, i, j): 1 / 3 for i in (0, 3) for j in (1, 2, 5)} | {(1, 0, 1): 1 / 2} | {(1, 0, j): 1 / 6 for j in (2, 3, 4)} | {(2, 1, j): 1 / 2 for j in (0, 2)}
    assert seen == pytest.approx(want, abs=0.03)


def test_stream_rejects_and_appends(spark, tmp_path):
    from tidewalk.streaming import ingest

    folder = str(tmp_path / "events.parquet")
    rows = [(k, T0 + dt.timedelta(minutes=k), k % 3, "view", 1.0, '{"k": %d}' % (k % 4)) for k in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(4).write.parquet(folder)
    stream = ingest.incoming(spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder))
    good, bad = ingest.validated(stream, _catalog(spark, [(0, ["a"], 3, 0.5), (1, ["a"], 3, 0.5)]))
    assert ingest.drain(good, "good", "append").count() == 20
    assert {r.reason for r in ingest.drain(bad, "bad", "append").collect()} == {"unknown_project"}
    assert ingest.drain(ingest.deduped_impressions(stream), "once", "append").groupBy("user_id", "project_id").count().filter("count > 1").count() == 0


def test_global_rank_and_lists_of_users_without_profile(spark):
    from tidewalk.operators.ranks import global_rank

    rows = [(i, f"s{i:04}", (i * 7 % 10) / 10, (i * 37 % 101) / 100) for i in range(300)]
    items = spark.createDataFrame(rows, "project_id long, slug string, prior double, popularity double").repartition(5)
    got = [r.project_id for r in global_rank(items, [F.desc("popularity"), F.col("slug")]).orderBy("place").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (-r[3], r[1]))] and global_rank(items.filter("false"), [F.col("slug")]).count() == 0
    users = [(1, 0.0), (2, 0.5), (3, 1.0), (4, 0.95), (5, 1 / 1.0725), (6, 0.3)]
    people = spark.createDataFrame(users, "user_id long, e double")
    gone = [(u, i) for u in (1, 3, 6) for i in range(u, 300, 4)]
    scores = [(2, 7, 1.0, 0.4), (3, 8, 1.0, 0.9), (3, 12, 1.0, 0.06)]
    affinities = spark.createDataFrame([(6, 5, 0.4), (6, 9, -0.2)], "user_id long, project_id long, affinity double")
    excluded = spark.createDataFrame(gone, "user_id long, project_id long")
    collaborative = spark.createDataFrame(scores, "user_id long, project_id long, evidence double, collaborative double")
    catalog = items.drop("popularity")
    popular = retrieval.popularity_candidates(items, people, excluded)
    frame = retrieval.item_signals(people, catalog, items, affinities, collaborative, popular, excluded)
    found = {(r.user_id, r["rank"]): (r.project_id, r.exploration) for r in retrieval.exploration_candidates(frame, excluded).collect()}
    own, near, want = {(u, i): c for u, i, _, c in scores}, {(6, 5): 0.4, (6, 9): -0.2}, {}
    for u, e in users:
        listed = []
        for i, slug, prior, pop in rows:
            a = near.get((u, i), 0) if u == 6 else None
            c = own.get((u, i))
            p = pop if a is None and c is None else max(0, a or 0, c or 0)
            x = max(0, a or 0)
            novelty = 0.65 * (1 - pop) + 0.35 * 4 * x * (1 - x)
            if (u, i) not in set(gone) and p >= 0.05:
                listed.append((-round((1 - e) * p + e * (0.65 * novelty + 0.35 * p), 9), -prior, slug, i))
        for k, (score, _, _, i) in enumerate(sorted(listed)[: int(8 + 7 * e + 0.5)]):
            want[u, k + 1] = (i, -score)
    assert found.keys() == want.keys() and all(found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1], abs=1e-8) for k in want)


def test_pairs_and_topics_of_onboarding(spark):
    from tidewalk.operators import onboarding

    catalog = spark.createDataFrame([(1, "a", "A"), (2, "b", "B"), (3, "c", "C")], "project_id long, slug string, title string")
    pairs = spark.createDataFrame([(0, "a", "b"), (1, "c", "a")], "position int, left string, right string")
    loaded = onboarding.load_pairs(pairs, catalog)
    assert sorted((r.position, r.left_id, r.right_id, r.right_title) for r in loaded.collect()) == [(0, 1, 2, "B"), (1, 3, 1, "A")]
    with pytest.raises(onboarding.OnboardingError):
        onboarding.load_pairs(spark.createDataFrame([(0, "a", "gone")], pairs.schema), catalog)
    answers = spark.createDataFrame([(7, 0, "a"), (7, 1, "a")], "user_id long, position int, slug string")
    choices = onboarding.choices_of(answers, loaded)
    assert sorted((r.position, r.chosen, r.rejected) for r in choices.collect()) == [(0, 1, 2), (1, 1, 3)]
    topics = spark.createDataFrame([("ai", "ml", 1.0), ("ai", "nlp", 0.7), ("ai", "x", 0.0), ("ai", "nlp", 0.2)], "topic string, tag string, weight double")
    assert sorted((r.feature, r.value) for r in onboarding.topic_features(topics).collect()) == [("tag:ml", 1.0), ("tag:nlp", 0.7)]
    old = spark.createDataFrame([(7, "BEGINNER"), (8, None)], "user_id long, difficulty string")
    kept, chosen = onboarding.complete(old, choices.select("user_id", "position", "chosen", "rejected"), spark.createDataFrame([(7, "SURPRISE_ME"), (9, "ADVANCED")], old.schema), spark.createDataFrame([(7, 1, 3, 1), (9, 0, 2, 1)], choices.schema))
    assert sorted(map(repr, map(tuple, kept.collect()))) == ["(7, None)", "(8, None)", "(9, 'ADVANCED')"] and sorted((r.user_id, r.position) for r in chosen.collect()) == [(7, 1), (9, 0)]


def test_stored_runs(spark, tmp_path):
    from tidewalk.operators import runs

    def made(user, minute, n, results=1, weights='{"content": 0.5, "novelty": 0.5, "other": 1, "session": null}'):
        diagnostics = '{"version":1,"pipeline":{"final":%d},"context":{"session":{"confidence":0.25},"exploration":{"mode":"balanced"}}}' % results if n else "{}"
        return (f"{user}@{minute}", user, None, "x", T0 + dt.timedelta(minutes=minute), 10, 0.5, weights, diagnostics)

    schema = "run_id string, user_id long, session_id long, algorithm string, created_at timestamp_ntz, requested_limit int, exploration_preference double, ranking_weights string, diagnostics string"
    rows = [made(1, m, m % 2) for m in range(30)] + [made(2, 5, 1)]
    results = [(r[0], r[1], p, p, p, 0.5, 0.5, None, None, 0.25, 0.1, ["content", "wrong"], '{"content": 0.5, "x": "y"}', "plain", '{"explanation":{"text":"rich","primary":"taste"}}' if p == 1 else "[]") for r in rows for p in (1, 2)]
    columns = "run_id string, user_id long, project_id long, rank int, pre_rank int, final_score double, content double, collaborative double, session double, novelty double, popularity double, sources array<string>, raw_signals string, explanation string, diagnostics string"
    store = runs.RunStore(spark, str(tmp_path / "store"))
    for part in (rows[:20], rows[20:]):
        ids = {r[0] for r in part}
        store.record(spark.createDataFrame(part, schema), spark.createDataFrame([r for r in results if r[0] in ids], columns))
    assert {r.user_id: r.stored for r in store.count().collect()} == {1: 25, 2: 1}
    recent = store.recent().collect()
    assert sorted((r.user_id, r.place) for r in recent) == [*((1, k + 1) for k in range(10)), (2, 1)]
    newest = next(r for r in recent if r.user_id == 1 and r.place == 1)
    assert (newest.run_id, newest.n_results, newest["mode"], newest.session_confidence) == ("1@29", 2, "balanced", 0.25)
    catalog = spark.createDataFrame([(1, "s", "One"), (2, "t", "Two")], "project_id long, slug string, title string")
    asked = spark.createDataFrame([(1, "1@29"), (2, "1@29"), (1, "1@0")], "user_id long, run_id string")
    found = {(r.run_id, r.project_id): r for r in store.detail(asked, catalog).collect()}
    assert set(found) == {("1@29", 1), ("1@29", 2)}  # not another user's run, nor one that is gone
    first, second = found["1@29", 1], found["1@29", 2]
    assert first.weights == {"content": 0.5, "novelty": 0.5} and first.sources == ["content"] and first.raw_signals == {"content": 0.5} and (first.explanation, second.explanation) == ("rich", "plain")
    assert first.content_part == 0.25 and first.collaborative_part is None and first.popularity_part is None and second.detail is None and first.run.context.exploration["mode"] == "balanced"
    smaller = store.prune(str(tmp_path / "pruned"), 3)
    assert {r.user_id: r.stored for r in smaller.count().collect()} == {1: 3, 2: 1} and smaller.results().count() == 8
    json = runs.to_json(spark.sql("select cast('NaN' as double) as a, array(cast('Infinity' as double), 1D) as b, map('k', cast('NaN' as double)) as c, null as d"), "out", a=F.col("a"), s=F.struct("b", "c"), d=F.col("d"))
    assert json.first().out == '{"a":null,"s":{"b":[null,1.0],"c":{"k":null}},"d":null}'


def test_stored_factors(spark, tmp_path):
    from tidewalk.operators import bpr

    users = spark.createDataFrame([(u, [0.1 * u] * 16) for u in range(5)], "user_id long, p array<double>")
    items = spark.createDataFrame([(i, [0.2 * i] * 16) for i in range(7)], "project_id long, q array<double>")
    path = str(tmp_path / "model")
    first = bpr.save_model(users, items, path, "today")
    assert first == bpr.save_model(users.repartition(3), items, path, "tomorrow") != bpr.checksum(users.filter("user_id > 0"), items)
    assert [df.count() for df in bpr.load_model(spark, path)] == [5, 7]
    for broken in (users.withColumn("p", F.slice("p", 1, 3)), users.withColumn("p", F.transform("p", lambda x: x + 1)), users.withColumn("p", F.transform("p", lambda x: F.lit(float("nan")))), users.filter("false"), users.unionByName(users)):
        broken.write.mode("overwrite").parquet(f"{path}/users")
        with pytest.raises(bpr.ModelError):
            bpr.load_model(spark, path)
    best = bpr.best_untouched(users, items, spark.createDataFrame([(1, 6), (1, 5), (2, 0)], "user_id long, project_id long"), 2)
    assert sorted((r.user_id, r["rank"], r.project_id) for r in best.collect()) == [(0, 1, 0), (0, 2, 1), (1, 1, 4), (1, 2, 3), *((u, k, 7 - k) for u in (2, 3, 4) for k in (1, 2))]


def test_metrics_must_be_finite(spark):
    good, bad = (spark.createDataFrame([("x", v)], "algorithm string, novelty double") for v in (0.5, float("nan")))
    assert evaluation.assert_finite(good, ["novelty"]).first().novelty == 0.5
    with pytest.raises(Exception, match="novelty is not finite"):
        evaluation.assert_finite(bad, ["novelty"]).collect()


def test_as_of_sums_over_days(spark):
    events = [(p, T0 + dt.timedelta(hours=7 * k), float(k + p)) for p in (1, 2) for k in range(30)]
    marks = [(p, T0 + dt.timedelta(hours=h), h) for p in (1, 2, 3) for h in (0, 1, 7, 50, 51, 300)]
    found = evaluation.as_of_sums(spark.createDataFrame(marks, "project_id long, t timestamp_ntz, h int"), spark.createDataFrame(events, "project_id long, t timestamp_ntz, x double"), ["x"])
    assert {(r.project_id, r.h): r.x for r in found.collect()} == {(p, h): sum(x for q, at, x in events if q == p and at < t) for p, t, h in marks}


def test_similar_items_of_few_shared_tags(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [f"t{rng.integers(40)}" for _ in range(rng.integers(1, 4))], int(rng.choice([1, 3, 9, 30])), float(rng.integers(10)) / 10) for i in range(120)]
    level = F.element_at(F.array(F.lit("BEGINNER"), F.lit("INTERMEDIATE"), F.lit("ADVANCED")), (F.col("project_id") % 3 + 1).cast("int"))
    catalog = _catalog(spark, rows).withColumn("language_slugs", F.array(F.concat(F.lit("l"), (F.col("project_id") % 60).cast("string")))).withColumn("difficulty", level)
    features = profiles.item_features(catalog)
    vectors = {}
    for r in features.collect():
        vectors.setdefault(r.project_id, {})[r.feature] = r.value
    known = {r.project_id: r for r in catalog.collect()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for i, v in vectors.items():
        near = [(-round(min(1, sum(x * w.get(f, 0) for f, x in v.items()) / length(v) / length(w)), 9), -known[j].prior, known[j].slug, j) for j, w in vectors.items() if j != i]
        want[i] = [j for s, _, _, j in sorted(near)[:5] if s < 0]
    got = {}
    for r in retrieval.similar_projects(features, catalog).orderBy("project_id", "rank").collect():
        got.setdefault(r.project_id, []).append(r.other_id)
    assert got == want
