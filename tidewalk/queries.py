"""The registered queries of the recommender, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewalk.config import CONFIG
from tidewalk.functions.scalar import age_days, clamp01, duration_bucket, exploration_limit, discovery_mode, diversification_lambda, fnv1a, format_duration, format_score, interaction_weight, max_items_per_tag, r9, time_decay
from tidewalk.operators import bpr, evaluation, onboarding, profiles, ranking, retrieval, rolling, runs, saved, sessions, states, views
from tidewalk.operators.ranks import global_rank
from tidewalk.oracle import AGE, BUCKET, at_cutoff, diversified, explained, sql
from tidewalk.plans.evaluate import Evaluation
from tidewalk.plans.feed import Feed
from tidewalk.sources import tables
from tidewalk.sources.shared import cut, new_path
from tidewalk.sources.versioned import KeyedTable, change_set
from tidewalk.streaming import ingest, session_service

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None, extra: dict[str, str] | None = None):
    """Register a function of a Feed under its name."""

    def register(f: Callable[[Feed], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, folder: f(Feed(spark, folder))
        if oracle is not None:
            _SQL[f.__name__] = sql(oracle, extra)
        return f

    return register


@query("select id, user_id, project_id, created_at, type, weight from interactions")
def interactions_view(feed: Feed) -> DataFrame:
    return feed.interactions


@query("select project_id, slug, title, array_to_string(list_sort(tag_slugs), ',') as tags, language_slugs[1] as language, difficulty, estimated_hours, prior from catalog")
def catalog_view(feed: Feed) -> DataFrame:
    return feed.catalog.select("project_id", "slug", "title", F.array_join(F.array_sort("tag_slugs"), ",").alias("tags"), F.get("language_slugs", 0).alias("language"), "difficulty", "estimated_hours", "prior")


@query("select type, weight, count(*) as n, sum(weight) as total from interactions group by type, weight")
def interaction_weights(feed: Feed) -> DataFrame:
    return feed.interactions.groupBy("type", interaction_weight(F.col("type")).alias("weight")).agg(F.count("*").alias("n"), F.sum("weight").alias("total"))


@query(f"select id, round(case when {AGE} <= 0 then 1 else pow(0.5, {AGE} / 30) end, 9) as decay from interactions")
def time_decay_of_events(feed: Feed) -> DataFrame:
    return feed.interactions.select("id", r9(time_decay(age_days(F.col("created_at"), feed.now))).alias("decay"))


@query("select project_id, feature, value from features")
def project_features(feed: Feed) -> DataFrame:
    return feed.features


@query(f"select project_id, {BUCKET} as bucket, case {BUCKET} when 'UNDER_2_HOURS' then 'Under 2 hours' when 'ONE_EVENING' then 'One evening' when 'WEEKEND' then 'Weekend' else '1–2 weeks' end || ' · ~' || estimated_hours || 'h' as duration, floor(100 * prior + 0.5)::int as percent from catalog")
def catalog_formats(feed: Feed) -> DataFrame:
    hours = F.col("estimated_hours")
    return feed.catalog.select("project_id", duration_bucket(hours).alias("bucket"), format_duration(hours).alias("duration"), format_score(F.col("prior")).alias("percent"))


@query("select user_id, project_id, saved, disliked, built, completed, opened, shared, excluded, interaction_count, first_touch, if(saved, last_save, null) as saved_at from states")
def project_states(feed: Feed) -> DataFrame:
    return feed.states


@query("select user_id, project_id, last_save as saved_at from states where saved")
def saved_projects(feed: Feed) -> DataFrame:
    return feed.states.filter("saved").select("user_id", "project_id", "saved_at")


@query("select user_id, project_id from states where disliked")
def disliked_projects(feed: Feed) -> DataFrame:
    return feed.states.filter("disliked").select("user_id", "project_id")


@query("select user_id, project_id from gone")
def excluded_projects(feed: Feed) -> DataFrame:
    return feed.excluded


@query("""select user_id, impression, "open", save, unsave, dislike, build, complete, share, total, saved_items, disliked_items, built_items, completed_items from (
  select user_id, count(*) filter (where type = 'IMPRESSION') as impression, count(*) filter (where type = 'OPEN') as "open", count(*) filter (where type = 'SAVE') as save, count(*) filter (where type = 'UNSAVE') as unsave,
    count(*) filter (where type = 'DISLIKE') as dislike, count(*) filter (where type = 'BUILD') as build, count(*) filter (where type = 'COMPLETE') as complete, count(*) filter (where type = 'SHARE') as share, count(*) as total from interactions group by user_id)
  join (select user_id, count(*) filter (where saved) as saved_items, count(*) filter (where disliked) as disliked_items, count(*) filter (where built) as built_items, count(*) filter (where completed) as completed_items from states group by user_id) using (user_id)""")
def user_stats(feed: Feed) -> DataFrame:
    return states.user_stats(feed.interactions, feed.states)


@query("select (select count(*) from catalog) as projects, (select count(distinct t) from (select unnest(tag_slugs) as t from catalog)) as tags, (select count(distinct t) from (select unnest(language_slugs) as t from catalog)) as languages, (select count(*) from app_users) as users, (select count(*) from interactions) as interactions")
def catalog_stats(feed: Feed) -> DataFrame:
    return states.catalog_stats(feed.catalog, feed.users, feed.interactions)


@query("select project_id, title, prior, row_number() over (order by prior desc, title, project_id) as place from catalog")
def catalog_listing(feed: Feed) -> DataFrame:
    return global_rank(feed.catalog.select("project_id", "title", "prior"), [F.desc("prior"), F.col("title"), F.col("project_id")])


@query("select user_id, project_id, slug, title from states join catalog using (project_id) where built")
def projects_by_slug(feed: Feed) -> DataFrame:
    """The items that users built, looked up by their slugs."""
    built = feed.states.filter("built").select("user_id", F.lpad(F.col("project_id").cast("string"), 6, "0").alias("slug"))
    return built.join(views.items_by_slug(feed.catalog, built), "slug").select("user_id", "project_id", "slug", "title")


@query("select user_id, feature, round(signal, 9) as signal from onboarding")
def onboarding_signals(feed: Feed) -> DataFrame:
    return feed.onboarding.select("user_id", "feature", r9("signal").alias("signal"))


@query("""select user_id, feature, round(signal, 9) as signal from (select user_id, feature, sum(scale * value) as signal from (
  select user_id, project_id, sum(weight * pow(0.5, date_diff('microsecond', created_at, timestamp '2024-01-31') / 86400000000.0::double / 30)) as scale from interactions
  where weight <> 0 and created_at >= timestamp '2024-01-17' and created_at < timestamp '2024-01-31' group by all) join features using (project_id) group by all) where round(signal, 9) <> 0""")
def rolling_signals(feed: Feed) -> DataFrame:
    """Decayed signals of the last fourteen days, kept over the days before the present: loaded, then moved on by three days."""
    kept = rolling.RollingSignals(feed.spark, new_path(feed.spark, "rolling"), history_days=14, buckets=16)
    kept.load(feed.interactions, date(2024, 1, 27))
    for day in (28, 29, 30):
        kept.advance(feed.interactions, date(2024, 1, day))
    return kept.signals(feed.features).withColumn("signal", r9("signal")).filter("signal <> 0")


@query("select user_id, feature, round(signal, 9) as signal, round(vector, 9) as vector, round(strength, 9) as strength from long_term")
def long_term_profile(feed: Feed) -> DataFrame:
    return feed.long_term.select("user_id", "feature", *[r9(c).alias(c) for c in ("signal", "vector", "strength")])


@query("select user_id, feature, round(signal, 9) as signal, round(vector, 9) as vector, round(strength, 9) as strength from session_profile")
def session_profile(feed: Feed) -> DataFrame:
    return feed.session_profile.select("user_id", "feature", *[r9(c).alias(c) for c in ("signal", "vector", "strength")])


_FAMILY = "case string_split(feature, ':')[1] when 'lang' then 'language' else string_split(feature, ':')[1] end"

def _top_sql(sign: str, where: str) -> str:
    return f"""select user_id, family, feature, '{sign}' as sign, row_number() over (partition by user_id, family order by abs(round(signal, 9)) desc, feature) as rank, round(family_strength, 9) as family_strength
  from (select *, signal / max(abs(signal)) over (partition by user_id, family) as family_strength from (select *, {_FAMILY} as family from long_term)) where {where} qualify rank <= case family when 'tag' then 12 when 'language' then 6 else 1000 end"""


@query(_top_sql("positive", "signal > 0") + "\nunion all\n" + _top_sql("negative", "signal < 0 and family in ('tag', 'language')"))
def profile_top_features(feed: Feed) -> DataFrame:
    """What a profile page shows: the 12 strongest tags and 6 languages of either sign, and all liked difficulties and durations."""
    part = lambda positive: profiles.profile_view(feed.long_term, positive).select("user_id", "family", "feature", F.lit("positive" if positive else "negative").alias("sign"), F.col("rank").cast("long"), r9("family_strength").alias("family_strength"))
    return part(True).unionByName(part(False))


@query("select project_id, evidence from popularity_evidence")
def popularity_evidence(feed: Feed) -> DataFrame:
    return retrieval.popularity_evidence(feed.interactions)


@query("select project_id, prior, round(behaviour, 9) as behaviour, popularity from popularity")
def popularity_scores(feed: Feed) -> DataFrame:
    return feed.popularity.select("project_id", "prior", r9("behaviour").alias("behaviour"), "popularity")


@query("select user_id, project_id, popularity, rank from popular")
def popularity_candidates(feed: Feed) -> DataFrame:
    return feed.popular.withColumn("rank", F.col("rank").cast("long"))


@query("select user_id, project_id, affinity from affinities")
def content_affinity(feed: Feed) -> DataFrame:
    return feed.affinities


@query("select user_id, project_id, affinity, rank from content")
def content_candidates(feed: Feed) -> DataFrame:
    """Without all affinities: by an index of pairs of tags with bounds."""
    return retrieval.ContentIndex(feed.features, feed.catalog).top(feed.effective, feed.excluded).withColumn("rank", F.col("rank").cast("long"))


_PART = "(select p_partkey as project_id, lpad(p_partkey::varchar, 6, '0') as slug, list_distinct(string_split(p_name, ' ')) as tags, lower(p_brand) as lang, case when p_type like 'ECONOMY%' or p_type like 'SMALL%' then 'BEGINNER' when p_type like 'MEDIUM%' or p_type like 'STANDARD%' then 'INTERMEDIATE' else 'ADVANCED' end as difficulty, p_size as hours, (p_partkey * 37 % 101) / 100.0 as prior from part)"


@query(f"""select * from (with items as materialized (select * from {_PART}),
values_of as (select project_id, 'tag:' || unnest(tags) as feature, 1.0::double as value from items union all select project_id, 'lang:' || lang, 0.5 from items union all select project_id, 'difficulty:' || difficulty, 0.35 from items
  union all select project_id, 'duration:' || case when hours <= 2 then 'UNDER_2_HOURS' when hours <= 5 then 'ONE_EVENING' when hours <= 20 then 'WEEKEND' else 'ONE_TO_TWO_WEEKS' end, 0.35 from items),
lengths as (select project_id, sqrt(sum(value * value)) as norm from values_of group by 1),
scores as (select user_id, project_id, round(greatest(-1, least(1, dot / norm)), 9) as affinity from (select user_id, project_id, sum(vector * value) as dot from effective join values_of using (feature) group by all) join lengths using (project_id))
select user_id, project_id, affinity, row_number() over (partition by user_id order by affinity desc, prior desc, slug) as rank from scores join items using (project_id) anti join gone using (user_id, project_id) where affinity >= 0.01 qualify rank <= 50)""")
def unseen_content(feed: Feed) -> DataFrame:
    """Content candidates among all items of the item table, those without any event too."""
    items = tables.as_catalog(tables.table(feed.spark, feed.folder, "part"))
    return retrieval.ContentIndex(profiles.item_features(items), items).top(feed.effective, feed.excluded).withColumn("rank", F.col("rank").cast("long"))


@query("""select project_id, other_id, similarity, row_number() over (partition by project_id order by similarity desc, prior desc, slug) as rank from (
  select a.project_id, b.project_id as other_id, round(least(1, sum(a.value * b.value) / (any_value(x.norm) * any_value(y.norm))), 9) as similarity from features a join features b on a.feature = b.feature and a.project_id <> b.project_id
  join norms x on x.project_id = a.project_id join norms y on y.project_id = b.project_id group by all) s join catalog c on c.project_id = s.other_id where similarity > 0 qualify rank <= 5""".replace("select project_id, other_id", "select s.project_id, other_id", 1).replace("partition by project_id", "partition by s.project_id"))
def similar_projects(feed: Feed) -> DataFrame:
    return retrieval.similar_projects(feed.features, feed.catalog).withColumn("rank", F.col("rank").cast("long"))


@query("select user_id, project_id, signal, state from signals")
def collab_signals(feed: Feed) -> DataFrame:
    return feed.signals


@query("select i, j, overlap, similarity from similarities")
def item_similarity(feed: Feed) -> DataFrame:
    return retrieval.item_similarity(feed.pairs)


@query("select i, j, similarity, rank from neighbours")
def item_neighbours(feed: Feed) -> DataFrame:
    return retrieval.item_neighbours(retrieval.item_similarity(feed.pairs)).withColumn("rank", F.col("rank").cast("long"))


@query("select user_id, project_id, signal as weight, state, row_number() over (partition by user_id order by signal desc, project_id) as rank from signals")
def collab_seeds(feed: Feed) -> DataFrame:
    return retrieval.collaborative_seeds(feed.signals).withColumn("rank", F.col("rank").cast("long"))


@query("select user_id, project_id, evidence, collaborative, array_to_string(support, ',') as support from collaborative_scores")
def collab_scores_loo(feed: Feed) -> DataFrame:
    return feed.collaborative_scores.withColumn("support", F.array_join("support", ","))


@query("select user_id, project_id, collaborative, rank from collaborative")
def collab_candidates(feed: Feed) -> DataFrame:
    return feed.collaborative.withColumn("rank", F.col("rank").cast("long"))


@query("select user_id, project_id, novelty from item_frame where affinity is not null")
def novelty_scores(feed: Feed) -> DataFrame:
    """Of users with a profile, for the items that share anything with them."""
    return feed.frame.filter("affinity is not null").select("user_id", "project_id", "novelty")


@query("select user_id, project_id, exploration, round(plausibility, 9) as plausibility, rank from exploration")
def exploration_candidates(feed: Feed) -> DataFrame:
    return feed.exploration.select("user_id", "project_id", "exploration", r9("plausibility").alias("plausibility"), F.col("rank").cast("long"))


@query("select user_id, project_id, sources, best_signal, n_sources from merged")
def merged_candidates(feed: Feed) -> DataFrame:
    return feed.merged.select("user_id", "project_id", F.array_join("sources", ",").alias("sources"), F.array_max(F.map_values("signals")).alias("best_signal"), F.size("sources").cast("long").alias("n_sources"))


@query("""select user_id, project_id, case when project_id not in (select project_id from catalog where difficulty <> 'ADVANCED') then 'unknown_project' when (user_id, project_id) in (select (user_id, project_id) from gone) then 'excluded_state' end as reason
  from (select distinct user_id, project_id from (select user_id, project_id from merged union all select user_id, project_id from gone))""")
def filtered_candidates(feed: Feed) -> DataFrame:
    """Candidates and excluded items against the catalog without its advanced items, so that both reasons occur."""
    rows = feed.merged.select("user_id", "project_id").unionByName(feed.excluded).distinct()
    return ranking.filter_candidates(rows, feed.catalog.filter("difficulty <> 'ADVANCED'"), feed.excluded)


@query("select source, count(*) as n, count(distinct user_id) as users from candidates group by source")
def candidates_by_source(feed: Feed) -> DataFrame:
    parts = [p.select("user_id", F.lit(name).alias("source")) for name, p in zip(ranking.SOURCES, (feed.content, feed.collaborative, feed.popular, feed.exploration))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("select user_id, e, cold_start, round(confidence, 9) as confidence, has_profile, has_collaborative, has_session, w_content, w_collaborative, w_session, w_novelty, w_popularity from weights")
def ranking_weights(feed: Feed) -> DataFrame:
    return feed.weights.withColumn("confidence", r9("confidence"))


@query("select user_id, project_id, sources, content, collaborative, session, novelty, popularity, saved, score, rank from ranked")
def hybrid_ranking(feed: Feed) -> DataFrame:
    return feed.ranked.select("user_id", "project_id", F.array_join("sources", ",").alias("sources"), "content", "collaborative", "session", "novelty", "popularity", "saved", "score", F.col("rank").cast("long"))


@query("select user_id, project_id, rank, round(w_content * content, 9) as content_part, round(w_collaborative * collaborative, 9) as collaborative_part, round(w_session * session, 9) as session_part, round(w_novelty * novelty, 9) as novelty_part, round(w_popularity * popularity, 9) as popularity_part from ranked")
def component_contributions(feed: Feed) -> DataFrame:
    return ranking.contributions(feed.ranked).withColumn("rank", F.col("rank").cast("long"))


@query("select user_id, e, case when e <= 0.3 then 'familiar' when e >= 0.7 then 'adventurous' else 'balanced' end as mode, floor(8 + 7 * e + 0.5)::int as exploration_limit, round(least(0.95, greatest(0.5, 0.9 - 0.2 * e)), 9) as lambda, greatest(2, floor((0.45 - 0.15 * e) * 10 + 0.5))::int as per_tag from app_users")
def exploration_context(feed: Feed) -> DataFrame:
    e = F.col("e")
    return feed.users.select("user_id", "e", discovery_mode(e).alias("mode"), exploration_limit(e).alias("exploration_limit"), r9(diversification_lambda(e)).alias("lambda"), max_items_per_tag(10, e).alias("per_tag"))


_PICKS = diversified("ranked")


@query("select user_id, project_id, score, pre_rank::int as pre_rank, final_rank, mmr, max_similarity, relaxed, applied from picks", _PICKS)
def diversified_feed(feed: Feed) -> DataFrame:
    return feed.diversified()


@query('select user_id, project_id, final_rank, pre_rank, score, mmr, "primary", text, factors, strength from reasons', _PICKS | explained())
def explained_feed(feed: Feed) -> DataFrame:
    """The flagship: every user's diversified feed with its reasons."""
    shown = cut(feed.diversified(), "shown")
    said = F.array_join(F.transform("factors", lambda x: F.concat(x["kind"], F.lit("("), F.array_join(x["features"], ","), F.lit(")"))), " ")
    strength = F.round(F.aggregate("factors", F.lit(0.0), lambda n, x: n + F.coalesce(x["strength"], F.lit(0.0))), 6)
    return feed.explained(shown).select("user_id", "project_id", "final_rank", "pre_rank", "score", "mmr", "primary", "text", said.alias("factors"), strength.alias("strength"))


@query("""select user_id, project_id, rank, row_number() over (partition by user_id order by rank) as place from ranked
  anti join (select user_id, project_id from session_rows where type = 'IMPRESSION' union select user_id, project_id from states where disliked) using (user_id, project_id) qualify place <= 10""")
def feed_refill(feed: Feed) -> DataFrame:
    """The next ten of the ranking that the session hasn't shown and the user hasn't dismissed."""
    shown, dismissed = feed.session_rows.filter("type = 'IMPRESSION'"), feed.states.filter("disliked")
    return views.refill(feed.ranked, shown, dismissed).filter("place <= 10").select("user_id", "project_id", F.col("rank").cast("long"), F.col("place").cast("long"))


_CONTEXT = """select user_id, project_id, excluded, content, collaborative, session, novelty, popularity, round(least(1::double, greatest(0::double, coalesce(w_content * least(1, greatest(-1, content)), 0) + coalesce(w_collaborative * collaborative, 0)
    + coalesce(w_session * session, 0) + coalesce(w_novelty * novelty, 0) + coalesce(w_popularity * popularity, 0))) * 0.6, 9) as score
  from (select *, round(0.65 * (1 - popularity) + 0.35 * 4 * greatest(0, content) * (1 - greatest(0, content)), 9) as novelty from (
    select s.user_id, s.project_id, s.excluded, coalesce(a.affinity, 0)::double as content, k.collaborative, case when w.has_session then coalesce(f.score, 0) end as session, p.popularity, w.* exclude (user_id, e, cold_start, confidence, has_profile, has_collaborative, has_session)
    from states s join popularity p using (project_id) join weights w on w.user_id = s.user_id and w.has_profile left join affinities a on a.user_id = s.user_id and a.project_id = s.project_id
    left join collaborative_scores k on k.user_id = s.user_id and k.project_id = s.project_id left join session_affinity f on f.user_id = s.user_id and f.project_id = s.project_id where s.saved))"""


@query(_CONTEXT)
def recommendation_context(feed: Feed) -> DataFrame:
    """Why the saved items would be recommended: their signals and scores; the operator explains them too."""
    return feed.context(feed.states.filter("saved")).select("user_id", "project_id", "excluded", "content", "collaborative", "session", "novelty", "popularity", "score")


@query("select user_id, session_no, started_at, last_active_at, n_events from all_sessions")
def user_sessions(feed: Feed) -> DataFrame:
    return feed.sessions


@query("select user_id, session_no, started_at, last_active_at, n_events, expires_at from active")
def active_session(feed: Feed) -> DataFrame:
    return feed.active


@query("select user_id, meaningful, evidence from evidence")
def session_evidence(feed: Feed) -> DataFrame:
    return sessions.session_evidence(feed.session_rows)


@query("select user_id, meaningful, evidence, round(coherence, 9) as coherence, round(evidence_confidence, 9) as evidence_confidence, round(confidence, 9) as confidence, round(blend_weight, 9) as blend_weight from confidence")
def session_confidence(feed: Feed) -> DataFrame:
    return feed.confidence.select("user_id", "meaningful", "evidence", *[r9(c).alias(c) for c in ("coherence", "evidence_confidence", "confidence", "blend_weight")])


@query("select user_id, feature, round(vector, 9) as vector from effective")
def effective_profile(feed: Feed) -> DataFrame:
    return feed.effective.withColumn("vector", r9("vector"))


@query("select user_id, project_id, raw, score from session_affinity")
def session_affinity(feed: Feed) -> DataFrame:
    return feed.session_affinity


@query("select user_id, feature, rank, round(strength, 9) as strength from (select user_id, feature, signal / max(signal) over (partition by user_id) as strength, row_number() over (partition by user_id order by round(signal, 9) desc, feature) as rank from session_profile where feature like 'tag:%' and signal > 0) where rank <= 5")
def session_top_features(feed: Feed) -> DataFrame:
    return sessions.top_features(feed.session_profile).select("user_id", "feature", F.col("rank").cast("long"), r9("strength").alias("strength"))


@query("select user_id, session_no, project_id, min(created_at) as created_at, min(id) as id from sessionized where type = 'IMPRESSION' group by user_id, session_no, project_id")
def impression_dedupe(feed: Feed) -> DataFrame:
    return sessions.dedupe_impressions(feed.sessionized)


_SAVED = {
    "page": "select s.user_id, s.project_id, s.last_save as saved_at, s.built, s.completed, c.slug, c.title, c.tag_slugs, c.language_slugs, c.difficulty, c.estimated_hours, greatest(0, coalesce(f.affinity, 0)) as match_score, round(0.65 * (1 - p.popularity) + 0.35 * 4 * greatest(0, coalesce(f.affinity, 0)) * (1 - greatest(0, coalesce(f.affinity, 0))), 9) as novelty_score from states s join catalog c using (project_id) join popularity p on p.project_id = s.project_id left join affinities f on f.user_id = s.user_id and f.project_id = s.project_id where s.saved",
}


def _page(feed: Feed) -> DataFrame:
    """Saved items with their scores; only these pairs are scored."""
    kept = feed.states.filter("saved").select("user_id", "project_id")
    return saved.saved_page(feed.states, feed.catalog, feed.popularity, retrieval.pair_affinity(kept, feed.effective, feed.features))


@query("select user_id, project_id, saved_at, title, match_score, novelty_score, built, completed from page", _SAVED)
def saved_page(feed: Feed) -> DataFrame:
    return _page(feed).select("user_id", "project_id", "saved_at", "title", "match_score", "novelty_score", "built", "completed")


@query("""select 'recent' as sort, user_id, project_id, row_number() over (partition by user_id order by saved_at desc, slug) as place from page
  union all select 'match', user_id, project_id, row_number() over (partition by user_id order by match_score desc, saved_at desc, slug) from page
  union all select 'shortest', user_id, project_id, row_number() over (partition by user_id order by estimated_hours, saved_at desc, slug) from page
  union all select 'difficulty', user_id, project_id, row_number() over (partition by user_id order by case difficulty when 'BEGINNER' then 0 when 'INTERMEDIATE' then 1 else 2 end, saved_at desc, slug) from page
  union all select 'adventurous', user_id, project_id, row_number() over (partition by user_id order by novelty_score desc, saved_at desc, slug) from page""", _SAVED)
def saved_sorted(feed: Feed) -> DataFrame:
    page = _page(feed)
    parts = [saved.sort_saved(page, sort).select(F.lit(sort).alias("sort"), "user_id", "project_id", F.col("place").cast("long")) for sort in saved.SORTS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("select user_id, 'tag' as kind, t as value, count(*) as n from (select user_id, unnest(tag_slugs) as t from page) group by all union all select user_id, 'language', t, count(*) from (select user_id, unnest(language_slugs) as t from page) group by all", _SAVED)
def saved_facets(feed: Feed) -> DataFrame:
    return saved.facets(_page(feed))


@query(f"select user_id, project_id from page where list_contains(tag_slugs, 'red') and difficulty = 'BEGINNER' and {BUCKET} = 'ONE_TO_TWO_WEEKS'", _SAVED)
def saved_filtered(feed: Feed) -> DataFrame:
    page = _page(feed)
    return saved.apply_filters(page, tag="red", difficulty="BEGINNER", duration="ONE_TO_TWO_WEEKS").select("user_id", "project_id")


def _runs(feed: Feed) -> DataFrame:
    return feed.sessions.select("user_id", F.col("session_no").alias("run_id"), F.col("started_at").alias("created_at"), F.col("n_events").alias("n_results"))


@query("select user_id, session_no as run_id, started_at as created_at, n_events as n_results, row_number() over (partition by user_id order by started_at desc, session_no desc) as place from all_sessions qualify place <= 10")
def recent_runs(feed: Feed) -> DataFrame:
    """Each session as a stored run: the ten newest of each user."""
    return saved.recent_runs(_runs(feed)).withColumn("place", F.col("place").cast("long"))


@query("select user_id, count(*) as kept, min(started_at) as oldest from (select * from all_sessions qualify row_number() over (partition by user_id order by started_at desc, session_no desc) <= 25) group by user_id")
def run_retention(feed: Feed) -> DataFrame:
    return saved.recent_runs(_runs(feed), CONFIG.kept_runs).groupBy("user_id").agg(F.count("*").alias("kept"), F.min("created_at").alias("oldest"))


@query("""select user_id, w_content, w_collaborative, w_session, w_novelty, w_popularity, coalesce(n_content, 0) as n_content, coalesce(n_collaborative, 0) as n_collaborative, coalesce(n_popular, 0) as n_popular,
  coalesce(n_exploration, 0) as n_exploration, coalesce(n_merged, 0) as n_merged, coalesce(n_ranked, 0) as n_ranked from weights
  left join (select user_id, count(*) as n_content from content group by user_id) using (user_id) left join (select user_id, count(*) as n_collaborative from collaborative group by user_id) using (user_id)
  left join (select user_id, count(*) as n_popular from popular group by user_id) using (user_id) left join (select user_id, count(*) as n_exploration from exploration group by user_id) using (user_id)
  left join (select user_id, count(*) as n_merged from merged group by user_id) using (user_id) left join (select user_id, count(*) as n_ranked from inputs group by user_id) using (user_id)""")
def run_snapshot(feed: Feed) -> DataFrame:
    return saved.run_snapshot(feed).drop("e", "cold_start", "confidence", "has_profile", "has_collaborative", "has_session")


def _stored(feed: Feed) -> runs.RunStore:
    store = runs.RunStore(feed.spark, new_path(feed.spark, "runs"))
    store.record(*runs.snapshot(feed, cut(feed.diversified(), "shown")))
    return store


@query("""select user_id, 1 as place, 1 as stored, least(10, coalesce(n_ranked, 0)) as n_results, e as exploration_preference, case when e <= 0.3 then 'familiar' when e >= 0.7 then 'adventurous' else 'balanced' end as mode, coalesce(confidence, 0) as session_confidence
  from weights left join (select user_id, count(*) as n_ranked from inputs group by user_id) using (user_id)""")
def stored_runs(feed: Feed) -> DataFrame:
    """Every user's feed stored as a run, and the list of stored runs read back."""
    store = _stored(feed)
    return store.recent().join(store.count(), "user_id").select("user_id", F.col("place").cast("long"), "stored", "n_results", "exploration_preference", "mode", "session_confidence")


@query("""select p.user_id, p.project_id, final_rank as rank, p.pre_rank::int as pre_rank, p.score as final_score, title, sources, w_content * content as content_part, w_collaborative * collaborative as collaborative_part, w_novelty * novelty as novelty_part, mmr,
  relaxed, saved from picks p join ranked r on r.user_id = p.user_id and r.project_id = p.project_id join catalog c on c.project_id = p.project_id""", _PICKS)
def run_detail(feed: Feed) -> DataFrame:
    """The results of the stored runs, from what was stored alone."""
    store = _stored(feed)
    rows = store.detail(store.runs(), feed.catalog)
    return rows.select("user_id", "project_id", "rank", "pre_rank", "final_score", "title", F.array_join("sources", ",").alias("sources"), "content_part", "collaborative_part", "novelty_part",
        F.col("detail.diversification.mmr").alias("mmr"), F.col("detail.diversification.relaxed").alias("relaxed"), F.col("detail.saved").alias("saved"))


_EVAL = {
    "first_touches": "select user_id, project_id, min(created_at) as first_touch, min(created_at) filter (where type in ('SAVE', 'BUILD', 'COMPLETE', 'SHARE')) as first_positive from interactions group by user_id, project_id",
    "positives": "select *, count(*) over (partition by user_id) as n_positives, row_number() over (partition by user_id order by first_touch desc, project_id desc) as r from first_touches where first_positive is not null",
    "held": "select * from positives where n_positives >= 5 and r <= greatest(1, least(3, floor(0.2 * n_positives + 0.5)))",
    "cutoffs": "select user_id, min(first_touch) as cutoff, list_sort(list(project_id)) as held_out, any_value(n_positives) as n_positives from held group by user_id",
    "cases": "select c.*, (select count(*) from positives p where p.user_id = c.user_id and p.first_positive < c.cutoff) as training_positives from cutoffs c where training_positives >= 2",
    "training": "select i.*, c.cutoff from interactions i join cases c using (user_id) where i.created_at < c.cutoff",
    "out_of_case": "select distinct user_id, project_id from training where type in ('SAVE', 'BUILD', 'COMPLETE', 'SHARE', 'DISLIKE')",
    "all_items": """select c.user_id, c.cutoff, g.project_id, g.prior, g.slug, coalesce(sum(i.weight), 0) as evidence, count(i.id) filter (where i.type <> 'OPEN') as n_strong from cases c cross join catalog g
      left join interactions i on i.project_id = g.project_id and i.created_at < c.cutoff and i.type in ('OPEN', 'SAVE', 'BUILD', 'COMPLETE', 'SHARE') group by all""",
    "eval_items": "select * from all_items anti join out_of_case using (user_id, project_id)",
    "case_signals": "select user_id, feature, sum(scale * value) as signal from (select user_id, project_id, sum(weight * pow(0.5, date_diff('microsecond', created_at, cutoff) / 86400000000.0::double / 30)) as scale from training where weight <> 0 group by user_id, project_id) join features using (project_id) group by user_id, feature having abs(sum(scale * value)) > 1e-12",
    "case_affinity": "select user_id, project_id, round(least(1, greatest(-1, dot / (len * norm))), 9) as affinity from (select user_id, project_id, sum(signal * value) as dot from case_signals join features using (feature) group by user_id, project_id) join (select user_id, sqrt(sum(signal * signal)) as len from case_signals group by user_id) using (user_id) join norms using (project_id)",
    "r_random": "select 'random' as algorithm, user_id, project_id, row_number() over (partition by user_id order by list_reduce(list_prepend(2166136261::bigint, list_transform(string_split('20260818:' || user_id || ':' || project_id, ''), lambda c: ascii(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295), project_id) as rank from eval_items qualify rank <= 10",
    "r_popularity": "select 'popularity' as algorithm, user_id, project_id, row_number() over (partition by user_id order by evidence desc, prior desc, slug) as rank from eval_items qualify rank <= 10",
    "r_content": "select 'content' as algorithm, user_id, project_id, row_number() over (partition by user_id order by coalesce(affinity, 0) desc, prior desc, slug) as rank from eval_items left join case_affinity using (user_id, project_id) where user_id in (select user_id from case_signals) qualify rank <= 10",
    "case_rows": "select c.user_id as case_id, i.* exclude (user_id), i.user_id as other from cases c join interactions i on i.created_at < c.cutoff and i.user_id <> c.user_id",
    "case_states": """select case_id, other, project_id, coalesce(arg_max(type, row(created_at, id)) filter (where type in ('SAVE', 'UNSAVE', 'DISLIKE')) = 'SAVE', false) as saved,
    coalesce(arg_max(type, row(created_at, id)) filter (where type in ('SAVE', 'DISLIKE')) = 'DISLIKE', false) as disliked, bool_or(type = 'BUILD') as built, bool_or(type = 'COMPLETE') as completed, bool_or(type = 'OPEN') as opened, bool_or(type = 'SHARE') as shared
    from (select * from case_rows union all select user_id, t.* exclude (user_id, cutoff), user_id from training t) group by all""",
    "case_vectors": "select * from (select case_id, other, project_id, case when disliked then 0 else (case when completed then 5 when built then 4 else 0 end) + if(saved, 2, 0) + if(shared, 3, 0) + if(opened, 0.5, 0) end::double as v from case_states) where v > 0",
    "case_seeds": "select case_id, project_id as i, v as w from case_vectors where case_id = other",
    "case_others": "select * from case_vectors where case_id <> other",
    "case_norms": "select case_id, project_id, sum(v * v) as n from case_others group by all",
    "case_pairs": "select s.case_id, s.i, s.w, b.project_id as j, sum(a.v * b.v) as dot, count(*) as overlap from case_seeds s join case_others a on a.case_id = s.case_id and a.project_id = s.i join case_others b on b.case_id = a.case_id and b.other = a.other and b.project_id <> s.i group by all",
    "case_near": """select p.*, round(least(1, dot / (sqrt(x.n) * sqrt(y.n)) * overlap / (overlap + 2.0)), 8) as sim from case_pairs p join case_norms x on x.case_id = p.case_id and x.project_id = i join case_norms y on y.case_id = p.case_id and y.project_id = j
    qualify row_number() over (partition by p.case_id, i order by sim desc, j) <= 20""",
    "case_raw": "select n.case_id as user_id, j as project_id, round(sum(sim * w), 9) as evidence from case_near n where not exists (select 1 from case_seeds s where s.case_id = n.case_id and s.i = n.j) group by all",
    "case_scored": "select user_id, project_id, slug, evidence, round(least(1, greatest(0, r.evidence / max(r.evidence) over (partition by user_id) * trust)), 9) as score from case_raw r join (select user_id, project_id, slug from eval_items) e using (user_id, project_id) join (select case_id as user_id, least(1, sum(w) / 6) as trust from case_seeds group by all) using (user_id)",
    "r_collaborative": "select 'collaborative' as algorithm, user_id, project_id, row_number() over (partition by user_id order by score desc, slug) as rank from case_scored where score >= 0.02 qualify rank <= 10",
    "recs": "select * from r_random union all select * from r_popularity union all select * from r_content union all select * from r_collaborative union all select * from r_hybrid union all select * from r_session union all select * from r_diversified",
    "case_hits": "select algorithm, user_id, count(*) filter (where rank <= 5) as h5, count(*) as h10, sum(1 / log2(rank + 1)) as gain from recs semi join held using (user_id, project_id) group by algorithm, user_id",
}


def _hybrids() -> dict[str, str]:
    """The feed at each case's cutoff, as parts that bring their own."""
    cases = {n: t for n, t in _EVAL.items() if not n.startswith("r_") and n not in ("recs", "case_hits")}
    lists = lambda name, session, rank, table, more=(): f"select '{name}' as algorithm, user_id, project_id, {rank} as rank from ({sql(f'select * from {table} where {rank} <= 10', cases | at_cutoff(session), dict(more))})"
    return {
        "r_hybrid": lists("hybrid", False, "rank", "ranked"), "r_session": lists("hybrid-session", True, "rank", "ranked"),
        "r_diversified": lists("hybrid-session-diversified", True, "final_rank", "picks", diversified("ranked")),
    }


_EVAL = {n: t for n, t in _EVAL.items() if n not in ("recs", "case_hits")} | _hybrids() | {n: _EVAL[n] for n in ("recs", "case_hits")}


@query("select user_id, cutoff, n_positives, array_to_string(held_out, ',') as held_out, training_positives from cases", _EVAL)
def eval_split(feed: Feed) -> DataFrame:
    return evaluation.split(feed.interactions).withColumn("held_out", F.array_join(F.col("held_out").cast("array<string>"), ","))


@query("select user_id, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(user_id || '@' || strftime(cutoff, '%Y-%m-%d %H:%M:%S.%f') || ':' || array_to_string(held_out, ','), ''), lambda c: ascii(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) as fingerprint from cases", _EVAL)
def eval_fingerprint(feed: Feed) -> DataFrame:
    return evaluation.fingerprint(evaluation.split(feed.interactions))


@query("""select * from (with leaves as (select sha256(user_id || '@' || strftime(cutoff, '%Y-%m-%d %H:%M:%S.%f') || ':' || array_to_string(held_out, ',')) as h, left(sha256(user_id::varchar), 4) as four from cases),
  low as (select four, sha256(string_agg(h, '' order by h)) as h, count(*) as n from leaves group by four), high as (select left(four, 2) as two, sha256(string_agg(h, '' order by four)) as h, sum(n) as n from low group by left(four, 2))
  select sum(n)::bigint as n_cases, sha256(string_agg(h, '' order by two)) as fingerprint from high)""", _EVAL)
def eval_split_fingerprint(feed: Feed) -> DataFrame:
    """One hash of the whole split."""
    return evaluation.split_fingerprint(evaluation.split(feed.interactions))


@query("select user_id, project_id from out_of_case", _EVAL)
def eval_exclusions(feed: Feed) -> DataFrame:
    return evaluation.exclusions(evaluation.target_training(feed.interactions, evaluation.split(feed.interactions)))


@query("select user_id, count(*) as n, min(project_id) as first_item, max(project_id) as last_item from eval_items group by user_id", _EVAL)
def eval_universe(feed: Feed) -> DataFrame:
    cases = evaluation.split(feed.interactions)
    items = evaluation.universe(cases, feed.catalog, evaluation.exclusions(evaluation.target_training(feed.interactions, cases)))
    return items.groupBy("user_id").agg(F.count("*").alias("n"), F.min("project_id").alias("first_item"), F.max("project_id").alias("last_item"))


@query("select user_id, project_id, evidence, n_strong from all_items", _EVAL)
def eval_evidence(feed: Feed) -> DataFrame:
    return Evaluation(feed).all_items.select("user_id", "project_id", "evidence", "n_strong")


@query("select algorithm, user_id, project_id, rank from recs", _EVAL)
def eval_recommendations(feed: Feed) -> DataFrame:
    return Evaluation(feed).lists().withColumn("rank", F.col("rank").cast("long"))


@query("select algorithm, user_id, project_id, rank from r_collaborative", _EVAL)
def eval_collaborative(feed: Feed) -> DataFrame:
    """The collaborative baseline: a model of the others' events before each case's cutoff."""
    return evaluation.collaborative_baseline(Evaluation(feed).collaborative, feed.catalog).withColumn("rank", F.col("rank").cast("long"))


@query()
def eval_factors(feed: Feed) -> DataFrame:
    """The lists by learnt factors, alone and blended into the full feed."""
    return Evaluation(feed).factor_lists().withColumn("rank", F.col("rank").cast("long"))


@query()
def eval_report(feed: Feed) -> DataFrame:
    """All nine algorithms on the same cases: accuracy, coverage, diversity and novelty."""
    e = Evaluation(feed)
    lists = cut(e.lists().unionByName(e.factor_lists()), "lists")
    beyond = evaluation.coverage(lists, feed.catalog).drop("items").join(evaluation.diversity(lists, feed.features), "algorithm").join(evaluation.list_novelty(lists, e.all_items), "algorithm")
    return evaluation.assert_finite(evaluation.metrics(lists, e.cases).join(beyond, "algorithm"), ["coverage", "diversity", "novelty"])


@query("""select algorithm, count(*) as cases, round(avg(coalesce(h5, 0) / 5), 9) as precision_5, round(avg(coalesce(h10, 0) / 10), 9) as precision_10, round(avg(coalesce(h5, 0) / len(held_out)), 9) as recall_5,
  round(avg(coalesce(h10, 0) / len(held_out)), 9) as recall_10, round(avg(coalesce(gain, 0) / list_sum(list_transform(range(1, len(held_out) + 1), lambda i: 1 / log2(i + 1)))), 9) as ndcg_10, round(avg(if(coalesce(h10, 0) > 0, 1.0, 0.0)), 9) as hit_10
  from (select distinct algorithm from recs) cross join cases left join case_hits using (algorithm, user_id) group by algorithm""", _EVAL)
def eval_metrics(feed: Feed) -> DataFrame:
    e = Evaluation(feed)
    return evaluation.metrics(cut(e.lists(), "lists"), e.cases)


@query("""select algorithm, items, coverage, diversity, novelty from (select algorithm, count(distinct project_id) as items, round(count(distinct project_id) / (select count(*) from catalog), 9) as coverage from recs group by algorithm)
  join (select algorithm, round(avg(1 - c), 9) as diversity from (select algorithm, user_id, avg(least(1, greatest(0, cosine))) as c from (
    select a.algorithm, a.user_id, a.rank as ra, b.rank as rb, (select coalesce(sum(f.value * g.value), 0) from features f join features g on f.feature = g.feature where f.project_id = a.project_id and g.project_id = b.project_id) / (x.norm * y.norm) as cosine
    from recs a join recs b on a.algorithm = b.algorithm and a.user_id = b.user_id and a.rank < b.rank join norms x on x.project_id = a.project_id join norms y on y.project_id = b.project_id) group by algorithm, user_id) group by algorithm) using (algorithm)
  join (select algorithm, round(avg(n), 9) as novelty from (select r.algorithm, r.user_id, avg(1 - ln(1 + n_strong) / ln(1 + peak)) as n from recs r join all_items i using (user_id, project_id) join (select user_id, max(n_strong) as peak from all_items group by user_id) using (user_id) group by r.algorithm, r.user_id) group by algorithm) using (algorithm)""", _EVAL)
def eval_beyond_accuracy(feed: Feed) -> DataFrame:
    e = Evaluation(feed)
    recommended = cut(e.lists(), "lists")
    return evaluation.coverage(recommended, feed.catalog).join(evaluation.diversity(recommended, feed.features), "algorithm").join(evaluation.list_novelty(recommended, e.all_items), "algorithm")


@query("select user_id, project_id, case when disliked then 'negative' when completed or built or saved or shared then 'positive' else 'neutral' end as label from states where user_id in (select user_id from states where not disliked and (completed or built or saved or shared))")
def bpr_dataset(feed: Feed) -> DataFrame:
    return bpr.dataset(feed.states, feed.catalog)


@query()
def bpr_recommendations(feed: Feed) -> DataFrame:
    """The ten best untouched items of each user by factors trained on all of them."""
    data = bpr.dataset(feed.states, feed.catalog)
    users, items = bpr.train(data, feed.catalog)
    return bpr.normalize(bpr.best_untouched(users, items, data)).withColumn("unit", r9("unit"))


@query("""select 'users' as part, count(distinct user_id) as n, 16 as factors from signed union all select 'items', (select count(*) from catalog), 16""", {"signed": "select user_id from states where not disliked and (completed or built or saved or shared)"})
def bpr_artifact(feed: Feed) -> DataFrame:
    """Factors written, checked against their checksum and read again."""
    path = new_path(feed.spark, "bpr-model")
    bpr.save_model(*bpr.train(bpr.dataset(feed.states, feed.catalog), feed.catalog), path, feed.now)
    users, items = bpr.load_model(feed.spark, path)
    part = lambda df, name, c: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.max(F.size(c)).alias("factors"))
    return part(users, "users", "p").unionByName(part(items, "items", "q"))


@query("""with pairs2 as (select o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey group by all),
  sizes as (select l_partkey, count(*) as n from pairs2 group by 1),
  both2 as (select a.l_partkey as i, b.l_partkey as j, count(*) as overlap from pairs2 a join pairs2 b on a.o_custkey = b.o_custkey and a.l_partkey <> b.l_partkey group by all)
  select i, j, overlap, round(overlap / (sqrt(x.n) * sqrt(y.n)) * overlap / (overlap + 2.0), 8) as similarity, row_number() over (partition by i order by round(overlap / (sqrt(x.n) * sqrt(y.n)) * overlap / (overlap + 2.0), 8) desc, j) as rank
  from both2 join sizes x on x.l_partkey = i join sizes y on y.l_partkey = j qualify rank <= 20""")
def basket_item_neighbours(feed: Feed) -> DataFrame:
    """Items of the same customers' orders: the item-item model on a sparse table."""
    orders, lines = feed.spark.read.parquet(f"{feed.folder}/orders.parquet"), feed.spark.read.parquet(f"{feed.folder}/lineitem.parquet")
    bought = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("project_id")).distinct()
    return retrieval.basket_neighbours(bought).withColumn("rank", F.col("rank").cast("long"))


@query("select project_id, sum(weight) as evidence, count(*) as n_events from interactions where type in ('OPEN', 'SAVE', 'BUILD', 'COMPLETE', 'SHARE') group by project_id")
def stream_popularity(feed: Feed) -> DataFrame:
    """Running evidence of a stream over the event files, drained."""
    rows = ingest.incoming(ingest.events_stream(feed.spark, f"{feed.folder}/events.parquet"))
    return ingest.drain(ingest.running_popularity(ingest.validated(rows, feed.catalog)[0]), "popularity")


@query("""select user_id, min(created_at) as started_at, max(created_at) + interval 30 minute as expires_at, count(*) as n_events from (
  select *, sum(s) over (partition by user_id order by created_at, id rows unbounded preceding) as no from (
    select *, coalesce(date_diff('microsecond', lag(created_at) over (partition by user_id order by created_at, id), created_at) > 1800000000, true)::int as s from interactions)) group by user_id, no""")
def stream_sessions(feed: Feed) -> DataFrame:
    """Session windows of a stream over the event files, drained."""
    rows = ingest.incoming(ingest.events_stream(feed.spark, f"{feed.folder}/events.parquet"))
    out = ingest.drain_sessions(rows, "sessions")
    return out.withColumn("started_at", F.to_timestamp_ntz(F.col("started_at").cast("string"))).withColumn("expires_at", F.to_timestamp_ntz(F.col("expires_at").cast("string")))


@query("""select * from (with flagged as (
  select user_id, id, created_at, id % 40 = 0 as manual, lag(created_at) over w as before from interactions window w as (partition by user_id order by created_at, id)),
begun as (select *, coalesce(date_diff('microsecond', before, created_at) > 21600000000, true) as stale from flagged),
numbered as (select *, sum((stale or manual)::int) over (partition by user_id order by created_at, id rows unbounded preceding) as session_no from begun),
own as (select user_id, session_no, min(created_at) as started_at, max(created_at) as last_active_at, count(*) as n_events, arg_min(manual, (created_at, id)) as manual from numbered group by all)
select user_id, session_no, started_at, last_active_at, n_events, manual, case when lead(manual) over w and date_diff('microsecond', last_active_at, lead(started_at) over w) <= 21600000000 then lead(started_at) over w
  when lead(started_at) over w is not null then last_active_at end as ended_at from own window w as (partition by user_id order by session_no))""")
def stream_session_service(feed: Feed) -> DataFrame:
    """Sessions of a stream over the event files as the session service keeps them, drained; every 40th event is a manual start."""
    rows = ingest.incoming(ingest.events_stream(feed.spark, f"{feed.folder}/events.parquet")).withColumn("manual", F.col("id") % 40 == 0)
    out, _ = session_service.latest(session_service.drain(session_service.session_log(rows, timeout_minutes=feed.timeout), "session-service"))
    ntz = lambda c: F.to_timestamp_ntz(F.col(c).cast("string")).alias(c)
    return out.select("user_id", "session_no", ntz("started_at"), ntz("last_active_at"), "n_events", "manual", ntz("ended_at"))


@query("select distinct user_id, project_id from interactions where type = 'IMPRESSION'")
def stream_impressions(feed: Feed) -> DataFrame:
    """Impressions of a stream over the event files, each item of a user once."""
    rows = ingest.incoming(ingest.events_stream(feed.spark, f"{feed.folder}/events.parquet"))
    return ingest.drain(ingest.deduped_impressions(rows), "impressions", "append").select("user_id", "project_id")


_KEY = "substr(feature, strpos(feature, ':') + 1)"


@query(f"""select feature, {_FAMILY} as family, {_KEY} as key, case {_KEY} when 'UNDER_2_HOURS' then 'Under 2 hours' when 'ONE_EVENING' then 'One evening' when 'WEEKEND' then 'Weekend' when 'ONE_TO_TWO_WEEKS' then '1–2 weeks'
  else case when {_FAMILY} = 'language' then upper({_KEY}) else upper({_KEY}[1]) || lower({_KEY}[2:]) end end as label from (select distinct feature from features)""")
def feature_labels(feed: Feed) -> DataFrame:
    return views.feature_labels(feed.features)


_ITEMS = {"every_item": "select p_partkey as project_id, lpad(p_partkey::varchar, 6, '0') as slug, p_name as title, list_distinct(string_split(p_name, ' ')) as own_tags, lower(p_brand) as own_language, p_size as hours, (p_partkey * 37 % 101) / 100.0::double as share, p_name || ' ' || p_type || ' ' || p_brand as summary, string_split(p_name || ' ' || p_type, ' ') as concepts from part"}


@query("""select project_id, 'duplicate slug' as problem from (select *, count(*) over (partition by slug) as n from every_item) where n > 1
  union all select project_id, 'slug has a bad form' from every_item where not regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$')
  union all select project_id, 'title too short' from every_item where length(trim(title)) < 5 union all select project_id, 'summary too short' from every_item where length(trim(summary)) < 30
  union all select project_id, 'description too short' from every_item where length(trim(summary)) < 300 union all select project_id, 'needs 3 concepts' from every_item where len(concepts) < 3
  union all select project_id, 'needs 1 to 5 tags' from every_item where len(own_tags) not between 1 and 5
  union all select project_id, 'hours are no integer from 1 to 200' from every_item where hours not between 1 and 200 union all select project_id, 'prior out of range' from every_item where share not between 0 and 1
  union all select project_id, 'unknown tag ' || t from (select project_id, unnest(own_tags) as t from every_item) where t not in (select unnest(tag_slugs) from catalog)
  union all select project_id, 'unknown language ' || own_language from every_item where own_language not in (select unnest(language_slugs) from catalog)""", _ITEMS)
def catalog_problems(feed: Feed) -> DataFrame:
    """Integrity of the whole item table; the tags and languages of the items that the event log knows are the known ones."""
    part = tables.table(feed.spark, feed.folder, "part")
    text = part.select(F.col("p_partkey").alias("project_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("summary"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("description"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("concepts"))
    known = lambda c: feed.catalog.select(F.explode(c).alias("slug")).distinct()
    return views.catalog_problems(tables.as_catalog(part).join(text, "project_id"), known("tag_slugs"), known("language_slugs"))


@query("""select position, l.slug as "left", r.slug as "right", chosen as left_id, l.title as left_title, rejected as right_id, r.title as right_title
  from (select *, row_number() over (order by chosen, rejected) as position from (select distinct chosen, rejected from answers)) join catalog l on l.project_id = chosen join catalog r on r.project_id = rejected""")
def onboarding_pairs(feed: Feed) -> DataFrame:
    """The pairs between which users chose, found in the catalog by their slugs."""
    slug = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    pairs = global_rank(feed.answers.select("chosen", "rejected").distinct(), [F.col("chosen"), F.col("rejected")], "position")
    return onboarding.load_pairs(pairs.select("position", slug("chosen").alias("left"), slug("rejected").alias("right")), feed.catalog)


@query("select topic, feature, max(weight) as value from (select topic, 'tag:' || tag as feature, weight from topic_tags) group by all")
def onboarding_topics(feed: Feed) -> DataFrame:
    return onboarding.topic_features(feed.topics)


@query("""select user_id, if(user_id in (select user_id from active), null, difficulty) as difficulty, if(user_id in (select user_id from active), 'ANYTHING', duration) as duration, if(user_id in (select user_id from active), rejected, chosen) as chosen from answers""")
def onboarding_upsert(feed: Feed) -> DataFrame:
    """Users in an active session answer again, without preferences, and choose the other item."""
    old = feed.answers
    again = old.join(feed.active.select("user_id"), "user_id", "left_semi")
    kept, chosen = onboarding.complete(
        old.select("user_id", "difficulty", "duration"), old.select("user_id", "chosen", "rejected"),
        again.select("user_id", F.lit("SURPRISE_ME").alias("difficulty"), F.lit("ANYTHING").alias("duration")), again.select("user_id", F.col("rejected").alias("chosen"), F.col("chosen").alias("rejected")),
    )
    return kept.join(chosen, "user_id").select("user_id", "difficulty", "duration", "chosen")


@query("select user_id, if(user_id in (select user_id from states where disliked), least(1, e + 0.1), e) as e from app_users")
def settings_upsert(feed: Feed) -> DataFrame:
    """Users who dislike something become more adventurous: an upsert of the stored settings."""
    users = feed.users.select("user_id", "e")
    moved = users.join(feed.states.filter("disliked").select("user_id").distinct(), "user_id", "left_semi").select("user_id", clamp01(F.col("e") + 0.1).alias("e"))
    stored = KeyedTable(feed.spark, new_path(feed.spark, "settings"), users.schema, ["user_id"], buckets=16)
    stored.upsert(users, "all")
    stored.upsert(moved, "disliked")
    return stored.rows()


@query("""select * from (with newer as (select p_partkey as project_id, case when p_partkey % 10 = 5 then upper(p_name) else p_name end as title, case when p_partkey % 7 = 2 then p_size + 1 else p_size end as estimated_hours from part where p_partkey % 11 <> 3),
  older as (select p_partkey as project_id, p_name as title, p_size as estimated_hours from part where p_partkey % 13 <> 4)
  select project_id, coalesce(n.title, o.title) as title, coalesce(n.estimated_hours, o.estimated_hours) as estimated_hours, case when o.project_id is null then 'insert' when n.project_id is null then 'delete' else 'update' end as change
  from older o full join newer n using (project_id) where o.project_id is null or n.project_id is null or o.title is distinct from n.title or o.estimated_hours is distinct from n.estimated_hours)""")
def catalog_changes(feed: Feed) -> DataFrame:
    """What turns one version of the item table into another: new, changed and stale items."""
    items = tables.as_catalog(tables.table(feed.spark, feed.folder, "part")).select("project_id", "title", "estimated_hours")
    k = F.col("project_id")
    newer = items.filter(k % 11 != 3).select(k, F.when(k % 10 == 5, F.upper("title")).otherwise(F.col("title")).alias("title"), F.when(k % 7 == 2, F.col("estimated_hours") + 1).otherwise(F.col("estimated_hours")).alias("estimated_hours"))
    return change_set(items.filter(k % 13 != 4), newer, ["project_id"])


@query("""select u.user_id, t.topics, a.chosen, a.rejected, a.difficulty, nullif(a.duration, 'ANYTHING') as duration, if(n < 3, 'too few topics', null) as problem
  from app_users u join answers a using (user_id) join (select user_id, string_agg(tag, ',' order by tag) as topics, count(*) as n from picked_topics group by user_id) t using (user_id)""")
def onboarding_state(feed: Feed) -> DataFrame:
    problems = views.onboarding_problems(feed.answers)
    state = feed.answers.withColumn("topics", F.array_join("topics", ",")).withColumn("duration", F.nullif("duration", F.lit("ANYTHING")))
    return state.join(problems, "user_id", "left").select("user_id", "topics", "chosen", "rejected", "difficulty", "duration", "problem")


@query("""select case when c.project_id is null then 'unknown_project' when floor(v * 1000000) not between 0 and 14400000 then 'dwell_out_of_range' else 'accepted' end as outcome, count(*) as n, sum(weight) as weight
  from interactions i join (select event_id as id, value as v from events) using (id) left join (select project_id from catalog where difficulty <> 'ADVANCED') c on c.project_id = i.project_id group by all""")
def interaction_outcomes(feed: Feed) -> DataFrame:
    """Events validated against the items that aren't advanced, with the event's value as dwell time (thousands of seconds)."""
    events = tables.table(feed.spark, feed.folder, "events")
    dwell = events.select(F.col("event_id").alias("id"), F.floor(F.col("value") * 1_000_000).alias("dwell_ms"))
    good, bad = ingest.validated(feed.interactions.join(dwell, "id"), feed.catalog.filter("difficulty <> 'ADVANCED'"))
    both = good.withColumn("outcome", F.lit("accepted")).select("outcome", "weight").unionByName(bad.select(F.col("reason").alias("outcome"), "weight"))
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("""select user_id, project_id, rank, if(content is null, 0, 1) + if(collaborative is null, 0, 1) + if(session is null, 0, 1) + if(novelty is null, 0, 1) + if(popularity is null, 0, 1) as n_signals,
  content as content_read, collaborative as collaborative_read, session as session_read from ranked where rank <= 10""")
def result_snapshots(feed: Feed) -> DataFrame:
    """The ten best of each user written as JSON and read back; absent signals stay absent."""
    stored = views.to_snapshot(feed.ranked.filter("rank <= 10")).withColumn("m", views.parse_signals(F.col("raw_signals")))
    return stored.select("user_id", "project_id", F.col("rank").cast("long"), F.size("m").alias("n_signals"), *[F.col(f"m.{c}").alias(f"{c}_read") for c in ("content", "collaborative", "session")])


@query("""select u.user_id, u.e, case when u.e <= 0.3 then 'familiar' when u.e >= 0.7 then 'adventurous' else 'balanced' end as mode, i.total, s.saved_items, r.runs, r.last_run_at from app_users u
  join (select user_id, count(*) as total from interactions group by user_id) i using (user_id) join (select user_id, count(*) filter (where saved) as saved_items from states group by user_id) s using (user_id)
  left join (select user_id, count(*) as runs, max(started_at) as last_run_at from all_sessions group by user_id) r using (user_id)""")
def user_insights(feed: Feed) -> DataFrame:
    stats = states.user_stats(feed.interactions, feed.states)
    return views.insights(feed.users, stats, _runs(feed)).select("user_id", "e", "mode", "total", "saved_items", "runs", "last_run_at")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
