"""The whole recommender as one lazy plan for all users at once; each stage is a DataFrame that queries can ask for."""

from __future__ import annotations

from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewalk.config import CONFIG
from tidewalk.functions.scalar import adjacency, age_days, clamp01, duration_bucket, novelty, r9
from tidewalk.operators import onboarding, profiles, ranking, retrieval, sessions, states
from tidewalk.sources import tables
from tidewalk.sources.shared import by_key, cut


def stage(f):
    """A stage that several others read: it is written once to the shared folder and read from there."""

    @wraps(f)
    def written(self):
        return cut(f(self), f.__name__)

    return cached_property(written)


class Feed:
    """Stages of the recommender over one folder of tables, at the moment ``now``.

    timeout_minutes: events of a user further apart start a new session; the latest is active if it is no older.
    """

    def __init__(self, spark: SparkSession, folder: str, now: str = tables.NOW, timeout_minutes: int = 360):
        self.spark, self.folder, self.now, self.timeout = spark, folder, now, timeout_minutes

    @stage
    def interactions(self) -> DataFrame:
        return tables.interactions(self.spark, self.folder)

    @stage
    def catalog(self) -> DataFrame:
        return tables.catalog(self.spark, self.folder, self.interactions)

    @stage
    def users(self) -> DataFrame:
        return tables.users(self.spark, self.folder, self.interactions)

    @stage
    def features(self) -> DataFrame:
        return profiles.item_features(self.catalog)

    @stage
    def states(self) -> DataFrame:
        return states.project_states(self.interactions)

    @cached_property
    def excluded(self) -> DataFrame:
        return self.states.filter("excluded").select("user_id", "project_id")

    @stage
    def sessionized(self) -> DataFrame:
        return sessions.sessionize(self.interactions, self.timeout)

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions.sessions(self.sessionized)

    @stage
    def active(self) -> DataFrame:
        return sessions.active_sessions(self.sessions, self.now, self.timeout)

    @cached_property
    def history(self) -> DataFrame:
        """All events outside active sessions."""
        return self.sessionized.join(self.active.select("user_id", "session_no"), ["user_id", "session_no"], "left_anti")

    @cached_property
    def session_rows(self) -> DataFrame:
        return self.sessionized.join(self.active.select("user_id", "session_no"), ["user_id", "session_no"], "left_semi")

    @stage
    def tags(self) -> DataFrame:
        tags = self.catalog.select(F.explode("tag_slugs").alias("tag")).distinct()
        return tags.withColumn("tag_no", F.row_number().over(Window.orderBy("tag")) - 1)

    @stage
    def answers(self) -> DataFrame:
        numbered = self.catalog.withColumn("item_no", F.row_number().over(Window.orderBy("project_id")) - 1)
        return profiles.answers_of(self.users, numbered, self.tags)

    @cached_property
    def onboarding(self) -> DataFrame:
        return profiles.onboarding_signals(self.answers, onboarding.topic_features(self.topics), self.features)

    @cached_property
    def topics(self) -> DataFrame:
        """topic, tag, weight: each tag names a topic that also has half of the next tag."""
        n = F.count("*").over(Window.partitionBy())
        after = self.tags.select((F.pmod(F.col("tag_no") - 1, n)).alias("tag_no"), F.col("tag").alias("next"))
        return self.tags.join(after, "tag_no").select(F.col("tag").alias("topic"), F.inline(F.array(F.struct(F.col("tag"), F.lit(1.0).alias("weight")), F.struct(F.col("next").alias("tag"), F.lit(0.5).alias("weight")))))

    @stage
    def long_term(self) -> DataFrame:
        return profiles.long_term_profile(self.history, self.features, self.onboarding, self.now)

    @stage
    def session_profile(self) -> DataFrame:
        return profiles.normalize(profiles.interaction_signals(self.session_rows, self.features))

    @stage
    def confidence(self) -> DataFrame:
        return sessions.session_confidence(sessions.session_evidence(self.session_rows), self.session_profile)

    @stage
    def effective(self) -> DataFrame:
        return sessions.blend(self.long_term, self.session_profile, self.confidence)

    @stage
    def popularity(self) -> DataFrame:
        return retrieval.popularity_scores(self.catalog, retrieval.popularity_evidence(self.interactions))

    @stage
    def popular(self) -> DataFrame:
        return retrieval.popularity_candidates(self.popularity, self.users, self.excluded)

    @stage
    def affinities(self) -> DataFrame:
        return retrieval.affinity(self.effective, self.features)

    @cached_property
    def content(self) -> DataFrame:
        return self.frame.filter("content_place is not null").select("user_id", "project_id", "affinity", F.col("content_place").alias("rank"))

    @cached_property
    def signals(self) -> DataFrame:
        return retrieval.collaborative_signals(self.states)

    @cached_property
    def pairs(self) -> DataFrame:
        return retrieval.item_pairs(self.signals)

    @stage
    def collaborative_scores(self) -> DataFrame:
        return retrieval.collaborative_scores(self.signals, self.pairs, self.excluded)

    @stage
    def collaborative(self) -> DataFrame:
        return retrieval.collaborative_candidates(self.collaborative_scores, self.catalog)

    @cached_property
    def session_affinity(self) -> DataFrame:
        """user_id, project_id, raw and score of users with a meaningful session, where they share a feature."""
        vectors = self.session_profile.join(self.confidence.select("user_id"), "user_id", "left_semi")
        return retrieval.affinity(vectors, self.features).select("user_id", "project_id", F.col("affinity").alias("raw"), F.greatest(F.lit(0.0), "affinity").alias("score"))

    @stage
    def frame(self) -> DataFrame:
        """Every pair that any score knows, with all its scores, flags and places among the candidates: users' rows meet once, and candidates are rows of this table."""
        return retrieval.with_places(retrieval.item_signals(
            self.users, self.catalog, self.popularity, self.affinities, self.collaborative_scores, self.popular, self.excluded, self.states.filter("saved"), self.session_affinity.withColumnRenamed("score", "session")
        ))

    @cached_property
    def exploration(self) -> DataFrame:
        return self.frame.filter("exploration_place is not null").select("user_id", "project_id", "exploration", "plausibility", F.col("exploration_place").alias("rank"))

    @cached_property
    def candidates(self) -> DataFrame:
        """Rows of the frame that any source names, with sources and signals as of ``ranking.merge_candidates``."""
        given = {"content": ("content_place", "affinity"), "collaborative": ("collaborative_place", "collaborative"), "popular": ("popular", "popularity"), "exploration": ("exploration_place", "exploration")}
        found = ranking.named({s: F.when(F.col(place).isNotNull(), F.col(signal)) for s, (place, signal) in given.items()})
        return self.frame.filter(" or ".join(f"{place} is not null" for place, _ in given.values())).withColumns(found)

    @cached_property
    def merged(self) -> DataFrame:
        return self.candidates.select("user_id", "project_id", "sources", "signals")

    @stage
    def weights(self) -> DataFrame:
        """Ranking weights of each user."""
        yes = lambda df, name: df.select("user_id").distinct().withColumn(name, F.lit(True))
        meaningful = self.interactions.filter("type <> 'IMPRESSION'").groupBy("user_id").agg(F.count("*").alias("n"))
        out = self.users.join(by_key(meaningful), "user_id", "left").withColumn("cold_start", F.coalesce("n", F.lit(0)) < CONFIG.cold_start_interactions).drop("n")
        out = out.join(by_key(self.confidence.select("user_id", "confidence")), "user_id", "left")
        for df, name in ((self.effective, "has_profile"), (self.collaborative_scores, "has_collaborative"), (self.session_profile.join(self.confidence, "user_id", "left_semi"), "has_session")):
            out = out.join(by_key(yes(df, name)), "user_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
        return ranking.ranking_weights(out)

    @cached_property
    def inputs(self) -> DataFrame:
        """Signals of every candidate that stays; null where there is no evidence."""
        rows = self.candidates.filter("not excluded").select("user_id", "project_id", "sources", F.col("affinity").alias("content"), "collaborative", "session", "novelty", "popularity", "slug", "prior", "saved")
        return rows.join(by_key(self.weights), "user_id").withColumn("session", F.when(F.col("has_session"), F.coalesce("session", F.lit(0.0))))

    @stage
    def ranked(self) -> DataFrame:
        return ranking.rank_candidates(self.inputs)

    def diversified(self, limit: int = CONFIG.feed_limit) -> DataFrame:
        return ranking.diversify(self.ranked, self.features, min(CONFIG.feed_max, max(1, limit)))

    def explained(self, feed: DataFrame, brand: str = "us") -> DataFrame:
        """feed (user_id, project_id, ...; a written table) with primary, text and factors."""
        keys = ["user_id", "project_id"]
        return feed.join(ranking.explain(self.reasons(feed.select(*keys).join(self.ranked, keys)), brand), keys)

    def reasons(self, items: DataFrame) -> DataFrame:
        """items (user_id, project_id and their signals) with what an explanation is made of; profiles are joined on the items' features alone."""
        keys = ["user_id", "project_id"]
        shown = items.select(*keys).join(self.features.drop("value"), "project_id")
        is_a = lambda prefix: F.col("feature").startswith(prefix)
        entry = F.struct(F.substring_index("feature", ":", -1).alias("key"), "signal")
        listed = lambda prefix, name: F.collect_list(F.when(is_a(prefix), entry)).alias(name)
        taste = shown.join(self.long_term.select("user_id", "feature", "signal"), ["user_id", "feature"]).groupBy(*keys).agg(
            listed("tag:", "taste_tags"), listed("lang:", "languages"), *[F.max(F.when(is_a(f"{x}:"), F.col("signal"))).alias(f"{x}_signal") for x in ("difficulty", "duration")]
        )
        now = shown.join(self.session_profile.select("user_id", "feature", "signal"), ["user_id", "feature"]).groupBy(*keys).agg(listed("tag:", "session_tags"))
        items = items.join(self.catalog.select("project_id", "difficulty", duration_bucket(F.col("estimated_hours")).alias("duration")), "project_id").join(taste, keys, "left").join(now, keys, "left")
        title = self.catalog.select(F.col("project_id").alias("seed_id"), "title")
        seeds = self.collaborative_scores.join(items.select(*keys), keys, "left_semi").select(*keys, F.posexplode("support").alias("place", "seed_id")).join(title, "seed_id")
        seeds = seeds.join(self.signals.select("user_id", F.col("project_id").alias("seed_id"), "state"), ["user_id", "seed_id"])
        seeds = seeds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "title", "state"))).alias("s")).select(*keys, F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["state"].alias("state"))).alias("seeds"))
        contributing = self.history.filter((F.col("weight") != 0) & (age_days(F.col("created_at"), self.now) <= CONFIG.history_days)).select("user_id").distinct().withColumn("warm", F.lit(True))
        items = items.join(seeds, keys, "left").join(contributing, "user_id", "left").withColumn("cold", F.col("warm").isNull())
        empty = F.array().cast("array<struct<key:string,signal:double>>")
        for name in ("taste_tags", "session_tags", "languages"):
            items = items.withColumn(name, F.coalesce(name, empty))
        return items.withColumn("adjacency", adjacency(F.coalesce("content", F.lit(0.0)))).withColumn("underexposure", 1 - clamp01(F.col("popularity")))

    def context(self, pairs: DataFrame, brand: str = "us") -> DataFrame:
        """What the feed would make of single items: for pairs (user_id, project_id) of users with a profile, the signals, score and explanation.

        Only the pairs are scored. Excluded items are scored too and have ``excluded``.
        """
        keys = ["user_id", "project_id"]
        pairs = cut(pairs.select(*keys).distinct(), "pairs")
        rows = pairs.join(self.catalog.select("project_id", "slug", "prior"), "project_id").join(self.popularity.select("project_id", "popularity"), "project_id").join(self.weights.filter("has_profile"), "user_id")
        rows = rows.join(retrieval.pair_affinity(pairs, self.effective, self.features).withColumnRenamed("affinity", "content"), keys, "left").withColumn("content", F.coalesce("content", F.lit(0.0)))
        rows = rows.join(self.collaborative_scores.select(*keys, "collaborative"), keys, "left")
        vectors = self.session_profile.join(self.confidence.select("user_id"), "user_id", "left_semi")
        session = retrieval.pair_affinity(pairs, vectors, self.features).select(*keys, F.greatest(F.lit(0.0), "affinity").alias("session"))
        rows = rows.join(session, keys, "left").withColumn("session", F.when(F.col("has_session"), F.coalesce("session", F.lit(0.0))))
        rows = rows.withColumn("novelty", r9(novelty(F.col("popularity"), F.col("content"))))
        rows = rows.withColumn("sources", F.when(F.col("collaborative").isNull(), F.array(F.lit("content"))).otherwise(F.array(F.lit("content"), F.lit("collaborative"))))
        state = self.states.select(*keys, "saved", "excluded")
        rows = rows.join(state, keys, "left").withColumn("saved", F.coalesce("saved", F.lit(False))).withColumn("excluded", F.coalesce("excluded", F.lit(False)))
        scored = cut(ranking.rank_candidates(rows).drop("rank"), "context")
        return scored.join(ranking.explain(self.reasons(scored), brand), keys)
