"""Item features and signed interest profiles, in long form (entity, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewalk.config import CONFIG
from tidewalk.functions.scalar import age_days, duration_bucket, family, feature_id, lookup, time_decay


def item_features(catalog: DataFrame) -> DataFrame:
    """project_id, feature, value."""
    langs = F.array_distinct("language_slugs")
    entries = F.concat(
        F.transform(F.array_distinct("tag_slugs"), lambda t: F.struct(feature_id("tag", t).alias("feature"), F.lit(CONFIG.tag).alias("value"))),
        F.transform(langs, lambda x: F.struct(feature_id("lang", x).alias("feature"), (F.lit(CONFIG.language) / F.size(langs)).alias("value"))),
        F.array(F.struct(feature_id("difficulty", F.col("difficulty")).alias("feature"), F.lit(CONFIG.difficulty).alias("value")),
                F.struct(feature_id("duration", duration_bucket(F.col("estimated_hours"))).alias("feature"), F.lit(CONFIG.duration).alias("value"))),
    )
    return catalog.select("project_id", F.explode(entries).alias("f")).select("project_id", "f.*")


def interaction_signals(rows: DataFrame, features: DataFrame, decay: Column | None = None) -> DataFrame:
    """user_id, feature, signal: what rows of weight add to each feature of their item."""
    scale = F.col("weight") * (decay if decay is not None else F.lit(1.0))
    scaled = rows.filter("weight <> 0").withColumn("scale", scale).groupBy("user_id", "project_id").agg(F.sum("scale").alias("scale"))
    return scaled.join(features, "project_id").groupBy("user_id", "feature").agg(F.sum(F.col("scale") * F.col("value")).alias("signal"))


def onboarding_signals(answers: DataFrame, topics: DataFrame, features: DataFrame) -> DataFrame:
    """user_id, feature, signal of onboarding answers.

    answers: user_id, topics (array), chosen, rejected (item ids), difficulty, duration (null or ANYTHING: no preference);
    topics: topic, feature, value.
    """
    weight = CONFIG.onboarding
    by_topic = answers.select("user_id", F.explode(F.array_distinct("topics")).alias("topic")).join(topics, "topic").select("user_id", "feature", (weight["topic"] * F.col("value")).alias("signal"))
    parts = [by_topic]
    for side in ("chosen", "rejected"):
        parts.append(answers.select("user_id", F.col(side).alias("project_id")).join(features, "project_id").select("user_id", "feature", (weight[side] * F.col("value")).alias("signal")))
    parts.append(answers.filter("difficulty is not null").select("user_id", feature_id("difficulty", F.col("difficulty")).alias("feature"), F.lit(weight["difficulty"]).alias("signal")))
    parts.append(answers.filter("duration is not null and duration <> 'ANYTHING'").select("user_id", feature_id("duration", F.col("duration")).alias("feature"), F.lit(weight["duration"]).alias("signal")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("user_id", "feature").agg(F.sum("signal").alias("signal"))


def normalize(signals: DataFrame) -> DataFrame:
    """signals less what is as good as zero, with vector (unit length) and strength (largest is 1)."""
    user = Window.partitionBy("user_id")
    kept = signals.filter(F.abs("signal") > 1e-12)
    return kept.withColumn("vector", F.col("signal") / F.sqrt(F.sum(F.col("signal") * F.col("signal")).over(user))).withColumn("strength", F.col("signal") / F.max(F.abs("signal")).over(user))


def long_term_profile(history: DataFrame, features: DataFrame, onboarding: DataFrame, now: str) -> DataFrame:
    """Decayed signals of the last year and the onboarding's, normalised."""
    age = age_days(F.col("created_at"), now)
    signals = interaction_signals(history.filter(age <= CONFIG.history_days), features, time_decay(age))
    return normalize(signals.unionByName(onboarding).groupBy("user_id", "feature").agg(F.sum("signal").alias("signal")))


def rank_features(profile: DataFrame, limit: int, positive: bool = True) -> DataFrame:
    """The strongest features of one sign in each family; strengths relate to the family's peak over both signs."""
    sign = F.col("signal") > 0 if positive else F.col("signal") < 0
    with_family = profile.withColumn("family", family(F.col("feature")))
    peak = F.max(F.abs("signal")).over(Window.partitionBy("user_id", "family"))
    ranked = with_family.withColumn("family_strength", F.col("signal") / peak).filter(sign)
    order = Window.partitionBy("user_id", "family").orderBy(F.desc(F.abs(F.round("signal", 9))), "feature")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


#: Features of a family that a profile page shows; the other families are shown as a whole, if they are liked.
SHOWN = {"tag": 12, "language": 6}


def profile_view(profile: DataFrame, positive: bool = True) -> DataFrame:
    """The features of one sign that a profile page shows, with their rank in the family."""
    most = lookup(SHOWN, F.col("family"), default=1 << 30 if positive else 0)
    return rank_features(profile, 1 << 30, positive).filter(F.col("rank") <= most)


def answers_of(users: DataFrame, catalog: DataFrame, tags: DataFrame) -> DataFrame:
    """Onboarding answers that stand for each user: the user's number picks topics, items and preferences.

    catalog: with item_no (from 0); tags: tag, tag_no (from 0).
    """
    n_items, n_tags = catalog.count(), tags.count()
    u = F.col("user_id")
    items = catalog.select("item_no", "project_id")
    names = tags.select(F.col("tag_no"), F.col("tag"))
    picks = users.select("user_id", F.explode(F.array(*[((u * 7 + j * 5) % n_tags).cast("int") for j in range(3)])).alias("tag_no"))
    topics = picks.join(names, "tag_no").groupBy("user_id").agg(F.array_sort(F.collect_set("tag")).alias("topics"))
    out = users.select("user_id", ((u * 3) % n_items).alias("c"), ((u * 3 + 1) % n_items).alias("r"),
        lookup({0: "BEGINNER", 1: "INTERMEDIATE", 2: "ADVANCED"}, u % 4).alias("difficulty"),
        lookup({k: v for k, v in enumerate([*CONFIG.duration_hours, CONFIG.duration_rest, "ANYTHING"])}, u % 5).alias("duration"))
    out = out.join(topics, "user_id").join(items.select(F.col("item_no").alias("c"), F.col("project_id").alias("chosen")), "c").join(items.select(F.col("item_no").alias("r"), F.col("project_id").alias("rejected")), "r")
    return out.select("user_id", "topics", "chosen", "rejected", "difficulty", "duration")
