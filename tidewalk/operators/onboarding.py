"""What users are asked at the start: topics, pairs of items, and their answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewalk.functions.scalar import feature_id


class OnboardingError(ValueError):
    """The questions don't fit the catalog."""


def topic_features(topics: DataFrame) -> DataFrame:
    """topic, feature, value of topics (topic, tag, weight): what a chosen topic says about tags, by weights above 0 up to 1."""
    kept = topics.filter((F.col("weight") > 0) & (F.col("weight") <= 1))
    return kept.groupBy("topic", feature_id("tag", F.col("tag")).alias("feature")).agg(F.max("weight").alias("value"))


def load_pairs(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """pairs (position, left, right: slugs) with left_id, left_title, right_id and right_title; an unknown slug is an error."""
    side = lambda name: catalog.select(F.col("slug").alias(name), F.col("project_id").alias(f"{name}_id"), F.col("title").alias(f"{name}_title"))
    joined = pairs.join(side("left"), "left").join(side("right"), "right")
    if joined.count() != pairs.count():
        raise OnboardingError("a pair names an item that the catalog lacks, or has twice")
    return joined.select("position", "left", "right", "left_id", "left_title", "right_id", "right_title")


def choices_of(answers: DataFrame, pairs: DataFrame) -> DataFrame:
    """user_id, position, chosen, rejected of answers (user_id, position, slug): a slug that isn't the pair's left side chooses the right one."""
    left = F.col("slug") == F.col("left")
    rows = answers.join(pairs, "position")
    return rows.select("user_id", "position", F.when(left, F.col("left_id")).otherwise(F.col("right_id")).alias("chosen"), F.when(left, F.col("right_id")).otherwise(F.col("left_id")).alias("rejected"))


def choice_problems(answers: DataFrame, pairs: DataFrame) -> DataFrame:
    """user_id, position, problem of answers (user_id, position, slug) that don't answer all pairs once with one of the pair's items.

    ``position`` is null for a user who answers too few or too many.
    """
    n = pairs.count()
    joined = answers.join(pairs.select("position", "left", "right"), "position", "left")
    alone = joined.withColumn("problem", F.when(F.col("left").isNull(), "unknown pair").when(~F.col("slug").isin(F.col("left"), F.col("right")) | F.col("slug").isNull(), "not an item of the pair"))
    found = alone.filter("problem is not null").select("user_id", "position", "problem")
    again = answers.groupBy("user_id", "position").agg(F.count("*").alias("n")).filter("n > 1").select("user_id", "position", F.lit("pair answered again").alias("problem"))
    many = answers.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") != n).select("user_id", F.lit(None).cast(answers.schema["position"].dataType).alias("position"), F.lit("not all pairs once").alias("problem"))
    return found.distinct().unionByName(again).unionByName(many)


def complete(profiles: DataFrame, choices: DataFrame, new_profiles: DataFrame, new_choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles and choices after some users answer (again): all they had said before is replaced, also where they now choose less.

    A difficulty SURPRISE_ME is no preference.
    """
    new_profiles = new_profiles.withColumn("difficulty", F.nullif("difficulty", F.lit("SURPRISE_ME")))
    return upsert(profiles, new_profiles, "user_id"), choices.join(new_profiles.select("user_id"), "user_id", "left_anti").unionByName(new_choices)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key has no row in new, and all rows of new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
