"""Saved items with their scores, facets, filters and orders; stored runs and their retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewalk.config import CONFIG
from tidewalk.functions.scalar import duration_bucket, lookup, novelty, r9

SORTS = ("recent", "match", "shortest", "difficulty", "adventurous")


def saved_page(states: DataFrame, catalog: DataFrame, popularity: DataFrame, affinities: DataFrame) -> DataFrame:
    kept = states.filter("saved").select("user_id", "project_id", "saved_at", "built", "completed").join(catalog, "project_id")
    rows = kept.join(popularity.select("project_id", "popularity"), "project_id").join(affinities, ["user_id", "project_id"], "left")
    match = F.greatest(F.lit(0.0), F.coalesce("affinity", F.lit(0.0)))
    return rows.withColumn("match_score", match).withColumn("novelty_score", r9(novelty(F.col("popularity"), F.coalesce("affinity", F.lit(0.0))))).drop("popularity", "affinity")


def apply_filters(items: DataFrame, tag: str | None = None, language: str | None = None, difficulty: str | None = None, duration: str | None = None) -> DataFrame:
    """Items that pass every filter given."""
    if tag:
        items = items.filter(F.array_contains("tag_slugs", tag))
    if language:
        items = items.filter(F.array_contains("language_slugs", language))
    if difficulty:
        items = items.filter(F.col("difficulty") == difficulty)
    if duration:
        items = items.filter(duration_bucket(F.col("estimated_hours")) == duration)
    return items


def sort_saved(items: DataFrame, sort: str = "recent") -> DataFrame:
    """items with their place in each user's list."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    first = {"match": F.desc("match_score"), "shortest": F.col("estimated_hours"), "adventurous": F.desc("novelty_score"), "difficulty": lookup({"BEGINNER": 0, "INTERMEDIATE": 1, "ADVANCED": 2}, F.col("difficulty"))}
    order = [first[sort]] if sort in first else []
    return items.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order, F.desc("saved_at"), "slug")))


def facets(items: DataFrame) -> DataFrame:
    """user_id, kind, value, n of the tags and languages of saved items."""
    parts = [items.select("user_id", F.lit(kind).alias("kind"), F.explode(column).alias("value")) for kind, column in (("tag", "tag_slugs"), ("language", "language_slugs"))]
    return parts[0].unionByName(parts[1]).groupBy("user_id", "kind", "value").agg(F.count("*").alias("n"))


def recent_runs(runs: DataFrame, limit: int = CONFIG.listed_runs) -> DataFrame:
    """The latest runs of each user: runs has user_id, run_id, created_at."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)


def run_snapshot(feed) -> DataFrame:
    """One row per user of what a run stores: candidate counts by stage, weights and context."""
    count = lambda df, name: df.groupBy("user_id").agg(F.count("*").alias(name))
    out = feed.weights
    for name in ("content", "collaborative", "popular", "exploration", "merged"):
        out = out.join(count(getattr(feed, name), f"n_{name}"), "user_id", "left")
    return out.join(count(feed.ranked, "n_ranked"), "user_id", "left").na.fill(0, [f"n_{x}" for x in ("content", "collaborative", "popular", "exploration", "merged", "ranked")])
