"""Labels, integrity checks, onboarding state, insights, and JSON snapshots of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewalk.config import CONFIG
from tidewalk.functions.scalar import discovery_mode, family, finite, lookup

SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"
SIGNALS = ("content", "collaborative", "session", "novelty", "popularity")


def feature_labels(features: DataFrame) -> DataFrame:
    """feature, family, key, label: durations by their names, languages in capitals, everything else as a title."""
    key = F.regexp_extract("feature", "^[^:]*:(.*)$", 1)
    label = F.coalesce(lookup(CONFIG.duration_labels, key), F.when(family(F.col("feature")) == "language", F.upper(key)).otherwise(F.initcap(key)))
    return features.select("feature").distinct().select("feature", family(F.col("feature")).alias("family"), key.alias("key"), label.alias("label"))


def catalog_problems(catalog: DataFrame, tags: DataFrame | None = None, languages: DataFrame | None = None) -> DataFrame:
    """project_id, problem: one row for each rule that an item breaks; rules on the lists of tags and languages (slug) have no item.

    Rules on columns that the catalog lacks, and on lists that aren't given, are left out. A null breaks the rule on it, but
    a source_url may be missing.
    """
    same = lambda c: F.count("*").over(Window.partitionBy(c)) > 1
    short = lambda c, n: F.length(F.trim(c)) < n
    repeats = lambda c: F.size(c) != F.size(F.array_distinct(c))
    hours = F.col("estimated_hours")
    rules = {
        "slug": {"slug has a bad form": ~F.col("slug").rlike(SLUG), "duplicate slug": same("slug")},
        "title": {"title too short": short("title", 5)}, "summary": {"summary too short": short("summary", 30)}, "description": {"description too short": short("description", 300)},
        "estimated_hours": {"hours are no integer from 1 to 200": ~(hours.between(1, 200) & (hours == F.floor(hours)))}, "prior": {"prior out of range": ~F.col("prior").between(0, 1)},
        "tag_slugs": {"needs 1 to 5 tags": ~F.size("tag_slugs").between(1, 5), "tags repeat": repeats("tag_slugs")}, "language_slugs": {"languages repeat": repeats("language_slugs")},
        "concepts": {"needs 3 concepts": F.size("concepts") < 3}, "source_url": {"source is no web address": ~F.coalesce(F.col("source_url").rlike("^https?://"), F.lit(True))},
        "difficulty": {"unknown difficulty": ~F.col("difficulty").isin("BEGINNER", "INTERMEDIATE", "ADVANCED")},
    }
    found = {name: broken for column, own in rules.items() if column in catalog.columns for name, broken in own.items()}
    marked = catalog.select("project_id", F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in found.items()])).alias("problems"))
    out = marked.select("project_id", F.explode("problems").alias("problem"))
    for kind, column, known in (("tag", "tag_slugs", tags), ("language", "language_slugs", languages)):
        if known is None:
            continue
        used = catalog.select("project_id", F.explode(F.array_distinct(column)).alias("slug"))
        none = F.lit(None).cast(catalog.schema["project_id"].dataType).alias("project_id")
        out = out.unionByName(used.join(known, "slug", "left_anti").select("project_id", F.concat(F.lit(f"unknown {kind} "), "slug").alias("problem")))
        out = out.unionByName(known.groupBy("slug").count().filter("count > 1").select(none, F.concat(F.lit(f"duplicate {kind} "), "slug").alias("problem")))
        out = out.unionByName(known.distinct().join(used, "slug", "left_anti").select(none, F.concat(F.lit(f"unused {kind} "), "slug").alias("problem")))
    return out


def items_by_slug(catalog: DataFrame, slugs: DataFrame) -> DataFrame:
    """The catalog's items of the slugs asked for (a column slug; unknown ones have no row, repeated ones count once)."""
    return catalog.join(slugs.select("slug").distinct(), "slug", "left_semi")


def item_by_slug(catalog: DataFrame, slug: str) -> DataFrame:
    """The item of one slug, or no row."""
    return catalog.filter(F.col("slug") == slug)


def refill(ranked: DataFrame, shown: DataFrame, dismissed: DataFrame) -> DataFrame:
    """ranked (user_id, project_id, rank, ...) less what is on the page or was dismissed, with its place among what is new."""
    keys = ["user_id", "project_id"]
    fresh = ranked.join(shown.select(*keys).unionByName(dismissed.select(*keys)), keys, "left_anti")
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("rank")))


def onboarding_problems(answers: DataFrame) -> DataFrame:
    """user_id, problem: answers that a form would refuse."""
    n = F.size(F.coalesce("topics", F.array().cast("array<string>")))
    low, high = 3, 7
    rules = {"too few topics": n < low, "too many topics": n > high, "topics repeat": n != F.size(F.array_distinct("topics")), "chose the rejected item": F.col("chosen") == F.col("rejected")}
    marked = answers.select("user_id", F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])).alias("problems"))
    return marked.select("user_id", F.explode("problems").alias("problem"))


def insights(users: DataFrame, stats: DataFrame, runs: DataFrame) -> DataFrame:
    latest = runs.groupBy("user_id").agg(F.count("*").alias("runs"), F.max("created_at").alias("last_run_at"))
    return users.join(stats, "user_id").join(latest, "user_id", "left").withColumn("mode", discovery_mode(F.col("e")))


def to_snapshot(ranked: DataFrame) -> DataFrame:
    """user_id, project_id, rank, raw_signals: JSON in which an absent signal is null and nothing is infinite."""
    clean = [F.when(finite(F.col(c)), F.col(c)).alias(c) for c in SIGNALS]
    return ranked.select("user_id", "project_id", "rank", F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("raw_signals"))


def parse_signals(json: Column) -> Column:
    """The finite numbers of a JSON object; other entries are left out, and anything malformed is an empty map."""
    entries = F.try_variant_get(F.try_parse_json(json), F.lit("$"), "map<string,variant>")
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, F.lit("$"), "double"))
    numbers = F.transform_values(entries, lambda _, v: number(v))
    return F.coalesce(F.map_filter(numbers, lambda _, v: finite(v)), F.create_map().cast("map<string,double>"))
