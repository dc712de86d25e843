"""Stored runs of the feed: what was shown to whom, with all that led to it, as it was then.

A run is a row, each of its results another; what has no column of its own is JSON, in which an absent signal is null and nothing
is infinite. Runs are added and never computed anew; of each user only the newest ``kept_runs`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewalk.config import CONFIG
from tidewalk.functions.scalar import discovery_mode, exploration_limit, finite
from tidewalk.operators.ranking import COMPONENTS, SOURCES
from tidewalk.operators.saved import recent_runs
from tidewalk.operators.views import parse_signals
from tidewalk.sources.shared import cut
from tidewalk.sources.versioned import VersionedTables

VERSION, ALGORITHM = 1, "hybrid-session"
COUNTS = ("content", "collaborative", "popular", "exploration", "merged", "ranked", "final")


def sanitized(column: Column, kind: T.DataType) -> Column:
    """column without numbers that JSON lacks: they become null, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(finite(column), column)
    if isinstance(kind, T.StructType):
        inner = F.struct(*[sanitized(column.getField(f.name), f.dataType).alias(f.name) for f in kind])
        return F.when(column.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: sanitized(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, x: sanitized(x, kind.valueType))
    return column


def to_json(df: DataFrame, name: str, **fields: Column) -> DataFrame:
    """df with the fields as one column of JSON; nulls stay in it."""
    df = df.withColumn(name, F.struct(*[c.alias(k) for k, c in fields.items()]))
    return df.withColumn(name, F.to_json(sanitized(F.col(name), df.schema[name].dataType), {"ignoreNullFields": "false"}))


def run_id(user: Column, now: str) -> Column:
    return F.concat(user.cast("string"), F.lit(f"@{now}"))


def snapshot(feed, shown: DataFrame, limit: int = CONFIG.feed_limit, brand: str = "us") -> tuple[DataFrame, DataFrame]:
    """The runs and results to store for the diversified lists ``shown`` (a written table) of a Feed."""
    count = lambda df, name: df.groupBy("user_id").agg(F.count("*").alias(name))
    runs = feed.weights
    for name, df in zip(COUNTS, (feed.content, feed.collaborative, feed.popular, feed.exploration, feed.merged, feed.ranked, shown)):
        runs = runs.join(count(df, f"n_{name}"), "user_id", "left")
    runs = runs.na.fill(0, [f"n_{name}" for name in COUNTS]).join(feed.active.select("user_id", F.col("session_no").alias("session_id")), "user_id", "left")
    runs = to_json(runs, "ranking_weights", **{c: F.col(f"w_{c}") for c in COMPONENTS})
    e = F.col("e")
    runs = to_json(runs, "diagnostics", version=F.lit(VERSION), pipeline=F.struct(*[F.col(f"n_{name}").alias(name) for name in COUNTS]), limit=F.lit(limit), generated_at=F.lit(feed.now), context=F.struct(
        F.col("cold_start"), (~F.col("has_profile")).alias("profile_empty"), F.struct("session_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence")).alias("session"),
        F.struct(e.alias("preference"), discovery_mode(e).alias("mode"), exploration_limit(e).alias("limit")).alias("exploration"), F.col("has_collaborative").alias("collaborative"),
    ))
    runs = runs.select(run_id(F.col("user_id"), feed.now).alias("run_id"), "user_id", "session_id", F.lit(ALGORITHM).alias("algorithm"), F.lit(feed.now).cast("timestamp_ntz").alias("created_at"),
        F.lit(limit).alias("requested_limit"), e.alias("exploration_preference"), *[f"n_{name}" for name in COUNTS], "ranking_weights", "diagnostics")

    keys = ["user_id", "project_id"]
    rows = feed.explained(shown, brand).join(feed.ranked.select(*keys, "sources", "saved", *COMPONENTS), keys)
    rows = to_json(rows, "raw_signals", **{c: F.col(c) for c in COMPONENTS})
    rows = to_json(rows, "diagnostics", version=F.lit(VERSION), explanation=F.struct("text", "primary", "factors"), saved=F.col("saved"),
        diversification=F.struct("mmr", "max_similarity", "relaxed"), novelty=F.struct(F.col("novelty"), (1 - F.col("popularity")).alias("underexposure")))
    results = rows.select(run_id(F.col("user_id"), feed.now).alias("run_id"), *keys, F.col("final_rank").alias("rank"), "pre_rank", F.col("score").alias("final_score"), *COMPONENTS, "sources", "raw_signals", F.col("text").alias("explanation"), "diagnostics")
    return runs, results


RUN = "version int, limit int, generated_at string, pipeline map<string,long>, context struct<cold_start:boolean,profile_empty:boolean,collaborative:boolean,session:struct<session_id:long,confidence:double>,exploration:struct<preference:double,mode:string,limit:int>>"
RESULT = "version int, saved boolean, explanation struct<text:string,primary:string,factors:array<struct<kind:string,features:array<string>,strength:double>>>, diversification struct<mmr:double,max_similarity:double,relaxed:boolean>, novelty struct<novelty:double,underexposure:double>"


def parse_run(json: Column) -> Column:
    """A run's diagnostics, or null where they are malformed or of before there were any."""
    parsed = F.from_json(json, RUN)
    return F.when(parsed["pipeline"].isNotNull() & parsed["context"].isNotNull(), parsed)


def parse_result(json: Column) -> Column:
    """A result's diagnostics, or null where they are malformed or have no text."""
    parsed = F.from_json(json, RESULT)
    return F.when(parsed["explanation"]["text"].isNotNull(), parsed)


def parse_weights(json: Column) -> Column:
    """The finite weights of known components."""
    return F.map_filter(parse_signals(json), lambda k, _: k.isin(*COMPONENTS))


def parse_sources(sources: Column) -> Column:
    """The known sources, in their order."""
    return F.filter(sources, lambda s: s.isin(*SOURCES))


class RunNotFound(LookupError):
    """A run that isn't stored, or is another user's."""


class RunStore:
    """Runs and results under one path of shared storage, in buckets of users; a change of both is one commit."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path = spark, path
        self.tables = VersionedTables(spark, path, {"results": (None, ["user_id"]), "runs": (None, ["user_id"])}, buckets)

    def record(self, runs: DataFrame, results: DataFrame, batch: str | None = None) -> bool:
        """Add runs with their results, both or neither; a ``batch`` that is stored already changes nothing. Whether it was stored."""
        return self.tables.append({"results": results, "runs": runs}, batch)

    def runs(self, kept: int = CONFIG.kept_runs) -> DataFrame:
        """The newest runs of each user."""
        return recent_runs(self.tables.read("runs"), kept).drop("place")

    def results(self, kept: int = CONFIG.kept_runs) -> DataFrame:
        return self.tables.read("results").join(self.runs(kept).select("user_id", "run_id"), ["user_id", "run_id"], "left_semi")

    def retain(self, kept: int = CONFIG.kept_runs) -> list[int]:
        """Remove older runs and their results where they are: only buckets of users with more than ``kept`` runs are written again, which come back."""
        rewritten: list[int] = []

        def pruned(before: dict) -> dict:
            stored = self.tables.read("runs", state=before)
            rewritten.extend(self.tables.touched("runs", stored.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") > kept)))
            runs = recent_runs(self.tables.read("runs", rewritten, before), kept).drop("place")
            results = self.tables.read("results", rewritten, before).join(runs.select("user_id", "run_id"), ["user_id", "run_id"], "left_semi")
            return {name: self.tables.rewrite(name, rewritten, rows, before) for name, rows in (("results", results), ("runs", runs))}

        self.tables.change(None, pruned)
        return rewritten

    def count(self) -> DataFrame:
        """user_id, stored: how many runs each user has."""
        return self.runs().groupBy("user_id").agg(F.count("*").alias("stored"))

    def recent(self, limit: int = CONFIG.listed_runs) -> DataFrame:
        """The newest runs of each user with their number of results and what the snapshot says of mode and session."""
        n = self.results().groupBy("run_id").agg(F.count("*").alias("n_results"))
        rows = recent_runs(self.runs(), limit).join(n, "run_id", "left").withColumn("d", parse_run(F.col("diagnostics")))
        return rows.select("user_id", "run_id", "place", "created_at", "algorithm", "session_id", F.coalesce("n_results", F.lit(0)).alias("n_results"), "exploration_preference",
            F.col("d.context.exploration.mode").alias("mode"), F.col("d.context.session.confidence").alias("session_confidence"))

    def detail(self, asked: DataFrame, catalog: DataFrame) -> DataFrame:
        """The results of the runs asked for (user_id, run_id), with titles, weights and contributions; another user's run has no row."""
        runs = self.runs().join(asked.select("user_id", "run_id").distinct(), ["user_id", "run_id"], "left_semi")
        runs = runs.select("user_id", "run_id", "created_at", "requested_limit", parse_weights(F.col("ranking_weights")).alias("weights"), parse_run(F.col("diagnostics")).alias("run"))
        rows = self.results().join(runs, ["user_id", "run_id"]).join(catalog.select("project_id", "slug", "title"), "project_id", "left")
        rows = rows.withColumn("detail", parse_result(F.col("diagnostics"))).withColumn("sources", parse_sources(F.col("sources"))).withColumn("raw_signals", parse_signals(F.col("raw_signals")))
        parts = {f"{c}_part": F.col(c) * F.try_element_at("weights", F.lit(c)) for c in COMPONENTS}
        text = F.coalesce("detail.explanation.text", "explanation")
        return rows.withColumns(parts).withColumn("explanation", text).drop("diagnostics")

    def selected(self, asked: DataFrame, catalog: DataFrame) -> DataFrame:
        """``detail`` of one run of each user asked for (user_id, run_id; null: the newest, if there is any); one that isn't the user's is an error."""
        newest = recent_runs(self.runs(), 1).select("user_id", F.col("run_id").alias("newest"))
        named = asked.join(newest, "user_id", "left").select("user_id", F.coalesce("run_id", "newest").alias("run_id")).filter("run_id is not null")
        lost = named.join(self.runs().select("user_id", "run_id"), ["user_id", "run_id"], "left_anti").limit(1).collect()
        if lost:
            raise RunNotFound(f"user {lost[0].user_id} has no run {lost[0].run_id}")
        return self.detail(named, catalog)

    def prune(self, path: str, kept: int = CONFIG.kept_runs) -> "RunStore":
        """A store at another path that has only the newest runs."""
        out = RunStore(self.spark, path)
        out.record(self.runs(kept), self.results(kept))
        return out


def served(feed, store: RunStore, batch: str, limit: int = CONFIG.feed_limit) -> tuple[DataFrame, Exception | None]:
    """The diversified lists and what kept them from being stored, if anything did: a feed is shown even if it can't be recorded."""
    shown = cut(feed.diversified(limit), "shown")
    try:
        store.record(*snapshot(feed, shown, limit), batch)
    except Exception as e:  # noqa: BLE001
        return shown, e
    return shown, None
