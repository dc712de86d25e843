"""Sessions: a gap of more than the timeout starts a new one; exactly the timeout does not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewalk.config import CONFIG
from tidewalk.functions.scalar import age_days, clamp, clamp01, safe_div
from tidewalk.sources.shared import by_key


def sessionize(interactions: DataFrame, timeout_minutes: int = CONFIG.session_timeout_minutes, manual_start: str | None = None) -> DataFrame:
    """interactions with session_no (from 1 per user); a true value of column ``manual_start`` begins a session too."""
    order = Window.partitionBy("user_id").orderBy("created_at", "id")
    gap = F.timestamp_diff("MICROSECOND", F.lag("created_at").over(order), F.col("created_at")) > timeout_minutes * 60_000_000
    starts = F.coalesce(gap, F.lit(True))
    if manual_start:
        starts = starts | F.coalesce(F.col(manual_start), F.lit(False))
    return interactions.withColumn("_new", starts.cast("int")).withColumn("session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def sessions(sessionized: DataFrame) -> DataFrame:
    return sessionized.groupBy("user_id", "session_no").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("last_active_at"), F.count("*").alias("n_events"))


def active_sessions(all_sessions: DataFrame, now: str, timeout_minutes: int) -> DataFrame:
    """Each user's latest session if it is still active at ``now``."""
    last = all_sessions.groupBy("user_id").agg(F.max_by(F.struct("session_no", "started_at", "last_active_at", "n_events"), "session_no").alias("s")).select("user_id", "s.*")
    idle = age_days(F.col("last_active_at"), now) * 1440
    return last.filter(idle <= timeout_minutes).withColumn("expires_at", F.col("last_active_at") + F.make_interval(mins=F.lit(timeout_minutes)))


def session_evidence(rows: DataFrame) -> DataFrame:
    """user_id, evidence (absolute weights, each item and type once), meaningful (all rows of weight)."""
    rows = rows.filter("weight <> 0")
    once = rows.filter("project_id is not null").dropDuplicates(["user_id", "project_id", "type"]).select("user_id", "weight")
    once = once.unionByName(rows.filter("project_id is null").select("user_id", "weight"))
    evidence = once.groupBy("user_id").agg(F.sum(F.abs("weight")).alias("evidence"))
    return rows.groupBy("user_id").agg(F.count("*").alias("meaningful")).join(evidence, "user_id")


def coherence(profile: DataFrame) -> DataFrame:
    """user_id, coherence: the share of the strongest tag signals in all of them."""
    tags = profile.filter(F.col("feature").startswith("tag:")).withColumn("a", F.abs("signal"))
    order = Window.partitionBy("user_id").orderBy(F.desc("a"), "feature")
    tags = tags.withColumn("r", F.row_number().over(order))
    top = F.sum(F.when(F.col("r") <= CONFIG.session_coherence_top, F.col("a")))
    return tags.groupBy("user_id").agg(safe_div(top, F.sum("a")).alias("coherence"))


def session_confidence(evidence: DataFrame, profile: DataFrame) -> DataFrame:
    """user_id, meaningful, evidence, evidence_confidence, coherence, confidence, blend_weight."""
    out = evidence.join(coherence(profile), "user_id", "left").withColumn("coherence", F.coalesce("coherence", F.lit(0.0)))
    out = out.withColumn("evidence_confidence", F.when(F.col("evidence") > 0, F.col("evidence") / (F.col("evidence") + CONFIG.session_half_saturation)).otherwise(0.0))
    floor = CONFIG.session_coherence_floor
    out = out.withColumn("confidence", F.col("evidence_confidence") * (floor + (1 - floor) * F.col("coherence")))
    return out.withColumn("blend_weight", CONFIG.session_max_blend * clamp01(F.col("confidence")))


def blend(long_term: DataFrame, session: DataFrame, confidence: DataFrame) -> DataFrame:
    """user_id, feature, vector: (1 - w) of the long-term and w of the session's unit vector, at unit length again.

    Where one of the two is empty, the other stays as it is.
    """
    w = confidence.select("user_id", clamp(F.col("blend_weight"), 0, CONFIG.session_max_blend).alias("w"))
    has = lambda df, name: df.select("user_id").distinct().withColumn(name, F.lit(True))
    both = long_term.select("user_id", "feature", F.col("vector").alias("l")).join(session.select("user_id", "feature", F.col("vector").alias("s")), ["user_id", "feature"], "full")
    for one in (w, has(long_term, "has_l"), has(session, "has_s")):
        both = both.join(by_key(one), "user_id", "left")
    w = F.when(F.col("has_s").isNull(), 0.0).when(F.col("has_l").isNull(), 1.0).otherwise(F.coalesce("w", F.lit(0.0)))
    raw = both.select("user_id", "feature", ((1 - w) * F.coalesce("l", F.lit(0.0)) + w * F.coalesce("s", F.lit(0.0))).alias("raw")).filter(F.abs("raw") > 1e-12)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("user_id")))
    return raw.select("user_id", "feature", (F.col("raw") / norm).alias("vector"))


def top_features(profile: DataFrame, limit: int = CONFIG.session_top_features) -> DataFrame:
    """Positive tags by strength, relative to the strongest positive tag."""
    tags = profile.filter(F.col("feature").startswith("tag:") & (F.col("signal") > 0))
    user = Window.partitionBy("user_id")
    tags = tags.withColumn("relative", F.col("signal") / F.max("signal").over(user)).withColumn("rank", F.row_number().over(user.orderBy(F.desc(F.round("signal", 9)), "feature")))
    return tags.filter(F.col("rank") <= limit).select("user_id", "feature", "rank", F.col("relative").alias("strength"))


def dedupe_impressions(interactions: DataFrame) -> DataFrame:
    """The first impression of each item in each session."""
    return interactions.filter("type = 'IMPRESSION'").groupBy("user_id", "session_no", "project_id").agg(F.min("created_at").alias("created_at"), F.min("id").alias("id"))
