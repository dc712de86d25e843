"""Merging candidates, ranking them by transparent weights, diversifying the list, and saying why."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewalk.config import CONFIG
from tidewalk.functions.scalar import clamp, clamp01, discovery_mode, diversification_lambda, finite, join_natural, lookup, max_items_per_tag, prose_label, r9, safe_div

SOURCES = ("content", "collaborative", "popular", "exploration")
COMPONENTS = ("content", "collaborative", "session", "novelty", "popularity")


def merge_candidates(parts: dict[str, DataFrame]) -> DataFrame:
    """user_id, project_id, sources (in order of SOURCES), signals (map of the largest signal by source).

    parts: for each source user_id, project_id, signal.
    """
    rows = None
    for source in SOURCES:
        part = parts[source].filter(finite(F.col("signal"))).select("user_id", "project_id", *[F.col("signal").alias(s) if s == source else F.lit(None).cast("double").alias(s) for s in SOURCES])
        rows = part if rows is None else rows.unionByName(part)
    merged = rows.groupBy("user_id", "project_id").agg(*[F.max(s).alias(s) for s in SOURCES])
    return merged.select("user_id", "project_id", *[x.alias(c) for c, x in named({s: F.col(s) for s in SOURCES}).items()])


def named(signals: dict[str, Column]) -> dict[str, Column]:
    """sources and signals of a pair from its signal by source, null where the source lacks it."""
    found = F.filter(F.array(*[F.struct(F.lit(s).alias("source"), signals[s].alias("signal")) for s in SOURCES]), lambda x: x["signal"].isNotNull())
    return {"sources": F.transform(found, lambda x: x["source"]), "signals": F.map_from_entries(found)}


def filter_candidates(merged: DataFrame, catalog: DataFrame, excluded: DataFrame) -> DataFrame:
    """merged with reason: unknown_project before excluded_state, null for what stays."""
    known = catalog.select("project_id", F.lit(True).alias("known"))
    out = excluded.select("user_id", "project_id", F.lit(True).alias("out"))
    rows = merged.join(known, "project_id", "left").join(out, ["user_id", "project_id"], "left")
    return rows.withColumn("reason", F.when(F.col("known").isNull(), "unknown_project").when(F.col("out").isNotNull(), "excluded_state")).drop("known", "out")


def ranking_weights(users: DataFrame) -> DataFrame:
    """users (user_id, e, cold_start, confidence, has_profile, has_collaborative, has_session) with a weight for each component.

    A component that the user lacks has a null weight; the others add up to 1, and are equal if all are 0.
    """
    e, has = clamp01(F.col("e")), {"content": F.col("has_profile"), "collaborative": F.col("has_collaborative"), "session": F.col("has_session"), "novelty": F.lit(True), "popularity": F.lit(True)}
    raw = {c: F.greatest(F.lit(0.0), CONFIG.ranking[c] + CONFIG.slopes[c] * e) for c in COMPONENTS}
    raw["popularity"] = raw["popularity"] * F.when(F.col("cold_start"), CONFIG.cold_start_popularity).otherwise(1.0)
    raw["session"] = raw["session"] * clamp01(F.coalesce("confidence", F.lit(0.0)))
    out = users.select("*", *[F.when(has[c], raw[c]).alias(f"raw_{c}") for c in COMPONENTS])
    total, n = sum((F.coalesce(f"raw_{c}", F.lit(0.0)) for c in COMPONENTS), F.lit(0.0)), sum((F.col(f"raw_{c}").isNotNull().cast("int") for c in COMPONENTS), F.lit(0))
    return out.select(*users.columns, *[r9(F.when(F.col(f"raw_{c}").isNull(), None).when(total > 0, F.col(f"raw_{c}") / total).otherwise(F.lit(1.0) / n)).alias(f"w_{c}") for c in COMPONENTS])


def rank_candidates(inputs: DataFrame) -> DataFrame:
    """inputs with score and rank: the weighted sum of present signals, saved items at a discount.

    inputs: user_id, project_id, slug, prior, saved, content, collaborative, session, novelty, popularity, w_*.
    """
    total = sum((F.coalesce(F.col(f"w_{c}") * clamp(F.col(c), -1 if c == "content" else 0, 1), F.lit(0.0)) for c in COMPONENTS), F.lit(0.0))
    score = clamp01(total) * F.when(F.col("saved"), CONFIG.saved_factor).otherwise(1.0)
    return by_score(inputs.withColumn("score", r9(score)))


def by_score(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("prior"), "slug")
    return scored.withColumn("rank", F.row_number().over(order))


def contributions(ranked: DataFrame) -> DataFrame:
    """What each component adds to a score; null where signal or weight is missing."""
    return ranked.select("user_id", "project_id", "rank", *[r9(F.col(f"w_{c}") * F.col(c)).alias(f"{c}_part") for c in COMPONENTS])


#: Scores and similarities have 9 digits and lambda two or three: so no half is left to round.
MMR_DIGITS = 12


def _pick(scores, tags, vectors, lam: float, cap: int, limit: int) -> list[tuple]:
    """Maximal marginal relevance within the band of good scores: (index, mmr, similarity, relaxed) in order of choice."""
    left, nearest, used, out = np.ones(len(scores), bool), np.zeros(len(scores)), np.zeros(tags.shape[1], int), []
    while len(out) < limit and left.any():
        value = np.where(left & (scores >= CONFIG.quality_ratio * scores[left].max()), np.round(lam * scores - (1 - lam) * nearest, MMR_DIGITS), -np.inf)
        allowed = ~tags[:, used >= cap].any(1) & (nearest < CONFIG.near_duplicate)
        relaxed = not np.isfinite(value[allowed]).any()
        best = int(np.argmax(value if relaxed else np.where(allowed, value, -np.inf)))  # the first of equals has the better rank
        out.append((best, value[best], nearest[best], relaxed))
        left[best] = False
        used += tags[best]
        nearest = np.maximum(nearest, np.round(np.clip(vectors @ vectors[best], 0, 1), 9))
    return out


DIVERSIFIED = "user_id long, project_id long, score double, pre_rank int, final_rank int, mmr double, max_similarity double, relaxed boolean, applied boolean"


def diversify(ranked: DataFrame, features: DataFrame, limit: int = CONFIG.feed_limit) -> DataFrame:
    """The feed of each user: its choice depends on what was chosen before, so it runs per user on at most 110 candidates."""
    limit = max(0, int(limit))
    entry = F.collect_list(F.struct(F.xxhash64("feature").alias("f"), "value", (F.col("feature").startswith("tag:") & (F.col("value") != 0)).alias("tag")))
    with_features = features.groupBy("project_id").agg(entry.alias("x")).select("project_id", *[F.col(f"x.{c}").alias(c) for c in ("f", "value", "tag")])
    rows = ranked.join(with_features, "project_id", "left").withColumn("lam", diversification_lambda(F.col("e"))).withColumn("cap", max_items_per_tag(limit, F.col("e")))

    def one_user(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        lam, cap, scores = float(pdf.lam[0]), int(pdf.cap[0]), pdf.score.to_numpy(float)
        applied = limit > 0 and len(pdf) >= CONFIG.min_diversify
        if applied:
            own = [(k, f, v, t) for k, (f, v, t) in enumerate(zip(pdf.f, pdf.value, pdf.tag)) if f is not None]
            item = np.repeat([k for k, *_ in own], [len(f) for _, f, *_ in own]).astype(int)
            flat = [np.concatenate([x[c] for x in own]) if own else np.zeros(0) for c in (1, 2, 3)]
            names, which = np.unique(flat[0], return_inverse=True)
            matrix, tags = np.zeros((len(pdf), len(names))), np.zeros((len(pdf), len(names)), bool)
            matrix[item, which], tags[item, which] = flat[1], flat[2].astype(bool)
            norm = np.linalg.norm(matrix, axis=1, keepdims=True)
            picks = _pick(scores, tags, matrix / np.where(norm == 0, 1, norm), lam, cap, limit)
        else:
            picks = [(i, lam * s, 0.0, False) for i, s in enumerate(scores[:limit])]
        at = [p[0] for p in picks]
        return pd.DataFrame({
            "user_id": pdf.user_id[at].to_numpy(), "project_id": pdf.project_id[at].to_numpy(), "score": scores[at], "pre_rank": pdf["rank"][at].to_numpy(), "final_rank": range(1, len(at) + 1),
            "mmr": [round(p[1], MMR_DIGITS) for p in picks], "max_similarity": [round(p[2], 9) for p in picks], "relaxed": [p[3] for p in picks], "applied": applied,
        })

    return rows.select("user_id", "project_id", "score", "rank", "lam", "cap", "f", "value", "tag").groupBy("user_id").applyInPandas(one_user, DIVERSIFIED)


# The words of explanations that results must have. The name of the product is a parameter.
DURATION_PROSE = {"UNDER_2_HOURS": "under-two-hour", "ONE_EVENING": "one-evening", "WEEKEND": "weekend-sized", "ONE_TO_TWO_WEEKS": "week-long"}
DIFFICULTY_PROSE = {"BEGINNER": "beginner-friendly", "INTERMEDIATE": "intermediate", "ADVANCED": "advanced"}
STATE_PROSE = {"completed": "completed", "built": "are building", "saved": "saved", "shared": "shared", "opened": "opened"}
FIXED = {
    "taste": "Because you like {tags} projects.",
    "onboarding": "Based on the interests you selected during onboarding: {tags}.",
    "session": "You've been exploring {now} projects in this session.",
    "session and taste": "Your current session has shifted towards {now}, while this still matches your broader {tags} interests.",
    "also session": "You've also been exploring {now} this session.",
    "fit": "Fits your preference for {fits} projects.",
    "one seed": "People who liked “{first}”, which you {state}, also liked this.",
    "two seeds": "People who liked “{first}” and “{second}”, which you {state}, also liked this.",
    "two seeds, two states": "People who liked “{first}” (which you {state}) and “{second}” (which you {other}) also liked this.",
    "adventurous": "You're in a more adventurous discovery mode, so {brand} is showing a less familiar project related to {tag}.",
    "adjacent": "A bit of a wildcard: this explores an adjacent area while still matching your {tag} interests.",
    "rare": "This is less commonly explored, but still overlaps with your interest in {tag}.",
    "popular": "Popular with {brand} users — a good place to start.",
    "popular and taste": "Popular with {brand} users, and related to your interest in {tag}.",
    "catalog": "From the {brand} catalog.",
}
# Words of our own, where results may say it in any way.
FREE = {
    "also taste": "Your interest in {tags} speaks for it too.",
    "rare alone": "Few others have found this one yet.",
    "weak taste": "Has to do with your interest in {tag}.",
}


def _say(name: str, **parts: Column | str) -> Column:
    """A sentence with its blanks filled; null if one of them is."""
    text = re.split(r"\{(\w+)\}", {**FIXED, **FREE}[name])
    filled = [F.lit(x) if k % 2 == 0 else parts[x] if isinstance(parts[x], Column) else F.lit(parts[x]) for k, x in enumerate(text)]
    return F.concat(*filled)


def _strongest(entries: Column, limit: int) -> Column:
    """Keys of the entries (key, signal) of positive signal, strongest first."""
    positive = F.filter(entries, lambda x: x["signal"] > 0)
    ordered = F.array_sort(F.transform(positive, lambda x: F.struct(F.negative(F.round(x["signal"], 9)).alias("minus"), x["key"].alias("key"))))
    return F.slice(F.transform(ordered, lambda x: x["key"]), 1, limit)


def explain(items: DataFrame, brand: str = "us") -> DataFrame:
    """user_id, project_id, primary, text, factors for each recommended item.

    items: user_id, project_id, content, collaborative, session, novelty, popularity (null: no such signal), adjacency,
    underexposure, e, confidence, cold, sources, w_content, w_collaborative, w_novelty, taste_tags, session_tags
    and languages (arrays of key and signal), difficulty_signal, duration_signal, difficulty, duration, and seeds
    (array of title and state).
    """
    gate, n = CONFIG.explain, CONFIG.explain_features
    c = F.col
    at_least = lambda name, least: F.coalesce(c(name) >= least, F.lit(False))
    from_source = lambda name: F.array_contains("sources", name)
    rows = items.withColumn("tags", _strongest(c("taste_tags"), n)).withColumn("now_tags", _strongest(c("session_tags"), n)).withColumn("lang", _strongest(c("languages"), 1))
    rows = rows.withColumn("affinity", F.coalesce("content", F.lit(0.0))).withColumn("seeds", F.slice(F.coalesce("seeds", F.array().cast("array<struct<title:string,state:string>>")), 1, n))
    rows = rows.withColumn("taste", (F.size("tags") > 0) & (c("affinity") >= gate["content"]))
    session_score = F.greatest(F.lit(0.0), F.coalesce("session", F.lit(0.0)))
    rows = rows.withColumn("now", at_least("confidence", gate["session_confidence"]) & (F.size("now_tags") > 0) & c("session").isNotNull() & (session_score >= gate["session"]))
    fits = F.array_compact(F.array(F.when(c("duration_signal") > 0, F.element_at(F.create_map(*[F.lit(x) for kv in DURATION_PROSE.items() for x in kv]), c("duration"))),
        F.when(c("difficulty_signal") > 0, F.element_at(F.create_map(*[F.lit(x) for kv in DIFFICULTY_PROSE.items() for x in kv]), c("difficulty"))), F.get("lang", 0)))
    rows = rows.withColumn("fits", fits).withColumn("fit", (F.size("fits") > 0) & (c("affinity") > 0))
    rows = rows.withColumn("popular", at_least("popularity", gate["popularity"]) & from_source("popular"))
    rows = rows.withColumn("others", at_least("collaborative", gate["collaborative"]) & (F.size("seeds") > 0) & from_source("collaborative"))
    rows = rows.withColumn("content_part", F.coalesce("w_content", F.lit(0.0)) * F.greatest(F.lit(0.0), c("affinity")))
    rows = rows.withColumn("others_part", F.when(c("others"), F.coalesce("w_collaborative", F.lit(0.0)) * c("collaborative")).otherwise(0.0))
    rows = rows.withColumn("others_lead", c("others") & (~c("taste") | (c("others_part") > c("content_part"))))
    rows = rows.withColumn("new_tag", F.when(c("taste"), F.get("tags", 0)).otherwise(F.get(_strongest(c("taste_tags"), 1), 0)))
    near = at_least("adjacency", gate["adjacency"]) & c("new_tag").isNotNull()
    rare = at_least("underexposure", gate["underexposure"])
    rows = rows.withColumn("near", near).withColumn("rare", rare).withColumn("new", at_least("novelty", gate["novelty"]) & (c("affinity") >= 0) & (near | rare))
    rows = rows.withColumn("new_part", F.when(c("new"), F.coalesce("w_novelty", F.lit(0.0)) * c("novelty")).otherwise(0.0))
    rows = rows.withColumn("new_leads", c("new") & (c("new_part") > c("content_part")) & (c("new_part") > c("others_part")) & ~(c("taste") & c("cold")))
    rows = rows.withColumn("now_leads", c("now") & (~c("taste") | (at_least("confidence", gate["strong_session"]) & (session_score >= F.greatest(F.lit(0.0), c("affinity"))))))

    tag = prose_label(c("new_tag"))
    new_text = (
        F.when((c("e") >= gate["adventurous"]) & from_source("exploration") & c("new_tag").isNotNull(), _say("adventurous", brand=brand, tag=tag))
        .when(c("near"), _say("adjacent", tag=tag)).when(c("rare") & c("new_tag").isNotNull(), _say("rare", tag=tag)).otherwise(_say("rare alone"))
    )
    first, second = F.get("seeds", 0), F.get("seeds", 1)
    named = {"first": first["title"], "state": lookup(STATE_PROSE, first["state"]), "second": second["title"], "other": lookup(STATE_PROSE, second["state"])}
    others_text = F.when(F.size("seeds") < 2, _say("one seed", **named)).when(first["state"] == second["state"], _say("two seeds", **named)).otherwise(_say("two seeds, two states", **named))
    taste, now = {"tags": join_natural(F.transform("tags", prose_label))}, {"now": join_natural(F.transform("now_tags", prose_label))}
    strongest = {"tag": prose_label(F.get("tags", 0))}
    also_taste, also_now, fit = _say("also taste", **taste), _say("also session", **now), _say("fit", fits=F.array_join("fits", " "))
    explored_new, related = c("new") & from_source("exploration"), F.get("tags", 0).isNotNull()

    def then(text: Column, *more: tuple[Column, Column]) -> Column:
        """text, and the first further sentence that applies."""
        return F.concat(text, _first_case([(when, F.concat(F.lit(" "), added)) for when, added in more]))

    heard, found, suits = (c("others"), others_text), (explored_new, new_text), (c("fit"), fit)
    by_session = F.when(c("taste"), _say("session and taste", **now, **taste)).otherwise(then(_say("session", **now), heard, suits))
    cases = [
        (c("others_lead") & (c("others_part") >= c("new_part")), "collaborative", then(others_text, (c("taste"), also_taste), (c("now"), also_now), (c("new"), new_text), suits)),
        (c("new_leads"), "novelty", then(new_text, (c("taste") & ~new_text.contains("interest"), also_taste), heard)),
        (c("now_leads"), "session", by_session),
        (c("taste") & c("cold"), "onboarding", then(_say("onboarding", **taste), (c("now"), also_now), found, suits)),
        (c("taste"), "taste", then(_say("taste", **taste), (c("now"), also_now), heard, found, suits)),
        (c("fit"), "fit", fit),
        (explored_new, "novelty", new_text),
        (c("popular"), "popularity", F.when(related, _say("popular and taste", brand=brand, **strongest)).otherwise(_say("popular", brand=brand))),
        ((c("affinity") > 0) & related, "taste", _say("weak taste", **strongest)),
    ]
    primary, text = _first_case([(k, F.lit(p)) for k, p, _ in cases], F.lit("catalog")), _first_case([(k, t) for k, _, t in cases], _say("catalog", brand=brand))
    factor = lambda when, kind, names, strength: F.when(when, F.struct(kind.alias("kind") if isinstance(kind, Column) else F.lit(kind).alias("kind"), names.alias("features"), strength.alias("strength")))
    none = F.array().cast("array<string>")
    weak = (primary == "taste") & ~c("taste")
    factors = F.array_compact(F.array(
        factor(c("taste"), F.when(c("cold"), "onboarding").otherwise("taste"), c("tags"), c("affinity")), factor(c("now"), "session", c("now_tags"), session_score), factor(c("fit"), "fit", c("fits"), c("affinity")),
        factor(c("popular"), "popularity", none, c("popularity")), factor(c("others"), "collaborative", F.transform("seeds", lambda s: s["title"]), c("collaborative")),
        factor(c("new"), "novelty", F.array_compact(F.array("new_tag")), c("novelty")), factor(weak, "taste", F.slice("tags", 1, 1), c("affinity")), factor(primary == "catalog", "catalog", none, F.lit(0.0)),
    ))
    return rows.select("user_id", "project_id", primary.alias("primary"), text.alias("text"), factors.alias("factors"))


def _first_case(cases: list, otherwise: Column | None = None) -> Column:
    out = None
    for when, value in cases:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(otherwise if otherwise is not None else F.lit(""))


