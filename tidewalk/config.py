"""All constants of the recommender in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType


def _fixed(**values):
    return field(default_factory=lambda: MappingProxyType(values))


@dataclass(frozen=True)
class Config:
    # They decide results, so they are the same numbers everywhere.
    weights: MappingProxyType = _fixed(IMPRESSION=0.0, OPEN=0.5, SAVE=2.0, UNSAVE=-1.0, DISLIKE=-3.0, BUILD=4.0, COMPLETE=5.0, SHARE=3.0)
    positive: tuple = ("OPEN", "SAVE", "BUILD", "COMPLETE", "SHARE")
    strong: tuple = ("SAVE", "BUILD", "COMPLETE", "SHARE")
    excluding: tuple = ("DISLIKE", "BUILD", "COMPLETE")
    half_life_days: float = 30.0
    history_days: int = 365
    tag: float = 1.0
    language: float = 0.5
    difficulty: float = 0.35
    duration: float = 0.35
    onboarding: MappingProxyType = _fixed(topic=2.0, chosen=1.5, rejected=-0.5, difficulty=1.0, duration=1.0)
    session_timeout_minutes: int = 30
    session_half_saturation: float = 4.0
    session_coherence_top: int = 3
    session_coherence_floor: float = 0.5
    session_max_blend: float = 0.45
    session_top_features: int = 5
    content_candidates: int = 50
    collaborative_candidates: int = 30
    popular_candidates: int = 15
    min_affinity: float = 0.01
    popularity_prior: float = 0.4
    popularity_behaviour: float = 0.6
    cold_start_interactions: int = 3
    cold_start_popularity: float = 3.0
    shrinkage: float = 2.0
    neighbours: int = 20
    full_confidence: float = 6.0
    min_collaborative: float = 0.02
    similar_limit: int = 5
    ranking: MappingProxyType = _fixed(content=0.45, collaborative=0.25, session=0.1, novelty=0.05, popularity=0.1)
    slopes: MappingProxyType = _fixed(content=-0.15, collaborative=-0.05, session=0.0, novelty=0.3, popularity=0.0)
    exploration_default: float = 0.35
    exploration_min: int = 8
    exploration_max: int = 15
    exploration_plausibility: float = 0.05
    exploration_novelty: float = 0.65
    novelty_underexposure: float = 0.65
    novelty_adjacency: float = 0.35
    lambda_base: float = 0.9
    lambda_slope: float = -0.2
    lambda_range: tuple = (0.5, 0.95)
    near_duplicate: float = 0.9
    tag_share: float = 0.45
    tag_share_slope: float = -0.15
    min_per_tag: int = 2
    quality_ratio: float = 0.8
    min_diversify: int = 3
    saved_factor: float = 0.6
    feed_limit: int = 10
    feed_max: int = 30
    kept_runs: int = 25
    listed_runs: int = 10
    explain: MappingProxyType = _fixed(content=0.2, session=0.25, session_confidence=0.15, strong_session=0.4, popularity=0.5, collaborative=0.3, novelty=0.55, underexposure=0.6, adjacency=0.5, adventurous=0.6)
    explain_features: int = 2
    familiar_max: float = 0.3
    adventurous_min: float = 0.7
    eval_min_positives: int = 5
    eval_holdout: float = 0.2
    eval_holdout_range: tuple = (1, 3)
    eval_min_training: int = 2
    eval_seed: int = 20260818
    bpr: MappingProxyType = _fixed(factors=16, epochs=80, rate=0.05, regularization=0.01, samples=1, explicit=0.5, init=0.05, seed=20260820, blend=0.2)
    duration_hours: MappingProxyType = _fixed(UNDER_2_HOURS=2, ONE_EVENING=5, WEEKEND=20)
    duration_rest: str = "ONE_TO_TWO_WEEKS"
    duration_labels: MappingProxyType = _fixed(UNDER_2_HOURS="Under 2 hours", ONE_EVENING="One evening", WEEKEND="Weekend", ONE_TO_TWO_WEEKS="1–2 weeks", ANYTHING="Anything")


CONFIG = Config()
