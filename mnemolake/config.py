"""Settings and the profile that a resource tier allows."""

from __future__ import annotations

import enum
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace


class Tier(enum.IntEnum):
    """Resource classes, ordered."""

    LITE = 0
    STANDARD = 1
    FULL = 2

    @classmethod
    def from_env(cls, variable: str = "MNEMOLAKE_TIER") -> Tier | None:
        """The override in an environment variable, if it names a tier."""
        return cls.__members__.get(os.environ.get(variable, "").strip().upper())


# Defaults of the settings.
PROFILE_KEYS = ("age", "email", "location", "name", "occupation", "pronouns")
THRESHOLDS_GIB = {"full": (16.0, 6.0), "standard": (8.0, 2.5)}
MEMORY_SPLIT = {"facts": 0.40, "episodic": 0.30, "sessions": 0.15, "lessons": 0.15}
SOURCE_IMPORTANCE = {"explicit": 1.0, "rule": 0.7, "auto": 0.5, "import": 0.8}
PRESSURE_GIB = 1.2
PRESSURE_COOLDOWN_SECONDS = 30.0
LITE_EPISODIC_SHARE, LITE_SESSIONS_SHARE = 0.45, 0.75
GRAPH_SHARE = 0.25


@dataclass(frozen=True)
class Settings:
    """All tunable values; `merged` rejects unknown names."""

    context_tokens: int = 4096
    output_reserve: int = 512
    tool_reserve: int = 600
    static_prompt_tokens: int = 0
    profile_keys: tuple[str, ...] = PROFILE_KEYS
    reserved_keys: tuple[str, ...] = ()
    self_reference_markers: tuple[str, ...] = ()
    quarantine_cap: int = 200
    fact_review_days: float = 7.0
    max_lessons: int = 15
    lessons_in_prompt: int = 5
    chunk_target_tokens: int = 400
    min_extraction_words: int = 4
    min_retrieval_words: int = 1
    fact_decay_days: float = 60.0
    fact_archive_threshold: float = 0.15
    episodic_recency_days: float = 30.0
    fact_recency_days: float = 90.0
    upgrade_healthy_ticks: int = 10
    idle_seconds: float = 90.0
    thresholds_gib: Mapping[str, tuple[float, float]] = field(default_factory=lambda: dict(THRESHOLDS_GIB))
    memory_split: Mapping[str, float] = field(default_factory=lambda: dict(MEMORY_SPLIT))
    working_share: float = 0.55
    worker_max_tokens: int = 96
    batch_turns: int = 2
    lite_llm: bool = False
    node_cap: int = 2000
    edge_cap: int = 5000
    graph_decay_days: float = 30.0
    graph_archive_threshold: float = 0.15
    graph_review_days: float = 7.0
    text_index: str = "bm25"
    stem: bool = True
    tier_override: Tier | None = None

    def __post_init__(self) -> None:
        if self.context_tokens < 1024:
            raise ValueError("context_tokens must be at least 1024")
        if not 0 < self.working_share < 1:
            raise ValueError("working_share must lie between 0 and 1")
        if set(self.memory_split) != set(MEMORY_SPLIT) or abs(sum(self.memory_split.values()) - 1) > 1e-6:
            raise ValueError(f"memory_split must give {sorted(MEMORY_SPLIT)} and sum to 1")
        if set(self.thresholds_gib) != set(THRESHOLDS_GIB):
            raise ValueError(f"thresholds_gib must give {sorted(THRESHOLDS_GIB)}")
        if self.text_index not in ("bm25", "like"):
            raise ValueError("text_index must be bm25 or like")

    def merged(self, **changes) -> Settings:
        """A copy with changes; an unknown name is a TypeError that lists the valid ones."""
        valid = [f.name for f in fields(self)]
        unknown = sorted(set(changes) - set(valid))
        if unknown:
            raise TypeError(f"unknown settings {unknown}; valid ones are {valid}")
        return replace(self, **changes)


@dataclass(frozen=True)
class Budgets:
    """Tokens of each prompt section."""

    working: int
    facts: int
    episodic: int
    sessions: int
    lessons: int


@dataclass(frozen=True)
class Profile:
    """What a tier allows."""

    tier: Tier
    budgets: Budgets
    embeddings: bool
    embedder_load: bool
    vector_recall: bool
    llm_extraction: bool
    cadence: str
    rolling_summary: str
    consolidation: str
    episodic_top_k: int
    graph_hops: int
    window_min_turns: int = 2

    @property
    def window_turns(self) -> int:
        """Verbatim turns that the working budget affords, at 120 tokens a message."""
        return max(self.window_min_turns, self.budgets.working // 120 // 2)


def budgets_for(settings: Settings, tier: Tier) -> Budgets:
    """Token budgets: whole-number truncation after each share."""
    dynamic = max(256, settings.context_tokens - settings.output_reserve - settings.tool_reserve - settings.static_prompt_tokens)
    working = int(dynamic * settings.working_share)
    pool, split = dynamic - working, dict(settings.memory_split)
    if tier is Tier.LITE:
        freed = split["episodic"] * (1 - LITE_EPISODIC_SHARE) + split["sessions"] * (1 - LITE_SESSIONS_SHARE)
        split["episodic"] *= LITE_EPISODIC_SHARE
        split["sessions"] *= LITE_SESSIONS_SHARE
        working += int(pool * freed)
    return Budgets(working, *(int(pool * split[k]) for k in ("facts", "episodic", "sessions", "lessons")))


def profile_for(settings: Settings, tier: Tier) -> Profile:
    """The whole decision for a tier."""
    full, lite = tier is Tier.FULL, tier is Tier.LITE
    return Profile(
        tier=tier,
        budgets=budgets_for(settings, tier),
        embeddings=not lite,
        embedder_load=not lite,
        vector_recall=True,
        llm_extraction=not lite or settings.lite_llm,
        cadence="per_turn" if full else ("session_end" if settings.lite_llm else "off") if lite else "batched",
        rolling_summary="extractive" if lite else "llm",
        consolidation="full" if full else "dedupe_only",
        episodic_top_k={Tier.FULL: 5, Tier.STANDARD: 4, Tier.LITE: 3}[tier],
        graph_hops=2 if full else 1,
    )
