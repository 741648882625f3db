"""Settings that change results, and the canonical table schemas."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

POSITIVE = "Positive"
NEUTRAL = "Neutral"
NEGATIVE = "Negative"
STRONGLY_NEGATIVE = "Strongly Negative"
LABELS = (POSITIVE, NEUTRAL, NEGATIVE, STRONGLY_NEGATIVE)
OTHER = "Other"

# General classes in tie-break order.
CATEGORIES = (
    "Streaming/Playback",
    "Comments & Social",
    "Billing & Subscriptions",
    "Performance & Crashes",
    "UI/UX & Navigation",
)

# A small starter lexicon; real deployments pass their own with ``Config(lexicon=...)``.
DEFAULT_LEXICON: Mapping[str, float] = {
    "love": 3.2,
    "great": 3.1,
    "excellent": 2.7,
    "good": 1.9,
    "smooth": 1.6,
    "helpful": 1.8,
    "enjoy": 2.2,
    "fair": 1.3,
    "fine": 0.8,
    "bad": -2.5,
    "terrible": -2.1,
    "awful": -2.0,
    "hate": -2.7,
    "crash": -1.7,
    "annoy": -1.8,
    "broken": -1.9,
    "useless": -1.8,
    "confuse": -1.6,
    "slow": -0.6,
    "fail": -2.5,
    "waste of time": -2.6,
    "dead end": -1.7,
}


@dataclass(frozen=True)
class LabelPreset:
    """Thresholds of the four-way label and of the overall trend label."""

    positive: float
    negative: float
    strong: float
    inclusive: bool = True
    overall: float = 10.0


# Engine preset and the alternate preset.
ENGINE_LABELS = LabelPreset(positive=0.25, negative=-0.25, strong=-0.60, inclusive=True)
ALTERNATE_LABELS = LabelPreset(positive=0.15, negative=-0.15, strong=-0.75, inclusive=False)


@dataclass(frozen=True)
class Config:
    labels: LabelPreset = ENGINE_LABELS
    categories: tuple[str, ...] = CATEGORIES
    confidence_floor: float = 0.30
    lexicon: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_LEXICON))
    stopwords: tuple[str, ...] | None = None
    highlight_threshold: float = 1.5
    hash_dim: int = 2048
    min_theme_size: int = 5
    max_subtopics: int = 8
    max_themes: int = 25
    samples_per_theme: int = 5
    kmeans_restarts: int = 5
    # A bound for fits that never settle; they stop when the centres stop moving.
    kmeans_max_iter: int = 300
    fit_threads: int = 8
    # How classes are split: "kmeans", "density", or "auto" (density for classes of at least ``density_min_docs`` rows).
    tier2_backend: str = "kmeans"
    density_min_docs: int = 300
    density_min_size: int = 10
    seed: int = 42
    min_rows: int = 10
    # The row cap is a guard for small deployments; None lets a run be as large as the cluster can take.
    max_rows: int | None = None
    max_file_bytes: int = 104_857_600
    require_date: bool = True
    dashboard_themes: int = 10
    low_sample: int = 10
    retention_days: int = 7
    timeout_seconds: int = 3600
    psi_bins: int = 10
    redaction_profile: str = "strict"


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


REVIEWS = _schema(
    ("row", T.LongType()),
    ("source_row", T.LongType()),
    ("review_text", T.StringType()),
    ("date", T.DateType()),
    ("rating", T.DoubleType()),
)

SCORED = _schema(
    ("job_id", T.StringType()),
    ("row", T.LongType()),
    ("source_row", T.LongType()),
    ("text", T.StringType()),
    ("sentiment_score", T.DoubleType()),
    ("sentiment_label", T.StringType()),
    ("theme_id", T.StringType()),
    ("date", T.DateType()),
    ("rating", T.DoubleType()),
)

THEMES = _schema(
    ("job_id", T.StringType()),
    ("theme_id", T.StringType()),
    ("general_class", T.StringType()),
    ("name", T.StringType()),
    ("count", T.LongType()),
    ("sentiment", T.StringType()),
    ("sentiment_score", T.DoubleType()),
    ("representative_indices", T.ArrayType(T.LongType())),
)

RUNS = _schema(
    ("job_id", T.StringType()),
    ("status", T.StringType()),
    ("created_at", T.TimestampType()),
    ("started_at", T.TimestampType()),
    ("finished_at", T.TimestampType()),
    ("file_name", T.StringType()),
    ("file_size", T.LongType()),
    ("file_sha256", T.StringType()),
    ("rows_received", T.LongType()),
    ("rows_analyzed", T.LongType()),
    ("rows_dropped", T.LongType()),
    ("dropped_reasons", T.MapType(T.StringType(), T.LongType())),
    ("warnings", T.ArrayType(T.StringType())),
    ("unassigned_count", T.LongType()),
    ("error_code", T.StringType()),
    ("error_message", T.StringType()),
    ("rows_per_second", T.DoubleType()),
)

PARTIALS = _schema(
    ("job_id", T.StringType()),
    ("date", T.DateType()),
    ("theme_id", T.StringType()),
    ("sentiment_label", T.StringType()),
    ("reviews", T.LongType()),
    ("scored", T.LongType()),
    ("score_sum", T.DecimalType(28, 4)),
)

AUDIT = _schema(
    ("job_id", T.StringType()),
    ("seq", T.LongType()),
    ("ts", T.TimestampType()),
    ("event", T.StringType()),
    ("details", T.MapType(T.StringType(), T.StringType())),
)
