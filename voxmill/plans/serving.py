"""What a dashboard asks of a stored run: summary, theme list, verbatim page, trend, governance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.config import Config
from voxmill.errors import NotFound
from voxmill.functions.pii import TAGS, TYPES
from voxmill.operators import analytics, redaction
from voxmill.operators.governance import CAVEAT
from voxmill.operators.highlight import highlight_terms
from voxmill.operators.pages import indexed_page, page_rows
from voxmill.operators.partials import breakdown_of_partials, trends_of_partials
from voxmill.operators.runs import audit_trail
from voxmill.operators.themes import class_facets
from voxmill.sources.tables import ResultStore, export_json


class RunReader:
    """Reads of one store. Every read insists on a completed run (JOB_NOT_FOUND, JOB_NOT_READY, JOB_FAILED)."""

    def __init__(self, store: ResultStore, cfg: Config = Config()) -> None:
        self.store = store
        self.cfg = cfg

    def summary(self, job_id: str) -> DataFrame:
        """Top themes with their samples, most urgent first, each row with the run's key figures in ``summary``."""
        run = self.store.read_results(job_id)
        themes = analytics.dashboard_themes(run["themes"].drop("job_id"), self.cfg.dashboard_themes)
        samples = analytics.sample_verbatims(run["reviews"], themes, self.cfg.samples_per_theme)
        row = run["result"].first()  # a result has one row
        figures = ["total_reviews", "overall_sentiment", "net_sentiment_score", "pii_redacted_count", "model_validation_accuracy", "drift_status",
                   "positive_pct", "neutral_pct", "negative_pct"]
        kept = [c for c in figures if c in row.asDict()]
        block = F.struct(*[F.lit(row[c]).cast(run["result"].schema[c].dataType).alias(c) for c in kept])
        return analytics.with_samples(themes, samples).withColumn("summary", block).orderBy("rank")

    def themes(self, job_id: str, sort: str = "priority", general_class: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
        """(ranked themes with samples, class facets, totals). Facets and totals cover all classes, whatever is listed."""
        run = self.store.read_results(job_id)
        head = run["run"].first()
        stored = run["themes"].drop("job_id")
        listed = analytics.list_themes(stored, head["rows_analyzed"] or 0, sort, general_class)
        samples = analytics.sample_verbatims(run["reviews"], listed, self.cfg.samples_per_theme)
        totals = {"total_themes": stored.count(), "unassigned_count": head["unassigned_count"]}
        return analytics.with_samples(listed, samples).orderBy("rank"), class_facets(stored), totals

    def _theme(self, themes: DataFrame, theme_id: str) -> dict:
        found = themes.where(F.col("theme_id") == theme_id).select("theme_id", "name", "general_class", "count").first()
        if found is None:
            raise NotFound("THEME_NOT_FOUND", f"the run has no theme {theme_id}")
        return found.asDict()

    def verbatims(
        self, job_id: str, theme_id: str, page: int = 1, limit: int = 20, sentiment: str | None = None, sort: str = "most_negative"
    ) -> tuple[dict, DataFrame]:
        """(header, page). The header has theme, page, limit, total and total_pages; texts pass the guard and carry highlights.

        Pages far behind come from the stored order of the theme, if the run has one.
        """
        run = self.store.read_results(job_id)
        header = {"theme": self._theme(run["themes"], theme_id), "page": page, "limit": limit}
        offset, store = (page - 1) * limit, self.store
        places = None
        if offset + limit > store.index_from:
            analytics.check_page(page, limit)
            places = page_rows(store.spark, store.path("verbatim_ranks"), job_id, theme_id, sort, offset, limit, sentiment, store.index_bucket)
        if places is not None:
            rows = indexed_page(run["reviews"], places)
        else:
            rows = analytics.verbatims(run["reviews"], theme_id, page, limit, sentiment, sort)
        total = analytics.verbatim_page_info(run["reviews"], theme_id, limit, sentiment).first()["total"]
        guarded, _ = redaction.output_guard(rows, profile=self.cfg.redaction_profile)
        shown = highlight_terms(guarded.drop("guard_hit"), self.cfg.lexicon, threshold=self.cfg.highlight_threshold)
        return header | {"total": total, "total_pages": max(1, math.ceil(total / limit))}, shown

    def trends(self, job_id: str, interval: str, theme_id: str | None = None) -> DataFrame:
        """Trend of the run or of one theme, from its kept aggregates; NO_DATE_DATA when no review has a date, THEME_NOT_FOUND for an unknown theme."""
        run = self.store.read_results(job_id)
        if theme_id is not None:
            self._theme(run["themes"], theme_id)
        return trends_of_partials(self.store.partials(job_id), interval, theme_id, self.cfg, require_dates=True)

    def trends_of_runs(self, interval: str, theme_id: str | None = None, job_ids: Sequence[str] = ()) -> DataFrame:
        """Trend over all completed runs, or those named, from their kept aggregates."""
        return trends_of_partials(self.store.partials(*job_ids), interval, theme_id, self.cfg)

    def breakdown_of_runs(self, job_ids: Sequence[str] = ()) -> DataFrame:
        """Breakdown over all completed runs, or those named, from their kept aggregates."""
        return breakdown_of_partials(self.store.partials(*job_ids))

    def meta(self, job_id: str) -> DataFrame:
        """One row about how a run came to its results: back-ends, reports, date range, counts of themes, seconds and warnings."""
        run = self.store.read_results(job_id)
        row, have = run["result"], set(run["result"].columns)
        head = run["run"].select("started_at", "finished_at", "warnings").first()
        seconds = (head["finished_at"] - head["started_at"]).total_seconds() if head["finished_at"] and head["started_at"] else None
        stored = run["themes"].count()
        none = F.lit(None)
        return row.select(
            "backends",
            (F.col("mean_score") if "mean_score" in have else none.cast("double")).alias("mean_polarity"),
            F.col("pii").alias("pii_breakdown"),
            "validation",
            "drift",
            F.struct(F.col("profile.date_start").alias("start"), F.col("profile.date_end").alias("end")).alias("date_range"),
            F.col("profile.average_rating").alias("average_rating"),
            F.lit(stored).cast("long").alias("themes_total"),
            F.lit(min(stored, self.cfg.max_themes)).cast("long").alias("themes_returned"),
            F.lit(seconds).cast("double").alias("seconds"),
            F.lit(head["warnings"] or []).cast("array<string>").alias("warnings"),
        )

    def export(self, job_id: str, path: str, reviews: bool = True) -> None:
        """Write a run as JSON lines: its summary, its themes by rank and its ``meta`` block; its reviews next to them."""
        run = self.store.read_results(job_id)
        listed = analytics.list_themes(run["themes"].drop("job_id"), run["run"].first()["rows_analyzed"] or 0)
        listed = listed.limit(self.cfg.max_themes).withColumnRenamed("rank", "position")
        blocks = ["breakdown", "pii", "data_quality", "profile", "validation", "drift", "backends", "job_id"]
        shown = run["result"].drop(*[b for b in blocks if b != "breakdown"]).withColumnRenamed("breakdown", "sentiment_breakdown")
        guarded = redaction.output_guard(run["reviews"], profile=self.cfg.redaction_profile)[0].drop("guard_hit") if reviews else None
        export_json(shown, listed, path, guarded, self.meta(job_id))

    def governance(self, job_id: str) -> tuple[DataFrame, DataFrame]:
        """(one nested row, audit trail) from what the run has stored about itself."""
        result = self.store.read_results(job_id)["result"]
        counts = F.create_map(*[x for k in TYPES for x in (F.lit(k), F.col(f"pii.{k}").cast("bigint"))])
        egress = F.coalesce(F.col("backends")["assist"], F.lit("off")) != "off"
        row = result.select(
            F.struct(
                F.col("pii.total").cast("bigint").alias("total_redacted"),
                counts.alias("by_type"),
                F.array(*[F.lit(t) for t in TAGS]).alias("tags"),
                F.lit(False).alias("raw_text_stored"),
            ).alias("pii"),
            F.struct("validation", F.lit(CAVEAT).alias("caveat")).alias("validation"),
            "drift",
            "data_quality",
            F.struct("backends", egress.alias("external_data_egress")).alias("models"),
        )
        return row, audit_trail(self.store.audit(), job_id)
