"""The whole analysis of one batch of reviews, with pluggable back-ends."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import partial

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.config import Config
from voxmill.errors import ContractMismatch
from voxmill.operators import cleaning, redaction, sentiment, themes, validation
from voxmill.operators.drift import INITIALIZED, drift_report, publish_baseline
from voxmill.operators.features import Encoder, embed_external, hashed_tf
from voxmill.operators.scale import materialised, scratch_scope, spread
from voxmill.sources.tables import ResultStore, require_job_id


@dataclass(frozen=True)
class BackEnds:
    """Optional models. Whatever is absent uses the built-in Spark expression."""

    scorer: sentiment.Scorer | None = None
    encoder: Encoder | None = None
    classifier: themes.ClassScores | None = None
    recogniser: Callable | None = None
    names: dict[str, str] = field(default_factory=dict)

    def described(self, cfg: Config) -> dict[str, str]:
        built_in = {
            "sentiment": "model" if self.scorer else "lexicon",
            "tier1": "model" if self.classifier else "keyword",
            "tier2": cfg.tier2_backend,
            "embeddings": "model" if self.encoder else f"hashing-{cfg.hash_dim}",
            "assist": "off",
        }
        return {**built_in, **self.names}


@dataclass(frozen=True)
class Analysis:
    """Tables of one analysed batch; all but ``reviews`` and ``themes`` have one row."""

    reviews: DataFrame
    themes: DataFrame
    summary: DataFrame
    breakdown: DataFrame
    pii: DataFrame
    quality: DataFrame
    profile: DataFrame
    drift: DataFrame | None
    validation: DataFrame | None
    backends: dict[str, str]
    publish_baseline: Callable[[], None] | None = None


_REVIEW_FIELDS = {
    "row": "bigint",
    "source_row": "bigint",
    "text": "string",
    "sentiment_score": "double",
    "sentiment_label": "string",
    "theme_id": "string",
    "date": "date",
    "rating": "double",
}


def check_contract(analysis: Analysis) -> None:
    """The reviews of any engine must have these columns with these types."""
    have = {f.name: f.dataType.simpleString() for f in analysis.reviews.schema.fields}
    wrong = {n: have.get(n) for n, t in _REVIEW_FIELDS.items() if have.get(n) != t}
    if wrong:
        raise ContractMismatch("engine output does not have the review columns", wrong=wrong)


class AnalysisEngine:
    """``run(raw)`` takes ``source_row, review_text, date, rating`` as text columns and returns the tables."""

    def __init__(self, cfg: Config = Config(), backends: BackEnds = BackEnds()) -> None:
        self.cfg = cfg
        self.backends = backends

    def info(self) -> dict[str, str]:
        return self.backends.described(self.cfg)

    def status(self) -> str:
        return "ready"

    def _classified(self, df: DataFrame) -> DataFrame:
        if self.backends.classifier:
            return themes.classify_external(df, self.backends.classifier, cfg=self.cfg)
        return themes.classify_keywords(df, cfg=self.cfg)

    def _scored(self, df: DataFrame, id_col: str) -> DataFrame:
        if self.backends.scorer:
            scorer = self.backends.scorer
            scored = sentiment.score_distinct(df, lambda d: sentiment.score_external(d, scorer), id_col)
        else:
            scored = sentiment.score_lexicon(df, self.cfg.lexicon)
        return scored.withColumn(
            "sentiment_label", sentiment.label_sentiment(F.col("sentiment_score"), self.cfg.labels)
        )

    def _embedded(self, df: DataFrame) -> DataFrame:
        if self.backends.encoder:
            vectors = embed_external(df, self.backends.encoder)
            return vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))).drop("embedding")
        return hashed_tf(df, cfg=self.cfg)

    def prepare(self, raw: DataFrame) -> DataFrame:
        """Clean, redacted and scored reviews with their class and vector. One narrow job plus the numbering."""
        clean = cleaning.coerce_rating(cleaning.normalize_dates(cleaning.clean_text(raw)))
        masked = redaction.redact(clean, "review_text", "text", self.cfg.redaction_profile).drop("review_text")
        if self.backends.recogniser:
            masked = redaction.redact_names(masked, self.backends.recogniser)
        scored = self._classified(self._scored(masked, "source_row"))
        return cleaning.assign_rows(scored)

    def run(
        self,
        raw: DataFrame,
        baseline_path: str | None = None,
        labelled: DataFrame | None = None,
        with_drift: bool = True,
        creator: str = "",
        publish: bool = True,
    ) -> Analysis:
        """Analyse a batch. Without ``publish`` a first baseline is left to the caller (``Analysis.publish_baseline``)."""
        cfg = self.cfg
        raw = spread(raw)
        quality = cleaning.data_quality(raw)
        # Everything later reads this table several times: it is written once and read back.
        ready = spread(materialised(self.prepare(raw), "ready"))
        cleaning.gate_rows(ready.count(), cfg)
        embedded = materialised(self._embedded(ready), "embedded", partition_by=["general_class"])
        reviews, theme_rows = themes.discover_themes(embedded, cfg)
        pii = redaction.pii_totals(ready)
        checked = self.validate(labelled) if labelled is not None else None
        drift, later = None, None
        if baseline_path and with_drift:
            maker = self.info()["embeddings"]
            drift = drift_report(
                raw.sparkSession, embedded, baseline_path, maker, bins=cfg.psi_bins, creator=creator, publish=publish
            )
            if not publish and drift.first()["status"] == INITIALIZED:
                later = partial(publish_baseline, embedded, baseline_path, maker, creator=creator)
        summary = sentiment.with_percent(sentiment.summarize_sentiment(ready, cfg.labels))
        shown = lambda report: F.lit(report.first()["display"] if report is not None else None).cast("string")
        summary = summary.withColumns(
            {
                "pii_redacted_count": F.lit(pii.first()["total"]).cast("bigint"),
                "model_validation_accuracy": shown(checked),
                "drift_status": shown(drift),
            }
        )
        analysis = Analysis(
            reviews=reviews,
            themes=theme_rows,
            summary=summary,
            breakdown=sentiment.sentiment_percent(ready),
            pii=pii,
            quality=quality,
            profile=cleaning.batch_profile(ready),
            drift=drift,
            validation=checked,
            backends=self.info(),
            publish_baseline=later,
        )
        check_contract(analysis)
        return analysis

    def validate(self, labelled: DataFrame) -> DataFrame:
        """Score and classify labelled rows (text, sentiment, category) with this engine's back-ends."""
        keyed = labelled.withColumn("_id", F.xxhash64("text", "sentiment", "category"))
        scored = self._classified(self._scored(keyed, "_id"))
        return validation.validation_report(
            scored.withColumnsRenamed({"sentiment": "gold", "category": "gold_class"}),
            self.cfg.categories,
            "sentiment_label",
            "gold",
            "general_class",
            "gold_class",
        )


def run_and_store(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    job_id: str | None = None,
    engine: AnalysisEngine | None = None,
    baseline_path: str | None = None,
    labelled: DataFrame | None = None,
    file_name: str | None = None,
) -> str:
    """Analyse a batch, guard its texts, write all result tables and the audit log; returns the run id.

    Everything the run writes on the way is deleted once its results are committed or it has failed.
    """
    with scratch_scope(spark):
        return _run_and_store(spark, raw, root, job_id, engine or AnalysisEngine(), baseline_path, labelled, file_name)


def _run_and_store(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    job_id: str | None,
    engine: AnalysisEngine,
    baseline_path: str | None,
    labelled: DataFrame | None,
    file_name: str | None,
) -> str:
    store = ResultStore(spark, root)
    job_id = require_job_id(job_id or str(uuid.uuid4()))
    started = datetime.now(timezone.utc)
    store.record(job_id, started, "JOB_STARTED", seq=1)
    run = {"job_id": job_id, "created_at": started, "started_at": started, "file_name": file_name}
    store.put_run(run_row(spark, run | {"status": "PROCESSING"}))
    try:
        done = engine.run(raw, baseline_path, labelled, creator=job_id, publish=False)
        pii = done.pii.first().asDict()
        store.record(
            job_id, datetime.now(timezone.utc), "PII_REDACTION_COMPLETED", {k: str(v) for k, v in pii.items()}, seq=2
        )
        guarded, hits = redaction.output_guard(done.reviews, profile=engine.cfg.redaction_profile)
        hit = hits.first()["guard_hits"]
        if hit:
            store.record(job_id, datetime.now(timezone.utc), "OUTPUT_GUARD_HIT", {"rows": str(hit)}, seq=3)
        quality = done.quality.first().asDict()
        missing = themes.unassigned_count(done.reviews).first()[0]
        finished = datetime.now(timezone.utc)
        seconds = max((finished - started).total_seconds(), 1e-3)
        run |= quality | {
            "status": "COMPLETED",
            "finished_at": finished,
            "unassigned_count": missing,
            "rows_per_second": quality["rows_analyzed"] / seconds,
        }
        result = result_row(spark, job_id, done)
        store.write_results(
            guarded.withColumn("job_id", F.lit(job_id)), done.themes.withColumn("job_id", F.lit(job_id)), result, run_row(spark, run)
        )
        if done.publish_baseline:
            done.publish_baseline()
        store.record(job_id, finished, "JOB_COMPLETED", {"rows": str(quality["rows_analyzed"])}, seq=4)
        return job_id
    except Exception as exc:
        fail(spark, root, job_id, exc, run)
        raise


def result_row(spark: SparkSession, job_id: str, done: Analysis) -> DataFrame:
    """Everything a later reader asks of a run, in one row: summary figures and a struct for each report."""
    blocks = {
        "breakdown": done.breakdown,
        "pii": done.pii,
        "data_quality": done.quality,
        "profile": done.profile,
        "validation": done.validation,
        "drift": done.drift,
    }
    head = done.summary
    fields, values = list(head.schema.fields), list(head.first())
    for name, block in blocks.items():  # each has one row
        fields.append(T.StructField(name, block.schema if block is not None else T.StructType([T.StructField("display", T.StringType())])))
        values.append(block.first() if block is not None else None)
    fields += [T.StructField("backends", T.MapType(T.StringType(), T.StringType())), T.StructField("job_id", T.StringType())]
    return spark.createDataFrame([(*values, done.backends, job_id)], T.StructType(fields))


def fail(spark: SparkSession, root: str, job_id: str, exc: Exception, run: dict | None = None) -> None:
    """Record a failed run in ``runs`` and in the audit log; nothing else of it stays."""
    now = datetime.now(timezone.utc)
    code = getattr(exc, "code", "ENGINE_ERROR")
    row = {"job_id": job_id, "created_at": now, "started_at": now} | (run or {})
    row |= {"status": "FAILED", "finished_at": now, "error_code": code, "error_message": str(exc)}
    store = ResultStore(spark, root)
    store.fail_run(run_row(spark, row))
    store.record(job_id, now, "JOB_FAILED", {"code": code}, seq=5)


def run_row(spark: SparkSession, values: dict) -> DataFrame:
    from voxmill.config import RUNS

    return spark.createDataFrame([tuple(values.get(n) for n in RUNS.names)], RUNS)
