"""Events to a model of what a session spends."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from .. import schema
from ..functions.columns import hash_below
from ..functions.features import featurize, select_features
from ..learning.models import (
    BOOSTING_ROUNDS,
    feature_importance,
    prediction_points,
    save_model,
    score_spend,
    train_boosted_spend,
    train_forest_spend,
    with_target,
)
from ..operators.metrics import regression_metrics
from ..operators.sampling import SEED, TRAIN_FRACTION, sample_n
from ..operators.sessions import SESSION, session_aggregate
from ..runtime import stage
from ..schema import DEFAULT_LABELS, EventLabels


@dataclass(frozen=True)
class SpendResult:
    model: PipelineModel
    scored: DataFrame
    metrics: DataFrame
    importance: DataFrame
    points: DataFrame


def spend_sessions(events: DataFrame, source: str | None = None, labels: EventLabels = DEFAULT_LABELS) -> DataFrame:
    """The session table; with ``source``, one row per session and source."""
    return session_aggregate(events, labels, by=[source] if source else [])


def train_spend(
    sessions: DataFrame,
    features: Sequence[str] = schema.SPEND_FEATURES,
    sample: int | None = None,
    key: str = SESSION,
    forest: bool = False,
    rounds: int = BOOSTING_ROUNDS,
    trees: int | None = None,
    save_to: str | None = None,
) -> SpendResult:
    """Split sessions 80/20, fit on log1p of the spend, score the held-out part.

    ``key`` must be unique in ``sessions``. Every session takes part; ``sample`` draws so many
    of them first.
    """
    table = stage(featurize(sessions), "spend-sessions")
    if sample is not None:
        table = sample_n(table, sample, key)
    table = with_target(select_features(table, features, key, schema.SPEND_TARGET))
    test = ~hash_below(key, SEED + 1, TRAIN_FRACTION)
    table = stage(table.withColumn("is_test", test).hint("rebalance"), "spend-split")
    held_out = table.where("is_test")
    if forest:
        options = {"trees": trees} if trees else {}
        model = train_forest_spend(table.where("NOT is_test"), features, **options)
    else:
        model = train_boosted_spend(table, features, validation="is_test", rounds=rounds)
    scored = stage(score_spend(model, held_out).select(key, "actual", "predicted"), "spend-scored")
    if save_to:
        save_model(model, save_to, features)
    return SpendResult(
        model=model,
        scored=scored,
        metrics=regression_metrics(scored, "actual", "predicted"),
        importance=feature_importance(model, table, features),
        points=prediction_points(scored, key),
    )
