"""Sessions to a model of whether a session buys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from .. import schema
from ..functions.features import prepare
from ..learning.models import save_model, score, train_purchase_model
from ..operators.metrics import classification_report, confusion_matrix, roc_auc
from ..operators.sampling import TRAIN_FRACTION, time_split
from ..operators.scaling import first_rows
from ..operators.sessions import SESSION
from ..runtime import stage


@dataclass(frozen=True)
class PurchaseResult:
    model: PipelineModel
    scored: DataFrame
    report: DataFrame
    confusion: DataFrame

    def auc(self) -> float:
        return roc_auc(self.scored, schema.PURCHASE_LABEL, "score")


def train_purchase(
    sessions: DataFrame,
    fraction: float = TRAIN_FRACTION,
    fit_rows: int | None = None,
    save_to: str | None = None,
) -> PurchaseResult:
    """Train on the earliest sessions, report on the latest.

    ``fit_rows`` fits the scaler on the earliest so many sessions instead of all of them.

    ``sessions`` is a stored session table. The split is a condition on it, so training
    and scoring each read it once and nothing is sorted.
    """
    early, late = time_split(sessions, fraction)
    train = stage(prepare(early, SESSION, "session_start"), "purchase-train")
    scale_on = None if fit_rows is None else first_rows(train, fit_rows)
    model = train_purchase_model(train, scale_on=scale_on)
    scored = stage(score(model, prepare(late, SESSION)), "purchase-scored")
    if save_to:
        save_model(model, save_to, schema.PURCHASE_FEATURES)
    return PurchaseResult(
        model=model,
        scored=scored,
        report=classification_report(scored, schema.PURCHASE_LABEL, "prediction"),
        confusion=confusion_matrix(scored, schema.PURCHASE_LABEL, "prediction"),
    )
