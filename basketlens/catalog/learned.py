"""Scaling, models, their scores, and the jobs that end in a model or report."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.features import featurize, prepare
from ..learning import models
from ..operators import metrics
from ..operators.sampling import time_split
from ..operators.scaling import first_rows, fit_scaler, scale
from ..plans import category_report, dictionary_build, purchase, spend
from ..runtime import scratch_path, stage
from ..sources.tables import retail_events
from . import sql
from .aggregates import EVENT_VOLUMES, SESSION_COLUMNS
from .files import MONTH_FOLDER
from .registry import query, retail_monthly_csv, stored_sessions

_X = schema.PURCHASE_FEATURES
_FLOAT_VIEW = "p AS (SELECT user_session, " + ", ".join(f"CAST(CAST(COALESCE({c}, 0) AS FLOAT) AS DOUBLE) AS {c}" for c in _X) + " FROM s)"


def _standard(view):
    moments = ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS d_{c}" for c in _X)
    scaled = ", ".join(
        sql.rounded(f"(({c} - m_{c}) / CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END)", 6) + f" AS {c}" for c in _X
    )
    return sql.with_sessions(view, f"SELECT user_session, {scaled} FROM p, m", f"{_FLOAT_VIEW}, m AS (SELECT {moments} FROM p)")


def _scaled(sessions):
    features = prepare(sessions, "user_session").drop(schema.PURCHASE_LABEL)
    result = scale(features, fit_scaler(features, _X))
    return result.select("user_session", *[F.round(c, 6).alias(c) for c in _X])


@query("ml_01_scale", _standard("c"))
def _(spark, d):
    return _scaled(stored_sessions(spark, d, "click"))


@query("ml_01_scale_retail", _standard("r"))
def _(spark, d):
    return _scaled(stored_sessions(spark, d, "retail"))


@query(
    "ml_01_fit_scaler_first_rows",
    sql.with_sessions(
        "r",
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {sql.rounded(f'AVG({c})', 6)} AS mean, {sql.rounded(f'STDDEV_POP({c})', 6)} AS std FROM f" for c in _X
        ),
        f"{_FLOAT_VIEW}, f AS (SELECT p.* FROM p JOIN s USING (user_session) ORDER BY session_start, user_session LIMIT 2000)",
    ),
)
def _(spark, d):
    features = prepare(stored_sessions(spark, d, "retail"), "user_session", "session_start")
    fitted = fit_scaler(first_rows(features, 2_000), _X)
    return fitted.select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _rule(sessions):
    """Sessions scored by a rule, so that SQL can score them too."""
    return sessions.select(
        "user_session",
        (F.col("n_purchases") > 0).cast("int").alias("label"),
        (F.col("n_views") >= 2).cast("int").alias("prediction"),
        (2 * F.col("n_views") + F.col("n_add_to_cart")).cast("double").alias("score"),
        F.col("total_spent").alias("actual"),
        (F.col("n_views") * F.coalesce(F.col("avg_price_viewed"), F.lit(0.0))).alias("predicted"),
    )


_RULE = """k AS (SELECT user_session, CASE WHEN n_purchases > 0 THEN 1 ELSE 0 END AS label, CASE WHEN n_views >= 2 THEN 1 ELSE 0 END AS prediction,
  CAST(2 * n_views + n_add_to_cart AS DOUBLE) AS score, total_spent AS actual, n_views * COALESCE(avg_price_viewed, 0) AS predicted FROM s)"""

_REPORT = """z AS (SELECT cls, SUM(CASE WHEN label = cls AND prediction = cls THEN 1 ELSE 0 END) AS hits,
    SUM(CASE WHEN prediction = cls THEN 1 ELSE 0 END) AS predicted, SUM(CASE WHEN label = cls THEN 1 ELSE 0 END) AS support
  FROM k, (SELECT DISTINCT label AS cls FROM k UNION SELECT DISTINCT prediction FROM k) GROUP BY cls),
m AS (SELECT CAST(cls AS VARCHAR) AS class, COALESCE(CAST(hits AS DOUBLE) / NULLIF(predicted, 0), 0) AS precision,
    COALESCE(CAST(hits AS DOUBLE) / NULLIF(support, 0), 0) AS recall,
    COALESCE(CAST(2 * hits AS DOUBLE) / NULLIF(predicted + support, 0), 0) AS f1, CAST(support AS BIGINT) AS support, hits FROM z)"""


def _report_sql(view):
    return sql.with_sessions(
        view,
        f"""SELECT class, {sql.rounded('precision', 9)} AS precision, {sql.rounded('recall', 9)} AS recall, {sql.rounded('f1', 9)} AS f1, support FROM (
        SELECT class, precision, recall, f1, support FROM m
        UNION ALL SELECT 'accuracy', NULL, NULL, CAST(SUM(hits) AS DOUBLE) / SUM(support), CAST(SUM(support) AS BIGINT) FROM m
        UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), CAST(SUM(support) AS BIGINT) FROM m
        UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
          SUM(f1 * support) / SUM(support), CAST(SUM(support) AS BIGINT) FROM m)""",
        f"{_RULE}, {_REPORT}",
    )


def _report(sessions):
    report = metrics.classification_report(_rule(sessions))
    return report.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("ml_04_classification_report", _report_sql("c"))
def _(spark, d):
    return _report(stored_sessions(spark, d, "click"))


@query("ml_04_classification_report_retail", _report_sql("r"))
def _(spark, d):
    return _report(stored_sessions(spark, d, "retail"))


@query(
    "ml_07_regression_metrics",
    sql.with_sessions(
        "r",
        """SELECT ROUND(SQRT(AVG((actual - predicted) ** 2)), 4) AS rmse, ROUND(AVG(ABS(actual - predicted)), 4) AS mae,
        ROUND(1 - SUM((actual - predicted) ** 2) / (VAR_POP(actual) * COUNT(*)), 6) AS r2, COUNT(*) AS n FROM k""",
        _RULE,
    ),
)
def _(spark, d):
    found = metrics.regression_metrics(_rule(stored_sessions(spark, d, "retail")), "actual", "predicted")
    return found.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"), "n")


@query(
    "rm_01_roc_auc",
    sql.with_sessions(
        "c",
        """SELECT ROUND(SUM(pos * (below + neg / 2.0)) / (SUM(pos) * SUM(neg)), 9) AS auc, CAST(SUM(pos) AS BIGINT) AS n_positive,
        CAST(SUM(neg) AS BIGINT) AS n_negative FROM b""",
        _RULE
        + """, g AS (SELECT score, CAST(SUM(label) AS DOUBLE) AS pos, CAST(SUM(1 - label) AS DOUBLE) AS neg FROM k GROUP BY score),
        b AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)""",
    ),
)
def _(spark, d):
    found = metrics.roc_auc_frame(_rule(stored_sessions(spark, d, "click")))
    return found.withColumn("auc", F.round("auc", 9))


@query("rm_02_confusion_matrix", sql.with_sessions("c", "SELECT label, prediction, COUNT(*) AS n FROM k GROUP BY 1, 2", _RULE))
def _(spark, d):
    return metrics.confusion_matrix(_rule(stored_sessions(spark, d, "click")))


def _train_test(spark, d):
    early, late = time_split(stored_sessions(spark, d, "click"))
    return stage(prepare(early, "user_session"), "train"), prepare(late, "user_session")


def equal_scores(found, expected):
    """How many scored sessions there are, and how many have the expected prediction and score."""
    both = found.select("user_session", "prediction", "score").alias("a").join(expected.select("user_session", "prediction", "score").alias("b"), "user_session")
    equal = (F.col("a.prediction") == F.col("b.prediction")) & (F.abs(F.col("a.score") - F.col("b.score")) < 1e-9)
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(equal).alias("n_equal"))


_N_TRAIN = "(SELECT COUNT(*) FROM train)"


def _weighted(features, rows, whole):
    """SQL for what ``_checked`` makes of the importance of these features."""
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {rows} AS n_rows, true AS is_weight, {whole} AS sums_to_one" for f in features)


def _checked(importance, train, whole=True):
    """Features whose weight is a number from 0 up, with the rows they were learned from; a forest's weights sum to one."""
    total = F.sum("importance").over(Window.partitionBy())
    sums = (F.abs(total - 1) < 1e-9) if whole else F.lit(False)
    weight = F.coalesce(F.col("importance") >= 0, F.lit(False))
    return importance.select("feature", F.lit(train.count()).alias("n_rows"), weight.alias("is_weight"), sums.alias("sums_to_one"))


def _stationary(model, train):
    """Per feature and for the intercept: whether the penalised log loss has no slope there, as it has at its minimum only."""
    fitted = model.stages[-1]
    miss = F.get(vector_to_array("probability"), F.lit(1)) - F.col(schema.PURCHASE_LABEL)
    slopes = [(F.avg(miss * F.col(f"{f}_z")) + F.lit(models.L2_PENALTY * float(w))).alias(f) for f, w in zip(_X, fitted.coefficients, strict=True)]
    found = model.transform(train).agg(*slopes, F.avg(miss).alias("(intercept)"))
    flat = found.unpivot([], [*_X, "(intercept)"], "feature", "slope")
    return flat.select("feature", (F.abs("slope") < 1e-4).alias("is_stationary"))


@query(
    "ml_02_logistic_regression",
    " UNION ALL ".join(f"SELECT '{f}' AS feature, true AS is_stationary" for f in [*_X, "(intercept)"]),
)
def _(spark, d):
    train, _test = _train_test(spark, d)
    return _stationary(models.train_purchase_model(train), train)


@query(
    "ml_03_score",
    sql.test_sessions("c") + " SELECT label AS label_purchase, COUNT(*) AS n_rows, COUNT(*) AS n_consistent FROM test GROUP BY label",
)
def _(spark, d):
    train, test = _train_test(spark, d)
    scored = models.score(models.train_purchase_model(train), test)
    consistent = F.col("prediction") == (F.col("score") > 0.5).cast("double")
    found = scored.groupBy(F.col("label_purchase").cast("int").alias("label_purchase"))
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(consistent).alias("n_consistent"))


# Random scores have an area of 0.5; trees of any depth do better on what they have seen.
_LEARNT = 0.6


def _learnt(model, train):
    """Whether a classifier ranks its training rows better than chance, by a margin."""
    return F.lit(metrics.roc_auc(models.score(model, train), schema.PURCHASE_LABEL, "score") > _LEARNT).alias("has_learnt")


_SUPPORT = sql.test_sessions("c") + """ SELECT class, support, true AS are_shares FROM (
    SELECT CAST(label AS VARCHAR) AS class, COUNT(*) AS support FROM test GROUP BY label
    UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT COUNT(*) FROM test))"""


def _support(report):
    """The support of each line of a report, and whether its scores are shares."""
    fine = F.lit(True)
    for c in ("precision", "recall", "f1"):
        fine = fine & F.coalesce(F.col(c).between(0, 1), F.lit(True))
    return report.select("class", "support", fine.alias("are_shares"))


@query("rm_03_forest_classifier", _SUPPORT.replace("true AS are_shares", "true AS are_shares, true AS has_learnt"))
def _(spark, d):
    train, test = _train_test(spark, d)
    model = models.train_forest_classifier(train)
    report = metrics.classification_report(models.score(model, test), schema.PURCHASE_LABEL, "prediction")
    return _support(report).select("*", _learnt(model, train))


@query("rm_04_boosted_classifier", _SUPPORT.replace("true AS are_shares", "true AS are_shares, true AS has_learnt"))
def _(spark, d):
    train, test = _train_test(spark, d)
    model = models.train_boosted_classifier(train)
    report = metrics.classification_report(models.score(model, test), schema.PURCHASE_LABEL, "prediction")
    return _support(report).select("*", _learnt(model, train))


@query("rm_07_classifier_importance", f"{sql.test_sessions('c')} SELECT *, true AS has_learnt FROM ({_weighted(_X, _N_TRAIN, 'true')})")
def _(spark, d):
    train, _test = _train_test(spark, d)
    model = models.train_forest_classifier(train)
    return _checked(models.feature_importance(model, train, _X), train).select("*", _learnt(model, train))


_HELD_OUT = f"SELECT COUNT(*) AS n, true AS beats_the_mean FROM s WHERE {sql.held_out('user_session')}"
#: The retail view's spend follows from its prices, so the error falls for thousands of rounds; its queries stop here.
RETAIL_ROUNDS = 120
_boosted: dict[tuple[str, str, str], spend.SpendResult] = {}


def _boosted_spend(spark, d, view):
    """The boosted spend model of a view, trained on first use in this application."""
    key = (spark.sparkContext.applicationId, d, view)
    if key not in _boosted:
        rounds = RETAIL_ROUNDS if view == "retail" else models.BOOSTING_ROUNDS
        _boosted[key] = spend.train_spend(stored_sessions(spark, d, view), rounds=rounds)
    return _boosted[key]


def _beats(result):
    """The held-out sessions, and whether the log of their spend is predicted better than by its mean."""
    log = result.scored.select(F.log1p("actual").alias("a"), F.log1p("predicted").alias("p"))
    return metrics.regression_metrics(log, "a", "p").select("n", (F.col("r2") > 0).alias("beats_the_mean"))


@query("ml_05_boosted_spend", sql.with_sessions("c", _HELD_OUT))
def _(spark, d):
    return _beats(_boosted_spend(spark, d, "click"))


@query("ml_06_forest_spend", sql.with_sessions("c", _HELD_OUT.replace("true AS beats_the_mean", "true AS is_scored, true AS has_learnt")))
def _(spark, d):
    # Deep trees fit the noise of these sessions, so they are held against the rows they have seen.
    sessions = stored_sessions(spark, d, "click")
    result = spend.train_spend(sessions, forest=True)
    seen = models.score_spend(result.model, models.with_target(featurize(sessions))).join(result.scored.select("user_session"), "user_session", "left_anti")
    log = seen.select(F.log1p("actual").alias("a"), F.log1p("predicted").alias("p"))
    learnt = metrics.regression_metrics(log, "a", "p").first()["r2"] > 0.3
    return result.metrics.select("n", (F.col("rmse") > 0).alias("is_scored"), F.lit(learnt).alias("has_learnt"))


@query("ml_08_spend_importance", sql.with_sessions("c", _weighted(schema.SPEND_FEATURES, "(SELECT COUNT(*) FROM s)", "true")))
def _(spark, d):
    return _checked(_boosted_spend(spark, d, "click").importance, stored_sessions(spark, d, "click"))


@query(
    "ml_09_prediction_points",
    sql.with_sessions(
        "r",
        f"""SELECT user_session, total_spent AS actual, (SELECT COUNT(*) FROM s WHERE {sql.held_out('user_session')}) AS n_held_out, true AS in_the_picture, true AS beats_the_mean
        FROM s WHERE {sql.held_out('user_session')} ORDER BY user_session LIMIT 2000""",
    ),
)
def _(spark, d):
    result = _boosted_spend(spark, d, "retail")
    inside = (F.col("predicted") <= F.col("axis_max")) & (F.col("actual") <= F.col("axis_max"))
    better = F.lit(_beats(result).first()["beats_the_mean"]).alias("beats_the_mean")
    return result.points.select("user_session", "actual", F.lit(result.scored.count()).alias("n_held_out"), inside.alias("in_the_picture"), better)


@query("snk_06_stored_model", sql.test_sessions("c") + " SELECT COUNT(*) AS n_rows, COUNT(*) AS n_equal FROM test")
def _(spark, d):
    train, test = _train_test(spark, d)
    path = scratch_path(spark, "model")
    fitted = models.train_purchase_model(train)
    models.save_model(fitted, path, _X)
    model, _features = models.load_model(path)
    return equal_scores(models.score(model, test), models.score(fitted, test))


_KEYED = sql.retail(
    f"SELECT COUNT(*) AS n, true AS beats_the_mean FROM k WHERE {sql.held_out('user_session')}",
    "k AS (SELECT DISTINCT user_session || '@' || month AS user_session FROM r)",
)


@query("job_01_spend_model", _KEYED)
def _(spark, d):
    events = retail_events(spark, d, [*SESSION_COLUMNS, "month"])
    sessions = spend.spend_sessions(events, source="month")
    keyed = sessions.withColumn("user_session", F.concat_ws("@", "user_session", "month"))
    return _beats(spend.train_spend(keyed, save_to=scratch_path(spark, "spend-model"), rounds=RETAIL_ROUNDS))


@query("job_02_purchase_model", _SUPPORT.replace("true AS are_shares", "true AS are_shares, true AS auc_is_share"))
def _(spark, d):
    result = purchase.train_purchase(stored_sessions(spark, d, "click"), save_to=scratch_path(spark, "purchase-model"))
    return _support(result.report).withColumn("auc_is_share", F.lit(0 <= result.auc() <= 1))


_TOTALS = f"t AS ({sql.category_totals('category_id, event_type, month', where='WHERE category_id IS NOT NULL AND event_type IS NOT NULL')})"


@query(
    "job_03_category_report",
    sql.retail(
        "SELECT category_id, month AS month_str, " + sql.total("total_sales") + " AS total_sales FROM t GROUP BY 1, 2",
        _TOTALS,
    ),
)
def _(spark, d):
    path = scratch_path(spark, "category-totals")
    category_report.aggregate_files(spark, retail_monthly_csv(spark, d), path, MONTH_FOLDER)
    return category_report.report(spark, path).heat_cells


@query(
    "job_03_event_volumes",
    sql.retail(
        EVENT_VOLUMES,
        _TOTALS,
    ),
)
def _(spark, d):
    path = scratch_path(spark, "category-totals")
    category_report.aggregate_files(spark, retail_monthly_csv(spark, d), path, MONTH_FOLDER)
    return category_report.report(spark, path).volumes


_CODES = """dict AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS code FROM (
  SELECT 'event_type' AS "column", event_type AS value FROM r UNION SELECT 'category_code', category_code FROM r
  UNION SELECT 'brand', brand FROM r) WHERE value IS NOT NULL)"""
_CODE = "(SELECT CAST(code AS DOUBLE) FROM dict WHERE \"column\" = '{c}' AND value = r.{c}) AS {c}_code"


@query(
    "job_04_dictionary_parquet",
    sql.retail(
        "SELECT event_time, "
        + ", ".join(_CODE.format(c=c) for c in schema.DICTIONARY_COLUMNS)
        + ", product_id, category_id, price, user_id, user_session FROM r",
        _CODES,
    ),
)
def _(spark, d):
    folder = retail_monthly_csv(spark, d)
    # Whatever months there are: those with an odd last digit, and all others.
    sources = [f"{folder}/month=*[13579]", f"{folder}/month=*[!13579]"]
    targets = [scratch_path(spark, "encoded"), scratch_path(spark, "encoded")]
    dictionary_build.build(spark, sources, targets, missing="skip")
    encoded = spark.read.parquet(*targets)
    return encoded.withColumns({f"{c}_code": F.col(f"{c}_code").cast("double") for c in schema.DICTIONARY_COLUMNS})
