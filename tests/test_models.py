from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from basketlens import schema
from basketlens.functions import features
from basketlens.learning import models
from basketlens.operators import metrics
from basketlens.operators.sampling import time_split
from basketlens.operators.scaling import first_rows, fit_scaler, scale
from basketlens.operators.sessions import session_aggregate
from basketlens.plans import purchase, spend
from basketlens.runtime import stage
from basketlens.sources.tables import click_events

SESSION_ROW = (
    "user_session string, session_start timestamp_ntz, session_end timestamp_ntz, session_duration double, total_events bigint, "
    "n_views bigint, n_add_to_cart bigint, n_purchases bigint, total_spent double, avg_price_viewed double, "
    "max_price_viewed double, unique_products bigint"
)


@pytest.fixture(scope="module")
def sessions(spark, sf_dir):
    return stage(session_aggregate(click_events(spark, sf_dir)), "test-sessions")


def test_features_by_hand(spark):
    row = ("a", None, None, 100_000.0, 4, 0, 2, 1, 9.5, None, None, 0)
    made = features.featurize(spark.createDataFrame([row], SESSION_ROW)).first()
    assert made.session_duration_min == 1440.0
    assert (made.views_per_product, made.cart_rate, made.purchase_flag) == (0.0, 2.0, 1)
    assert (made.avg_price_viewed, made.max_price_viewed) == (0.0, 0.0)
    ready = features.prepare(spark.createDataFrame([row], SESSION_ROW)).first()
    assert ready.session_duration == 0.0 and ready.label_purchase == 1


def test_nothing_leaks(sessions):
    ready = features.prepare(sessions)
    assert ready.columns == [*schema.PURCHASE_FEATURES, schema.PURCHASE_LABEL]
    assert not set(features.drop_leakage(sessions).columns) & {*schema.IDENTIFIERS, *schema.LEAKS}
    assert not {*schema.SPEND_FEATURES, *schema.PURCHASE_FEATURES} & {*schema.IDENTIFIERS, *schema.LEAKS}


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, constant double")
    scaled = scale(df, fit_scaler(df, ["x", "constant"])).orderBy("x").collect()
    assert [tuple(r) for r in scaled] == [(-1.0, 0.0), (1.0, 0.0)]


def test_report_by_hand(spark):
    pairs = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 0)] * 4 + [(0, 1)] * 2
    scored = spark.createDataFrame(pairs, "label int, prediction int")
    report = {r["class"]: r for r in metrics.classification_report(scored).collect()}
    assert report["1"].precision == pytest.approx(3 / 5)
    assert report["1"].recall == pytest.approx(3 / 4)
    assert report["0"].f1 == pytest.approx(2 * 4 / (5 + 6))
    assert report["accuracy"].f1 == pytest.approx(0.7)
    assert report["macro avg"].recall == pytest.approx((3 / 4 + 4 / 6) / 2)
    assert report["weighted avg"].precision == pytest.approx((0.6 * 4 + 0.8 * 6) / 10)
    assert {r.support for r in report.values()} == {4, 6, 10}


def test_report_edges(spark):
    assert metrics.classification_report(spark.createDataFrame([], "label int, prediction int")).count() == 0
    one = spark.createDataFrame([(0, 1)], "label int, prediction int")
    report = {r["class"]: r for r in metrics.classification_report(one).collect()}
    assert (report["0"].recall, report["1"].precision, report["1"].f1, report["accuracy"].f1) == (0.0, 0.0, 0.0, 0.0)


def test_regression_metrics_by_hand(spark):
    scored = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], "a double, p double")
    found = metrics.regression_metrics(scored, "a", "p").first()
    assert found.rmse == pytest.approx(math.sqrt(5 / 3))
    assert found.mae == pytest.approx(1.0)
    assert found.r2 == pytest.approx(1 - 5 / 8)


def test_auc_counts_ties_half(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.4), (0, 0.4), (1, 0.4), (0, 0.1)]
    scored = spark.createDataFrame(rows, "label int, score double")
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert metrics.roc_auc(scored) == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)


def test_purchase_model_learns_repeats_and_reloads(spark, sessions, tmp_path):
    early, late = time_split(sessions)
    train = stage(features.prepare(early, "user_session"), "test-train")
    test = features.prepare(late, "user_session")
    model = models.train_purchase_model(train)
    scored = models.score(model, test)
    assert metrics.roc_auc(scored, schema.PURCHASE_LABEL, "score") > 0.6
    again = models.score(models.train_purchase_model(train), test)
    models.save_model(model, str(tmp_path / "m"), schema.PURCHASE_FEATURES)
    loaded, names = models.load_model(str(tmp_path / "m"))
    assert names == schema.PURCHASE_FEATURES
    expected = sorted((r.user_session, r.score) for r in scored.collect())
    for other in (again, models.score(loaded, test)):
        found = sorted((r.user_session, r.score) for r in other.collect())
        assert [k for k, _ in found] == [k for k, _ in expected]
        assert [v for _, v in found] == pytest.approx([v for _, v in expected], abs=1e-9)


def test_scaler_can_be_fitted_on_the_first_rows(sessions):
    result = purchase.train_purchase(sessions, fit_rows=50)
    assert result.report.count() == 5
    head = first_rows(sessions, 50)
    assert head.count() == 50
    assert head.agg(F.max("session_start")).first()[0] <= sessions.join(head, "user_session", "left_anti").agg(F.min("session_start")).first()[0]


@pytest.mark.parametrize("forest", [False, True])
def test_spend_models(sessions, tmp_path, forest):
    result = spend.train_spend(sessions, rounds=10, forest=forest, trees=5, save_to=str(tmp_path / "m"))
    found = result.metrics.first()
    assert found.n > 0 and found.rmse > 0
    importance = result.importance.collect()
    assert {r.feature for r in importance} == set(schema.SPEND_FEATURES)
    assert [r.importance for r in importance] == sorted((r.importance for r in importance), reverse=True)
    points = result.points.collect()
    assert all(max(p.actual, p.predicted) <= p.axis_max for p in points)
    model, names = models.load_model(str(tmp_path / "m"))
    assert names == schema.SPEND_FEATURES and model.stages


def test_spend_sample_is_exact(sessions):
    result = spend.train_spend(sessions, sample=100, rounds=2)
    assert 0 < result.metrics.first().n < 40


def test_boosting_stops_after_its_patience(sessions):
    table = models.with_target(features.featurize(sessions)).withColumn("held_out", F.abs(F.hash("user_session")) % 5 == 0)
    model = models.train_boosted_spend(table, validation="held_out", rounds=24, patience=3).stages[-1]
    held_out = models._assembler(schema.SPEND_FEATURES).transform(table.where("held_out"))
    n = model.getNumTrees
    longer = models.train_boosted_spend(table.where("NOT held_out"), rounds=min(24, n + 3)).stages[-1]
    errors = longer.evaluateEachIteration(held_out, "squared")
    assert errors[n - 1] == pytest.approx(min(errors))


def test_scores_keep_the_callers_columns(sessions):
    train = features.prepare(sessions, "user_session").withColumn("own_z", F.lit(1.5))
    scored = models.score(models.train_purchase_model(train), train)
    assert scored.columns == [*train.columns, "prediction", "score"]


def test_a_forest_of_one_class_scores_zero(sessions):
    train = features.prepare(sessions, "user_session").withColumn(schema.PURCHASE_LABEL, F.lit(0))
    scored = models.score(models.train_forest_classifier(train, trees=2, depth=2), train)
    assert scored.agg(F.max("score")).first()[0] == 0.0


def test_metrics_leave_out_rows_without_a_prediction(spark):
    scored = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0), (100.0, None), (None, 4.0)], "a double, p double")
    found = metrics.regression_metrics(scored, "a", "p").first()
    assert (found.n, found.r2) == (3, pytest.approx(1 - 5 / 8))


def test_boosting_stops_at_the_best_round(spark):
    """Every round is made once, errors are those of the model after each round, and the best prefix is kept."""
    rng = random.Random(4)
    rows = [(float(x := rng.random()), rng.random(), 2 * x + rng.gauss(0, 0.5), k % 4 == 0) for k in range(1200)]
    table = spark.createDataFrame(rows, f"a double, b double, {models.TARGET} double, out boolean")
    found = models.boost(table, "out", ["a", "b"], rounds=60, patience=8, every=7)
    best = min(range(len(found.errors)), key=found.errors.__getitem__)
    kept = found.model.stages[-1]
    assert kept.getNumTrees == best + 1
    assert len(found.errors) == min(60, best + 1 + 8)
    scored = found.model.transform(table.where("out"))
    assert scored.agg(F.avg((F.col(models.TARGET) - F.col("prediction")) ** 2)).first()[0] == pytest.approx(found.errors[best])
    # The same trees as MLlib's own loop.
    whole = models.train_boosted_spend(table.where("not out"), ["a", "b"], rounds=best + 1)
    same = whole.transform(table.where("out")).select(F.col("prediction").alias("p"), "a").join(scored, "a")
    assert same.where(F.abs(F.col("p") - F.col("prediction")) > 1e-6).count() == 0
    assert models.boost(table, "out", ["a", "b"], rounds=5).model.stages[-1].getNumTrees <= 5


def test_boosting_costs_cells_not_rows(spark, monkeypatch):
    """Rows with the same bins are one weighted row: the trees are those of MLlib's own loop over all rows."""
    rng = random.Random(5)
    rows = [(float(a := rng.randint(0, 5)), float(b := rng.randint(0, 3)), a * b + rng.gauss(0, 0.5), k % 4 == 0) for k in range(3000)]
    table = spark.createDataFrame(rows, f"a double, b double, {models.TARGET} double, out boolean")
    seen = []
    monkeypatch.setattr(models, "stage", lambda df, label: seen.append(stage(df, label)) or seen[-1])
    found = models.boost(table, "out", ["a", "b"], rounds=20, patience=20)
    assert [t.count() for t in seen] == [2 * 24] * len(seen)
    kept = found.model.stages[-1].getNumTrees
    whole = models.train_boosted_spend(table.where("not out"), ["a", "b"], rounds=kept)
    both = found.model.transform(table.where("out")).select("a", "b", models.TARGET, F.col("prediction").alias("p")).distinct().join(whole.transform(table.where("out")).select("a", "b", "prediction").distinct(), ["a", "b"])
    assert both.where(F.abs(F.col("p") - F.col("prediction")) > 1e-6).count() == 0
    assert both.agg(F.avg((F.col(models.TARGET) - F.col("p")) ** 2)).first()[0] == pytest.approx(found.errors[kept - 1])


def test_thresholds_lie_between_values():
    assert models._thresholds([1.0, 1.0, 2.0, 5.0], 32) == [1.5, 3.5]
    assert models._thresholds([], 32) == [] == models._thresholds([3.0], 32)
    many = models._thresholds([float(k) for k in range(3200)], 32)
    assert len(many) == 31 and all(abs(b - a - 100) <= 1 for a, b in zip(many, many[1:]))


def test_values_at_a_threshold_lie_below_it(spark):
    table = spark.createDataFrame([(0.0,), (2.0,)], "a double")
    placed = models.binning_stage(table, ["a"]).transform(spark.createDataFrame([(-9.0,), (1.0,), (1.5,), (9.0,)], "a double"))
    assert [r.a_bin for r in placed.orderBy("a").collect()] == [0.0, 0.0, 1.0, 1.0]


def test_forests_draw_as_many_rows_as_there_are(spark):
    """A cell of n rows is drawn Poisson(n) times for a tree: mean and variance n, whatever the layout of the data."""
    cells = spark.createDataFrame([(k, 50.0) for k in range(200)] + [(1000, 1.0)], "_key bigint, _n double")
    drawn = models._bagged(cells, 40, 7)
    weights = [list(r)[1:] for r in drawn.where("_n = 50").collect()]
    flat = [w for r in weights for w in r]
    mean = sum(flat) / len(flat)
    assert mean == pytest.approx(50, abs=0.5)
    assert sum((w - mean) ** 2 for w in flat) / len(flat) == pytest.approx(50, rel=0.1)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, models._bagged(cells.repartition(5), 40, 7).collect()))


def test_a_forest_has_no_more_leaves_than_cells(spark, tmp_path):
    rng = random.Random(6)
    rows = [(float(a := rng.randint(0, 5)), float(b := rng.randint(0, 3)), a * b + rng.gauss(0, 0.1), int(a > b)) for _ in range(3000)]
    table = spark.createDataFrame(rows, f"a double, b double, {models.TARGET} double, bought int")
    model = models.train_forest_spend(table, ["a", "b"], trees=6, depth=30)
    assert all(tree.numNodes < 2 * 24 for tree in model.stages[-1].trees) and model.stages[-1].getNumTrees == 6
    assert model.transform(table).agg(F.max(F.abs(F.col("prediction") - F.col("a") * F.col("b")))).first()[0] < 0.1
    models.save_model(model, str(tmp_path / "m"), ["a", "b"])
    assert models.load_model(str(tmp_path / "m"))[0].stages[-1].getNumTrees == 6
    classifier = models.train_forest_classifier(table, ["a", "b"], "bought", trees=6, depth=10)
    assert metrics.roc_auc(models.score(classifier, table), "bought", "score") > 0.99
    assert models.score(classifier, table).columns == [*table.columns, "prediction", "score"]


@pytest.fixture(scope="module")
def bumpy(spark):
    rng = random.Random(8)
    places = [(rng.randint(0, 9), rng.randint(0, 6), rng.randint(0, 30)) for _ in range(1500)]
    rows = [(float(a), float(b), float(c), a * b + (7 * a + 13 * b + 5 * c * c) % 17 / 8) for a, b, c in places]
    return stage(spark.createDataFrame(rows, f"a double, b double, c double, {models.TARGET} double"), "bumpy")


def test_a_forest_takes_few_jobs(spark, bumpy):
    """trees are grown in tasks, many at once, not with some jobs for every level of every tree."""
    spark.sparkContext.setJobGroup("few-jobs", "few-jobs")
    try:
        model = models.train_forest_spend(bumpy, ["a", "b", "c"], trees=12, depth=30)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert model.stages[-1].getNumTrees == 12 and min(t.depth for t in model.stages[-1].trees) > 10
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 60


@pytest.mark.parametrize("depth", [0, 4, 30])
def test_a_forest_grown_in_tasks_is_that_of_mllib(bumpy, monkeypatch, depth):
    names = ["a", "b", "c"]
    grown = models.train_forest_spend(bumpy, names, trees=3, depth=depth)
    monkeypatch.setattr(models, "TASK_CELLS", 0)
    fitted = models.train_forest_spend(bumpy, names, trees=3, depth=depth)
    ours, theirs = grown.stages[-1], fitted.stages[-1]
    assert [(t.numNodes, t.depth) for t in ours.trees] == [(t.numNodes, t.depth) for t in theirs.trees]
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-3)
    both = grown.transform(bumpy).select(*names, F.col("prediction").alias("p")).distinct().join(fitted.transform(bumpy).distinct(), names)
    assert both.count() > 1000 and both.where(F.abs(F.col("p") - F.col("prediction")) > 1e-9).count() == 0


def test_a_forest_is_scored_by_its_bins(spark, bumpy, monkeypatch):
    """Every row has the prediction that it has alone, equal rows included."""
    model = models.train_forest_spend(bumpy, ["a", "b", "c"], trees=3, depth=8)
    table = bumpy.unionAll(bumpy.limit(40)).withColumn(schema.SPEND_TARGET, F.lit(2.5)).withColumn("own", F.lit("x"))
    asked = []
    transform = models.RandomForestRegressionModel.transform
    monkeypatch.setattr(models.RandomForestRegressionModel, "transform", lambda self, df, *more: asked.append(df.count()) or transform(self, df, *more))
    found = models.score_spend(model, table)
    assert asked == [model.stages[0].transform(table).select(*model.stages[0].getOutputCols()).distinct().count()]
    assert found.columns == [*table.columns, "actual", "predicted"]
    alone = models.score(model, table).select("a", "b", "c", F.expm1("prediction").alias("p"))
    key = lambda r: (r[0], r[1], r[2], round(r[3], 6))
    assert sorted(map(key, found.select("a", "b", "c", "predicted").collect())) == sorted(map(key, alone.select("a", "b", "c", "p").collect()))
