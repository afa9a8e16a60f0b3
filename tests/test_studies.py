"""Independent models of a study are fitted side by side, and what they share is counted once."""

import threading

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics, models


def test_fits_run_side_by_side_in_their_order(spark):
    met = threading.Barrier(2, timeout=20)
    assert models.side_by_side(spark, [lambda i=i: (met.wait(), i * i)[1] for i in range(4)], 2) == [0, 1, 4, 9]
    with pytest.raises(ZeroDivisionError):
        models.side_by_side(spark, [lambda: 1 / 0, lambda: 1])


class Flat:
    """A detector that scores by id."""

    threshold = 0.5

    def score(self, df):
        return df.withColumn("score", (F.col("transaction_id") * 37 % 100) / 100)


def test_studies_fit_their_models_side_by_side(spark, monkeypatch):
    met = threading.Barrier(2, timeout=60)  # broken where a model waits for the one before

    def fit(*_, **__):
        met.wait()
        return Flat()

    monkeypatch.setattr(models, "fit_detector", fit)
    df = spark.range(400).selectExpr("id AS transaction_id", "CAST(id % 40 AS INT) AS day", "CAST(id % 7 = 0 AS INT) AS is_fraud", "'none' AS fraud_type", "CAST(id AS DOUBLE) AS amount", "CAST(id % 50 AS DOUBLE) AS x")
    got = models.delayed_label_retraining(df, ["x"], (10, 20), 30, 5).collect()
    assert [r["available_training_end_day"] for r in got] == [24, 29] and len({r["pr_auc"] for r in got}) == 1
    assert [r["analyst_review_budget"] for r in models.feedback_curve(df, ["x"], ["x"], (10, 20, 30), (0, 5)).collect()] == [0, 5]
    got = models.verification_bias(df, ["x"], F.col("transaction_id") % 5 == 0, (20, 30), (0.0, 0.5), (1, 2)).collect()
    assert [(r["audit_rate"], r["seed"]) for r in got] == [(0.0, 1), (0.0, 2), (0.5, 1), (0.5, 2)]
    assert [r["train_end_day"] for r in models.rolling_backtest(df, ["x"], 10, 5, 2).collect()] == [10, 15]


def test_thresholds_share_one_ordering(spark):
    df = spark.range(300).selectExpr("id AS transaction_id", "CAST(id % 11 = 0 AS INT) AS is_fraud", "CAST(id AS DOUBLE) AS amount", "(id * 37 % 50) / 50 AS score")
    assert metrics.at_thresholds(df, [0.2, 0.7, 2.0]) == [metrics.binary_metrics(df, t).first().asDict() for t in (0.2, 0.7, 2.0)]
    row = metrics.binary_metrics(df, 0.5).first()
    assert row["roc_auc"] == metrics.roc_auc(df).first()[0] and row["pr_auc"] == metrics.average_precision(df).first()[0]
    with pytest.raises(ValueError):
        metrics.at_thresholds(df.withColumn("score", F.lit(2.0)), [0.5])
