"""Spend prediction by linear regression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import half_even
from ledgerloom.operators.scaling import assemble, standardise, train_test_split
from ledgerloom.session import materialise

BASELINE = ["Recency", "Frequency"]
# Average purchase value is derived from the target, so it is not a predictor.
EXTENDED_PREDICTORS = BASELINE + ["ProductDiversity", "AvgDaysBetweenTransactions"]
# Smallest denominator of a percentage error: the double-precision epsilon.
EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class SpendModel:
    """A fitted model: its coefficients, and all rows with their predictions."""

    coefficients: DataFrame
    scored: DataFrame


def spend_regression(
    features: DataFrame,
    predictors: Sequence[str] = BASELINE,
    target: str = "Monetary",
    test_share: float = 0.2,
) -> SpendModel:
    """Least squares on predictors scaled by the training rows alone.

    The solver sums the normal equations on the executors; the driver solves a
    system of as many unknowns as predictors.
    """
    return fit_split(split_rows(features, predictors, target, test_share), predictors)


def split_rows(
    features: DataFrame, predictors: Sequence[str], target: str = "Monetary", test_share: float = 0.2
) -> DataFrame:
    """Customers with predictors, ``actual`` and ``is_test``, written out since a fit reads them often."""
    needed = features.select("CustomerID", *predictors, F.col(target).alias("actual"))
    return materialise(train_test_split(needed, test_share=test_share), "regression")


def fit_split(split: DataFrame, predictors: Sequence[str]) -> SpendModel:
    """Least squares on rows that ``split_rows`` made."""
    train = split.filter(~F.col("is_test"))
    names = [f"{name}_scaled" for name in predictors]
    points = assemble(standardise(split, predictors, fit_on=train), names)
    model = LinearRegression(
        featuresCol="point", labelCol="actual", predictionCol="predicted", solver="normal"
    ).fit(points.filter(~F.col("is_test")))
    terms = [("Intercept", float(model.intercept))]
    terms += list(zip(predictors, (float(value) for value in model.coefficients)))
    coefficients = split.sparkSession.createDataFrame(terms, "term string, coefficient double")
    scored = model.transform(points).select("CustomerID", "is_test", "actual", "predicted")
    return SpendModel(coefficients, scored)


def test_rows(model: SpendModel) -> DataFrame:
    return model.scored.filter("is_test")


def actual_vs_predicted(model: SpendModel) -> DataFrame:
    """Test customers with actual and predicted spend, rounded to cents."""
    return test_rows(model).select(
        "CustomerID",
        half_even(F.col("actual"), 2).alias("ActualMonetary"),
        half_even(F.col("predicted"), 2).alias("PredictedMonetary"),
    )


def regression_metrics(scored: DataFrame) -> DataFrame:
    """MAE, RMSE, MAPE in percent and R2 of (actual, predicted) in one pass."""
    error = F.col("actual") - F.col("predicted")
    share = F.abs(error) / F.greatest(F.abs("actual"), F.lit(EPSILON))
    explained = 1 - F.try_divide(
        F.sum(error * error), F.var_pop("actual") * F.count("actual")
    )
    return scored.agg(
        half_even(F.avg(F.abs(error)), 2).alias("MAE"),
        half_even(F.sqrt(F.avg(error * error)), 2).alias("RMSE"),
        half_even(F.avg(share) * 100, 2).alias("MAPE"),
        half_even(explained, 4).alias("R2"),
    )


def model_report(model: SpendModel, name: str, predictors: Sequence[str]) -> DataFrame:
    """The metrics with the model's name, features and target."""
    return regression_metrics(test_rows(model)).select(
        F.lit(name).alias("Model"),
        F.lit(", ".join(predictors)).alias("Features"),
        F.lit("Monetary").alias("Target"),
        "MAE",
        "RMSE",
        "MAPE",
        "R2",
    )


def regression_comparison(features: DataFrame) -> DataFrame:
    """Baseline and extended predictors on the same split, one row each."""
    split = split_rows(features, EXTENDED_PREDICTORS)
    baseline = model_report(fit_split(split, BASELINE), "Baseline Regression", BASELINE)
    extended = model_report(
        fit_split(split, EXTENDED_PREDICTORS),
        "Extended Feature Regression",
        EXTENDED_PREDICTORS,
    )
    return baseline.unionByName(extended)
