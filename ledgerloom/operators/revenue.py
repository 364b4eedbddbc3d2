"""Sales pipeline KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import half_up, percent
from ledgerloom.functions.columns import MONEY

WON, LOST = "Won", "Lost"


def _is(stage: str) -> Column:
    return F.col("deal_stage") == stage


def _exact_sum(column: str) -> Column:
    return F.sum(F.col(column).cast(MONEY))


def total_revenue_won(pipeline: DataFrame) -> DataFrame:
    return pipeline.filter(_is(WON)).agg(
        half_up(_exact_sum("close_value"), 0).alias("total_revenue")
    )


def total_opportunities(pipeline: DataFrame) -> DataFrame:
    return pipeline.agg(F.count(F.lit(1)).alias("total_opportunities"))


def win_rate(pipeline: DataFrame) -> DataFrame:
    """Won among all opportunities, in percent."""
    rate = percent(F.count_if(_is(WON)), F.count(F.lit(1)))
    return pipeline.agg(half_up(rate, 2).alias("win_rate"))


def closed_win_rate(pipeline: DataFrame) -> DataFrame:
    """Won among closed opportunities, in percent; null when none is closed."""
    closed = F.col("deal_stage").isin(WON, LOST)
    rate = percent(F.count_if(_is(WON)), F.count_if(closed))
    return pipeline.agg(half_up(rate, 2).alias("closed_win_rate"))


def stage_counts(pipeline: DataFrame) -> DataFrame:
    return pipeline.groupBy("deal_stage").agg(F.count(F.lit(1)).alias("opportunities"))


def average_won_deal(pipeline: DataFrame) -> DataFrame:
    won = pipeline.filter(_is(WON) & F.col("close_value").isNotNull())
    mean = F.try_divide(_exact_sum("close_value").cast("double"), F.count(F.lit(1)))
    return won.agg(half_up(mean, 2).alias("avg_won_deal"))


def active_pipeline(pipeline: DataFrame) -> DataFrame:
    """Opportunities neither won nor lost."""
    return pipeline.agg(
        F.count_if(~F.coalesce("deal_stage", F.lit("")).isin(WON, LOST)).alias("active_opportunities")
    )


def _won_by(pipeline: DataFrame, key: str) -> DataFrame:
    return pipeline.filter(_is(WON)).groupBy(key).agg(_exact_sum("close_value").alias("won"))


def _report(totals: DataFrame, key: str) -> DataFrame:
    return (
        totals.groupBy(key)
        .agg(half_up(F.sum("won"), 0).alias("revenue"))
        .orderBy(F.desc("revenue"), key)
    )


def revenue_by_sector(pipeline: DataFrame, accounts: DataFrame) -> DataFrame:
    """Won revenue per sector; deals without a known account drop out.

    Deals are summed per account before the join, so a dominant account is one
    row by then, and the optimizer broadcasts accounts only if they are small.
    """
    totals = _won_by(pipeline.filter(F.col("account").isNotNull()), "account")
    return _report(totals.join(accounts, "account"), "sector")


def revenue_by_product(pipeline: DataFrame) -> DataFrame:
    return _report(_won_by(pipeline, "product"), "product")


def revenue_by_manager(pipeline: DataFrame, teams: DataFrame) -> DataFrame:
    """Won revenue per manager, summed per agent before the join."""
    return _report(_won_by(pipeline, "sales_agent").join(teams, "sales_agent"), "manager")


def pipeline_pivot(pipeline: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Product rows by stage columns: counts and closed value.

    The stage list is given, so no extra job looks for the pivot values.
    """
    return (
        pipeline.groupBy("product")
        .pivot("deal_stage", list(stages))
        .agg(
            F.count(F.lit(1)).alias("deals"),
            _exact_sum("close_value").cast("double").alias("value"),
        )
    )


def explore(
    pipeline: DataFrame,
    teams: DataFrame,
    managers: Sequence[str] | None = None,
    agents: Sequence[str] | None = None,
    products: Sequence[str] | None = None,
    stages: Sequence[str] | None = None,
) -> DataFrame:
    """Opportunities that pass every given list of values; an absent list passes all."""
    kept = pipeline
    for column, values in (("sales_agent", agents), ("product", products), ("deal_stage", stages)):
        if values is not None:
            kept = kept.filter(F.col(column).isin(list(values)))
    if managers is not None:
        teams = teams.filter(F.col("manager").isin(list(managers)))
    how = "left" if managers is None else "inner"
    return kept.join(teams, "sales_agent", how)
