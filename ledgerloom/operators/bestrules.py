"""The strongest association rules of each segment, without making all splits of large sets.

A set of n items has 2^n - 2 splits. Here the items of a set are dealt to the two
sides one by one, and a split dealt in part goes on only while the best rule it may
still become could be among its segment's best. The bound rests on one fact: a side
that lacks item i lies within the set without i, so it is in at least as many baskets
as that set, whose count is known. Pairs, then rules with one consequent, set the bar
before any larger split is dealt. Splits that go on are rows of a table, however many: a
set whose bound stays ahead of the bar to the end is split in all ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.baskets import drop_mirrored, measure_splits, top_rules
from ledgerloom.session import materialise, release

RULE = ["segment", "antecedents", "consequents", "support", "confidence", "lift"]


def _best(rules: DataFrame, count: int) -> DataFrame:
    """At most ``count`` rules a segment; partitions keep no more before they are shuffled."""
    order = Window.partitionBy("segment").orderBy(
        F.desc("lift"), F.desc("support"), "antecedents", "consequents"
    )
    return rules.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= count)


def _within_reach(splits: DataFrame, best: DataFrame, count: int, min_lift: float) -> DataFrame:
    """The partial splits whose bound is not behind their segment's last best rule.

    Behind means less lift, or as much with less support, or as much of both with
    antecedents that come later in order. Counts are whole and division is monotone,
    so bounds and lifts compare without a tolerance.
    """
    bar = best.filter(F.col("place") == count).select(
        "segment",
        F.col("lift").alias("bar_lift"),
        F.col("support").alias("bar_support"),
        F.col("antecedents").alias("bar_antecedents"),
    )
    total = F.col("baskets").cast("double")
    both = F.col("both").cast("double")
    bound = both * total / (F.col("least_ante").cast("double") * F.col("least_cons").cast("double"))
    support = both / total
    ahead = (bound > F.col("bar_lift")) | (
        (bound == F.col("bar_lift"))
        & (
            (support > F.col("bar_support"))
            | ((support == F.col("bar_support")) & (F.col("first") <= F.col("bar_antecedents")))
        )
    )
    return (
        splits.filter(bound >= F.lit(float(min_lift)))
        .join(bar, "segment", "left")
        .filter(F.col("bar_lift").isNull() | ahead)
        .drop("bar_lift", "bar_support", "bar_antecedents")
    )


def _with_bounds(splits: DataFrame) -> DataFrame:
    """Add the least counts of both sides and the first antecedents in order that a split can reach.

    ``lacking[i]`` counts the baskets that hold the set without its item i. A side's
    count is at least the largest ``lacking`` of the other side's items; an empty side
    gets at least the smallest of those not dealt yet, and the largest of those not
    dealt falls to one of the two. The antecedents are the larger side.
    """
    rest = F.slice("lacking", F.col("dealt") + 1, F.size("items"))
    low = F.array_min(F.col("rest"))
    cons = F.coalesce("top_cons", low)  # bounds the antecedents' count
    ante = F.coalesce("top_ante", low)
    high = F.coalesce(F.array_max("rest"), F.lit(0))
    lifted = F.greatest(cons, high) * ante <= cons * F.greatest(ante, high)
    half = F.floor((F.size("items") + 1) / 2).cast("int")
    more = F.greatest(half - F.size("left"), F.lit(0))
    return (
        splits.withColumn("rest", rest)
        .withColumn("least_ante", F.when(lifted, F.greatest(cons, high)).otherwise(cons))
        .withColumn("least_cons", F.when(lifted, ante).otherwise(F.greatest(ante, high)))
        .withColumn("first", F.concat("left", F.slice("items", F.col("dealt") + 1, more)))
        .drop("rest")
    )


def _deal(splits: DataFrame) -> DataFrame:
    """Every split twice, its next item on either side, unless a side would have too many.

    The antecedents are the larger side, or of two equal ones the one with the first item.
    """

    def side(antecedent: bool) -> Column:
        item, lacking = F.get("items", F.col("dealt")), F.get("lacking", F.col("dealt"))
        return F.struct(
            (F.concat("left", F.array(item)) if antecedent else F.col("left")).alias("left"),
            (F.greatest("top_ante", lacking) if antecedent else F.col("top_ante")).alias("top_ante"),
            (F.col("top_cons") if antecedent else F.greatest("top_cons", lacking)).alias("top_cons"),
        )

    n, consequents = F.size("items"), F.col("dealt") - F.size("left")
    leads = F.get("left", F.lit(0)) == F.get("items", F.lit(0))
    return (
        splits.withColumn("way", F.explode(F.array(side(True), side(False))))
        .drop("left", "top_ante", "top_cons")
        .select("*", "way.*")
        .drop("way")
        .withColumn("dealt", F.col("dealt") + 1)
        .filter(F.size("left") < n)
        .filter((2 * consequents < n) | ((2 * consequents == n) & F.coalesce(leads, F.lit(False))))
    )


def best_rules(itemsets: DataFrame, count: int = 10, min_lift: float = 1.0) -> DataFrame:
    """What ``top_rules`` gives of all rules without mirrored ones, by bounds.

    ``itemsets`` holds (segment, items, freq, baskets) and, with every set, all its
    subsets, as ``frequent_itemsets`` returns them. A segment with fewer rules gets
    all it has; no sets give no rows.
    """
    sets = itemsets.filter(F.size("items") >= 2).withColumnRenamed("freq", "both")

    def rules(splits: DataFrame) -> DataFrame:
        return drop_mirrored(measure_splits(splits, itemsets, min_lift)).select(RULE)

    def improved(best: DataFrame | None, found: DataFrame) -> DataFrame:
        every = found if best is None else best.select(RULE).unionByName(found)
        return materialise(_best(every, count), "best-rules")

    pairs = sets.filter(F.size("items") == 2)
    best = improved(
        None,
        rules(
            pairs.select(
                "segment",
                F.slice("items", 1, 1).alias("antecedents"),
                F.slice("items", 2, 1).alias("consequents"),
                "both",
                "baskets",
            )
        ),
    )
    # No side is in fewer baskets than the whole set, so sets may fall behind before any join.
    half = F.floor((F.size("items") + 1) / 2).cast("int")
    larger = _within_reach(
        sets.filter(F.size("items") > 2)
        .withColumn("least_ante", F.col("both"))
        .withColumn("least_cons", F.col("both"))
        .withColumn("first", F.slice("items", 1, half)),
        best,
        count,
        min_lift,
    )
    counts = itemsets.select("segment", F.col("items").alias("antecedents"), F.col("freq").alias("lacking"))
    singles = materialise(
        larger.select("segment", "items", "both", "baskets", F.posexplode("items").alias("place", "item"))
        .withColumn("antecedents", F.filter("items", lambda _, i: i != F.col("place")))
        .join(counts, ["segment", "antecedents"]),
        "singles",
    )
    before = best
    best = improved(
        best,
        rules(
            singles.select(
                "segment", "antecedents", F.array("item").alias("consequents"), "both", "baskets"
            )
        ),
    )
    release(before)
    # Sets of three have no other splits than those with one consequent.
    state = (
        singles.filter(F.size("items") > 3)
        .groupBy("segment", "items", "both", "baskets")
        .agg(F.array_sort(F.collect_list(F.struct("place", "lacking"))).alias("lacking"))
        .select(
            "segment",
            "items",
            "both",
            "baskets",
            F.col("lacking.lacking").alias("lacking"),
            F.lit(0).alias("dealt"),
            F.lit(None).cast("bigint").alias("top_ante"),
            F.lit(None).cast("bigint").alias("top_cons"),
            F.slice("items", 1, 0).alias("left"),
        )
    )
    spent = singles
    while True:
        dealt = materialise(
            _within_reach(_with_bounds(state), best, count, min_lift).drop(
                "least_ante", "least_cons", "first"
            ),
            "splits",
        )
        release(spent)
        if dealt.isEmpty():
            release(dealt)
            return top_rules(best.select(RULE), count)
        whole = F.col("dealt") == F.size("items")
        ended = dealt.filter(whole & (F.size("left") < F.size("items") - 1))
        if not ended.isEmpty():
            before = best
            best = improved(
                best,
                rules(
                    ended.select(
                        "segment",
                        F.col("left").alias("antecedents"),
                        F.filter("items", lambda item: ~F.array_contains("left", item)).alias("consequents"),
                        "both",
                        "baskets",
                    )
                ),
            )
            release(before)
        state, spent = _deal(dealt.filter(~whole)), dealt
