"""Market baskets: frequent product sets and association rules per segment.

Everything stays in long form, one row per basket and item; there is no column
per product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import half_even
from ledgerloom.session import materialise


def basket_items(clean: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct (segment, InvoiceNo, item) with a positive total quantity.

    Lines are summed per invoice and item before they meet the labels, which
    shrinks whatever a dominant customer bought.
    """
    bought = (
        clean.filter(F.col("Description").isNotNull())
        .groupBy("CustomerID", "InvoiceNo", F.col("Description").alias("item"))
        .agg(F.sum(F.col("Quantity").cast("bigint")).alias("quantity"))
    )
    return (
        bought.join(labels.select("CustomerID", "segment"), "CustomerID")
        .groupBy("segment", "InvoiceNo", "item")
        .agg(F.sum("quantity").alias("quantity"))
        .filter(F.col("quantity") > 0)
        .select("segment", "InvoiceNo", "item")
    )


def frequent_items(items: DataFrame, support: float, min_baskets: int) -> DataFrame:
    """(segment, item, n, code, baskets, least): items that reach their segment's least count.

    The least count is the smallest whose share reaches the support, in integers
    (no 0.02 * n). Codes number a segment's items from the most frequent on.
    Segments with too few baskets are left out, as are rows without a segment.
    """
    parts = round(support * 1_000_000)
    totals = (
        items.groupBy("segment")
        .agg(F.countDistinct("InvoiceNo").alias("baskets"))
        .filter(F.col("baskets") >= min_baskets)
        .withColumn("least", F.expr(f"greatest(1, (baskets * {parts} + 999999) div 1000000)"))
    )
    rank = Window.partitionBy("segment").orderBy(F.desc("n"), "item")
    return (
        items.groupBy("segment", "item")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(totals, "segment")
        .filter(F.col("n") >= F.col("least"))
        .withColumn("code", F.row_number().over(rank) - 1)
    )


def coded_baskets(items: DataFrame, frequent: DataFrame) -> DataFrame:
    """(segment, grown, rest, weight): equal baskets as one row, codes rising, nothing grown yet."""
    return (
        items.join(frequent.select("segment", "item", "code"), ["segment", "item"])
        .groupBy("segment", "InvoiceNo")
        .agg(F.array_sort(F.collect_set("code")).alias("rest"))
        .groupBy("segment", "rest")
        .agg(F.count(F.lit(1)).alias("weight"))
        .select("segment", F.array().cast("array<int>").alias("grown"), "rest", "weight")
    )


def conditional_baskets(baskets: DataFrame) -> DataFrame:
    """The same columns with each item of ``rest`` moved to ``grown``, before it only what is more frequent."""
    return (
        baskets.select("segment", "grown", "rest", "weight", F.posexplode("rest").alias("place", "code"))
        .groupBy(
            "segment",
            F.concat("grown", F.array("code")).alias("grown"),
            F.slice("rest", F.lit(1), F.col("place")).alias("rest"),
        )
        .agg(F.sum("weight").alias("weight"))
    )


def grow_sets(lists: pa.ListArray, weights: np.ndarray, least: int) -> Iterator[tuple[list[int], int]]:
    """Every set of codes that weighs at least ``least`` among the lists, with its weight.

    The lists are a bit matrix; a set is extended by rarer-first codes among the
    rows that hold it, so no set is met twice.
    """
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    codes, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    kept = np.flatnonzero(np.bincount(column, weights[row], len(codes)) >= least)
    place = np.full(len(codes), -1)
    place[kept] = np.arange(len(kept))
    column = place[column]
    held = np.zeros((len(lists), len(kept)), bool)
    held[row[column >= 0], column[column >= 0]] = True
    codes = codes[kept]
    waiting = [([], np.arange(len(lists)), np.arange(len(kept)))]
    while waiting:
        grown, rows, able = waiting.pop()
        sums = weights[rows].astype(float) @ held[np.ix_(rows, able)]  # whole numbers below 2^53
        enough = sums >= least
        able, sums = able[enough], sums[enough]
        for turn, (code, total) in enumerate(zip(able.tolist(), sums.tolist())):
            larger = [*grown, int(codes[code])]
            yield larger, int(total)
            if turn:
                waiting.append((larger, rows[held[rows, code]], able[:turn]))


def _grow_group(group: pa.Table) -> pa.Table:
    """All frequent sets that one set of codes grows to."""
    grown = group.column("grown")[0].as_py()
    rest = group.column("rest").combine_chunks()
    if isinstance(rest, pa.ChunkedArray):
        rest = rest.chunk(0)
    found = list(grow_sets(rest, group.column("weight").to_numpy(), group.column("least")[0].as_py()))
    return pa.table(
        {
            "segment": pa.array([group.column("segment")[0].as_py()] * len(found), group.schema.field("segment").type),
            "grown": pa.array([grown + more for more, _ in found], pa.list_(pa.int32())),
            "freq": pa.array([freq for _, freq in found], pa.int64()),
        }
    )


def frequent_itemsets(
    items: DataFrame, support: float = 0.02, min_baskets: int = 10, group_rows: int = 16_384
) -> DataFrame:
    """Item sets of any size at or above the support: (segment, items, freq, baskets).

    All segments are mined together. Every basket goes to each of its frequent
    items, with the items more frequent than that one, and equal rows become one
    weighted row before the shuffle. Where an item's rows are at most
    ``group_rows``, one task grows all its sets; a larger item is split by its
    second item, and so on, so no group outgrows a task. Items below the support
    cannot be in a frequent set and never enter a basket. Segments with too few
    baskets are skipped.
    """
    items = materialise(items, "baskets")
    frequent = materialise(frequent_items(items, support, min_baskets), "frequent")
    least = frequent.groupBy("segment").agg(F.max("least").alias("least"))
    kind = items.schema["segment"].dataType.simpleString()
    state, found = coded_baskets(items, frequent), []
    while True:
        rows = materialise(conditional_baskets(state), "conditional")
        sets = materialise(
            rows.groupBy("segment", "grown")
            .agg(F.sum("weight").alias("freq"), F.count(F.lit(1)).alias("rows"))
            .join(least, "segment")
            .filter(F.col("freq") >= F.col("least")),
            "sets",
        )
        alive = rows.filter(F.size("rest") > 0).join(sets, ["segment", "grown"])
        grown = (
            alive.filter(F.col("rows") <= group_rows)
            .select("segment", "grown", "rest", "weight", "least")
            .groupBy("segment", "grown")
            .applyInArrow(_grow_group, f"segment {kind}, grown array<int>, freq bigint")
        )
        found += [sets.select("segment", "grown", "freq"), grown]
        if sets.filter(F.col("rows") > group_rows).isEmpty():
            break
        state = alive.filter(F.col("rows") > group_rows).select("segment", "grown", "rest", "weight")
    # A segment has no more frequent items than its baskets' mean size divided by the support.
    names = frequent.groupBy("segment").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("code", "item"))), lambda x: x["item"]).alias("names"),
        F.max("baskets").alias("baskets"),
    )
    return materialise(
        reduce(DataFrame.unionByName, found)
        .join(names, "segment")
        .select(
            "segment",
            F.array_sort(F.transform("grown", lambda code: F.get("names", code))).alias("items"),
            "freq",
            "baskets",
        ),
        "itemsets",
    )


def association_rules(itemsets: DataFrame, min_lift: float = 1.0) -> DataFrame:
    """Every split of every frequent set into antecedents -> consequents, with measures.

    The supports of both sides are looked up among the sets themselves; all
    subsets of a frequent set are frequent, so none is missing. The lift bound
    compares products of counts, not rounded quotients.
    """
    size = F.size("items")

    def masks(bits: Column) -> Column:
        """All numbers of so many bits."""
        return F.explode(F.sequence(F.lit(0).cast("bigint"), (F.pow(F.lit(2.0), bits) - 1).cast("bigint")))

    # Two halves of the subset's mask, so that no row holds an array of all subsets.
    half = F.floor(size / 2).cast("int")
    splits = (
        itemsets.filter(size >= 2)
        .withColumn("low", masks(half))
        .withColumn("high", masks(size - half))
        .withColumn("mask", F.col("low") + F.col("high") * F.pow(F.lit(2.0), half).cast("bigint"))
        .filter((F.col("mask") > 0) & (F.col("mask") < F.pow(F.lit(2.0), size).cast("bigint") - 1))
        .select(
            "segment",
            F.filter("items", lambda _, i: F.getbit("mask", i) == 1).alias("antecedents"),
            F.filter("items", lambda _, i: F.getbit("mask", i) == 0).alias("consequents"),
            F.col("freq").alias("both"),
            "baskets",
        )
    )
    return measure_splits(splits, itemsets, min_lift)


def measure_splits(splits: DataFrame, itemsets: DataFrame, min_lift: float = 1.0) -> DataFrame:
    """The measures of splits (segment, antecedents, consequents, both, baskets) that reach the lift."""
    left = itemsets.select("segment", F.col("items").alias("antecedents"), F.col("freq").alias("ante"))
    right = itemsets.select("segment", F.col("items").alias("consequents"), F.col("freq").alias("cons"))
    both, total = F.col("both").cast("double"), F.col("baskets").cast("double")
    ante, cons = F.col("ante").cast("double"), F.col("cons").cast("double")
    kept = (
        splits.join(left, ["segment", "antecedents"])
        .join(right, ["segment", "consequents"])
        .filter(both * total >= F.lit(float(min_lift)) * ante * cons)
    )
    measured = kept.select(
        "segment",
        "antecedents",
        "consequents",
        (ante / total).alias("antecedent_support"),
        (cons / total).alias("consequent_support"),
        (both / total).alias("support"),
        (both / ante).alias("confidence"),
        (both * total / (ante * cons)).alias("lift"),
        ((both * total - ante * cons) / (total * total)).alias("leverage"),
        # Null where the confidence is one.
        F.try_divide((total - cons) * ante, total * (ante - both)).alias("conviction"),
    )
    bound = F.greatest(
        F.col("support") * (1 - F.col("antecedent_support")),
        F.col("antecedent_support") * (F.col("consequent_support") - F.col("support")),
    )
    return measured.withColumn("zhang", F.try_divide(F.col("leverage"), bound))


def drop_mirrored(rules: DataFrame) -> DataFrame:
    """Keep one of A -> B and B -> A: the larger antecedent, then the lesser in order.

    Lift is symmetric, so both directions are always present and a plain filter
    decides; nothing is grouped.
    """
    larger = F.size("antecedents") > F.size("consequents")
    even = F.size("antecedents") == F.size("consequents")
    return rules.filter(larger | (even & (F.col("antecedents") < F.col("consequents"))))


def top_rules(rules: DataFrame, count: int = 10) -> DataFrame:
    """The strongest rules of each segment as readable, rounded rows."""
    order = Window.partitionBy("segment").orderBy(
        F.desc("lift"), F.desc("support"), "antecedents", "consequents"
    )
    return (
        rules.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= count)
        .select(
            "segment",
            "position",
            F.concat_ws(", ", "antecedents").alias("antecedents"),
            F.concat_ws(", ", "consequents").alias("consequents"),
            half_even(F.col("support"), 4).alias("support"),
            half_even(F.col("confidence"), 4).alias("confidence"),
            half_even(F.col("lift"), 4).alias("lift"),
        )
    )
