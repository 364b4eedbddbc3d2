"""Scaling, regression, clusters, scores and baskets."""

import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import (
    baskets,
    density,
    kmeans,
    projection,
    regression,
    scaling,
    scores,
    segments,
)


def test_population_deviation_and_constant_columns(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "v double, c double")
    rows = scaling.standardise(frame, ["v", "c"]).orderBy("v").collect()
    assert rows[0].v_scaled == pytest.approx(-math.sqrt(1.5))
    assert {r.c_scaled for r in rows} == {0.0}


@pytest.mark.parametrize("rows", [1, 5, 37, 1000])
def test_split_takes_the_smallest_digests(spark, rows):
    import hashlib

    ids = [str(i) for i in range(rows)]
    frame = spark.createDataFrame([(i,) for i in ids], "CustomerID string")
    got = {r.CustomerID for r in scaling.train_test_split(frame).filter("is_test").collect()}
    ordered = sorted(ids, key=lambda i: hashlib.md5(i.encode()).hexdigest())
    assert got == set(ordered[: math.ceil(rows * 0.2)])


def test_regression_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"Recency": rng.integers(1, 300, 200), "Frequency": rng.integers(1, 20, 200)})
    data["Monetary"] = 50.0 * data.Frequency - data.Recency + rng.normal(0, 20, 200)
    data.insert(0, "CustomerID", [str(i) for i in range(200)])
    model = regression.spend_regression(spark.createDataFrame(data))
    scored = model.scored.toPandas().merge(data, on="CustomerID")
    train = scored[~scored.is_test]
    design = np.c_[np.ones(len(train)), train.Recency, train.Frequency]
    beta = np.linalg.lstsq(design, train.Monetary, rcond=None)[0]
    expected = np.c_[np.ones(len(scored)), scored.Recency, scored.Frequency] @ beta
    np.testing.assert_allclose(scored.predicted, expected, rtol=1e-7)
    test = scored[scored.is_test]
    row = regression.regression_metrics(model.scored.filter("is_test")).first()
    error = test.actual - test.predicted
    assert row.RMSE == pytest.approx(math.sqrt((error**2).mean()), abs=0.006)
    r2 = 1 - (error**2).sum() / ((test.actual - test.actual.mean()) ** 2).sum()
    assert row.R2 == pytest.approx(r2, abs=6e-5)


def test_mape_of_regression_keeps_zero_actuals(spark):
    scored = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "actual double, predicted double")
    expected = (1 / 2.220446049250313e-16 + 0.5) / 2 * 100
    assert regression.regression_metrics(scored).first().MAPE == pytest.approx(expected)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[0, 0], [6, 0], [0, 6]])
    points = np.concatenate([c + rng.normal(0, 0.5, (n, 2)) for c, n in zip(centres, (60, 40, 20))])
    data = pd.DataFrame(points, columns=["x", "y"])
    data["truth"] = np.repeat([0, 1, 2], [60, 40, 20])
    data["Monetary"] = np.repeat([100.0, 300.0, 200.0], [60, 40, 20])
    data["CustomerID"] = [str(i) for i in range(len(data))]
    return data


def _silhouette(points, labels):
    distance = ((points[:, None] - points[None]) ** 2).sum(-1)
    values = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            values.append(0.0)
            continue
        a = distance[i][same].sum() / (same.sum() - 1)
        b = min(distance[i][labels == other].mean() for other in set(labels) - {own})
        values.append((b - a) / max(a, b))
    return float(np.mean(values))


def test_scores_match_brute_force(spark, blobs):
    data = blobs.copy()
    data.loc[0, "truth"] = 3  # a singleton
    frame = spark.createDataFrame(data).repartition(5)
    xy, labels = data[["x", "y"]].to_numpy(), data.truth.to_numpy()
    got = scores.silhouettes(frame, ["x", "y"], ["truth"]).first().silhouette
    assert got == pytest.approx(_silhouette(xy, labels), rel=1e-9)
    centre = {k: xy[labels == k].mean(0) for k in set(labels)}
    spread = {k: np.sqrt(((xy[labels == k] - c) ** 2).sum(1)).mean() for k, c in centre.items()}
    worst = [
        max((spread[i] + spread[j]) / np.linalg.norm(centre[i] - centre[j]) for j in centre if j != i)
        for i in centre
    ]
    index = scores.davies_bouldin(frame, ["x", "y"], "truth").first().davies_bouldin
    assert index == pytest.approx(np.mean(worst), rel=1e-9)


def test_euclidean_silhouette_of_all_points_is_exact_and_of_a_draw_near(spark):
    rng = np.random.default_rng(4)
    xy = rng.normal(size=(300, 2)) + rng.integers(0, 3, 300)[:, None] * 3
    labels = (xy.sum(1) > 3).astype(int) + (xy.sum(1) > 9)
    labels[7] = 9  # alone in its cluster
    gap = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    want = []
    for i, own in enumerate(labels):
        mean = {c: gap[i, labels == c].sum() / (np.sum(labels == c) - (c == own) or 1) for c in set(labels)}
        a, b = mean.pop(own), min(v for c, v in mean.items() if c != own)
        want.append(0 if (labels == own).sum() == 1 else (b - a) / max(a, b))
    data = pd.DataFrame({"CustomerID": range(300), "x": xy[:, 0], "y": xy[:, 1], "l": labels})
    frame = spark.createDataFrame(data).repartition(4)
    whole = scores.euclidean_silhouettes(frame, ["x", "y"], ["l"]).first()
    assert whole.silhouette == pytest.approx(np.mean(want), rel=1e-9) and whole.standard_error == 0
    some = scores.euclidean_silhouettes(frame, ["x", "y"], ["l"], draws=150).first()
    assert abs(some.silhouette - np.mean(want)) < 4 * some.standard_error and some.draws == 150
    assert scores.euclidean_silhouettes(frame.limit(0), ["x", "y"], ["l"]).count() == 0


def test_one_cluster_has_no_silhouette(spark, blobs):
    frame = spark.createDataFrame(blobs).withColumn("one", F.lit(0))
    assert scores.silhouettes(frame, ["x", "y"], ["one"]).first().silhouette is None


def test_kmeans_finds_the_blobs_and_numbers_them_by_spend(spark, blobs):
    points = scaling.assemble(spark.createDataFrame(blobs), ["x", "y"])
    sweep = segments.kmeans_sweep(points, ["x", "y"], "KMeans", ks=[2, 3, 4], starts=3)
    assert segments.best_k(sweep).first().Clusters == 3
    labelled = segments.segment_customers(points, ["x", "y"], (3,), starts=3).toPandas()
    assert labelled.groupby("cluster_3").Monetary.nunique().eq(1).all()
    assert labelled.groupby("cluster_3").Monetary.first().tolist() == [300.0, 200.0, 100.0]


def _lloyd(points, seeds):
    centres = np.array(seeds, float)
    for _ in range(300):
        label = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        moved = np.array([points[label == j].mean(0) if (label == j).any() else c for j, c in enumerate(centres)])
        shift, centres = ((moved - centres) ** 2).sum(), moved
        if shift <= kmeans.TOLERANCE * kmeans.SCALE**2:
            break
    size = [(label == j).sum() for j in range(len(centres))]
    gain = sum((points[label == j].sum(0) ** 2).sum() / n for j, n in enumerate(size) if n)
    return centres, gain


def test_joint_models_equal_plain_rounds(spark):
    rng = np.random.default_rng(8)
    xy = np.round(rng.normal(size=(400, 2)), 6)
    frame = spark.createDataFrame(
        pd.DataFrame({"CustomerID": [str(i) for i in range(400)], "x": xy[:, 0], "y": xy[:, 1]})
    ).repartition(5)
    models = kmeans.fit_models(frame, ["x", "y"], [2, 5], starts=4)
    points = np.round(xy * kmeans.SCALE)
    order = sorted(range(400), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    for k in (2, 5):
        runs = [_lloyd(points, points[[order[s + 4 * j] for j in range(k)]]) for s in range(4)]
        best = max(runs, key=lambda run: run[1])[0]
        assert np.allclose(np.array(models[k]), best, rtol=0, atol=1e-3)
        got = kmeans.labelled(frame, ["x", "y"], {k: models[k]}).orderBy(F.col("CustomerID").cast("int")).toPandas()
        want = ((points[:, None] - np.array(models[k])[None]) ** 2).sum(2).argmin(1)
        assert (got[f"cluster_{k}"].to_numpy() == want).all()


def test_joint_models_of_few_or_no_points(spark):
    rows = [("a", 1.0, 2.0), ("b", 1.0, 2.0), ("c", 3.0, 4.0)]
    frame = spark.createDataFrame(rows, "CustomerID string, x double, y double")
    got = segments.with_labels(frame, ["x", "y"], [2, 4], 2).orderBy("CustomerID").collect()
    assert got[0].cluster_2 == got[1].cluster_2 != got[2].cluster_2
    assert segments.with_labels(frame.limit(0), ["x", "y"], [2], 2).count() == 0


def test_best_k_breaks_rounded_ties_by_the_smaller_k(spark):
    rows = [("m", 3, round(0.43211, 4), 1.0), ("m", 2, round(0.43214, 4), 1.0), ("m", 4, 0.1, 1.0)]
    frame = spark.createDataFrame(
        rows, "Method string, Clusters int, SilhouetteScore double, DaviesBouldinIndex double"
    )
    assert segments.best_k(frame).first().Clusters == 2


def test_summary_percentages_cover_everyone(spark, blobs):
    summary = segments.cluster_summary(spark.createDataFrame(blobs), "truth", ["Monetary"]).toPandas()
    assert summary.Percentage.sum() == pytest.approx(100, abs=0.05)
    assert summary.CustomerCount.sum() == len(blobs)


def _grid_clusters(points, eps, min_points, min_share):
    """Brute-force twin of the grid density clusters: sets of point indices."""
    cells = {}
    for i, p in enumerate(np.floor(points / eps).astype(int)):
        cells.setdefault(tuple(p), []).append(i)
    moves = list(itertools.product((-1, 0, 1), repeat=points.shape[1]))
    near = {c: [n for m in moves if (n := tuple(np.add(c, m).tolist())) in cells] for c in cells}
    core = {c for c in cells if sum(len(cells[n]) for n in near[c]) >= min_points}
    groups, seen = [], set()
    for start in core:
        if start in seen:
            continue
        stack, group = [start], set()
        while stack:
            cell = stack.pop()
            if cell not in group:
                group.add(cell)
                stack += [n for n in near[cell] if n in core]
        seen |= group
        groups.append(group)
    members = [{i for c in g for i in cells[c]} for g in groups]
    for cell in set(cells) - core:
        touching = [k for k, g in enumerate(groups) if any(n in g for n in near[cell])]
        if len(touching) == 1:
            members[touching[0]] |= set(cells[cell])
        elif touching:
            return None
    return sorted(sorted(m) for m in members if len(m) >= min_share * len(points))


@pytest.mark.parametrize("eps", [0.4, 0.7])
def test_density_clusters_match_brute_force(spark, blobs, eps):
    frame = spark.createDataFrame(blobs)
    got = density.density_clusters(frame, ["x", "y"], eps).toPandas()
    expected = _grid_clusters(blobs[["x", "y"]].to_numpy(), eps, 5, 0.03)
    assert expected is not None
    found = got[got.cluster >= 0].groupby("cluster").CustomerID.apply(lambda s: sorted(map(int, s)))
    assert sorted(found.tolist()) == expected
    sizes = got[got.cluster >= 0].cluster.value_counts().sort_index().tolist()
    assert sizes == sorted(sizes, reverse=True)


def test_density_of_a_long_chain_is_one_cluster(spark):
    rows = [(str(i), i * 0.2, 0.0) for i in range(300)]
    frame = spark.createDataFrame(rows, "CustomerID string, x double, y double")
    got = density.density_clusters(frame, ["x", "y"], 0.5)
    assert [tuple(r) for r in got.groupBy("cluster").count().collect()] == [(0, 300)]


def test_density_silhouette_needs_two_clusters(spark, blobs):
    one = spark.createDataFrame(blobs).withColumn("cluster", F.lit(-1))
    assert density.density_silhouette(one, ["x", "y"]).first().silhouette is None


def test_projection_has_fixed_signs_and_falling_variance(spark, blobs):
    scaled = scaling.standardise(spark.createDataFrame(blobs), ["x", "y"])
    points = scaling.assemble(scaled, ["x_scaled", "y_scaled"])
    got = projection.pca_projection(points, ["CustomerID"]).toPandas()
    assert got.PC1.var() > got.PC2.var()
    assert abs(np.corrcoef(got.PC1, got.PC2)[0, 1]) < 1e-9


def _basket_rows():
    kinds = [(5, "abc"), (3, "ab"), (2, "c")]
    baskets_ = [items for count, items in kinds for _ in range(count)]
    return [(0, str(i), item) for i, items in enumerate(baskets_) for item in items]


@pytest.fixture(scope="module")
def itemsets(spark):
    items = spark.createDataFrame(_basket_rows(), "segment int, InvoiceNo string, item string")
    return baskets.frequent_itemsets(items, 0.02)


def test_supports(itemsets):
    got = {"".join(r["items"]): r.freq for r in itemsets.collect()}
    assert got == {"a": 8, "b": 8, "c": 7, "ab": 8, "abc": 5, "ac": 5, "bc": 5}


def test_rules_have_every_split_with_enough_lift(itemsets):
    rules = baskets.association_rules(itemsets).collect()
    got = {("".join(r.antecedents), "".join(r.consequents)): r for r in rules}
    assert got[("a", "b")].lift == pytest.approx(1.25)
    assert got[("a", "b")].conviction is None
    assert ("a", "bc") in got and ("c", "a") not in got
    assert got[("a", "bc")].confidence == pytest.approx(0.625)
    assert all(got[(c, a)].lift == r.lift for (a, c), r in got.items())


def test_mirrored_rules_keep_the_larger_antecedent(itemsets):
    kept = baskets.drop_mirrored(baskets.association_rules(itemsets)).collect()
    pairs = {("".join(r.antecedents), "".join(r.consequents)) for r in kept}
    assert ("a", "b") in pairs and ("b", "a") not in pairs
    assert ("bc", "a") in pairs and ("a", "bc") not in pairs


@pytest.mark.parametrize("group_rows", [16_384, 4, 0])
def test_item_sets_of_many_segments_against_all_subsets(spark, group_rows):
    rng = np.random.default_rng(11)
    rows, counts = [], Counter()
    for segment in range(12):
        total = int(rng.integers(8, 60))
        for basket in range(total):
            # Item 0 is in nearly every basket.
            items = sorted({f"i{rng.geometric(0.3)}" for _ in range(rng.integers(1, 7))} | ({"i0"} if basket % 9 else set()))
            rows += [(segment, f"{segment}-{basket}", item) for item in items]
            for size in range(1, len(items) + 1):
                counts.update((segment, total, part) for part in itertools.combinations(items, size))
    expected = {
        (segment, part, n, total) for (segment, total, part), n in counts.items() if total >= 10 and 20 * n >= total
    }
    items = spark.createDataFrame(rows, "segment int, InvoiceNo string, item string").repartition(4)
    found = baskets.frequent_itemsets(items, 0.05, 10, group_rows).collect()
    assert len(found) == len(expected)
    assert {(r.segment, tuple(r["items"]), r.freq, r.baskets) for r in found} == expected


def test_few_baskets_are_skipped(spark):
    rows = [r for r in _basket_rows() if int(r[1]) < 9]
    items = spark.createDataFrame(rows, "segment int, InvoiceNo string, item string")
    assert baskets.frequent_itemsets(items).count() == 0


def test_support_bound_is_exact(spark):
    # 0.02 * 350 is above 7 in binary; seven of 350 baskets must still count.
    rows = [(0, str(i), "x") for i in range(7)] + [(0, str(i), "y") for i in range(350)]
    items = spark.createDataFrame(rows, "segment int, InvoiceNo string, item string")
    got = {tuple(r["items"]): r.freq for r in baskets.frequent_itemsets(items).collect()}
    assert got == {("x",): 7, ("y",): 350, ("x", "y"): 7}


def test_density_chain_longer_than_any_round_limit(spark):
    rows = [(str(i), float(i // 5), 0.0) for i in range(5 * 260)] + [("far", 1e6, -1e6)]
    frame = spark.createDataFrame(rows, "CustomerID string, x double, y double")
    labels = {r.CustomerID: r.cluster for r in density.density_clusters(frame, ["x", "y"], 1.0).collect()}
    assert {labels[str(i)] for i in range(5 * 260)} == {0} and labels["far"] == density.NOISE


def test_metrics_of_a_zero_actual_with_a_large_error(spark):
    from ledgerloom.operators.regression import regression_metrics

    frame = spark.createDataFrame([(0.0, 5e8), (1.0, 2.0)], "actual double, predicted double")
    assert regression_metrics(frame).first().MAPE > 1e24


def test_forecast_runs_where_workers_cannot_import_the_package(tmp_path):
    import subprocess
    import sys
    import textwrap
    from pathlib import Path

    script = tmp_path / "job.py"
    script.write_text(
        textwrap.dedent(
            f"""
            import sys
            sys.path.insert(0, {str(Path(__file__).parent.parent)!r})
            from datetime import date, timedelta
            from ledgerloom.operators.forecast import arima_forecast
            from ledgerloom.session import build_session
            sys.path.pop(0)
            spark = build_session("foreign", "local[2]", **{{"spark.ui.enabled": "false"}})
            rows = [("a", date(2020, 1, 1) + timedelta(days=i), float(i % 7 + i)) for i in range(60)]
            train = spark.createDataFrame(rows, "series string, Date date, Sales double")
            print("ROWS", arima_forecast(train).count())
            """
        )
    )
    run = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS 7" in run.stdout, run.stderr[-2000:]


def test_products_of_matrices_give_the_first_nearest_centre():
    rng = np.random.default_rng(3)
    points = np.rint(rng.normal(size=(500, 3)) * kmeans.SCALE)
    models = [points[rng.choice(500, k, replace=False)] for k in (2, 5, 8)]
    models.append(np.vstack([points[0], points[0], points[1]]))  # equal centres
    models.append(np.array([[-1.0, 0, 0], [1.0, 0, 0]]) * kmeans.SCALE)  # ties at x = 0
    points[:50, 0] = 0
    want = []
    for centres in models:
        label = kmeans.nearest(points, centres)
        want += [[*points[label == j].sum(axis=0), (label == j).sum()] for j in range(len(centres))]
    assert (kmeans.Stretch(models).sums(points) == np.array(want)).all()


def test_scores_of_text_labels_and_of_points_without_one(spark, blobs):
    frame = spark.createDataFrame(blobs).repartition(5)
    text = F.concat(F.lit("c"), F.col("truth").cast("string"))
    part = frame.withColumns({"text": text, "some": F.when(F.col("truth") > 0, F.col("truth"))})
    got = {row.label_column: row for row in scores.both_scores(part, ["x", "y"], ["truth", "text", "some"]).collect()}
    assert got["text"].silhouette == pytest.approx(got["truth"].silhouette, rel=1e-12)
    assert got["text"].davies_bouldin == pytest.approx(got["truth"].davies_bouldin, rel=1e-12)
    kept = part.filter("some IS NOT NULL")
    alone = scores.both_scores(kept, ["x", "y"], ["some"]).first()
    share = kept.count() / part.count()  # points without a label score 0 and lie in no cluster
    assert got["some"].silhouette == pytest.approx(alone.silhouette * share, rel=1e-9)
    assert got["some"].davies_bouldin == pytest.approx(alone.davies_bouldin, rel=1e-9)
