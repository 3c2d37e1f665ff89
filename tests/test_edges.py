"""Hand-made edge frames: nulls, single levels, constants, gaps, ties, one class, nothing at all."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import cleaning, crosstab, density, distribution, dynamics, evaluate, features, rates, split, timeseries


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_null_keys_leave_rate_tables(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1), ("b", 0)], "dim string, late_risk int")
    assert rows(rates.rate_by(df, "dim")) == [("a", 2, 0.5), ("b", 1, 0.0)]
    assert rows(rates.rate_by_every(df, ["dim"])) == [("dim", "a", 2, 0.5), ("dim", "b", 1, 0.0)]


def test_values_are_never_trimmed(spark):
    df = spark.createDataFrame([("US Center ", 1), ("US Center", 0)], "dim string, late_risk int")
    assert rates.rate_by(df, "dim").count() == 2


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(k, 1) for k in "ddccbbaaa"], "k string, late_risk int")
    assert [r["k"] for r in rates.rate_of_top(df, "k", 3).collect()] == ["a", "b", "c"]


def test_small_cells_are_left_out(spark):
    data = [("r", "c", 1, 1, 2.0)] * 10 + [("r", "d", 1, 1, 2.0)] * 9
    df = spark.createDataFrame(data, "order_region string, category_name string, late_risk int, days_scheduled int, sales double")
    assert [r["category_name"] for r in rates.cells(df).collect()] == ["c"]


def test_one_level_gives_no_dummies_and_null_is_all_zero(spark):
    one = spark.createDataFrame([(1, "x"), (2, "x")], "id int, cat string")
    assert features.one_hot(one, ["cat"]).columns == ["id"]
    null = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, cat string")
    assert sorted(rows(features.one_hot(null, ["cat"]))) == [(1, 0), (2, 1), (3, 0)]


def test_constant_column(spark):
    df = spark.createDataFrame([(0.1, 1.0, 0), (0.1, 2.0, 1), (0.1, 4.0, 1)], "a double, b double, late_risk int")
    corr = {(r["column_a"], r["column_b"]): r["corr"] for r in distribution.correlation_matrix(df, ["a", "b"]).collect()}
    assert corr[("a", "b")] is None and corr[("a", "a")] is None and corr[("b", "b")] == pytest.approx(1)
    assert [r["a"] for r in features.standardized(df, ["a", "b"]).collect()] == [0.0, 0.0, 0.0]
    assert density.kde(df, "a").count() == 0


def test_correlations_use_pairs_that_are_both_present(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(400, 3)) + 1e5, columns=list("abc"))
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[::5, "b"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    want = pdf.corr()
    for r in distribution.correlation_matrix(df, list("abc")).collect():
        assert r["corr"] == pytest.approx(want.loc[r["column_a"], r["column_b"]], abs=1e-9)


def gap_days(spark):
    days = [(1, 1, 5), (1, 2, 7), (1, 4, 1)] + [(1, d, d) for d in range(5, 15)] + [(3, 2, 9)]
    data = [(dt.datetime(2020, m, d, 3), float(s), s % 2, "SUSPECTED_FRAUD") for m, d, s in days]
    return spark.createDataFrame(data, "order_ts timestamp, sales double, late_risk int, order_status string")


def test_calendar_is_filled_for_rates_and_months_but_not_for_variance(spark):
    df = gap_days(spark)
    daily = timeseries.daily_rolling_rate(df).toPandas()
    assert len(daily) == 62
    series = pd.Series(daily["daily_rate"].to_numpy(), dtype=float)
    np.testing.assert_allclose(daily["rolling_rate"].astype(float), series.rolling(7).mean(), equal_nan=True)
    variance = timeseries.daily_rolling_variance(df).toPandas()
    assert len(variance) == 14
    want = variance["daily_total"].rolling(7).var()
    np.testing.assert_allclose(variance["rolling_variance"].astype(float), want, equal_nan=True)
    months = rows(timeseries.monthly_count(df, "SUSPECTED_FRAUD"))
    assert [m[1] for m in months] == [13, 0, 1] and months[1][0] == dt.date(2020, 2, 29)


def test_short_series_has_no_rolling_value(spark):
    data = [(dt.datetime(2020, 1, d), 1.0, 1) for d in range(1, 7)]
    df = spark.createDataFrame(data, "order_ts timestamp, sales double, late_risk int")
    assert timeseries.daily_rolling_rate(df).where("rolling_rate is not null").count() == 0
    assert timeseries.daily_rolling_variance(df).where("rolling_variance is not null").count() == 0


def scored(spark, data):
    rows = [(str(i), "m", y, float(p), float(c)) for i, (y, p, c) in enumerate(data)]
    return spark.createDataFrame(rows, "line_id string, model string, y int, p double, profit_ratio double")


def test_tied_scores(spark):
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 300), rng.integers(0, 11, 300) / 10
    s = scored(spark, zip(y.tolist(), p.tolist(), [0.1] * 300))
    wins = ((p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])).mean()
    auc = evaluate.roc_auc(s).first()["roc_auc"]
    assert auc == pytest.approx(wins)
    assert evaluate.roc_auc(s.withColumn("p", -F.col("p"))).first()["roc_auc"] == pytest.approx(1 - auc)
    bins = {r["bin"]: r["n"] for r in evaluate.calibration_curve(s).collect()}
    edges = np.linspace(0, 1, 11)
    want = pd.Series(np.searchsorted(edges[1:-1], p)).value_counts().to_dict()
    assert bins == want
    roc = evaluate.roc_curve(s).collect()
    assert (roc[0]["fpr"], roc[0]["tpr"], roc[0]["threshold"]) == (0, 0, None) and (roc[-1]["fpr"], roc[-1]["tpr"]) == (1, 1)
    pr = evaluate.pr_curve(s).collect()
    assert (pr[-1]["recall"], pr[-1]["precision"]) == (0, 1)


def test_one_class(spark):
    s = scored(spark, [(1, 0.2, 0.1), (1, 0.7, 0.1)])
    assert evaluate.roc_auc(s).first()["roc_auc"] is None
    assert evaluate.classification_metrics(s).first()["recall"] == 0.5
    none_flagged = scored(spark, [(1, 0.2, 0.1), (0, 0.3, 0.1)])
    assert evaluate.classification_metrics(none_flagged).first()["precision"] is None
    assert evaluate.confusion_matrix(none_flagged).count() == 4


def test_cost_curve_equals_a_loop_and_may_fall_with_misses(spark):
    rng = np.random.default_rng(5)
    grid = np.linspace(0.05, 0.95, 50)
    y, p = rng.integers(0, 2, 400), np.r_[rng.random(300), rng.choice(grid, 100)]
    c = rng.normal(size=400)
    curve = evaluate.cost_curve(scored(spark, zip(y.tolist(), p.tolist(), c.tolist()))).toPandas()
    want = [c[(y == 1) & (p < t)].sum() + 0.15 * ((y == 0) & (p >= t)).sum() for t in grid]
    np.testing.assert_allclose(curve["cost"], want, atol=1e-9)
    assert curve["threshold"].tolist() == grid.tolist()
    late = scored(spark, [(1, 0.01, -1.0), (1, 0.02, 0.25)])
    assert evaluate.cost_curve(late).toPandas()["cost"].tolist()[-1] == pytest.approx(-0.75)


def test_survival_by_hand_with_censoring(spark):
    data = [("m", 0, 1), ("m", 1, 1), ("m", 1, 0), ("m", 3, 1), ("m", 5, 0), ("m", 6, 1)]
    df = spark.createDataFrame(data, "shipping_mode string, days_real int, seen int")
    curve = dynamics.kaplan_meier(df, observed="seen").collect()
    want, s = [], 1.0
    for at_risk, d in ((6, 1), (5, 1), (3, 1), (2, 0), (1, 1)):
        s *= 1 - d / at_risk
        want.append(s)
    assert [r["survival"] for r in curve] == pytest.approx(want)
    assert dynamics.median_survival(dynamics.kaplan_meier(df)).first()["median_days"] == 1
    plain = [r["survival"] for r in dynamics.kaplan_meier(df).collect()]
    assert plain == sorted(plain, reverse=True) and plain[-1] == 0


def test_centrality_equals_eigenvector(spark):
    rng = np.random.default_rng(6)
    edges = [(f"m{i}", f"r{j}", float(rng.random())) for i in range(3) for j in range(5)] + [("m0", "m1", 0.3)]
    got = {r["node"]: r["centrality"] for r in dynamics.eigenvector_centrality(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    nodes = sorted(got)
    a = np.zeros((len(nodes), len(nodes)))
    for s, d, w in edges:
        a[nodes.index(s), nodes.index(d)] += w
        a[nodes.index(d), nodes.index(s)] += w
    vector = np.abs(np.linalg.eigh(a)[1][:, -1])
    np.testing.assert_allclose([got[n] for n in nodes], vector, atol=1e-8)


def test_split_is_exact_per_class_and_independent_of_leaf_size(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("line_id"), (F.col("id") % 3 == 0).cast("int").alias("late_risk"))
    out = split.stratified_split(df)
    counts = {(r["late_risk"], r["split"]): r["count"] for r in out.groupBy("late_risk", "split").count().collect()}
    assert counts == {(1, "test"): 333, (1, "train"): 1334, (0, "test"): 667, (0, "train"): 2666}
    ranks = lambda n: [0, 1, n // 2, n]
    deep = split.hash_cuts(df, "line_id", ranks, "late_risk", leaf_rows=10)
    assert deep == split.hash_cuts(df, "line_id", ranks, "late_risk")
    folds = split.stratified_folds(df, 5).groupBy("late_risk", "fold").count().toPandas()
    assert folds.groupby("late_risk")["count"].agg(lambda c: c.max() - c.min()).max() <= 1
    assert split.stratified_subsample(df, 1000).count() == 1000
    assert split.stratified_subsample(df, 10_000).count() == 5000
    assert distribution.sample_rows(df, 77).count() == 77
    assert distribution.sample_rows(df, 77).exceptAll(distribution.sample_rows(df.repartition(7), 77)).count() == 0


def test_pareto_reaches_one_and_lists_every_rank(spark):
    values = [0.5] * 4 + [0.25, 0.1, -0.2, -0.2, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "profit_ratio double")
    got = timeseries.cumulative_share(df).orderBy("position").toPandas()
    want = np.cumsum(sorted(values, reverse=True)) / sum(v for v in values if v > 0)
    np.testing.assert_allclose(got["share"], want)
    assert got["share"].max() == pytest.approx(1) and got["rows_share"].iloc[[0, -1]].tolist() == [0, 1]


def test_histogram_bins_equal_numpy(spark):
    x = np.random.default_rng(7).normal(size=500)
    got = distribution.histogram(spark.createDataFrame(pd.DataFrame({"x": x})), "x", 20).toPandas()
    counts, edges = np.histogram(x, bins=20)
    assert got["n"].tolist() == counts.tolist()
    np.testing.assert_allclose(got["bin_low"], edges[:-1])
    closed = spark.createDataFrame([(7,), (0,), (8,)], "x int")
    assert distribution.histogram(closed, "x", 7, 0, 7).toPandas()["n"].tolist() == [1, 0, 0, 0, 0, 0, 1]


def test_box_stats_with_outliers(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    got = distribution.box_stats(spark.createDataFrame([(0, v) for v in x], "g int, x double"), "x", ["g"]).first()
    assert (got["q1"], got["median"], got["q3"]) == pytest.approx((2.25, 3.5, 4.75))
    assert (got["whisker_low"], got["whisker_high"], got["outliers"]) == (1, 5, 1)


def test_density_integrates_to_one_and_equals_the_formula(spark):
    x = np.random.default_rng(8).normal(size=300).round(1)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    for discrete in (False, True):
        got = density.kde(df, "x", grid=200, cut=4, discrete=discrete).toPandas()
        h = x.std(ddof=1) * len(x) ** -0.2
        want = np.exp(-0.5 * ((got["x"].to_numpy()[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
        np.testing.assert_allclose(got["density"], want, rtol=1e-9)
        assert np.trapezoid(got["density"], got["x"]) == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("spacing", [0.5, 0.1, 0.02])
def test_binned_density_stays_within_its_bound(spark, spacing):
    rng = np.random.default_rng(19)
    pdf = pd.DataFrame({"x": np.r_[rng.normal(size=400), rng.exponential(size=300) * 3, [40.0]], "g": ["a", "b", "b"] * 233 + ["c", "c"]})
    df = spark.createDataFrame(pdf)
    exact = density.kde(df, "x", ["g"], grid=80).toPandas()
    got = density.kde(df, "x", ["g"], grid=80, spacing=spacing).toPandas()
    assert got[["g", "grid_index"]].equals(exact[["g", "grid_index"]])
    np.testing.assert_allclose(got["x"], exact["x"])
    for g, part in pdf.groupby("g"):
        h = part["x"].std() * len(part) ** -0.2
        off = (got[got.g == g]["density"] - exact[exact.g == g]["density"]).abs().max()
        assert off <= spacing**2 / 8 / (h * np.sqrt(2 * np.pi)) + 1e-12
    assert density.kde(df.limit(0), "x", ["g"], spacing=spacing).count() == 0
    assert density.violin(df, "x", "g", spacing=spacing).count() == 300


def test_density_in_two_dimensions_sums_to_one_over_keys(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"x": rng.normal(size=400), "y": rng.normal(size=400), "g": rng.integers(0, 2, 400)})
    got = density.kde_2d(spark.createDataFrame(pdf), "x", "y", "g", grid=40, cut=4).toPandas()
    dx = np.diff(np.sort(got["x"].unique()))[0]
    dy = np.diff(np.sort(got["y"].unique()))[0]
    assert got["density"].sum() * dx * dy == pytest.approx(1, abs=0.01)


def test_shares_of_a_row_sum_to_one(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "r string, c int")
    got = crosstab.row_shares(df, "r", "c").toPandas()
    assert len(got) == 4 and got.groupby("r")["share"].sum().tolist() == [1, 1] and got["n"].min() == 0


def test_leakage_audit_counts_missing_days_as_not_longer(spark):
    df = spark.createDataFrame([(3, 2, 1), (3, 2, 0), (1, 2, 0), (None, 2, 0)], "days_real int, days_scheduled int, late_risk int")
    assert rows(cleaning.leakage_audit(df)) == [(4, 0.75)]


def test_bootstrap_interval_covers_the_rate_and_replays(spark):
    df = spark.range(4000).select((F.col("id") % 2).cast("string").alias("m"), (F.col("id") % 5 == 0).cast("int").alias("late_risk"))
    first = rates.bootstrap_rates(df, "m").collect()
    assert first == rates.bootstrap_rates(df.repartition(5), "m").collect()
    for r in first:
        half = 1.96 * math.sqrt(r["rate"] * (1 - r["rate"]) / r["n"])
        assert r["ci_low"] == pytest.approx(r["rate"] - half, abs=0.005)
        assert r["ci_high"] == pytest.approx(r["rate"] + half, abs=0.005)
    general = rates.bootstrap_means(df.withColumn("line_id", F.monotonically_increasing_id()), "m", "late_risk", draws=300)
    for a, b in zip(first, general.collect()):
        assert b["mean"] == pytest.approx(a["rate"]) and b["ci_low"] == pytest.approx(a["ci_low"], abs=0.01)


@pytest.mark.parametrize("n,leaf", [(4_000, 100_000), (40_000, 50)])
def test_many_classes_split_at_any_number_of_rows(spark, n, leaf):
    df = spark.range(n).select(F.col("id").cast("string").alias("line_id"), (F.col("id") % 200).cast("int").alias("late_risk"))
    cuts = split.hash_cuts(df, "line_id", lambda size: [split.half_up(0.2 * size)], "late_risk", leaf_rows=leaf)
    assert len(cuts) == 200
    parts = split.stratified_split(df).groupBy("late_risk", "split").count().toPandas()
    assert set(parts[parts["split"] == "test"]["count"]) == {n // 1000} and len(parts) == 400
    with pytest.raises(ValueError):
        split.hash_cuts(df, "line_id", lambda size: [1], "late_risk", max_strata=100)


def test_centrality_that_has_not_settled_is_an_error(spark):
    path = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in range(60)], "src string, dst string, weight double")
    with pytest.raises(RuntimeError):
        dynamics.eigenvector_centrality(path, max_rounds=20)


def test_running_totals_cut_each_key_by_its_own_values(spark):
    from parcelwise.operators.prefix import running_totals

    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": ["wide"] * 3000 + ["narrow"] * 300, "v": np.r_[rng.permutation(3000) * 1e3, rng.permutation(300) / 1e6], "w": 1})
    df = spark.createDataFrame(pdf)
    out = running_totals(df, "v", ["w"], by=["k"], buckets=10)
    # the window's partitions are the buckets
    plan = out._jdf.queryExecution().toString()
    assert "_bucket" in plan
    want = pdf.sort_values("v").assign(upto=lambda d: d.groupby("k")["w"].cumsum()).set_index(["k", "v"])["upto"]
    got = out.toPandas().set_index(["k", "v"])["upto_w"]
    assert (got.sort_index() == want.sort_index()).all()


def test_bootstrap_of_a_mean(spark):
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(10, 3, 400), rng.normal(-2, 1, 50)]
    rows = [(str(i), "a" if i < 400 else "b", float(v)) for i, v in enumerate(x)] + [("n", None, 1.0), ("m", "a", None)]
    df = spark.createDataFrame(rows, "line_id string, k string, v double")
    got = rates.bootstrap_means(df, "k", "v").toPandas().set_index("k")
    for k, part in (("a", x[:400]), ("b", x[400:])):
        half = 1.96 * part.std() / np.sqrt(len(part))
        row = got.loc[k]
        assert row["n"] == len(part) and row["mean"] == pytest.approx(part.mean())
        assert row["ci_low"] == pytest.approx(part.mean() - half, abs=0.25 * half) and row["ci_high"] == pytest.approx(part.mean() + half, abs=0.25 * half)
    again = rates.bootstrap_means(df, "k", "v").toPandas().set_index("k")
    assert (got == again).all().all()


def test_density_of_two_columns_equals_a_loop(spark):
    rng = np.random.default_rng(8)
    xy = rng.normal(size=(60, 2)) @ np.array([[1.0, 0.6], [0.0, 0.5]])
    df = spark.createDataFrame([(float(a), float(b), "k") for a, b in xy], "x double, y double, g string")
    got = density.kde_2d(df, "x", "y", "g", grid=9).toPandas()
    cov = np.cov(xy.T) * 60 ** (-1 / 3)
    inv, norm = np.linalg.inv(cov), 2 * np.pi * np.sqrt(np.linalg.det(cov)) * 60
    for r in got.itertuples():
        d = xy - [r.x, r.y]
        assert r.density == pytest.approx(np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, inv, d)).sum() / norm, rel=1e-9, abs=1e-12)


NO_ROWS = (
    "risk_by_region", "risk_by_all_dims", "class_balance", "region_category_cells", "describe_by_class", "correlation_matrix",
    "risk_mode_x_region", "transition_matrix", "status_composition", "hist_sales", "box_profit_ratio", "violin_sales", "kde_log_sales",
    "bootstrap_rate_ci", "bootstrap_sales_ci", "daily_risk_rolling", "bullwhip_variance", "fraud_monthly", "pareto_profit",
    "sample_scatter", "interactions", "pca_scree", "pca_projection", "stratified_split", "stratified_folds", "cell_rate_scores",
    "roc_curve", "roc_auc", "pr_curve", "cost_curve", "calibration_curve", "confusion_matrix", "lr_coefficients", "dt_importance",
    "model_results", "models_roc_curve", "lr_residual_kde", "cv_results", "permutation_importance", "learning_curve",
    "partial_dependence", "kmeans_summary", "kmeans_elbow", "kmeans_scatter", "silhouette_values", "entropy_by_region", "risk_edges",
    "eigenvector_centrality", "kaplan_meier", "survival_median",
)


@pytest.mark.parametrize("name", NO_ROWS)
def test_an_empty_table_gives_an_empty_or_null_result(spark, name):
    from parcelwise.plans.catalogue import ANALYSES
    from parcelwise.sources.star import order_lines

    analysis = ANALYSES[name]
    lines = order_lines(spark, "/root/testdata/sf0.001", analysis.uses).limit(0)
    found = analysis.run(lines).toPandas()
    assert len(found) == 0 or found.select_dtypes("number").fillna(0).to_numpy().sum() == 0


def test_bootstrap_weights_replay_the_hash_of_key_and_draw(spark):
    """Means of every draw from rows that are repeated draw by draw, and keys of several types."""
    rng = np.random.default_rng(20)
    rows = [(f"k{i}", int(i), ["a", "b", None][i % 3], float(v) if i % 7 else None) for i, v in enumerate(rng.normal(size=200) + 5)]
    df = spark.createDataFrame(rows, "name string, number long, g string, v double").withColumn("_x", F.lit("clash"))
    for key in ("name", "number"):
        hashed = rates.hashed_onwards(
            np.array([r["h"] for r in df.select(F.xxhash64(F.lit(42), key).alias("h")).collect()])[:, None], np.arange(9)[None]
        )
        want = df.select(*[F.xxhash64(F.lit(42), key, F.lit(d)) for d in range(9)]).collect()
        assert hashed.tolist() == [list(r) for r in want]
        draws = df.where("g is not null and v is not null").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(59))))
        u = F.xxhash64(F.lit(42), key, "draw") / F.lit(2.0**64) + 0.5
        steps = np.cumsum([math.exp(-1) / math.factorial(w) for w in range(18)])
        weight = sum((F.when(u >= float(s), 1).otherwise(0) for s in steps), F.lit(0))
        means = draws.groupBy("g", "draw").agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias("m")).toPandas()
        got = rates.bootstrap_means(df, "g", "v", key, draws=60).toPandas().set_index("g")
        for g, part in means.groupby("g"):
            np.testing.assert_allclose(got.loc[g, ["ci_low", "ci_high"]].astype(float), np.quantile(part["m"], [0.025, 0.975]))
    assert rates.bootstrap_means(df.limit(0), "g", "v", "name").count() == 0


def test_fifty_thousand_strata_split_exactly(spark):
    """Strata beyond the limit of an expression's branches, one of them large, against sorted hashes."""
    import hashlib

    strata = [*range(50_000)] * 2 + [7] * 3000 + [None] * 5
    pdf = pd.DataFrame({"s": pd.array(strata, "Int64"), "line_id": [f"r{i}" for i in range(len(strata))], "_s": "clash"})
    df = spark.createDataFrame([(None if pd.isna(a) else int(a), b, c) for a, b, c in pdf.itertuples(index=False)], "s long, line_id string, _s string")
    got = split.stratified_split(df.drop("_s").withColumn("_p", F.lit("clash")), "s", test_share=0.4).select("line_id", "split").toPandas()
    pdf = pdf.dropna(subset=["s"])
    pdf["h"] = [hashlib.md5(f"42|{k}".encode()).hexdigest() for k in pdf["line_id"]]
    pdf = pdf.sort_values(["s", "h", "line_id"])
    place, size = pdf.groupby("s").cumcount(), pdf.groupby("s")["h"].transform("size")
    want = dict(zip(pdf["line_id"], np.where(place < np.floor(size * 0.4 + 0.5), "test", "train")))
    assert dict(zip(got["line_id"], got["split"])) == want


@pytest.mark.parametrize("leaf", [100_000, 40])
def test_cut_tables_equal_branches(spark, monkeypatch, leaf):
    rng = np.random.default_rng(23)
    rows = [(int(s), f"k{i}") for i, s in enumerate(np.minimum(rng.geometric(0.3, 4000), 9))] + [(20, "only"), (None, "x")]
    df = spark.createDataFrame(rows, "s int, line_id string")
    ranks = lambda n, floor: [floor(n * 0.0 + 0.5), floor(n * 0.31 + 0.5), floor(n * 0.9 + 0.5)]
    branches = split.with_part(df, "part", ranks, "s", "line_id", 5)
    real = split.cut_table
    monkeypatch.setattr(split, "cut_table", lambda *a: real(*a, leaf_rows=leaf))
    table = split.with_part(df, "part", ranks, "s", "line_id", 5, max_strata=3)
    columns = ["s", "line_id", "part"]
    assert sorted(map(tuple, table.select(columns).collect())) == sorted(map(tuple, branches.select(columns).collect()))
    for parts in (split.stratified_folds(df, 4, "s"), split.stratified_prefixes(df, (0.2, 0.7, 1.0), "s")):
        assert parts.count() == len(rows) - 1
