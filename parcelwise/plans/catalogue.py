"""Every analysis by name, over order lines with the working column names.

Each one is a function of the order lines alone and names the columns it reads, so that a source can leave out what is
not asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.columns import numeric_columns
from parcelwise.functions.small import checkpointed, sweep
from parcelwise.operators import (
    cleaning,
    clusters,
    crosstab,
    density,
    diagnostics,
    distribution,
    dynamics,
    evaluate,
    exact_tree,
    features,
    many_fits,
    models,
    rates,
    relu_net,
    split,
    timeseries,
)

L = "late_risk"
# fixed values: the columns whose levels make the rate tables
DIMENSIONS = (
    "shipping_mode", "order_region", "market", "customer_segment", "department_name", "category_name", "order_status",
    "days_scheduled", "payment_type",
)
MEASURES = ("days_scheduled", "sales", "quantity", "discount_rate", "product_price", "benefit", "profit_ratio")
CATEGORIES = tuple(c for c in models.CATEGORIES if c != "customer_country")
SCORED = ("line_id", L, "shipping_mode", "order_status", "profit_ratio")
MODEL_USES = ("line_id", L, *MEASURES, *CATEGORIES, "order_ts")
CELL_USES = ("order_region", "category_name", L, "days_scheduled", "sales")
CELL_KEYS = ("order_region", "category_name")
MONTHS = ("order_month",)


@dataclass(frozen=True)
class Analysis:
    """``run`` maps order lines to a result; ``uses`` are the columns it reads, ``digits`` the places that are exact."""

    run: Callable[[DataFrame], DataFrame]
    uses: Sequence[str] | None
    digits: int | dict[str, int] = 6
    source: str = "lines"


def of_rows(schema: str):
    """A fit of no rows has no result: the decorated analysis of an empty table is an empty table."""

    def decorate(run: Callable) -> Callable:
        @wraps(run)
        def guarded(df: DataFrame, *args) -> DataFrame:
            # distinct rows of no column need none of the left joins, which taking a row would carry out
            some = df.select(F.lit(1).alias("some")).distinct().take(1)
            return run(df, *args) if some else df.sparkSession.createDataFrame([], schema)

        return guarded

    return decorate


def _dated(df: DataFrame) -> DataFrame:
    return cleaning.with_date_parts(df)


def _clean_numeric(df: DataFrame) -> tuple[DataFrame, list[str]]:
    table = cleaning.clean(df)
    return table, numeric_columns(table)


def model_numeric(df: DataFrame) -> list[str]:
    """Numeric feature columns: what cleaning and dropping high-cardinality columns leave, without the label."""
    table = cleaning.model_columns(cleaning.clean(df))
    return [c for c in numeric_columns(table) if c != L]


def _model_lines(df: DataFrame) -> DataFrame:
    return cleaning.with_date_parts(df).drop("order_day", "order_quarter")


def preparing(df: DataFrame, carry: Sequence[str] = (), interactions: Sequence[str] = models.INTERACTIONS):
    """Context manager with the split, encoded and scaled rows of the order lines."""
    return models.prepared(
        _model_lines(df), model_numeric(df), models.CATEGORIES, interactions, L, "line_id", carry
    )


def _scores(df: DataFrame) -> DataFrame:
    return evaluate.cell_rate_scores(df)


# scored tables of this application's order lines, so that every curve of the fitted models reads one and the same
_scored: dict[tuple, DataFrame] = {}


@of_rows("line_id string, model string, y int, p double, profit_ratio double")
def _fitted_scores(df: DataFrame, *names: str) -> DataFrame:
    """The test rows as the named models score them, all four by default; fitted once for the same order lines."""
    known = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), names)
    if known not in _scored:
        with preparing(df, ["profit_ratio"]) as data:
            # written while the vectors are cached: nothing is scored or rebuilt after the block
            _scored[known] = checkpointed(evaluate_all(data, names))
    return _scored[known]


def forget_scores() -> None:
    """Fit anew from here on; needed once the scratch tables are gone."""
    _scored.clear()


def evaluate_all(data: models.Prepared, names: Sequence[str] = ()) -> DataFrame:
    """``(line_id, profit_ratio, model, y, p)`` of the named models, all four by default."""
    chosen = {"models": tuple(names)} if names else {}
    scores = models.evaluate_models(data, carry=["profit_ratio"], **chosen)
    return scores.select("line_id", "model", "y", "p", "profit_ratio")


def _clean_projection(df: DataFrame) -> DataFrame:
    return cleaning.clean(df)


def _describe(df: DataFrame) -> DataFrame:
    table, numeric = _clean_numeric(df)
    return distribution.describe_by(table, [c for c in numeric if c != L], L)


def _correlations(df: DataFrame) -> DataFrame:
    table, numeric = _clean_numeric(df)
    return distribution.correlation_matrix(table, numeric)


def _by_month(df: DataFrame) -> DataFrame:
    return rates.rate_by(_dated(df), "order_month")


def _weekdays(df: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])
    table = rates.rate_by(_dated(df), "order_weekday")
    return table.withColumn("label", names[F.col("order_weekday")])


def _status_composition(df: DataFrame) -> DataFrame:
    classes = df.withColumn("class", F.when(F.col(L) == 0, "On-time").when(F.col(L) == 1, "Late-risk"))
    return crosstab.row_shares(classes, "class", "order_status")


def _log_sales(df: DataFrame) -> DataFrame:
    return df.select(F.log1p("sales").alias("log_sales"))


def _one_hot(df: DataFrame) -> DataFrame:
    present = [c for c in models.CATEGORIES if c in df.columns]
    return features.one_hot(df.select("line_id", *present), present)


def _interactions(df: DataFrame) -> DataFrame:
    products = features.interaction_columns(models.INTERACTIONS)
    return df.select("line_id", *[e.alias(name) for name, e in products.items()])


def _standardized(df: DataFrame) -> DataFrame:
    return features.standardized(_model_lines(df), model_numeric(df), keep=["line_id"])


@of_rows("component int, explained double, cumulative double")
def _scree(df: DataFrame) -> DataFrame:
    return features.principal_components(_model_lines(df), model_numeric(df))[1]


@of_rows("line_id string, late_risk int, pc1 double, pc2 double")
def _pca_projection(df: DataFrame) -> DataFrame:
    lines, numeric = _model_lines(df), model_numeric(df)
    model, _ = features.principal_components(lines, numeric)
    return features.project(lines, model, numeric, ["line_id", L])


def _logistic(df: DataFrame):
    with preparing(df) as data:
        model = models.fit("Logistic Regression", models.logistic_regression(data.n_train), data.train)
        return data, model


@of_rows("feature string, coefficient double")
def _lr_coefficients(df: DataFrame) -> DataFrame:
    data, model = _logistic(df)
    return models.coefficient_table(df.sparkSession, data.design.names, model)


def _tree(df: DataFrame):
    with preparing(df) as data:
        return data, models.fit("Decision Tree", models.decision_tree(), data.train)


@of_rows("feature string, importance double")
def _dt_importance(df: DataFrame) -> DataFrame:
    data, model = _tree(df)
    return models.importance_table(df.sparkSession, data.design.names, model)


def _exact_tree(df: DataFrame):
    with preparing(df) as data:
        blocks = many_fits.feature_blocks(data.train, [], "raw")
    return data, exact_tree.exact_tree(blocks)


@of_rows(exact_tree.NODES)
def _dt_exact_nodes(df: DataFrame) -> DataFrame:
    data, tree = _exact_tree(df)
    return tree.table(df.sparkSession, data.design.names)


@of_rows("feature string, importance double")
def _dt_exact_importance(df: DataFrame) -> DataFrame:
    data, tree = _exact_tree(df)
    shares = tree.importances(len(data.design.names)).tolist()
    rows = sorted(zip(data.design.names, shares), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


@of_rows("iteration int, loss double")
def _mlp_loss(df: DataFrame) -> DataFrame:
    with preparing(df) as data:
        found = models.fitted_net(data.train, len(data.design.names))
    return models.loss_curve(df.sparkSession, found)


@of_rows("model string, metric string, mean double, std double")
def _cross_validation(df: DataFrame) -> DataFrame:
    lines = _model_lines(df)
    present = [c for c in models.CATEGORIES if c in lines.columns]
    numeric = model_numeric(df)
    # levels, the subsample and its folds all read these columns: join and derive them once
    lines = checkpointed(lines.select(*dict.fromkeys(["line_id", L, *numeric, *present, *models.INTERACTIONS])))
    sweep(df.sparkSession)
    levels = features.category_levels(lines, present)
    design = features.Design(numeric, levels, models.INTERACTIONS)
    return diagnostics.cross_validate(lines, design)


def _relu_net(data: models.Prepared):
    """Early stopping judges by a tenth of the training part."""
    held = split.prefix_step(data.train, (0.1,), data.label, data.key)
    blocks = many_fits.feature_blocks(data.train.withColumn("held", held), ["held"])
    return relu_net.fit_net(blocks, lambda marks: marks == 0)


@of_rows(relu_net.CURVE)
def _net_loss(df: DataFrame) -> DataFrame:
    with preparing(df) as data:
        _, curve = _relu_net(data)
    return relu_net.loss_curve(df.sparkSession, curve)


@of_rows("line_id string, model string, y int, p double")
def _net_scores(df: DataFrame) -> DataFrame:
    with preparing(df) as data:
        net, _ = _relu_net(data)
        return checkpointed(relu_net.net_scores(data.test, net, "Rectified Net", ["line_id"]))


@of_rows("feature string, repeat int, decrease double")
def _permutation_repeats(df: DataFrame) -> DataFrame:
    with preparing(df) as data:
        model = models.fit("Logistic Regression", models.logistic_regression(data.n_train), data.train)
        weights = [float(w) for w in model.coefficients]
        return checkpointed(diagnostics.permutation_repeats(data.test, data.design.names, weights, model.intercept))


@of_rows(
    "size_index int, share double, train_size double, "
    "train_f1_mean double, train_f1_std double, validation_f1_mean double, validation_f1_std double"
)
def _learning_curve(df: DataFrame) -> DataFrame:
    with preparing(df) as data:
        return checkpointed(diagnostics.learning_curve(data))


@of_rows("feature string, grid_index int, x double, mean_p double")
def _partial_dependence(df: DataFrame) -> DataFrame:
    with preparing(df) as data:
        model = models.fit("Decision Tree", models.decision_tree(), data.train)
        curves = diagnostics.partial_dependence(
            data.train, model, data.design.names, ("days_scheduled", "sales", "discount_rate")
        )
        return checkpointed(curves)


@of_rows(
    "order_region string, category_name string, late_risk_rate double, avg_scheduled_days double, avg_sales double, "
    "order_volume long, cluster int"
)
def _kmeans(df: DataFrame) -> DataFrame:
    return clusters.kmeans_assignment(rates.cells(df), CELL_KEYS)


@of_rows("k int, cost double")
def _elbow(df: DataFrame) -> DataFrame:
    return clusters.elbow(checkpointed(rates.cells(df)), CELL_KEYS)


@of_rows("order_region string, category_name string, cluster int, a double, b double, silhouette double")
def _silhouette(df: DataFrame) -> DataFrame:
    cells = checkpointed(rates.cells(df))
    assigned = clusters.kmeans_assignment(cells, CELL_KEYS).select(*CELL_KEYS, "cluster")
    points = clusters.cell_features(cells, CELL_KEYS).join(assigned, list(CELL_KEYS))
    return clusters.silhouette(points, clusters.MEASURES, CELL_KEYS)


def _silhouette_by_rule(df: DataFrame) -> DataFrame:
    """Silhouette of a fixed grouping of the cells, cells later than the mean cell against the others, instead of
    fitted clusters."""
    cells = checkpointed(rates.cells(df))
    middle = cells.agg(F.avg("late_risk_rate")).scalar()
    rule = cells.select(*CELL_KEYS, F.when(F.col("late_risk_rate") >= middle, 1).otherwise(0).alias("cluster"))
    points = clusters.cell_features(cells, CELL_KEYS).join(rule, list(CELL_KEYS))
    return clusters.silhouette(points, clusters.MEASURES, CELL_KEYS)


MODES = ("Standard Class", "First Class")


def _survival(df: DataFrame) -> DataFrame:
    return dynamics.kaplan_meier(df, values=MODES)


def _rate(dim: str, order: str = "rate_desc") -> Analysis:
    return Analysis(lambda df: rates.rate_by(df, dim, order=order), (dim, L))


def _top(dim: str, k: int, ascending: bool = False) -> Analysis:
    return Analysis(lambda df: rates.rate_of_top(df, dim, k, ascending=ascending), (dim, L))


def _pair(a: str, b: str) -> Analysis:
    return Analysis(lambda df: crosstab.mean_by_pair(df, a, b), (a, b, L))


def _dated_pair(a: str, b: str) -> Analysis:
    return Analysis(lambda df: crosstab.mean_by_pair(_dated(df), a, b), ("order_ts", L))


def _on_scores(run: Callable[[DataFrame], DataFrame], digits=6) -> Analysis:
    return Analysis(lambda df: run(_scores(df)), SCORED, digits)


def _fitted(*names: str) -> Analysis:
    return Analysis(lambda df: _fitted_scores(df, *names), MODEL_USES)


def _on_fitted(run: Callable[[DataFrame], DataFrame], digits=6) -> Analysis:
    return Analysis(lambda df: run(_fitted_scores(df)), MODEL_USES, digits)


def _on_residuals(model: str, run: Callable[[DataFrame], DataFrame], digits=6) -> Analysis:
    """Of one model's residuals; no other model is fitted for them."""
    return Analysis(lambda df: run(evaluate.with_residual(_fitted_scores(df, model))), MODEL_USES, digits)


def _residual_density(scores: DataFrame) -> DataFrame:
    return density.kde(scores, "residual", ["model"], grid=200, cut=0, discrete=True, scale_bins=50)


KDE_DIGITS = {"density": 10, "x": 4, "q1": 4, "median": 4, "q3": 4}

ANALYSES: dict[str, Analysis] = {
    # cleaning
    "scan_order_lines": Analysis(lambda df: df, None),
    "leakage_audit": Analysis(cleaning.leakage_audit, ("days_real", "days_scheduled", L)),
    "clean_projection": Analysis(_clean_projection, None),
    "date_parts": Analysis(lambda df: _dated(df).drop("order_ts"), ("line_id", "order_ts")),
    # rates and volumes
    "overall_rate": Analysis(rates.overall_rate, (L,)),
    "class_balance": Analysis(lambda df: rates.volume_by(df, L), (L,)),
    "risk_by_shipping_mode": _rate("shipping_mode"),
    "bootstrap_rate_ci": Analysis(lambda df: rates.bootstrap_rates(df, "shipping_mode"), ("shipping_mode", L)),
    "bootstrap_sales_ci": Analysis(
        lambda df: rates.bootstrap_means(df, "shipping_mode", "sales"), ("line_id", "shipping_mode", "sales"), 4
    ),
    "risk_by_region": _rate("order_region"),
    "risk_by_region_published": Analysis(
        lambda df: rates.published_rate(rates.rate_by(df, "order_region", order="rate_desc")), ("order_region", L)
    ),
    "risk_by_market": _rate("market"),
    "risk_by_segment": _rate("customer_segment"),
    "risk_by_department": _rate("department_name"),
    "risk_by_top_categories": _top("category_name", 15),
    "status_volume": Analysis(lambda df: rates.volume_by(df, "order_status"), ("order_status",)),
    "risk_by_status": _rate("order_status"),
    "risk_by_scheduled_days": _rate("days_scheduled", "key"),
    "monthly_volume_risk": Analysis(_by_month, ("order_ts", L)),
    "weekday_risk": Analysis(_weekdays, ("order_ts", L)),
    "hourly_volume_risk": Analysis(
        lambda df: rates.rate_by(_dated(df), "order_hour"), ("order_ts", L), source="events"
    ),
    "risk_by_top_countries": _top("order_country", 10),
    "risk_by_payment_type": _rate("payment_type"),
    "yearly_risk": Analysis(lambda df: rates.rate_by(_dated(df), "order_year"), ("order_ts", L)),
    "risk_by_top_cities": _top("order_city", 20, ascending=True),
    "delay_by_department": Analysis(
        lambda df: rates.mean_by(cleaning.with_delay(df), "department_name", "delay", "mean_delay"),
        ("department_name", "days_real", "days_scheduled"),
    ),
    "delivery_status_share": Analysis(lambda df: rates.share_by(df, "delivery_status"), ("delivery_status",)),
    "region_category_cells": Analysis(
        lambda df: rates.cells(df).orderBy(*CELL_KEYS), CELL_USES, {"avg_sales": 4}
    ),
    "describe_by_class": Analysis(_describe, (L, *MEASURES, "order_ts"), 3),
    "correlation_matrix": Analysis(_correlations, (L, *MEASURES, "order_ts")),
    "describe_by_class_wide": Analysis(
        lambda df: distribution.describe_wide(_describe(df), L), (L, *MEASURES, "order_ts"), 3
    ),
    "correlation_matrix_wide": Analysis(
        lambda df: distribution.correlation_wide(_correlations(df), _clean_numeric(df)[1]), (L, *MEASURES, "order_ts")
    ),
    "risk_by_all_dims": Analysis(lambda df: rates.rate_by_every(df, DIMENSIONS), (*DIMENSIONS, L)),
    # two-way tables
    "risk_mode_x_region": _pair("shipping_mode", "order_region"),
    "risk_mode_x_region_wide": Analysis(
        lambda df: crosstab.mean_wide(df, "shipping_mode", "order_region"), ("shipping_mode", "order_region", L)
    ),
    "risk_mode_x_segment": _pair("shipping_mode", "customer_segment"),
    "risk_mode_x_segment_wide": Analysis(
        lambda df: crosstab.mean_wide(df, "shipping_mode", "customer_segment"), ("shipping_mode", "customer_segment", L)
    ),
    "status_composition": Analysis(_status_composition, ("order_status", L)),
    "risk_month_x_day": _dated_pair("order_month", "order_day"),
    "risk_yoy": _dated_pair("order_month", "order_year"),
    "risk_market_x_region": _pair("market", "order_region"),
    "risk_segment_x_payment": _pair("customer_segment", "payment_type"),
    "category_region_counts": Analysis(
        lambda df: crosstab.counts_in_top(df, "order_region", "category_name", 10), ("order_region", "category_name")
    ),
    "risk_department_x_payment": _pair("department_name", "payment_type"),
    "transition_matrix": Analysis(crosstab.transition_matrix, ("days_scheduled", "days_real")),
    "status_share_by_region": Analysis(
        lambda df: crosstab.row_shares(df, "order_region", "delivery_status"), ("order_region", "delivery_status")
    ),
    # distributions
    "hist_scheduled_days": Analysis(
        lambda df: distribution.histogram(df, "days_scheduled", 7, 0, 7, L), ("days_scheduled", L)
    ),
    "hist_sales": Analysis(lambda df: distribution.histogram(df, "sales", 60), ("sales",), 4),
    "hist_quantity": Analysis(lambda df: distribution.histogram(df, "quantity", 5, 1, 6, L), ("quantity", L)),
    "log_sales_histogram": Analysis(lambda df: distribution.histogram(_log_sales(df), "log_sales", 50), ("sales",)),
    "residual_histogram": _on_scores(
        lambda s: distribution.histogram(evaluate.with_residual(s), "residual", 50, by="model")
    ),
    "hist_predicted": _on_scores(lambda s: distribution.histogram(s, "p", 10, 0, 1, by="model")),
    "box_discount_rate": Analysis(lambda df: distribution.box_stats(df, "discount_rate", [L]), ("discount_rate", L)),
    "box_profit_ratio": Analysis(lambda df: distribution.box_stats(df, "profit_ratio", [L]), ("profit_ratio", L)),
    "box_benefit": Analysis(lambda df: distribution.box_stats(df, "benefit", [L]), ("benefit", L), 4),
    "box_sched_by_quarter": Analysis(
        lambda df: distribution.box_stats(_dated(df), "days_scheduled", ["order_quarter", L]),
        ("order_ts", "days_scheduled", L),
    ),
    "violin_sched": Analysis(
        lambda df: density.violin(df, "days_scheduled", L, discrete=True), ("days_scheduled", L), KDE_DIGITS
    ),
    "violin_sales": Analysis(lambda df: density.violin(df, "sales", L), ("sales", L), KDE_DIGITS | {"density": 12}),
    "violin_sales_binned": Analysis(
        lambda df: density.violin(df, "sales", L, spacing=0.02), ("sales", L), KDE_DIGITS | {"density": 12}
    ),
    "violin_profit": Analysis(lambda df: density.violin(df, "profit_ratio", L), ("profit_ratio", L), KDE_DIGITS),
    "violin_benefit_segment": Analysis(
        lambda df: density.violin(df, "benefit", "customer_segment"),
        ("benefit", "customer_segment"),
        KDE_DIGITS | {"density": 12},
    ),
    "kde_log_sales": Analysis(
        lambda df: density.kde(_log_sales(df), "log_sales", grid=200, cut=0, scale_bins=50), ("sales",), {"density": 4}
    ),
    "kde_log_sales_binned": Analysis(
        lambda df: density.kde(_log_sales(df), "log_sales", grid=200, cut=0, scale_bins=50, spacing=0.02), ("sales",), {"density": 4}
    ),
    "kde_residuals": _on_scores(lambda s: _residual_density(evaluate.with_residual(s)), {"density": 4}),
    "kde_sched_by_status": Analysis(
        lambda df: density.kde(df, "days_scheduled", ["order_status"], grid=200, cut=3, discrete=True),
        ("days_scheduled", "order_status"),
    ),
    "kde2d_discount_profit": Analysis(
        lambda df: density.kde_2d(distribution.sample_rows(df, 5_000), "discount_rate", "profit_ratio", L),
        ("line_id", "discount_rate", "profit_ratio", L),
    ),
    "sample_scatter": Analysis(
        lambda df: distribution.sample_rows(df, 8_000),
        ("line_id", "days_scheduled", "sales", "discount_rate", "quantity", L),
    ),
    "sample_price_quantity": Analysis(
        lambda df: distribution.sample_rows(df, 5_000), ("line_id", "product_price", "quantity", L)
    ),
    # time series
    "daily_risk_rolling": Analysis(timeseries.daily_rolling_rate, ("order_ts", L)),
    "bullwhip_variance": Analysis(
        timeseries.daily_rolling_variance, ("order_ts", "sales"), {"daily_total": 3, "rolling_variance": -4}
    ),
    "fraud_monthly": Analysis(
        lambda df: timeseries.monthly_count(df, "SUSPECTED_FRAUD"), ("order_ts", "order_status")
    ),
    "pareto_profit": Analysis(timeseries.cumulative_share, ("profit_ratio",)),
    # features
    "one_hot": Analysis(_one_hot, ("line_id", *CATEGORIES)),
    "interactions": Analysis(_interactions, ("line_id", *models.INTERACTIONS)),
    "standardize": Analysis(_standardized, ("line_id", L, *MEASURES, "order_ts")),
    "pca_scree": Analysis(_scree, ("line_id", L, *MEASURES, "order_ts")),
    "pca_projection": Analysis(_pca_projection, ("line_id", L, *MEASURES, "order_ts")),
    "stratified_split": Analysis(lambda df: split.stratified_split(checkpointed(df)), ("line_id", L)),
    "stratified_subsample": Analysis(lambda df: split.stratified_subsample(checkpointed(df)), ("line_id", L)),
    "stratified_folds": Analysis(lambda df: split.stratified_folds(checkpointed(df)), ("line_id", L)),
    # evaluation, on a scorer any engine can compute
    "cell_rate_scores": _on_scores(lambda s: s),
    "confusion_matrix": _on_scores(evaluate.confusion_matrix),
    "classification_metrics": _on_scores(evaluate.classification_metrics),
    "roc_curve": _on_scores(evaluate.roc_curve),
    "roc_auc": _on_scores(evaluate.roc_auc),
    "pr_curve": _on_scores(evaluate.pr_curve),
    "average_precision": _on_scores(evaluate.average_precision),
    "cost_curve": _on_scores(evaluate.cost_curve),
    "cost_optimal_threshold": _on_scores(lambda s: evaluate.cost_optimal_threshold(evaluate.cost_curve(s))),
    "calibration_curve": _on_scores(evaluate.calibration_curve),
    # models
    "lr_scores": _fitted("Logistic Regression"),
    "lr_coefficients": Analysis(_lr_coefficients, MODEL_USES),
    "dt_scores": _fitted("Decision Tree"),
    "dt_importance": Analysis(_dt_importance, MODEL_USES),
    "knn_scores": _fitted("KNN"),
    "mlp_scores": _fitted("Artificial Neural Network"),
    "mlp_loss_curve": Analysis(_mlp_loss, MODEL_USES),
    "dt_importance_top": Analysis(
        lambda df: _dt_importance(df).orderBy(F.desc("importance"), "feature").limit(15), MODEL_USES
    ),
    "net_loss_curve": Analysis(_net_loss, MODEL_USES),
    "net_scores": Analysis(_net_scores, MODEL_USES),
    "dt_exact_nodes": Analysis(_dt_exact_nodes, MODEL_USES),
    "dt_exact_importance": Analysis(_dt_exact_importance, MODEL_USES),
    "model_results": _on_fitted(evaluate.model_results),
    "models_confusion_matrix": _on_fitted(evaluate.confusion_matrix),
    "models_roc_curve": _on_fitted(evaluate.roc_curve),
    "models_pr_curve": _on_fitted(evaluate.pr_curve),
    "models_cost_curve": _on_fitted(evaluate.cost_curve),
    "models_cost_optimal_threshold": _on_fitted(lambda s: evaluate.cost_optimal_threshold(evaluate.cost_curve(s))),
    "models_calibration_curve": _on_fitted(evaluate.calibration_curve),
    "models_hist_predicted": _on_fitted(lambda s: distribution.histogram(s, "p", 10, 0, 1, by="model")),
    "lr_residual_histogram": _on_residuals(
        "Logistic Regression", lambda s: distribution.histogram(s, "residual", 50, by="model")
    ),
    "lr_residual_kde": _on_residuals("Logistic Regression", _residual_density),
    "cv_results": Analysis(_cross_validation, MODEL_USES),
    "permutation_repeats": Analysis(_permutation_repeats, MODEL_USES),
    "permutation_importance": Analysis(
        lambda df: diagnostics.importance_summary(_permutation_repeats(df)), MODEL_USES
    ),
    "learning_curve": Analysis(_learning_curve, MODEL_USES),
    "partial_dependence": Analysis(_partial_dependence, MODEL_USES),
    # clusters
    "kmeans_assignment": Analysis(_kmeans, CELL_USES),
    "kmeans_summary": Analysis(lambda df: clusters.cluster_summary(_kmeans(df)), CELL_USES),
    "kmeans_elbow": Analysis(_elbow, CELL_USES),
    "kmeans_scatter": Analysis(lambda df: clusters.scatter_series(_kmeans(df)), CELL_USES),
    "silhouette_values": Analysis(_silhouette, CELL_USES),
    "silhouette_mean": Analysis(lambda df: clusters.mean_silhouette(_silhouette(df)), CELL_USES),
    "silhouette_by_rule": Analysis(_silhouette_by_rule, CELL_USES),
    # system dynamics
    "entropy_by_region": Analysis(dynamics.entropy_by, ("order_region", "delivery_status")),
    "entropy_mean": Analysis(dynamics.mean_entropy, ("order_region", "delivery_status")),
    "risk_edges": Analysis(dynamics.risk_edges, ("source_market", "order_region", L)),
    "eigenvector_centrality": Analysis(
        lambda df: dynamics.eigenvector_centrality(dynamics.risk_edges(df)), ("source_market", "order_region", L)
    ),
    "kaplan_meier": Analysis(_survival, ("shipping_mode", "days_real")),
    "survival_median": Analysis(lambda df: dynamics.median_survival(_survival(df)), ("shipping_mode", "days_real")),
}

# analyses of every numeric column that a table has, listed or not
MEASURES_OF_ALL = frozenset(
    name
    for name, analysis in ANALYSES.items()
    if analysis.uses is MODEL_USES or analysis.uses == (L, *MEASURES, "order_ts") or analysis.uses == ("line_id", L, *MEASURES, "order_ts")
)
