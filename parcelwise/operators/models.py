"""Classifiers for late delivery: preparation, fitting and scoring."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.columns import all_present
from parcelwise.functions.parallel import side_by_side
from parcelwise.functions.small import checkpointed, sweep
from parcelwise.operators.features import Design, SparseScaler, category_levels, sparse_design
from parcelwise.operators.knn import knn_scores
from parcelwise.operators.many_fits import feature_blocks, logistic_fits, sparse_blocks, standard_scale
from parcelwise.operators.relu_net import net_scores
from parcelwise.operators.sigmoid_net import SigmoidFit, SigmoidNet, fit_net
from parcelwise.operators.split import stratified_split

log = logging.getLogger(__name__)

# fixed values: the categories that become dummies and the columns that are multiplied with one another
CATEGORIES = (
    "payment_type", "category_name", "customer_country", "customer_segment", "department_name", "market",
    "order_region", "order_status", "shipping_mode",
)
INTERACTIONS = ("days_scheduled", "sales", "discount_rate", "quantity")


@dataclass
class Prepared:
    """Feature vectors, split and scaled, with the fitted pieces that made them."""

    design: Design
    scaler: SparseScaler
    train: DataFrame
    test: DataFrame
    n_train: int
    key: str
    label: str


ROWS_PER_TASK = 10_000
MOST_ROWS = 250_000  # whose vectors one task reads, about
CACHED_ROWS = 8_000_000  # whose vectors are cached, at most: some 3 GB


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """Enough partitions for all cores, but no more than there are rows to make tasks worth it.

    Fits run many rounds, each with a task per partition. Takes a checkpointed table; one with more partitions than
    cores is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted, pieces = min(cores, -(-rows // ROWS_PER_TASK)), df.rdd.getNumPartitions()
    if pieces < wanted:
        return df.repartition(wanted, key)
    return df.coalesce(wanted) if pieces <= cores else df


def in_pieces(df: DataFrame, rows: int, key: str) -> DataFrame:
    """At least one partition for every ``MOST_ROWS`` rows, so that what a task reads of the vectors stays as it is.

    As many of them as all cores take in whole turns: fits go over them hundreds of times, and a last turn of a few tasks
    takes as long as any other.
    """
    wanted, cores = -(-rows // MOST_ROWS), df.sparkSession.sparkContext.defaultParallelism
    wanted = -(-wanted // cores) * cores if wanted > 1 else wanted
    return df.repartition(wanted, key) if wanted > 1 and df.rdd.getNumPartitions() < wanted else df


@contextmanager
def prepared(
    df: DataFrame,
    numeric: Sequence[str],
    categories: Sequence[str] = CATEGORIES,
    interactions: Sequence[str] = INTERACTIONS,
    label: str = "late_risk",
    key: str = "line_id",
    carry: Sequence[str] = (),
) -> Iterator[Prepared]:
    """Split, encode and scale. The vectors stay cached while the block runs, since fitting reads them many times.

    Of more than ``CACHED_ROWS`` rows it is the :meth:`Design.coded` ones, which take less than a third of the memory or disk:
    vectors are made of them for each read, as most fits keep blocks of their own.

    ``train`` and ``test`` have the key, ``y``, the carried columns, ``raw`` and ``features`` (scaled).
    """
    # levels, cuts and vectors all read these columns: join and derive them once
    categories = [c for c in categories if c in df.columns]
    df = checkpointed(df.select(*dict.fromkeys([key, label, *numeric, *categories, *interactions, *carry])))
    sweep(df.sparkSession)
    rows = df.count()
    df = spread(df, rows, key)
    keep = list(dict.fromkeys([key, label, "split", *carry]))
    design = Design(numeric, category_levels(df, categories), interactions, keep)
    coded = in_pieces(design.coded(stratified_split(df, label, key)), rows, key)
    vectors = design.assembled(coded).withColumn("y", F.col(label).cast("double"))
    cached = (vectors if rows <= CACHED_ROWS else coded).persist()
    try:
        train, test = vectors.where("split = 'train'"), vectors.where("split = 'test'")
        n = train.count()
        scaler = SparseScaler(train, design.numbers, n)
        yield Prepared(design, scaler, scaler.transform(train), scaler.transform(test), n, key, label)
    finally:
        cached.unpersist()


def logistic_regression(n_train: int, features: str = "features", max_iter: int = 1000, c: float = 1.0):
    """L2-penalised logistic regression. The built-in loss is a mean over rows, hence a penalty of 1 / (c n)."""
    return LogisticRegression(
        featuresCol=features,
        labelCol="y",
        regParam=1.0 / (c * n_train),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-7,
    )


def decision_tree(features: str = "raw", depth: int = 10, bins: int = 256, seed: int = 42):
    return DecisionTreeClassifier(
        featuresCol=features, labelCol="y", impurity="gini", maxDepth=depth, maxBins=bins, seed=seed
    )


def neural_net(n_features: int, hidden: Sequence[int] = (64, 32), max_iter: int = 300, seed: int = 42):
    """Two hidden layers. The built-in network has sigmoid units and fits by L-BFGS until its tolerance or ``max_iter``."""
    return MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="y", layers=[n_features, *hidden, 2], maxIter=max_iter, seed=seed, solver="l-bfgs"
    )


def fitted_net(train: DataFrame, n_features: int, max_iter: int = 300) -> SigmoidFit:
    """The net of :func:`neural_net` from its own first weights, with all gradients of a block as matrix products.

    A loss is the mean over all rows, however they are partitioned.
    """
    shape = neural_net(n_features, max_iter=0)
    # no step at all: the weights are those that the seed draws
    ends = [(Vectors.dense([0.0] * n_features), 0.0), (Vectors.dense([1.0] * n_features), 1.0)]
    drawn = shape.fit(train.sparkSession.createDataFrame(ends, ["features", "y"])).weights.toArray()
    blank = [(np.zeros((a, b)), np.zeros(b)) for a, b in zip(shape.getLayers(), shape.getLayers()[1:])]
    start = time.perf_counter()
    found = fit_net(feature_blocks(train, []), SigmoidNet(blank).like(drawn), max_iter)
    log.info("%s fitted in %.1fs", "Artificial Neural Network", time.perf_counter() - start)
    return found


def scored(model, df: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    """``(keep..., model, y, p)`` of a fitted classifier."""
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(df).select(*keep, F.lit(name).alias("model"), F.col("y").cast("int").alias("y"), p.alias("p"))


def fit(name: str, estimator, train: DataFrame):
    """Fit and log how long it took; time is never part of a result."""
    start = time.perf_counter()
    model = estimator.fit(train)
    log.info("%s fitted in %.1fs", name, time.perf_counter() - start)
    return model


def evaluate_models(
    data: Prepared,
    models: Sequence[str] = ("Logistic Regression", "Decision Tree", "KNN", "Artificial Neural Network"),
    carry: Sequence[str] = (),
    net_iterations: int = 300,
) -> DataFrame:
    """Fit the named models on the training part and score the test part, as one long table."""
    keep = [data.key, *carry]

    def scores_of(name: str) -> DataFrame:
        if name == "KNN":
            # written here: the search goes on beside the other fits, not after them
            return checkpointed(knn_scores(data.train, data.test, data.key, carry=carry, name=name))
        if name == "Artificial Neural Network":
            net = fitted_net(data.train, len(data.design.names), net_iterations).net
            return net_scores(data.test, net, name, keep)
        estimator = {"Logistic Regression": lambda: logistic_regression(data.n_train), "Decision Tree": decision_tree}[name]()
        return scored(fit(name, estimator, data.train), data.test, name, keep)

    # fits that go over the vectors hundreds of times leave cores idle between their passes
    parts = side_by_side(data.train.sparkSession, [lambda name=name: scores_of(name) for name in models])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def coefficient_table(spark, names: Sequence[str], model) -> DataFrame:
    """``(feature, coefficient)``, largest first."""
    rows = sorted(zip(names, (float(v) for v in model.coefficients)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, coefficient double")


def wide_coefficients(
    df: DataFrame,
    numeric: Sequence[str],
    categories: Sequence[str] = CATEGORIES,
    interactions: Sequence[str] = INTERACTIONS,
    label: str = "late_risk",
    c: float = 1.0,
) -> DataFrame:
    """``(feature, coefficient)`` of a logistic regression on any number of dummies, largest first; see :func:`sparse_design`.

    Numbers are standardised and dummies scaled over all rows, as for :func:`coefficient_table`. The driver holds the
    weights. Rare levels that foretell the label have ever larger weights, which takes many passes; a lower ``c`` bounds
    them.
    """
    rows, names, width, numbers = sparse_design(df.where(all_present(label)), numeric, categories, interactions, [label])
    blocks = sparse_blocks(rows, "places", "values", width, y=label)
    scale = standard_scale(blocks, _every_row, 1, numbers)
    fitted = logistic_fits(blocks, _every_row, 1, c, scale)
    # of the scaled entries; one without spread has a weight of 0
    factor = scale.factor[:, 0]
    weights = np.divide(fitted.weights[:, 0], factor, out=np.zeros(width), where=factor > 0)
    table = df.sparkSession.createDataFrame(pd.DataFrame({"place": np.arange(width), "coefficient": weights}), "place long, coefficient double")
    return names.join(table, "place").select("feature", "coefficient").orderBy(F.desc("coefficient"), "feature")


def _every_row(marks: np.ndarray) -> np.ndarray:
    return np.ones((len(marks), 1), bool)


def importance_table(spark, names: Sequence[str], model) -> DataFrame:
    """``(feature, importance)``, largest first; importances sum to 1."""
    rows = sorted(zip(names, (float(v) for v in model.featureImportances.toArray())), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def loss_curve(spark, model) -> DataFrame:
    """``(iteration, loss)`` of a fitted neural net."""
    losses = model.losses if isinstance(model, SigmoidFit) else model.summary().objectiveHistory
    history = [(i, float(v)) for i, v in enumerate(losses)]
    return spark.createDataFrame(history, "iteration int, loss double")
