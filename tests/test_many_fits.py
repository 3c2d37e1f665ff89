"""Shared fits against the gradient of their losses and fits of one table each."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from parcelwise.operators import diagnostics, many_fits, models
from parcelwise.operators.evaluate import classification_metrics

ROWS, WIDTH, FITS = 900, 6, 4


#: Fit k has the rows of all groups but k; the last fit has all.
member = lambda marks: marks[:, :1] != np.array([0, 1, 2, -5])  # noqa: E731  # workers don't know this module


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(ROWS, WIDTH)) * [1, 30, 1, 1, 0, 1] + [0, 500, 0, 0, 3, 0]
    x[:, 2:4] = rng.random((ROWS, 2)) < 0.2
    y = (rng.random(ROWS) < 1 / (1 + np.exp(-(x[:, 0] + 0.02 * (x[:, 1] - 500) - x[:, 2])))).astype(float)
    group = rng.integers(0, 3, ROWS)
    rows = []
    for k in range(ROWS):
        dense = Vectors.dense(x[k])
        v = dense if k % 3 == 0 else Vectors.sparse(WIDTH, [(j, float(c)) for j, c in enumerate(x[k]) if c])
        rows.append((v, float(y[k]), int(group[k]) if k else None))
    group[0] = -1  # a null mark
    return x, y, group[:, None], spark.createDataFrame(rows, ["features", "y", "group"]).repartition(3)


@pytest.mark.parametrize("block", [1 << 19, 64])
def test_blocks_hold_the_rows(table, monkeypatch, block):
    x, y, marks, df = table
    monkeypatch.setattr(many_fits, "BLOCK_NUMBERS", block)
    blocks = many_fits.feature_blocks(df, ["group"])
    assert (blocks.width, blocks.marks) == (WIDTH, 1)
    sums = many_fits.added(blocks, lambda a, b, m: np.vstack([a.T @ (m == 1), b @ (m == 1), (m == -1).sum(axis=0)]), (WIDTH + 2, 1))
    inside = marks[:, 0] == 1
    np.testing.assert_allclose(sums[:, 0], [*x[inside].sum(axis=0), y[inside].sum(), 1])


@pytest.mark.parametrize("scaled", [False, True])
def test_every_fit_is_at_its_optimum(table, scaled):
    x, y, marks, df = table
    blocks = many_fits.feature_blocks(df, ["group"])
    scale = many_fits.standard_scale(blocks, member, FITS, 2) if scaled else None
    fitted = many_fits.logistic_fits(blocks, member, FITS, scale=scale)
    inside = member(marks)
    assert fitted.n.tolist() == inside.sum(axis=0).tolist() and fitted.gradient.max() <= 1e-6
    for k in range(FITS):
        a, b = x[inside[:, k]], y[inside[:, k]]
        n = len(b)
        if scaled:
            std = a.std(axis=0)
            factor = np.where(std > 1e-9, 1 / np.maximum(std, 1e-9), 0)
            centre = np.where(np.arange(WIDTH) < 2, a.mean(axis=0), 0)
            np.testing.assert_allclose(scale.factor[:, k], factor, rtol=1e-6)
            np.testing.assert_allclose(scale.centre[:, k], centre, rtol=1e-9)
        else:
            factor, centre = np.ones(WIDTH), np.zeros(WIDTH)
        p = 1 / (1 + np.exp(-(a @ fitted.weights[:, k] + fitted.intercept[k])))
        own = np.divide(fitted.weights[:, k], factor, out=np.zeros(WIDTH), where=factor > 0)
        gradient = (factor * (a - centre)).T @ (p - b) / n + own / n
        assert np.abs(gradient).max() < 1e-5 and abs((p - b).mean()) < 1e-5


def test_confusion_counts(table):
    x, y, marks, df = table
    blocks = many_fits.feature_blocks(df, ["group"])
    fitted = many_fits.logistic_fits(blocks, member, FITS)
    inside = member(marks)
    got = {(k, part): tuple(c) for k, part, *c in many_fits.confusion(blocks, fitted, {"in": member, "out": lambda m: ~member(m)})}
    flagged, late = x @ fitted.weights + fitted.intercept > 0, (y == 1)[:, None]
    for k in range(FITS):
        for name, rows in (("in", inside[:, k]), ("out", ~inside[:, k])):
            f, t = flagged[rows, k], late[rows, 0]
            want = (len(f), (f & t).sum(), (f & ~t).sum(), (~f & t).sum(), (f == t).sum())
            assert got.get((k, name)) == (tuple(int(v) for v in want) if len(f) else None)


def test_fits_without_rows_or_with_one_class(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), 1.0, 0), (Vectors.dense([0.0, 1.0]), 1.0, 0)], ["features", "y", "group"])
    blocks = many_fits.feature_blocks(df, ["group"])
    fitted = many_fits.logistic_fits(blocks, lambda m: m[:, :1] == np.array([0, 1]), 2)
    assert fitted.n.tolist() == [2, 0] and fitted.weights[:, 1].tolist() == [0, 0]
    assert (np.array([[1.0, 2.0], [0, 1]]) @ fitted.weights[:, 0] + fitted.intercept[0] > 2).all()
    none = many_fits.feature_blocks(df.limit(0), ["group"])
    empty = many_fits.logistic_fits(none, lambda m: m[:, :1] == np.array([0]), 1)
    assert empty.n.tolist() == [0] and many_fits.confusion(none, empty, {"all": lambda m: m[:, :1] == 0}) == []


def test_learning_curve_equals_separate_fits(spark):
    """F1 of each size by the library's own regression on the same rows."""
    from parcelwise.operators.split import stratified_folds, stratified_prefixes
    from parcelwise.plans import catalogue
    from parcelwise.sources.star import order_lines

    lines = order_lines(spark, "/root/testdata/sf0.001", catalogue.MODEL_USES)
    with catalogue.preparing(lines) as data:
        shares = (0.3, 1.0)
        got = {r["size_index"]: r for r in diagnostics.learning_curve(data, shares, k=2).collect()}
        rows = stratified_folds(data.train.select(data.key, data.label, "y", "features"), 2, data.label, data.key).persist()
        for i in range(2):
            found = []
            for fold in range(2):
                grown = stratified_prefixes(rows.where(F.col("fold") != fold), shares, data.label, data.key)
                train = grown.where(F.col("step") <= i)
                model = models.fit("lr", models.logistic_regression(train.count()).setTol(1e-10), train)
                both = [models.scored(model, t, "lr", []) for t in (train, rows.where(F.col("fold") == fold))]
                found.append((train.count(), *[classification_metrics(s).first()["f1"] for s in both]))
            n, train_f1, held_f1 = np.array(found).T
            assert got[i]["train_size"] == pytest.approx(n.mean())
            assert got[i]["train_f1_mean"] == pytest.approx(train_f1.mean(), abs=2e-3)
            assert got[i]["validation_f1_mean"] == pytest.approx(held_f1.mean(), abs=2e-3)
            assert got[i]["validation_f1_std"] == pytest.approx(held_f1.std(), abs=2e-3)
        rows.unpersist()


def test_sparse_rows_multiply_as_dense_ones(table, monkeypatch):
    """The same fits from blocks that are taken for wide ones."""
    x, y, marks, df = table
    blocks = many_fits.feature_blocks(df, ["group"])
    dense = many_fits.logistic_fits(blocks, member, FITS, scale=many_fits.standard_scale(blocks, member, FITS, 2))
    monkeypatch.setattr(many_fits, "FULL_WIDTH", 3)
    sparse = many_fits.logistic_fits(blocks, member, FITS, scale=many_fits.standard_scale(blocks, member, FITS, 2))
    np.testing.assert_allclose(sparse.weights, dense.weights, atol=1e-3)
    assert sparse.gradient.max() <= 1e-6
    rng = np.random.default_rng(1)
    m = rng.random((7, 5)) * (rng.random((7, 5)) < 0.4)
    row, place = np.nonzero(m)
    s, w, v = many_fits.SparseRows(row, place, m[row, place], m.shape), rng.random((5, 2)), rng.random((7, 3))
    np.testing.assert_allclose(s @ w, m @ w)
    np.testing.assert_allclose((s * s).T @ v, (m * m).T @ v)
    np.testing.assert_allclose(s.sum(axis=0), m.sum(axis=0))


def test_sparse_design_equals_the_dense_one(spark):
    from pyspark.ml.functions import vector_to_array

    from parcelwise.operators.features import Design, category_levels, sparse_design

    rows = [(i, float(i % 7), None if i % 11 == 0 else i * 0.5, ["a", "b", "c", None][i % 4], f"l{i % 13}") for i in range(60)]
    df = spark.createDataFrame(rows, "line_id long, u double, v double, f string, g string")
    design = Design(["u", "v"], category_levels(df, ["f", "g"]), ["u", "v"], ["line_id"])
    want = {r["line_id"]: r["x"] for r in design.apply(df).select("line_id", vector_to_array("raw").alias("x")).collect()}
    got, names, width, numbers = sparse_design(df, ["u", "v"], ["f", "g"], ["u", "v"], ["line_id"])
    assert (width, numbers) == (len(design.names), design.numbers)
    assert [r["feature"] for r in names.orderBy("place").collect()] == design.names
    for r in got.collect():
        x = np.zeros(width)
        x[r["places"]] = r["values"]
        assert x.tolist() == want[r["line_id"]]


def test_a_hundred_thousand_levels_fit_a_model(spark):
    """A level in a thousand decides the label; its weights are the extreme ones."""
    df = spark.range(300_000).select(
        F.concat(F.lit("level"), F.pmod(F.col("id") * 7919, F.lit(100_000))).alias("c"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("u"),
    )
    df = df.withColumn("late_risk", F.when(F.col("c").endswith("777"), 1).when(F.col("c").endswith("333"), 0).otherwise((F.col("u") > 500).cast("int")))
    got = models.wide_coefficients(df, ["u"], ["c"], [], c=1e-4).toPandas()
    assert len(got) == 100_000
    weights = got.set_index("feature")["coefficient"]
    ends = weights[weights.index.str.endswith("777")], weights[weights.index.str.endswith("333")]
    assert ends[0].min() > 0 > ends[1].max() and weights["u"] > 0
