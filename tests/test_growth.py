"""What keeps time, memory and shuffles of the fits in proportion to the rows, with the same results."""

import gc
from threading import Barrier

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from test_exact_tree import frame, plain, table_of

from parcelwise.llm import extraction
from parcelwise.operators import density, diagnostics, exact_tree, features, knn, many_fits, models, rates, sigmoid_net
from parcelwise.plans import catalogue


def order_rows(spark, n=1_500):
    """Order lines with the columns that models read."""
    number = lambda c, mod: F.pmod(F.xxhash64("id", F.lit(c)), F.lit(mod))
    made = {c: number(c, 1_000).cast("double") for c in catalogue.MEASURES} | {c: F.concat(F.lit(c[0]), number(c, 4)) for c in catalogue.CATEGORIES}
    lines = spark.range(n).withColumns(made | {"order_ts": F.to_timestamp(F.lit("2020-05-01")), "late_risk": number("y", 2).cast("int")})
    return lines.select(F.concat(F.lit("k"), "id").alias("line_id"), *made, "order_ts", "late_risk")


@pytest.mark.parametrize("name", ["lr_residual_histogram", "lr_residual_kde"])
def test_residuals_fit_their_own_model_only(spark, monkeypatch, name):
    asked = []
    scores = spark.createDataFrame([(f"k{i}", "Logistic Regression", i % 2, i / 20) for i in range(20)], "line_id string, model string, y int, p double")
    monkeypatch.setattr(catalogue, "_fitted_scores", lambda df, *names: asked.append(names) or scores)
    assert catalogue.ANALYSES[name].run(None).count() > 0
    assert asked == [("Logistic Regression",)]


def test_the_sigmoid_net_takes_the_steps_of_the_built_in_one(spark):
    rng = np.random.default_rng(71)
    x = rng.normal(size=(256, 5))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=256) > 0).astype(float)
    df = spark.createDataFrame([(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y))], ["line_id", "features", "y"]).coalesce(1)
    want = models.neural_net(5, max_iter=12).fit(df)
    got = models.fitted_net(df, 5, 12)
    np.testing.assert_allclose(got.losses, want.summary().objectiveHistory, rtol=1e-7)
    np.testing.assert_allclose(got.net.flat, want.weights.toArray(), rtol=1e-4, atol=1e-5)
    p = {r["line_id"]: r["p"] for r in models.scored(want, df, "net", ["line_id"]).collect()}
    for r in models.net_scores(df, got.net, "net", ["line_id"]).collect():
        assert r["p"] == pytest.approx(p[r["line_id"]], abs=1e-5)
    assert models.loss_curve(spark, got).count() == 13
    assert models.fitted_net(df.limit(0), 5, 3).losses == []


def test_the_sigmoid_nets_gradient_equals_differences():
    rng = np.random.default_rng(72)
    net = sigmoid_net.SigmoidNet([(rng.normal(size=s), rng.normal(size=s[1])) for s in ((4, 5), (5, 3), (3, 2))])
    x, y = rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float)
    _, gradient = net.loss_and_gradient(x, y)
    for i in range(len(net.flat)):
        step = np.zeros_like(net.flat)
        step[i] = 1e-6
        up, down = (net.like(net.flat + s * step).loss_and_gradient(x, y)[0] for s in (1, -1))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_the_sigmoid_net_uses_its_arrays_again():
    rng = np.random.default_rng(75)
    net = sigmoid_net.SigmoidNet([(rng.normal(size=s), rng.normal(size=s[1])) for s in ((4, 5), (5, 9), (9, 3), (3, 2))])
    room, held = sigmoid_net.Room(), None
    for n in (40, 7, 0, 40):
        x, y = rng.normal(size=(n, 4)), rng.integers(0, 2, n).astype(float)
        loss, gradient = net.loss_and_gradient(x, y)
        again = net.loss_and_gradient(x, y, room)
        assert again[0] == loss
        np.testing.assert_array_equal(again[1], gradient)
        held = held or {k: id(v) for k, v in room.arrays.items()}
        if not n:
            continue
        row, place = np.nonzero(x)
        sparse = net.loss_and_gradient(many_fits.SparseRows(row, place, x[row, place], x.shape), y, room)
        assert sparse[0] == pytest.approx(loss)
        np.testing.assert_allclose(sparse[1], gradient, rtol=1e-9, atol=1e-12)
    assert len(held) > 5 and held == {k: id(v) for k, v in room.arrays.items()}


def test_models_are_fitted_beside_one_another(spark, monkeypatch):
    """Each of the two waits until the other one has begun."""
    both = Barrier(2, timeout=60)
    neighbours, net = models.knn_scores, models.fitted_net
    monkeypatch.setattr(models, "knn_scores", lambda *a, **k: both.wait() >= 0 and neighbours(*a, **k))
    monkeypatch.setattr(models, "fitted_net", lambda train, width, steps: both.wait() >= 0 and net(train, width, 2))
    with catalogue.preparing(order_rows(spark, 300)) as data:
        names = ["Decision Tree", "KNN", "Artificial Neural Network"]
        scores = models.evaluate_models(data, names)
        assert {r["model"]: r["count"] for r in scores.groupBy("model").count().collect()} == dict.fromkeys(names, data.test.count())


def test_blocks_stay_small(spark):
    """Parquet buffers a hundred of them at least."""
    rows = spark.range(3_000).select(F.array_repeat(F.col("id") + 1.0, 100).alias("x"), F.sequence(F.lit(0), F.lit(99)).alias("places"), F.lit(1.0).alias("y"))
    blocks = many_fits.sparse_blocks(rows.coalesce(1), "places", "x", 100)
    sizes = blocks.table.agg(F.max(F.octet_length("value")), F.max(F.octet_length("at")), F.sum(F.octet_length("y"))).first()
    assert sizes[0] <= 1 << 20 and sizes[1] <= 1 << 19 and sizes[2] == 8 * 3_000


def test_a_task_reads_a_bounded_number_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(models, "MOST_ROWS", 100)
    with catalogue.preparing(order_rows(spark)) as data:
        assert data.train.rdd.getNumPartitions() >= 15
        assert data.train.count() + data.test.count() == 1_500


def test_pieces_of_vectors_fill_whole_turns_of_the_cores(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(models, "MOST_ROWS", 100)
    df = spark.range(100 * cores + 1).repartition(cores)
    dealt = models.in_pieces(df, 100 * cores + 1, "id")
    assert dealt.rdd.getNumPartitions() == 2 * cores and dealt.count() == 100 * cores + 1
    assert models.in_pieces(df.coalesce(1), 100, "id").rdd.getNumPartitions() == 1


def test_held_blocks_give_the_same_sums(spark, monkeypatch):
    rng = np.random.default_rng(74)
    vectors = [(i, Vectors.dense(v), float(i % 3 == 0)) for i, v in enumerate(rng.normal(size=(700, 4)))]
    rows = spark.createDataFrame(vectors, ["line_id", "features", "y"]).repartition(3, "line_id")
    blocks = many_fits.feature_blocks(rows.withColumn("m", F.col("line_id") % 5), ["m"])
    part = lambda x, y, marks: x.T @ np.column_stack([y, marks[:, 0], np.ones(len(y))])
    cached = spark.sparkContext._jsc.getPersistentRDDs
    before = cached().size()
    with many_fits.held(blocks) as kept:
        got = [many_fits.added(kept, part, (4, 3)) for _ in range(2)]
        assert cached().size() == before + 1
        asked = []
        whole = many_fits.added
        monkeypatch.setattr(sigmoid_net, "added", lambda b, *rest: asked.append(b.kept) or whole(b, *rest))
        net = sigmoid_net.SigmoidNet([(np.ones((4, 2)) * [0.1, -0.2], np.zeros(2))])
        losses = sigmoid_net.fit_net(blocks, net, 3).losses
    assert cached().size() == before
    assert len(losses) == 4 and asked and None not in asked and len({id(k) for k in asked}) == 1
    for sums in got:
        np.testing.assert_array_equal(sums, many_fits.added(blocks, part, (4, 3)))
    # too many numbers for the driver: added by a shuffle
    monkeypatch.setattr(many_fits, "DRIVER_NUMBERS", 1)
    with many_fits.held(blocks) as kept:
        np.testing.assert_allclose(many_fits.added(kept, part, (4, 3)), got[0], rtol=1e-12)
    none = many_fits.feature_blocks(rows.limit(0), [])
    with many_fits.held(none) as kept:
        assert many_fits.added(kept, lambda x, y, marks: x, (1, 1)).tolist() == [[0.0]]


def test_a_category_is_one_column_of_the_design(spark, monkeypatch):
    asked, made = [], features.VectorAssembler
    monkeypatch.setattr(features, "VectorAssembler", lambda inputCols, outputCol: asked.append(inputCols) or made(inputCols=inputCols, outputCol=outputCol))
    rows = [(0, 1.0, "a", "x", "only"), (1, None, "b", None, "only"), (2, 3.0, "c", "y", None), (3, 0.0, None, "z", "only"), (4, 2.0, "new", "x", "only")]
    df = spark.createDataFrame(rows, "line_id long, u double, f string, g string, h string")
    design = features.Design(["u"], {"f": ["a", "b", "c"], "g": ["x", "y", "z"], "h": ["only"]}, [], ["line_id"])
    got = design.apply(df)
    vectors = {r["line_id"]: r["raw"].toArray().tolist() for r in got.collect()}
    assert design.names == ["u", "f_b", "f_c", "g_y", "g_z"]
    assert vectors == {0: [1, 0, 0, 0, 0], 1: [0, 1, 0, 0, 0], 2: [3, 0, 1, 1, 0], 3: [0, 0, 0, 0, 1], 4: [2, 0, 0, 0, 0]}
    assert len(asked[0]) == 3  # the number and the categories with dummies
    assert "ml_attr" not in got.schema["raw"].metadata  # trees would split dummies as categories


@pytest.mark.parametrize("part", [3, 1 << 15])
def test_pieces_of_the_exact_tree_follow_one_another(spark, monkeypatch, part):
    rng = np.random.default_rng(73)
    x = np.c_[rng.normal(size=250), rng.integers(0, 40, 250), rng.random(250) < 0.5, np.repeat(rng.normal(size=5), 50)]
    y = (x[:, 0] + x[:, 1] / 20 + rng.normal(size=250) > 1).astype(int)
    monkeypatch.setattr(exact_tree, "PART_VALUES", part)
    monkeypatch.setattr(exact_tree, "PIECE_VALUES", 20)
    monkeypatch.setattr(exact_tree, "HELD_COUNTS", 200)
    blocks = many_fits.feature_blocks(frame(spark, x, y), [], "raw")
    assert len(exact_tree.feature_cuts(blocks)[0]) > 5
    got, want = table_of(exact_tree.exact_tree(blocks, depth=3)), plain(x, y, 3)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    np.testing.assert_allclose([r[6] for r in got], [r[6] for r in want], atol=1e-9)


def test_permuted_vectors_are_shuffled_once(spark):
    df = spark.createDataFrame([(f"k{i}", Vectors.sparse(3, [(0, float(i)), (2, 1.0)]), float(i % 2)) for i in range(40)], ["line_id", "features", "y"])
    got = diagnostics.permutation_repeats(df, list("abc"), [1.0, 2.0, 3.0], -20.0, repeats=2, bucket_rows=5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan  # of vectors, for the ends of buckets
    assert {(r["feature"], r["repeat"]) for r in got.collect()} == {(f, r) for f in "abc" for r in (0, 1)}
    assert diagnostics.permutation_repeats(df.limit(0), list("abc"), [1.0, 2.0, 3.0], 0.0).count() == 0


def test_a_violin_reads_its_rows_once(spark, monkeypatch):
    kept, made = [], density.checkpointed
    monkeypatch.setattr(density, "checkpointed", lambda df: kept.append(df.columns) or made(df))
    df = spark.range(60).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"), F.lit("other").alias("o"))
    assert density.violin(df, "v", "k", grid=5).count() == 10
    assert kept == [["k", "v"]]


def test_weights_by_table_equal_those_by_search():
    steps = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1, np.arange(1, 18)]))
    rng = np.random.default_rng(74)
    near = ((steps[:-1, None] - 0.5) * 2.0**64 + np.arange(-3, 4) * 2048.0).clip(-(2.0**63), 2.0**63 - 2048).astype(np.int64).ravel()
    ends = np.array([-(2**63), -1, 0, 1, 2**63 - 1])
    hashes = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 100_000), near, ends, (np.arange(-(1 << 15), 1 << 15) << 48)])
    want = np.searchsorted(steps, hashes / 2.0**64 + 0.5, "right")
    assert (rates.poisson_weights(hashes, steps, rates.weight_table(steps)) == want).all()


def test_a_parsed_page_goes_with_its_last_use():
    """Trees that only the collector frees pile up in the workers."""
    page = "<html><body><div><p>one<p>two <table><tr><td>a<td>b</table></div><ul><li>x<li>y</ul></body></html>"
    extraction.parsed(page)
    gc.collect()
    gc.disable()
    try:
        for _ in range(5):
            extraction.parsed(page)
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_a_pass_takes_one_row_from_each_task(spark, monkeypatch):
    df = spark.createDataFrame([(Vectors.dense([float(i), 1.0]), float(i % 2)) for i in range(50)], ["features", "y"]).repartition(3)
    blocks = many_fits.feature_blocks(df, [])
    part = lambda x, y, marks: np.array([[x[:, 0].sum(), x[:, 1].sum()], [y.sum(), len(y)]])
    with monkeypatch.context() as m:
        m.setattr(many_fits, "F", None)  # no shuffle adds them
        got = many_fits.added(blocks, part, (2, 2))
    assert got.tolist() == [[1225, 50], [25, 50]]
    monkeypatch.setattr(many_fits, "DRIVER_NUMBERS", 0)
    assert many_fits.added(blocks, part, (2, 2)).tolist() == got.tolist()


@pytest.mark.parametrize("found", [1, 16])
def test_a_reach_spares_points_but_no_neighbour(monkeypatch, found):
    monkeypatch.setattr(knn, "FOUND", found)
    rng = np.random.default_rng(76)
    x = np.c_[rng.normal(size=(900, 2)), rng.integers(0, 2, (900, 3))]
    x[600:] = x[:300]  # ties
    q, rank, k = rng.normal(size=(70, 5)), rng.permutation(900), 6
    d = np.round(((q[:, None] - x[None]) ** 2).sum(axis=2), 9)
    want = [(i, int(j), d[i, j]) for i in range(70) for j in np.lexsort((rank, d[i]))[:k]]
    whole = knn.BoxTree(x, 16)
    assert [*zip(*(c.tolist() for c in whole.nearest(q, rank, k)))] == want
    reach = np.where(np.arange(70) % 7 == 0, np.inf, np.sort(d, axis=1)[:, 2])
    tree = knn.BoxTree(x, 16)
    got = [r for r in zip(*(c.tolist() for c in tree.nearest(q, rank, k, reach))) if r[2] <= reach[r[0]]]
    assert got == [r for r in want if r[2] <= reach[r[0]]]
    assert tree.compared < whole.compared
