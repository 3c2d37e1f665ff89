"""Fitted operators against a second computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from parcelwise.operators import clusters, diagnostics, features, knn, many_fits, models, relu_net
from parcelwise.plans import catalogue
from parcelwise.sources.star import order_lines

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    lines = order_lines(spark, SMALL, catalogue.MODEL_USES)
    with catalogue.preparing(lines, ["profit_ratio"]) as prepared:
        yield prepared


def arrays(df, column):
    pdf = df.select(vector_to_array(F.col(column)).alias("x"), "y", "line_id").orderBy("line_id").toPandas()
    return np.stack(pdf["x"]), pdf["y"].to_numpy(), pdf["line_id"].to_numpy()


@pytest.mark.parametrize("n_cells,block", [(1, 4000), (40, 4000), (40, 7)])
def test_neighbours_equal_brute_force(spark, n_cells, block):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(500, 4)).round(1)
    x[:, 0] += 5 * (np.arange(500) % n_cells)
    label = rng.integers(0, 2, 500).astype(float)
    ids = [f"p{i:04d}" for i in range(500)]
    cell = [str(c) for c in np.arange(500) % n_cells]
    points = spark.createDataFrame(list(zip(ids, x.tolist(), label.tolist(), cell)), "id string, x array<double>, label double, cell string")
    qx = np.r_[x[:60], rng.normal(size=(20, 4)).round(1) + 3]
    qc = cell[:60] + ["elsewhere"] * 20
    queries = spark.createDataFrame([(f"q{i}", v, c) for i, (v, c) in enumerate(zip(qx.tolist(), qc))], "q string, x array<double>, cell string")
    got = knn.neighbours(points, queries, 15, block_rows=block).toPandas()
    assert len(got) == 80 * 15
    for i in range(80):
        d = np.round(((x - qx[i]) ** 2).sum(1), 9)
        want = [ids[j] for j in np.lexsort((np.arange(500), d))[:15]]
        assert got[got.q == f"q{i}"].sort_values(["d", "id"])["id"].tolist() == want


def test_merged_cells_give_the_same_neighbours(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 3))
    rows = [(str(i), v, 1.0, str(i % 50)) for i, v in enumerate(x.tolist())]
    points = spark.createDataFrame(rows, "id string, x array<double>, label double, cell string")
    queries = points.select(F.col("id").alias("q"), "x", "cell").limit(30)
    columns = ["q", "id"]
    plain = knn.neighbours(points, queries, 5).select(*columns).toPandas().sort_values(columns)
    merged = knn.neighbours(points, queries, 5, max_cells=7).select(*columns).toPandas().sort_values(columns)
    assert plain.to_numpy().tolist() == merged.to_numpy().tolist()


@pytest.mark.parametrize("leaf", [1, 20, 256])
def test_box_tree_equals_brute_force(leaf):
    """Dummies, ties, repeated points, flat columns and queries outside of all boxes."""
    rng = np.random.default_rng(17)
    x = np.c_[rng.normal(size=(700, 3)).round(1), 4.0 * np.eye(6)[rng.integers(0, 6, 700)], np.ones(700)]
    x[600:650] = x[0]
    q = np.r_[x[:100], rng.normal(size=(30, 10)) * 5]
    tree = knn.BoxTree(x, leaf)
    rank = rng.permutation(700)
    query, point, d = tree.nearest(q, rank, 15)
    for i in range(len(q)):
        every = np.round(((x - q[i]) ** 2).sum(1), 9)
        want = np.lexsort((rank, every))[:15]
        assert point[query == i].tolist() == want.tolist() and d[query == i].tolist() == every[want].tolist()
    assert tree.compared < len(q) * len(x)
    few = knn.BoxTree(x[:4], leaf).nearest(q[:2], np.arange(4), 15)
    assert few[0].tolist() == [0] * 4 + [1] * 4


def test_box_trees_compare_ever_fewer_pairs():
    """Ten times the points take far less than a hundred times the comparisons of as many more queries."""
    rng = np.random.default_rng(18)
    shares = []
    for n in (2_000, 20_000):
        x = np.c_[rng.normal(size=(n, 2)), 5.0 * np.eye(30)[rng.integers(0, 30, n)]]
        tree = knn.BoxTree(x, 64)
        tree.nearest(x[: n // 20], np.arange(n), 15)
        shares.append(tree.compared / (n // 20) / n)
    assert shares[0] < 1 / 3 and shares[1] < shares[0] / 5


def test_crowded_leaves_and_few_points(spark):
    """More equal points than a group holds, and fewer points than neighbours asked for."""
    rows = [(f"{i:03d}", [1.0, 2.0] if i < 90 else [float(i), 0.0], float(i % 2)) for i in range(100)]
    points = spark.createDataFrame(rows, "id string, x array<double>, label double")
    queries = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [95.2, 0.0])], "q string, x array<double>")
    got = {(r["q"], r["id"]) for r in knn.neighbours(points, queries, 20, block_rows=10).select("q", "id").collect()}
    x = np.array([r[1] for r in rows])
    want = {(q, rows[j][0]) for q, v in (("a", [1, 2]), ("b", [95.2, 0])) for j in np.lexsort((np.arange(100), np.round(((x - v) ** 2).sum(1), 9)))[:20]}
    assert got == want
    assert knn.neighbours(points.limit(3), queries, 20).count() == 6
    assert knn.neighbours(points.limit(0), queries, 20).count() == 0
    assert knn.neighbours(points, queries.limit(0), 20).count() == 0


def test_design_counts_and_scaling(data):
    x, _, _ = arrays(data.train, "features")
    raw, _, _ = arrays(data.train, "raw")
    assert x.shape[1] == len(data.design.names) == len(set(data.design.names))
    std = raw.std(axis=0)
    np.testing.assert_allclose(x.std(axis=0)[std > 0], 1, atol=1e-9)
    centred = np.arange(x.shape[1]) < data.design.numbers
    want = np.where(centred, raw - raw.mean(axis=0), raw)[:, std > 0] / std[std > 0]
    np.testing.assert_allclose(x[:, std > 0], want, atol=1e-9)
    assert {type(v).__name__ for v, in data.train.select("features").limit(50).collect()} == {"SparseVector"}
    assert np.abs(x[:, std == 0]).max() == 0


def test_logistic_regression_is_at_the_optimum_of_the_penalised_loss(data):
    model = models.fit("lr", models.logistic_regression(data.n_train), data.train)
    x, y, _ = arrays(data.train, "features")
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    gradient = x.T @ (p - y) + w
    assert np.abs(gradient).max() / len(y) < 1e-4
    assert abs((p - y).mean()) < 1e-4


def test_tree_importances_sum_to_one_and_partial_dependence_equals_brute_force(spark, data):
    model = models.fit("dt", models.decision_tree(depth=5), data.train)
    table = models.importance_table(spark, data.design.names, model).toPandas()
    assert table["importance"].sum() == pytest.approx(1)
    names = ("days_scheduled", "sales")
    got = diagnostics.partial_dependence(data.train, model, data.design.names, names, grid=6).toPandas()
    raw, _, _ = arrays(data.train, "raw")
    assert sorted(got[got.feature == "days_scheduled"]["x"]) == [0, 1, 2, 4]
    assert len(got[got.feature == "sales"]) == 6
    for r in got.itertuples():
        changed = raw.copy()
        changed[:, data.design.names.index(r.feature)] = r.x
        df = spark.createDataFrame(pd.DataFrame({"v": changed.tolist()})).select(array_to_vector("v").alias("raw"))
        mean = model.transform(df).agg(F.avg(vector_to_array("probability")[1])).first()[0]
        assert r.mean_p == pytest.approx(mean, abs=1e-9)


def test_permutation_importance_finds_the_features_that_matter(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 4))
    y = (2 * x[:, 0] + x[:, 1] > 0).astype(float)
    rows = [(str(i), v, t) for i, (v, t) in enumerate(zip(x.tolist(), y.tolist()))]
    df = spark.createDataFrame(rows, "line_id string, v array<double>, y double").withColumn("features", array_to_vector("v"))
    got = diagnostics.permutation_importance(df, list("abcd"), [2, 1, 0, 0], 0.0, bucket_rows=700).toPandas().set_index("feature")
    assert got.index.tolist()[:2] == ["a", "b"] and got.loc[["c", "d"], "mean"].abs().max() == 0
    z = 2 * x[:, 0] + x[:, 1]
    want = np.mean([1 - ((z + 2 * (rng.permutation(x[:, 0]) - x[:, 0]) > 0) == y).mean() for _ in range(20)])
    assert got.loc["a", "mean"] == pytest.approx(want, abs=0.02)


def test_silhouette_equals_brute_force_for_any_block_size(spark):
    rng = np.random.default_rng(13)
    x = np.r_[rng.normal(size=(30, 2)), rng.normal(size=(25, 2)) + 8, [[40.0, 40.0]]]
    c = np.r_[np.zeros(30), np.ones(25), [2]].astype(int)
    rows = [(f"p{i:02d}", *v, int(g)) for i, (v, g) in enumerate(zip(x.tolist(), c))]
    df = spark.createDataFrame(rows, "id string, u double, v double, cluster int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            want.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, c == o].mean() for o in set(c) - {c[i]})
        want.append((b - a) / max(a, b))
    for block in (2000, 9):
        got = clusters.silhouette(df, ["u", "v"], ["id"], block_rows=block).toPandas()
        np.testing.assert_allclose(got["silhouette"], want, atol=1e-12)
    assert got["silhouette"].iloc[:-1].min() > 0.4


def test_kmeans_splits_two_blobs_and_numbers_them_by_rate(spark):
    rng = np.random.default_rng(14)
    rows = [(f"r{i}", "c", float(0.2 + 0.6 * (i % 2) + 0.01 * rng.random()), 2.0 + (i % 2), 10.0, 50) for i in range(40)]
    cells = spark.createDataFrame(
        rows, "order_region string, category_name string, late_risk_rate double, avg_scheduled_days double, avg_sales double, order_volume long"
    )
    got = clusters.kmeans_assignment(cells, k=2).toPandas()
    assert ((got["late_risk_rate"] > 0.5).astype(int) == got["cluster"]).all()
    summary = clusters.cluster_summary(clusters.kmeans_assignment(cells, k=2)).toPandas()
    assert summary["cells"].tolist() == [20, 20]


def test_principal_components_equal_numpy(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd"))).withColumn("line_id", F.lit("x"))
    model, table = features.principal_components(df, list("abcd"), 4)
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    np.testing.assert_allclose(table.toPandas()["explained"], values / values.sum(), atol=1e-9)
    scores = features.project(df, model, list("abcd"), ["line_id"]).toPandas()
    np.testing.assert_allclose(scores["pc1"].var(ddof=1), values[0], rtol=1e-3)


def test_permutations_do_not_depend_on_the_buckets(spark):
    rng = np.random.default_rng(16)
    x, y = rng.normal(size=(500, 3)), rng.integers(0, 2, 500).astype(float)
    rows = [(str(i), v, t) for i, (v, t) in enumerate(zip(x.tolist(), y.tolist()))]
    df = spark.createDataFrame(rows, "line_id string, v array<double>, y double").withColumn("features", array_to_vector("v"))
    tables = [
        {(r["feature"], r["repeat"]): r["decrease"] for r in diagnostics.permutation_repeats(df, list("abc"), [1, -2, 0.5], 0.1, repeats=3, bucket_rows=b).collect()}
        for b in (10_000, 60, 7)
    ]
    assert len(tables[0]) == 9 and tables[0] == tables[1] == tables[2]
    # by hand, from the order of the hashes
    orders = df.select("line_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("repeat"))
    orders = orders.withColumn("h", F.xxhash64(F.lit(42), "repeat", "line_id")).orderBy("repeat", "h").toPandas()
    z, late = x @ np.array([1, -2, 0.5]) + 0.1, y == 1
    for repeat, part in orders.groupby("repeat"):
        order = part["line_id"].astype(int).to_numpy()
        before = np.empty(500, int)
        before[order] = np.roll(order, 1)
        for j, (name, w) in enumerate(zip("abc", (1, -2, 0.5))):
            moved = z + (x[before, j] - x[:, j]) * w
            want = ((z > 0) == late).mean() - ((moved > 0) == late).mean()
            assert tables[0][name, repeat] == pytest.approx(want)


def test_the_net_ends_by_its_tolerance_or_after_300_steps(data):
    net = models.neural_net(len(data.design.names))
    assert net.getMaxIter() == 300
    steps = models.loss_curve(data.train.sparkSession, models.fit("net", net, data.train)).toPandas()
    assert len(steps) <= 302 and steps["loss"].iloc[-1] < steps["loss"].iloc[0]


def test_the_elbow_at_k_is_the_cost_of_the_clustering_with_k(spark):
    lines = order_lines(spark, SMALL, catalogue.CELL_USES)
    from parcelwise.operators import rates

    cells = rates.cells(lines, min_volume=1)
    costs = {r["k"]: r["cost"] for r in clusters.elbow(cells, catalogue.CELL_KEYS, (2, 4)).collect()}
    points = clusters.cell_features(cells, catalogue.CELL_KEYS)
    assigned = clusters.kmeans_assignment(cells, catalogue.CELL_KEYS).select(*catalogue.CELL_KEYS, "cluster")
    pdf = points.join(assigned, list(catalogue.CELL_KEYS)).toPandas()
    x = pdf[list(clusters.MEASURES)].to_numpy()
    cost = sum(((x[pdf["cluster"] == c] - x[pdf["cluster"] == c].mean(0)) ** 2).sum() for c in range(4))
    assert costs[4] == pytest.approx(cost, rel=1e-6) and costs[2] > costs[4]


def test_large_tables_cache_coded_rows(spark, monkeypatch):
    """The same vectors, made of rows that take less than a third of the room (F15 to F28)."""
    lines = order_lines(spark, SMALL, catalogue.MODEL_USES)
    rows = []
    for most in (models.CACHED_ROWS, 10):
        monkeypatch.setattr(models, "CACHED_ROWS", most)
        with catalogue.preparing(lines) as data:
            made = [df.select("line_id", "y", vector_to_array("raw").alias("r"), vector_to_array("features").alias("f")).collect() for df in (data.train, data.test)]
            cached = data.train._jdf.queryExecution().withCachedData().toString()
            # only the small table's vectors are cached themselves
            assert ("InMemoryRelation" in cached) and ("raw#" in cached.split("InMemoryRelation")[1].split("]")[0]) == (most > 10)
        rows.append([sorted(map(tuple, part)) for part in made])
    assert rows[0] == rows[1] and len(rows[0][0]) > 1000


def test_factors_of_products_need_not_be_numbers_themselves(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "x"), (2, None, 5.0, "y"), (3, 4.0, None, None)], "id long, a double, b double, c string")
    design = features.Design(["a"], {"c": ["x", "y"]}, ["a", "b"], ["id"])
    got = {r["id"]: r["x"] for r in design.apply(df).select("id", vector_to_array("raw").alias("x")).collect()}
    assert design.names == ["a", "a b", "c_y"] and got == {1: [2.0, 6.0, 0.0], 2: [0.0, 0.0, 1.0], 3: [4.0, 0.0, 0.0]}


def test_held_blocks_and_points_take_no_disk_twice(spark, monkeypatch):
    """Blocks are held in memory alone, for both nets; a search keeps one copy of its points (F3, F4, F22)."""
    rng = np.random.default_rng(60)
    rows = [(str(i), Vectors.dense(v), float(i % 2)) for i, v in enumerate(rng.normal(size=(400, 3)))]
    df = spark.createDataFrame(rows, ["id", "features", "y"])
    blocks = many_fits.feature_blocks(df, [])
    with many_fits.held(blocks) as kept:
        level = kept.kept.getStorageLevel()
        assert level.useMemory and not level.useDisk
    seen, held = [], many_fits.held
    monkeypatch.setattr(relu_net, "held", lambda b: seen.append(b) or held(b))
    relu_net.fit_net(blocks, lambda m: np.zeros((len(m), 1), bool), (2,), 2)
    assert len(seen) == 1
    points = df.select("id", vector_to_array("features").alias("x"), F.col("y").alias("label"))
    gone, drop = [], knn.discard
    monkeypatch.setattr(knn, "discard", lambda spark, path: gone.append(path) or drop(spark, path))
    near = knn.neighbours(points, points.select(F.col("id").alias("q"), "x"), 3, block_rows=50)
    assert near.count() == 1200 and len(gone) == 1


def test_turns_follow_queries_and_cores():
    """Points go to each turn of their group: where groups are many, turns are large (F3, F6, F8, F12)."""
    assert knn.turn_rows(120_000, 118) == 8_192  # few groups: as many turns as cores take
    assert knn.turn_rows(200_000_000, -400) == knn.turn_rows(200_000_000, 100) == 65_536
    assert knn.turn_rows(1_000_000, 50) == 20_000 and knn.turn_rows(0, 0) == 8_192
