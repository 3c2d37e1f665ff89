"""The exact tree against a plain search of every split."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from parcelwise.operators import exact_tree, many_fits


def plain(x, y, depth):
    """Nodes level by level: (feature, threshold, left, right, n, late, gain)."""
    def score(n, late):
        return (late * late + (n - late) * (n - late)) / n

    nodes = [[-1, 0.0, 0, 0, len(y), int(y.sum()), 0.0]]
    level = [(0, np.arange(len(y)))]
    for _ in range(depth):
        following = []
        for i, rows in level:
            n, late = len(rows), int(y[rows].sum())
            best = None
            for f in range(x.shape[1]) if 0 < late < n else ():
                values = np.unique(x[rows, f])
                for low, high in zip(values, values[1:]):
                    side = x[rows, f] <= low
                    a, b = int(side.sum()), int(y[rows][side].sum())
                    s = score(float(a), float(b)) + score(float(n - a), float(late - b))
                    if best is None or s > best[0]:
                        best = (s, f, low, high)
            if best is None:
                continue
            s, f, low, high = best
            side = x[rows, f] <= low
            nodes[i][:4] = f, low + (high - low) / 2, len(nodes), len(nodes) + 1
            nodes[i][6] = max(s - score(n, late), 0.0)
            for part in (rows[side], rows[~side]):
                following.append((len(nodes), part))
                nodes.append([-1, 0.0, len(nodes), 0, len(part), int(y[part].sum()), 0.0])
        level = following
    return nodes


def table_of(tree):
    s = tree.splits
    return [[int(a), float(b), int(c), int(d), int(e), int(f), float(g)] for a, b, c, d, e, f, g in zip(s.feature, s.threshold, s.left, s.right, tree.n, tree.late, tree.gain)]


def frame(spark, x, y):
    rows = [(i, Vectors.dense(v) if i % 2 else Vectors.sparse(len(v), [(j, float(c)) for j, c in enumerate(v) if c]), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["line_id", "raw", "y"]).repartition(3)


@pytest.mark.parametrize("held", [1 << 21, 50])
@pytest.mark.parametrize("piece", [50_000, 7])
def test_equals_a_plain_search(spark, monkeypatch, held, piece):
    rng = np.random.default_rng(41)
    x = np.c_[rng.normal(size=300), rng.integers(0, 3, 300), rng.normal(size=300).round(1), rng.random(300) < 0.3, np.ones(300)]
    y = (x[:, 0] + x[:, 3] + rng.normal(size=300) > 0.3).astype(int)
    monkeypatch.setattr(exact_tree, "HELD_COUNTS", held)
    monkeypatch.setattr(exact_tree, "PIECE_VALUES", piece)
    df = frame(spark, x, y)
    tree = exact_tree.exact_tree(many_fits.feature_blocks(df, [], "raw"), depth=4)
    want = plain(x, y, 4)
    got = table_of(tree)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    np.testing.assert_allclose([r[6] for r in got], [r[6] for r in want], atol=1e-9)
    assert tree.importances(5).sum() == pytest.approx(1) and tree.importances(5)[4] == 0
    if held > 50 and piece > 7:
        scores = exact_tree.exact_tree_scores(df, tree, "Exact Tree", ["line_id"]).toPandas().set_index("line_id")
        share = tree.late / tree.n
        np.testing.assert_allclose(scores.loc[range(300), "p"], share[tree.splits.leaf(x)])
        nodes = tree.table(spark, list("abcde")).toPandas()
        assert len(nodes) == len(want) and nodes["feature"].notna().sum() == (tree.splits.feature >= 0).sum()


def test_ties_go_to_the_lowest_feature_and_value(spark):
    """An exclusive or: no first split gains anything, equal columns gain the same."""
    x = np.array([[0, 0, 0], [0, 1, 1], [1, 0, 0], [1, 1, 1]] * 2, float)
    y = np.array([0, 1, 1, 0] * 2)
    tree = exact_tree.exact_tree(many_fits.feature_blocks(frame(spark, x, y), [], "raw"), depth=3)
    assert table_of(tree) == plain(x, y, 3)
    assert tree.splits.feature.tolist() == [0, 1, 1, -1, -1, -1, -1] and tree.gain[0] == 0


def test_one_class_equal_rows_and_no_rows(spark):
    one = exact_tree.exact_tree(many_fits.feature_blocks(frame(spark, np.eye(3), np.ones(3)), [], "raw"))
    assert table_of(one) == [[-1, 0.0, 0, 0, 3, 3, 0.0]]
    equal = exact_tree.exact_tree(many_fits.feature_blocks(frame(spark, np.ones((4, 2)), [0, 1, 0, 1]), [], "raw"))
    assert table_of(equal) == [[-1, 0.0, 0, 0, 4, 2, 0.0]]
    none = frame(spark, np.ones((1, 2)), [1]).where(F.lit(False))
    assert table_of(exact_tree.exact_tree(many_fits.feature_blocks(none, [], "raw"))) == [[-1, 0.0, 0, 0, 0, 0, 0.0]]
