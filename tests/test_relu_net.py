"""The net with rectified units: its gradient, its steps and its early end, by numpy."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from parcelwise.operators import many_fits, relu_net


def test_gradient_equals_differences():
    rng = np.random.default_rng(51)
    net = relu_net.Net.drawn([4, 6, 3, 1], 1)
    x, y = rng.normal(size=(40, 4)), rng.integers(0, 2, 40).astype(float)
    loss, gradient = net.loss_and_gradient(x, y)
    flat = net.flat
    assert net.penalised.sum() == 4 * 6 + 6 * 3 + 3 and len(flat) == len(gradient)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (net.like(flat + s * step).loss_and_gradient(x, y)[0] for s in (1, -1))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)
    z = net.log_odds(x)
    assert loss == pytest.approx(-np.where(y == 1, np.log(1 / (1 + np.exp(-z))), np.log(1 / (1 + np.exp(z)))).sum())


def adam(net, x, y, held, steps, patience, rate):
    """The same fit in plain numpy."""
    w, m, v = net.flat, 0.0, 0.0
    losses, best, least, waited = [], None, np.inf, 0
    for t in range(steps + 1):
        own = np.where(net.penalised, w, 0)
        loss, g = net.like(w).loss_and_gradient(x[~held], y[~held])
        judged = net.like(w).loss_and_gradient(x[held], y[held])[0] / held.sum()
        losses.append(judged)
        waited = 0 if judged < least - 1e-4 else waited + 1
        if judged < least:
            best, least = w, judged
        if waited >= patience or t == steps:
            break
        g = (g + 1e-4 * own) / (~held).sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8)
    return best, losses


def frame(spark, x, y, held):
    rows = [(int(i), Vectors.dense(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, y, held))]
    return spark.createDataFrame(rows, ["line_id", "features", "y", "held"]).repartition(3)


@pytest.mark.parametrize(("steps", "patience", "rate"), [(8, 10, 0.01), (60, 2, 0.3)])
def test_steps_and_early_end_equal_numpy(spark, steps, patience, rate):
    rng = np.random.default_rng(52)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(300) < 0.2)).astype(float)
    held = np.arange(300) % 5 == 0
    df = frame(spark, x, y, held)
    blocks = many_fits.feature_blocks(df, ["held"])
    net, curve = relu_net.fit_net(blocks, lambda m: m == 1, (8, 4), steps, patience, rate, seed=3)
    best, losses = adam(relu_net.Net.drawn([3, 8, 4, 1], 3), x, y, held, steps, patience, rate)
    np.testing.assert_allclose(net.flat, best, rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose([c[2] for c in curve], losses, rtol=1e-6)
    assert (len(curve) < steps + 1) == (steps == 60)
    if steps == 8:
        got = relu_net.net_scores(df, net, "net", ["line_id"]).toPandas().set_index("line_id")
        np.testing.assert_allclose(got.loc[range(300), "p"], 1 / (1 + np.exp(-net.log_odds(x))))
        assert relu_net.loss_curve(spark, curve).count() == 9


def test_no_rows(spark):
    df = frame(spark, np.ones((2, 2)), [0, 1], [0, 0])
    net, curve = relu_net.fit_net(many_fits.feature_blocks(df.limit(0), ["held"]), lambda m: m == 1, (2,), 3)
    assert curve == []
    _, curve = relu_net.fit_net(many_fits.feature_blocks(df, ["held"]), lambda m: m == 1, (2,), 3)
    assert len(curve) == 4 and np.isnan(curve[0][2])
