import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelwise.operators import quantiles
from parcelwise.operators.prefix import running_totals
from parcelwise.operators.quantiles import doubles, exact_quantiles, ordered_bits, radix_quantiles


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_plain_cumsum(spark, descending):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": ["a"] * 700 + ["b"] * 300, "v": rng.permutation(1000) / 7.0, "w": rng.integers(1, 9, 1000)})
    out = running_totals(spark.createDataFrame(pdf), "v", ["w"], by=["g"], descending=descending, buckets=8).toPandas()
    want = pdf.sort_values("v", ascending=not descending)
    want["upto_w"] = want.groupby("g")["w"].cumsum()
    merged = out.merge(want, on=["g", "v", "w"], suffixes=("", "_want"))
    assert len(merged) == 1000
    assert (merged["upto_w"] == merged["upto_w_want"]).all()


def test_running_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "v double, w long")
    assert running_totals(empty, "v", ["w"]).count() == 0


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(
        {
            "g": rng.choice(["a", "b"], 5000, p=[0.9, 0.1]),
            "x": rng.normal(size=5000),
            "few": rng.integers(0, 5, 5000).astype(float),
            "same": 3.0,
        }
    )
    pdf.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    out = exact_quantiles(df, ["x", "few", "same"], (0.05, 0.25, 0.5, 0.95), ["g"], accuracy).toPandas()
    assert len(out) == 2 * 3 * 4
    for r in out.itertuples():
        values = pdf[pdf.g == r.g][r.column_name].dropna()
        assert r.n == len(values)
        assert r.value == pytest.approx(np.quantile(values, r.prob), abs=1e-12)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30))
def test_quantiles_of_any_short_column(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    out = exact_quantiles(df, ["x"], (0.0, 0.3, 1.0), accuracy=10).toPandas()
    for r in out.itertuples():
        assert r.value == pytest.approx(np.quantile(values, r.prob), rel=1e-9, abs=1e-9)


ADVERSARIAL = {
    "near": 1.0 + np.arange(3000) * 2.0**-52,  # differ in the last bits only
    "far": np.concatenate([10.0 ** np.linspace(-300, 300, 1500), -(10.0 ** np.linspace(-300, 300, 1500))]),
    "zeros": np.array([-0.0, 0.0, 5e-324, -5e-324] * 750),
    "ends": np.array([np.inf, -np.inf, 1e308, -1e308, 0.0] * 600),
    "one": np.full(3000, -7.25),
}


def test_radix_selection_of_adversarial_columns(spark):
    pdf = pd.DataFrame(ADVERSARIAL)
    pdf["_digit"] = ["a", "b", "b"] * 1000  # a key with the name of a column in use
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=5))
    df = df.withColumnRenamed("_digit", "g")
    probs = (0.0, 0.01, 0.5, 0.77, 1.0)
    out = radix_quantiles(df, [*ADVERSARIAL], probs, ["g"]).toPandas()
    assert len(out) == 2 * 5 * 5
    for r in out.itertuples():
        values = np.sort(pdf[pdf["_digit"] == r.g][r.column_name].to_numpy())
        target = r.prob * (len(values) - 1)
        low = values[int(target)]
        high = values[min(int(target) + 1, len(values) - 1)]
        want = low if target == int(target) else low + (high - low) * (target - int(target))
        assert r.n == len(values) and (r.value == pytest.approx(want, rel=1e-15, abs=0) or np.isnan(want))


def test_radix_selection_equals_numpy_with_gaps(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"x": rng.normal(size=4000), "y": rng.integers(-3, 4, 4000).astype(float), "void": np.nan})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    out = radix_quantiles(df, ["x", "y", "void"]).toPandas()
    assert len(out) == 6
    for r in out.itertuples():
        values = pdf[r.column_name].dropna()
        assert r.n == len(values) and r.value == pytest.approx(np.quantile(values, r.prob), abs=1e-12)
    assert radix_quantiles(df.limit(0), ["x"]).count() == 0


def test_bits_keep_the_order():
    x = np.sort(np.concatenate([*ADVERSARIAL.values()]))
    bits = ordered_bits(x)
    assert (np.diff(bits) >= 0).all() and (doubles(bits) == x).all()
    assert ordered_bits(np.array([np.inf, np.nan]))[1] > ordered_bits(np.array([np.inf]))[0]


def test_a_missed_bracket_is_answered_without_one(spark, monkeypatch):
    """Sketches that are told to be wrong: the values are selected all the same."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"x": rng.normal(size=3000)})
    df = spark.createDataFrame(pdf)
    real = quantiles.F.percentile_approx
    wrong = lambda c, shares, accuracy: real(c, [min(1.0, p + 0.2) for p in shares], accuracy)
    monkeypatch.setattr(quantiles.F, "percentile_approx", wrong)
    out = exact_quantiles(df, ["x"], (0.1, 0.5)).toPandas()
    assert [r.value for r in out.sort_values("prob").itertuples()] == pytest.approx(np.quantile(pdf["x"], [0.1, 0.5]).tolist())
