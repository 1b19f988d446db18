"""Networks and support-vector regression against finite differences and single-process versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import networks
from tidemark.operators.networks import Convolution, Dense, Network
from tidemark.operators.support import SupportVector

NETS = [Dense(6, 2, units=5, layers=2, activation="tanh"), Dense(6, 2, units=4, layers=0), Convolution(12, 12, units=3, layers=2, activation="sigmoid", channels=2, kernel=3), Convolution(8, 8, units=2, layers=1, activation="tanh", channels=1, kernel=5)]
XY = "x array<double>, y array<double>, n int"


def frame(spark, x, y, parts):
    return spark.createDataFrame([(a.tolist(), b.tolist(), i) for i, (a, b) in enumerate(zip(x, y, strict=True))], XY).repartition(parts)


@pytest.mark.parametrize("net", NETS)
def test_gradients_equal_finite_differences(net):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(7, net.inputs)), rng.normal(size=(7, net.outputs))
    flat = networks.drawn(net, 3)
    flat = flat + rng.normal(0, 0.3, len(flat))
    got = networks.gradient(net, flat, x, y)
    assert got[0] == pytest.approx(((networks.forecast(net, flat, x) - y) ** 2).sum())
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (networks.gradient(net, up, x, y)[0] - networks.gradient(net, down, x, y)[0]) / 2e-6
        assert got[1 + i] == pytest.approx(slope, rel=1e-4, abs=1e-5)


def test_convolution_equals_its_definition():
    net = Convolution(6, 6, units=2, layers=1, activation="linear", channels=2, kernel=3)
    rng = np.random.default_rng(5)
    flat, x = rng.normal(size=len(networks.drawn(net, 0))), rng.normal(size=(2, 6))
    w, b, v, e = flat[:18].reshape(3, 3, 2), flat[18:20], flat[20:22], flat[22]
    image = x.reshape(2, 3, 2)
    for n in range(2):
        for s in range(3):
            for c in range(2):
                hidden = b.copy()
                for i in range(3):
                    for j in range(3):
                        if 0 <= s + i - 1 < 3 and 0 <= c + j - 1 < 2:
                            hidden = hidden + w[i, j] * image[n, s + i - 1, c + j - 1]
                assert networks.forecast(net, flat, x)[n].reshape(3, 2)[s, c] == pytest.approx(hidden @ v + e)


def test_training_does_not_depend_on_partitions_and_goes_on(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (300, 4))
    y = np.stack([x[:, 0] * 2 - x[:, 1], np.maximum(x[:, 2], 0)], 1)
    bad = [(None, [1.0, 1.0], 1), ([1.0], [1.0, 1.0], 2), ([1.0, None, 1.0, 1.0], [1.0, 1.0], 3), ([float("nan")] * 4, [1.0, 1.0], 4), ([1.0] * 4, None, 5), ([1.0] * 4, [float("inf"), 1.0], 6)]
    net = Dense(4, 2, units=8)
    one, many = frame(spark, x, y, 1), frame(spark, x, y, 6).unionAll(spark.createDataFrame(bad, XY))
    held = frame(spark, x[:40], y[:40], 2)
    a = Network(net, epochs=6, slices=3, rate=0.02).fit(one, held)
    b = Network(net, epochs=6, slices=3, rate=0.02).fit(many, held)
    assert b.weights == pytest.approx(a.weights, rel=1e-7, abs=1e-9)
    assert a.history[-1] < 0.5 * a.history[0]
    # stopped after two epochs, taken up again from the folder
    Network(net, epochs=2, slices=3, rate=0.02).fit(one, held, str(tmp_path / "state"))
    on = Network(net, epochs=6, slices=3, rate=0.02).fit(many, held, str(tmp_path / "state"))
    assert len(on.history) == 4
    assert on.weights == pytest.approx(a.weights, rel=1e-7, abs=1e-9)
    # one slice, one epoch: a step of Adam on the whole gradient
    small = Network(net, epochs=1, slices=1, rate=0.02).fit(many)
    start = networks.drawn(net, 42)
    g = networks.gradient(net, start, x, y)[1:] / (300 * 2)
    assert small.weights == pytest.approx(start - 0.02 * g / (np.abs(g) + 1e-7), abs=1e-9)
    out = {r["n"]: r["y_pred"] for r in a.predict(one).collect()}
    for i in (0, 17, 299):
        assert out[i] == pytest.approx(networks.forecast(net, a.weights, x[i : i + 1])[0].tolist())
    assert [r["y_pred"] is None for r in a.predict(spark.createDataFrame(bad, XY)).orderBy("n").collect()] == [True, True, True, True, False, False]


def test_network_without_rows(spark):
    net = Dense(2, 1, units=3)
    empty = spark.createDataFrame([], XY)
    model = Network(net, epochs=2, slices=2).fit(empty, empty)
    assert model.weights == pytest.approx(networks.drawn(net, 42))
    assert model.predict(empty).columns == ["x", "y", "n", "y_pred"]
    assert model.predict(empty).collect() == []


def test_patience_keeps_the_best_weights(spark):
    x = np.random.default_rng(4).uniform(-1, 1, (60, 2))
    train, held = frame(spark, x, x[:, :1], 2), frame(spark, x, -x[:, :1], 2)
    model = Network(Dense(2, 1, layers=0), epochs=9, slices=1, rate=0.05).fit(train, held)
    assert len(model.history) == 3  # the first epoch is the best there will be
    first = Network(Dense(2, 1, layers=0), epochs=1, slices=1, rate=0.05).fit(train)
    assert model.weights == pytest.approx(first.weights)


# --- support vectors -----------------------------------------------------------------------


def solved(phi, y, c, epsilon):
    """The dual by coordinate descent; the bias by a constant feature would be penalised, so pairs of rows move."""
    k, n = phi @ phi.T, len(y)
    a, f = np.zeros(n), np.zeros(n)
    for _ in range(20000):
        up, down = y - f - epsilon * np.where(a >= 0, 1, -1), y - f + epsilon * np.where(a > 0, -1, 1)
        i, j = int(np.argmax(np.where(a < c, up, -np.inf))), int(np.argmin(np.where(a > -c, down, np.inf)))
        if up[i] - down[j] < 1e-6:
            break
        most = min(c - a[i] if a[i] >= 0 else -a[i], c + a[j] if a[j] <= 0 else a[j])
        t = min(most, (up[i] - down[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12))
        a[i], a[j] = a[i] + t, a[j] - t
        a[np.abs(a) < 1e-12] = 0.0
        f = k @ a
    return 0.5 * a @ f, f, up[i]


@pytest.mark.parametrize(("kernel", "c", "epsilon"), [("linear", 1.0, 0.1), ("poly", 0.5, 0.05), ("rbf", 2.0, 0.1)])
def test_objective_is_that_of_the_dual(spark, kernel, c, epsilon):
    rng = np.random.default_rng(6)
    x = rng.uniform(-2, 2, (120, 2))
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1] + rng.normal(0, 0.2, 120)
    rows = [(float(a), float(b), float(v)) for (a, b), v in zip(x, y, strict=True)]
    bad = [(None, 1.0, 1.0), (1.0, float("nan"), 1.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows + bad, "a double, b double, y double").repartition(4)
    model = SupportVector(kernel, c, epsilon, size=40).fit(df, ["a", "b"])
    z = (x - x.mean(0)) / x.std(0)
    phi = model.phi(z)
    if kernel == "poly":
        assert phi @ phi.T == pytest.approx(((z @ z.T) / 2) ** 3)
    own, f, b = solved(phi, y, c, epsilon)
    best = own + c * np.maximum(np.abs(y - f - b) - epsilon, 0).sum()
    assert best * (1 - 1e-3) <= model.objective <= best * 1.01
    assert 0 <= model.gap <= 0.01 * best
    out = model.predict(df).collect()
    assert [r["y_pred"] is None for r in out] == [r["a"] is None or r["b"] != r["b"] for r in out]
    made = {(r["a"], r["b"]): r["y_pred"] for r in out}
    assert [made[r[:2]] for r in rows] == pytest.approx(phi @ model.weights[:-1] + model.weights[-1])


def test_random_features_approach_the_radial_kernel():
    model = SupportVector("rbf", size=20000)
    z = np.random.default_rng(3).normal(size=(20, 3))
    phi = model._map(3)(z)
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    assert phi @ phi.T == pytest.approx(np.exp(-d / 3), abs=0.05)


def test_support_edge_cases(spark):
    empty = spark.createDataFrame([], "a double, y double")
    assert SupportVector().fit(empty, ["a"]).predict(empty).collect() == []
    flat = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, y double")
    assert [r["y_pred"] for r in SupportVector("linear").fit(flat, ["a"]).predict(flat).collect()] == pytest.approx([2.0] * 5, abs=0.11)
    untaught = SupportVector().fit(flat.withColumn("y", F.lit(None).cast("double")), ["a"])
    assert [r["y_pred"] for r in untaught.predict(flat).collect()] == [None] * 5
