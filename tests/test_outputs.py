"""Models of several outputs against single-process versions."""

import random

import numpy as np
import pytest

from tidemark.operators.outputs import BoostedOutputs, LinearOutputs

rng = random.Random(21)
SCHEMA = "feature string, step int, a double, b double, c double, y double"


def samples(n, outputs=(("x", 0), ("x", 1), ("z", 0))):
    rows = []
    for k, (feature, step) in enumerate(outputs):
        for _ in range(n * (4 if k == 0 else 1)):  # the first output holds most rows
            a, b = rng.uniform(-1, 1), float(rng.randint(0, 5))
            rows.append((feature, step, a, b, 2 * a - b + 3, (k + 1) * a - b * b + rng.gauss(0, 0.1) + 100))
    return rows


def test_linear_outputs(spark):
    rows = samples(40) + [("x", 0, None, 1.0, 1.0, 5.0), ("x", 0, float("inf"), 1.0, 1.0, 5.0), ("x", 1, 1.0, 1.0, 1.0, None), ("lone", 0, 1.0, 2.0, 3.0, 7.0), ("none", 0, 1.0, 1.0, 1.0, None), (None, 3, 1.0, 2.0, 1.0, 4.0), (None, 3, 2.0, 2.0, 1.0, 6.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = LinearOutputs(["feature", "step"]).fit(df, ["a", "b", "c"])
    got = {(r["feature"], r["step"], r["a"], r["b"], r["y"]): r["y_pred"] for r in model.predict(df).collect()}
    assert len(got) == len(rows)
    for key in {(r[0], r[1]) for r in rows}:
        mine = [r for r in rows if (r[0], r[1]) == key]
        used = [r for r in mine if r[5] is not None and all(v is not None and np.isfinite(v) for v in r[2:5])]
        if not used:
            assert all(got[*key, r[2], r[3], r[5]] is None for r in mine)
            continue
        x = np.array([[1, *r[2:5]] for r in used])
        w = np.linalg.lstsq(x, np.array([r[5] for r in used]), rcond=None)[0]
        for r, p in zip(used, x @ w, strict=True):
            assert got[*key, r[2], r[3], r[5]] == pytest.approx(p, abs=1e-8)
    dependent = model.model.where("feature = 'x' and step = 0").first()["weights"]
    assert dependent[2] == 0  # c follows from a and b


def tree(x, g, depth, least):
    """(node -> (input, bin)) and the node of each row."""
    node, splits = np.ones(len(g), dtype=int), {}
    for level in range(depth):
        for k in range(2**level, 2 ** (level + 1)):
            here = node == k
            best = None
            for i in range(x.shape[1]):
                for b in sorted(set(x[here, i])):
                    left = here & (x[:, i] <= b)
                    nl, nr = left.sum(), here.sum() - left.sum()
                    if nl >= least and nr >= least:
                        gain = g[left].sum() ** 2 / nl + g[here & ~left].sum() ** 2 / nr - g[here].sum() ** 2 / here.sum()
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, i, b)
            if best:
                splits[k] = best[1:]
                node[here] = 2 * k + (x[here, best[1]] > best[2])
    return splits, node


def test_boosted_outputs_split_by_split(spark):
    rows = samples(60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = BoostedOutputs(["feature", "step"], rounds=3, step=0.5, depth=2, bins=8, least=5).fit(df, ["a", "b", "c"])
    learned = {(r["feature"], r["step"]): r for r in model.model.collect()}
    values = [sorted(r[2 + i] for r in rows) for i in range(3)]
    bounds = [sorted({float(np.quantile(v, (k + 1) / 8)) for k in range(7)}) for v in values]
    assert [model.bounds[f] for f in "abc"] == [pytest.approx(b) for b in bounds]
    predicted = {tuple(r[:6]): r["y_pred"] for r in model.predict(df).collect()}
    for key, m in learned.items():
        mine = [r for r in rows if (r[0], r[1]) == key]
        x = np.array([[sum(r[2 + i] > e for e in model.bounds[f]) for i, f in enumerate("abc")] for r in mine])
        y = np.array([r[5] for r in mine])
        f = np.full(len(y), y.mean())
        assert [t["round"] for t in m["trees"]] == [0, 1, 2]
        for t in m["trees"]:
            splits, node = tree(x, y - f, 2, 5)
            assert {k: (v["input"], v["bin"]) for k, v in t["tree"].items() if v["input"] is not None} == splits
            f += 0.5 * np.array([(y - f)[node == k].mean() for k in node])
        assert [predicted[r] for r in mine] == pytest.approx(f.tolist())
    assert np.mean([(predicted[r] - r[5]) ** 2 for r in rows]) < 0.2 * np.var([r[5] for r in rows])


def test_boosted_edge_cases(spark):
    rows = [("x", 0, None, 1.0, float("nan"), 1.0), ("x", 0, 1.0, 1.0, 2.0, 3.0), ("x", 0, 1.0, 1.0, 2.0, None)]
    model = BoostedOutputs(["feature", "step"], rounds=1, depth=1, least=1, step=1.0).fit(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"])
    out = model.predict(spark.createDataFrame([*rows, ("other", 1, 1.0, 1.0, 1.0, 1.0)], SCHEMA)).collect()
    assert sorted(((r["feature"], r["y_pred"]) for r in out), key=str) == [("other", None), ("x", 1.0), ("x", 3.0), ("x", 3.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert BoostedOutputs(["feature"], rounds=1).fit(empty, ["a"]).predict(empty).collect() == []
    assert LinearOutputs(["feature"]).fit(empty, ["a"]).predict(empty).collect() == []
